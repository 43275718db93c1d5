from __future__ import annotations

import random

import pytest

from quire.llm.p4 import pieces


def frame(spark, texts):
    return spark.createDataFrame([("documents", i, t, 5) for i, t in enumerate(texts)], "src_table string, row_id bigint, text string, piece_no int")


def check(texts, rows, limit, overlap, slack):
    by = {}
    for r in rows:
        by.setdefault(r.row_id, []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t and len(t) > limit}
    for i, ps in by.items():
        t, last = texts[i], 0
        for k, p in enumerate(sorted(ps, key=lambda p: p.piece_no)):
            assert p.piece_no == k and p.piece == t[p.start_pos : p.end_pos] and len(p.piece) <= limit
            assert p.start_pos == 0 if not k else overlap - slack <= last - p.start_pos <= overlap
            last = p.end_pos
        assert last == len(t)


def test_round_trip(spark):
    rng = random.Random(4)
    words = ["snow", "Oskin", "눈이", "내렸다.", "雪が降った。", "“Hush!”", "𝒳y", "a,", "b;", "\n\n", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 900))) for _ in range(40)] + [None, "", "x" * 1200, "x" * 1201, "x" * 5000, "\n" * 3000, "가" * 2401]
    check(texts, pieces(frame(spark, texts)).collect(), 1200, 100, 30)


@pytest.mark.parametrize(("limit", "overlap", "slack"), [(120, 20, 6), (60, 0, 0), (80, 20, 0)])
def test_parameters(spark, limit, overlap, slack):
    texts = ["One two three. Four five six seven! Eight nine ten eleven? " * 9, "z" * 333, "a " * 200]
    check(texts, pieces(frame(spark, texts), limit, overlap, slack).collect(), limit, overlap, slack)


def test_boundaries_by_strength(spark):
    para = "A sentence of some length stands here. " * 20
    text = para + "\n\n" + para + "\n\n" + para
    rows = sorted(pieces(frame(spark, [text])).collect(), key=lambda r: r.piece_no)
    assert all(text[: r.end_pos].endswith("\n\n") for r in rows[:-1])
    rows = sorted(pieces(frame(spark, [para * 4])).collect(), key=lambda r: r.piece_no)
    assert all(r.piece.rstrip().endswith(".") for r in rows)


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        pieces(frame(spark, ["x"]), 100, 60, 10)


def test_empty(spark):
    assert pieces(frame(spark, ["short"]).limit(0)).count() == 0
