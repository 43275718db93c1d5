from __future__ import annotations

import random
import unicodedata

import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import p5, truncation
from quire.llm.lookalikes import Classes, Rewriter, build, counted
from quire.llm.p6 import consistent, look_alike_classes

DIR = "/root/testdata/sf0.01"
PLAIN = ["The café of Éloise stood open in Moscow.", "우산이 커 보였다. 3걸음", "ロリモンドは卜書き口調で工夫した。ト", "Тихая пристань", "ΦΩΣ ΗΜΕΡΑΣ", "で"]
ODD = ["".join(map(chr, range(0xFF01, 0xFF5F))), "\ufb01\ufb00\u00a0\u2003\u3000\u200b\u200c\u00ad\u2060\uff71\u0405\u0408\u043e\u0435\u0392\u03a4", unicodedata.normalize("NFD", "우산이 커 보였다. Éloise が")]
R = Rewriter(build(counted(PLAIN * 3 + ODD)))


def test_union_find():
    u = Classes()
    for a, b in ("ab", "cd", "bc"):
        u.union(a, b)
    u.find("z")
    assert sorted(map(sorted, u.members())) == [["a", "b", "c", "d"], ["z"]]


def test_what_changes():
    for odd, plain in {
        "Ｍｒ. Oskin": "Mr. Oskin",
        "우산이 커 보였다．": "우산이 커 보였다.",
        "“쉿！” 그가": "“쉿!” 그가",
        unicodedata.normalize("NFD", "우산이 커 보였다."): "우산이 커 보였다.",
        unicodedata.normalize("NFD", "Éloise"): "Éloise",
        "ofﬁce aﬀair": "office affair",
        "낡은 하숙집 쪽을 보게": "낡은 하숙집 쪽을 보게",
        "열‌렸­다⁠.": "열렸다.",
        "Ѕt. J. Oskin": "St. J. Oskin",
        "(vоl. 2)": "(vol. 2)",
        "Тhe light": "The light",
        "Ј. R. 더넉": "J. R. 더넉",
        "エ口ワーズと卜マシン": "エロワーズとトマシン",
        "が": "が",
        "오스킨이　토머신에게": "오스킨이 토머신에게",
    }.items():
        assert R.rewrite(odd) == plain


def test_what_stays():
    for t in ("「なんと！」（雪）そう。", "　翌朝、雪が降った。", "第二章　手袋", "没有人知道，真的！", "«Тихая пристань»라고", "ΦΩΣ ΗΜΕΡΑΣ라는 글", "Éloise “said” — so…", "Утром в саду нашли зонт, и Oskin промолчал.", "口で言う工夫", "", "　"):
        assert R.rewrite(t) == t
        assert R.rewrite(t) is t or not t


@given(st.text())
def test_rewriting_is_stable(t):
    once = R.rewrite(t)
    assert R.rewrite(once) == once


def test_consistent(spark):
    df = spark.createDataFrame([("documents", 1, "Ａ b", 0), ("documents", 2, "A b", 0), ("documents", 3, None, 0), ("documents", 4, "　", 0)], "src_table string, row_id bigint, text string, changed int")
    got = {r.row_id: (r.text, r.changed) for r in consistent(df, look_alike_classes(df)).collect()}
    assert got == {1: ("A b", True), 2: ("A b", False), 3: (None, False), 4: ("　", False)}
    assert consistent(df.limit(0), look_alike_classes(df.limit(0))).count() == 0


def test_held_out_cuts():
    texts = [x for x in pq.read_table(f"{DIR}/translations.parquet").column("t").to_pylist() + pq.read_table(f"{DIR}/documents.parquet").column("text").to_pylist() if x]
    random.Random(1).shuffle(texts)
    w = truncation.fit(texts[:3500])
    xs, ys = truncation.examples(texts[3500:5500], random.Random(2))
    said = [truncation.score(w, x) > p5.CUT_OVER for x in xs]
    found = sum(a and b for a, b in zip(said, ys, strict=True))
    assert found / sum(ys) > 0.95 and found / sum(said) > 0.97


def test_odd_values():
    w = truncation.fit(["He left the house. She stayed at home all day.", "It was late."] * 30)
    for t in (None, "", " ", "* * *", "<em></em>", "a\n\n* * *"):
        assert truncation.score(w, t) == float("-inf")
    assert not truncation.fit([]).any()


def test_rates(spark):
    df = spark.createDataFrame([("documents", 1, "He left the hou", None, False), ("documents", 2, None, "s", False)], "src_table string, row_id bigint, text string, origin string, heading boolean")
    rows = p5.scored(df, truncation.fit([])).collect()
    assert [(r.row_id, r.cut) for r in rows] == [(1, False), (2, False)]
    assert p5.scored(df.limit(0), p5.fit_on_sample(df.limit(0))).count() == 0
