from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from quire.functions import quotes as G
from quire.operators import catalog as K
from quire.operators import dialogue as D
from quire.operators import overlay as O
from quire.operators import quality as Q
from quire.operators import ranges as R
from quire.operators import reading as S
from quire.operators import sets as U
from quire.operators import structure as B
from quire.operators import versions as V
from quire.operators import windows as W
from quire.streaming import reading as stream

UNITS = "work_id string, seq int, kind string, k string, t string, lang string, ref string"


def units(spark, *rows):
    return spark.createDataFrame([("w", i, k, f"{k}:{i}", t, "en", str(i)) for i, (k, t) in enumerate(rows)], UNITS)


def test_facets(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), (None, ["z"]), ("b", None)], "f string, s array<string>")
    assert K.facet_filter(df, {"f": [], "s": []}).count() == 3
    assert [r.f for r in K.facet_filter(df, {"f": ["a", "b"], "s": ["y"]}).collect()] == ["a"]


def test_states(spark):
    df = spark.createDataFrame([(0.001, True, 0), (0.5, False, 2), (None, None, None)], "f double, d boolean, m int")
    assert [r[0] for r in df.select(K.reading_states("f", "d", "m")).collect()] == [["unread", "done"], ["reading", "marked"], ["unread"]]


def test_as_of(spark):
    left = spark.createDataFrame([("w", 0), ("w", 5), ("w", 9), ("x", 3), (None, 1)], "work_id string, p int")
    right = spark.createDataFrame([("w", 1, "a"), ("w", 5, "b"), ("w", None, "n")], "work_id string, s int, v string")
    got = {(r.work_id, r.p): r.hit for r in R.as_of(left, right, ["work_id"], "p", "s", "v", "hit").collect()}
    assert got == {("w", 0): None, ("w", 5): "b", ("w", 9): "b", ("x", 3): None, (None, 1): None}


def test_locate_border_belongs_to_the_earlier_unit(spark):
    u = spark.createDataFrame([("w", 0, 10), ("w", 1, 10), ("w", 2, 20)], "work_id string, seq int, n int")
    p = spark.createDataFrame([("w", f) for f in (0.0, 0.25, 0.26, 0.5, 0.51, 1.0, 2.0)], "work_id string, frac double")
    got = {r.frac: r["__at"] for r in R.locate(p, u, "work_id", "seq", "n", "frac").collect()}
    assert got == {0.0: 0, 0.25: 0, 0.26: 1, 0.5: 1, 0.51: 2, 1.0: 2, 2.0: 2}


def test_chunks_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [("h" if rng.random() < 0.1 else "p", "x" * rng.randint(0, 900)) for _ in range(120)]
    df = units(spark, *rows)
    want, n, c = {}, 0, 1
    for i, (k, t) in enumerate(rows):
        if k == "h" and n > 2000 * 0.45:
            c, n = c + 1, 0
        want[i] = c
        n += len(t)
        if n >= 2000:
            c, n = c + 1, 0
    for parts in (1, 8):
        assert {r.seq: r.chunk for r in O.chunks(df.repartition(parts), 2000).collect()} == want
        assert {r.seq: r.chunk for r in O.chunks(df.repartition(parts), 2000, block=7).collect()} == want


def test_carry_over(spark):
    old = units(spark, ("h", "One"), ("p", "alpha"), ("p", "beta"), ("p", "gamma"))
    new = spark.createDataFrame([("w", 0, "p", "a", "One!", "en", ""), ("w", 1, "p", "b", "ALPHA", "en", ""), ("w", 2, "p", "c", "new", "en", ""), ("w", 3, "p", "d", "gamma.", "en", "")], UNITS)
    kept = spark.createDataFrame([("w", "h:0", "일"), ("w", "p:1", "가"), ("w", "p:2", "나"), ("w", "p:3", "다")], "work_id string, k string, t string")
    got = {r.k: r.t for r in O.carry_over(old, new, kept).collect()}
    assert got == {"a": "일", "b": "가", "c": "나", "d": "다"}


def test_depth_is_clamped(spark):
    rng = random.Random(5)
    steps = [rng.choice([-1, -1, 0, 1]) for _ in range(200)]
    df = spark.createDataFrame([("w", i, s) for i, s in enumerate(steps)], "work_id string, seq int, step int")
    want, d = [], 0
    for s in steps:
        d = max(0, d + s)
        want.append(d)
    assert [r.depth for r in W.depth(df, "work_id", "seq", F.col("step")).orderBy("seq").collect()] == want


def test_overlapping_matches_all_pairs(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), s := rng.randint(0, 400), s + rng.randint(0, 150)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g string, s int, e int")
    want = {}
    for a in rows:
        n = sum(a[0] != b[0] and a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3] for b in rows)
        if n:
            want[a[0]] = n
    assert {r.id: r.n for r in U.overlapping(df, ["g"], "id").collect()} == want


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,)], "xs array<string>")
    assert [r[0] for r in df.select(U.to_front(F.lit("b"), F.col("xs"))).collect()] == [["b", "a"], ["b"]]
    assert df.select(U.toggled(F.col("xs"), F.lit("a"))).first()[0] == ["b"]
    assert W.batches(12) == [(1, 5), (6, 12)] and W.batches(8) == [(1, 5), (6, 8)] and W.batches(2) == [(1, 2)]


def test_parser_accounts_for_every_character():
    text = "CONTENTS\n\nThe Door 5\nThe Wall 9\n\n\nCHAPTER I\n\nThe Door\n\nHe came\nhome late.\n\n* * *\n\nCHAPTER II. The Wall\n\nIt was dark.\n\nPrinted by Nobody\n\nads"
    rows = B.parse_document(text)
    assert sum(r[3] for r in rows) == len(text)
    assert [(r[0], r[2]) for r in rows if r[0] in "hp"] == [("h", "CHAPTER I The Door"), ("p", "He came home late."), ("h", "CHAPTER II. The Wall"), ("p", "It was dark.")]
    crlf = B.parse_document("﻿" + text.replace("\n", "\r\n"))
    assert [r[:3] for r in crlf] == [r[:3] for r in rows]
    assert B.parse_document("") == [("drop:space", 0, "", 0)]


def test_block_kinds(spark):
    df = spark.createDataFrame([(1, "* * *\n\nChapter II\n\nA line\nAnother line\n\nSome prose that ends. And goes\non here.\n\n―――"), (2, None), (3, "")], "doc_id int, text string")
    rows = B.blocks(df, "doc_id", "text").select("block", B.block_kind("lines").alias("k")).orderBy("block").collect()
    assert [r.k for r in rows] == ["scenerule", "head", "verse", "para", "hrule"]


def test_cast_and_script(spark):
    cast = spark.createDataFrame(
        [("w", "n", "narrator", "m", "old", ("N",), ("F1", {"F2": 0.4}, 1.0)), ("w", "a", "lead", "m", "old", ("A",), ("F1", {"F2": 0.4}, 1.0)), ("w", "b", "support", "x", "old", ("",), ("F9", None, 2.0))],
        "work string, id string, role string, gender string, age string, names struct<ko:string>, voice struct<base:string, mix:map<string,double>, speed:double>",
    )
    got = {r.id: r.problems for r in Q.member_problems(cast, ["F1", "F2"], ["old"], ["m", "f"]).collect()}
    assert got == {"a": [], "n": ["shared_voice"], "b": ["bad_gender", "no_name", "bad_base", "bad_speed"]}
    script = spark.createDataFrame(
        [("w", 1, 2, [("a", "shout", None), (None, None, "x" * 41)], "dark", "n"), ("w", 2, 1, [("z", "sing", None)], "odd", "q"), ("w", 3, 1, None, None, None)],
        "work string, p int, n_quotes int, q array<struct<who:string, how:string, n:string>>, mood string, nar string",
    )
    got = {r.p: r.problems for r in Q.script_problems(script, cast, ["shout"], ["dark"]).collect()}
    assert got == {1: ["long_note"], 2: ["unknown_who", "bad_how", "bad_mood", "unknown_nar"], 3: ["bad_length"]}
    counted = spark.createDataFrame([("w", 1, 3), ("w", 2, 1)], "work string, p int, n_quotes int")
    kept = {r.p: r.q is None for r in Q.without_drifted(script.where("p < 3"), counted).collect()}
    assert kept == {1: True, 2: False}


def test_speakers(spark):
    df = spark.createDataFrame([([("a", "x"), ("b", None)], 2), ([("a", "x"), ("a", "x")], 3), ([("a", "x"), ("b", "y")], 3), ([], 1)], "q array<struct<who:string, how:string>>, n int")
    got = [[tuple(e) for e in r[0]] for r in df.select(D.align_speakers(F.col("q"), F.col("n"))).collect()]
    assert got == [[("a", "x"), ("b", None)], [("a", "x")] * 3, [(None, None)] * 3, [(None, None)]]


def test_quotations_carry_within_a_chapter(spark):
    df = units(spark, ("h", "I"), ("p", "“one"), ("p", "“two” x"), ("p", "“three"), ("h", "II"), ("p", "four” “five”"))
    got = [(r.seq, r.s, r.e, r.continued) for r in D.quotations(df, "t").orderBy("seq", "s").collect()]
    assert got == [(1, 0, 4, False), (2, 0, 5, True), (3, 0, 6, False), (5, 6, 12, False)]


def test_smoothed(spark):
    df = spark.createDataFrame([([400.0] * 6,), ([],)], "xs array<double>")
    v = 200.0
    for i in range(6):
        v = float(int(v + (400 - v) * (0.35 if i < 5 else 0.15) + 0.5))
    assert [r[0] for r in df.select(S.smoothed(F.col("xs"))).collect()] == [int(v), 200]


def test_empty_tables(spark):
    e = spark.createDataFrame([], UNITS)
    t = spark.createDataFrame([], "tr_id bigint, work_id string, k string, t string, rev int, made_at timestamp")
    assert O.coverage(e, t).count() == O.compose(e, t).count() == O.reconcile(e, t).count() == O.chunks(e).count() == 0
    assert D.quotations(e, "t").count() == W.islands(e, "work_id", "seq", F.lit(False)).count() == 0


class Kept:
    """State as the engine keeps it between calls."""

    def __init__(self):
        self.value, self.hasTimedOut = None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, v):
        self.value = v


def test_speed_state_spans_batches():
    s = Kept()
    feed = [pd.DataFrame({"at_ms": [0, 100_000], "chars": [0, 500]}), pd.DataFrame({"at_ms": [300_000], "chars": [5500]})]
    out = [next(stream.speed_state((1,), iter([b]), s)) for b in feed]
    assert list(out[0].wpm) == [200] and list(out[1].wpm) == [200] and list(out[1].samples) == [1]
    list(stream.speed_state((1,), iter([pd.DataFrame({"at_ms": [600_000], "chars": [13750]})]), s))
    assert s.value[2] == 235.0


def test_undo_state():
    s = Kept()
    b = pd.DataFrame({"at_ms": [0, 1000, 2000, 3000, 4000], "p": [1, 2, None, None, None]})
    out = next(stream.undo_state((1,), iter([b]), s))
    assert [None if pd.isna(x) else int(x) for x in out.p] == [2, 1, None]


def test_adapt():
    assert stream.adapt([1.0] * 3, 1, 8)[0] == "wait"
    assert stream.adapt([0.8] * 4, 1, 8) == ("worker", 2, 8)
    assert stream.adapt([4.0] * 4, 4, 8) == ("down", 4, 7)
    assert stream.adapt([0.2] * 4, 1, 6) == ("up", 1, 7)


def test_sentence_case(spark):
    heads = spark.createDataFrame([(1, "THE ROAD TO LONDON, II"), (2, ""), (3, None)], "id int, head string")
    texts = spark.createDataFrame([("He saw London by day. The road to London was long, said the man.",), ("We left London, the road.",)], "t string")
    got = {r.id: r.restored for r in B.sentence_case(heads, texts, "head", "t").collect()}
    assert got == {1: "The road to London, II", 2: None, 3: None}


def test_levels_and_bylines(spark):
    h = spark.createDataFrame([("a", 0, "book"), ("a", 1, "chapter"), ("a", 2, "numeric"), ("b", 0, "chapter"), ("b", 1, "numeric"), ("c", 0, "numeric"), ("c", 1, None)], "d string, seq int, type string")
    got = {(r.d, r.seq): r.level for r in B.infer_levels(h, "d").collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 2): 3, ("b", 0): 1, ("b", 1): 2, ("c", 0): 1, ("c", 1): 1}
    df = spark.createDataFrame([(1, "Title\n\nBy A. Wren\n\nby B. Oskin"), (2, "no")], "doc_id int, text string")
    assert [tuple(r) for r in B.byline(B.blocks(df, "doc_id", "text"), "doc_id").collect()] == [(1, "A. Wren")]


def test_quote_state_spans_batches():
    s = Kept()
    feed = [[(0, "p", "“one")], [(1, "p", "“two” x"), (2, "p", "“three")], [(3, "h", "II"), (4, "p", "four” “five”")]]
    got = []
    for rows in feed:
        got += next(stream.quote_state(("w",), iter([pd.DataFrame(rows, columns=["seq", "kind", "t"])]), s)).values.tolist()
    assert got == [["w", 0, 0, 4, False], ["w", 1, 0, 5, True], ["w", 2, 0, 6, False], ["w", 4, 6, 12, False]]


def test_merge_states(spark):
    rows = lambda *xs: spark.createDataFrame(list(xs), "reader_id int, work_id string, max_frac double")
    got = {r.work_id: (r.max_frac, r.origin) for r in O.merge_states(rows((1, "a", 0.5), (1, "b", 0.5), (1, "c", None)), rows((1, "a", 0.5), (1, "b", 0.6), (1, "d", 0.1))).collect()}
    assert got == {"a": (0.5, "current"), "b": (0.6, "imported"), "c": (None, "current"), "d": (0.1, "imported")}


def test_streams_run(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, 0), (1, 300_000, 5500), (2, 0, 0)], "reader_id bigint, at_ms bigint, chars bigint").write.parquet(src)
    out = stream.run_to_table(stream.speeds(spark.readStream.schema("reader_id bigint, at_ms bigint, chars bigint").parquet(src)), ["reader_id"])
    assert {r.reader_id: (r.wpm, r.samples) for r in out.collect()} == {1: (200, 1), 2: (200, 0)}
    spark.createDataFrame([("w", 0, "p", "“a"), ("w", 1, "p", "“b”")], "work_id string, seq int, kind string, t string").write.parquet(src + "q")
    q = stream.quotations(spark.readStream.schema("work_id string, seq int, kind string, t string").parquet(src + "q"))
    out = q.writeStream.outputMode("append").format("memory").queryName("quotes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted((r.seq, r.s, r.e, r.continued) for r in spark.table("quotes").collect()) == [(0, 0, 2, False), (1, 0, 3, True)]


def test_running_in_blocks_matches_a_plain_loop(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.choice([None, -2, -1, 0, 1, 2])) for k in ("a", "b", None) for i in range(23)]
    df = spark.createDataFrame(rows, "k string, seq int, v int")
    plain = {"sum": lambda xs: sum(xs), "max": lambda xs: max(xs, default=None), "min": lambda xs: min(xs, default=None), "last": lambda xs: xs[-1] if xs else None}
    for how, f in plain.items():
        for before in (False, True):
            for backward in (False, True):
                got = {(r.k, r.seq): r.x for r in W.running(df, "k", "seq", "x", F.col("v"), how, before, backward, block=4).collect()}
                for k in ("a", "b", None):
                    mine = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if backward else r[1])
                    for n, r in enumerate(mine):
                        xs = [x[2] for x in mine[: n + (not before)] if x[2] is not None]
                        want = f(xs)
                        assert got[k, r[1]] == want or (how == "sum" and not xs and got[k, r[1]] in (0, None)), (how, before, backward, k, r)


def test_blocks_leave_results_alike(spark):
    rows = [("p", "x" * (i % 5)) if i % 6 else ("h", "h") for i in range(40)]
    df = units(spark, *rows)
    flag = F.length("t") < 3

    def every():
        out = [W.islands(df, "work_id", "seq", F.col("t") == ""), W.long_runs(df, "work_id", "seq", flag), W.merged_pairs(df, "work_id", "seq", flag, flag), W.without_repeats(df, "work_id", "seq", "kind"), W.sections(df, "work_id", "seq", F.col("kind") == "h"), W.renumber(df, "work_id", "seq"), W.beside(df, "work_id", "seq", "t", "n", after=True)]
        return [sorted(map(tuple, x.collect()), key=repr) for x in out]

    whole = every()
    was, W.BLOCK = W.BLOCK, 7
    try:
        assert every() == whole
    finally:
        W.BLOCK = was


def test_quotations_of_one_long_work_match_a_plain_walk(spark, monkeypatch):
    """The carry is the row before's, in blocks; a heading ends it. Rows come in any order and stand in many blocks."""
    monkeypatch.setattr(W, "BLOCK", 5)
    rng = random.Random(8)
    parts = ["“a", "b”", "c", "“d” e", "“f “g", " “h”"]
    rows = [("h" if rng.random() < 0.1 else "p", " ".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))) for _ in range(60)]
    want, carry = [], None
    for i, (kind, t) in enumerate(rows):
        want += [("w", i, *x) for x in G.quotations(t, "“", None if kind == "h" else carry)]
        carry = G.left_open(t, "“")
    got = D.quotations(units(spark, *rows).repartition(3), "t")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and any(x[4] for x in want)
    src = units(spark, *rows).select("work_id", "seq", "kind", "t")
    assert src.count() == 60


def test_versions_keep_unmoved_units_and_pair_the_rest(spark):
    old = [(i, f) for i, f in enumerate(["a", "b", "x", "x", "c", "d", "e", "f", "g"])]
    new = [(i, f) for i, f in enumerate(["a", "new", "x", "x", "e", "f", "c", "d", "y", "g"])]
    side = lambda rows: spark.createDataFrame([("w", i, f) for i, f in rows], "work_id string, at int, form string")
    got = {(r.i, r.j) for r in V.paired(side(old), side(new)).collect()}
    assert {(0, 0), (2, 2), (3, 3), (8, 9)} <= got  # anchors and repeated forms in order
    assert (1, 1) in got  # a stretch of equal length that was replaced
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert V.paired(side(old), side([]).where("false")).count() == 0


def test_heaviest_chain_against_all_subsets():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randint(0, 8)
        b, w = rng.sample(range(20), n), [rng.randint(1, 5) for _ in range(n)]
        best = max((sum(w[i] for i in c) for m in range(1 << n) for c in [[i for i in range(n) if m >> i & 1]] if all(b[x] < b[y] for x, y in zip(c, c[1:], strict=False))), default=0)
        chain = V.heaviest_chain(list(range(n)), b, w)
        assert sum(w[i] for i in chain) == best and all(b[x] < b[y] for x, y in zip(chain, chain[1:], strict=False))


def test_rolling_median_in_blocks(spark):
    rng = random.Random(2)
    xs = [rng.randint(0, 50) for _ in range(40)]
    df = spark.createDataFrame([("u", i, x) for i, x in enumerate(xs)], "k string, o int, v int")
    got = {r.o: r.m for r in W.rolling_upper_median(df, "k", "o", "v", name="m", block=9).collect()}
    assert got == {i: (sorted(xs[max(0, i - 5) : i + 1])[len(xs[max(0, i - 5) : i + 1]) // 2] if i >= 3 else None) for i in range(40)}


def test_speeds_over_segments(spark):
    rng = random.Random(1)
    at, chars, rows = 0, 0, []
    for _ in range(60):
        at, chars = at + rng.randint(20_000, 200_000), chars + rng.randint(-100, 900)
        rows.append((7, "w", at, chars))
    want, start = [], rows[0]
    for r in rows[1:]:
        if r[2] - start[2] >= 300_000:
            wpm = (r[3] - start[3]) / 5.5 / ((r[2] - start[2]) / 60000)
            if r[3] > start[3] and 60 < wpm < 450:
                want.append((r[2], round(wpm, 6)))
            start = r
    got = S.speeds(spark.createDataFrame(rows, "reader_id int, work_id string, updated bigint, chars bigint"))
    assert sorted((r.updated, round(r.wpm, 6)) for r in got.collect()) == want and want


def test_payload_problems_come_in_order(spark):
    good = 'receive({"id":"a","chapters":[{"firstP":0}],"html":"' + "<p data-p=\\\"0\\\">" + "x" * 450 + '</p>"});'
    df = spark.createDataFrame([("a", good), ("b", None), ("c", good), ("d", "take(")], "id string, js string")
    got = {r.id: r.problems for r in Q.payload_problems(df).collect()}
    assert got["b"] == ["missing"] and "other_id" in got["c"] and "bad_wrapper" in got["d"] and "repeated_id" in got["a"]
