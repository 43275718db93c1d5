"""From plain text to blocks, kinds of blocks, and a spine of headings and paragraphs with an account of every character."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

C = str | Column


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, no (from 0), line of every text that isn't null."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)).alias("no", "line"))


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, block (from 0), lines of the maximal runs of lines that aren't blank. Kept within the row: no shuffle."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\n[ \t]*\n+", "\u0001")
    parts = F.filter(F.split(clean, "\u0001", -1), lambda b: F.trim(b, F.lit(" \t\n")) != "")
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("block", "b")).select(key, "block", F.filter(F.split("b", "\n", -1), lambda x: F.trim(x) != "").alias("lines"))


#: Lines that belong to the production of a text and not to it.
JUNK = "|".join((r"^\s*</?pre\b[^>]*>\s*$", r"^\s*/\s*$", r"^\s*\[?Illustration\b", r"^\s*\[?Device\]?\s*$", r"^\s*Produced by\b", r"^\s*\[?Transcriber.?s?\s+note", r"^\s*\*\*\*\s*(?:START|END) OF TH", r"^\s*\+[-+]{5,}\+\s*$", r"^\s*\|.{0,80}\|\s*$"))
#: Blocks before the text that are dropped, and blocks that end it.
FRONT = "|".join((r"^\s*(?:A\s+)?(?:TABLE\s+OF\s+)?CONTENTS?[.:]?\s*$", r"^\s*LIST OF ILLUSTRATIONS\.?\s*$", r"^\s*BY THE SAME AUTHOR\b", r"^\s*Books by\b", r"^\s*COPYRIGHT[,.]?\s", r"^\s*_?All rights reserved_?\.?\s*$", r"^\s*Printed in\b", r"^\s*WITH FRONTISPIECE\s*$", r"^\s*_?ILLUSTRATED_?\s*$"))
BACK = "|".join((r"^\s*_?PRINTED BY(?:\b|_)", r"^\s*A LIST OF NEW BOOKS\b", r"^\s*\*\*\* END OF TH", r"^\s*ADVERTISEMENTS?\s*$", r"^\s*CORRECTIONS\s*$", r"^\s*The following pages contain advertisements"))


def junk_line(x: C) -> Column:
    return _c(x).rlike("(?i)" + JUNK)


def block_kind(xs: C) -> Column:
    """Kind of a block by its lines, the first that fits: drop, scenerule, hrule, head, verse, quote, para."""
    ls = _c(xs)
    n = F.size(ls)
    first = F.trim(F.element_at(ls, 1))
    every = lambda p: F.forall(ls, lambda x: x.rlike(p))
    unended = F.size(F.filter(ls, lambda x: ~x.rlike(r"[.!?。！？…]['\"”’」』)）]*\s*$")))
    short = F.forall(ls, lambda x: F.length(F.trim(x)) <= 64)
    capital = F.forall(ls, lambda x: ~F.trim(x).rlike("^[a-z]"))
    return (
        F.when(every("(?i)" + JUNK), "drop")
        .when(every(r"^[\s*·•.]+$"), "scenerule")
        .when(every(r"^[\s—―–_=-]{3,}$"), "hrule")
        .when((n == 1) & (first.rlike(r"(?i)^(?:chapter|book|part|act|scene|section)\s+(?:[ivxlc]+|\d+)\b") | first.rlike(r"^(?:[IVXLC]+|\d{1,3})\.(?:\s+\S.{0,60})?$") | first.rlike("^제 ?\\d+ ?[장화부]|^第[0-9一二三四五六七八九十百]+[章話回部]")), "head")
        .when((n >= 2) & short & capital & (unended >= n - 1), "verse")
        .when((n >= 2) & every(r"^(?:>|\s{4,})"), "quote")
        .otherwise("para")
    )


def profile(df: DataFrame) -> DataFrame:
    """doc_id, curly, wrapped, acts of df(doc_id, text): more curly than straight quotes, hard-wrapped, acts or scenes."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    return df.select("doc_id", (n("[“”]") > n('"')).alias("curly"), (n("\n") > 5).alias("wrapped"), (n(r"(?i)\b(?:act|scene) [ivx0-9]+") >= 2).alias("acts"))


def dropped_ledger(units: DataFrame) -> DataFrame:
    """Characters that don't count as body text, by reason."""
    reason = F.when(F.col("t").isNull() | T.blank("t"), "blank").when(~F.col("t").rlike(r"[\p{L}\p{N}]"), "rule").when(F.col("kind") == "h", "heading")
    return units.select(reason.alias("reason"), F.coalesce(F.length("t"), F.lit(0)).alias("n")).where("reason IS NOT NULL").groupBy("reason").agg(F.sum("n").alias("n"))


def front_worth_keeping(xs: C) -> Column:
    """Does a block before the text read like prose: lines that end sentences and are long on average, or a long block?"""
    ls = _c(xs)
    total = F.aggregate(F.transform(ls, F.length), F.lit(0), lambda a, n: a + n)
    ended = F.element_at(ls, -1).rlike(r"[.!?]['\"”’)]*\s*$")
    return (ended & (total / F.size(ls) >= 34)) | (total > 220)


# ---- one document as a whole: folds that need what came before

HEAD = re.compile(r"(?i)^(chapter|book|part|act|scene|section)\s+([ivxlc]+|\d+)\b\.?\s*(.*)$")
NUMBERED = re.compile(r"^(?:([IVXLC]+|\d{1,3})\.)(?:\s+(\S.{0,60}))?$")
ASIAN_HEAD = re.compile(r"^(?:제 ?\d+ ?[장화부]|第[0-9一二三四五六七八九十百]+[章話回部])")
END = re.compile(r"[.!?。！？…][”’」』)）\"']*\s*$")
LEVEL = {"book": 1, "part": 1, "act": 1, "chapter": 2, "scene": 3, "section": 3}
JUNK_RX, FRONT_RX, BACK_RX = re.compile(JUNK, re.I), re.compile(FRONT, re.I), re.compile(BACK, re.I)


def key_of(s: str) -> str:
    return re.sub("[^A-Za-z0-9]", "", s).upper() or re.sub(r"\W", "", s)


def harvest_contents(bs: list[list[str]], within: int = 80, most: int = 160) -> tuple[set[str], int, int]:
    """Keys of a table of contents, and the blocks it takes: from a heading Contents until prose or a repeated key."""
    for i, b in enumerate(bs[:within]):
        if len(b) == 1 and re.fullmatch(r"\s*(?:table of )?contents?[.:]?\s*", b[0], re.I):
            keys: list[str] = []
            j = i + 1
            while j < len(bs):
                rows = [re.sub(r"[\s.]+\d{1,4}\s*$", "", x).strip() for x in bs[j]]
                heads = len(bs[j]) == 1 and HEAD.match(rows[0]) and keys and not re.search(r"\d\s*$", bs[j][0])
                if heads and not (j + 1 < len(bs) and len(bs[j + 1]) == 1 and HEAD.match(bs[j + 1][0].strip())):
                    break
                if any(len(x) > 66 for x in rows) or any(key_of(x) in keys for x in rows) or len(keys) + len(rows) > most:
                    break
                keys += [key_of(x) for x in rows]
                j += 1
            return set(keys), i, j
    return set(), -1, -1


def bare_number(head: str) -> bool:
    m, n = HEAD.match(head), NUMBERED.match(head)
    return not m[3] if m else bool(n and not n[2])


def unwrap(ls: list[str]) -> str:
    out = ""
    for x in (x.strip() for x in ls):
        out += x if not out or out[-1] in "-—" else " " + x
    return out


def parse_document(text: str) -> list[tuple[str, int, str, int]]:
    """(kind, level, text, source characters) in order: h headings, p paragraphs, and what was dropped as drop:reason.

    The source characters of all rows, with the white space between and around blocks under drop:space, add up to the text.
    """
    t = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*", t)]
    bs = [t[a:b].split("\n") for a, b in spans]
    listed, c0, c1 = harvest_contents(bs)
    rows: list[tuple[str, int, str, int]] = []
    kept = 0
    ended = False
    last = ""
    body = False
    i = 0
    while i < len(bs):
        b, size = bs[i], spans[i][1] - spans[i][0]
        kept += size
        one = b[0].strip() if len(b) == 1 else ""
        if ended or BACK_RX.search(b[0]):
            ended = ended or i > 0.45 * len(bs)
            rows.append(("drop:back" if ended else "drop:front", 0, "", size))
        elif c0 <= i < c1:
            rows.append(("drop:contents", 0, "", size))
        elif all(JUNK_RX.search(x) for x in b):
            rows.append(("drop:junk", 0, "", size))
        elif not body and FRONT_RX.search(b[0]):
            rows.append(("drop:front", 0, "", size))
        elif not re.search(r"\w", unwrap(b)):
            rows.append(("drop:rule", 0, "", size))
        elif one and (m := HEAD.match(one)) and len(one) <= 90:
            body, last = True, key_of(one)
            rows.append(("h", LEVEL[m[1].lower()], one, size))
        elif one and (NUMBERED.match(one) or ASIAN_HEAD.match(one)):
            body, last = True, key_of(one)
            rows.append(("h", 2, one, size))
        elif one and key_of(one) in listed and not END.search(one) and key_of(one) != last:
            body, last = True, key_of(one)
            # a title below its number is one heading with it
            if rows and rows[-1][0] == "h" and bare_number(rows[-1][2]):
                k, level, head, n = rows[-1]
                rows[-1] = (k, level, f"{head} {one}", n + size)
            else:
                rows.append(("h", 2, one, size))
        elif one and key_of(one) == last and last:
            rows.append(("drop:repeat", 0, "", size))
        else:
            body = True
            verse = len(b) > 1 and all(len(x.strip()) <= 64 for x in b) and sum(not END.search(x) for x in b) >= len(b) - 1 and not any(x.strip()[:1].islower() for x in b)
            rows.append(("p", 0, "\n".join(x.strip() for x in b) if verse else unwrap(b), size))
        i += 1
    # a chapter right before another chapter is a part
    for j in range(len(rows) - 1):
        if rows[j][0] == rows[j + 1][0] == "h" and rows[j][1] == rows[j + 1][1] == 2:
            rows[j] = (rows[j][0], 1, *rows[j][2:])
    rows.append(("drop:space", 0, "", len(text) - kept))
    return rows


def parse(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, no, kind, level, t, n_source of every text that isn't null, one text a row of the input: an Arrow map, no shuffle."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            out = [(i, n, *r) for i, t in zip(b[key], b[text], strict=True) for n, r in enumerate(parse_document(t))]
            yield pd.DataFrame(out, columns=[key, "no", "kind", "level", "t", "n_source"], dtype=object)

    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, no int, kind string, level int, t string, n_source int")


def byline(bs: DataFrame, key: str, within: int = 40) -> DataFrame:
    """key, author named in a line "by ..." of the first blocks of df(key, block, lines); the first such line counts."""
    one = F.filter(F.transform("lines", lambda x: F.regexp_extract(x, r"(?i)^\s*by\s+([A-Z][\w.'’ -]{2,60})\s*$", 1)), lambda x: x != "")
    x = bs.where(F.col("block") < within).withColumn("a", F.element_at(F.concat(one, F.array(F.lit(None).cast("string"))), 1)).where("a IS NOT NULL")
    return x.groupBy(key).agg(F.min_by("a", "block").alias("author"))


def infer_levels(heads: DataFrame, key: str) -> DataFrame:
    """Adds level to df(key, seq, type): by which kinds of headings a document has. Books, parts and acts are 1; chapters are 2, or 1 where nothing stands above them;
    numerals are 2 where there are no chapters and 3 below them; named divisions go with the chapters."""
    n = lambda *ts: F.count_if(F.col("type").isin(*ts)) > 0
    kinds = heads.groupBy(F.col(key).alias("__k")).agg(n("book", "part", "act").alias("__above"), n("chapter").alias("__chapters"))
    chapter = F.when(F.col("__above"), 2).otherwise(1)
    level = F.when(F.col("type").isin("book", "part", "act"), 1).when(F.col("type").isin("chapter", "named"), chapter).when(F.col("type") == "scene", 3)
    level = level.when(F.col("__chapters"), chapter + 1).otherwise(chapter).cast("int")
    return heads.join(kinds, F.col(key).eqNullSafe(F.col("__k"))).withColumn("level", level).select(*heads.columns, "level")


def sentence_case(heads: DataFrame, texts: DataFrame, head: str, text: str, least: int = 2) -> DataFrame:
    """heads with restored: an all-capital heading in sentence case, where words that the texts write with a capital keep it.

    A word keeps its capital if the texts hold it inside sentences more often capitalised than small, at least least times; the first word has one anyway.
    Only words of the headings are counted.
    """
    words = F.expr(f"regexp_extract_all({head}, '[A-Za-z]+', 0)")
    need = heads.select(F.explode(F.transform(words, F.lower)).alias("w")).distinct()
    inner = F.regexp_extract_all(F.col(text), F.lit(r"(?<=[a-z,;] )([A-Za-z]+)"), 1)
    seen = texts.select(F.explode(inner).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    seen = seen.groupBy(F.lower("x").alias("w")).agg(F.sum(F.when(F.col("x").rlike("^[A-Z]"), F.col("n")).otherwise(0)).alias("up"), F.sum(F.when(F.col("x").rlike("^[a-z]"), F.col("n")).otherwise(0)).alias("low"))
    names = need.join(seen, "w").where((F.col("up") > F.col("low")) & (F.col("up") >= least)).select("w", F.lit(True).alias("cap"))
    x = heads.withColumn("__id", F.monotonically_increasing_id())
    parts = x.select("__id", F.posexplode(F.regexp_extract_all(F.col(head), F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), 1)).alias("i", "p")).withColumn("w", F.lower("p"))
    first = F.min(F.when(F.col("p").rlike("^[A-Za-z]"), F.col("i"))).over(Window.partitionBy("__id"))
    word = F.when(F.coalesce("cap", F.lit(False)) | (F.col("i") == first), F.initcap("w")).when(F.col("p").rlike("^[IVXLC]+$") & (F.length("p") > 1), F.col("p")).otherwise(F.col("w"))
    done = parts.join(names, "w", "left").withColumn("q", word).groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda z: z.q), "").alias("restored"))
    return x.join(done, "__id", "left").drop("__id")
