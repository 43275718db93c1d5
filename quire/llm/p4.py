"""Problem 4: texts over a limit cut into overlapping pieces at natural boundaries.

One regular expression with bounded quantifiers consumes the text: its alternatives, from the
strongest boundary to the weakest, each take as much as fits between a least fill and the limit
(paragraph break, line break, sentence end, clause mark, white space, any character). The lengths of
its matches give the offsets, and each piece after the first looks back by up to the overlap, to the
first boundary in that stretch. Everything is built-in SQL on arrays; no Python touches the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, texts

LIMIT, OVERLAP, SLACK = 1200, 100, 30


def cutting_pattern(size: int) -> str:
    """Consumes at most size characters, at the strongest boundary in the upper two thirds, else where it must."""
    low, half = max(1, size // 3), max(1, size * 2 // 3)
    ends = r"[.!?…。！？]+[”’」』)）\"'»]*"
    return "(?s)(?:" + "|".join(
        (
            rf".{{0,{size}}}\z",
            rf".{{{half},{size - 2}}}\n[ \t　]*\n",
            rf".{{{low},{size - 8}}}(?:{ends}[\s　]+|[。！？][”’」』)）]*(?![”’」』)）]))",
            rf".{{{low},{size - 1}}}\n",
            rf".{{{half},{size - 2}}}[,;:、，；：—](?:[\s　]|(?<=[、，；：—]))",
            rf".{{{low},{size - 1}}}[\s　]",
            rf".{{1,{size}}}",
        )
    ) + ")"


def pieces(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> DataFrame:
    """src_table, row_id, piece_no, start_pos, end_pos, piece of the rows of df(src_table, row_id, text) longer than limit.

    Pieces have at most limit characters; each after the first starts overlap characters before the end of
    the piece before it, or up to slack fewer, at the first white space or sentence mark there. Their parts
    after the overlap, put together, are the text. Null texts and texts within the limit give no row.
    """
    size = limit - overlap
    if not (0 <= slack <= overlap and 3 * overlap <= size):
        raise ValueError("0 <= slack <= overlap and 3 * overlap <= limit - overlap")
    long = df.select("src_table", "row_id", "text").where(F.length("text") > limit)
    cuts = long.select("src_table", "row_id", F.expr(f"filter(regexp_extract_all(text, {_quoted(cutting_pattern(size))}, 0), p -> p != '')").alias("parts"))
    ends = F.expr("aggregate(parts, array(0), (a, p) -> a || array(element_at(a, -1) + length(p)))")
    rows = cuts.withColumn("e", ends).select(
        "src_table",
        "row_id",
        F.explode(
            F.expr(
                "transform(sequence(1, size(parts)), i -> struct(i - 1 AS piece_no, e[i - 1] AS cut, e[i] AS end_pos,"
                f" parts[i - 1] AS part, if(i > 1, right(parts[i - 2], {overlap}), '') AS back))"
            )
        ).alias("c"),
    ).select("src_table", "row_id", "c.*")
    # how far into the stretch that is repeated its first boundary lies; where there is none near, all of it is repeated
    skip = F.expr(f"length(regexp_extract(back, '(?s)^.{{0,{max(slack - 1, 0)}}}?[\\\\s。！？、]', 0))")
    rows = rows.withColumn("skip", skip)
    rows = rows.withColumn("lead", F.expr("substring(back, skip + 1, length(back))"))
    return rows.select(
        "src_table",
        "row_id",
        "piece_no",
        (F.col("cut") - F.length("lead")).cast("int").alias("start_pos"),
        F.col("end_pos").cast("int").alias("end_pos"),
        F.concat("lead", "part").alias("piece"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spread(texts(spark, sf_dir, "documents", "translations")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the splitter cuts: each has exactly one second piece."""
    return p4_pieces(spark, sf_dir).where("piece_no = 1").select("src_table", "row_id")
