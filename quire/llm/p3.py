"""Problem 3: defective responses. Units are the prompts, delivered translations the responses."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, spread, table
from .langs import TAG, korean_share, language, mostly_korean, refuses
from .p5 import CUT_OVER, fit_on_sample, values
from .sentences import ANY, plain, segment
from .truncation import score

SPACES = re.compile(r"\s+")
QUOTE = str.maketrans("“”„‘’‚«»「」『』…—―–", "\"\"\"'''\"\"\"\"''.---")
#: A response is a copy if, compressed with the prompt as dictionary, it takes at most this share of its bytes, besides a frame.
COPY_SHARE, FRAME = 0.22, 14


def level(text: str) -> str:
    """Text without tags, case, kinds of quotation marks and spaces, as trifling changes leave it."""
    return SPACES.sub(" ", TAG.sub("", plain(text)[0]).translate(QUOTE).casefold()).strip()


def copied(prompt: str, response: str) -> bool:
    """Is the response the prompt, give or take trifles? Judged by its size when compressed with the prompt as a zstandard dictionary.

    An exact check follows: of a short response, in which a frame hides what is new, the one must hold the other; a longer one must give back at least half of the prompt, or 60 bytes.
    """
    a, b = level(prompt), level(response)
    if not a or not b:
        return False
    x, y = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False)
    if len(c.compress(y)) > FRAME + COPY_SHARE * len(y):
        return False
    if len(a) < 24:
        return a in b and len(b) - len(a) <= 12 or b in a and len(a) - len(b) <= 4
    return 2 * len(y) >= len(x) or len(y) > 60


def defect(unit: str | None, text: str | None, lang: str | None, cut: Callable[[str], bool]) -> str | None:
    """empty, refusal, copy, other_language, truncated or None for one pair; a unit without letters has no defect.

    A response most of whose letters are Hangul is neither a copy nor in another language: the units are English or Japanese, and one in Korean that is kept as it is is no case.
    """
    if not unit or not ANY.search(TAG.sub("", unit)):
        return None
    if not text or not ANY.search(TAG.sub("", text)):
        return "empty"
    if refuses(text) and not copied(unit, text):
        return "refusal"
    share = 1.0 if mostly_korean(text) else korean_share(text)
    if share < 0.6:
        own = language(unit)
        foreign = own not in ("en", "ja", "") or (own == "" and lang not in ("en", "ja", None))
        if copied(unit, text):
            return None if foreign else "copy"
        if share < 0.3:
            u = level(unit)
            left = [text[s:e] for s, e in segment(text) if level(text[s:e]) not in u]
            if left and korean_share(" ".join(left)) < 0.3:
                return "other_language"
    return "truncated" if cut(text) else None


def pairs(spark: SparkSession, sf_dir: str, share: float = 1.0) -> DataFrame:
    """tr_id, unit, text, lang, heading of every translations row whose (work_id, k) is in units.

    One shuffled join; adaptive execution splits a key that holds very many rows. Rows with a null work or key match no unit.
    With a share below 1, that share of the keys by their hash, taken before anything is shuffled.
    """
    u = table(spark, sf_dir, "units").select("work_id", "k", F.col("t").alias("unit"), "lang").where("work_id IS NOT NULL AND k IS NOT NULL")
    t = table(spark, sf_dir, "translations").select("tr_id", "work_id", "k", F.col("t").alias("text")).where("work_id IS NOT NULL AND k IS NOT NULL")
    if share < 1:
        few = F.pmod(F.xxhash64("work_id", "k"), F.lit(1 << 24)) < int(share * (1 << 24)) + 1
        u, t = u.where(few), t.where(few)
    return t.join(u, ["work_id", "k"]).select("tr_id", "unit", "text", "lang", F.col("k").startswith("h:").alias("heading"))


def defects(rows: DataFrame, weights) -> DataFrame:
    """tr_id, defect of the defective rows of df(tr_id, unit, text, lang, heading)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        w = shared.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, out = [], []
            for i, u, t, g, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                d = defect(u, t, g, lambda x, h=h: score(w, x, h) > CUT_OVER)
                if d:
                    ids.append(i)
                    out.append(d)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["tr_id", "defect"])

        return run

    return map_rows(rows.select("tr_id", "unit", "text", "lang", "heading"), make, "tr_id bigint, defect string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(pairs(spark, sf_dir), fit_on_sample(values(spark, sf_dir)))
