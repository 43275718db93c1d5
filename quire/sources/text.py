"""Sources and sinks of texts: whole files, catalogues of files, payloads wrapped in scripts, job outputs, archives, page readers.

Unreadable input never fails a scan: it becomes a row with a problem.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.arrow import expand_tabs, wrap
from ..functions.text import strip_tags


def whole_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path, text of every file below a folder: mark and carriage returns gone, tabs to columns of eight."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), expand_tabs("value").alias("text"))


def file_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """path, author (folder), year, title of files named year_title.txt; others and those that begin with 00_ are left out. Contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    p = r"^(1[89]\d\d|20\d\d)_(.+)$"
    f = f.withColumn("name", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))
    f = f.where(F.col("name").rlike(p) & ~F.col("name").startswith("00_"))
    return f.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("author"), F.regexp_extract("name", p, 1).cast("int").alias("year"), F.regexp_extract("name", p, 2).alias("title"))


def between_marks(text: Column | str, start: str, end: str) -> Column:
    """What stands between a line that matches start and one that matches end; the text itself where they don't occur."""
    t = F.col(text) if isinstance(text, str) else text
    p = rf"(?s)(?:{start})[^\n]*\n(.*?)(?:\n[^\n]*(?:{end})|\z)"
    return F.when(t.rlike(p), F.trim(F.regexp_extract(t, p, 1), F.lit("\n"))).otherwise(t)


def last_section(text: Column | str, head: str, until: str) -> Column:
    """From the last occurrence of head to the last of until after it (to the end if there is none); null without head."""
    t = F.col(text) if isinstance(text, str) else text
    size = F.length(t)
    at = size - F.instr(F.reverse(t), F.lit(head[::-1])) - len(head) + 2
    rest = F.substr(t, at)
    stop = F.length(rest) - F.instr(F.reverse(rest), F.lit(until[::-1])) - len(until) + 2
    cut = F.when(F.instr(rest, F.lit(until)) > 1, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest)
    return F.when(F.instr(t, F.lit(head)) > 0, cut)


def payloads(df: DataFrame, text: str, schema: str) -> DataFrame:
    """df with payload: the JSON between the first ( and the last ) of a script, null if it can't be parsed."""
    return df.withColumn("payload", F.from_json(F.regexp_extract(F.col(text), r"(?s)\((.*)\)", 1), schema))


def manifest(df: DataFrame, text: str, schema: str, name: str = "MANIFEST") -> DataFrame:
    """One row an entry of the array that a page assigns to a variable."""
    js = F.regexp_extract(F.col(text), rf"(?s)\b{name}\s*=\s*(\[.*?\])\s*;", 1)
    return df.select(F.explode(F.from_json(js, f"array<{schema}>")).alias("x")).select("x.*")


def job_outputs(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path, k, t, problem of JSON objects from key to text; a file that can't be parsed gives one row with its problem."""
    f = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    m = f.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"))
    good = m.where("m IS NOT NULL").select("path", F.explode("m").alias("k", "t"), F.lit(None).cast("string").alias("problem"))
    bad = m.where("m IS NULL").select("path", F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("t"), F.lit("unreadable").alias("problem"))
    return good.unionByName(bad)


def kv_quarantine(df: DataFrame, key: str, value: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantined): rows whose JSON fits the schema, and the raw rows of those that don't."""
    p = df.withColumn("__p", F.from_json(value, schema, {"mode": "PERMISSIVE"})).withColumn("__ok", F.col(value).isNotNull() & F.try_parse_json(value).isNotNull())
    return p.where("__ok").select(key, "__p.*"), p.where("NOT __ok").select(key, value)


def _book(data: bytes) -> str:
    """Text of an EPUB's pages in the order of its spine, without its apparatus."""
    z = zipfile.ZipFile(io.BytesIO(data))
    opf = next(n for n in z.namelist() if n.endswith(".opf"))
    root = ElementTree.fromstring(z.read(opf))
    ns = {"o": "http://www.idpf.org/2007/opf"}
    items = {i.get("id"): i.get("href") for i in root.iterfind(".//o:manifest/o:item", ns)}
    base = opf.rpartition("/")[0]
    out = []
    for ref in root.iterfind(".//o:spine/o:itemref", ns):
        href = items.get(ref.get("idref"), "")
        if not href or re.search(r"titlepage|imprint|colophon|uncopyright|toc|cover|nav", href):
            continue
        page = z.read(f"{base}/{href}" if base else href).decode("utf-8", "replace")
        page = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", "", page)
        page = re.sub(r"(?i)<br\s*/?>", "\n", page)
        page = re.sub(r"(?i)</(?:p|div|h[1-6]|li|blockquote|section)\s*>", "\n\n", page)
        out.append(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub("<[^>]+>", "", page))).strip())
    return "\n\n".join(x for x in out if x)


def _zipped_text(data: bytes) -> str:
    """The first text file of a ZIP, decoded as Japanese of code page 932."""
    z = zipfile.ZipFile(io.BytesIO(data))
    return z.read(next(n for n in z.namelist() if n.lower().endswith(".txt"))).decode("cp932", "replace")


def archives(spark: SparkSession, path: str, kind: str = "epub") -> DataFrame:
    """path, text, problem of EPUB or ZIP files below a folder; one that can't be read has a problem and no text."""
    read = {"epub": _book, "zip": _zipped_text}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b.path, b.content, strict=True):
                try:
                    rows.append((p, read(bytes(data)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "problem"], dtype=object)

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(path)
    return f.select("path", "content").mapInPandas(run, "path string, text string, problem string")


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.value = number


class PageReader(DataSourceReader):
    """Reads numbered pages; each page is a partition, tried up to three times with a growing wait."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(int(self.options.get("pages", "0")))]

    def read(self, partition: Page):
        import time
        import urllib.request

        url = self.options["url"].format(page=partition.value)
        problem = None
        for attempt in range(3):
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", "30"))) as r:  # noqa: S310
                    yield (partition.value, r.read().decode("utf-8", "replace"), None)
                    return
            except Exception as e:  # noqa: BLE001
                problem = type(e).__name__
                time.sleep(float(self.options.get("wait", "2")) * attempt)
        yield (partition.value, None, problem)


class PageSource(DataSource):
    """spark.read.format("pages") with options url (with {page}), pages, wait, timeout: page, text, problem. file: addresses work too."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, text string, problem string"

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


# ---- sinks


def write_payloads(df: DataFrame, path: str, key: str = "work_id") -> None:
    """One folder of JSON a key; a run replaces the folders of the keys it holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def write_index(df: DataFrame, path: str, *order: str) -> None:
    """A sorted table in one file, for small results such as coverage."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def append_summary(df: DataFrame, path: str) -> None:
    """Rows appended as tab-separated text."""
    df.write.mode("append").option("sep", "\t").option("header", "true").csv(path)


def fresh(found: DataFrame, have: DataFrame, key: str, least: int = 3000, size: str = "size") -> DataFrame:
    """Rows to be taken in: those whose key isn't there yet with at least least bytes."""
    return found.join(have.where(F.col(size) > least).select(key), key, "left_anti")


def write_edition(df: DataFrame, path: str, width: int = 72) -> None:
    """Plain text editions of df(work_id, seq, kind, t): a folder of text a work, with a table of contents of its headings and the units in order, wrapped at
    width columns, quotations that open a paragraph indented. Lines are sorted by place in ranges, so that no work is one row or one task; the table of lines is kept beside the text.

    Null texts are left out; blank ones give an empty line.
    """
    u = df.where("t IS NOT NULL").select("work_id", "seq", F.coalesce(F.col("kind") == "h", F.lit(False)).alias("head"), "t")
    plain = strip_tags("t")
    contents = u.where("head").select("work_id", F.lit(0).alias("no"), F.lit("contents").alias("part"), "seq", F.concat(F.lit("  "), plain).alias("line"), F.length("t").alias("n_source"))
    indent = F.when(F.col("t").rlike("^\\s*[“‘「『]"), "  ").otherwise("")
    body = u.select("work_id", F.lit(1).alias("no"), F.lit("text").alias("part"), "seq", F.concat(wrap(plain, width, indent), F.lit("\n")).alias("line"), F.length("t").alias("n_source"))
    lines = contents.unionByName(body).repartitionByRange("work_id", "no", "seq").sortWithinPartitions("work_id", "no", "seq")
    lines.write.mode("overwrite").parquet(f"{path}/lines")
    back = df.sparkSession.read.parquet(f"{path}/lines").repartitionByRange("work_id", "no", "seq").sortWithinPartitions("work_id", "no", "seq")
    back.select("work_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("work_id").text(f"{path}/text")


def export_backup(progress: DataFrame, marks: DataFrame) -> DataFrame:
    """One JSON row a reader with all states and marks."""
    p = progress.groupBy("reader_id").agg(F.collect_list(F.struct(*[c for c in progress.columns if c != "reader_id"])).alias("progress"))
    m = marks.groupBy("reader_id").agg(F.collect_list(F.struct(*[c for c in marks.columns if c != "reader_id"])).alias("marks"))
    return p.join(m, "reader_id", "full").select("reader_id", F.to_json(F.struct("progress", "marks")).alias("backup"))
