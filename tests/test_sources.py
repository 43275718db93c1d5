from __future__ import annotations

import zipfile

from quire.sources import text as X


def test_files(spark, tmp_path):
    (tmp_path / "oskin").mkdir()
    (tmp_path / "oskin" / "1906_The Gate.txt").write_bytes("﻿a\r\n\tb".encode())
    (tmp_path / "oskin" / "00_notes.txt").write_text("x")
    (tmp_path / "oskin" / "1706_Old.txt").write_text("x")
    rows = {r.path.rsplit("/", 1)[-1]: r.text for r in X.whole_texts(spark, str(tmp_path)).collect()}
    assert [v for k, v in rows.items() if "Gate" in k] == ["a\n        b"]
    assert [(r.author, r.year, r.title.replace("%20", " ")) for r in X.file_catalogue(spark, str(tmp_path)).collect()] == [("oskin", 1906, "The Gate")]


def test_jobs(spark, tmp_path):
    (tmp_path / "001.json").write_text('{"p:0": "하나", "h:a": ""}')
    (tmp_path / "002.json").write_text('{"p:1": ')
    rows = sorted((r.k or "", r.t, r.problem) for r in X.job_outputs(spark, str(tmp_path)).collect())
    assert rows == [("", None, "unreadable"), ("h:a", "", None), ("p:0", "하나", None)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("c/x.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/><item id="t" href="titlepage.xhtml"/></manifest><spine><itemref idref="t"/><itemref idref="a"/><itemref idref="b"/></spine></package>')
        for n in "ab":
            z.writestr(f"c/{n}.xhtml", f"<html><head><title>t</title></head><body><p>{n}</p></body></html>")
        z.writestr("c/titlepage.xhtml", "<p>no</p>")
    (tmp_path / "b.epub").write_bytes(b"broken")
    rows = {r.path[-6:]: (r.text, r.problem) for r in X.archives(spark, str(tmp_path)).collect()}
    assert rows == {"a.epub": ("a\n\nb", None), "b.epub": (None, "BadZipFile")}
    with zipfile.ZipFile(tmp_path / "j.zip", "w") as z:
        z.writestr("k.txt", "漢字".encode("cp932"))
    assert [r.text for r in X.archives(spark, str(tmp_path), "zip").collect()] == ["漢字"]


def test_pages(spark, tmp_path):
    (tmp_path / "p0").write_text("zero")
    X.register(spark)
    df = spark.read.format("pages").option("url", f"file://{tmp_path}/p{{page}}").option("pages", "2").option("wait", "0").load()
    assert sorted((r.page, r.text, r.problem) for r in df.collect()) == [(0, "zero", None), (1, None, "URLError")]


def test_manifest_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([('<script>var MANIFEST=[{"id":"a","y":1},{"id":"b"}];</script>',)], "html string")
    rows = X.manifest(df, "html", "struct<id:string,y:int>")
    assert [tuple(r) for r in rows.collect()] == [("a", 1), ("b", None)]
    out = str(tmp_path / "out")
    X.write_payloads(spark.createDataFrame([("w", 1), ("x", 2)], "work_id string, n int"), out)
    X.write_payloads(spark.createDataFrame([("w", 3)], "work_id string, n int"), out)
    assert sorted((r.work_id, r.n) for r in spark.read.json(out).collect()) == [("w", 3), ("x", 2)]
    for _ in range(2):
        X.append_summary(spark.createDataFrame([("a", 1)], "s string, n int"), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "tsv")).count() == 2
    X.write_edition(spark.createDataFrame([("w", 2, "p", "“b” " * 30), ("w", 1, "p", "a"), ("w", 0, "h", "One")], "work_id string, seq int, kind string, t string").coalesce(1), str(tmp_path / "ed"))
    got = "".join(r.value for r in spark.read.text(str(tmp_path / "ed" / "text"), wholetext=True).select("value").collect())
    assert got.startswith("  One\nOne\n\na\n\n  “b”") and max(map(len, got.split("\n"))) <= 72
    X.write_index(rows, str(tmp_path / "ix"), "id")
    have = spark.createDataFrame([("a", 5000), ("b", 10)], "id string, size int")
    assert [r.id for r in X.fresh(rows, have, "id").collect()] == ["b"]
