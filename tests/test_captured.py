"""The data source of captured pages: rows, fields, pushed filters, streams and unknown names."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lotwise.sources import captured as C
from lotwise.sources.pages import read_pages


def island(total, n):
    data = {"listingsData": [{}] * n, "paginationData": {"totalPages": total}}
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"pageData": {"data": data}}}})}</script>'


@pytest.fixture
def folder(tmp_path):
    for k in range(12):
        d = tmp_path / f"site{k % 3}" / "sub"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{k}.html").write_text("x" * k + island(f"{k},000", k % 4) + "é\n")
    (tmp_path / "site1" / "_SUCCESS").write_text("")
    (tmp_path / "loose.html").write_text("<html></html>")
    return tmp_path


def test_the_rows_of_read_pages(spark, folder):
    got = {(r.site_dir, r.name): r for r in C.captured(spark, str(folder), partition_bytes="300").collect()}
    want = {}
    for d in (*(folder / f"site{k}" / "sub" for k in range(3)), folder):
        want |= {"/".join(r.path.rsplit("/", 3)[1:]) if d != folder else r.path.rsplit("/", 1)[1]: r.html for r in read_pages(spark, str(d)).collect()}
    assert {"/".join(filter(None, k)): r.html for k, r in got.items()} == want and len(got) == 13
    assert (got["site1", "sub/7.html"].total, got["site1", "sub/7.html"].listings) == (7000, 3) and got["", "loose.html"].total == 0
    assert got["site2", "sub/11.html"].bytes == len(got["site2", "sub/11.html"].html.encode())


def test_files_are_dealt_over_tasks(spark, folder):
    assert C.captured(spark, str(folder), partition_bytes="1").rdd.getNumPartitions() == 13
    assert C.captured(spark, str(folder)).rdd.getNumPartitions() == 1


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_choose_files_and_others_are_left_to_spark(spark, folder):
    pages = C.captured(spark, str(folder))
    some = pages.filter((F.col("site_dir") == "site2") & F.col("name").startswith("sub/1") & (F.col("bytes") > 10) & (F.col("total") > 1))
    assert [r.name for r in some.collect()] == ["sub/11.html"]
    text = plan(some)
    pushed, left = text.split("PushedFilters: [")[1].split("]")[0], text.split("Condition :")[1].split("\n")[0]
    assert "EqualTo(site_dir,site2)" in pushed and "StringStartsWith(name,sub/1)" in pushed and "GreaterThan(bytes,10)" in pushed and "total" not in pushed
    assert "total" in left and "bytes" not in left and "site_dir" not in left
    for k in range(12):  # a file that is left out isn't even opened
        if k % 3 != 2:
            (folder / f"site{k % 3}" / "sub" / f"{k}.html").chmod(0)
    assert pages.filter(F.col("site_dir").isin("site2", "none")).count() == 4 and pages.filter("site_dir = 'none'").count() == 0


def test_fields_without_text_read_no_page(spark, folder, monkeypatch):
    pages = C.captured(spark, str(folder), fields="name,bytes")
    assert pages.columns == ["name", "bytes"] and pages.count() == 13
    reads = C._Pages({"path": str(folder)}, ["name", "bytes"])
    monkeypatch.setattr(C._Pages, "filesystem", lambda self: (None, ""))  # nothing can be opened
    assert list(reads.rows(C.Files((("s", "n", 3, "/nowhere"),)))) == [("n", 3)]


@pytest.mark.parametrize("options, why", [({"site": "other"}, "unknown site"), ({"fields": "name,colour"}, "unknown field")])
def test_unknown_names_fail_in_spark(spark, folder, options, why):
    with pytest.raises(Exception, match=why):
        C.captured(spark, str(folder), **options).collect()
    with pytest.raises(Exception, match="DATA_SOURCE_NOT_FOUND|Failed to find"):
        spark.read.format("captured_pagez").load(str(folder)).collect()


def test_a_stream_reads_each_file_once(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")

    def run():
        pages = C.captured(spark, str(folder), streaming=True, fields="site_dir,name,total", settle="0")
        q = pages.writeStream.format("parquet").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start(f"{out}/rows")
        q.awaitTermination()
        return sorted((r.name, r.total) for r in spark.read.parquet(f"{out}/rows").collect())

    first = run()
    assert len(first) == 13 and ("sub/7.html", 7000) in first
    assert run() == first
    time.sleep(0.05)
    (folder / "site0" / "late.html").write_text(island("9", 1))
    assert run() == sorted([*first, ("late.html", 9)])
