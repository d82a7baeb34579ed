"""Rows that are small beside the work on them are dealt over all cores, and work on them is done once."""

from lotwise.plans import page_queries, run_queries
from lotwise.sources import pages as P
from lotwise.sources.captured import captured, keep_pages


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_project_pages_are_dealt_and_their_tables_read_once(spark, data):
    got = page_queries.project_pages(spark, data)
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert optimized(P.projects(got)).count("regexp_replace") <= 4
    assert P.projects(got).count() == spark.read.parquet(f"{data}/part.parquet").count()


def test_requests_are_dealt(spark, data):
    assert "RepartitionByExpression [c_custkey" in optimized(run_queries.request_rejects(spark, data))


def test_kept_pages_are_a_file_each_without_a_folder_each(spark, tmp_path):
    rows = [("a", "1.html", "<p>x</p>"), ("a", "2.html", ""), ("b", "1.html", None), ("b", "2.html", "é\n")]
    pages = spark.createDataFrame(rows, "site_dir string, name string, html string")
    for _ in range(2):  # again over what is there
        keep_pages(pages, str(tmp_path / "pages"))
    assert sorted(str(p.relative_to(tmp_path / "pages")) for p in (tmp_path / "pages").rglob("*")) == ["a", "a/1.html", "a/2.html", "b", "b/1.html", "b/2.html"]
    got = captured(spark, str(tmp_path / "pages"), fields="site_dir,name,bytes,html").collect()
    assert sorted(map(tuple, got)) == [(s, n, len(((h or "") + "\n").encode()), (h or "") + "\n") for s, n, h in rows]
