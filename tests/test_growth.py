"""Steps whose cost must grow no faster than their input: what Spark plans for them."""

import json

from pyspark.sql import functions as F

from lotwise.sources import pages as P


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def island(cards, total="7"):
    return f'<html>{P.ISLAND_START} x="1">' + json.dumps({"props": {"pageProps": {"pageData": {"data": {"listingsData": cards, "paginationData": {"totalPages": total}}}}}}) + "</script></html>"


def stored_pages(spark, tmp_path):
    """A page with cards, one with a card of another type, one cut short, none."""
    good = {"listingData": {"id": "3", "price": {"value": "1,000"}}}
    rows = [(1, island([good])), (2, island([good, "x"])), (3, island([good])[:-30]), (4, "</script>" + island([good])), (5, ""), (6, None)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages")
    return spark.read.parquet(f"{tmp_path}/pages")


def test_an_island_is_found_and_parsed_once(spark, tmp_path):
    pages = stored_pages(spark, tmp_path)
    for df in (P.listings(pages), P.parsed_pages(pages, ("page_id",)), pages.select(P.total_pages(F.col("html")).alias("total"))):
        assert optimized(df).count("__NEXT_DATA__") == 1
    assert "listingsData" not in optimized(pages.select(P.total_pages(F.col("html")).alias("total")))
    assert {r.page_id: r.t for r in pages.select("page_id", P.total_pages(F.col("html")).alias("t")).collect()} == {1: 7, 2: 7, 3: 0, 4: 7, 5: 0, 6: 0}
    assert sorted(r.page_id for r in P.listings(pages).collect()) == [1, 2, 4]
    assert [r.n for r in P.parsed_pages(pages, ("page_id",)).orderBy("page_id").select(F.size("cards").alias("n")).collect()] == [1, 1, 0, 1, 0, 0]
