"""Groups are few: no step may deal out pages or cards by them."""

from lotwise.operators import listings as L
from lotwise.operators import search_pages as W
from lotwise.plans import page_queries
from lotwise.sources import pages as P


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_shuffle_by_group_alone(spark, data):
    """Three groups have all pages and cards: by group they would be three tasks."""
    fetched = page_queries.result_pages(spark, data)
    wanted = spark.createDataFrame([("N", 0, 0), ("H", 2, 1)], "grp string, most bigint, place int")
    parsed = P.parsed_pages(fetched, ("grp", "page"))
    filters = spark.createDataFrame([("N", *[None] * 8, None)], "grp string, min_price bigint, max_price bigint, min_size bigint, max_size bigint, min_psf bigint, max_psf bigint, min_top bigint, max_top bigint, districts array<string>")
    hints = lambda df: optimized(df).count("Hint=(strategy=broadcast)")
    assert hints(fetched) == 1
    assert hints(W.scan_parsed(wanted, parsed)[0]) == 3  # its own, and that of the pages, which it reads twice
    assert hints(L.recheck(W.scan_parsed(wanted, parsed)[0], filters)) == 4
