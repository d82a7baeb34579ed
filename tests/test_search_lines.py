"""Searches whose forms repeat a group."""

from pyspark.sql import functions as F

from lotwise.operators import forms as M
from lotwise.plans import form_queries


def test_forms_of_one_group_in_a_search_come_by_their_key(spark, data):
    """Two forms of one group in a search: the order of the keys, not of the descriptions."""
    form = form_queries.forms(spark, data).limit(1).select(*(F.lit("").alias(c) if t == "string" else F.array().cast("array<string>").alias(c) for c, t in form_queries.forms(spark, data).dtypes if c not in ("k", "grp", "maxPages")))
    three = spark.createDataFrame([(9, "N", "0", "b"), (1, "N", "0", "z"), (5, "H", "0", "c")], "k bigint, grp string, maxPages string, word string")
    got = M.search_lines(three.crossJoin(form.drop("keyword")).withColumn("keyword", F.col("word")).withColumn("search", F.lit(1)), "search", ["k"]).collect()[0]
    assert got.full == 'Condo (keyword "z"), Condo (keyword "b"), HDB (keyword "c")'
