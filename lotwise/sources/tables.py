"""Tables by name in a folder of Parquet files, and keyed JSON stores."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import requests, scalars
from . import pages

PARQUET = "parquet"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """The rows over all cores by a key, before work that is large beside their bytes: a few MB of rows would be one task, however long each of them takes.
    The number of partitions is fixed, as Spark would put small ones together again."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def shuffled(rows: DataFrame, how: str = "merge") -> DataFrame:
    """The rows for a join that shuffles both sides (``how``: ``merge``, or ``shuffle_hash`` with these rows as the side that is looked up), before joins of what
    grows with the input. Spark takes sizes from compressed files and from the types of columns, so a million pages can pass for small, and what passes
    for small goes through the driver whole."""
    return rows.hint(how)


def stream_table(spark: SparkSession, folder: str, name: str, files_a_batch: int = 100) -> DataFrame:
    """The files of a table as a stream, whether it is one file or a folder of them."""
    path = f"{folder}/{name}.parquet"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def json_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A store of JSON objects, one a line; broken lines are all null and are left out, a missing store is empty."""
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    rows = reader.json(path)
    return rows.filter(rows["_corrupt"].isNull()).drop("_corrupt")


class PageSource(Protocol):
    """What a site's reader has to give. All of it is columns and DataFrames, so a new site is one more object of this form."""

    marker: str  # what a fetched page must hold

    def search_url(self, group: Column, page: Column, filters: Column, has: list[str]) -> Column: ...
    def total_pages(self, html: Column) -> Column: ...
    def listings(self, pages: DataFrame, keep: tuple[str, ...]) -> DataFrame: ...
    def parsed(self, pages: DataFrame, keep: tuple[str, ...]) -> DataFrame: ...
    def project_path(self, name: Column, key: Column) -> Column: ...
    def projects(self, pages: DataFrame, keep: tuple[str, ...]) -> DataFrame: ...
    def search_fields(self) -> str: ...
    def project_fields(self) -> list[str]: ...


class IslandPages:
    """Search pages with a JSON island, project pages with microdata; ``base`` is the address of the site."""

    marker = "__NEXT_DATA__"

    def __init__(self, base: str = ""):
        self.base = base

    def search_url(self, group: Column, page: Column, filters: Column, has: list[str]) -> Column:
        return requests.search_url(self.base, group, page, filters, has)

    def total_pages(self, html: Column) -> Column:
        return pages.total_pages(html)

    def listings(self, rows: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
        return pages.listings(rows, keep=keep)

    def parsed(self, rows: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
        return pages.parsed_pages(rows, keep)

    def project_path(self, name: Column, key: Column) -> Column:
        return scalars.project_path(name, key)

    def projects(self, rows: DataFrame, keep: tuple[str, ...] = ("property_id",)) -> DataFrame:
        return pages.projects(rows, keep=keep)

    def search_fields(self) -> str:
        """The part of the island that is read; the rest is not parsed into rows."""
        return pages.PAGE

    def project_fields(self) -> list[str]:
        return ["top_year", "total_units", "floors", "tenure", "developer", "property_type", "psf_range", "image_url", "photos", "latitude", "longitude"]


#: Readers of tables and of sites by name; a new source is one more entry.
SOURCES = {PARQUET: table}
SITES: dict[str, PageSource] = {"islands": IslandPages()}


def source(name: str = ""):
    """The reader of a name, the default for none; an unknown name is an error."""
    if (found := SOURCES.get(name or PARQUET)) is None:
        raise ValueError(f"unknown source: {name}")
    return found


def site(name: str = "") -> PageSource:
    """The same for sites."""
    if (found := SITES.get(name or next(iter(SITES)))) is None:
        raise ValueError(f"unknown site: {name}")
    return found
