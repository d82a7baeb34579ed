"""Writes: whole tables in one step, results by job, and turns of conversations, all of which can be repeated without harm."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.listings import first_by_arrival


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def there(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def _move_over(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another one in one step."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), spark._jsc.hadoopConfiguration()).rename(a, b, options)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def version(spark: SparkSession, path: str) -> str | None:
    """The folder of a table's current version, none where it was never written."""
    fs, pointer = _fs(spark, f"{path}/_current")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def current(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The current version of a table that ``overwrite`` writes; with a ``schema``, a table that isn't there is empty."""
    folder = version(spark, path)
    if folder is None:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(folder)


def overwrite(df: DataFrame, path: str) -> None:
    """Write a table as a new version in the folder ``path``, then move a pointer to it over the old one: one rename, so readers see the old or
    the new table at any time, also after a crash. A table may be made of itself. The version before the last stays for those who read it."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    before = version(spark, path)
    df.write.parquet(f"{path}/{name}")
    _write_text(spark, f"{path}/_next-{name}", name)
    _move_over(spark, f"{path}/_next-{name}", f"{path}/_current")
    fs, folder = _fs(spark, path)
    keep = {f"{path}/{name}".rsplit("/", 1)[1], before and before.rsplit("/", 1)[1]}
    for status in fs.listStatus(folder):
        if status.isDirectory() and status.getPath().getName().startswith("v-") and status.getPath().getName() not in keep:
            fs.delete(status.getPath(), True)


def write_results(results: DataFrame, path: str, job: str = "job_id") -> None:
    """Results in a folder for each job; a job that is written again replaces its own folder only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(path)


def append_batch(rows: DataFrame, path: str, batch: int, key: Sequence[str], order: Sequence[str]) -> bool:
    """Append a batch to a table with a ledger, once: whether it was new.

    Each batch is a folder, and a marker in the ledger commits it. A batch that is there already isn't written again, and what an
    attempt without a marker left is written over. Of rows with one key the first by ``order`` counts. The table itself is never read,
    so a batch costs the same however much is there."""
    if committed(rows.sparkSession, path, batch):
        return False
    first_by_arrival(rows, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    fs, marker = _fs(rows.sparkSession, f"{path}/_ledger/{batch}")
    fs.create(marker, True).close()
    return True


def committed(spark: SparkSession, path: str, batch: int) -> bool:
    return there(spark, f"{path}/_ledger/{batch}")


def ledger(spark: SparkSession, path: str) -> list[int]:
    """The committed batches, in order."""
    fs, folder = _fs(spark, f"{path}/_ledger")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []


def read_ledger(spark: SparkSession, path: str, schema, key: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """The rows of all committed batches with their ``batch``. With a ``key``, of the same key in several batches the first batch counts."""
    batches = ledger(spark, path)
    whole = T.StructType([*schema, T.StructField("batch", T.LongType())])
    if not batches:
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches))
    return first_by_arrival(rows, key, ["batch", *order]) if key else rows


def turn_sink(path: str, key: Sequence[str] = ("session", "turn"), order: Sequence[str] = ("role", "text")) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: turns are appended once, whether they ended well or not and however often a batch runs."""

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, number, key, order)

    return write
