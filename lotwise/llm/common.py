"""Helpers that the operators share: table access, Arrow batch mapping and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a mapped function sees at once; Arrow batches are cut to this so that long texts stay within memory.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Rows in an Arrow batch between the JVM and Python, unless the session has a setting of its own.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows; parts of more than ``most_bytes`` are halved down to single rows."""
    for start in range(0, batch.num_rows, rows):
        waiting = [batch.slice(start, rows)]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > most_bytes:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def small_batches(spark: SparkSession) -> None:
    """Texts can be long, so batches of the default 10,000 rows are too large; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``fn`` over Arrow slices of ``df``; it returns the columns of ``schema`` as lists.

    ``fn`` may be a factory result with per-worker state; it is pickled once per task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_rows):
                out = fn(part)
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, inputs: list[Column], fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of ``df`` as they are, with the columns of ``schema`` that ``fn`` makes of the ``inputs``; their names must
    be new to ``df`` (see ``free_name``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    own, new = df.schema, StructType.fromDDL(schema)
    n, new_arrow, whole = len(own), to_arrow_schema(new), to_arrow_schema(StructType([*own, *new]))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_rows):
                out = fn(part.select(range(n, part.num_columns)))
                made = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in new_arrow]
                yield pa.RecordBatch.from_arrays([part.column(i).cast(whole.field(i).type) for i in range(n)] + made, names=whole.names)

    # by place, since names may clash or hold dots
    return df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)), *(c.alias(f"x{i}") for i, c in enumerate(inputs))).mapInArrow(run, StructType([*own, *new]))


_STATE: dict = {}


def worker_state(key, make: Callable):
    """What a Python worker keeps from one task to the next, such as word caches; the last few keys stay."""
    if key not in _STATE:
        while len(_STATE) >= 2:
            _STATE.pop(next(iter(_STATE)))
        _STATE[key] = make()
    return _STATE[key]


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def persist_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table whose readers are done."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
