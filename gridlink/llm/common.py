"""What the operators share: reading tables, cutting lineage in the shared folder, Arrow batches by bytes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one call of a batch function gets at most, unless a single row is larger.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders and tables made by this process, by session; what is left of them goes when the process ends.
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local session (tests) takes a temporary
    folder; on a cluster that would be another folder on each machine, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/gridlink-scratch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/gridlink-{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove_all, spark)
    _MADE.add(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.discard(path)


def _remove_all(spark: SparkSession) -> None:
    """Results are read lazily, so their tables can't go before the process does."""
    with contextlib.suppress(Exception):  # the session may be gone; then whoever owns the folder cleans it
        if spark.sparkContext._jsc is not None:
            for path in list(_MADE):
                _remove(spark, path)


def cut(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """df, written once to the shared folder and read again: later stages don't recompute it, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Removes the files of a table made by cut() that nothing reads any more."""
    path = getattr(df, "scratch", None)
    if path:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of results that nothing refers to; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def arrow_of(schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema; on the driver only."""
    return to_arrow_schema(T._parse_datatype_string(schema))


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most size bytes of text, or of one row."""
    wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type)]
    rows = batch.num_rows
    if not wide or sum(c.nbytes for c in wide) <= size:
        yield batch
        return
    sizes = [0] * rows
    for c in wide:
        for i, v in enumerate(pa.compute.binary_length(c).to_pylist()):
            sizes[i] += v or 0
    start, total = 0, 0
    for i, v in enumerate(sizes):
        if total + v > size and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += v
    yield batch.slice(start)


def map_columns(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str | T.StructType, size: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of at most size bytes of text. make() runs once in each task and returns the function that
    takes the columns as Python lists and returns the result's columns, as lists or arrays."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        call = make()
        for batch in batches:
            for part in slices(batch, size):
                if part.num_rows:
                    got = call(*(c.to_pylist() for c in part.columns))
                    yield pa.RecordBatch.from_arrays([got[f.name].cast(f.type) if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def bucket(column: str, modulus: int):
    """crc32 of an id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus
