"""What the corpus operators share: tables, staged intermediate tables, Arrow row maps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records of one Arrow batch; with it a worker holds a few MB of usual texts at a time.
BATCH_RECORDS = 1000
#: Bytes of one Arrow batch, for batches of very long texts.
BATCH_BYTES = 8 << 20

#: Paths of staged tables that are still there.
_staged: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts (read when a plan is executed)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_RECORDS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = getattr(spark.sparkContext, "_gridloom_shared", None)
    if own is None:
        if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="gridloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            own = f"file://{folder}"
        else:
            # On a cluster only what all executors share will do: the warehouse.
            own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_gridloom"
        spark.sparkContext._gridloom_shared = own
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to delete a query's shuffle files when it has ended, not when its driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and reread: cuts the lineage and survives lost executors.

    What was shuffled to make it isn't needed after that, and is deleted at once.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstaged(df: DataFrame) -> None:
    """Delete what ``staged`` has written, before its `staging` ends."""
    _staged.remove(df._staged_at)
    drop(df.sparkSession, df._staged_at)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those that the function it gives has staged: what the results are read from."""
    mark, results = len(_staged), []

    def result(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        results.append(_staged.pop())
        return out

    try:
        yield result
    finally:
        while len(_staged) > mark:
            drop(spark, _staged.pop())
        _staged.extend(results)


#: Bytes of files, or of what was shuffled, up to which Spark may choose to broadcast a side inside ``bounded_broadcasts``.
BROADCAST = 1 << 20


@contextmanager
def bounded_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Plans executed inside broadcast no side of more than BROADCAST bytes, or of Spark's limit if that is less.

    Spark goes by the bytes of compressed files. Columns of numbers that repeat, or arrays that share most of theirs,
    can be many times larger as rows in the driver.
    """
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, most = spark.conf.get(key), spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set(key, str(min(most, BROADCAST)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add (names compare without case, as Spark's do)."""
    own = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in own])


def packed(df: DataFrame, *own: Column) -> DataFrame:
    """``_row``, all columns of ``df`` as one, and the columns ``own``: whatever the columns' names, they don't clash with an operator's own."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *own)


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``_row``, those in ``new`` replaced."""
    return df.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes, so that a text that isn't valid Unicode doesn't break the transfer."""
    return text.cast("binary")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and its n + 1 offsets; nulls are empty."""
    column = column.fill_null(b"") if column.null_count else column
    wide = column.type in (pa.large_binary(), pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, name: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of the binary column each, one row at least."""
    _, at = flat(batch.column(batch.schema.get_field_index(name)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def row_map(df: DataFrame, work: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], keep: list[str] | None = None, most: int = 2 << 20) -> DataFrame:
    """Columns computed from the binary column ``work`` beside the columns ``keep`` (all others by default).

    ``make`` runs once in each task and returns the function of a piece of the column.
    Rows stay where they are: no shuffle, nothing kept between pieces.
    """
    keep = [c for c in df.columns if c != work] if keep is None else keep
    df = df.select([df[f"`{c}`"] for c in keep] + [df[f"`{work}`"]])
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in pieces(batch, work, most):
                found = f(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + found, names=names)

    return df.mapInArrow(run, schema)


def long(values: np.ndarray | list, mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), mask=mask)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values[at[i]:at[i + 1]]`` for each i, also for empty ranges."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


#: Lower-cases A to Z only.
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: The same, and every ASCII byte that is neither a digit nor a letter becomes a space.
LOWER_ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in LOWER)

