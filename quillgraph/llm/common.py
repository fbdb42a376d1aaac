"""What the operators share: scratch tables in the cluster's shared folder, a bounded broadcast that
thins a scan before a join, and a join that splits hot keys by salt."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts give it.
WS = r"[\x20\x09-\x0D]"

BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

#: Words of 64 bits of the thinning filter: its broadcast has so many rows of two longs at most, some tens of MB at any scale.
FILTER_WORDS = 1 << 20

#: Parts that the rows of one key are split into by salted_join().
SALTS = 16


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, as in tests; an error on a cluster,
    whose executors would not see it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/quillgraph-scratch-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes the scratch tables written within it when it ends, but for those that materialize(..., stays=True) wrote.
    What leaves the scope must read such tables only. Scopes nest; they belong to one thread of the driver."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def scratch_path(spark: SparkSession, name: str, stays: bool = False) -> str:
    path = f"{scratch_root(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if stays else _scopes
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone, and with it the right to clean up
        pass


def materialize(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors. stays: beyond the innermost scratch_scope()."""
    spark = df.sparkSession
    path = scratch_path(spark, name, stays)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Has the driver notice now that the shuffles of finished writes are no longer referred to, so that executors remove their files before the next large shuffle, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def byte_batches(spark: SparkSession) -> None:
    """Has Spark hand rows to Python in Arrow batches of BATCH_BYTES, as a batch of 10,000 long texts would fill a worker and its executor's
    buffers. Spark has no such setting for one query, so it holds for the session; a limit that the cluster or the caller has set stays."""
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def release_memory() -> None:
    """Gives what a Python worker has freed back to the machine; workers live on, and idle ones should not hold a task's peak."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(sizes: list[int], limit: int):
    """(from, to) of runs of texts of about limit bytes, one text at least."""
    a = size = 0
    for i, n in enumerate(sizes):
        size += n + 1
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct named row: an operator's own columns beside it can't clash with any of them."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")


def row_columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of docs again, out of row, those named in new with new values."""
    return [(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, also where body's lambdas use it often."""
    return F.transform(F.array(value), body)[0]


def _filter_of(keys: DataFrame, cols: list[str], words: int) -> DataFrame:
    """A bit map over the hashes of keys: rows of word number and 64 bits."""
    h = F.xxhash64(*cols)
    return F.broadcast(keys.select(F.pmod(h, F.lit(words)).alias("word"), _bit(h).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))


def _may_be(h: Column, found: DataFrame, words: int) -> Column:
    return (F.pmod(h, F.lit(words)) == found["word"]) & (found["bits"].bitwiseAND(_bit(h)) != 0)


def thin(df: DataFrame, keys: DataFrame, cols: list[str], words: int = FILTER_WORDS) -> DataFrame:
    """The rows of df whose key may occur in keys: no row that does is lost, most others are.

    The broadcast is a bit map of at most `words` rows however many keys there are; it thins well up to some thirty million keys, and less beyond.
    """
    found = _filter_of(keys, cols, words)
    return df.join(found, _may_be(F.xxhash64(*[df[c] for c in cols]), found, words), "left_semi")


def part_by_keys(df: DataFrame, keys: DataFrame, col: str, key_col: str, words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose col is surely not among keys, which need no shuffle to learn that, and the others. Bounded like thin()."""
    found = _filter_of(keys, [key_col], words)
    on = _may_be(F.xxhash64(df[col]), found, words)
    return df.join(found, on, "left_anti"), df.join(found, on, "left_semi")


def salted_join(df: DataFrame, keyed: DataFrame, cols: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """df joined on cols with keyed, which has one row of a key: a key's rows of df are dealt to `salts` parts by a hash of
    all their columns, and its row of keyed to each, so that a hot key is no single task's."""
    own = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    each = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", own).join(each, [*cols, "_salt"], how).drop("_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
