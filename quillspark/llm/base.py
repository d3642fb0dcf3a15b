"""Shared plumbing of the llm operators: tables, staging, Arrow helpers and keyed hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: dict[str, SparkSession] = {}
_LOCAL_ROOT = "file:///tmp/checkpoints/quillspark"
#: Bytes of an Arrow batch that goes to a Python worker, where the session has Spark's default of 64 MB.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any file system that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a local one, if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or _LOCAL_ROOT


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, so a lost executor costs no recomputation.

    The files stay until ``unstage`` or the exit of the driver's Python. Shuffle files of what was staged before go as soon as the
    driver's garbage is collected, which is asked for here.
    """
    spark = df.sparkSession
    release(spark)
    path = f"{shared_root(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_clean)
    _STAGED[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing will read again; a table that isn't staged is left alone."""
    for df in tables:
        path = df.__dict__.pop("staged_at", None)
        if path in _STAGED:
            _remove(_STAGED.pop(path), path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _STAGED.items():
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():  # a stopped session can't remove them
            return
        _remove(spark, path)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns an operator works on, under fixed names; extra columns never clash."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """A string column as str; null is empty."""
    return [x or "" for x in column.to_pylist()]


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session now sends Python workers batches of bounded bytes, if it had Spark's default."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, BATCH_BYTES)
    return df


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def settle() -> None:
    """Give freed memory back to the system: Python workers live long, and share their executor's with the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def through(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes, settled now and then."""

    def settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for b in batches:
            yield b
            size += b.nbytes
            if size >= 4 << 20:
                settle()
                size = 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(settled(batches))
        settle()

    return small_batches(df).mapInArrow(run, schema)


def column_function(f: Callable[..., pa.Array], kind: str) -> Callable[..., F.Column]:
    """A function of columns that goes through Python in Arrow batches and settles after each."""

    def run(*columns: pa.Array) -> pa.Array:
        out = f(*columns)
        settle()
        return out

    if f.__code__.co_argcount == 1:
        return F.arrow_udf(lambda a: run(a), kind)
    return F.arrow_udf(lambda a, b, c: run(a, b, c), kind)


def narrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply f to each Arrow batch; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)

    return through(df, run, schema)


def rid_text(doc_id: str = "id") -> F.Column:
    """The id as text; null is empty."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def rid(doc_id: str = "id") -> F.Column:
    """crc32 of the id as text, the number by which contracts divide rows; a null id counts as empty text."""
    return F.crc32(rid_text(doc_id).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) over all (s, n)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
