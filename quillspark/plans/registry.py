"""The table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Tables of texts, whose rows take long; and up to which size their rows are dealt out if they are in too few files.
TEXTS, SMALL = ("documents", "pages"), 256 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. A small table of texts in fewer files than there are cores would be one task's work; its rows are dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and len(df.inputFiles()) < cores and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL:
        return df.repartition(cores)
    return df


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register f(read) under its name; read(table) gives a table of the folder at hand."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda t: read_table(spark, sf_dir, t))
        if sql:
            SQL[key] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places: sums in another order differ in the last bits."""
    return df.select(*[r6(f"`{n}`").alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
