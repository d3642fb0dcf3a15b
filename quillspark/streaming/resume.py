"""Long extractions that can be stopped at any time: checkpoints by batch, time limits, rebuilding of what is stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def extract(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on each micro-batch of a stream and keep its rows under ``path``/batch=<id>; ends when all that is there is done.

    A batch that is run again after a crash replaces its own folder, so no row is lost or doubled. How much is between two checkpoints is the source's
    limit (maxFilesPerTrigger, maxRowsPerBatch).
    """

    def save(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within(query: StreamingQuery, seconds: float) -> bool:
    """Whether the query ended by itself in time; else it is stopped, and what its batches kept stays for a later start with the same checkpoint."""
    if query.awaitTermination(max(1, round(seconds))):
        return True
    query.stop()
    return False


def stale(expected: DataFrame, have: DataFrame, key: str, stated: DataFrame | None = None) -> DataFrame:
    """key, expected, rows, stated of every part that isn't there as a whole: its rows, or the number that its metadata state (a column n), differ from what is expected."""
    want = expected.groupBy(key).agg(F.count("*").alias("expected"))
    rows = have.groupBy(key).agg(F.count("*").alias("rows"))
    both = want.join(rows, key, "left")
    both = both.join(stated.select(key, F.col("n").alias("stated")), key, "left") if stated is not None else both.withColumn("stated", F.col("rows"))
    return both.where("not (rows <=> expected) or not (stated <=> expected)").select(key, "expected", F.coalesce("rows", F.lit(0)).alias("rows"), "stated")


def rebuild(spark: SparkSession, source: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, schema: str) -> list[str]:
    """Extract again those parts of a table partitioned by ``key`` that are missing or whose count differs from the source's, and replace just these.

    Gives the names of the parts that were replaced, which are as many as differ; all others are neither read nor written again.
    """
    have = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    parts = [r[0] for r in stale(source, have, key).select(F.col(key).cast("string")).orderBy(key).collect()]
    if parts:
        done = work(source.where(F.col(key).cast("string").isin(parts)))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return parts


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
