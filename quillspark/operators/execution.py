"""What became of experiments: records from a log of starts and ends, with time limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A log has a row a start or an end; a record a row an experiment.
LOG = "experiment string, kind string, at timestamp, timeout_seconds int, return_code int, metric double, status string"
RECORD = "experiment string, status string, return_code int, metric double, started_at timestamp, ended_at timestamp, duration_seconds double, error string"


def status_of(ended: Column, return_code: Column, metric: Column, reported: Column) -> Column:
    """failed without an end in time, with another return code than 0, or without a metric; else what was reported, and a failure that has a metric is a discard."""
    return F.when(~ended | (F.coalesce(return_code, F.lit(-1)) != 0) | metric.isNull(), "failed").when(reported.isNull() | (reported == "failed"), "discard").otherwise(reported)


def error_of(ended: Column, limit: Column, return_code: Column, metric: Column) -> Column:
    late = F.concat(F.lit("command timed out after "), limit.cast("string"), F.lit(" seconds"))
    code = F.concat(F.lit("command exited with code "), F.coalesce(return_code.cast("string"), F.lit("unknown")))
    return F.when(~ended, late).when(F.coalesce(return_code, F.lit(-1)) != 0, code).when(metric.isNull(), F.lit("metric extraction failed"))


def execution_records(log: DataFrame, now: Column | None = None) -> DataFrame:
    """RECORD for every experiment of the log that has ended, or whose time is over at ``now`` (else: over, if no end came).

    The first start counts, and of the ends the first after it; an end up to the limit is in time, a later one is none. An end before
    its start (clocks differ) counts with a duration of 0. An experiment without a start has no record; of equal times the lesser metric counts.
    """
    end = F.struct("at", F.col("metric"), "return_code", "status")
    one = log.withColumn("at", F.col("at").cast("timestamp")).groupBy("experiment").agg(
        F.min(F.when(F.col("kind") == "start", F.struct("at", "timeout_seconds"))).alias("s"),
        F.min(F.when(F.col("kind") == "end", end)).alias("e"),
    ).where("s is not null")
    limit = F.col("s.timeout_seconds")
    deadline = F.timestamp_add("SECOND", limit, F.col("s.at"))
    ended = F.coalesce(F.col("e.at") <= deadline, F.lit(False))
    over = ended | (F.lit(True) if now is None else now > deadline)
    known = lambda c: F.when(ended, F.col(f"e.{c}"))
    at = F.when(ended, F.col("e.at")).otherwise(deadline)
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros("s.at")) / 1e6)
    return one.where(over).select(
        "experiment", status_of(ended, known("return_code"), known("metric"), known("status")).alias("status"), known("return_code").alias("return_code"), known("metric").alias("metric"),
        F.col("s.at").alias("started_at"), at.alias("ended_at"), seconds.alias("duration_seconds"), error_of(ended, limit, known("return_code"), known("metric")).alias("error"),
    )
