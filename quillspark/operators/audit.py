"""Integrity: coverage, totals, ranges, claims and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status (missing, orphan, duplicate): what of the expected isn't there once, and what is there unexpected."""
    have = actual.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys, F.lit(True).alias("wanted")).distinct().join(have, keys, "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "orphan").when(F.col("n") > 1, "duplicate")
    return both.select(*keys, status.alias("status")).where("status is not null")


def vector_integrity(df: DataFrame, vector_col: str) -> DataFrame:
    """One row: rows, dims, rows with NaN, zero rows, least and greatest norm."""
    v = V.doubles(F.col(vector_col))
    n = V.norm(v)
    return df.agg(F.count("*").alias("n_rows"), F.min(F.size(v)).alias("min_dims"), F.max(F.size(v)).alias("max_dims"), F.sum(F.exists(v, lambda x: x.isNull() | F.isnan(x)).cast("long")).alias("nan_rows"), F.sum((n == 0).cast("long")).alias("zero_rows"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm"))


def claims(observed: DataFrame, claimed: dict[str, float], tolerance: float = 0.15) -> DataFrame:
    """name, claimed, observed, ok: numbers of a one-row table against what is said of them."""
    each = [F.struct(F.lit(k).alias("name"), F.lit(v).alias("claimed"), F.col(k).cast("double").alias("observed"), (F.abs(F.col(k) - v) <= tolerance).alias("ok")) for k, v in claimed.items()]
    return observed.select(F.inline(F.array(*each)))


def plan_issues(plan: DataFrame) -> DataFrame:
    """issue, value: experiment or run ids used twice, and empty commands. plan: experiment_id, run_id, command (array)."""
    twice = lambda c: plan.groupBy(F.col(c).alias("value")).count().where("count > 1").select(F.lit(f"duplicate {c}").alias("issue"), "value")
    empty = plan.where(F.coalesce(F.size("command"), F.lit(0)) <= 0).select(F.lit("empty command").alias("issue"), F.col("experiment_id").alias("value"))
    return twice("experiment_id").union(twice("run_id")).union(empty)


def profile_issues(profiles: DataFrame, rows: DataFrame, author: str, work: str) -> DataFrame:
    """author, issue, work, stated, actual: where profiles (author, total, works as an array of work and n) don't say what the rows are.

    A profile is missing or unexpected as a whole; else its total, and each work's count, stated or not, must be those of the rows.
    """
    counts = rows.groupBy(F.col(author).alias("author"), F.col(work).alias("work")).agg(F.count("*").alias("n"))
    actual = counts.groupBy("author").agg(F.sum("n").alias("actual"))
    both = profiles.select("author", F.col("total").cast("long").alias("stated"), F.lit(True).alias("there")).join(actual, "author", "full")
    whole = F.when(F.col("there").isNull(), "missing profile").when(F.col("actual").isNull(), "unexpected profile").when(~F.col("stated").eqNullSafe(F.col("actual")), "total mismatch")
    first = both.select("author", whole.alias("issue"), F.lit(None).cast("string").alias("work"), "stated", "actual").where("issue is not null")
    listed = profiles.select("author", F.explode("works").alias("w")).select("author", F.col("w.work").alias("work"), F.col("w.n").cast("long").alias("stated"))
    known = actual.join(profiles.select("author"), "author", "left_semi").select("author")
    each = listed.join(known, "author", "left_semi").join(counts.join(known, "author", "left_semi").withColumnRenamed("n", "actual"), ["author", "work"], "full")
    return first.union(each.where("not (stated <=> actual)").select("author", F.lit("work mismatch").alias("issue"), "work", "stated", "actual"))


def progress(payload: Column, complete: int = 150) -> tuple[Column, Column]:
    """How many chapters a result file (its text) has, and whether these are enough: 0 without a file or a list of chapters, -1 for what is no JSON."""
    parsed = F.try_parse_json(payload)
    found = F.coalesce(F.size(F.try_variant_get(parsed, "$.chapters", "array<variant>")), F.lit(0))
    n = F.when(payload.isNull(), 0).when(parsed.isNull(), -1).otherwise(F.greatest(found, F.lit(0))).cast("long")
    return n, n >= complete


def same(a: Column, b: Column) -> Column:
    """Equal and both known: two nulls aren't comparable."""
    return a.isNotNull() & b.isNotNull() & (a == b)
