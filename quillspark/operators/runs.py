"""Runs: summaries, comparisons, promotion and the incumbent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a candidate run must reach to be promoted.
MIN_OVERLAP, MIN_MEAN, MIN_MEDIAN, MIN_SHARE, MAX_FAILURES = 4, 0.005, 0.0, 0.5, 0


def run_summary(cases: DataFrame) -> DataFrame:
    """run, n_cases, n_failed, mean and median objective. cases: run, case, objective, labels (array)."""
    return cases.groupBy("run").agg(F.count("*").alias("n_cases"), F.sum((F.size("labels") > 0).cast("long")).alias("n_failed"), F.avg("objective").alias("mean_objective"), F.median("objective").alias("median_objective"))


def failure_modes(cases: DataFrame, labels: list[str]) -> DataFrame:
    """label, n, n_runs; labels without cases are kept."""
    every = cases.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    seen = cases.select("run", F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("run").alias("n_runs"))
    return every.join(seen, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"))


def paired(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Cases that two runs share, for each two runs i < j of the table of runs (run, idx)."""
    c = cases.join(F.broadcast(runs), "run")  # runs are a dimension of a few rows
    a = c.select("case", F.col("run").alias("ref"), F.col("idx").alias("i"), F.col("objective").alias("x"), F.col("labels").alias("lx"))
    b = c.select("case", F.col("run").alias("cand"), F.col("idx").alias("j"), F.col("objective").alias("y"), F.col("labels").alias("ly"))
    return a.join(b, "case").where("i < j")


def run_comparison(pairs: DataFrame) -> DataFrame:
    """ref, cand, n, mean and median delta, improved, worsened, unchanged, share not worse, failure delta, greatest gain and drop with their case."""
    d = pairs.withColumn("d", F.col("y") - F.col("x"))
    flag = lambda c: F.sum(c.cast("long"))
    return d.groupBy("ref", "cand").agg(
        F.count("*").alias("n"),
        F.avg("d").alias("mean_delta"),
        F.median("d").alias("median_delta"),
        flag(F.col("d") > 0).alias("improved"),
        flag(F.col("d") < 0).alias("worsened"),
        flag(F.col("d") == 0).alias("unchanged"),
        F.avg((F.col("d") >= 0).cast("double")).alias("share_not_worse"),
        (flag(F.size("ly") > 0) - flag(F.size("lx") > 0)).alias("failure_delta"),
        F.max("d").alias("gain"),
        F.min_by("case", F.struct((-F.col("d")).alias("d"), "case")).alias("gain_case"),
        F.min("d").alias("drop"),
        F.min_by("case", F.struct("d", "case")).alias("drop_case"),
    )


def failure_transitions(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """ref, cand, label: persistent, resolved, introduced."""
    e = pairs.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    was, is_ = F.array_contains("lx", F.col("label")), F.array_contains("ly", F.col("label"))
    flag = lambda c: F.sum(c.cast("long"))
    return e.groupBy("ref", "cand", "label").agg(flag(was & is_).alias("persistent"), flag(was & ~is_).alias("resolved"), flag(~was & is_).alias("introduced"))


def promotion(comparison: DataFrame, comparable=None) -> DataFrame:
    """The comparison with a recommendation: hold (not comparable, or few cases), promote, or reject."""
    ok = F.lit(True) if comparable is None else comparable
    clears = (F.col("mean_delta") >= MIN_MEAN) & (F.col("median_delta") >= MIN_MEDIAN) & (F.col("share_not_worse") >= MIN_SHARE) & (F.col("failure_delta") <= MAX_FAILURES)
    return comparison.withColumn("recommendation", F.when(~ok | (F.col("n") < MIN_OVERLAP), "hold").when(clears, "promote").otherwise("reject"))


def promotion_fold(comparison: DataFrame, order: DataFrame) -> DataFrame:
    """Runs in order against the incumbent, which a promoted run replaces: run, incumbent, recommendation.

    Each step needs the result of the one before, for a few runs: they are folded in one task.
    """
    import pandas as pd

    known = promotion(comparison).select("ref", "cand", "recommendation")
    both = order.select("run", "idx").join(known, order["run"] == known["cand"], "left").withColumn("all", F.lit(1))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        said = {(r.ref, r.cand): r.recommendation for r in pdf.itertuples() if isinstance(r.recommendation, str)}
        out, incumbent = [], None
        for run in pdf.sort_values("idx")["run"].drop_duplicates():
            what = "incumbent" if incumbent is None else said.get((incumbent, run), "hold")
            out.append((run, incumbent, what))
            if what in ("incumbent", "promote"):
                incumbent = run
        return pd.DataFrame(out, columns=["run", "incumbent", "recommendation"])

    return both.groupBy("all").applyInPandas(fold, "run string, incumbent string, recommendation string")


def incumbent_fold(log: DataFrame, key: str, seq: str, value: str, higher: bool = True) -> DataFrame:
    """The log with its decision: failed (no value), keep (strictly better than all before) or discard, and the best so far."""
    best = F.max if higher else F.min
    w = Window.partitionBy(key).orderBy(seq)
    before = best(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | ((F.col(value) > before) if higher else (F.col(value) < before))
    return log.withColumn("decision", F.when(F.col(value).isNull(), "failed").when(better, "keep").otherwise("discard")).withColumn("best", best(value).over(w))
