"""Scores of rewrites, objectives, iterations and what is chosen from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.lexicons import FAILURES

# Tolerances, guardrails and weights of success.
TOLERANCE = 0.75
LENGTH_MIN, LENGTH_MAX, JACCARD_MIN, EDIT_MIN = 0.80, 1.20, 0.10, 0.10
WEIGHTS = {"semantic": 0.45, "target": 0.35, "length": 0.10, "lexical": 0.10}
IMPROVES_BY = 1e-9


def lexical_controls(source: Column, candidate: Column) -> dict[str, Column]:
    """Token counts, length ratio (0 for an empty source) and Jaccard similarity (1 for two empty texts)."""
    a, b = X.token_set(source), X.token_set(candidate)
    na, nb = F.size(X.chunks(source)), F.size(X.chunks(candidate))
    return {
        "source_tokens": na.cast("long"),
        "candidate_tokens": nb.cast("long"),
        "length_ratio": F.coalesce(F.try_divide(nb.cast("double"), na), F.lit(0.0)),
        "token_jaccard": F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(1.0)),
    }


def edit_similarity(df: DataFrame, source: str, candidate: str, out: str = "edit_similarity") -> DataFrame:
    """Ratio of matching blocks (with the heuristic for popular characters), in this order of the two texts; a pandas UDF."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    return df.withColumn(out, ratio(F.col(source), F.col(candidate)))


def rewrite_score(source: Column, candidate: Column, target: Column, scale: Column) -> dict[str, Column]:
    """Distances of a rewrite's vector, improvement towards the target, and whether each is within tolerance."""
    to_source, to_target, before = V.rms_distance(source, candidate, scale), V.rms_distance(candidate, target, scale), V.rms_distance(source, target, scale)
    return {
        "source_distance": to_source,
        "target_distance": to_target,
        "start_distance": before,
        "improvement": before - to_target,
        "improvement_ratio": F.coalesce(F.try_divide(before - to_target, before), F.lit(1.0)),
        "source_pass": to_source <= TOLERANCE,
        "target_pass": to_target <= TOLERANCE,
    }


def weighted_objective(semantic: Column, target: Column, ratio: Column, jaccard: Column, edit: Column) -> dict[str, Column]:
    """Components between 0 and 1, guardrails, and their weighted sum."""
    length_pass = ratio.between(LENGTH_MIN, LENGTH_MAX)
    overlap_pass = (jaccard >= JACCARD_MIN) & (edit >= EDIT_MIN)
    part = {
        "semantic": V.clamp01(1 - semantic / TOLERANCE),
        "target": V.clamp01(1 - target / TOLERANCE),
        "length": F.when(length_pass, 1.0).when(ratio < LENGTH_MIN, V.clamp01(ratio / LENGTH_MIN)).otherwise(V.clamp01(F.try_divide(F.lit(LENGTH_MAX), ratio))),
        "lexical": F.when(overlap_pass, V.clamp01(1 - edit)).otherwise(0.0),
    }
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + w * part[k]
    return {f"{k}_component": v for k, v in part.items()} | {"length_pass": length_pass, "overlap_pass": overlap_pass, "weighted_objective": total}


def best_iteration(df: DataFrame, case: str, turn: str, value: str) -> DataFrame:
    """case, best_turn, best_value, n_used, stop_reason.

    Turns are read in order; the first that doesn't improve on the best before it, but the very first, ends the case.
    """
    w = Window.partitionBy(case).orderBy(turn)
    best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("__fails", best.isNotNull() & ~(F.col(value) > best + IMPROVES_BY))
    d = d.withColumn("__stopped", F.coalesce(F.max(F.col("__fails").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = d.where("__stopped = 0").groupBy(case).agg(F.max_by(turn, F.struct(F.when(~F.col("__fails"), F.col(value)).alias("v"), (-F.col(turn)).alias("t"))).alias("best_turn"), F.max(F.when(~F.col("__fails"), F.col(value))).alias("best_value"), F.count("*").alias("n_used"), F.max(F.col("__fails").cast("int")).alias("f"))
    return used.select(case, "best_turn", "best_value", "n_used", F.when(F.col("f") == 1, "no_objective_improvement").otherwise("max_iterations_reached").alias("stop_reason"))


def failure_labels(semantic: Column, target: Column, length: Column, overlap: Column, stalled: Column) -> Column:
    """Labels, in their fixed order, of what failed (the first four are passes) or stalled."""
    flags = [~semantic, ~target, ~length, ~overlap, stalled]
    return F.filter(F.array(*[F.when(f, name) for f, name in zip(flags, FAILURES, strict=True)]), lambda x: x.isNotNull())


def style_deltas(long: DataFrame, keys: list[str], source: str, target: str, top: int = 5) -> DataFrame:
    """Of each key, the dims with the greatest difference of target and source (ties by name, descending), as text."""
    d = long.withColumn("delta", F.col(target) - F.col(source))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("delta"), 9)), F.desc("dim")))
    d = d.withColumn("rank", rank).where(F.col("rank") <= top)
    return d.select(*keys, "rank", "dim", F.format_string("%s: %.3f -> %.3f", F.col("dim"), F.col(source), F.col(target)).alias("line"))


def validate_scores(payload: Column, dims: list[str]) -> Column:
    """Map of dim to score (1 to 10) from JSON, whether each is a number or an object with a score; null unless all are there and numeric."""
    value = {d: F.expr("0") for d in dims}
    for d in dims:
        raw = F.coalesce(F.get_json_object(payload, f"$.{d}.score"), F.get_json_object(payload, f"$.{d}"))
        value[d] = V.clamp_score(raw.try_cast("double"))
    ok = F.lit(True)
    for v in value.values():
        ok = ok & v.isNotNull()
    return F.when(ok, F.create_map(*[x for d, v in value.items() for x in (F.lit(d), v)]))
