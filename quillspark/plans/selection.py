"""Queries that choose rows, and verdicts on paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import selection
from .paths import _COS, PATHS, _test, paths
from .registry import query, rounded


@query("SELECT conv_id, turn, role, input FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY input, turn) AS n FROM (SELECT conv_id, turn, role, 0 AS input FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, role, 1 FROM conversations)) WHERE n = 1")
def ordered_dedup(read):
    c = read("conversations").select("conv_id", "turn", "role")
    return selection.first_wins([c.where("role = 'assistant'"), c], "conv_id", "turn").select("conv_id", "turn", "role", "input")


@query("SELECT doc_id, d.lang AS lang, t.lang AS target FROM documents d JOIN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) t ON d.lang <> t.lang ORDER BY doc_id, t.lang OFFSET 10 LIMIT 50")
def shift_cases(read):
    """Cases 11 to 60: offset and limit are the operator's own."""
    d = read("documents").select("doc_id", "lang")
    targets = d.where("lang is not null").select(F.col("lang").alias("target")).distinct()
    return selection.shift_cases(d, targets, "lang", "target", ["doc_id", "target"], 10, 50)


@query("SELECT vec_id, label, coalesce(lead(vec_id) OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id), first_value(vec_id) OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS partner FROM embeddings")
def derangement(read):
    return read("embeddings").select("vec_id", "label", selection.partner("vec_id", "label").alias("partner"))


@query(f"WITH {PATHS} SELECT path, arg_max(vec_id, pos) AS last_id, arg_min(vec_id, pos) AS first_id, round(list_inner_product(arg_max(v, pos), arg_min(v, pos)), 6) AS similarity FROM p GROUP BY path")
def closing_loop(read):
    ends = paths(read).groupBy("path").agg(F.max_by("vec_id", "pos").alias("last_id"), F.min_by("vec_id", "pos").alias("first_id"), F.max_by("v", "pos").alias("a"), F.min_by("v", "pos").alias("b"))
    return rounded(ends.select("path", "last_id", "first_id", V.dot(F.col("a"), F.col("b")).alias("similarity")))


@query(f"{_COS} SELECT path, CASE WHEN below * 100.0 / n > 95 THEN 'smoother than random' WHEN below * 100.0 / n > 50 THEN 'some signal' ELSE 'not smoother than random' END AS verdict FROM t")
def path_verdict(read):
    return _test(read, "mean_similarity", 1).select("path", selection.smoothness_band(F.col("percentile_raw")).alias("verdict"))
