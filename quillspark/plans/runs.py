"""Queries over events as runs: a type is a run, a user a case, the mean value its objective."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lexicons import FAILURES
from ..operators import audit, metrics, runs, scoring
from .registry import query, rounded

CASES = f"""ca AS (SELECT event_type AS run, user_id AS "case", avg(value) AS objective, count(*) AS n, list_filter([CASE WHEN min(value) < 1 THEN '{FAILURES[0]}' END, CASE WHEN max(value) > 60 THEN '{FAILURES[1]}' END, CASE WHEN count(*) < 9 THEN '{FAILURES[2]}' END, CASE WHEN user_id % 7 = 0 THEN '{FAILURES[3]}' END, CASE WHEN user_id % 11 = 0 THEN '{FAILURES[4]}' END], lambda x: x IS NOT NULL) AS labels FROM events GROUP BY event_type, user_id)"""
_RUNS = "ru AS (SELECT run, row_number() OVER (ORDER BY run) AS idx FROM (SELECT DISTINCT event_type AS run FROM events))"
PAIRED = f"""{CASES}, {_RUNS}, pa AS (SELECT a.run AS ref, b.run AS cand, a."case" AS "case", a.objective AS x, b.objective AS y, round(b.objective - a.objective, 12) AS d, a.labels AS lx, b.labels AS ly FROM ca a JOIN ru i ON a.run = i.run JOIN ca b ON a."case" = b."case" JOIN ru j ON b.run = j.run WHERE i.idx < j.idx)"""


def cases(read):
    g = read("events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("case")).agg(F.avg("value").alias("objective"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    labels = scoring.failure_labels(F.col("lo") >= 1, F.col("hi") <= 60, F.col("n") >= 9, F.col("case") % 7 != 0, F.col("case") % 11 == 0)
    return g.select("run", "case", "objective", "n", labels.alias("labels"))


def _runs(read):
    r = read("events").select(F.col("event_type").alias("run")).distinct()  # a few run ids
    return r.withColumn("idx", F.row_number().over(Window.orderBy("run")))


def _paired(read):
    return runs.paired(cases(read).select("run", "case", "objective", "labels"), _runs(read))


@query(f"""WITH {CASES} SELECT run, "case", round(objective, 6) AS objective, n, array_to_string(labels, ',') AS labels FROM ca""")
def case_table(read):
    return rounded(cases(read).withColumn("labels", F.array_join("labels", ",")))


@query(f"""WITH {CASES} SELECT run, "case", CAST(len(labels) AS BIGINT) AS n_labels, array_to_string(labels, ',') AS labels FROM ca WHERE len(labels) > 0""")
def failure_labels(read):
    return cases(read).where(F.size("labels") > 0).select("run", "case", F.size("labels").cast("long").alias("n_labels"), F.array_join("labels", ",").alias("labels"))


@query(f"WITH {CASES} SELECT run, count(*) AS n_cases, count(*) FILTER (WHERE len(labels) > 0) AS n_failed, round(avg(objective), 6) AS mean_objective, round(median(objective), 6) AS median_objective FROM ca GROUP BY run")
def run_summary(read):
    return rounded(runs.run_summary(cases(read)))


@query(f"WITH {CASES} SELECT label, count(l) AS n, CAST(count(DISTINCT run) AS BIGINT) AS n_runs FROM (SELECT unnest([{', '.join(f"'{x}'" for x in [*FAILURES, 'other'])}]) AS label) LEFT JOIN (SELECT run, unnest(labels) AS l FROM ca) ON label = l GROUP BY label")
def failure_modes(read):
    return runs.failure_modes(cases(read), [*FAILURES, "other"])


@query(f"""WITH {CASES}, k AS (SELECT coalesce(a.run, b.run) AS mode, coalesce(n, 0) AS n, coalesce(n_failed, 0) AS n_failed, mean, median, reasons FROM (SELECT run, count(*) AS n, avg(objective) AS mean, median(objective) AS median, array_to_string(list_sort(list(DISTINCT CASE WHEN "case" % 11 = 0 THEN 'stalled' ELSE 'done' END)), ',') AS reasons FROM ca WHERE len(labels) = 0 OR "case" % 2 = 0 GROUP BY run) a FULL JOIN (SELECT run, count(*) AS n_failed FROM ca WHERE len(labels) > 0 AND "case" % 2 = 1 GROUP BY run) b ON a.run = b.run)
SELECT mode, n, n_failed, round(coalesce(mean, 0), 6) AS mean, round(coalesce(median, 0), 6) AS median, coalesce(reasons, '') AS reasons FROM k""")
def control_summary(read):
    c = cases(read)
    ok = (F.size("labels") == 0) | (F.col("case") % 2 == 0)
    reason = F.when(F.col("case") % 11 == 0, "stalled").otherwise("done")
    a = c.where(ok).groupBy("run").agg(F.count("*").alias("n"), F.avg("objective").alias("mean"), F.median("objective").alias("median"), F.array_join(F.sort_array(F.collect_set(reason)), ",").alias("reasons"))
    b = c.where(~ok).groupBy("run").agg(F.count("*").alias("n_failed"))
    j = a.join(b, "run", "full")
    return rounded(j.select(F.col("run").alias("mode"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "n_failed")], *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("mean", "median")], F.coalesce("reasons", F.lit("")).alias("reasons")))


@query(f"""WITH {CASES} SELECT run, CAST("case" % 5 AS BIGINT) AS author, count(*) AS n, round(avg(objective), 6) AS mean, round(median(objective), 6) AS median FROM ca GROUP BY GROUPING SETS ((run), ("case" % 5))""")
def bias_slices(read):
    c = cases(read).select("run", (F.col("case") % 5).cast("long").alias("author"), "objective")
    g = c.groupingSets([[F.col("run")], [F.col("author")]], F.col("run"), F.col("author"))
    return rounded(g.agg(F.count("*").alias("n"), F.avg("objective").alias("mean"), F.median("objective").alias("median")))


@query(f"""WITH {PAIRED} SELECT ref, cand, label, count(*) FILTER (WHERE list_contains(lx, label) AND list_contains(ly, label)) AS persistent, count(*) FILTER (WHERE list_contains(lx, label) AND NOT list_contains(ly, label)) AS resolved, count(*) FILTER (WHERE NOT list_contains(lx, label) AND list_contains(ly, label)) AS introduced FROM pa, (SELECT unnest([{', '.join(f"'{x}'" for x in FAILURES)}]) AS label) GROUP BY ref, cand, label""")
def failure_transitions(read):
    return runs.failure_transitions(_paired(read), FAILURES)


_COMPARE = f"""{PAIRED}, cmp AS (SELECT ref, cand, count(*) AS n, avg(y - x) AS mean_delta, median(y - x) AS median_delta, count(*) FILTER (WHERE y - x > 0) AS improved, count(*) FILTER (WHERE y - x < 0) AS worsened, count(*) FILTER (WHERE y - x = 0) AS unchanged, avg(CASE WHEN y - x >= 0 THEN 1.0 ELSE 0 END) AS share_not_worse,
 count(*) FILTER (WHERE len(ly) > 0) - count(*) FILTER (WHERE len(lx) > 0) AS failure_delta, max(y - x) AS gain, arg_min("case", (-(y - x), "case")) AS gain_case, min(y - x) AS "drop", arg_min("case", (y - x, "case")) AS drop_case FROM pa GROUP BY ref, cand)"""
_COMPARED = 'ref, cand, n, round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta, improved, worsened, unchanged, round(share_not_worse, 6) AS share_not_worse, failure_delta, round(gain, 6) AS gain, gain_case, round("drop", 6) AS "drop", drop_case'


@query(f"WITH {_COMPARE} SELECT {_COMPARED} FROM cmp")
def run_comparison(read):
    return rounded(runs.run_comparison(_paired(read)))


_WHAT = "CASE WHEN n < 4 THEN 'hold' WHEN mean_delta >= 0.005 AND median_delta >= 0 AND share_not_worse >= 0.5 AND failure_delta <= 0 THEN 'promote' ELSE 'reject' END"


@query(f"WITH {_COMPARE} SELECT ref, cand, {_WHAT} AS recommendation FROM cmp")
def promotion_decision(read):
    return runs.promotion(runs.run_comparison(_paired(read))).select("ref", "cand", "recommendation")


@query(f"WITH {_COMPARE}, w AS (SELECT ref, {_WHAT} AS what FROM cmp) SELECT ref, count(*) FILTER (WHERE what = 'hold') AS hold, count(*) FILTER (WHERE what = 'promote') AS promote, count(*) FILTER (WHERE what = 'reject') AS reject FROM w GROUP BY ref")
def promotion_counts(read):
    p = runs.promotion(runs.run_comparison(_paired(read))).groupBy("ref").pivot("recommendation", ["hold", "promote", "reject"]).count()
    return p.select("ref", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hold", "promote", "reject")])


@query()
def promotion_fold(read):
    return runs.promotion_fold(runs.run_comparison(_paired(read)), _runs(read))


@query(f"""WITH {CASES} SELECT run, arg_min("case", (-objective, "case")) AS best_case, arg_min("case", (objective, "case")) AS worst_case FROM ca GROUP BY run""")
def extremes(read):
    return cases(read).groupBy("run").agg(F.min_by("case", F.struct((-F.col("objective")).alias("o"), "case")).alias("best_case"), F.min_by("case", F.struct("objective", "case")).alias("worst_case"))


_FIELDS = ("c_mktsegment", "c_nationkey")


@query("""WITH c AS (SELECT a.c_custkey AS ref, b.c_custkey AS cand, a.c_mktsegment = b.c_mktsegment AS s1, a.c_nationkey = b.c_nationkey AS s2 FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)
SELECT count(*) FILTER (WHERE s1 AND s2) AS comparable, count(*) FILTER (WHERE NOT (s1 AND s2)) AS not_comparable, count(*) FILTER (WHERE NOT s1) AS segment_mismatch, count(*) FILTER (WHERE NOT s2) AS nation_mismatch FROM c""")
def comparability_summary(read):
    c = read("customer").select("c_custkey", *_FIELDS)
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), *[F.col(f).alias(f"{f}_b") for f in _FIELDS])
    j = c.join(b, "c_custkey").select(*[audit.same(F.col(f), F.col(f"{f}_b")).alias(n) for f, n in zip(_FIELDS, ("s1", "s2"), strict=True)])
    flag = lambda x: F.sum(x.cast("long"))
    both = F.col("s1") & F.col("s2")
    return j.agg(flag(both).alias("comparable"), flag(~both).alias("not_comparable"), flag(~F.col("s1")).alias("segment_mismatch"), flag(~F.col("s2")).alias("nation_mismatch"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), b AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(v) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM e)
SELECT user_id, event_id, CASE WHEN v IS NULL THEN 'failed' WHEN before IS NULL OR v > before THEN 'keep' ELSE 'discard' END AS decision, best FROM b""")
def incumbent_fold(read):
    e = read("events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return runs.incumbent_fold(e, "user_id", "event_id", "v").select("user_id", "event_id", "decision", "best")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN -1 WHEN value > 10 THEN 1 ELSE 0 END AS ordinal FROM events")
def decision_score(read):
    return read("events").select("event_id", F.when(F.col("event_type") == "error", -1).when(F.col("value") > 10, 1).otherwise(0).alias("ordinal"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS mean, max(value) AS top FROM events GROUP BY user_id, event_type)
SELECT user_id, 'controls.' || event_type || '.count' AS name, CAST(n AS DOUBLE) AS value FROM g UNION ALL SELECT user_id, 'controls.' || event_type || '.mean', round(mean, 6) FROM g UNION ALL SELECT user_id, 'controls.' || event_type || '.last.0', top FROM g
UNION ALL SELECT user_id, 'total_cases', CAST(sum(n) AS DOUBLE) FROM g GROUP BY user_id UNION ALL SELECT user_id, 'complete', CAST(count(*) = 5 AS INT) FROM g GROUP BY user_id""")
def flatten_metrics(read):
    """Each user's metrics by type of event as nested JSON, made flat."""
    g = read("events").groupBy("user_id", "event_type").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.array(F.max("value")).alias("last"))
    one = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("count", "mean", "last", F.col("event_type").alias("label"))))).alias("controls"), F.sum("count").alias("total_cases"), (F.count("*") == 5).alias("complete"))
    nested = one.select("user_id", F.to_json(F.struct("controls", "total_cases", "complete")).alias("payload"))
    return rounded(metrics.flatten(nested, "payload", ["user_id"]))


@query("SELECT DISTINCT split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages")
def extract_params(read):
    """The value after a flag of a command, distinct."""
    words = F.split(F.concat(F.lit("run --host "), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)), F.lit(" --quiet")), " ")
    w = read("pages").select("page_id", words.alias("w"))
    return w.select(F.get("w", (F.array_position("w", "--host")).cast("int")).alias("host")).distinct()


@query("""WITH p AS (SELECT 'e' || (event_id - CASE WHEN event_id % 90 = 1 THEN 1 ELSE 0 END) AS experiment_id, event_id FROM events)
SELECT 'duplicate experiment_id' AS issue, experiment_id AS value FROM p GROUP BY experiment_id HAVING count(*) > 1 UNION ALL SELECT 'empty command', experiment_id FROM p WHERE event_id % 250 = 0""")
def plan_validation(read):
    name = F.col("event_id") - F.when(F.col("event_id") % 90 == 1, 1).otherwise(0)
    p = read("events").select(F.format_string("e%d", name).alias("experiment_id"), F.format_string("r%d", F.col("event_id")).alias("run_id"), F.when(F.col("event_id") % 250 != 0, F.array(F.lit("run"))).alias("command"))
    return audit.plan_issues(p)


@query(f"""WITH {CASES} SELECT run, CAST(len(labels) AS BIGINT) AS n_labels, count(*) AS n FROM ca GROUP BY run, len(labels)""")
def report_tables(read):
    return cases(read).groupBy("run", F.size("labels").cast("long").alias("n_labels")).agg(F.count("*").alias("n"))


@query(f"""WITH {_COMPARE} SELECT 'runs' AS section, run AS name, round(avg(objective), 6) AS value FROM ca GROUP BY run UNION ALL SELECT 'comparisons', ref || '/' || cand, round(mean_delta, 6) FROM cmp""")
def analysis_report(read):
    a = runs.run_summary(cases(read)).select(F.lit("runs").alias("section"), F.col("run").alias("name"), F.col("mean_objective").alias("value"))
    b = runs.run_comparison(_paired(read)).select(F.lit("comparisons").alias("section"), F.concat_ws("/", "ref", "cand").alias("name"), F.col("mean_delta").alias("value"))
    return rounded(a.union(b))
