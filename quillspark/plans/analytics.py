"""Queries with raters, scores and rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import matrix, scoring, selection
from ..operators import stats as S
from .registry import query, r6, rounded

#: Two raters from 1 to 10: bins of quantity and of price, for each line number; ties are many, as in such scores.
RATERS = "ra AS (SELECT l_linenumber AS dim, l_orderkey, CAST(greatest(1, least(10, ceil(l_quantity / 5.0))) AS BIGINT) AS a, CAST(greatest(1, least(10, ceil(l_extendedprice / 10000.0))) AS BIGINT) AS b FROM lineitem)"


def raters(read):
    one = lambda c, by: F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col(c) / by))).cast("long")
    return read("lineitem").select(F.col("l_linenumber").alias("dim"), "l_orderkey", one("l_quantity", 5.0).alias("a"), one("l_extendedprice", 10000.0).alias("b"))


_RANKED = "rk AS (SELECT dim, rank() OVER (PARTITION BY dim ORDER BY a) + (count(*) OVER (PARTITION BY dim, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dim ORDER BY b) + (count(*) OVER (PARTITION BY dim, b) - 1) / 2.0 AS rb FROM ra)"
_AGREE = "count(*) AS n, round(corr(a, b), 6) AS r, round(avg(abs(a - b)), 6) AS mae, round(avg(CASE WHEN abs(a - b) <= 1 THEN 100.0 ELSE 0 END), 6) AS within_1, round(avg(CASE WHEN abs(a - b) <= 2 THEN 100.0 ELSE 0 END), 6) AS within_2, round(avg(CASE WHEN a = b THEN 100.0 ELSE 0 END), 6) AS exact, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS bias, CAST(max(abs(a - b)) AS DOUBLE) AS max_diff"


@query(f"WITH {RATERS}, {_RANKED} SELECT dim, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM rk GROUP BY dim")
def spearman(read):
    return rounded(S.spearman(raters(read), "a", "b", ["dim"]))


def _p_sql(r: str) -> str:
    """1 - I(r^2; 1/2, (n - 2) / 2), by the power series of the incomplete beta function, term by term in logarithms."""
    z, b = f"({r} * {r})", "((n - 2) / 2.0)"
    front = f"0.5 * ln({z}) + {b} * ln(1 - {z}) - ln(0.5) + lgamma(0.5 + {b}) - lgamma(0.5) - lgamma({b})"
    term = f"lgamma(1.5) + lgamma(0.5 + {b} + k + 1) - lgamma(k + 2.5) - lgamma(0.5 + {b}) + (k + 1) * ln({z})"
    return f"1 - (exp({front}) + list_sum(list_transform(range(0, 400), lambda k: exp({front} + {term}))))"


_WEAK = "wk AS (SELECT l_linenumber AS dim, 'discount' AS other, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b FROM lineitem UNION ALL SELECT l_linenumber, 'tax', CAST(l_quantity AS DOUBLE), CAST(l_tax AS DOUBLE) FROM lineitem)"


@query(f"""WITH {_WEAK}, rk AS (SELECT dim, other, a, b, rank() OVER (PARTITION BY dim, other ORDER BY a) + (count(*) OVER (PARTITION BY dim, other, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dim, other ORDER BY b) + (count(*) OVER (PARTITION BY dim, other, b) - 1) / 2.0 AS rb FROM wk),
g AS (SELECT dim, other, count(*) AS n, corr(ra, rb) AS rho, corr(a, b) AS r FROM rk GROUP BY dim, other)
SELECT dim, other, n, round(rho, 6) AS rho, round({_p_sql('rho')}, 6) AS rho_p, round(r, 6) AS r, round({_p_sql('r')}, 6) AS r_p FROM g""")
def spearman_p(read):
    """Correlations with p-values of columns that hardly depend on each other."""
    d = read("lineitem").select(F.col("l_linenumber").alias("dim"), F.col("l_quantity").cast("double").alias("a"), *[F.col(f"l_{c}").cast("double").alias(c) for c in ("discount", "tax")])
    each = d.select("dim", "a", F.inline(F.array(*[F.struct(F.lit(c).alias("other"), F.col(c).alias("b")) for c in ("discount", "tax")])))
    return rounded(S.correlation_tests(each, "a", "b", ["dim", "other"]))


@query(f"WITH {RATERS} SELECT dim, round(corr(a, b), 6) AS r FROM ra GROUP BY dim")
def pearson(read):
    return rounded(raters(read).groupBy("dim").agg(matrix.pearson("a", "b").alias("r")))


_KAPPA = "ka AS (SELECT h.dim, 1 - o.seen / (sum(h.n * g.n * (h.x - g.x) * (h.x - g.x)) / CAST(o.n AS DOUBLE)) AS kappa FROM (SELECT dim, a AS x, count(*) AS n FROM ra GROUP BY dim, a) h JOIN (SELECT dim, b AS x, count(*) AS n FROM ra GROUP BY dim, b) g ON h.dim = g.dim JOIN (SELECT dim, count(*) AS n, sum((a - b) * (a - b)) AS seen FROM ra GROUP BY dim) o ON o.dim = h.dim GROUP BY h.dim, o.seen, o.n)"


@query(f"WITH {RATERS}, {_RANKED}, {_KAPPA}, rh AS (SELECT dim, corr(ra, rb) AS rho FROM rk GROUP BY dim), g AS (SELECT dim, {_AGREE} FROM ra GROUP BY dim) SELECT g.*, round(rho, 6) AS rho, round(kappa, 6) AS kappa FROM g JOIN rh USING (dim) JOIN ka USING (dim)")
def inter_rater(read):
    return rounded(S.inter_rater(raters(read), "a", "b", ["dim"]))


@query(f"WITH {RATERS} SELECT {_AGREE} FROM ra")
def inter_rater_overall(read):
    return rounded(raters(read).agg(*S.rater_columns("a", "b")))


@query(f"WITH {RATERS}, g AS (SELECT dim, corr(a, b) AS r, avg(b - a) AS bias FROM ra GROUP BY dim) SELECT CASE WHEN r >= 0.7 THEN 'strong' WHEN r >= 0.5 THEN 'moderate' ELSE 'weak' END AS band, CASE WHEN bias > 0.5 THEN 'higher' WHEN bias < -0.5 THEN 'lower' ELSE 'even' END AS bias_band, count(*) AS n FROM g GROUP BY 1, 2")
def agreement_bands(read):
    g = raters(read).groupBy("dim").agg(matrix.pearson("a", "b").alias("r"), F.avg(F.col("b") - F.col("a")).alias("bias"))
    return g.groupBy(S.band(F.col("r")).alias("band"), S.bias_band(F.col("bias")).alias("bias_band")).agg(F.count("*").alias("n"))


@query(f"WITH {RATERS}, d AS (SELECT l_orderkey, count(*) FILTER (WHERE abs(a - b) >= 4) AS swings, max(abs(a - b)) AS greatest, round(avg(b - a), 6) AS mean_diff, round(stddev_pop(b - a), 6) AS std_diff FROM ra GROUP BY l_orderkey) SELECT * FROM d WHERE swings >= 3 ORDER BY swings DESC, l_orderkey LIMIT 10")
def version_diff(read):
    """The ten orders on which the raters disagree most often: a report of ten rows."""
    d = F.col("b") - F.col("a")
    g = raters(read).groupBy("l_orderkey").agg(F.sum((F.abs(d) >= 4).cast("long")).alias("swings"), F.max(F.abs(d)).alias("greatest"), F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("std_diff"))
    return rounded(g.where("swings >= 3").orderBy(F.desc("swings"), "l_orderkey").limit(10))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(1, least(10, round_even(l_quantity / 4.0, 0))) AS INT) AS score FROM lineitem")
def clamp_score(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", V.clamp_score(F.col("l_quantity") / 4.0).alias("score"))


@query("""SELECT event_id, CASE WHEN event_type IS NOT NULL AND event_id % 7 <> 0 THEN CAST(greatest(1, least(10, round_even(value, 0))) AS INT) END AS mood, CASE WHEN event_id % 7 <> 0 THEN CAST(greatest(1, least(10, user_id % 12)) AS INT) END AS pace FROM events""")
def validate_scores(read):
    payload = F.when(F.col("event_id") % 7 == 0, F.format_string('{"mood": {"score": "none"}, "pace": %d}', F.col("user_id") % 12)).otherwise(F.format_string('{"mood": {"score": %s, "evidence": "x"}, "pace": %d}', F.col("value").cast("string"), F.col("user_id") % 12))
    got = read("events").select("event_id", scoring.validate_scores(payload, ["mood", "pace"]).alias("m"))
    return got.select("event_id", F.try_element_at("m", F.lit("mood")).alias("mood"), F.try_element_at("m", F.lit("pace")).alias("pace"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(read):
    return read("events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT user_id AS run_id, CAST(arg_max(json_extract_string(props, '$.k'), event_id) AS BIGINT) AS generation_seed, CAST(NULL AS VARCHAR) AS git_sha, count(*) AS n FROM events GROUP BY user_id")
def run_provenance(read):
    e = read("events").groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("props", "event_id").alias("p"), F.count("*").alias("n"))
    return e.select("run_id", F.get_json_object("p", "$.k").try_cast("long").alias("generation_seed"), F.get_json_object("p", "$.git_sha").alias("git_sha"), "n")


@query("SELECT l_orderkey, l_linenumber, [CAST(l_quantity AS DOUBLE), CAST(l_tax AS DOUBLE), CAST(l_discount AS DOUBLE)] AS v FROM lineitem")
def map_to_vector(read):
    m = F.create_map(F.lit("tax"), F.col("l_tax").cast("double"), F.lit("quantity"), F.col("l_quantity").cast("double"), F.lit("discount"), F.col("l_discount").cast("double"))
    return read("lineitem").select("l_orderkey", "l_linenumber", V.from_map(m, ["quantity", "tax", "discount"]).alias("v"))


# ---- rewrites: a vector (source), the next (candidate) and the one after (target) ----

_TRI = "tri AS (SELECT vec_id, a, b, c FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, lead(CAST(embedding AS DOUBLE[])) OVER (ORDER BY vec_id) AS b, lead(CAST(embedding AS DOUBLE[]), 2) OVER (ORDER BY vec_id) AS c FROM embeddings) WHERE c IS NOT NULL)"


def _rms(x: str, y: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({x}, {y}), lambda z: ((z[1] - z[2]) / 0.25) * ((z[1] - z[2]) / 0.25))) / len({x}))"


def _tri(read):
    w = Window.orderBy("vec_id")
    v = read("embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("a"))
    return v.select("vec_id", "a", F.lead("a").over(w).alias("b"), F.lead("a", 2).over(w).alias("c")).where("c is not null")


@query(f"WITH {_TRI}, d AS (SELECT vec_id, {_rms('a', 'b')} AS ab, {_rms('b', 'c')} AS bc, {_rms('a', 'c')} AS ac FROM tri) SELECT vec_id, round(ab, 6) AS source_distance, round(bc, 6) AS target_distance, round(ac, 6) AS start_distance, round(ac - bc, 6) AS improvement, round((ac - bc) / ac, 6) AS improvement_ratio, ab <= 0.75 AS source_pass, bc <= 0.75 AS target_pass FROM d")
def rewrite_score(read):
    s = scoring.rewrite_score(F.col("a"), F.col("b"), F.col("c"), F.transform("a", lambda _: F.lit(0.25)))
    return rounded(_tri(read).select("vec_id", *[c.alias(k) for k, c in s.items()]))


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), o AS (SELECT vec_id, a, coalesce(lead(a) OVER (ORDER BY vec_id), first_value(a) OVER (ORDER BY vec_id)) AS b,
  coalesce(lead(a) OVER (ORDER BY md5('42|' || vec_id), vec_id), first_value(a) OVER (ORDER BY md5('42|' || vec_id), vec_id)) AS c FROM e), d AS (SELECT vec_id, {_rms('a', 'a')} AS same, {_rms('a', 'b')} AS next_, {_rms('a', 'c')} AS far FROM o)
SELECT control, count(*) AS n, round(avg(x), 6) AS mean_distance, round(avg(CASE WHEN x <= 0.75 THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM (SELECT 'identity' AS control, same AS x FROM d UNION ALL SELECT 'copy_source', next_ FROM d UNION ALL SELECT 'random_target', far FROM d) GROUP BY control""")
def control_diagnostics(read):
    """Each vector against itself, against the next one (after the last the first), and against its partner in a derangement of all."""
    v = read("embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("a"))
    ends = v.agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).first()
    wide = max(1, ((ends.high or 0) - (ends.low or 0)) // 256 + 1)
    key = F.md5(F.concat(F.lit("42|"), F.col("vec_id").cast("string")))
    places = selection.following(v, "vec_id", F.col("vec_id"), F.floor((F.col("vec_id") - (ends.low or 0)) / wide), "b").join(selection.following(v, "vec_id", key, selection.hash_bucket(key), "c"), "vec_id")
    three = v.join(places, "vec_id")
    for c in "bc":
        three = three.join(v.select(F.col("vec_id").alias(c), F.col("a").alias(f"v_{c}")), c)
    scale = F.transform("a", lambda _: F.lit(0.25))
    rows = [F.struct(F.lit(n).alias("control"), V.rms_distance(F.col("a"), F.col(c), scale).alias("x")) for n, c in (("identity", "a"), ("copy_source", "v_b"), ("random_target", "v_c"))]
    each = three.select(F.inline(F.array(*rows)))
    return rounded(each.groupBy("control").agg(F.count("*").alias("n"), F.avg("x").alias("mean_distance"), F.avg((F.col("x") <= 0.75).cast("double")).alias("pass_rate")))


_OBJ = "ob AS (SELECT l_orderkey, l_linenumber, l_tax * 10 AS semantic, l_discount * 10 AS target, l_quantity / 25.0 AS ratio, (l_linenumber % 4) / 10.0 AS jac, (l_linenumber % 3) / 10.0 AS edit FROM lineitem)"


@query(f"""WITH {_OBJ}, c AS (SELECT *, greatest(0.0, least(1.0, 1 - semantic / 0.75)) AS semantic_component, greatest(0.0, least(1.0, 1 - target / 0.75)) AS target_component,
  CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN 1.0 WHEN ratio < 0.8 THEN greatest(0.0, least(1.0, ratio / 0.8)) ELSE greatest(0.0, least(1.0, 1.2 / ratio)) END AS length_component,
  CASE WHEN jac >= 0.1 AND edit >= 0.1 THEN greatest(0.0, least(1.0, 1 - edit)) ELSE 0.0 END AS lexical_component, ratio BETWEEN 0.8 AND 1.2 AS length_pass, jac >= 0.1 AND edit >= 0.1 AS overlap_pass FROM ob)
SELECT l_orderkey, l_linenumber, round(CAST(semantic_component AS DOUBLE), 6) AS semantic_component, round(CAST(target_component AS DOUBLE), 6) AS target_component, round(CAST(length_component AS DOUBLE), 6) AS length_component, round(CAST(lexical_component AS DOUBLE), 6) AS lexical_component, length_pass, overlap_pass,
  round(CAST(0.45 * semantic_component + 0.35 * target_component + 0.1 * length_component + 0.1 * lexical_component AS DOUBLE), 6) AS weighted_objective FROM c""")
def weighted_objective(read):
    d = lambda c: F.col(c).cast("double")
    o = scoring.weighted_objective(d("l_tax") * 10, d("l_discount") * 10, d("l_quantity") / 25.0, (F.col("l_linenumber") % 4) / 10.0, (F.col("l_linenumber") % 3) / 10.0)
    return rounded(read("lineitem").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in o.items()]))


@query("""WITH c AS (SELECT conv_id, turn, round(length(text) % 97 / 97.0, 9) AS v FROM conversations), b AS (SELECT *, max(v) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c),
f AS (SELECT *, best IS NOT NULL AND NOT (v > best + 1e-9) AS fails FROM b), s AS (SELECT *, coalesce(max(CASE WHEN fails THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM f)
SELECT conv_id, max(turn) FILTER (WHERE NOT fails) AS best_turn, round(max(v) FILTER (WHERE NOT fails), 6) AS best_value, count(*) AS n_used, CASE WHEN max(CASE WHEN fails THEN 1 ELSE 0 END) = 1 THEN 'no_objective_improvement' ELSE 'max_iterations_reached' END AS stop_reason FROM s WHERE stopped = 0 GROUP BY conv_id""")
def best_iteration(read):
    c = read("conversations").select("conv_id", "turn", F.round(F.length("text") % 97 / 97.0, 9).alias("v"))
    return rounded(scoring.best_iteration(c, "conv_id", "turn", "v"))


@query("SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN round(least(10.0, greatest(0.0, length(text) / 1000.0 + (1 - length(text) / 1000.0) * (0.1 + turn * 0.05))), 6) END AS measured FROM conversations")
def heuristic_measure(read):
    """A stand-in for a measurement: the source's value moved towards the target's by the divergence and a tenth."""
    x = F.length("text") / 1000.0
    return read("conversations").select("conv_id", "turn", r6(F.least(F.lit(10.0), F.greatest(F.lit(0.0), x + (1 - x) * (0.1 + F.col("turn") * 0.05)))).alias("measured"))


@query("""WITH d AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])[1:8]) AS src, unnest(CAST(embedding AS DOUBLE[])[9:16]) AS tgt, 'd' || unnest(generate_series(0, 7)) AS dim FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(tgt - src), 9) DESC, dim DESC) AS rank FROM d) SELECT vec_id, rank, dim, dim || ': ' || format('{:.3f}', src) || ' -> ' || format('{:.3f}', tgt) AS line FROM k WHERE rank <= 5""")
def style_deltas(read):
    v = V.doubles(F.col("embedding"))
    rows = [F.struct(F.lit(f"d{i}").alias("dim"), F.get(v, F.lit(i)).alias("src"), F.get(v, F.lit(i + 8)).alias("tgt")) for i in range(8)]
    long = read("embeddings").select("vec_id", F.inline(F.array(*rows)))
    return scoring.style_deltas(long, ["vec_id"], "src", "tgt").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT conv_id, turn, 'Rewrite in the voice of ' || role AS instruction, text AS input, length(text) AS n_chars, CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM conversations WHERE role <> 'system'")
def training_examples(read):
    split = F.when(F.col("conv_id") % 10 < 8, "train").when(F.col("conv_id") % 10 == 8, "validation").otherwise("test")
    c = read("conversations").where("role <> 'system'")
    return c.select("conv_id", "turn", F.concat(F.lit("Rewrite in the voice of "), F.col("role")).alias("instruction"), F.col("text").alias("input"), F.length("text").cast("long").alias("n_chars"), split.alias("split"))


@query("SELECT split, conv_id, turn FROM (SELECT conv_id, turn, CASE WHEN conv_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, row_number() OVER (PARTITION BY CASE WHEN conv_id % 10 < 8 THEN 'train' ELSE 'test' END ORDER BY conv_id, turn) AS n FROM conversations) WHERE n <= 20")
def bounded_subset(read):
    """The first rows of each split: a bounded subset is what is asked for."""
    c = read("conversations").withColumn("split", F.when(F.col("conv_id") % 10 < 8, "train").otherwise("test"))
    first = [c.where(F.col("split") == s).orderBy("conv_id", "turn").limit(20) for s in ("train", "test")]
    return first[0].union(first[1]).select("split", "conv_id", "turn")


@query("WITH c AS (SELECT conv_id, turn, text, length(text) % 100 / 100.0 AS objective, turn % 3 > 0 AS ok FROM conversations) SELECT conv_id, turn, round(objective, 6) AS objective FROM c WHERE trim(text) <> '' AND objective >= 0.5 AND ok")
def distill_filter(read):
    c = read("conversations").withColumn("objective", F.length("text") % 100 / 100.0)
    return rounded(c.where((F.trim("text") != "") & (F.col("objective") >= 0.5) & (F.col("turn") % 3 > 0)).select("conv_id", "turn", "objective"))


@query("WITH c AS (SELECT md5(text) AS k, conv_id, turn, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS n FROM conversations) SELECT k, conv_id, turn FROM c WHERE n = 1")
def distill_examples(read):
    """The first of equal texts over ordered inputs."""
    return read("conversations").groupBy(F.md5("text").alias("k")).agg(F.min(F.struct("conv_id", "turn")).alias("f")).select("k", "f.conv_id", "f.turn")


@query("SELECT sha256('{\"role\":\"' || role || '\",\"turn\":' || turn || '}') AS h, conv_id, turn FROM conversations")
def config_hash(read):
    return read("conversations").select(F.sha2(F.to_json(F.struct("role", "turn")), 256).alias("h"), "conv_id", "turn")


@query(r"SELECT role, count(*) AS n_examples, count(*) FILTER (WHERE trim(text) = '') AS n_empty, count(*) FILTER (WHERE contains(text, '###') OR contains(text, '- ')) AS n_forbidden, round(avg(len(regexp_extract_all(text, '\S+'))), 6) AS mean_words FROM conversations GROUP BY role")
def probe_summary(read):
    from ..functions import text as X

    flag = lambda c: F.sum(c.cast("long"))
    t = F.col("text")
    return rounded(read("conversations").groupBy("role").agg(F.count("*").alias("n_examples"), flag(F.trim("text") == "").alias("n_empty"), flag(t.contains("###") | t.contains("- ")).alias("n_forbidden"), F.avg(F.size(X.chunks(t))).alias("mean_words")))


@query()
def bootstrap_ci(read):
    return rounded(S.bootstrap_mean(read("events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("v")), "event_type", "v"))
