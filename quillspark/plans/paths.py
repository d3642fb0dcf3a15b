"""Queries over embeddings: vector functions and ordered paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import matrix, pairs, trajectory
from .registry import query, r6, rounded

E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
#: Two orders of all vectors: by id, and by a hash.
PATHS = f"{E}, p AS (SELECT 'linear' AS path, vec_id, label, v, row_number() OVER (ORDER BY vec_id) AS pos FROM e UNION ALL SELECT 'hopscotch', vec_id, label, v, row_number() OVER (ORDER BY md5('hop|' || vec_id), vec_id) FROM e)"
STEPS = f"{PATHS}, n AS (SELECT *, lead(v) OVER (PARTITION BY path ORDER BY pos) AS w, lead(v, 2) OVER (PARTITION BY path ORDER BY pos) AS x FROM p), s AS (SELECT path, pos, vec_id, label, list_inner_product(v, w) AS similarity, list_distance(v, w) AS distance FROM n WHERE w IS NOT NULL)"
N_PERM = 5000
#: Places of a vector.
SIZE = 64
PERMS = f"{E}, o AS (SELECT perm, vec_id, row_number() OVER (PARTITION BY perm ORDER BY md5('42|' || perm || '|' || vec_id), vec_id) AS pos FROM e, (SELECT unnest(generate_series(1, {N_PERM})) AS perm)), q AS (SELECT perm, pos, v, lead(v) OVER (PARTITION BY perm ORDER BY pos) AS w, lead(v, 2) OVER (PARTITION BY perm ORDER BY pos) AS x FROM o JOIN e USING (vec_id))"


def _sub(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


ANGLE = f"CASE WHEN x IS NOT NULL AND list_distance(w, v) >= 1e-10 AND list_distance(x, w) >= 1e-10 THEN acos(greatest(-1.0, least(1.0, list_inner_product({_sub('w', 'v')}, {_sub('x', 'w')}) / (list_distance(w, v) * list_distance(x, w))))) END"
NULL = f"{PERMS}, null_ AS (SELECT perm, avg(list_inner_product(v, w)) AS mean_similarity, avg(list_distance(v, w)) AS mean_distance, avg({ANGLE}) AS mean_curvature FROM q GROUP BY perm)"


def vectors(read):
    return read("embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def paths(read, v=None):
    v = vectors(read) if v is None else v
    by_id = v.withColumn("path", F.lit("linear")).withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("vec_id")))
    hop = F.md5(F.concat(F.lit("hop|"), F.col("vec_id").cast("string")))
    by_hash = v.withColumn("path", F.lit("hopscotch")).withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy(hop, "vec_id")))
    return by_id.unionByName(by_hash)


@query(f"WITH {STEPS} SELECT path, CAST(pos AS BIGINT) AS pos, round(similarity, 6) AS similarity FROM s")
def consecutive_similarity(read):
    return rounded(trajectory.steps(paths(read)).select("path", F.col("pos").cast("long").alias("pos"), "similarity"))


@query(f"WITH {STEPS} SELECT path, count(*) AS n_steps, round(avg(distance), 6) AS mean_distance FROM s GROUP BY path")
def path_smoothness(read):
    return rounded(trajectory.smoothness(paths(read)).select("path", "n_steps", "mean_distance"))


@query(f"WITH {STEPS} SELECT path, count(*) AS n_steps, round(avg(similarity), 6) AS mean_similarity FROM s GROUP BY path")
def path_smoothness_cos(read):
    return rounded(trajectory.smoothness(paths(read)).select("path", "n_steps", "mean_similarity"))


@query(f"WITH {STEPS} SELECT path, round(avg({ANGLE}), 6) AS mean_curvature FROM n GROUP BY path")
def path_curvature(read):
    return rounded(trajectory.curvature(paths(read)))


@query(f"""WITH {STEPS}, l AS (SELECT path, distance AS x, {', '.join(f'lead(distance, {k}) OVER (PARTITION BY path ORDER BY pos) AS y{k}' for k in range(1, 6))} FROM s)
{' UNION ALL '.join(f"SELECT path, CAST({k} AS BIGINT) AS lag, round(corr(x, y{k}) FILTER (WHERE y{k} IS NOT NULL), 6) AS r FROM l GROUP BY path" for k in range(1, 6))}""")
def path_autocorr(read):
    return rounded(trajectory.autocorrelation(paths(read), 5).select("path", F.col("lag").cast("long").alias("lag"), "r"))


@query(f"WITH {STEPS}, k AS (SELECT path, pos, distance, row_number() OVER (PARTITION BY path ORDER BY round(distance, 9) DESC, pos) AS rank FROM s) SELECT path, rank, CAST(pos AS BIGINT) AS pos, round(distance, 6) AS distance FROM k WHERE rank <= 5")
def roughest_steps(read):
    s = trajectory.steps(paths(read))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.round("distance", 9)), "pos"))
    return rounded(s.select("path", rank.cast("long").alias("rank"), F.col("pos").cast("long").alias("pos"), "distance").where("rank <= 5"))


@query(f"WITH {STEPS} SELECT path, CAST(pos AS BIGINT) AS pos, round(1 - similarity, 6) AS cosine_distance, round(distance, 6) AS distance, CAST(least(24, floor(distance / 2.0 * 25)) AS BIGINT) AS bin FROM s")
def step_distances(read):
    s = trajectory.steps(paths(read))
    bin_ = F.least(F.lit(24), F.floor(F.col("distance") / 2.0 * 25)).cast("long")
    return rounded(s.select("path", F.col("pos").cast("long").alias("pos"), (1 - F.col("similarity")).alias("cosine_distance"), "distance", bin_.alias("bin")))


DRIFT = f"""{E}, g AS (SELECT label, vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e),
t AS (SELECT label, vec_id, round(list_inner_product(v, w), 15) AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM g WHERE w IS NOT NULL),
m AS (SELECT label, avg(s) AS mean, max(1 - s) AS jump, arg_min(i, (s, i)) AS place FROM t GROUP BY label),
z AS (SELECT label, count(*) AS n, arg_min(v, vec_id) AS a, arg_max(v, vec_id) AS b FROM e GROUP BY label),
drift AS (SELECT label, n AS n_windows, CASE WHEN n < 2 THEN 0 ELSE 1 - mean END AS mean_drift, CASE WHEN n < 2 THEN 0 ELSE jump END AS max_jump, CASE WHEN n < 2 THEN 0 ELSE place / CAST(n - 1 AS DOUBLE) END AS jump_position, CASE WHEN n < 2 THEN 1 ELSE list_inner_product(a, b) END AS span FROM z LEFT JOIN m USING (label))"""


def _drift(read):
    return trajectory.drift(vectors(read).select(F.col("label").alias("path"), F.col("vec_id").alias("pos"), "v")).withColumnRenamed("path", "label")


@query(f"WITH {DRIFT} SELECT label, n_windows, round(mean_drift, 6) AS mean_drift, round(max_jump, 6) AS max_jump, round(jump_position, 6) AS jump_position, round(span, 6) AS span FROM drift")
def drift(read):
    return rounded(_drift(read))


@query(f"WITH {DRIFT} SELECT label, rank() OVER (ORDER BY round(mean_drift, 9) DESC) AS rank, round(rank() OVER (ORDER BY round(mean_drift, 9) DESC) * 100.0 / count(*) OVER (), 6) AS pct, round(mean_drift - median(mean_drift) OVER (), 6) AS over_median FROM drift")
def drift_rank(read):
    d = _drift(read)
    mid = d.agg(F.median("mean_drift").alias("mid"), F.count("*").alias("n"))
    rank = F.rank().over(Window.orderBy(F.desc(F.round("mean_drift", 9))))  # one row a path
    return rounded(d.crossJoin(F.broadcast(mid)).select("label", rank.cast("long").alias("rank"), (rank * 100.0 / F.col("n")).alias("pct"), (F.col("mean_drift") - F.col("mid")).alias("over_median")))


def _null(read, *only):
    return trajectory.permutation_null(read("embeddings"), "vec_id", "embedding", N_PERM, only=only or trajectory.MEANS)


def _observed(read, *values):
    """Means of the two paths; vectors are sorted as they are stored, and curvature is worked out if asked for."""
    raw = read("embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    p = paths(read, raw).withColumn("v", V.doubles(F.col("v")))
    seen = trajectory.smoothness(p)
    return seen.join(trajectory.curvature(p), "path") if "mean_curvature" in values else seen


@query(f"WITH {NULL} SELECT CAST(perm AS BIGINT) AS perm, round(mean_similarity, 6) AS mean_similarity, round(mean_distance, 6) AS mean_distance, round(mean_curvature, 6) AS mean_curvature FROM null_")
def permutation_null(read):
    return rounded(_null(read).withColumn("perm", F.col("perm").cast("long")))


def _test_sql(value: str, expr: str, sign: int) -> str:
    worse = f"{value} < observed" if sign > 0 else f"{value} > observed"
    return f"""WITH {NULL}, {PATHS[len(E) + 2 :]}, nn AS (SELECT *, lead(v) OVER (PARTITION BY path ORDER BY pos) AS w, lead(v, 2) OVER (PARTITION BY path ORDER BY pos) AS x FROM p),
obs AS (SELECT path, avg({expr}) AS observed FROM nn WHERE w IS NOT NULL GROUP BY path),
t AS (SELECT path, observed, avg({value}) AS null_mean, stddev_pop({value}) AS null_std, count(*) FILTER (WHERE {worse}) AS extreme, count(*) FILTER (WHERE {value} < observed) AS below, count(*) AS n FROM obs, null_ GROUP BY path, observed)"""


_COS, _DIST, _CURVE = _test_sql("mean_similarity", "list_inner_product(v, w)", 1), _test_sql("mean_distance", "list_distance(v, w)", -1), _test_sql("mean_curvature", ANGLE, -1)
_ALL = "round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_std, 6) AS null_std, round(CASE WHEN null_std > 0 THEN {sign} * (observed - null_mean) / null_std ELSE 0 END, 4) AS z, round((extreme + 1) * 100.0 / (n + 1), 6) AS percentile, round(below * 100.0 / n, 6) AS percentile_raw"


def _test(read, value: str, sign: int):
    return trajectory.against_null(_observed(read, value), _null(read, value), value, sign)


@query(f"{_COS} SELECT path, {_ALL.format(sign=1)} FROM t")
def trajectory_test(read):
    return rounded(_test(read, "mean_similarity", 1).withColumn("z", F.round("z", 4)))


@query(f"{_CURVE} SELECT path, {_ALL.format(sign=-1)} FROM t")
def curvature_test(read):
    return rounded(_test(read, "mean_curvature", -1).withColumn("z", F.round("z", 4)))


@query(f"{_DIST} SELECT path, round(CASE WHEN null_std > 0 THEN -(observed - null_mean) / null_std ELSE 0 END, 4) AS z FROM t")
def z_score(read):
    return _test(read, "mean_distance", -1).select("path", F.round("z", 4).alias("z"))


@query(f"{_DIST} SELECT path, round((extreme + 1) * 100.0 / (n + 1), 6) AS percentile FROM t")
def percentile_cc(read):
    return rounded(_test(read, "mean_distance", -1).select("path", "percentile"))


@query(f"{_DIST} SELECT path, round(below * 100.0 / n, 6) AS percentile_raw FROM t")
def percentile_raw(read):
    return rounded(_test(read, "mean_distance", -1).select("path", "percentile_raw"))


@query(f"""WITH c AS ({_COS} SELECT path, CASE WHEN null_std > 0 THEN (observed - null_mean) / null_std ELSE 0 END AS z1 FROM t), d AS ({_DIST} SELECT path, CASE WHEN null_std > 0 THEN -(observed - null_mean) / null_std ELSE 0 END AS z2 FROM t)
SELECT path, CASE WHEN sign(z1) = sign(z2) AND abs(z1) > 2 AND abs(z2) > 2 THEN 'strong agreement' WHEN sign(z1) = sign(z2) THEN 'same direction' ELSE 'disagreement' END AS verdict FROM c JOIN d USING (path)""")
def agreement_verdict(read):
    signs = {"mean_similarity": 1, "mean_distance": -1}
    z = trajectory.z_scores(_observed(read, *signs), _null(read, *signs), signs)
    return z.select("path", trajectory.verdict(*map(F.col, signs)).alias("verdict"))


@query(f"WITH {PATHS}, l AS (SELECT path, label, lag(label) OVER (PARTITION BY path ORDER BY pos) AS before FROM p) SELECT path, before AS from_label, label AS to_label, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY path, before, label")
def section_weaving(read):
    before = F.lag("label").over(trajectory.order_of())
    return paths(read).select("path", before.alias("from_label"), F.col("label").alias("to_label")).where("from_label is not null").groupBy("path", "from_label", "to_label").agg(F.count("*").alias("n"))


@query(f"WITH {PATHS} SELECT path, CAST(pos AS BIGINT) AS pos, round(v[1], 6) AS value, round(avg(v[1]) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth, pos % 10 = 0 AS marked FROM p")
def path_series(read):
    p = paths(read).withColumn("value", F.get("v", F.lit(0)))
    return rounded(p.select("path", F.col("pos").cast("long").alias("pos"), "value", trajectory.moving_average(p, "value", 2).alias("smooth"), (F.col("pos") % 10 == 0).alias("marked")))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM events")
def moving_avg(read):
    e = read("events")
    return rounded(e.select("user_id", "event_id", trajectory.moving_average(e, "value", 1, "user_id", "event_id").alias("smooth")))


@query(f"WITH {PATHS} SELECT path, CAST(pos AS BIGINT) AS pos, vec_id, CASE WHEN k IS NOT NULL THEN round(v[1], 6) END AS x, CASE WHEN k IS NOT NULL THEN round(v[2], 6) END AS y FROM p LEFT JOIN (SELECT vec_id AS k FROM e WHERE label < 5) h ON vec_id = k")
def path_coords(read):
    """Every point of the paths; one without coordinates breaks its path."""
    p = paths(read)
    some = vectors(read).where("label < 5").select(F.col("vec_id").alias("k"))
    j = p.join(some, p["vec_id"] == some["k"], "left")
    at = lambda i: F.when(F.col("k").isNotNull(), F.get("v", F.lit(i)))
    return rounded(j.select("path", F.col("pos").cast("long").alias("pos"), "vec_id", at(0).alias("x"), at(1).alias("y")))


@query(f"WITH {PATHS} SELECT path, CAST(pos AS BIGINT) AS pos, {', '.join(f'round(v[{i + 1}], 6) AS d{i}' for i in range(SIZE))} FROM p")
def path_matrix(read):
    return rounded(paths(read).select("path", F.col("pos").cast("long").alias("pos"), *[F.get("v", F.lit(i)).alias(f"d{i}") for i in range(SIZE)]))


@query(f"WITH {PATHS}, d AS (SELECT path, label, list(pos ORDER BY pos) AS places FROM p GROUP BY path, label) SELECT path, label, CAST(len(places) AS BIGINT) AS n, array_to_string(places[1:5], ',') AS first_places FROM d WHERE len(places) > 1")
def path_duplicates(read):
    d = paths(read).groupBy("path", "label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("at")).where("n > 1")
    return d.select("path", "label", "n", F.array_join(F.transform(F.slice("at", 1, 5), lambda x: x.cast("string")), ",").alias("first_places"))


# ---- vectors ----

_NEXT = f"{E}, nx AS (SELECT vec_id, v, lead(v) OVER (ORDER BY vec_id) AS w FROM e)"


def _next(read):
    return vectors(read).withColumn("w", F.lead("v").over(Window.orderBy("vec_id"))).where("w is not null")


@query(f"WITH {_NEXT} SELECT vec_id, round(list_cosine_similarity(v, w), 6) AS cosine FROM nx WHERE w IS NOT NULL")
def cosine(read):
    return _next(read).select("vec_id", r6(V.cosine(F.col("v"), F.col("w"))).alias("cosine"))


@query(f"WITH {_NEXT} SELECT vec_id, round(list_distance(v, w), 6) AS distance FROM nx WHERE w IS NOT NULL")
def euclidean(read):
    return _next(read).select("vec_id", r6(V.euclidean(F.col("v"), F.col("w"))).alias("distance"))


@query(f"WITH {_NEXT} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(v, w), lambda z: ((z[1] - z[2]) / 0.125) * ((z[1] - z[2]) / 0.125))) / len(v)), 6) AS rms FROM nx WHERE w IS NOT NULL")
def rms_distance(read):
    scale = F.transform("v", lambda _: F.lit(0.125))
    return _next(read).select("vec_id", r6(V.rms_distance(F.col("v"), F.col("w"), scale)).alias("rms"))


@query(f"WITH {E} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, abs(sqrt(list_inner_product(v, v)) - 1) < 1e-5 AS unit FROM e")
def l2_norm(read):
    n = V.norm(F.col("v"))
    return vectors(read).select("vec_id", r6(n).alias("norm"), (F.abs(n - 1) < 1e-5).alias("unit"))


@query(f"""WITH {E}, u AS (SELECT vec_id, v AS a FROM e), s AS (SELECT {', '.join(f'avg(a[{i}]) AS m{i}, stddev_pop(a[{i}]) AS s{i}' for i in range(1, SIZE + 1))} FROM u)
SELECT vec_id, {', '.join(f'round((a[{i}] - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END, 6) AS d{i - 1}' for i in range(1, SIZE + 1))} FROM u, s""")
def z_standardize(read):
    wide = vectors(read).select("vec_id", *[F.get("v", F.lit(i)).alias(f"d{i}") for i in range(SIZE)])
    return rounded(matrix.z_standardize(wide, [f"d{i}" for i in range(SIZE)]))


@query(f"WITH {E} SELECT vec_id, {', '.join(f'round(v[{i + 1}], 6) AS d{i}' for i in range(SIZE) if i != 1)} FROM e")
def drop_dims(read):
    wide = vectors(read).select("vec_id", *[F.get("v", F.lit(i)).alias(f"d{i}") for i in range(SIZE)])
    return rounded(wide.drop("d1"))


@query(f"WITH {E} SELECT label, round(v[1], 6) AS a, round(v[2], 6) AS b, vec_id FROM e WHERE vec_id IN (1, 2, 3)")
def profile_rows(read):
    rows = vectors(read).where(F.col("vec_id").isin(1, 2, 3))
    return rounded(rows.select("label", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"), "vec_id"))


@query("SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n FROM (SELECT least(24, floor((value - lo) * 25 / (hi - lo))) AS bin FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)) GROUP BY bin")
def histogram(read):
    return matrix.histogram(read("events"), "value", 25).select(F.col("bin").cast("long").alias("bin"), "n")


# ---- pairs ----

PAIRS = f"{E}, pr AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label AS la, b.label AS lb, list_inner_product(a.v, b.v) AS s, list_distance(a.v[1:16], b.v[1:16]) AS da, list_distance(a.v[17:32], b.v[17:32]) AS db, list_distance(a.v[33:64], b.v[33:64]) AS dc FROM e a JOIN e b ON a.vec_id < b.vec_id)"


@query(f"WITH {PAIRS} SELECT count(*) AS n, round(min(s), 6) AS least, round(max(s), 6) AS greatest, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS std, round(max(s) - min(s), 6) AS width, {', '.join(f'round(quantile_cont(s, {p / 100}), 6) AS p{p}' for p in (1, 5, 10, 25, 50, 75, 90, 95, 99))} FROM pr")
def pair_similarity_stats(read):
    shares = (1, 5, 10, 25, 50, 75, 90, 95, 99)
    one = pairs.similarity_stats(read("embeddings"), "vec_id", "embedding", "label", [p / 100 for p in shares])
    each = {p: F.get("quantiles", F.lit(i)) for i, p in enumerate(shares)}
    return rounded(one.select("n", "least", "greatest", "mean", each[50].alias("median"), "std", (F.col("greatest") - F.col("least")).alias("width"), *[c.alias(f"p{p}") for p, c in each.items()]))


@query(f"WITH {PAIRS} SELECT CASE WHEN la = lb THEN 'within' ELSE 'between' END AS side, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM pr GROUP BY la = lb")
def group_cohesion(read):
    return rounded(pairs.cohesion(read("embeddings"), "vec_id", "embedding", "label"))


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, id_a, id_b) AS hi, row_number() OVER (ORDER BY round(s, 9), id_a, id_b) AS lo FROM pr) SELECT id_a, id_b, round(s, 6) AS s, 'most' AS side FROM r WHERE hi <= 5 UNION ALL SELECT id_a, id_b, round(s, 6), 'least' FROM r WHERE lo <= 5")
def extreme_pairs(read):
    return rounded(pairs.extremes(read("embeddings"), "vec_id", "embedding", "label", 5))


@query(f"WITH {PAIRS} SELECT round(max(s), 6) AS most, arg_max(id_a || '-' || id_b, s) AS most_pair, round(min(s), 6) AS least, arg_min(id_a || '-' || id_b, s) AS least_pair FROM pr WHERE id_a IN (1, 2, 3) AND id_b IN (1, 2, 3)")
def similarity_triangle(read):
    three = vectors(read).where(F.col("vec_id").isin(1, 2, 3))
    p = matrix.all_pairs(three, "vec_id", ["v"]).withColumn("s", V.dot(F.col("v_a"), F.col("v_b")))
    name = F.concat_ws("-", F.col("id_a").cast("string"), F.col("id_b").cast("string"))
    return rounded(p.agg(F.max("s").alias("most"), F.max_by(name, "s").alias("most_pair"), F.min("s").alias("least"), F.min_by(name, "s").alias("least_pair")))


_RANKS = ", ".join(f"rank() OVER (ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY round({c}, 9)) - 1) / 2.0 AS r{c}" for c in ("da", "db", "dc"))


@query(f"WITH {PAIRS}, rk AS (SELECT {_RANKS} FROM pr) SELECT 'da' AS scale_a, 'db' AS scale_b, round(corr(rda, rdb), 6) AS rho FROM rk UNION ALL SELECT 'da', 'dc', round(corr(rda, rdc), 6) FROM rk UNION ALL SELECT 'db', 'dc', round(corr(rdb, rdc), 6) FROM rk")
def mantel(read):
    return rounded(pairs.mantel(read("embeddings"), "vec_id", "embedding", {"da": (0, 16), "db": (16, 32), "dc": (32, 64)}))


@query(f"WITH {E}, k AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, neighbour) AS rank FROM k) SELECT id, neighbour, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5")
def knn(read):
    e = read("embeddings")
    return rounded(matrix.knn(e, "vec_id", "embedding", 5, e.where("vec_id % 100 = 0")).withColumn("rank", F.col("rank").cast("long")))


@query()
def pca(read):
    return rounded(matrix.pca(read("embeddings"), "vec_id", "embedding", 3))
