"""Operators on small tables with known answers, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.functions.lexicons import FAILURES
from quillspark.operators import audit, backends, dataset, matrix, runs, scoring, selection, stats, stylometrics, trajectory


def test_moving_type_token_ratio_equals_windows(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcdefghijk") for _ in range(n)) for n in (0, 1, 49, 50, 51, 120, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in stylometrics.features(df, only=["mattr", "hapax_ratio", "vocab_density"]).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        n = len(w)
        expected = len(set(w)) / max(n, 1) if n <= 50 else sum(len(set(w[s : s + 50])) / 50 for s in range(n - 49)) / (n - 49)
        assert got[i].mattr == pytest.approx(expected)
        assert got[i].hapax_ratio == pytest.approx(sum(w.count(x) == 1 for x in set(w)) / len(set(w)) if w else 0)


def test_syntax_features(spark):
    parse = spark.createDataFrame([(1, 0, 1, 2, "NOUN", "nsubj"), (1, 0, 2, 2, "VERB", "ROOT"), (1, 0, 3, 2, "VERB", "ccomp"), (1, 0, 4, 3, "NOUN", "obj"), (1, 1, 1, 1, "VERB", "ROOT")], "doc_id int, sent int, token int, head int, pos string, dep string")
    got = stylometrics.syntax_features(parse).first()
    assert got.parse_depth_mean == 2.0 and got.subordinate_ratio == pytest.approx(1 / 3)


def test_z_scores_and_percentiles(spark):
    null = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    up = trajectory.against_null(spark.createDataFrame([("p", 3.0)], "path string, v double"), null, "v", 1).first()
    down = trajectory.against_null(spark.createDataFrame([("p", 1.0)], "path string, v double"), null, "v", -1).first()
    assert up.z == pytest.approx(1.224745, abs=1e-6) == down.z
    mid = trajectory.against_null(spark.createDataFrame([("p", 1.5)], "path string, v double"), null, "v", -1).first()
    assert mid.percentile == 75.0
    flat = trajectory.against_null(spark.createDataFrame([("p", 1.0)], "path string, v double"), spark.createDataFrame([(1.0,)] * 3, "v double"), "v", 1).first()
    assert flat.z == 0.0


def test_standardized_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 2.0), (3, 5.0, 2.0)], "id int, a double, b double")
    got = matrix.z_standardize(df, ["a", "b"]).agg(F.avg("a"), F.max("b"), F.min("b"), F.stddev_pop("a")).first()
    assert tuple(got) == pytest.approx((0, 0, 0, 1))
    moved = matrix.z_standardize(df.withColumn("a", F.col("a") + 100), ["a"]).orderBy("id").collect()
    assert [r.a for r in moved] == pytest.approx([r.a for r in matrix.z_standardize(df, ["a"]).orderBy("id").collect()])


def test_path_of_a_square(spark):
    points = [("p", i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])] + [("q", 0, [1.0, 0.0])]
    df = spark.createDataFrame(points, "path string, pos int, v array<double>")
    assert trajectory.smoothness(df).first().mean_distance == 1.0
    bend = {r.path: r.mean_curvature for r in trajectory.curvature(df).collect()}
    assert bend["p"] == pytest.approx(1.5707963) and bend["q"] == 0.0
    assert {r.path: r.max_jump for r in trajectory.drift(df).collect()}["q"] == 0.0


def test_permutations_are_repeatable_and_whole(spark):
    items = spark.range(20).withColumnRenamed("id", "x")
    got = trajectory.shuffled(items, "x", 3).groupBy("perm").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("pos").alias("n")).collect()
    assert all(r.ids == list(range(20)) and r.n == 20 for r in got) and len(got) == 3


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (4, 4), (5, 5)], "a int, b int")
    assert stats.spearman(df, "a", "b").first().rho == pytest.approx(0.974679, abs=1e-6)
    same = df.select(F.lit("d").alias("dim"), "a", F.col("a").alias("b"))
    assert stats.weighted_kappa(same, "a", "b", ["dim"]).first().kappa == 1.0
    constant = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert stats.spearman(constant, "a", "b").first().rho is None


def test_kappa_equals_its_definition(spark):
    rng = random.Random(1)
    rows = [("d", rng.randint(1, 10), rng.randint(1, 10)) for _ in range(200)]
    seen = sum((a - b) ** 2 for _, a, b in rows)
    expected = sum((a - b) ** 2 for _, a, _ in rows for _, _, b in rows) / len(rows)
    assert stats.weighted_kappa(spark.createDataFrame(rows, "dim string, a int, b int"), "a", "b", ["dim"]).first().kappa == pytest.approx(1 - seen / expected)


def test_constant_deltas_have_a_point_interval(spark):
    df = spark.createDataFrame([("k", 0.1), ("k", 0.1)], "k string, v double")
    got = stats.bootstrap_mean(df, "k", "v", 50).first()
    assert (got.low, got.high) == pytest.approx((0.1, 0.1))


def test_split_sizes():
    shares = {"train": 0.7, "validation": 0.15, "test": 1 - 0.7 - 0.15}
    expected = {1: (1, 0, 0), 2: (2, 0, 0), 3: (1, 1, 1), 6: (4, 1, 1), 10: (7, 1, 2), 20: (14, 3, 3), 100: (70, 15, 15)}
    for n, sizes in expected.items():
        assert tuple(dataset.split_sizes(n, shares)[k] for k in shares) == sizes, n


def test_hash_split_has_exact_sizes_and_order(spark):
    segs = spark.createDataFrame([("alpha:1",), ("alpha:2",), ("beta:1",), ("beta:2",)], "id string")
    got = {r.id: r.split for r in dataset.hash_split(segs, "id", {"a": 0.25, "b": 0.25, "c": 0.5}).collect()}
    assert got == {"beta:1": "a", "alpha:2": "b", "alpha:1": "c", "beta:2": "c"}


def test_bucket_split_values(spark):
    df = spark.createDataFrame([("case-1",), ("case-2",), ("case-3",)], "k string")
    got = df.select(dataset.bucket_split(F.col("k"), 0.8, 0.1, "20260501").alias("s")).collect()
    assert [r.s for r in got] == ["train", "test", "train"]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.sample(range(60), 20) for _ in range(12)]
    rows = []
    for i in range(60):
        words = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(20)] = 100 + rng.randrange(30)
        rows.append((i, " ".join(f"w{w}" for w in words), "ab"[i % 2]))
    rows.append((60, rows[0][1], "a"))
    df = spark.createDataFrame(rows, "id int, text string, split string")
    for t in (0.8, 0.95):
        sets = {i: set(x.split()) for i, x, _ in rows}
        expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(r.id_a, r.id_b) for r in dataset.near_duplicates(df, "id", "text", t).collect()} == expected
        side = {i: s for i, _, s in rows}
        across = {(r.id_a, r.id_b) for r in dataset.near_duplicates(df, "id", "text", t, "split").collect()}
        assert across == {(a, b) for a, b in expected if side[a] != side[b]}


def test_envelopes_and_sources(spark):
    rows = [(w, f"{w}{c}", c, s, sp, float(c)) for w in "abcd" for c in (1, 2) for s in (0, 9) for sp in [("train" if (c + "abcd".index(w)) % 2 else "test")]]
    win = spark.createDataFrame(rows, "work string, segment string, chapter int, start int, split string, d double")
    env = dataset.target_envelopes(win, ["d"], top=1).collect()
    assert [(r.work, r.n_windows, r.n_segments) for r in env] == [("a", 2, 1)]
    got = dataset.source_selection(win, spark.createDataFrame([("a",)], "work string")).collect()
    assert [(r.work, r.start) for r in got] == [("b", 0), ("c", 0), ("d", 0), ("b", 9), ("c", 9)]


def test_rewrite_scores(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0], [9.0, 9.0])], "s array<double>, c array<double>, t array<double>")
    same = df.select(*[c.alias(k) for k, c in scoring.rewrite_score(F.col("s"), F.col("c"), F.col("c"), F.array(F.lit(1.0), F.lit(1.0))).items()]).first()
    assert same.source_distance == same.target_distance == 0 and same.improvement_ratio == 1.0 and same.target_pass
    far = df.select(*[c.alias(k) for k, c in scoring.rewrite_score(F.col("s"), F.col("c"), F.col("t"), F.array(F.lit(3.559026), F.lit(3.559026))).items()]).first()
    assert far.target_distance == pytest.approx(2.247806, abs=1e-5) and not far.target_pass and far.improvement == 0


def test_best_iteration(spark):
    rows = [("a", 0, 0.3), ("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.9), ("b", 0, 0.397349), ("b", 1, 0.669781), ("c", 0, 0.2)]
    got = {r.case: tuple(r)[1:] for r in scoring.best_iteration(spark.createDataFrame(rows, "case string, turn int, v double"), "case", "turn", "v").collect()}
    assert got["a"] == (1, 0.5, 3, "no_objective_improvement") and got["b"] == (1, 0.669781, 2, "max_iterations_reached") and got["c"][3] == "max_iterations_reached"


def test_edit_similarity_is_that_of_matching_blocks(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("abcd" * 80, "abxd" * 70), ("", "")], "a string, b string")
    got = [r.edit_similarity for r in scoring.edit_similarity(df, "a", "b").collect()]
    assert got == [SequenceMatcher(None, "abcd" * 80, "abxd" * 70).ratio(), 1.0]


def _cases(spark):
    rows = [("A", 1, 0.40, []), ("A", 2, 0.50, []), ("B", 1, 0.55, []), ("B", 2, 0.45, [FAILURES[0]])]
    return spark.createDataFrame(rows, "run string, case int, objective double, labels array<string>")


def test_run_comparison(spark):
    pairs = runs.paired(_cases(spark), spark.createDataFrame([("A", 1), ("B", 2)], "run string, idx int"))
    r = runs.run_comparison(pairs).first()
    assert (r.n, r.improved, r.worsened, r.share_not_worse, r.failure_delta, r.gain_case, r.drop_case) == (2, 1, 1, 0.5, 1, 1, 2)
    assert (r.mean_delta, r.median_delta, r.gain, r["drop"]) == pytest.approx((0.05, 0.05, 0.15, -0.05))
    moved = {x.label: (x.persistent, x.resolved, x.introduced) for x in runs.failure_transitions(pairs, FAILURES).collect()}
    assert moved[FAILURES[0]] == (0, 0, 1) and moved[FAILURES[1]] == (0, 0, 0)
    assert runs.promotion(runs.run_comparison(pairs)).first().recommendation == "hold"


def test_promotion_fold(spark):
    rows = [("A", "B", 5, 0.1, 0.1, 1.0, 0), ("A", "C", 5, 0.2, 0.2, 1.0, 0), ("B", "C", 5, -0.1, -0.1, 0.0, 0)]
    cmp = spark.createDataFrame(rows, "ref string, cand string, n long, mean_delta double, median_delta double, share_not_worse double, failure_delta long")
    order = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "run string, idx int")
    assert [(r.run, r.incumbent, r.recommendation) for r in runs.promotion_fold(cmp, order).collect()] == [("A", None, "incumbent"), ("B", "A", "promote"), ("C", "B", "reject")]


def test_incumbent_fold_equals_loop(spark):
    rng = random.Random(3)
    rows = [("s", i, None if rng.random() < 0.2 else round(rng.random(), 1)) for i in range(60)]
    for higher in (True, False):
        best, expected = None, []
        for _, _, v in rows:
            if v is None:
                expected.append("failed")
            elif best is None or (v > best if higher else v < best):
                expected.append("keep")
                best = v
            else:
                expected.append("discard")
        got = runs.incumbent_fold(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v", higher).orderBy("i").collect()
        assert [r.decision for r in got] == expected


def test_audits(spark):
    want = spark.createDataFrame([(1,), (2,)], "id int")
    have = spark.createDataFrame([(1,), (1,), (3,)], "id int")
    assert {(r.id, r.status) for r in audit.coverage(want, have, ["id"]).collect()} == {(1, "duplicate"), (2, "missing"), (3, "orphan")}
    plan = spark.createDataFrame([("a", "r1", ["x"]), ("a", "r2", []), ("b", "r1", ["y"])], "experiment_id string, run_id string, command array<string>")
    assert {tuple(r) for r in audit.plan_issues(plan).collect()} == {("duplicate experiment_id", "a"), ("duplicate run_id", "r1"), ("empty command", "a")}
    two = spark.createDataFrame([(None, None), ("a", "a"), ("a", None)], "a string, b string")
    assert [r.x for r in two.select(audit.same(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, False]


def test_pca_and_knn(spark):
    rng = random.Random(4)
    rows = [(i, [3.0 * (x := rng.gauss(0, 1)) + rng.gauss(0, 0.1), x, rng.gauss(0, 0.1)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    p = matrix.pca(df, "id", "v", 2)
    assert p.where("component = 0").first().share > 0.99 and p.count() == 160
    assert p.groupBy("component").agg(F.avg("score").alias("m")).where("abs(m) > 1e-9").count() == 0
    got = {(r.id, r.neighbour) for r in matrix.knn(df, "id", "v", 3).collect()}
    pairs = df.alias("a").crossJoin(df.alias("b")).where("a.id <> b.id").select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), V.cosine(F.col("a.v"), F.col("b.v")).alias("s")).toPandas()
    best = pairs.sort_values(["i", "s"], ascending=[True, False]).groupby("i").head(3)
    assert got == set(zip(best["i"], best["j"], strict=True))


def test_decorrelation(spark):
    rows = [(float(i), 2.0 * i, float(i * 7 % 5)) for i in range(20)]
    assert matrix.decorrelate(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]) == ["b", "c"]


def test_backends(spark):
    class Shout:  # of this test alone, so that it travels to the workers whole
        def generate(self, prompts):
            return [p.upper() for p in prompts]

        def encode(self, texts):
            return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    assert [r.response for r in backends.generate(df, "text", Shout).orderBy("id").collect()] == ["A", ""]
    assert [r.embedding for r in backends.encode(df, "text", Shout).orderBy("id").collect()] == [[1.0], [0.0]]


def test_permutations_by_blocks_and_by_joins_agree(spark, sf):
    items = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 40")
    ways = [sorted(map(tuple, trajectory.permutation_null(items, "vec_id", "embedding", 7, sent=n).collect())) for n in (1 << 20, 0)]
    assert len(ways[0]) == 7
    for a, b in zip(*ways, strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    assert trajectory.permutation_null(items.where("false"), "vec_id", "embedding", 3).count() == 0


def test_permutations_leave_nulls_out_at_every_size(spark):
    rows = [(i / 2, [float(i % 5), 1.0 / (i + 1), float(-i)]) for i in range(12)] + [(99.5, None), (98.5, [1.0, None, 2.0])]
    items = spark.createDataFrame(rows, "k double, v array<double>")
    ways = [sorted(map(tuple, trajectory.permutation_null(items, "k", "v", 5, sent=n).collect())) for n in (1 << 20, 0)]
    clean = sorted(map(tuple, trajectory.permutation_null(items.where("k < 90"), "k", "v", 5).collect()))
    assert len(clean) == 5
    for a, b, c in zip(*ways, clean, strict=True):
        assert a == pytest.approx(b, abs=1e-9) and a == pytest.approx(c, abs=1e-9)
    ragged = items.union(spark.createDataFrame([(7.25, [1.0])], "k double, v array<double>"))
    for n in (1 << 20, 0):
        with pytest.raises(ValueError, match="1 to 3 places"):
            trajectory.permutation_null(ragged, "k", "v", 5, sent=n)
        assert trajectory.permutation_null(items.where("k = 1"), "k", "v", 5, sent=n).count() == 0


def test_following_wraps_over_buckets(spark):
    from quillspark.operators import selection

    ids = [3, 4, 50, 51, 52, 300, -7]
    df = spark.createDataFrame([(i,) for i in ids], "id int").repartition(3)
    got = dict(map(tuple, selection.following(df, "id", F.col("id"), F.floor(F.col("id") / 10), "n").collect()))
    order = sorted(ids)
    assert got == {a: order[(k + 1) % len(order)] for k, a in enumerate(order)}
    key = F.md5(F.col("id").cast("string"))
    partner = dict(map(tuple, selection.following(df, "id", key, selection.hash_bucket(key), "n").collect()))
    assert sorted(partner) == sorted(partner.values()) == order and all(a != b for a, b in partner.items())
    assert selection.following(df.where("id = 3"), "id", F.col("id"), F.lit(0), "n").first().n == 3


def test_depths_of_odd_parses(spark):
    rows = [(1, 0, t, max(1, t - 1), "NOUN", "obj") for t in range(1, 301)] + [(2, 0, 10, 12, "NOUN", "a"), (2, 0, 12, 12, "VERB", "ROOT"), (2, 0, 15, 10, "NOUN", "b"), (2, 0, 16, 99, "NOUN", "c"), (2, 1, 1, 1, "NOUN", "d")]
    got = {r.doc_id: r.parse_depth_mean for r in stylometrics.syntax_features(spark.createDataFrame(rows, "doc_id int, sent int, token int, head int, pos string, dep string")).collect()}
    assert got == {1: 300.0, 2: 2.0}


def test_bootstrap_of_a_constant_and_its_spread(spark):
    rows = [("a", 1.0)] * 9 + [("b", float(i)) for i in range(50)]
    got = {r.k: (r.low, r.high) for r in stats.bootstrap_mean(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got["a"] == (1.0, 1.0) and 19 < got["b"][0] < 22 and 27 < got["b"][1] < 30


def test_selection(spark):
    a, b = spark.createDataFrame([(1, 5), (None, 1)], "k int, o int"), spark.createDataFrame([(1, 0), (2, 3), (2, 2)], "k int, o int")
    assert sorted(map(tuple, selection.first_wins([a, b], "k", "o").collect()), key=str) == sorted([(1, 5, 0), (2, 2, 1), (None, 1, 0)], key=str)
    items = spark.createDataFrame([(i, i % 3) for i in range(31)] + [(99, 9)], "i int, g int")
    got = items.select("i", "g", selection.partner("i", "g").alias("p")).collect()
    assert sorted(r.p for r in got) == sorted(r.i for r in got) and all(r.p != r.i for r in got if r.g != 9) and all((r.p % 3 == r.g) for r in got if r.g != 9)
    cases = selection.shift_cases(items, items.select(F.col("g").alias("h")).distinct(), "g", "h", ["i", "h"], 2, 4)
    assert len(cases.collect()) == 4
    with pytest.raises(ValueError):
        selection.shift_cases(items, items, "g", "g", ["i"], -1)


def test_near_duplicates_shuffle_prefixes_only(spark, sf):
    """No task gets all tokens with their sets: a set's words are never sorted or counted in a window over exploded rows."""
    from quillspark.plans import QUERIES

    for name in ("near_duplicates", "leakage_audit"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "MapInArrow" in plan
