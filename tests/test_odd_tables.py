"""Registered queries against their SQL on tables other than the given ones."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dataset, matrix, pairs, stats, stylometrics, trajectory
from quillspark.plans import QUERIES, SQL
from test_queries import _value


def differ(spark, folder, name, tables):
    """Rows of the query and of its SQL that the other lacks."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    order = sorted(df.columns)
    mine = sorted((tuple(_value(r[c]) for c in order) for r in df.collect()), key=repr)
    found = con.execute(SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == order
    theirs = sorted((tuple(_value(r[cols.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    return mine, theirs


PAGES = [
    (1, "<html><body><h2>x</h2><p>a&amp b&amp;&amp&amp;c</p><p>&lt;b&gt; &amp;lt; &eacute; &#65; &nbsp &copy &copy;</p></body></html>"),
    (2, "<html><body><h3>no</h3><p>&quot;q&quot; &middot; &ampamp; &amp;amp; &AMP; &notin</p><br/>&amp\n<p>12</p></body></html>"),
    (3, "no body &amp at all &hellip;"),
    (4, ""),
]


@pytest.mark.parametrize("name", ["html_unescape", "html_main_text", "html_to_text", "html_epigraph", "strip_editorial"])
def test_references_that_are_not_common_stay(spark, tmp_path, name):
    mine, theirs = differ(spark, tmp_path, name, {"pages": (PAGES, "page_id long, html string")})
    assert mine == theirs


@pytest.mark.parametrize("n", [3, 10, 17, 50])
def test_split_sizes_round_as_in_sql(spark, tmp_path, n):
    docs = {"documents": ([(i, f"s{i % 3}", "en", 5, "a b c") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")}
    for name in ("hash_split", "split_counts", "split_leakage"):
        mine, theirs = differ(spark, tmp_path, name, docs)
        assert mine == theirs, name


def test_rounded_sizes_equal_duckdb_s():
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    want = duckdb.sql("select n, cast(round(n * 0.7) as bigint), cast(round(n * 0.15) as bigint) from (select unnest(generate_series(0, 3000)) as n)").fetchall()
    assert [(n, *list(dataset.rounded_sizes(n, shares).values())[:2]) for n, _, _ in want] == want


TEXTS = ["", None, "  \n ", "One. Two words! Three more words?\n\nA new — paragraph… it ends... (so); no: yes", "l'été à la mer, où les élèves ñ x\x01y z", "the of and he she " * 40 + "ΣΑΣ", "a b c " * 17, "¡Hola! ¿Qué tal? ... … –", "x" * 500]


def test_features_of_odd_texts_equal_sql(spark, tmp_path):
    docs = {"documents": ([(i, t, "s", "en", 5) for i, t in enumerate(TEXTS) if t], "doc_id long, text string, source string, lang string, n_chars long")}
    for name in ("stylometric_features", "feature_stats", "top_variance_dims"):
        mine, theirs = differ(spark, tmp_path, name, docs)
        assert mine == theirs, name


def test_features_are_computed_once(spark):
    """Texts go to Python in one step, and no expression reads the words of a text again."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    f = stylometrics.features(df).drop("text")
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    got = {r.doc_id: r for r in f.collect()}
    assert got[1].sent_len_mean == got[2].mattr == got[1].vocab_density == 0.0 and got[3].sent_len_max > 0


def test_covariances_of_uneven_tasks(spark):
    """Constant columns far from zero have no deviation, whatever the tasks; empty tasks change nothing; no rows give nulls."""
    rows = [(5.1, float(i), None if i % 3 else 1e9 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    got = {(r.dim_a, r.dim_b): r.r for r in matrix.corr_matrix(df.union(df.where("false")), ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["a", "c"] is None
    both = df.where("c is not null")
    assert matrix.corr_matrix(both, ["b", "c"]).first().r == pytest.approx(1.0)
    assert matrix.decorrelate(both, ["a", "b", "c"]) in (["a", "b"], ["a", "c"])


def test_pairs_by_blocks_equal_sql(spark, tmp_path, monkeypatch):
    """Copies, one id twice, a null label, blocks of a few rows; no plan joins row to row."""
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(64)], rng.randrange(3)) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(7, rows[3][1], 1), (300, rows[5][1], None)]
    for name in ("extreme_pairs", "group_cohesion", "pair_similarity_stats"):
        for block in (7, 8192):
            monkeypatch.setattr(pairs.by_blocks, "__defaults__", (block,))
            mine, theirs = differ(spark, tmp_path, name, {"embeddings": (rows, "vec_id long, embedding array<float>, label int")})
            assert mine == theirs, (name, block)
    plan = QUERIES["group_cohesion"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_ranks_are_of_counted_values(spark):
    """No window holds a row for each of a key's rows; ties, nulls, constants and no keys as before."""
    rows = [("a", float(i % 5), float((i * 7) % 4)) for i in range(400)] + [("b", 1.0, float(i)) for i in range(5)] + [("a", None, 1.0), (None, 1.0, 2.0), (None, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    plain = df.where("x is not null").select("k", stats.average_rank("x", "k").alias("rx"), stats.average_rank("y", "k").alias("ry"))
    want = {r.k: (r.r, r.n) for r in plain.groupBy("k").agg(matrix.pearson("rx", "ry").alias("r"), F.count("*").alias("n")).collect()}
    got = {r.k: (r.rho, r.n) for r in stats.spearman(df, "x", "y", ["k"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == (want[k][0] if want[k][0] is None else pytest.approx(want[k][0], abs=1e-12), want[k][1]) for k in want)
    assert stats.spearman(df.where("k = 'a'"), "x", "y").first().rho == pytest.approx(want["a"][0], abs=1e-12)
    plan = stats.spearman(df, "x", "y", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 9, 10, 23])
def test_stretches_of_a_path_meet(monkeypatch, n):
    """Means over stretches are those over the whole path, wherever it is cut."""
    m = np.random.default_rng(1).normal(size=(n, 4))
    m[5:7] = m[4:5] if n > 7 else m[5:7]  # steps of no length
    order = trajectory._order(b"42|1|", [str(i).encode() for i in range(n)])
    assert list(order) == sorted(range(n), key=lambda i: hashlib.md5(f"42|1|{i}".encode()).digest())
    whole = trajectory._path_means(m, np.arange(n))
    for size in (1, 2, 4, 7):
        monkeypatch.setattr(trajectory, "STRETCH", size)
        assert trajectory._path_means(m, np.arange(n)) == (None, None, 0.0) if n < 2 else trajectory._path_means(m, np.arange(n)) == pytest.approx(whole, abs=1e-12)


def test_draws_are_those_of_a_plain_bootstrap(spark, monkeypatch):
    """Draws in parts and resamples in parts give the interval of a plain loop; no expression draws row by row."""
    monkeypatch.setattr(stats, "DRAWS", 4)
    values = [float(i * i % 11) for i in range(10)]
    df = spark.createDataFrame([("k", v) for v in values] + [(None, v) for v in values[:3]], "k string, v double")
    out = stats.bootstrap_mean(df, "k", "v", 60)
    assert "md5(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.low, r.high) for r in out.collect()}
    for k, some in (("k", sorted(values)), (None, sorted(values[:3]))):
        name = "42|k|" if k else "42|"
        means = sorted(sum(some[int(hashlib.md5(f"{name}{r}|{i}".encode()).hexdigest()[:12], 16) % len(some)] for i in range(len(some))) / len(some) for r in range(60))
        assert got[k] == pytest.approx((means[int(0.025 * 59)], means[int(0.975 * 59)]), abs=1e-12)


def test_mantel_equals_its_sql_on_odd_vectors(spark, tmp_path):
    """Null vectors, copies and a repeated id, in several blocks and parts; no window ranks all pairs."""
    import duckdb
    import numpy as np

    from quillspark.operators import pairs
    from quillspark.plans import SQL

    rng = np.random.default_rng(1)
    rows = [(i, None if i % 11 == 0 else [float(x) for x in np.round(rng.normal(0, 1, 64), 1)], 1) for i in range(60)]
    rows += [(i + 100, rows[1][1], 1) for i in range(9)] + [(5, rows[3][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    scales = {"da": (0, 16), "db": (16, 32), "dc": (32, 64)}
    got = pairs.mantel(df, "vec_id", "embedding", scales, block=10, part=50)
    assert sorted((r.scale_a, r.scale_b, round(r.rho, 6)) for r in got.collect()) == sorted(con.execute(SQL["mantel"]).fetchall())
    assert all(r.rho is None for r in pairs.mantel(df.where("false"), "vec_id", "embedding", scales).collect())


def test_hashed_orders_are_those_of_plain_digests():
    """Names of any length, one of more than a block, copies, and none."""
    names = [str(i).encode() for i in range(3000)] + [b"", b"x" * 60, b"y" * 47, b"7", b"7"]
    for prefix in (b"42|1|", b"42|5000|", b""):
        want = sorted(range(len(names)), key=lambda i: (hashlib.md5(prefix + names[i]).digest(), i))
        assert list(trajectory._hashed_order(prefix, trajectory._grouped(names))) == want
    assert len(trajectory._hashed_order(b"42|1|", trajectory._grouped([]))) == 0


def test_permutations_of_large_tables_are_sent_or_joined_in_rounds(spark, sf, monkeypatch):
    """Vectors of 6 GB of tables (615,384) are sent; joins beyond that go by rounds and leave no plan that holds all permutations; verdicts draw the null once."""
    assert 615_384 * 64 * 4 <= trajectory.SENT < 1 << 29
    monkeypatch.setattr(trajectory, "ROUND", 1 << 14)
    released = []
    monkeypatch.setattr(trajectory, "release", lambda s: released.append(s))
    items = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 40")
    only = ("mean_distance",)
    joined = trajectory.permutation_null(items, "vec_id", "embedding", 7, sent=0, only=only)
    assert joined.columns == ["perm", "mean_distance"] and len(released) == 7
    for a, b in zip(*(sorted(map(tuple, x.collect())) for x in (joined, trajectory.permutation_null(items, "vec_id", "embedding", 7, only=only))), strict=True):
        assert a == pytest.approx(b, abs=1e-12)
    for name in ("z_score", "agreement_verdict"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1, name


def test_candidates_are_confirmed_by_files(spark, monkeypatch):
    """One group of many near copies, in one file or parted: the pairs of plain sets. No join sends a set once for each of its pairs."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + base[k + 1 :] + [f"x{rng.randrange(3)}"]), "ab"[i % 2]) for i, k in enumerate(rng.randrange(6) for _ in range(40))] + [(90, "", "a"), (91, None, "b"), (92, "alone here", "a")]
    sets = {i: set((t or "").split()) for i, t, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.95}
    df = spark.createDataFrame(rows, "id int, text string, split string")
    for dense in (1 << 17, 4):
        monkeypatch.setattr(dataset, "DENSE", dense)
        out = dataset.near_duplicates(df, "id", "text", 0.95)
        assert len(want) > 20 and {(r.id_a, r.id_b) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union" not in plan and "FlatMapCoGroupsInArrow" in plan
