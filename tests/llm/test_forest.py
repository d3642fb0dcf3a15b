import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import forest


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in low).split(" ") if w]
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def linked(a, b):
    return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)


def plain(texts):
    """{id: (n, component)} by comparing all."""
    sets = {i: shingles(t) for i, t in texts.items()}
    of = {}
    for i in sorted(sets):
        if i in of:
            continue
        todo, of[i] = [i], i
        while todo:
            x = todo.pop()
            near = [j for j in sets if j not in of and linked(sets[x], sets[j])]
            of |= dict.fromkeys(near, i)
            todo += near
    return {i: (len(s), of[i]) for i, s in sets.items()}


def found(df):
    return {r.id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.fixture(scope="module")
def edited():
    """A dense group, chains of edits whose ends are far apart, templates just below the threshold, a shared passage, short texts."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    texts, passage = [], [word() for _ in range(50)]
    for g in range(14):
        base = [word() for _ in range(rng.randint(30, 250))]
        for _ in range(80 if g == 0 else 6):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
            if g % 3 == 1:
                base = new
    texts += [" ".join([word() for _ in range(rng.randint(1, 20))] + passage) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["one", "One", "one one", "one one one", "a b", "A\tb"]
    return dict(enumerate(texts))


def test_links_all_pairs_of_similarity(spark, edited):
    docs = spark.createDataFrame(list(edited.items()), "doc_id long, text string").repartition(4)
    expected = plain(edited)
    assert found(forest.near_duplicates(docs)) == expected
    assert len({c for _, c in expected.values()}) < len(edited) - 100


def test_many_small_ranges(spark, edited):
    """Each partition holds fewer rows than a region: all pairs are found across borders."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    some = {i: t for i, t in edited.items() if i % 2}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "29")
        assert found(forest.near_duplicates(docs)) == plain(some)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def filed(texts):
    """Sorted rows of one order, in memory."""
    column = pa.array(texts)
    h, ends = next(forest.shingled(column))
    sig = forest.signatures(h, ends)
    key = [x.tobytes() for x in sig[:, forest.PLACES[0]].astype(">u2")]
    sketch = [x.tobytes() for x in forest.sketches(sig)]
    order = sorted(range(len(texts)), key=lambda i: (key[i], sketch[i], i))
    n = [len(shingles(t)) for t in texts]
    take = lambda x, kind: pa.array([x[i] for i in order], kind)
    return [pa.array(np.zeros(len(order), np.int32)), take(key, pa.binary()), take(list(range(len(texts))), pa.int64()), take(n, pa.int64()), take(sketch, pa.binary())]


def test_dense_regions_go_deeper(monkeypatch, edited):
    """Where a region is larger than allowed, its rows are tried at a greater depth and beside their neighbours; nothing is lost of a dense group."""
    texts = [t for i, t in edited.items() if i < 80]
    whole = {frozenset((int(r.node[x]), int(r.node[y]))) for r in [forest.Rows(filed(texts))] for a, b, _ in r.tried() for x, y in zip(a, b, strict=True)}
    monkeypatch.setattr(forest, "REGION", 5)
    monkeypatch.setattr(forest, "NEIGHBOURS", 3)
    rows = forest.Rows(filed(texts))
    region, deep = forest.regions(rows.prefixes(), forest.DEPTH + forest.MINIMA // 2)
    assert deep.any() and max(np.unique(region[region >= 0], return_counts=True)[1]) <= 5
    less = {frozenset((int(rows.node[x]), int(rows.node[y]))) for a, b, _ in rows.tried() for x, y in zip(a, b, strict=True)}
    assert less and less < whole
    a, b, _ = rows.best()
    assert len(set(a.tolist())) > 60 and (np.unique(a, return_counts=True)[1] <= forest.BEST).all()


def test_estimates_keep_what_is_similar():
    """No pair of similarity 0.8 or more falls below the bar; hardly one below 0.45 passes."""
    rng = np.random.default_rng(4)
    lost = kept = high = low = 0
    for _ in range(400):
        n = int(rng.integers(2, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for change in (rng.random() * 0.11, 0.5):
            b = np.where(rng.random(n) < change, rng.integers(0, 1 << 63, n, dtype=np.uint64), a)
            both = len(np.intersect1d(a, b))
            j = both / (2 * n - both)
            sketch = forest.sketches(forest.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n])))
            passed = len(forest.agreeing(sketch, np.array([0]), np.array([1]))[0]) == 1
            if j >= 0.8:
                high, lost = high + 1, lost + (not passed)
            elif j < 0.45:
                low, kept = low + 1, kept + passed
    assert high > 300 and lost == 0 and low > 300 and kept <= low // 50


def test_samples_keep_what_is_similar():
    """Sets within the region as they are, or by sample where they are large or of two levels: nothing similar fails, little else passes."""
    rng = np.random.default_rng(6)
    for n, change in ((100, 0.1), (2000, 0.11), (2047, 0.11), (5000, 0.11), (9000, 0.11), (300, 0.2), (6000, 0.3)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        others = [np.unique(np.append(np.where(rng.random(len(a)) < change, rng.integers(0, 1 << 63, len(a), dtype=np.uint64), a), rng.integers(0, 1 << 63, k, dtype=np.uint64))) for k in (0, 2, n // 40)]
        sets = [a, *others]
        samples = [forest.sampled(x) for x in sets]
        assert all(len(x) <= 1.2 * forest.SAMPLED for _, x in samples)
        got = forest.alike(samples, np.zeros(3, int), np.arange(1, 4))
        for x, good in zip(others, got.tolist(), strict=True):
            both = len(np.intersect1d(a, x))
            j = both / (len(a) + len(x) - both)
            assert good > 0 or j < 0.8
            assert not good or j > 0.7
            assert not good or max(map(len, sets)) > forest.SAMPLED or good == pytest.approx(j, abs=1e-9)


def test_orders_begin_with_places_of_their_own():
    first = forest.PLACES[:, : forest.OWN].ravel()
    assert len(set(first.tolist())) == len(first) and all(len(set(p)) == forest.DEPTH for p in forest.PLACES.tolist())


def test_edges(spark, edge, nothing):
    rows = forest.near_duplicates(edge).collect()
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in rows), key=repr)
    one = [(1, 5, 1, True), (1, 5, 1, True), (2, 5, 1, False)]
    empty = [(i, 0, i, True) for i in (3, 4, 5)]
    assert [g for g in got if g[0] in (1, 2, 3, 4, 5)] == one + empty
    assert [g for g in got if g[0] is None] == [(None, 4, None, True)]
    assert next(g for g in got if g[0] == 7) == (7, 1, 7, True) and len(got) == edge.count()
    assert forest.near_duplicates(nothing).collect() == []


def test_null_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y z"), (None, "x y z"), ("a", "X y\nz"), (None, "p q"), (None, "p q"), ("c", None)], "name string, body string")
    got = sorted(((r.id, r.component_id, r.kept) for r in forest.near_duplicates(docs, id_col="name", text_col="body").collect()), key=repr)
    assert got == sorted([("b", "a", False), (None, "a", False), ("a", "a", True), (None, None, True), (None, None, True), ("c", "c", True)], key=repr)
