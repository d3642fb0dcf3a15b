import random

import corpus_pipeline
import numpy as np
import pytest

from quillspark.llm import setjoin
from quillspark.llm.base import table


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in low).split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(texts):
    """Least id of each id's class, by comparing all."""
    sets = {i: shingles(t) for i, t in texts.items()}
    of = {}
    for i in sorted(sets):
        if i in of:
            continue
        todo = [i]
        of[i] = i
        while todo:
            x = todo.pop()
            near = [j for j in sets if j not in of and jaccard(sets[x], sets[j]) >= 0.8]
            of |= dict.fromkeys(near, i)
            todo += near
    return of


@pytest.fixture(scope="module")
def edited():
    """Texts with many small edits, chains of them, a dense group, and a passage that many others hold."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts, passage = [], [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(rng.randint(40, 300))]
        for _ in range(60 if g == 0 else 5):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 55))):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
            if g % 3 == 1:
                base = new
    texts += [" ".join([word() for _ in range(rng.randint(1, 20))] + passage) for _ in range(40)]
    return dict(enumerate(texts))


def test_pipeline_stage_links_all_pairs_of_similarity(spark, edited):
    docs = spark.createDataFrame(list(edited.items()), "doc_id long, text string").repartition(4)
    expected = classes(edited)
    sets = [shingles(t) for t in edited.values()]
    assert sum(0.8 <= jaccard(a, b) < 0.9 for a in sets[:60] for b in sets[:60]) > 50
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(expected.values())


def test_real_documents(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert kept == set(classes(texts).values())


def test_prefixes_meet_whatever_the_order():
    rng = np.random.default_rng(1)
    for _ in range(500):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, n // 9).astype(np.uint64)))
        common = np.sort(rng.permutation(a)[: len(a) // 2])
        often = rng.integers(2, 9, len(common))
        if setjoin.similar(a, b):
            assert np.intersect1d(setjoin.prefix(a, common, often), setjoin.prefix(b, common, often)).size
            assert len(np.setxor1d(a, b)) * 9 <= len(a) + len(b)


def test_pipeline_stage_links_by_simhash_first(spark, edited, monkeypatch):
    """The fingerprints' pairs are those of a plain comparison, up to what connects them, and the stage's first links come from them."""
    fps = {i: setjoin.majority(next(setjoin.sets_of(setjoin.pa.array([t])))) for i, t in edited.items()}
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "node long, fp long")
    pairs = [(r.a, r.b) for r in setjoin.simhash_pairs(nodes).collect()]
    near = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4]
    assert pairs and set(pairs) <= set(near)

    def connected(edges):
        of = {i: i for i in fps}
        for _ in fps:
            for i, j in edges:
                of[i] = of[j] = min(of[i], of[j])
        return of

    assert connected(pairs) == connected(near)
    seen, plain = [], setjoin._linked
    monkeypatch.setattr(setjoin, "_linked", lambda pairs, *more: seen.append((more[-1], pairs.count())) or plain(pairs, *more))
    corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(list(edited.items()), "doc_id long, text string"), "")
    assert seen[0][0] == "simhash" and seen[0][1] > 0
