import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quillspark.llm import simhash
from quillspark.llm.base import table
from quillspark.llm.components import components


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(fps):
    """Class of each fingerprint by comparing all."""
    left, out = list(dict.fromkeys(fps)), {}
    while left:
        todo, root = [left.pop(0)], None
        group = list(todo)
        while todo:
            x = todo.pop()
            near = [y for y in left if bin(x ^ y).count("1") <= 4]
            left = [y for y in left if y not in set(near)]
            todo += near
            group += near
        root = min(group)
        out |= dict.fromkeys(group, root)
    return out


def test_fingerprints_and_components(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    of = classes(rows.values())
    least = {}
    for i, f in rows.items():
        least[of[f]] = min(i, least.get(of[f], i))
    got = simhash.near_duplicates(docs).collect()
    assert {r.id: r.fp % (1 << 64) for r in got} == rows
    assert {r.id: r.component_id for r in got} == {i: least[of[f]] for i, f in rows.items()}


@pytest.mark.parametrize("limit", [simhash.LIMIT, 20])
def test_no_link_is_lost_in_dense_groups(spark, limit):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(150)} | {centre}
    for _ in range(250):  # a cloud, and chains away from it
        x = centre
        for _ in range(rng.randint(1, 3)):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(simhash.links(nodes, limit=limit)).collect()}
    expected = classes(fps)
    groups = {}
    for f, s in zip(fps, signed, strict=True):
        groups.setdefault(expected[f], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_ring_filter_keeps_every_near_pair():
    rng = random.Random(1)
    d = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12))) for _ in range(5000)], np.uint64)
    near = np.bitwise_count(d) <= 4
    assert simhash.ring_filter(d)[near].all() and not simhash.ring_filter(d).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 0 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(edge, nothing):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.component_id)
    assert by[1] == by[2] == {1} and by[3] == by[4] == by[5] == {3} and by[None] == {None}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 3, 6, 7, 8, 9, 10, None], key=str)
    assert simhash.keep_one(nothing).count() == 0
