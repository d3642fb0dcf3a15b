import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Every item's best rows of docs (id, text), by looking at all."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def rows(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def drawn():
    """Few words, so that ties and common terms abound; copies, empty texts, a null id, a long text."""
    rng = random.Random(3)
    plain_words = "Alpha béta gamma DELTA x-y 文字 z9 été common common Ünï 1.5".split()

    def word():
        return rng.choice(plain_words) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7)) % 300}"

    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[5][1]), (400, None), (401, ""), (402, "\x00 - !"), (403, " ".join(word() for _ in range(60_000)))]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(25)] + [(100, None), (101, ""), (102, "nothingofthesort"), (None, docs[3][1]), (5, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [search.BLOCK_BYTES, 200])
def test_against_all_scores(spark, drawn, block_bytes):
    docs, items = drawn
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    assert rows(search.search(d, i, block_bytes=block_bytes)) == sorted(plain(docs, items), key=repr)


def test_slices_do_not_change_sums(monkeypatch, spark, drawn):
    docs, items = drawn
    texts = pa.array([t or "" for _, t in docs])
    block = search.Items(pa.array([t or "" for _, t in items]))
    _, doc, term, tf = block.postings(texts)

    def sums():
        return {(int(a), int(b)): int(c) for x, y, z in search.accumulate(block, doc, term, tf) for a, b, c in zip(x, y, z, strict=True)}

    whole = sums()
    monkeypatch.setattr(search, "IMPACTS", 50)
    assert sums() == whole
    expected = {(j, i): sum(bag[t] for t in set(terms(text)) if t in bag) for j, (_, text) in enumerate(items) for i, bag in enumerate(Counter(terms(x)) for _, x in docs) if set(terms(text)) & set(bag)}
    assert whole == expected


def test_radix_order():
    rng = np.random.default_rng(0)
    for top in (10, 1 << 16, 1 << 20, 1 << 40):
        key = rng.integers(0, top, 3000, endpoint=True)
        assert (search.radix_order(key, top) == np.argsort(key, kind="stable")).all()


def test_edges(spark, edge, nothing, benchmark):
    got = rows(search.search(edge, benchmark))
    assert got == sorted(plain([(r.doc_id, r.text) for r in edge.collect()], [(r.item_id, r.text) for r in benchmark.collect()]), key=repr)
    assert [r[2] for r in got if r[0] == 4][:3] == [1, 1, 2]
    assert rows(search.search(nothing, benchmark)) == [] and rows(search.search(edge, benchmark.where("false"))) == []


def test_text_ids_and_other_columns(spark):
    docs = spark.createDataFrame([("b", "one two", 1), ("a", "one two", 2), (None, "one", 3)], "name string, body string, score int")
    items = spark.createDataFrame([("q", "two one", 5)], "q string, words string, rank int")
    found = search.search(docs, items, id_col="name", text_col="body", item_col="q", item_text_col="words", k=2)
    assert [(r.item_id, r["rank"], r.doc_id) for r in found.collect()] == [("q", 1, "a"), ("q", 2, "b")]
