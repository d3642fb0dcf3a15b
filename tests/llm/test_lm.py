import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import lm
from quillspark.llm.base import table


def brute(rows):
    """rows: (id, text). The model in plain Python: counts, weights, scores."""
    docs = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    full, base, fold = Counter(), Counter(), Counter()
    full2, base2 = Counter(), Counter()
    for _, r, w in docs:
        pairs = list(zip(["<s>", *w], w, strict=False))
        if r != lm.HELD_OUT:
            full.update(w)
            full2.update(pairs)
            if r == lm.LEARN:
                fold.update(w)
            else:
                base.update(w)
                base2.update(pairs)
    n, v, n_base = sum(full.values()), len(full), sum(base.values())
    words = [w for w in full if fold[w]]
    ml = np.array([2.0 ** (round(16 * math.log2(base[w])) / 16) if base[w] else 0.0 for w in words]) / max(n_base, 1)
    m = lm.em(ml * (v + 1), np.array([fold[w] for w in words], float)) if n_base else 1e-6

    def p1(w, c, total):
        return m * c[w] / max(total, 1) + (1 - m) / (v + 1)

    events = {}
    for _, r, w in docs:
        if r == lm.LEARN and n_base:
            for h, x in zip(["<s>", *w], w, strict=False):
                c = base[None] if h == "<s>" else base[h]
                if c:
                    q = base2[h, x] / c / p1(x, base, n_base)
                    events.setdefault(int(math.log2(c)), []).append(2.0 ** (round(16 * math.log2(q)) / 16) if q else 0.0)
    lam = np.full(64, 0.5)
    for b in sorted(events):
        lam[b:] = lm.em(np.array(events[b]), np.ones(len(events[b])))
    out = []
    for i, r, w in docs:
        s = 0.0
        for h, x in zip(["<s>", *w], w, strict=False):
            c = full[None] if h == "<s>" else full[h]
            weight = lam[int(math.log2(c))] if c else 0.0
            s += math.log10(weight * (full2[h, x] / c if c else 0) + (1 - weight) * p1(x, full, n))
        out.append((i, r == lm.HELD_OUT, len(w), sum(1 for x in w if full[x]), n, sum(math.log10((full[x] + 1) / (n + v + 1)) for x in w), s))
    return out


def same(got, expected):
    order = lambda x: (x[0] is None, x[0] or 0, x[2])
    got, expected = sorted((tuple(r) for r in got), key=order), sorted(expected, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6), a[0]


def test_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.train_and_score(docs, block_bytes=40_000, stable=True).collect()
    same(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_rows(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    same(lm.train_and_score(edge).collect(), brute(rows))
    assert lm.train_and_score(nothing).count() == 0
    one = edge.where("doc_id = 7")
    same(lm.train_and_score(one).collect(), brute([(7, "a")]))


def test_em_finds_the_weight():
    rng = np.random.default_rng(0)
    p, q = np.array([0.7, 0.2, 0.1]), np.array([0.1, 0.3, 0.6])
    draws = np.bincount(rng.choice(3, 100_000, p=0.3 * p + 0.7 * q), minlength=3)
    assert lm.em(p / q, draws.astype(float)) == pytest.approx(0.3, abs=0.02)
