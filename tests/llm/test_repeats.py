import random

import numpy as np
import pytest

from quillspark.llm import repeats
from quillspark.llm.base import table


def brute(rows):
    """rows: distinct (id, text). Removed ranges and kept bytes of each, as the definition says."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        cover = np.zeros(len(t), bool)
        for s in range(len(t) - repeats.LENGTH + 1):
            g = t[s : s + repeats.LENGTH]
            if g in seen:
                cover[s : s + repeats.LENGTH] = True
            seen.add(g)
        out[i] = bytes(np.frombuffer(t, np.uint8)[~cover])
    return out


def kept(df):
    return {r.doc_id: bytes(r.kept) for r in df.collect()}


def test_two_stage_sort_equals_sort():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))] + [0]
        assert repeats.two_stage(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("limit", [repeats.LIMIT, 1500])
def test_equals_brute_force(spark, sf, limit):
    docs = table(spark, sf, "documents")
    expected = brute([(r.doc_id, r.text.encode()) for r in docs.collect()])
    assert kept(repeats.remove_repeats(docs, limit=limit)) == expected
    assert any(len(expected[r.doc_id]) < len(r.text.encode()) for r in docs.collect())


@pytest.mark.parametrize("limit", [repeats.LIMIT, 800])
def test_made_up_repeats(spark, limit):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdef") for _ in range(130))
    short = line[:96]  # shared, but too short to remove
    rows = []
    for i in range(60):
        own = lambda n: "".join(rng.choice("ghijkl") for _ in range(n))
        mid = "".join(rng.choice("ab") for _ in range(3))
        rows.append((i * 3 % 61, rng.choice([own(40) + line + own(30), own(5) + short + own(70), line[:99] + mid + line, own(200), line * 3, short + line[:50] + own(10), own(20) + line[20:] + own(20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert kept(repeats.remove_repeats(docs, limit=limit)) == brute([(i, t.encode()) for i, t in rows])


def test_edge_rows(spark, edge, nothing):
    got = repeats.remove_repeats(edge).collect()
    assert len(got) == edge.count()
    distinct = {(r.doc_id, (r.text or "").encode()) for r in edge.collect()}
    expected = brute(distinct)
    assert all(bytes(r.kept) == expected[r.doc_id] for r in got)
    assert repeats.remove_repeats(nothing).count() == 0
    clash = spark.createDataFrame([(1, "x" * 50 + "a" * 120), (1, "y" * 50 + "a" * 120), (None, "a" * 130)], "doc_id long, text string")
    out = sorted(((r.doc_id is not None, bytes(r.kept)) for r in repeats.remove_repeats(clash).collect()))
    assert out == [(False, b"a"), (True, b"x" * 50), (True, b"y" * 50)]
