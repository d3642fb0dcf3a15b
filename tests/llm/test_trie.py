import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillspark.llm import queries, trie
from quillspark.llm.base import stage

COLUMNS = ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_bytes")


def plain(convs):
    """Nodes and ends of {conv: [(role, text)]}, by walking all prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children), len(leaves), saved, tuple(sorted(ends[p]))))
    return sorted(out, key=repr)


def ordered(rows):
    """{conv: turns} of (conv, turn, role, text) in the order that the operator states."""
    out = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            out[c].append((n is not None, n or 0, (r or ""), (t or "")))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in out.items()}


def found(built):
    ends = defaultdict(list)
    for r in built.ends.collect():
        ends[tuple(r.node)].append(r.conv)
    return sorted(((*(r[c] for c in COLUMNS), tuple(sorted(ends[tuple(r.node)]))) for r in built.nodes.collect()), key=repr)


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(2)
    rows, n = [], 0
    for c in rng.sample(range(-20, 400), 60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t * 2, rng.choice(["user", "bot"]) if t > 2 else "user", rng.choice(["", "hé", "a", "long text " * 3])))
    rows += [(500 + i, t, "user", "the same") for i in range(40) for t in range(3)]  # a group of copies
    rows += [(7, None, None, "x"), (7, None, "user", None), (7, None, None, "x"), (None, 1, "user", "lost"), (900, 5, "user", "second"), (900, 5, "bot", "first")]
    return rows


SCHEMA = "conv_id long, turn int, role string, text string, extra int, conv int, node string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("bits", [trie.BITS, 1])
def test_against_all_prefixes(spark, drawn, bits):
    """One bit a turn makes most fingerprints collide: groups are parted until each is one prefix."""
    rows = drawn if bits > 1 else drawn[:40]
    assert found(trie.prefix_trie(frame(spark, rows), bits=bits)) == plain(ordered(rows))


def test_long_conversation_spans_partitions(spark):
    rows = [(5, i, "user", f"t{i}") for i in range(3000)] + [(6, i, "user", f"t{i}" if i < 1500 else "else") for i in range(1600)] + [(1, 0, "user", "t0")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan = trie.scanned(trie.turns_of(frame(spark, rows), "conv_id", "turn", "role", "text"))
        assert [(r.conv, r.d) for r in scan.where("last").orderBy("conv").collect()] == [(1, 1), (5, 3000), (6, 1600)]
        got = {(r.conv, r.d): (r.fp, r.parent_fp, r.past) for r in scan.collect()}
        assert len(got) == len(rows) and got[5, 3000][2] == sum(len(f"t{i}") for i in range(3000))
        assert all(got[c, d][1] == (got[c, d - 1][0] if d > 1 else 0) for c, d in got)
        assert got[5, 1500][0] == got[6, 1500][0] and got[5, 1501][0] != got[6, 1501][0] and got[1, 1] == got[5, 1]
        nodes = {(r.conv, r.depth): r for r in trie.prefix_trie(frame(spark, rows)).nodes.collect()}
        assert len(nodes) == 1 + 3000 + 100
        assert nodes[1, 1].n_convs == 3 and nodes[1, 1].n_leaves == 2 and nodes[5, 1500].n_children == 2 and nodes[6, 1501].parent_conv == 5
        assert nodes[5, 2].saved_bytes == sum(len(f"t{i}") for i in range(1, 1500))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_edges(spark):
    empty = trie.prefix_trie(frame(spark, [(1, 1, "a", "b")]).where("false"))
    assert empty.nodes.count() == 0 and empty.ends.count() == 0
    convs = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "c long")
    assert found(trie.prefix_trie(frame(spark, [(2, 1, "a", "b")]), convs=convs)) == plain({1: [], 2: [("a", "b")], 3: []})
    assert found(trie.prefix_trie(frame(spark, [(2, 1, "a", "b")]).where("false"), convs=convs)) == plain({1: [], 2: [], 3: []})


def test_very_long_texts_and_clashing_names(spark):
    rows = [(i, 1, "user", "word " * 200_000) for i in range(3)] + [(1, 2, "bot", "end")]
    assert found(trie.prefix_trie(frame(spark, rows))) == plain(ordered(rows))


def test_digest_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 64)
    ids = random.Random(1).sample(range(-50, 10_000), 700)
    ends = spark.createDataFrame([((1, 0, 2), i) for i in ids] + [((2, 0, 2), 5)], "node struct<d: bigint, split: bigint, fp: bigint>, conv long").repartition(5)
    got = {r.node.d: r.digest for r in trie.ends_digest(stage(ends, "ends")).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 2: hashlib.sha256(b"5").hexdigest()}


def test_query_rebuilds(spark, tmp_path, drawn):
    rows = [r for r in drawn if r[0] is None or r[0] >= 0]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    own = ordered(rows)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    digest = {x[:7]: hashlib.sha256(",".join(map(str, x[7])).encode()).hexdigest() for x in plain(built)}
    got = queries.op12_prefix_trie(spark, str(tmp_path)).collect()
    assert any(not t for t in built.values())
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((*k, v) for k, v in digest.items()), key=repr)
