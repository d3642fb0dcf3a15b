"""Near copies by similarity of shingle sets: every pair whose Jaccard similarity is 0.8 or more is found.

Words are those of simhash.py; a document's set holds 64-bit hashes of its distinct shingles of five words (a shorter
text is one shingle). Equal sets are one node. Candidates come from an exact prefix filter: with all shingles in one
order, two sets of n and more that are similar enough share one of their first n - ceil(0.8 n) + 1, under each of which
a set is filed with its place. In the file of the first shingle that they share, what either has from there on must still be
enough for 0.8. The order puts shingles that are common in a sample of documents last; it decides the cost, not the result.

SimHash comes first: each set has a 64-bit fingerprint of its shingles, fingerprints of at most four differing bits are linked by
simhash.py's pigeonring, and the pairs of sets that this gives are confirmed in full. Copies with more edits differ by more bits, so the exact
prefix filter looks for what is left, between sets that SimHash hasn't joined. It finds links in two turns, so that a dense group costs about its size: first each file's sets are compared with its
least sets in some fixed orders, and the links give components; then pairs of a file whose components differ are compared,
unless the parities folded to 256 bits say already that they differ too much.
Candidates of fitting sizes are pruned by pigeonring filtering: a node's fingerprint has the parities of at least four times as many
buckets as it has shingles; two fingerprints differ in no more bits than the sets do, (n + m) / 9 at most, so in their ring of eight
segments some chain must keep its proportional budgets, before the full Hamming check. What is left is compared in full.

Sets are made from texts when they are needed, and only those of nodes with a candidate are shuffled. Defined results are
those of simhash.py; an empty text has an empty set, and empty sets are equal; a very long text's set is whole, its fingerprint at most 2**20 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import column_function, mix64, narrow, small_batches, stage, through, unstage
from .components import components
from .simhash import chains, links, majority
from .words import coded, hashes, pieces

SHINGLE = 5
#: Similarity of 4 / 5 or more, in whole numbers.
PART, WHOLE = 4, 5
#: About how many documents are read for common shingles, and how many of those are kept at most.
SAMPLE, COMMON = 1 << 12, 1 << 18
#: Sets of each file with which all others of it are compared first.
CENTRES = 16
#: Bits of the filter that spares rows a shuffle, segments of a fingerprint, its sizes, and nodes a task remembers to have filed.
_BITS = 1 << 24
_SEGMENTS, _LEAST, _MOST = 8, 256, 1 << 20
_FILED = 1 << 17


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for part in pieces(column):
        codes, bounds, words = coded(part)
        h = hashes(words)[codes]
        full = _mixed([h[j : len(h) - SHINGLE + 1 + j] for j in range(SHINGLE)]) if len(h) >= SHINGLE else h[:0]
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(full[x : y - SHINGLE + 1]) if y - x >= SHINGLE else _mixed([h[i : i + 1] for i in range(x, y)]) if y > x else h[:0]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of words in a row."""
    key = parts[0] + np.uint64(len(parts))
    with np.errstate(over="ignore"):
        for h in parts[1:]:
            key = mix64(key) * np.uint64(0x9E3779B97F4A7C15) + h
    return mix64(key)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more; two empty sets do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * WHOLE >= PART * (len(a) + len(b) - both)


def parities(a: np.ndarray) -> bytes:
    """A bit for each bucket of hashes: whether it holds an odd number."""
    size = min(max(_LEAST, 1 << (4 * len(a) - 1).bit_length()), _MOST)
    return np.packbits(np.bincount((a & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 == 1, bitorder="little").tobytes()


def folded(parity: bytes) -> list[int]:
    """The parities of 256 buckets, as four signed numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.int64).reshape(-1, _LEAST // 64)).tolist()


def differing(a: bytes, b: bytes) -> np.ndarray:
    """Bits that differ, by segment; the longer fingerprint is folded, which leaves the parities of fewer buckets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size)) if len(z) > size else z for z in (x, y))
    return np.bitwise_count(x ^ y).reshape(_SEGMENTS, -1).sum(axis=1, dtype=np.int64)


def prefix(a: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles under which a set is filed: the first n - ceil(0.8 n) + 1, rare ones first."""
    n = len(a)
    if not n:
        return a
    most = n + (-PART * n) // WHOLE + 1
    if not len(common):
        return a[:most]
    at = np.minimum(np.searchsorted(common, a), len(common) - 1)
    count = np.where(common[at] == a, often[at], 0)
    rare = np.flatnonzero(count == 0)[:most]
    return a[rare] if len(rare) == most else a[np.lexsort((a, count))[:most]]


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, at) sorted by key and node: those of keys that several nodes have, each once. One row is held back."""
    held: list[np.ndarray] = []
    before = False  # whether the row held back shares its key with one that went before
    for r in batches:
        if not r.num_rows:
            continue
        key, node, place = (np.concatenate(c) for c in zip(*([held] if held else []), [c.to_numpy() for c in r.columns], strict=True))
        once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, place = key[once], node[once], place[once]
        same = key[1:] == key[:-1]
        many = np.append(before, same) | np.append(same, False)
        out = np.flatnonzero(many[:-1])
        held, before = [c[-1:] for c in (key, node, place)], bool(many[-1])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (key, node, place)], ["key", "node", "at"])
    if before:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["key", "node", "at"])


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (a, b), a < b, of rows whose nodes a and b are under one key at places at_a and at_b: those that may be similar if it is the first key they share."""
    n = [F.shiftright(f"at_{x}", 32) for x in "ab"]
    left = [n[i] - F.col(f"at_{x}").bitwiseAND((1 << 32) - 1) for i, x in enumerate("ab")]
    # shared by both are (4 / 9) (n + m) or more
    fit = (F.least(*n) * WHOLE >= F.greatest(*n) * PART) & (F.least(*left) * (PART + WHOLE) >= (n[0] + n[1]) * PART)
    return df.where(fit & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def hit(df: DataFrame, column: str, wanted: DataFrame) -> F.Column:
    """Whether a row's number may be in wanted, whose one column has the same name: a bitmap of bounded size tells."""
    bit = F.pmod(column, F.lit(_BITS))
    parts = wanted.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    some = np.zeros(_BITS + (1 << 16), bool)
    for r in parts:  # buckets of 32,768 bits, numbered from 1 for bits 1 to 32,768; bit 0 has bucket 0
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        place = (r.k - 1) * len(bits) + 1 if r.k > 0 else 0
        some[place : place + len(bits)] |= bits == 1
    packed = np.packbits(some)

    def test(x: pa.Array) -> pa.Array:
        at = x.to_numpy() % _BITS
        return pa.array((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return column_function(test, "boolean")(F.col(column))


def _linked(pairs: DataFrame, nodes: DataFrame, src: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that are similar. nodes: node, n, parity, text_hash; src: text_hash, text."""

    def sides(p: DataFrame, s: DataFrame, cols: list[str]) -> DataFrame:
        for x in "ab":
            p = p.join(s.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols]), x)
        return p.select("a", "b", *[f"{c}_{x}" for c in cols for x in "ab"])

    def prune(b: pa.RecordBatch) -> pa.RecordBatch:
        most = (b.column(2).to_numpy() + b.column(3).to_numpy()) * (WHOLE - PART) // (WHOLE + PART)
        per = np.array([differing(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64).reshape(-1, _SEGMENTS).T
        keep = chains(per, most)
        keep[keep] = per[:, keep].sum(axis=0) <= most[keep]
        return pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in range(2)], ["a", "b"])

    left = stage(narrow(sides(pairs, nodes, ["n", "parity"]), prune, "a bigint, b bigint"), f"{name}-candidates")
    wanted = stage(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node"), f"{name}-wanted")
    hashes_ = wanted.select("text_hash")

    def grams(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets_of(b.column(1))], pa.binary())], ["text_hash", "grams"])

    some = src.where(hit(src, "text_hash", hashes_)).join(hashes_, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    full = stage(narrow(some.select("text_hash", "text"), grams, "text_hash bigint, grams binary").join(wanted, "text_hash").select("node", "grams"), f"{name}-sets")

    def verify(b: pa.RecordBatch) -> pa.RecordBatch:
        same = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        keep = pa.array(same, pa.bool_())
        return pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(2)], ["a", "b"])

    out = stage(narrow(sides(left, full, ["grams"]), verify, "a bigint, b bigint"), f"{name}-links")
    unstage(left, wanted, full)
    return out


def _common(src: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of documents repeats, sorted, and how often; bounded."""

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets_of(b.column(0))]).view(np.int64))], ["gram"])

    each = max(1, src.count() // SAMPLE)
    some = narrow(src.where(F.pmod(F.xxhash64("id", "text_hash"), F.lit(each)) == 0).select("text"), spread, "gram bigint")
    top = some.groupBy("gram").count().where("count > 1").orderBy(F.desc("count"), "gram").limit(COMMON).toArrow()
    gram, count = (c.to_numpy() for c in top.columns)
    gram = gram.astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], count[order].astype(np.int64)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, fp): those that connect equal fingerprints, and fingerprints of at most four differing bits."""
    heads = stage(nodes.groupBy("fp").agg(F.min("node").alias("head")), "simhash-heads")
    equal = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    side = lambda c, name: heads.select(F.col("fp").alias(c), F.col("head").alias(name))
    near = links(heads).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    return equal.union(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, text_hash, node (of its shingle set), root (the least node of its component)."""
    from xxhash import xxh3_64_intdigest

    text = F.col(f"`{text_col}`").cast("string")
    src = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def named(s: np.ndarray) -> int:
        return xxh3_64_intdigest(s.tobytes()) - (1 << 63)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(named(s), len(s), parities(s), majority(s)) for s in sets_of(b.column(2))]
        *cols, fp = zip(*rows, strict=True)
        cols = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns[:2], *cols, pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "text_hash", "node", "n", "parity", "fp"])

    every = stage(narrow(src, batch, f"id {kind}, text_hash bigint, node bigint, n bigint, parity binary, fp bigint"), "fingerprinted")
    nodes = stage(every.groupBy("node").agg(F.min(F.struct("text_hash", "n", "parity", "fp")).alias("r")).select("node", "r.text_hash", "r.n", "r.parity", "r.fp"), "nodes")
    alike = stage(simhash_pairs(nodes), "simhash-pairs")
    by_fp = _linked(alike, nodes, src, "simhash")
    joined = components(by_fp)
    common, often = _common(src)

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            keys, names, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in sets_of(b.column(0)):
                node = named(s)
                if node in done:  # a copy of what this task has filed
                    continue
                done.add(node)
                keys.append(prefix(s, common, often))
                names.append(np.full(len(keys[-1]), node, np.int64))
                places.append(len(s) << 32 | np.arange(len(keys[-1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (keys, names, places)], ["key", "node", "at"])
            if len(done) > _FILED:
                done.clear()

    filed = through(src.select("text"), file, "key bigint, node bigint, at bigint").repartition("key").sortWithinPartitions("key", "node")
    shared = stage(through(filed, _shared, "key bigint, node bigint, at bigint"), "shared")
    orders = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node", "at")) for k in range(CENTRES)]
    least = shared.groupBy("key").agg(F.array_distinct(F.array(*orders)).alias("centres"))
    centred = shared.withColumnRenamed("at", "at_a").join(least, "key").select("node", "at_a", F.explode("centres").alias("c")).select("node", "at_a", F.col("c.node").alias("centre"), F.col("c.at").alias("at_b"))
    stars = _pairs(centred, "node", "centre")
    for x in "ab":  # but for what SimHash has joined
        stars = stars.join(joined.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    tried = stage(stars.where("root_a is null or root_b is null or root_a <> root_b").select("a", "b"), "stars")
    first = by_fp.union(_linked(tried, nodes, src, "stars"))
    roots = components(first)
    rooted = stage(shared.join(roots, "node", "left").select("key", "node", "at", F.coalesce("root", "node").alias("root")), "rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")

    def fold(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([folded(x) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["node", "bits"])

    apart = rooted.join(several, "key", "left_semi")
    bits = narrow(nodes.select("node", "parity"), fold, "node bigint, bits array<bigint>").select("node", *[F.col("bits")[i].alias(f"bits{i}") for i in range(_LEAST // 64)])
    order = Window.partitionBy("node").orderBy("at")  # a set's files that several components share: its prefix at most
    apart = stage(apart.join(bits, "node").withColumns({f"before{j}": F.lag("key", j).over(order) for j in (1, 2, 3)}), "apart")
    x, y = (apart.select("key", *[F.col(c).alias(f"{c}_{side}") for c in apart.columns if c != "key"]) for side in "ab")
    differ = sum((F.bit_count(F.col(f"bits{i}_a").bitwiseXOR(F.col(f"bits{i}_b"))) for i in range(_LEAST // 64)), F.lit(0))
    near = differ * (PART + WHOLE) <= F.shiftright("at_a", 32) + F.shiftright("at_b", 32)
    # a key that follows on another shared one is not the first they share, under which they meet anyway
    later = F.arrays_overlap(*[F.array(*[F.col(f"before{j}_{side}") for j in (1, 2, 3)]) for side in "ab"])
    across = _pairs(x.join(y, "key").where("root_a < root_b").where(near & ~F.coalesce(later, F.lit(False))), "node_a", "node_b").join(tried, ["a", "b"], "left_anti")
    second = _linked(stage(across, "across"), nodes, src, "across")
    if second.limit(1).count():
        roots = components(first.union(second))
    return every.select("id", "text_hash", "node").join(roots, "node", "left").select("id", "text_hash", "node", F.coalesce("root", "node").alias("root"))
