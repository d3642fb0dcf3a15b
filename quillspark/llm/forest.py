"""Near copies by an LSH forest of MinHash signatures.

A document's set holds 64-bit hashes of its distinct shingles of two words; equal sets are one node. A node's signature has 96 minima of 16 bits. It is
filed in 20 orders, each a fixed choice of places of the signature whose first four no other order begins with. Within an order, nodes
are sorted by their minima, one after the other, and range-partitioned; rows near a border meet their neighbours across it in a second, small job.

Candidates have a long common prefix: a node's region is the first depth at which at most ``REGION`` nodes of its order share all minima so far, deeper
where the data are dense, and all pairs of a region are tried; where the first minimum alone is too common, ``NEIGHBOURS`` rows
before and behind, whose common prefix is the longest, are tried besides. Trying is in memory: sizes must fit, then four bits of each minimum estimate the similarity,
and pairs estimated five deviations below the threshold or more go on.

Links are found in turns, so that a dense group costs about its size: first each node's two most similar candidates of all orders are
confirmed on the full sets, and the links give components. Then the nodes that were candidates are tried again for pairs of different components;
those that have such a pair come with their whole set (hashes of 32 bits; a sample by hash where it has over 2,048) into the regions, where all these pairs are compared
in memory. Of what is similar by that, the three best pairs of each two components and region are confirmed. So of a group of many nodes just
below the threshold no pair leaves its region. Components are found by joins.

Two sets of similarity 0.8 miss each other in an order's region of depth k with probability 1 - 0.8 ** k, so in all 20 at depth 1, 2, 3, 4 with 1e-14, 1e-9,
6e-7, 3e-5, if the estimate keeps them (all but about one in a million). Regions are of depth 1 or 2 up to some millions of documents.

Defined results: texts that are null, empty or without words have an empty set, which is linked with nothing; a text of one word has it for its only shingle;
repeated rows and exact copies share a component; a component's id is its least id that isn't null, and a null id's row is kept only in a component of null
ids; an empty table gives an empty result; very long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import mix64, narrow, ragged, small_batches, stage, through, unstage
from .components import components
from .setjoin import hit
from .words import coded, hashes, pieces

SHINGLE = 2
#: Similarity of 80 / 100 or more, in whole numbers.
PART, WHOLE = 80, 100
#: Minima of a signature, orders, minima that an order sorts by before it turns to the four-bit sketch, and places that only one order begins with.
MINIMA, ORDERS, DEPTH, OWN = 96, 20, 4, 4
#: Most nodes of a region, rows that are handled at once (neighbouring turns share a region's), and neighbours tried where regions are deep.
REGION, TURN, NEIGHBOURS = 1024, 8192, 32
#: Best candidates of each node in the first turn, best pairs of each two components in a region in the second, and pairs compared at once.
BEST, ACROSS, PAIRS = 2, 3, 1 << 19
_SEEDS = np.random.default_rng(13)
_XOR = _SEEDS.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_ODD = _SEEDS.integers(0, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
_OWN = _SEEDS.permutation(MINIMA)
#: Places of the signature by which each order sorts.
PLACES = np.array([_OWN[OWN * o : OWN * o + OWN] for o in range(ORDERS)])
#: Equal sketch places needed of the first 16 and of all: five deviations below what similarity 0.8 gives, chance matches included.
_FIRST, _ALL = 5, 59
#: Most hashes of a set that come into a region, and the similarity of samples from which a pair goes on: five deviations below the threshold.
SAMPLED, SAMPLE_BAR = 2048, 0.75
_FILE = ["ord", "key", "node", "n", "sketch"]
_KIND = "ord int, key binary, node bigint, n bigint, sketch binary"


def shingled(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of a column: the hashes of all shingles, repeats included, and where each text's begin (and the end)."""
    for part in pieces(column):
        codes, bounds, words = coded(part)
        h = hashes(words)[codes]
        size = np.diff(bounds)
        with np.errstate(over="ignore"):
            pair = mix64(mix64(h[:-1] + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
            alone = mix64(h[bounds[:-1][size == 1]] + np.uint64(1))
        many = np.where(size > 1, size - 1, size)
        ends = np.append(0, np.cumsum(many))
        out = np.zeros(ends[-1], np.uint64)
        out[ragged(ends[:-1][size > 1], many[size > 1])] = pair[ragged(bounds[:-1][size > 1], many[size > 1])]
        out[ends[:-1][size == 1]] = alone
        yield out, ends


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for h, ends in shingled(column):
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield np.unique(h[a:z])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets, not both empty, have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both * WHOLE >= PART * (len(a) + len(b) - both)


def signatures(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The minima of each set, by row; sets must not be empty."""
    out = np.empty((MINIMA, len(ends) - 1), np.uint16)
    with np.errstate(over="ignore"):
        for i in range(MINIMA):
            out[i] = np.minimum.reduceat((((h ^ _XOR[i]) * _ODD[i]) >> np.uint64(32)).astype(np.uint32), ends[:-1])
    return np.ascontiguousarray(out.T)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, in words of 16."""
    low = (signature & np.uint16(15)).astype(np.uint8)
    return np.ascontiguousarray(low[:, ::2] | low[:, 1::2] << 4).view(np.uint64)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of a word's 16 places are equal."""
    x = a ^ b
    x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)
    return 16 - np.bitwise_count(x).astype(np.int16)


def agreeing(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, which agree in enough places of their sketches, and in how many."""
    some = np.flatnonzero(_equal(sketch[a, 0], sketch[b, 0]) >= _FIRST)
    total = _equal(sketch[a[some]], sketch[b[some]]).sum(axis=1, dtype=np.int16)
    good = total >= _ALL
    return some[good], total[good]


def regions(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows of which lcp[i] = common prefix of i and i + 1: the region of each row (-1: alone) and the rows whose region is deeper than 1."""
    n = len(lcp) + 1
    region, deep = np.full(n, -1, np.int64), np.zeros(n, bool)
    left = np.ones(n, bool)
    for k in range(1, depth + 1):
        new = np.append(True, lcp < k)
        run = np.cumsum(new) - 1
        size = np.bincount(run)[run]
        fits = left & (size <= REGION)
        region[fits & (size > 1)] = (np.int64(k) << 32 | run)[fits & (size > 1)]
        left &= ~fits
        if k == 1:
            deep = left.copy()
        if not left.any():
            break
    return region, deep


class Rows:
    """Sorted rows of a forest that are handled at once."""

    def __init__(self, columns: list[pa.Array]) -> None:
        self.ord, self.node, self.n = (columns[i].to_numpy().astype(np.int64) for i in (0, 2, 3))
        self.key = _matrix(columns[1]).view(">u2").reshape(-1, DEPTH)
        self.sketch = _matrix(columns[4]).view(np.uint64).reshape(-1, MINIMA // 16)

    def prefixes(self) -> np.ndarray:
        same = np.concatenate([(self.ord[1:] == self.ord[:-1])[:, None], self.key[1:] == self.key[:-1], self.sketch[1:].view(np.uint8) == self.sketch[:-1].view(np.uint8)], axis=1)
        return np.where(same[:, 0], np.cumprod(same, axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64) - 1, 0)

    def tried(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of rows (a, b) that may be similar, and in how many places they agree, in slices."""
        if len(self.ord) < 2:
            return
        lcp = self.prefixes()
        region, deep = regions(lcp, DEPTH + MINIMA // 2)
        row = np.flatnonzero(region >= 0)
        row = row[np.lexsort((self.n[row], region[row]))]
        _, group = np.unique(region[row], return_inverse=True)
        place = group.astype(np.int64) << 40 | self.n[row]
        most = np.searchsorted(place, group.astype(np.int64) << 40 | self.n[row] * WHOLE // PART, side="right")
        yield from self._slices(row, np.arange(len(row)) + 1, most)
        if deep.any():
            at = np.arange(len(self.ord))
            stop = np.flatnonzero(np.append(lcp < 1, True))
            end = np.minimum(stop[np.searchsorted(stop, at)] + 1, at + 1 + NEIGHBOURS)
            yield from self._slices(at, at + 1, np.where(deep, end, at + 1))

    def _slices(self, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        many = np.maximum(stop - start, 0)
        ends, at = np.cumsum(many), 0
        while at < len(row):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            part = slice(at, upto)
            a, b = np.repeat(row[part], many[part]), row[ragged(start[part], many[part])]
            good, total = agreeing(self.sketch, a, b)
            a, b = a[good], b[good]
            fit = (np.minimum(self.n[a], self.n[b]) * WHOLE >= PART * np.maximum(self.n[a], self.n[b])) & (self.node[a] != self.node[b])
            if fit.any():
                yield a[fit], b[fit], total[fit]
            at = upto

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of each row and its BEST partners, of equal ones in one order of nodes that all tasks have, and in how many places they differ."""
        order = np.argsort(mix64(self.node.view(np.uint64)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        width = np.int64(len(order)).item().bit_length()
        held = np.zeros(0, np.int64)
        for a, b, total in self.tried():
            key = np.concatenate([a << (width + 8) | (MINIMA - total).astype(np.int64) << width | rank[b], b << (width + 8) | (MINIMA - total).astype(np.int64) << width | rank[a]])
            held = np.unique(np.concatenate([held, key]))
            row = held >> (width + 8)
            first = np.searchsorted(row, row)
            held = held[np.arange(len(held)) - first < BEST]
        return self.node[held >> (width + 8)], self.node[order[held & ((1 << width) - 1)]], (held >> width) & 255


def sampled(a: np.ndarray) -> tuple[int, np.ndarray]:
    """How many low bits must be zero in the sample of a set, and the sample: 32 bits of each hash, all of them if the set is not too large."""
    level = max(0, -(-len(a) // SAMPLED) - 1).bit_length()
    short = a.astype(np.uint32)
    return level, short[short & np.uint32((1 << level) - 1) == 0]


def alike(samples: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of pairs of sets by their samples, 0 where it is too low. For sets that are there as a whole it is exact, but for equal 32-bit hashes of different shingles.

    A set's hashes mark a table of 65,536 by their upper half, in which those of its partners are looked up; what may then be similar is compared in full.
    """
    out = np.zeros(len(a))
    if not len(a):
        return out
    order = np.argsort(a, kind="stable")
    first = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))
    table = np.zeros(1 << 16, bool)
    for x, y in zip(first.tolist(), np.append(first[1:], len(a)).tolist(), strict=True):
        level, own = samples[a[order[x]]]
        table[own >> np.uint32(16)] = True
        for at in range(x, y, 512):
            some = order[at : min(y, at + 512)]
            others = [samples[i] for i in b[some].tolist()]
            both = np.maximum(np.array([k for k, _ in others]), level)
            other = np.concatenate([z for _, z in others])
            ends = np.append(0, np.cumsum([len(z) for _, z in others]))
            inside = other & np.repeat((1 << both) - 1, np.diff(ends)).astype(np.uint32) == 0 if both.any() else np.ones(len(other), bool)
            theirs, shared = (np.diff(np.append(0, np.cumsum(c))[ends]) for c in (inside, inside & table[other >> np.uint32(16)]))
            mine = np.array([int((own & np.uint32((1 << k) - 1) == 0).sum()) for k in range(int(both.max()) + 1)])[both]
            bar = np.where(both > 0, SAMPLE_BAR, PART / WHOLE) - 1e-9
            for i in np.flatnonzero(shared >= bar * (mine + theirs - shared)).tolist():
                mask = np.uint32((1 << int(both[i])) - 1)
                n = len(np.intersect1d(own[own & mask == 0], others[i][1][others[i][1] & mask == 0]))
                likeness = n / max(1, int(mine[i] + theirs[i]) - n)
                out[some[i]] = likeness if likeness >= bar[i] else 0
        table[own >> np.uint32(16)] = False
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as one array of bytes."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def _pairs(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in range(2)] + [pa.nulls(len(both), pa.int64())]


def best_pairs(columns: list[pa.Array]) -> list[pa.Array]:
    """Nodes and their best partners, each pair as often as it is one's best, with what differs."""
    return [pa.array(c) for c in Rows(columns).best()]


def open_nodes(columns: list[pa.Array]) -> list[pa.Array]:
    """Nodes that have a candidate of another root; as pairs of one."""
    rows, root = Rows(columns), columns[5].to_numpy()
    found = [np.unique(np.concatenate([x[apart], y[apart]])) for x, y, _ in rows.tried() for apart in [root[x] != root[y]]]
    node = rows.node[np.unique(np.concatenate([np.zeros(0, np.int64), *found]))]
    return _pairs(node, node)


def pairs_across(columns: list[pa.Array]) -> list[pa.Array]:
    """The most similar pairs of each two roots, by their samples, of those that may be similar."""
    rows, root = Rows(columns), columns[5].to_numpy()
    samples = [(x[0], np.frombuffer(x, np.uint32, offset=4)) for x in columns[6].to_pylist()]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for x, y, _ in rows.tried():
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        likeness = alike(samples, x, y)
        found.append((x[likeness > 0], y[likeness > 0], likeness[likeness > 0]))
    x, y, likeness = (np.concatenate(c) for c in zip(*found, strict=True))
    low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
    order = np.lexsort((rows.node[y], rows.node[x], -likeness, high, low))
    new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))[: len(order)]
    start = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    first = order[place < ACROSS]
    return _pairs(rows.node[x[first]], rows.node[y[first]])


def candidates(nodes: DataFrame, met: Callable[[list[pa.Array]], list[pa.Array]] = best_pairs) -> DataFrame:
    """a, b, far that ``met`` finds among rows that are handled at once, not distinct. nodes: node, n, signature, and what more a row should carry (root, then sample).

    The rows of all orders are sorted in ranges. A task handles its rows some thousands at a time, neighbouring turns sharing a region's rows. What
    is near a border goes to a second job; one row a partition tells the driver how many rows it has.
    """
    more = [c for c in nodes.columns if c not in ("node", "n", "signature")]
    kind = "".join(f", {c} {nodes.schema[c].dataType.simpleString()}" for c in more)

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sig = _matrix(part.column(2)).view(np.uint16).reshape(-1, MINIMA)
                n = len(sig)
                key = pa.array([x.tobytes() for x in sig[:, PLACES].astype(">u2").reshape(-1, DEPTH)], pa.binary())
                sketch = pa.array([x.tobytes() for x in sketches(sig)], pa.binary())
                each = pa.array(np.repeat(np.arange(n), ORDERS))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), n)), key, *[c.take(each) for c in (part.column(0), part.column(1), sketch, *part.columns[3:])]], [*_FILE, *more])

    wide = [*_FILE, *more]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), *[pa.binary() if c == "sample" else pa.int64() for c in more]]
    blank = lambda n, types: [pa.nulls(n, t) for t in types]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b); rows near either end of the partition that may have partners beyond it (part, at, the row); how many rows there are (part, at)."""
        from pyspark import TaskContext

        part, at, held, lead = TaskContext.get().partitionId(), 0, None, 0
        names = ["a", "b", "far", "part", "at", *wide]

        def give(a: list[pa.Array]) -> pa.RecordBatch:
            n = len(a[0])
            return pa.RecordBatch.from_arrays([*a, *blank(n, [pa.int32(), pa.int64(), *kinds])], names)

        def border(t: pa.Table, first: int) -> pa.RecordBatch:
            n = t.num_rows
            return pa.RecordBatch.from_arrays([*blank(n, [pa.int64()] * 3), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first, first + n)), *[_flat(c) for c in t.columns]], names)

        first: tuple[int, bytes] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b])
            if lead == at and lead < REGION:  # so far all rows share their order and first minimum
                run = _runs(b)
                first = first or run[0]
                same = next((i for i, r in enumerate(run) if r != first), b.num_rows)
                yield border(new.slice(0, min(same, REGION - lead)), at)
                lead += min(same, REGION - lead)
            at += b.num_rows
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= TURN:
                yield give(met([_flat(c) for c in held.slice(0, TURN).columns]))
                held = held.slice(TURN - REGION)
        if held is not None:
            yield give(met([_flat(c) for c in held.columns]))
            tail = held.slice(max(0, held.num_rows - min(REGION, at - lead)))  # what hasn't been given as one of the first
            if tail.num_rows:
                run = [r for b in tail.to_batches() for r in _runs(b)]
                size = next((i for i, r in enumerate(reversed(run)) if r != run[-1]), len(run))
                yield border(tail.slice(len(run) - size), at - size)
            yield pa.RecordBatch.from_arrays([*blank(1, [pa.int64()] * 3), pa.array([part], pa.int32()), pa.array([at], pa.int64()), *blank(1, kinds)], names)

    order = ["ord", "key", "sketch", "node"]
    filed = through(nodes.select("node", "n", "signature", *more), file, _KIND + kind).repartitionByRange(*order).sortWithinPartitions(*order)
    walked = stage(through(filed, walk, f"a bigint, b bigint, far bigint, part int, at bigint, {_KIND}{kind}"), "walked")
    counts = {r.part: r.at for r in walked.where("part is not null and ord is null").select("part", "at").collect()}
    parts = sorted(counts)
    offset = dict(zip(parts, np.append(0, np.cumsum([counts[p] for p in parts])).tolist(), strict=False))
    starts = np.array([offset[p] for p in parts[1:]], np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row near a border, in the two blocks of 2 * REGION places that hold it: any two rows less than a region apart share one."""
        for b in batches:
            at = np.array([offset[p] for p in b.column(0).to_pylist()], np.int64) + b.column(1).to_numpy()
            near = np.flatnonzero(np.searchsorted(starts, at - REGION, side="right") < np.searchsorted(starts, at + REGION, side="right"))
            block = np.concatenate([at[near] // REGION, at[near] // REGION - 1])
            each = pa.array(np.concatenate([near, near]))
            yield pa.RecordBatch.from_arrays([pa.array(block), *[c.take(each) for c in b.columns[2:]]], ["border", *wide])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def whole(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(met([_flat(c) for c in t.columns[1:]]), ["a", "b", "far"])

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = _flat(held.column(0)).to_numpy()
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield whole(held.slice(x, y - x))
            held = held.slice(int(cuts[-1])) if len(cuts) else held
        if held is not None and held.num_rows:
            yield whole(held)

    near = through(walked.where("ord is not null").select("part", "at", *wide), deal, f"border bigint, {_KIND}{kind}").repartition("border").sortWithinPartitions("border", *order)
    return walked.where("a is not null").select("a", "b", "far").union(through(near, meet, "a bigint, b bigint, far bigint"))


def _runs(b: pa.RecordBatch) -> list[tuple[int, bytes]]:
    """Order and first minimum of each row: only rows that share them can meet."""
    return list(zip(b.column(0).to_pylist(), (k[:2] for k in b.column(1).to_pylist()), strict=True))


def _flat(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return c if isinstance(c, pa.Array) else c.chunk(0) if c.num_chunks else pa.array([], c.type)


def _made(wanted: DataFrame, src: DataFrame, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """node, made: bytes made of the set of each wanted node, from its text again; some others, which a bitmap can't tell, are there too. src: text_hash, text. A staged table."""

    def grams(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([make(s) for s in sets_of(b.column(1))], pa.binary())], ["node", "made"])

    some = src.where(hit(src, "text_hash", wanted.select(F.col("node").alias("text_hash")))).select("text_hash", "text")
    return stage(narrow(some, grams, "node bigint, made binary").groupBy("node").agg(F.first("made").alias("made")), "sets")


def confirmed(pairs: DataFrame, src: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar on their full sets. src: text_hash, text. A staged table."""

    def verify(b: pa.RecordBatch) -> pa.RecordBatch:
        same = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        keep = pa.array(same, pa.bool_())
        return pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(2)], ["a", "b"])

    full = _made(pairs.select(F.explode(F.array("a", "b")).alias("node")), src, lambda s: s.tobytes())
    x, y = (full.select(F.col("node").alias(s), F.col("made").alias(f"grams_{s}")) for s in "ab")
    out = stage(narrow(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "grams_a", "grams_b"), verify, "a bigint, b bigint"), "links")
    unstage(full)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, node (of its set; null if it is empty), root (the least node of its component), component_id, kept."""
    from xxhash import xxh3_64_intdigest

    text = F.col(f"`{text_col}`").cast("string")
    src = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for h, ends in shingled(b.column(2)):
                rows = len(ends) - 1
                own = [np.unique(h[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                some = np.flatnonzero(np.diff(ends) > 0)
                signed: list[bytes | None] = [None] * rows
                if len(some):
                    for i, s in zip(some.tolist(), signatures(h, np.append(ends[some], ends[-1])), strict=True):
                        signed[i] = s.tobytes()
                node = [xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in own]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, rows) for c in b.columns[:2]], pa.array(node, pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array(signed, pa.binary())],
                    ["id", "text_hash", "node", "n", "signature"],
                )
                at += rows

    every = stage(through(src, sign, f"id {kind}, text_hash bigint, node bigint, n bigint, signature binary"), "signed")
    # a node is called by the hash of one of its texts, so that its set can be made again
    least = F.min(F.struct("text_hash", "n", "signature")).alias("r")
    nodes = stage(every.where("node is not null").groupBy(F.col("node").alias("set")).agg(least).select("set", F.col("r.text_hash").alias("node"), "r.n", "r.signature"), "nodes")
    slim = stage(every.select("id", F.col("node").alias("set"), "n"), "documents")
    unstage(every)
    signed = nodes.select("node", "n", "signature")
    best = F.slice(F.array_sort(F.collect_set(F.struct("far", F.xxhash64("b").alias("rank"), "b"))), 1, BEST)  # of some dozens
    tried = candidates(signed).groupBy("a").agg(best.alias("best")).select("a", F.explode("best.b").alias("b"))
    tried = stage(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    links = confirmed(tried, src)
    roots = components(links)
    among = stage(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(signed, "node"), "among")
    rooted = among.join(roots, "node", "left").select("node", "n", "signature", F.coalesce("root", "node").alias("root"))
    apart = stage(candidates(rooted, open_nodes).select(F.col("a").alias("node")).distinct(), "apart")
    samples = _made(apart, src, lambda s: (lambda level, short: np.uint32(level).tobytes() + short.tobytes())(*sampled(s)))
    full = rooted.join(apart, "node", "left_semi").join(samples.withColumnRenamed("made", "sample"), "node").select("node", "n", "signature", "root", "sample")
    across = stage(candidates(full, pairs_across).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "across")
    if across.limit(1).count():
        more = confirmed(across, src)
        if more.limit(1).count():  # links between components: their components are found among roots alone
            for x in "ab":
                more = more.join(roots.withColumnRenamed("node", x), x, "left").withColumn(x, F.coalesce("root", x)).drop("root")
            above = components(more)
            joined = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            roots = joined.union(above.join(roots.select("node"), "node", "left_anti").select("node", "root"))
    named = slim.join(nodes.select("set", "node"), "set", "left").join(roots, "node", "left").select("id", "n", "node", F.coalesce("root", "node").alias("root"))
    named = stage(named, "rooted")
    least = stage(named.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id")), "named")
    full = named.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return full.select("id", F.col("n").alias("n_shingles"), "node", "root", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
