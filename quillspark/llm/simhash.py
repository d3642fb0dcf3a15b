"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

Words are runs without ASCII white space, A to Z in lower case. Each shingle of four words, repeats included, is hashed
with XXH64 (seed 42); a fingerprint's bit is set if it is set in over half the hashes.

Fingerprints are cut into a ring of five segments. If two differ in at most four bits, then from some segment on, every
chain of j consecutive segments differs in at most 4j/5 bits (the pigeonring principle). So their first segment of that
chain is equal and the second differs in one bit at most: each fingerprint is filed under its own two segments and under
those with one bit of the second cleared, at each of the five starts. Fingerprints that share a file are candidates; a
candidate pair is pruned unless some chain keeps all its budgets, and what is left is compared in full.

Equal fingerprints are one node. Within a file only a spanning forest is passed on: small files by comparing all pairs,
large ones by breadth-first search, so that a dense group costs its size, not its square. A file of more than ``limit``
fingerprints is split into blocks that meet in pairs. Components are found by joins.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows share a component; null
ids are larger than any other (a component of null ids alone has a null component_id); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import narrow, stage, through, unstage, utf8
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Bits of each segment, from the lowest.
WIDTHS = (13, 13, 13, 13, 12)
LIMIT = 1 << 20
_SMALL = 12
_STARTS = np.cumsum((0, *WIDTHS))[:-1]


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    cut = map(slice, starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter(map(xxh64_intdigest, map(line.__getitem__, cut), repeat(SEED)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").astype(np.float32).sum(axis=0, dtype=np.float32).astype(np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, text_hash (of the text itself) and fp (the fingerprint as a signed number) of each document; a narrow pass."""
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([majority(shingle_hashes(t, shingle)) for t in utf8(b.column(2))], np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    return narrow(src, batch, f"id {src.schema['id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(_STARTS, WIDTHS, strict=True)]


def files(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of every file of each fingerprint."""
    seg, m = _segments(fp), len(WIDTHS)
    keys, of = [], []
    for i in range(m):
        first, second = seg[i], seg[(i + 1) % m]
        head = np.uint64(i) << np.uint64(26) | first << np.uint64(13)
        keys.append(head | second)
        of.append(fp)
        for bit in range(WIDTHS[(i + 1) % m]):
            has = (second >> np.uint64(bit)) & np.uint64(1) == 1
            keys.append((head | second)[has] ^ np.uint64(1 << bit))
            of.append(fp[has])
    return np.concatenate(keys).view(np.int64), np.concatenate(of)


def chains(per: np.ndarray, distance: int | np.ndarray) -> np.ndarray:
    """Of pairs whose bits differ as per[segment] says: which have a chain around the whole ring that keeps its budgets of distance * j / segments."""
    m = len(per)
    ok = np.zeros(per.shape[1], bool)
    for i in range(m):
        chain, good = np.zeros(per.shape[1], np.int64), np.ones(per.shape[1], bool)
        for j in range(1, m + 1):
            chain += per[(i + j - 1) % m]
            good &= chain * m <= distance * j
        ok |= good
    return ok


def ring_filter(differing: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which XORs have such a chain."""
    return chains(np.stack([np.bitwise_count(s).astype(np.int64) for s in _segments(differing)]), distance)


def near(x: np.ndarray, y: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which pairs differ in at most distance bits: ring filter, then the full comparison of what it leaves."""
    d = x ^ y
    out = ring_filter(d, distance)
    out[out] = np.bitwise_count(d[out]) <= distance
    return out


def forest(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges that connect whatever is connected within one large file."""
    left, out = np.unique(fp), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(np.full(len(left), x), left, distance)
            for y in left[hit]:
                out.append((int(x), int(y)))
                queue.append(y)
            left = left[~hit]
    return out


def _meet(rows: Iterable[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Edges within the files of a partition that is sorted by its key columns."""

    def solve(keys: list[np.ndarray], fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(fp)))
        group = np.repeat(np.arange(len(at)), size)
        small = (size > 1) & (size <= _SMALL)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        inside = small[group]
        for d in range(1, _SMALL):
            pair = np.flatnonzero(inside[:-d] & (group[d:] == group[:-d])) if len(fp) > d else np.zeros(0, np.int64)
            if not len(pair):
                break
            ok = near(fp[pair], fp[pair + d], distance)
            a.append(fp[pair][ok])
            b.append(fp[pair + d][ok])
        for g in np.flatnonzero(size > _SMALL):
            edges = forest(fp[at[g] : at[g] + size[g]], distance)
            if edges:
                x, y = zip(*edges, strict=True)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
        u, v = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        e = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], ["a", "b"])

    held: list[np.ndarray] | None = None
    for r in rows:
        cols = [c.to_numpy(zero_copy_only=False) for c in r.columns]
        held = cols if held is None else [np.concatenate(p) for p in zip(held, cols, strict=True)]
        last = np.logical_and.reduce([k == k[-1] for k in held[:-1]])
        cut = len(last) - int(np.argmax(~last[::-1])) if not last.all() else 0  # the last file may go on
        if cut:
            yield solve([k[:cut] for k in held[:-1]], held[-1][:cut].view(np.uint64))
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield solve(held[:-1], held[-1].view(np.uint64))


def links(nodes: DataFrame, *, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in nodes.fp that connect all that are linked."""
    if distance != DISTANCE:
        raise ValueError("the files are laid out for a distance of 4")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        key, fp = files(b.column(0).to_numpy().view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], ["key", "fp"])

    filed = narrow(nodes.select("fp"), batch, "key bigint, fp bigint").withColumn("pair", F.lit(0))
    n = nodes.count()
    if n > limit:  # else no file can be larger
        big = filed.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        filed = filed.drop("pair").join(big, "key", "left").withColumn("c", other).withColumn("own", F.coalesce(own, F.lit(0)))
        filed = filed.select("key", "fp", (F.least("c", "own") * F.lit(1 << 15) + F.greatest("c", "own")).alias("pair"))
    filed = filed.select("key", "pair", "fp")
    dealt = filed.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return through(dealt, lambda rows: _meet(rows, distance), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row a document: id, text_hash, fp, root (the component's least fingerprint), component_id (its least id)."""
    fps = stage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes, limit=limit))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = stage(rooted.select("fp", "root").join(least, "root"), "named")
    return fps.join(named, "fp").select("id", "text_hash", "fp", "root", "component_id")


def first_of_each(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one of each root of found (id, text_hash, root): the row of least id, then least text hash; of equal ones that of least hash.

    Rows that share their id and text with no other row of a root pass unshuffled, but for some that a bitmap of bounded size can't tell.
    """
    from .setjoin import hit

    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("k"), F.count("*").alias("rows")).where("rows > 1")
    first = stage(first.select("root", "k.id", "k.text_hash"), "kept")
    crowd = found.select("id", "text_hash", "root").join(first.select("root"), "root", "left_semi").select(F.xxhash64(name, "text_hash").alias("__row")).distinct()
    first = first.select(F.xxhash64(name, "text_hash").alias("__row")).distinct().withColumn("__first", F.lit(True))
    crowd = stage(crowd.join(first, "__row", "left"), "crowd")
    keyed = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.xxhash64(F.col(f"`{text_col}`").cast("string"))))
    keyed = keyed.withColumn("__some", hit(keyed, "__row", crowd.select("__row")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    judged = keyed.where("__some").join(crowd.withColumn("__in", F.lit(True)), "__row", "left").where("__in is null or __first")
    alone = judged.where("__in is null").select(cols)
    one = judged.where("__in").groupBy("__row").agg(F.min_by(F.struct(cols), F.xxhash64(*cols)).alias("__kept")).select(*[F.col(f"__kept.`{c}`").alias(c) for c in docs.columns])
    return keyed.where("not __some").select(cols).union(alone).union(one)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one of each component: the row of least id, then least text hash; of equal rows one."""
    return first_of_each(docs, near_duplicates(docs, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
