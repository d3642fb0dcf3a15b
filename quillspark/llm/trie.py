"""Prefix trie of conversations by polynomial rolling fingerprints.

Turns are sorted by conversation and place, range-partitioned, so that a conversation of very many turns spans several partitions. A numpy scan
gives each turn the fingerprint of the prefix that ends with it: the sum of turn hashes times a base to the power of their places, modulo
two primes of 31 bits. Such sums add up, so what a conversation had in earlier partitions is one row a partition, added afterwards.

Prefixes of one length and fingerprint are a group. Its members are parted by their last turn, role and text in full, and by their group
one turn before; those that equal the member of least conversation, its representative, stay, the others have collided: their conversations
leave for another group from that turn on, and all is grouped anew until no group is parted. By induction over the
length, groups are then the nodes of the trie. Equal members are pre-aggregated, so a node of very many members costs a row a task.

Sums over subtrees need no walk. A conversation owns the nodes of which it is the least member: those from some depth on, as a node's members
are its parent's too. So a node's leaves are its members that own the leaf they end in; its children its members that own their next node; and
the sum over its subtree of (members - 1) * bytes is the sum over its members of the bytes from there on that they do not own. Each is a sum over members.

Defined results: rows with a null conversation are left out; null roles and texts are empty; turns are ordered by number, null first, then by role
and text; repeated rows are turns of their own; very long texts and conversations are handled whole; no conversation gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, stage, through, unstage

#: Moduli and bases of the fingerprints, and bits of turn hashes that are used (fewer only in tests of collisions).
PRIMES, BASES, BITS = (2147483647, 2147483629), (1103515245, 1300173011), 62
#: Bytes of ids in a row of a node's ends.
CHUNK = 1 << 16
_LOCAL = ("k", "bytes", "past", *(f"{c}{i}" for c in "sq" for i in range(2)))


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** i modulo prime, for i below n."""
    out = np.ones(max(1, n), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out[:n]


class _Scan:
    """Running sums within runs of one conversation, over sorted batches; the last row is held back to learn whether it ends its run."""

    def __init__(self) -> None:
        self.conv, self.k, self.past, self.s = None, 0, 0, [0, 0]

    def batch(self, conv: np.ndarray, turn: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        new = np.append(conv[0] != self.conv, conv[1:] != conv[:-1])
        starts = np.append(0, np.flatnonzero(new[1:]) + 1)
        runs = np.diff(np.append(starts, len(conv)))
        goes_on = not new[0]
        local = np.arange(len(conv)) - np.repeat(starts, runs) + 1
        k = local.copy()
        if goes_on:
            k[: runs[0]] += self.k
        out = {"k": k, "bytes": size}
        out["past"] = self._sums(size, starts, runs, self.past if goes_on else 0)
        for i, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            p = np.uint64(prime)
            power = powers(base, prime, int(runs.max()) + 1)[local]
            if goes_on:
                power[: runs[0]] = power[: runs[0]] * np.uint64(pow(base, self.k, prime)) % p
            part = turn.astype(np.uint64) % p * power % p
            total = self._sums(part.astype(np.int64), starts, runs, self.s[i] if goes_on else 0) % prime
            out[f"s{i}"], out[f"q{i}"] = total, (total - part.astype(np.int64)) % prime
        self.conv, self.k, self.past, self.s = conv[-1], int(k[-1]), int(out["past"][-1]), [int(out[f"s{i}"][-1]) for i in range(2)]
        return out

    @staticmethod
    def _sums(x: np.ndarray, starts: np.ndarray, runs: np.ndarray, carried: int) -> np.ndarray:
        total = np.cumsum(x)
        out = total - np.repeat(total[starts] - x[starts], runs)
        out[: runs[0]] += carried
        return out


def scanned(turns: DataFrame) -> DataFrame:
    """turns (conv, nth, role, text, turn, bytes) with d (place in the conversation), fp and parent_fp (of the prefixes with and without the turn), past (bytes up to it), last. A staged table."""
    order = [F.col("conv"), F.asc_nulls_first("nth"), F.col("role"), F.col("text")]
    dealt = turns.select("conv", "nth", "role", "text", "turn", "bytes").repartitionByRange(*order).sortWithinPartitions(*order)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, state, lead, held = TaskContext.get().partitionId(), _Scan(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            conv, turn, size = (b.column(i).to_numpy() for i in (0, 3, 4))
            lead = conv[0] if lead is None else lead
            cols = state.batch(conv, turn, size)
            own = [*b.columns[:3], *[pa.array(cols[c]) for c in _LOCAL], pa.array(conv == lead), pa.array(np.full(len(conv), part, np.int32))]
            both = pa.Table.from_arrays([pa.chunked_array([h, c]) for h, c in zip(held, own, strict=True)] if held else [pa.chunked_array([c]) for c in own], names).combine_chunks()
            key = both.column("conv").to_numpy()
            out = both.slice(0, both.num_rows - 1).append_column("ends", pa.array(key[:-1] != key[1:]))
            held = [c.combine_chunks() for c in both.slice(both.num_rows - 1).columns]
            yield from out.to_batches()
        if held:
            yield pa.RecordBatch.from_arrays([*held, pa.array([True])], [*names, "ends"])

    names = ["conv", "role", "text", *_LOCAL, "lead", "part"]
    schema = "conv bigint, role string, text string, " + ", ".join(f"{c} bigint" for c in _LOCAL) + ", lead boolean, part int, ends boolean"
    local = stage(through(dealt.select("conv", "role", "text", "turn", "bytes"), scan, schema), "scanned")
    carried, unfinished = _carried(local)
    spark = turns.sparkSession
    more = spark.createDataFrame(carried, "part int, lead boolean, k0 bigint, past0 bigint, s00 bigint, s01 bigint, w0 bigint, w1 bigint")  # a row a partition at most
    open_ = spark.createDataFrame(unfinished, "part int, conv bigint, goes_on boolean")
    full = local.join(F.broadcast(more), ["part", "lead"], "left").join(F.broadcast(open_), ["part", "conv"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("k0", "past0", "s00", "s01")} | {c: F.coalesce(c, F.lit(1)) for c in ("w0", "w1")}

    def moved(c: str, i: int) -> F.Column:
        return (zero[f"s0{i}"] + F.col(f"{c}{i}") * zero[f"w{i}"]) % PRIMES[i]

    d = F.col("k") + zero["k0"]
    return full.select(
        "conv", "role", "text", d.alias("d"), "bytes", (F.col("past") + zero["past0"]).alias("past"),
        (F.shiftleft(moved("s", 0), 31) + moved("s", 1)).alias("fp"),
        F.when(d == 1, 0).otherwise(F.shiftleft(moved("q", 0), 31) + moved("q", 1)).alias("parent_fp"),
        (F.col("ends") & F.col("goes_on").isNull()).alias("last"),
    )


def _carried(local: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """What conversations that span partitions had before each, and their parts that do not end them: from one row a partition."""
    tail = F.max_by(F.struct("conv", "lead", *[c for c in _LOCAL if c not in ("bytes", "q0", "q1")]), F.struct("conv", "k"))
    ends = local.groupBy("part").agg(F.min("conv").alias("first"), tail.alias("tail")).orderBy("part").collect()
    carried, unfinished, before = [], [], None
    for r in ends:
        own = {c: r.tail[c] for c in ("conv", "k", "past", "s0", "s1")}
        if before and before["conv"] == r.first:
            unfinished.append((before["part"], r.first, True))
            w = [pow(base, before["k"], prime) for base, prime in zip(BASES, PRIMES, strict=True)]
            carried.append((r.part, True, before["k"], before["past"], before["s0"], before["s1"], *w))
            if r.tail.lead:
                own |= {"k": own["k"] + before["k"], "past": own["past"] + before["past"]}
                own |= {f"s{i}": (before[f"s{i}"] + own[f"s{i}"] * w[i]) % PRIMES[i] for i in range(2)}
        before = own | {"part": r.part}
    return carried, unfinished


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, bits: int = BITS) -> DataFrame:
    """conv, nth, role, text, turn (a hash of role and text), bytes; under fixed names."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    named = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("nth"), role.alias("role"), text.alias("text")).where("conv is not null")
    return small_batches(named).select("*", F.xxhash64("role", "text").bitwiseAND((1 << bits) - 1).alias("turn"), F.octet_length("text").cast("long").alias("bytes"))


@dataclass
class Trie:
    """nodes: node (a key), conv (the least member), depth, parent_conv, n_convs, n_children, n_leaves, saved_bytes. ends: node, conv for each conversation, at the node where it ends."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(
    df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", convs: DataFrame | None = None, bits: int = BITS
) -> Trie:
    """The trie of all prefixes of the conversations, from the root of no turns. convs: one column of all conversations, if some have no turn."""
    scan = scanned(turns_of(df, conv_col, turn_col, role_col, text_col, bits))
    every = (convs if convs is not None else df.select(f"`{conv_col}`")).toDF("conv").select(F.col("conv").cast("long")).where("conv is not null").distinct()
    ended = stage(scan.where("last").select("conv", F.col("d").alias("length"), F.col("past").alias("total"), "fp"), "ended")
    ended = stage(every.join(ended, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("length", "total", "fp")]), "conversations")
    root = ended.select("conv", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("past"), F.lit(0).cast("long").alias("fp"), F.lit(-1).cast("long").alias("parent_fp"), (F.col("length") == 0).alias("last"))
    rows, nodes = _verified(scan.union(root))
    kept = ["d", "split", "fp"]
    owned = nodes.groupBy("owner").agg(F.min(F.struct("d", (F.col("past") - F.col("bytes")).alias("before"))).alias("top"), F.max("leaf").alias("leaf"))
    info = stage(ended.join(owned.withColumnRenamed("owner", "conv"), "conv", "left").select(
        "conv", "length", F.coalesce("top.d", F.col("length") + 1).alias("own"), F.coalesce("top.before", "total").alias("before"), F.coalesce("leaf", F.lit(False)).alias("leaf")
    ), "owners")
    each = rows.drop("role", "text").join(info, "conv")
    saved = F.when(F.col("d") < F.col("own"), F.col("before") - (F.col("past") - F.col("bytes"))).otherwise(0)
    next_ = (F.col("d") + 1 >= F.col("own")) & (F.col("d") < F.col("length"))
    sums = each.groupBy(*kept).agg(F.sum(next_.cast("long")).alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(saved).alias("saved_bytes"))
    sums = stage(nodes.join(sums, kept), "nodes")
    above = sums.select((F.col("d") + 1).alias("d"), F.col("split").alias("parent_split"), F.col("fp").alias("parent_fp"), F.col("owner").alias("parent_conv"))
    node = F.struct("d", "split", "fp").alias("node")
    full = sums.join(above, ["d", "parent_split", "parent_fp"], "left").select(node, F.col("owner").alias("conv"), F.col("d").alias("depth"), "parent_conv", "n_convs", "n_children", "n_leaves", "saved_bytes")
    return Trie(full, rows.where("last").select(node, "conv"))


def _verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with their split and their parent's, and the nodes, once no group of one length, split and fingerprint holds different prefixes."""
    moves = None
    while True:
        placed = _placed(rows, moves)
        group = ["d", "split", "fp"]
        own = [*group, "parent_split", "parent_fp", "role", "text"]
        count = [F.min("conv").alias("owner"), F.count("*").alias("n_convs"), (F.count_if("last") == F.count("*")).alias("leaf"), F.min("past").alias("past"), F.min("bytes").alias("bytes")]
        nodes = stage(placed.groupBy(*own).agg(*count).drop("role", "text"), "classes")
        parted = stage(nodes.groupBy(*group).agg(F.min("owner").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "collided")
        if not parted.limit(1).count():
            unstage(parted)
            return placed, nodes
        placed = placed.join(parted, group).withColumnRenamed("least", "conv_of")
        of = placed.where("conv = conv_of").select(*group, *[F.col(c).alias(f"{c}_of") for c in own[3:]])
        other = placed.join(of, group).where(" or ".join(f"{c} <> {c}_of" for c in own[3:]))
        left = other.groupBy("conv").agg(F.min("d").alias("since"))
        moves = stage(left if moves is None else moves.union(left), "moves")
        unstage(nodes, parted)


def _placed(rows: DataFrame, moves: DataFrame | None) -> DataFrame:
    """rows with split: how many times their conversation has left a group up to their turn."""
    zero = F.lit(0).cast("long")
    if moves is None:
        return rows.withColumns({"split": zero, "parent_split": zero})
    gone = moves.groupBy("conv").agg(F.collect_list("since").alias("since"))

    def times(d: F.Column) -> F.Column:
        return F.coalesce(F.size(F.filter("since", lambda x: x <= d)), zero).cast("long")

    return rows.join(gone, "conv", "left").withColumns({"split": times(F.col("d")), "parent_split": times(F.col("d") - 1)}).drop("since")


def ends_digest(ends: DataFrame) -> DataFrame:
    """node, digest: SHA-256 of each node's ending conversations, ascending, comma-joined. A digest is a sequence by definition; ids are joined to long strings before they meet."""
    order = ["node", "conv"]
    dealt = ends.select("node", "conv").repartitionByRange(*order).sortWithinPartitions(*order)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(0).field(i).to_numpy() for i in range(3)])
            conv = b.column(1).to_numpy()
            new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
            new[:: CHUNK // 16] = True
            starts = np.flatnonzero(new)
            words = conv.astype("U20").tolist()
            text = [",".join(words[a:z]) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(words)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(starts)), pa.array(conv[starts]), pa.array(text)], ["node", "conv", "ids"])

    kind = "node struct<d: bigint, split: bigint, fp: bigint>"
    chunks = through(dealt, join, f"{kind}, conv bigint, ids string")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            out = []
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], b.column(0).type), pa.array([x for _, x in out])], ["node", "digest"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], b.column(0).type), pa.array([sha.hexdigest()])], ["node", "digest"])

    return through(chunks.repartition("node").sortWithinPartitions("node", "conv").select("node", "ids"), digest, f"{kind}, digest string")
