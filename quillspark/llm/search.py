"""Ranked lexical search by sort-based accumulation.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A to Z in lower case. A first pass sums in each task how many
documents hold each term that an item has, and the number and terms of all documents; a second one scores. For a slice of documents,
the impacts of all matched (term, document) postings are laid end to end, once for each item that has the term, under packed keys
(item, document); the keys are radix sorted in digits of 16 bits and equal ones summed by ``reduceat``. Each task keeps the k best of every item, picked
from a heap and the scores that reach the item's floor. These are written, range-partitioned by item, score and id, so that an item
with many rows spans several partitions; each gives the first k of an item, and the last choice is among those.

Items are taken in blocks of bounded text, one job of two passes each, so what is sent to the tasks is bounded whatever the size of either side.

Defined results: each row of either table is a document or an item of its own, repeated rows included; a text that is null, empty or
without terms matches nothing and doesn't count; equal scores go by ascending id, null ids last, and equal ids in no fixed order (their
rows are equal); an item without terms, and any item over an empty table, has no rows; a very long text is scored whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import id_and_text, ragged, small_batches, stage, through
from .words import coded, pieces, raw

K = 10
#: Bytes of items' text in a block, and impacts that are laid end to end at once (a single document may have more, by its block at most).
BLOCK_BYTES, IMPACTS = 4 << 20, 1 << 20
#: Bytes of a text as they stand in terms; all others part them.
_TERM = np.full(256, 32, np.uint8)
_TERM[0x80:] = np.arange(0x80, 0x100)
_TERM[0x30:0x3A] = np.arange(0x30, 0x3A)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = np.arange(0x61, 0x7B)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of all terms in the vocabulary, where each text's begin (and the end), and the vocabulary."""
    data, bounds = raw(column)
    plain = pa.StringArray.from_buffers(len(column), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(_TERM[data]))
    return coded(plain, lower=False)


class Items:
    """The terms of a block of items, and the items of each term, as sorted arrays."""

    def __init__(self, texts: pa.Array) -> None:
        codes, bounds, self.terms = terms_of(texts)
        pair = np.unique(codes.astype(np.int64) * max(1, len(texts)) + np.repeat(np.arange(len(texts)), np.diff(bounds)))
        term, self.item = pair // max(1, len(texts)), pair % max(1, len(texts))
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.n = len(texts)

    def postings(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and (text, term, occurrences) of those that an item has, by text."""
        codes, bounds, vocabulary = terms_of(column)
        place = pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy().astype(np.int64)
        size = np.diff(bounds)
        term = place[codes] if len(codes) else np.zeros(0, np.int64)
        known = term >= 0
        key, tf = np.unique(np.repeat(np.arange(len(size)), size)[known] * max(1, len(self.terms)) + term[known], return_counts=True)
        return size, key // max(1, len(self.terms)), key % max(1, len(self.terms)), tf.astype(np.int64)


def radix_order(key: np.ndarray, top: int) -> np.ndarray:
    """The stable order of whole numbers up to top, by digits of 16 bits, the lowest first."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while top >> shift:
        order = order[np.argsort(((key[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulate(items: Items, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, document, score) by item, in slices of documents; doc ascends, and each document is in one slice."""
    many = np.diff(items.starts)[term]
    ends = np.cumsum(many)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    at = 0
    while at < len(doc):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + IMPACTS, side="right"))
        whole = first[np.searchsorted(first, upto, side="right") - 1] if upto < len(doc) else upto
        if whole <= at:  # a single document
            after = np.searchsorted(first, at, side="right")
            whole = first[after] if after < len(first) else len(doc)
        part = slice(at, whole)
        at = whole
        low, docs = doc[part][0], int(doc[part][-1] - doc[part][0]) + 1
        item = items.item[ragged(items.starts[term[part]], many[part])]
        key = item * docs + np.repeat(doc[part] - low, many[part])
        order = radix_order(key, items.n * docs)
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        yield key[new] // docs, key[new] % docs + low, np.add.reduceat(np.repeat(impact[part], many[part])[order], new)


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor, self.held = k, np.ones(n, np.int64), {}

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Take in scores by item; of each item, those below its k-th so far or the k-th of this offer can't matter."""
        able = np.flatnonzero(score >= self.floor[item])
        able = able[np.lexsort((-score[able], item[able]))]
        starts = np.flatnonzero(np.append(True, item[able][1:] != item[able][:-1])) if len(able) else able
        sizes = np.diff(np.append(starts, len(able)))
        least = score[able[starts + np.minimum(sizes, self.k) - 1]]
        able = able[score[able] >= np.repeat(least, sizes)]
        named = ids.take(pa.array(doc[able])).to_pylist()
        new: dict[int, list] = {}
        for i, s, d in zip(item[able].tolist(), score[able].tolist(), named, strict=True):
            new.setdefault(i, []).append((-s, d is None, 0 if d is None else d))
        for i, rows in new.items():
            self.held[i] = nsmallest(self.k, self.held.get(i, []) + rows)
            if len(self.held[i]) == self.k:
                self.floor[i] = -self.held[i][-1][0]


def _counts(src: DataFrame, items: Items) -> tuple[np.ndarray, int, int]:
    """How many documents hold each term, how many have one at all, and their terms."""
    width = len(items.terms)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(width, np.int64), 0, 0
        for b in batches:
            for part in pieces(b.column(0)):
                size, _, term, _ = items.postings(part)
                df += np.bincount(term, minlength=width)
                n += int((size > 0).sum())
                total += int(size.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, total]))], ["term", "n"])

    got = through(src.select("text"), count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df, plain = np.zeros(width + 2, np.int64), got.column("term").to_numpy()
    df[plain] = got.column("n").to_numpy()  # -1 and -2 are the last two
    return df[:width], int(df[-1]), int(df[-2])


def _top(src: DataFrame, items: Items, names: pa.Array, block: int, k: int, kinds: tuple[str, str]) -> DataFrame:
    """Each task's k best documents of every item."""
    df, n_docs, n_terms = _counts(src, items)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, schema = Best(items.n, k), None
        for b in batches:
            schema, at = b.column(0).type, 0
            for part in pieces(b.column(1)):
                size, doc, term, tf = items.postings(part)
                norm = np.array([100 - 90 + 90 * x * n_docs // max(1, n_terms) for x in size.tolist()], np.int64)
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc]))
                ids = b.column(0).slice(at, len(part))
                for item, d, s in accumulate(items, doc, term, impact):
                    best.offer(item, d, s, ids)
                at += len(part)
        rows = [(i, none, d, -s) for i, held in best.held.items() for s, none, d in held]
        if rows:
            item, none, d, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(item, np.int64) + (block << 32)), names.take(pa.array(item)), pa.array([None if x else y for x, y in zip(none, d, strict=True)], schema), pa.array(s, pa.int64())],
                ["item", "item_id", "id", "score"],
            )

    return through(src.select("id", "text"), score, f"item bigint, item_id {kinds[0]}, id {kinds[1]}, score bigint")


def _first(df: DataFrame, k: int) -> DataFrame:
    """Of partitions sorted by item, the first k rows of each item."""

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            item = b.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
            sizes = np.diff(np.append(starts, len(item)))
            place = np.arange(len(item)) - np.repeat(starts, sizes)
            if item[0] == last:
                place[: sizes[0]] += seen
            last, seen = int(item[-1]), int(place[-1]) + 1
            yield b.filter(pa.array(place < k))

    return through(df, pick, df.schema.simpleString()[7:-1])


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    src = small_batches(id_and_text(docs, id_col, text_col))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("words")).where("words is not null")
    kinds = (asked.schema["item_id"].dataType.simpleString(), src.schema["id"].dataType.simpleString())
    blocks = max(1, -(-asked.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // block_bytes))
    best = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block)
        got = part.toArrow().combine_chunks()
        names, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns)
        own = stage(_top(src, Items(texts.cast(pa.string())), names, block, k, kinds), "best")
        best = own if best is None else best.union(own)
    order = [F.col("item"), F.desc("score"), F.asc_nulls_last("id")]
    near = _first(best.repartitionByRange(*order).sortWithinPartitions(*order), k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order[1:])))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", F.col("id").alias("doc_id"), "score")
