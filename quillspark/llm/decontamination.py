"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every run of ``window`` words of a benchmark item is a pattern; an item of fewer words is one pattern. A document becomes
its lower-cased words with single spaces around them, and is searched for all patterns at once: the shift table of
blocks says how far the search may skip, patterns whose leading part ends in the block at hand are found by that block's
hash bucket, and a direct comparison confirms each occurrence. Patterns are searched in classes of similar length, so a
short item doesn't shorten every skip.

Items come in blocks of bounded bytes, whose tables the tasks build: one block goes along in one narrow pass over the documents,
without a shuffle. Several blocks are searched one after the other, each in a job of its own whose hits, not texts, are staged;
the documents then get the hits of all by id and hash of the text. Defined results: null and empty texts have no words and no hits;
items without words have no pattern; repeated items count once under their item_id; repeated documents each get a row; an empty
benchmark hits nothing; a very long text is searched whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column_function, id_and_text, rid_text, small_batches, stage, utf8

WINDOW = 10
#: Bytes of item texts that one pass carries; their tables take about a hundred times as much in a task.
BLOCK_BYTES = 1 << 20
#: A to Z become lower case; every other ASCII character but digits and letters parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Occurrences of many byte strings in a text; no pattern is empty."""

    def __init__(self, patterns: list[bytes]):
        classes: dict[int, list[bytes]] = {}
        for p in patterns:
            classes.setdefault(min(5, len(p).bit_length()), []).append(p)
        self.classes = [self._tables(ps) for _, ps in sorted(classes.items())]

    @staticmethod
    def _tables(patterns: list[bytes]) -> tuple[int, int, dict[bytes, int], dict[bytes, list[bytes]]]:
        m = min(map(len, patterns))
        # the block grows with the patterns' total length, as the paper advises, so that few blocks are in any pattern
        block = max(1, min(m // 2, 2 + int(np.log2(2 * m * len(patterns))) // 2))
        shift: dict[bytes, int] = {}
        bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(block, m + 1):
                b = p[end - block : end]
                shift[b] = min(shift.get(b, m), m - end)
            bucket.setdefault(p[m - block : m], []).append(p)
        return m, block, shift, bucket

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Start and pattern of every occurrence, overlapping ones included."""
        n = len(text)
        for m, block, shift, bucket in self.classes:
            far, skip, at = m - block + 1, shift.get, m
            while at <= n:
                by = skip(text[at - block : at], far)
                if by:
                    at += by
                    continue
                for p in bucket[text[at - block : at]]:
                    if text.startswith(p, at - m):
                        yield at - m, p
                at += 1


def patterns_of(items: list[tuple[str, bytes]], window: int) -> dict[bytes, set[str]]:
    """Patterns with a space at either end, and the items each stands in."""
    out: dict[bytes, set[str]] = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            out.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", set()).add(name)
    return out


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row a document: doc_id, n_words, spans (word ranges [from, to) that items cover, merged), item_ids (sorted as strings)."""
    src = small_batches(id_and_text(docs, id_col, text_col))
    items, blocks = _items(benchmark, item_col, item_text_col, block_bytes)
    if blocks == 1:
        found = src.select("id", _search(_block(items, 0, 1), window)("text").alias("r")).select("id", "r.*")
    else:
        counted = src.select("id", rid_text().alias("name"), F.xxhash64("text").alias("hash"), _search([], window)("text")["n_words"].alias("n_words"))
        found = counted.join(_hits(src, items, blocks, window), ["name", "hash"], "left")
    spans = F.expr("transform(sequence(1, size(starts)), i -> struct(starts[i - 1] as `from`, ends[i - 1] as `to`))")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(F.size("starts") > 0, spans).otherwise(F.expr("cast(array() as array<struct<`from`: bigint, `to`: bigint>>)")).alias("spans"),
        F.coalesce("names", F.expr("cast(array() as array<string>)")).alias("item_ids"),
    )


def _items(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """Names and texts of the items, and how many blocks they make."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("words")).where("words is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    return items, max(1, -(-size // block_bytes))


def _block(items: DataFrame, k: int, blocks: int) -> list[tuple[str, bytes]]:
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
    return [(r.item, r.words.encode()) for r in part.toLocalIterator()]


def _hits(src: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """Of documents with a hit, by name (the id as text) and hash of the text: starts, ends and names over all blocks."""
    parts = None
    for k in range(blocks):
        found = src.select(rid_text().alias("name"), F.xxhash64("text").alias("hash"), _search(_block(items, k, blocks), window)("text").alias("r")).where(F.size("r.starts") > 0)
        found = stage(found.dropDuplicates(["name", "hash"]), "hits")
        parts = found if parts is None else parts.union(found)

    def merge(column: pa.Array) -> pa.Array:
        rows = []
        for several in column.to_pylist():
            spans = _merged([x for r in several for x in zip(r["starts"], r["ends"], strict=True)])
            rows.append({"starts": [a for a, _ in spans], "ends": [b for _, b in spans], "names": sorted({n for r in several for n in r["names"]})})
        return pa.array(rows, pa.struct(list(_FOUND)[1:]))

    merged = column_function(merge, "struct<starts: array<bigint>, ends: array<bigint>, names: array<string>>")
    return parts.groupBy("name", "hash").agg(F.collect_list("r").alias("several")).select("name", "hash", merged("several").alias("r")).select("name", "hash", "r.*")


_FOUND = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("names", pa.list_(pa.string()))])


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _search(items: list[tuple[str, bytes]], window: int):
    """A function of a text column: the number of words, starts and ends of the spans that the items cover, and those items' names."""
    ready: list[tuple[dict[bytes, set[str]], WuManber]] = []

    def one(text: bytes) -> dict[str, object]:
        patterns, search = ready[0]
        w = words(text)
        line = b" " + b" ".join(w) + b" "
        found = list(search.find(line)) if patterns and w else []
        if not found:
            return {"n_words": len(w), "starts": [], "ends": [], "names": []}
        space = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        first = np.searchsorted(space, [at for at, _ in found])
        spans = _merged([(int(a), int(a) + p.count(b" ") - 1) for a, (_, p) in zip(first, found, strict=True)])
        return {"n_words": len(w), "starts": [a for a, _ in spans], "ends": [b for _, b in spans], "names": sorted(set().union(*(patterns[p] for _, p in found)))}

    def scan(column: pa.Array) -> pa.Array:
        if not ready:
            patterns = patterns_of(items, window)
            ready.append((patterns, WuManber(list(patterns))))
        return pa.array([one(t) for t in utf8(column)], _FOUND)

    return column_function(scan, "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, names: array<string>>")


def hit_words() -> F.Column:
    """How many of a document's words lie in a span."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, all columns, that hold no benchmark window. Only texts go to Python, and nothing but hits comes back."""
    items, blocks = _items(benchmark, item_col, item_text_col, block_bytes)
    text = F.col(f"`{text_col}`").cast("string")
    if blocks == 1:
        return small_batches(docs).where(F.size(_search(_block(items, 0, 1), window)(text)["starts"]) == 0)
    hits = stage(_hits(small_batches(id_and_text(docs, id_col, text_col)), items, blocks, window).select(F.col("name").alias("__name"), F.col("hash").alias("__hash")), "contaminated")
    keyed = docs.withColumn("__name", rid_text(f"`{id_col}`")).withColumn("__hash", F.xxhash64(text))
    return keyed.join(hits, ["__name", "__hash"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
