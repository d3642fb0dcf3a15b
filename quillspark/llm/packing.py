"""Cost-balanced packing of documents into token sequences of bounded length.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``: attention is computed within a document's piece.
Each scan task packs its own documents in groups of about ``group_tokens`` tokens, so there is no shuffle and memory is
bounded. Within a group, documents go in descending order to the sequence of lowest cost that has room; where none has
room for the whole, the document is cut to fill the sequence that has most room. The sequences' capacities add up to
the group's tokens: full ones, and the rest split into powers of two, which need no padding.

Defined results: a null or empty text is one end token; a text longer than a group is a group of its own, and fills
sequences whole; repeated rows are packed once each; a null id is kept; an empty
table gives no pieces; other columns are ignored. The special tokens' strings in a text are those tokens, as in the library's plain call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .base import id_and_text, ragged, through
from .words import coded, pieces

CAPACITY = 2048
GROUP_TOKENS = 1 << 20
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Distinct words that a Python worker remembers, how many new ones the library gets as one text, and bytes of texts looked up at once.
_CACHE, _LINE, _PIECE = 200_000, 256, 4 << 20
_MARK = "\0"
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class WordCachedTokenizer:
    """Ids of whole texts, equal to ``Tokenizer.encode``, of which the library makes those of each distinct word once.

    No token of the vocabulary's splitter spans white space and its normaliser looks at single characters and their
    combining marks, so a text's ids are those of its words in order; A to Z may be lowered before, and a space put between a
    letter of a to z and a full stop or the like, where the splitter parts them anyway. New words are encoded many to a text,
    with one zero byte after each: its id, which no other word has, shows where they end. Words with a zero byte are encoded
    alone. What is remembered is bounded, and lives as long as the Python worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        special = sorted(t.content.lower() for t in self.full.get_added_tokens_decoder().values() if t.content)
        self.special = "|".join(map(re.escape, special)) or None
        (self.mark,) = self.full.encode(_MARK, add_special_tokens=False).ids
        self.seen: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.met = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _forget(self) -> None:
        """Keep only words that were met again, half of what may be remembered at most."""
        names, often = list(self.seen), self.met[: len(self.seen)]
        kept = np.flatnonzero(often > 1)
        if len(kept) > _CACHE // 2:
            kept = np.sort(kept[np.argsort(-often[kept], kind="stable")[: _CACHE // 2]])
        sizes = self.start[kept + 1] - self.start[kept]
        ids = self.ids[ragged(self.start[kept], sizes)]
        self.seen = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.ids[: len(ids)], self.used = ids, len(ids)
        self.start[: len(kept) + 1] = np.append(0, np.cumsum(sizes))
        self.met[: len(kept)], self.met[len(kept) :] = 1, 0

    def _add(self, words: list[str]) -> dict[str, int]:
        """Remember the ids of words that are new, and give their places."""
        odd = [w for w in words if _MARK in w]
        words = [w for w in words if _MARK not in w] if odd else words
        # beside a letter or numeral the zero byte is a piece of its own; elsewhere it needs spaces
        plain = [w for w in words if w[:1] in _PLAIN and w[-1:] in _PLAIN]
        other = [w for w in words if not (w[:1] in _PLAIN and w[-1:] in _PLAIN)]
        words = plain + other
        lines = [sep.join([*ws[i : i + _LINE], ""]) for sep, ws in ((_MARK, plain), (f" {_MARK} ", other)) for i in range(0, len(ws), _LINE)]
        got = [np.array(e.ids, np.uint32) for e in self.full.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate(got) if got else np.zeros(0, np.uint32)
        ends = np.flatnonzero(flat == self.mark)
        sizes = np.diff(ends, prepend=-1) - 1
        flat = np.delete(flat, ends)
        if odd:
            more = [e.ids for e in self.full.encode_batch_fast(odd, add_special_tokens=False)]
            flat = np.concatenate([flat, *(np.array(x, np.uint32) for x in more)])
            sizes = np.append(sizes, [len(x) for x in more])
            words = words + odd
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.seen) + len(words) + 1 > len(self.start):
            self.start, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.met))
        self.ids[self.used : self.used + len(flat)] = flat
        at = len(self.seen)
        self.start[at + 1 : at + 1 + len(words)] = self.used + np.cumsum(sizes)
        places = dict(zip(words, range(at, at + len(words)), strict=True))
        self.seen.update(places)
        self.used += len(flat)
        return places

    def __call__(self, text: str) -> np.ndarray:
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (and the end). A text with the string of a special token, in any case, is the library's as a whole."""
        if self.special:
            rare = pc.match_substring_regex(pc.ascii_lower(column), self.special)
            if pc.any(rare).as_py():
                ids, bounds = self._words(pc.if_else(rare, "", column))
                parts = [ids[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                for i in np.flatnonzero(rare.to_numpy(zero_copy_only=False)).tolist():
                    parts[i] = np.array(self.full.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
                return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
        return self._words(column)

    def _words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, bounds, words = coded(pc.replace_substring_regex(pc.ascii_lower(column), "([a-z])([.,;:!?])", r"\1 \2"), lower=False)
        if len(self.seen) > _CACHE:
            self._forget()
        known = words.to_pylist()
        at = np.fromiter(map(self.seen.get, known, repeat(-1)), np.int64, len(known))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [known[i] for i in new.tolist()]
            places = self._add(fresh)
            at[new] = [places[w] for w in fresh]
        self.met[at] += 1
        first, size = self.start[at], self.start[at + 1] - self.start[at]
        sizes = size[codes]
        return self.ids[ragged(first[codes], sizes)], np.append(0, np.cumsum(sizes))[bounds]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordCachedTokenizer:
    return WordCachedTokenizer(path)


def capacities(total: int, capacity: int) -> list[int]:
    """Room of the sequences that hold total tokens without padding: full ones, then falling powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group; every sequence is filled to its capacity."""
    room = np.array(capacities(sum(lengths), capacity), np.int64)
    cost = np.zeros(len(room))
    filled = np.zeros(len(room), np.int64)
    open_, out = len(room), []
    todo: dict[int, list[tuple[int, int]]] = {}
    fresh = 0
    for d, n in enumerate(lengths):
        whole = n // capacity if n > capacity else 0
        for j in range(whole):  # a document longer than a sequence fills some alone
            out.append((d, j * capacity, capacity, fresh, 0))
            room[fresh], cost[fresh], filled[fresh] = 0, linear * capacity + quadratic * capacity**2, capacity
            fresh += 1
        if n - whole * capacity:
            todo.setdefault(n - whole * capacity, []).append((d, whole * capacity))
    for n in range(max(todo, default=0), 0, -1):
        for d, start in todo.pop(n, ()):
            fits = room >= n
            if fits.any():
                b, take = int(np.where(fits, cost, np.inf).argmin()), n
            else:
                b = int(room.argmax())
                take = int(room[b])
                todo.setdefault(n - take, []).append((d, start + take))
            out.append((d, start, take, b, int(filled[b])))
            room[b] -= take
            filled[b] += take
            cost[b] += linear * take + quadratic * take * take
    assert not open_ or not room.any()
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    group_tokens: int = GROUP_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, sequence_tokens, cost."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    src = id_and_text(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, cost double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        first = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held
            pieces = assign([len(x) for x in ids], capacity, linear, quadratic)
            size = np.bincount([p[3] for p in pieces], [p[2] for p in pieces]).astype(np.int64)
            d, s, n, q, o = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(names).take(pa.array(d)),
                    pa.array(s),
                    pa.array(n),
                    pa.array([ids[a][b : b + c].tobytes() for a, b, c, _, _ in pieces], pa.binary()),
                    pa.array(np.array([len(x) for x in ids], np.int64)[d]),
                    pa.array(q + first),
                    pa.array(o),
                    pa.array(size[q]),
                    pa.array(linear * n + quadratic * n.astype(float) ** 2),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "cost"],
            )
            first += len(size)
            ids.clear()
            names.clear()
            held = 0
            return out

        for b in batches:
            at = 0
            for part in pieces(b.column(1), _PIECE):
                flat, bounds = encode.many(part)
                for i in range(len(part)):
                    ids.append(np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4"))
                    names.append(b.column(0).slice(at + i, 1))
                    held += len(ids[-1])
                    if held >= group_tokens:
                        yield flush()
                at += len(part)
        if ids:
            yield flush()

    return through(src, run, schema)
