"""Language identification by rank-order profiles of character n-grams.

A text's letters are lower-cased, every other run becomes one space, and n-grams of 1 to 3 characters are counted. A
profile lists a language's most frequent n-grams in order of frequency, ties by n-gram. A document's own ``top`` most
frequent n-grams are compared with each profile: an n-gram costs the difference of its two ranks, or ``top`` if the
profile lacks it. The language of least total distance wins, ties by name. The score is 1 - distance / greatest distance.

Profiles count every training text. Counting is a narrow pass with sums in each task before the shuffle on n-grams; no n-gram spans texts,
and a very long text is counted in pieces with the same result as at once. Combining marks go with letters, but are none.
Defined results: a null text, or one without letters, is ``und`` with score 0; rows with a null language train nothing;
without any training row all is ``und``; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import narrow, strings, through

TOP = 400
ORDERS = 3
#: Characters handled at once.
_PIECE = 1 << 20
_GAP = 0
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, itself if it is a combining mark, else a space."""
    out = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(ch) == "Mn":
            out[c] = c
    return out


def _symbols(text: str) -> Iterator[np.ndarray]:
    """Letters in lower case with single spaces between words and at both ends, piece by piece."""
    yield np.array([32])
    if not any(map(str.isalpha, text)):
        return
    last = 32
    for at in range(0, len(text), _PIECE):
        raw = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        s = _letters()[raw]
        s = s[(s != 32) | np.append(last != 32, s[:-1] != 32)]
        if len(s):
            last = int(s[-1])
            yield s
    if last != 32:
        yield np.array([32])


def symbols(text: str) -> np.ndarray:
    """All at once."""
    return np.concatenate(list(_symbols(text)))


def grams(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers (three code points of 21 bits, earlier ones higher) and their counts; a lone space is none, nor what a gap parts."""
    alphabet, code = np.unique(s, return_inverse=True)
    wide = len(alphabet) + 1
    code = code.astype(np.int64) + 1
    keys = [code[(s != 32) & (s != _GAP)]]
    key, whole = code, s != _GAP
    for n in range(1, ORDERS):
        key = key[:-1] * wide + code[len(code) - len(key) + 1 :]
        whole = whole[:-1] & (s[n:] != _GAP)
        keys.append(key[whole])
    key = np.concatenate(keys)
    if wide**ORDERS <= 1 << 22 and len(key) > 1 << 16:
        count = np.bincount(key)
        key = np.flatnonzero(count)
        count = count[key]
    else:
        key, count = np.unique(key.astype(np.int32) if wide**ORDERS < 1 << 31 else key, return_counts=True)
    out, key = np.zeros(len(key), np.int64), key.astype(np.int64)
    point = np.append(0, alphabet)
    for j in range(ORDERS):
        out |= point[key % wide] << (_BITS * j)
        key //= wide
    return out, count


def count(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams over all texts, in pieces of bounded size."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held: list[np.ndarray] = []
    size = 0

    def fold() -> None:
        nonlocal size
        k, c = grams(np.concatenate(held))
        held.clear()
        size = 0
        keys.append(k)
        counts.append(c)
        if len(keys) > 32:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            keys[:], counts[:] = [k], [c]

    for t in texts:
        before = np.zeros(0, np.int64)  # the end of what has gone to fold, where the text goes on
        for s in _symbols(t):
            held.append(s)
            size += len(s)
            if size >= _PIECE:
                before = np.concatenate([before, *held])[-ORDERS + 1 :]
                before = before[np.flatnonzero(before == _GAP)[-1] + 1 :] if (before == _GAP).any() else before
                fold()
                if len(before):  # it is counted again with what follows, so once less here
                    held.append(before)
                    k, c = grams(before)
                    keys.append(k)
                    counts.append(-c)
        held.append(np.array([_GAP]))
        size += 1
    if held:
        fold()
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    return k[n > 0], n[n > 0]


def profiles(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """lang, gram, rank (from 0): at most ``top`` rows a language."""
    src = train.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            texts, langs = strings(b.column(0)), strings(b.column(1))
            for lang in dict.fromkeys(langs):
                held.setdefault(lang, []).append(count(t for t, x in zip(texts, langs, strict=True) if x == lang))
        for lang, parts in held.items():
            k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n)], ["lang", "gram", "n"])

    counted = through(src, run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


def identify(docs: DataFrame, train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, passed: dict[str, F.Column] | None = None) -> DataFrame:
    """doc_id, the columns in ``passed``, lang_pred, score; profiles are learned from ``train`` now."""
    learned: dict[str, dict[int, int]] = {}
    for r in profiles(train, text_col=text_col, lang_col=lang_col, top=top).collect():  # at most top rows a language
        learned.setdefault(r.lang, {})[r.gram] = r.rank
    names = sorted(learned)
    every = np.array(sorted({g for p in learned.values() for g in p}), np.int64)
    ranks = np.full((len(names), len(every) + 1), -1, np.int64)
    for i, lang in enumerate(names):
        ranks[i, np.searchsorted(every, np.fromiter(learned[lang], np.int64))] = list(learned[lang].values())

    def predict(text: str) -> tuple[str, float]:
        k, n = count([text])
        if not len(k) or not names:
            return "und", 0.0
        best = np.lexsort((k, -n))[:top]
        if len(n) > 4 * top:
            best = np.flatnonzero(n >= np.partition(n, -top)[-top])
            best = best[np.lexsort((k[best], -n[best]))][:top]
        g = k[best]
        at = np.minimum(np.searchsorted(every, g), len(every) - 1)
        at = np.where(every[at] == g, at, len(every))
        theirs = ranks[:, at]
        far = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(g)))).sum(axis=1)
        i = int(far.argmin())
        return names[i], float(1 - far[i] / (top * len(g)))

    passed = passed or {}
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[c.alias(k) for k, c in passed.items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text") + ", lang_pred string, score double"

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [predict(t) for t in strings(b.column(1))]
        kept = [i for i, name in enumerate(b.schema.names) if name != "text"]
        more = [pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())]
        return pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *more], [*[b.schema.names[i] for i in kept], "lang_pred", "score"])

    return narrow(src, batch, schema)
