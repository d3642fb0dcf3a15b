"""Quality classifier: support vectors over naive Bayes features.

A text's features are indicators of hashed n-grams: one and two words in lower case, and one to three word shapes (runs
of upper-case, lower-case, numerals and each other character, and whether the word repeats the one before). Each
indicator is scaled by its class log-count ratio log((p/|p|) / (q/|q|)), where p and q are smoothed counts of documents
of either class; rows have unit length. A linear hinge-loss model is fitted to these by dual coordinate descent.

The model is fitted on a sample of labelled ids with a low hash: at most ``sample``, at most half of either class, and in that
order as many as have ``budget`` features together, so what comes to the driver is bounded in bytes too. Everything is scored, whole.
Defined results: null and empty texts get the score of a row without features (the bias); null labels train nothing;
without rows of both classes every score is 0.5; an id trains once (its greatest label, and of its rows the one of least text hash);
repeated rows are each scored; a very long text's n-grams are gathered part by part, with the result of the whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column_function, mix64, narrow, small_batches, stage, unstage
from .words import coded, hashes, pieces, raw, spelled

SAMPLE = 6000
#: Features that the sampled rows may have together: 4 bytes each on their way to the driver.
BUDGET = 24_000_000
BITS = 18
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 30
#: Words whose n-grams are sorted at once.
_PART = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What a byte is in a shape: 0 for numerals, A and a for letters of either case (a for all beyond ASCII), else itself.
_KIND = np.array([48 if 48 <= c <= 57 else 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else c for c in range(256)], np.uint8)
_RUN = np.isin(np.arange(256), (48, 65, 97))


def shapes(words: pa.Array) -> np.ndarray:
    """A hash of each word's shape: aA0 for the runs, other characters as they are."""
    data, bounds = raw(words)
    kind = _KIND[data]
    keep = np.append(True, kind[1:] != kind[:-1])[: len(kind)] | ~_RUN[kind]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    ends = np.append(0, np.cumsum(keep))[bounds]
    return spelled(kind[keep], np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends)), ends)


def _ngrams(word: np.ndarray, shape: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words in a row, and the text each is of; none spans texts."""
    with np.errstate(over="ignore"):
        found, of = [mix64(word ^ np.uint64(1)), mix64(shape ^ np.uint64(2))], [text, text]
        for n, h, salt in ((2, word, 3), (2, shape, 4), (3, shape, 5)):
            key = h[n - 1 :] + np.uint64(salt)
            for j in range(n - 1):
                key = mix64(key) * _ODD + h[j : len(h) - n + 1 + j]
            inside = text[n - 1 :] == text[: len(text) - n + 1]
            found.append(mix64(key)[inside])
            of.append(text[n - 1 :][inside])
    return np.concatenate(found), np.concatenate(of)


def features_of(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, sorted, end to end, and where each text's begin (and the end)."""
    codes, bounds, words = coded(column, lower=False)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    again = np.append(False, (codes[1:] == codes[:-1]) & (text[1:] == text[:-1]))
    word, shape = hashes(pc.ascii_lower(words))[codes], shapes(words)[codes]
    shape[again] ^= _ODD
    parts: list[np.ndarray] = []
    for at in range(0, len(codes), _PART):
        part = slice(max(0, at - 2), at + _PART)  # n-grams that two parts share are the same key
        h, of = _ngrams(word[part], shape[part], text[part])
        new = np.sort(of << bits | (h >> np.uint64(64 - bits)).astype(np.int64))
        parts.append(new[np.append(True, new[1:] != new[:-1])])
        if len(parts) > 8:
            parts = [np.unique(np.concatenate(parts))]
    keys = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
    return keys & ((1 << bits) - 1), np.searchsorted(keys >> bits, np.arange(len(column) + 1))


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Those of one text."""
    return features_of(pa.array([text], pa.binary()).cast(pa.string()), bits)[0]


@dataclass
class Model:
    """Weight of each hashed n-gram times its log-count ratio, the ratios, and the bias."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float

    def margins(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts whose features are f[bounds[i]:bounds[i + 1]]."""
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        norm = np.sqrt(np.bincount(text, self.ratio[f] ** 2, len(bounds) - 1))
        return np.bincount(text, self.weight[f], len(bounds) - 1) / np.where(norm > 0, norm, 1) + self.bias

    def scores(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margins(f, bounds)))

    def margin(self, f: np.ndarray) -> float:
        return float(self.margins(f, np.array([0, len(f)]))[0])

    def score(self, f: np.ndarray) -> float:
        return float(self.scores(f, np.array([0, len(f)]))[0])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, *, bits: int = BITS, smoothing: float = SMOOTHING, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """labels: 1 or 0. Log-count ratios, then dual coordinate descent on the hinge loss."""
    size = 1 << bits
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        return Model(np.zeros(size), np.zeros(size), 0.0)

    def smoothed(sign: int) -> np.ndarray:
        n = smoothing + np.bincount(np.concatenate([r for r, s in zip(rows, y, strict=True) if s == sign] or [np.zeros(0, np.int64)]), minlength=size)
        return n / n.sum()

    ratio = np.log(smoothed(1) / smoothed(-1))
    norms = [np.sqrt((ratio[r] ** 2).sum()) for r in rows]
    values = [ratio[r] / n if n else np.zeros(len(r)) for r, n in zip(rows, norms, strict=True)]
    # a rarer class weighs more, so that both weigh the same in total
    upper = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            f, v = rows[i], values[i]
            gradient = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (2.0 if norms[i] else 1.0), 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model(w * ratio, ratio, float(bias))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, budget: int = BUDGET, bits: int = BITS) -> Model:
    """Fit on documents of the ``sample`` labelled ids of lowest hash, as far as ``budget`` goes; their features, not texts, come to the driver.

    The ids are drawn from the labels alone, so they can be sent to every task and the documents needn't be shuffled.
    """
    label = F.col(f"`{label_col}`").cast("int")
    one = labels.select(F.col(f"`{id_col}`").alias("id"), label.alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    one = stage(one.withColumn("key", F.xxhash64(F.col("id").cast("string"), F.lit("sample"))), "labelled")
    half, span = sample // 2, float(1 << 64)
    chosen = None
    for r in one.groupBy("label").count().collect():
        below = min(-(1 << 63) + int(min(1.0, 1.2 * half / r["count"]) * span), (1 << 63) - 1)  # spares the sort most rows
        part = one.where((F.col("label") == r.label) & (F.col("key") <= F.lit(below))).orderBy("key", "id").limit(half)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return fit_rows([], np.zeros(0))
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).join(F.broadcast(chosen), "id").select("key", "label", "hash", "text")  # ``sample`` rows at most

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [x.astype("<i4").tobytes() for t in pieces(b.column(3)) for x in _apart(*features_of(t, bits))]
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], ["key", "label", "hash", "n", "f"])

    rows = stage(narrow(src, batch, "key bigint, label int, hash bigint, n bigint, f binary"), "sample")
    first = {}  # at most a few rows for each of ``sample`` ids: sizes alone
    for r in rows.groupBy("key").agg(F.min(F.struct("hash", "n")).alias("r")).collect():
        first[r.key] = (r.r.hash, r.r.n)
    keys = sorted(first)
    keys = keys[: int(np.searchsorted(np.cumsum([first[k][1] for k in keys]), budget, side="right"))]
    wanted = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<bigint>")
    got = {r.key: r for r in rows.where(F.array_contains(wanted, F.col("key"))).groupBy("key").agg(F.min(F.struct("hash", "label", "f")).alias("r")).select("key", "r.label", "r.f").collect()}
    unstage(one, rows)
    return fit_rows([np.frombuffer(bytes(got[k].f), "<i4").astype(np.int64) for k in keys], np.array([got[k].label for k in keys]), bits=bits)


def _apart(f: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    return (f[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", bits: int = BITS, score_col: str = "score") -> DataFrame:
    """The columns of docs with the score appended; a narrow pass, in which only the text goes to Python."""
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # 2 ** (bits + 4) bytes, whatever the input

    def scores(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(sent.value.scores(*features_of(t, bits)) for t in pieces(column))]))

    return docs.withColumn(score_col, column_function(scores, "double")(F.col(f"`{text_col}`").cast("string")))
