"""Stylometric features of texts: one row a text, no shuffle.

Everything is computed within the row. The moving type-token ratio comes from one sorted array of (word, position): a word's
earlier occurrence is its neighbour there, and the number of windows in which an occurrence is the first of its word has a
closed form, so no window is built.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X

WINDOW = 50
NAMES = (
    "sent_len_mean sent_len_median sent_len_std sent_len_max sent_len_cv mattr hapax_ratio vocab_density articles_per_k prepositions_per_k conjunctions_per_k "
    "pronouns_per_k semicolons_per_k colons_per_k em_dashes_per_k ellipses_per_k exclamations_per_k questions_per_k parens_per_k french_per_k english_per_k "
    "word_len_mean syllable_mean para_len_mean"
).split()
GROUPS = {
    "sentence_stats": NAMES[:5],
    "mattr": ["mattr"],
    "hapax": ["hapax_ratio", "vocab_density"],
    "function_word_rates": NAMES[8:12],
    "punctuation_profile": NAMES[12:19],
    "code_switching": ["french_per_k", "english_per_k"],
    "readability": NAMES[21:],
}


_SPACE = b" \t\n\x0b\f\r"
_WORD = re.compile(X.WORD)
_SENTENCE_END = re.compile(rb"([.!?]|\xe2\x80\xa6)[" + _SPACE + rb"]+")
_VOWELS = re.compile("[aeiouáéíóúü]+")
_MARK = X.MARK.encode()
_LISTS = [frozenset(words) for words in (L.ARTICLES, L.PREPOSITIONS, L.CONJUNCTIONS, L.PRONOUNS, L.FRENCH, L.ENGLISH)]
_MARKS = [[m.encode() for m in marks] for marks in ((";",), (":",), ("—", "–"), ("…", "..."), ("!", "¡"), ("?", "¿"), ("(", ")"))]


class _Words(dict):
    """Numbers of words in order of appearance, and for each a row: which lists hold it, its length, its syllables."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, ...]] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.rows)
        self.rows.append((*[word in some for some in _LISTS], len(word), max(1, len(_VOWELS.findall(word)))))
        return n


def _inside(ids: np.ndarray) -> int:
    """Over all windows of WINDOW words, how many distinct words they hold: an occurrence counts where it is the first of its word."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    p = order + 1
    q = np.where(np.append(False, ids[order][1:] == ids[order][:-1]), np.append(0, p[:-1]), 0)
    first = np.maximum(np.maximum(q + 1, p - (WINDOW - 1)), 1)
    return int(np.maximum(0, np.minimum(p, n - (WINDOW - 1)) - first + 1).sum())


def _measure(text: bytes, ids: np.ndarray, of: np.ndarray) -> tuple[float, ...]:
    """The features of one text with numbered words, in the order of NAMES; of: sums over its words' rows."""
    n = len(ids)
    seen = np.unique(ids, return_counts=True)[1]
    types, single = len(seen), int((seen == 1).sum())
    sent = np.array([k for k in (len(x.split()) for x in _SENTENCE_END.sub(rb"\1" + _MARK, text.strip(_SPACE)).split(_MARK)) if k] or [0], float)
    para = [k for k in (len(x.split()) for x in text.split(b"\n")) if k]
    mean = float(sent.mean())
    std = float(np.sqrt(((sent - mean) ** 2).mean())) if len(sent) > 1 else 0.0
    per_k = 1000.0 / max(n, 1)
    mattr = types / max(n, 1) if n <= WINDOW else _inside(ids) / (WINDOW * (n - (WINDOW - 1)))
    marks = [sum(map(text.count, some)) * per_k for some in _MARKS]
    lists = [int(k) * per_k for k in of[: len(_LISTS)]]
    return (
        mean, float(np.median(sent)), std, float(sent.max()), std / mean if mean > 0 else 0.0,
        mattr, single / types if types else 0.0, types / len(sent),
        *lists[:4], *marks, *lists[4:],
        int(of[-2]) / n if n else 0.0, int(of[-1]) / n if n else 0.0, sum(para) / len(para) if para else 0.0,
    )


def _measured(text: pa.Array, lower: pa.Array) -> pa.Array:
    known = _Words()
    ids = [np.array([known[w] for w in _WORD.findall(x)], np.int64) for x in lower.to_pylist()]
    rows = np.array(known.rows, np.int64).reshape(-1, len(_LISTS) + 2)
    out = [_measure(t, i, rows[i].sum(axis=0)) for t, i in zip(text.cast(pa.binary()).to_pylist(), ids, strict=True)]
    cols = np.array(out, float).reshape(-1, len(NAMES)).T
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], NAMES)


def features(docs: DataFrame, text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """The columns of docs and the features, or those named in ``only``. A null text counts as empty.

    Only the text goes to Python, in Arrow batches; words are numbered once a batch.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    measured = F.arrow_udf(lambda text, lower: _measured(text, lower), f"struct<{', '.join(f'{name}: double' for name in NAMES)}>")
    a = docs.select(*keep, measured(t, F.lower(t)).alias("__f"))
    return a.select(*keep, *[F.col(f"__f.{name}").alias(name) for name in only or NAMES])


def syntax_features(parses: DataFrame, key: str = "doc_id") -> DataFrame:
    """parse_depth_mean and subordinate_ratio from a parse table (key, sent, token, head, pos, dep); a root is its own head.

    A sentence's heads are one row's array, in which every token doubles its way to the root: as many turns as the logarithm of
    the sentence's length, without a join. A head that isn't there counts as a root.
    """
    one = parses.groupBy(F.col(key).alias("key"), "sent").agg(F.array_sort(F.collect_list(F.struct("token", "head"))).alias("t"))
    place = F.transform("t", lambda x: F.array_position(F.transform("t", lambda y: y["token"]), x["head"]).cast("int"))
    counted = F.forall(F.transform("t", lambda x, i: x["token"] == i + 1), lambda x: x)  # tokens from 1: a head is its own place
    one = one.select("key", F.size("t").alias("n"), F.when(counted, F.transform("t", lambda x: x["head"].cast("int"))).otherwise(place).alias("h"))
    one = one.withColumn("h", F.transform("h", lambda h, i: F.when((h >= 1) & (h <= F.col("n")), h).otherwise(i + 1)))
    start = F.struct(F.col("h").alias("up"), F.transform("h", lambda h, i: (h != i + 1).cast("int")).alias("far"))
    at = lambda a, i: F.element_at(a, i)
    turn = lambda s, _: F.struct(F.transform(s["up"], lambda u: at(s["up"], u)).alias("up"), F.zip_with(s["far"], s["up"], lambda f, u: f + at(s["far"], u)).alias("far"))
    deep = one.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.col("n") + 1)).cast("int")), start, turn))
    depth = deep.groupBy("key").agg(F.avg(F.array_max("s.far") + 1).alias("parse_depth_mean"))
    sub = F.sum(((F.col("pos") == "VERB") & F.col("dep").isin("advcl", "acl", "ccomp", "xcomp", "relcl")).cast("long"))
    ratio = parses.groupBy(F.col(key).alias("key")).agg(F.coalesce(F.try_divide(sub, F.sum((F.col("pos") == "VERB").cast("long"))), F.lit(0.0)).alias("subordinate_ratio"))
    return depth.join(ratio, "key").select(F.col("key").alias(key), "parse_depth_mean", "subordinate_ratio")
