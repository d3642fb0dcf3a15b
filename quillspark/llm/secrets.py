"""Secret scan: three patterns of known form, and a battery of randomness tests for the rest.

Candidates of the battery are the maximal runs of 20 or more characters of an encoding's alphabet, inferred in this order: hex (either
case), base32, base64 and its URL form; numerals alone are none. A run that mixes the last two has parts in either. Under the null hypothesis a candidate is ordinary writing: its characters come
independently from the corpus's own distribution over that alphabet, learned from all texts. Three statistics are held
against that null by their normal approximations, all small or all large when characters are uniform:

* chi-squared distance from uniformity over the alphabet (a random string's is small);
* runs of the two classes letter and not letter (a random string has many);
* serial correlation: the lag-one product of deviations of character ranks, and the share of repeated neighbours,
  which must not be large (a counter or a repeated word is not random).

The p-values of the first two are combined by Stouffer's rule with equal weights, and the third by the intersection-union rule: the
combined value is the greatest of theirs, and 1 where the third test rejects independence of neighbours, or chi-squared
uniformity itself. A value that only grows stays valid. False discoveries are controlled by
Benjamini and Hochberg's step-up rule over all candidates tested, within classes of length (20-23, 24-31, 32-47, 48-79, 80 and more), each at level ``rate``:
long ordinary tokens therefore cannot pay for short doubtful ones. The rule runs on counts of p-values in 2,048 bins of
their logarithm, rounded up, so what is gathered is bounded and the rule only gets stricter.

Two narrow passes read the texts (null distribution; candidates and patterns); found candidates are staged. Defined results: a
null or empty text has no spans; a very long text is searched whole; repeated rows get a row each and count each time; an empty table gives none; other columns are
ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, narrow, stage, strings, through, utf8

RATE = 0.01
SHORTEST = 20
BINS = 2048
#: The patterns of known form, in the order in which ties are listed, and how long what they find must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
#: Alphabets of encodings, in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
_BOTH = re.compile("[+/]"), re.compile("[_-]")
_PARTS = re.compile("[A-Za-z0-9+/]{20,}"), re.compile("[A-Za-z0-9_-]{20,}")
_EDGES = (20, 24, 32, 48, 80)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the three patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # greedy runs: the long ones are whole runs
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of what may be encoded: whole runs of one alphabet; of a run that mixes both forms of base64, the longest parts in either."""
    for m in _CANDIDATE.finditer(text):
        run = m[0].rstrip("=")
        if not (_BOTH[0].search(run) and _BOTH[1].search(run)):
            yield m.start(), m.end()
            continue
        parts = {(m.start() + p.start(), m.start() + p.end()) for form in _PARTS for p in form.finditer(run)}
        last = 0
        for s, e in sorted(parts, key=lambda p: (p[0], -p[1])):
            if e > last:  # else within the one before
                last = e
                yield s, m.end() if e == m.start() + len(run) else e


def encoding(token: str) -> str | None:
    """The first alphabet that has all of a token's characters."""
    chars = set(token)
    return next((k for k, a in ALPHABETS.items() if chars <= set(a)), None)


def _tail(z: float) -> float:
    """Chance of a standard normal value of z or more."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def p_value(token: str, kind: str, null: np.ndarray) -> float:
    """How likely ordinary writing of this length looks as random as the token. null: 256 counts of bytes in the corpus."""
    alphabet = ALPHABETS[kind]
    k, n = len(alphabet), len(token)
    q = null[[ord(c) for c in alphabet]] + 1.0
    q = q / q.sum()
    at = {c: i for i, c in enumerate(alphabet)}
    x = np.array([at[c] for c in token])
    f = np.bincount(x, minlength=k)
    # sum of f squared under the null: its mean and variance for a multinomial distribution
    s2, s3 = (q**2).sum(), (q**3).sum()
    mean = n + n * (n - 1) * s2
    var = 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2**2)
    z_uniform = (mean - (f.astype(float) ** 2).sum()) / math.sqrt(max(var, 1e-9))
    letter = np.array([c.isalpha() for c in alphabet])
    p = float(q[letter].sum())
    turns = int((letter[x][1:] != letter[x][:-1]).sum())
    a = 2 * p * (1 - p)
    z_runs = (turns - (n - 1) * a) / math.sqrt(max((n - 1) * a * (1 - a) + 2 * (n - 2) * (p * (1 - p) - a * a), 1e-9))
    d = x - x.mean()
    serial = (d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9)
    z_serial = (serial + 1 / n) * math.sqrt(n)
    same = int((x[1:] == x[:-1]).sum())
    z_same = (same - (n - 1) / k) / math.sqrt((n - 1) / k * (1 - 1 / k))
    chi = k / n * float((f.astype(float) ** 2).sum()) - n
    z_chi = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    if abs(z_serial) > 3.29 or z_same > 4.5 or z_chi > 4.5:
        return 1.0
    return _tail((z_uniform + z_runs) / math.sqrt(2))


def length_class(n: int) -> int:
    return sum(n >= e for e in _EDGES)


def byte_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each byte stands in all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for t in utf8(b.column(0)):
                total += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["byte", "n"])

    src = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    out = np.zeros(256)
    for r in through(src, run, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row a document: doc_id, and spans: an array of (start, kind, end) by start, then kind, then end; kind is a pattern's or ``random``."""
    null = byte_counts(docs, text_col)
    src = id_and_text(docs, id_col, text_col)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        base, more = [], []
        for t in strings(b.column(1)):
            spans = base_spans(t)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            found = []
            for start, end in candidates(t):
                token = t[start:end].rstrip("=")
                kind = encoding(token)
                if kind and not token.isdigit() and not any(s < end and start < e for s, _, e in spans):
                    p = p_value(token, kind, null)
                    found.append({"start": start, "end": end, "bin": math.floor(-8 * math.log2(max(p, 1e-300))), "size": length_class(len(token))})
            more.append(found)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _BASE), pa.array(more, _MORE)], ["id", "base", "more"])

    kind = src.schema["id"].dataType.simpleString()
    found = stage(narrow(src, batch, f"id {kind}, base array<struct<start: int, kind: int, `end`: int>>, more array<struct<start: int, `end`: int, bin: int, size: int>>"), "secrets")
    # step-up rule: the weakest bin whose upper p-value, 2 ** (-bin / 8), is at most rate * rank / number of candidates tested
    each = found.select(F.explode("more").alias("c")).select("c.size", F.least(F.col("c.bin"), F.lit(BINS)).alias("bin")).groupBy("size", "bin").count().collect()
    limits: dict[int, int] = {}
    for size in {r.size for r in each}:
        bins = sorted(((r.bin, r["count"]) for r in each if r.size == size), reverse=True)
        total, rank = sum(n for _, n in bins), 0
        for bin_, n in bins:
            rank += n
            if 2.0 ** (-bin_ / 8) <= rate * rank / total:
                limits[size] = bin_
    test = lambda c: _passes(c, limits)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    extra = F.transform(F.filter("more", test), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    return found.select(F.col("id").alias("doc_id"), F.array_sort(F.concat(base, extra)).alias("spans"))


def _passes(c: F.Column, limits: dict[int, int]) -> F.Column:
    out = F.lit(False)
    for size, least in limits.items():
        out = out | ((c["size"] == size) & (c["bin"] >= least))
    return out


def listed(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_MORE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bin", pa.int32()), ("size", pa.int32())]))
