"""Exact repeats of at least 100 bytes across all texts, by two-stage suffix sorting.

Every byte covered by a 100-byte string that also starts earlier (smaller id, or same row and earlier start) is removed.

1. Each 100-byte string has an anchor: of the 32-byte strings in it, the last of those with the least hash. Neighbouring
   starts share an anchor; such a run with the bytes it spans is a context. Equal strings have equal anchors, so only
   contexts with equal anchors can share any. Each task sums up equal contexts first: of these only the first is compared
   on, so a passage that is everywhere costs one row a chunk of text.
2. Contexts are grouped by anchor. All but the first of equal contexts are repeats. Where an anchor has different contexts,
   one of each is cut out of its text. A string holds 34 bytes on one side of its anchor at least, so contexts meet
   in groups by those 34 bytes, left and right.
3. The distinct cuts of a group are suffix-sorted in two stages: only suffixes smaller than their successor are
   sorted directly; the others follow by scanning the buckets of first bytes from the left, each suffix placing its
   predecessor. Adjacent common prefixes of 100 bytes then join equal strings, of which the first stays.
   A group of more than ``limit`` bytes is sorted in blocks, whose first strings meet by their 128-bit hash.

Repeats are staged tables; texts are shuffled twice, never gathered. Defined results: a null or empty text has no bytes and no
removals; texts under 100 bytes keep all; null ids come first; rows of one id and one text are one document (each gets the same
result, as though it were there once); rows of one id with different texts are apart, the one of lower text hash first; table gives an empty result; other columns are ignored. Equality of anchors and contexts is that of 64-bit
hashes of each (128 bits in all).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, mix64, narrow, ragged, release, stage, utf8

LENGTH = 100
GRAM = 32
SIDE = (LENGTH - GRAM) // 2
CHUNK = 4 << 20
LIMIT = 8 << 20
_LOWEST = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place, where there are so many."""
    h = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
    width = 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + (h[width:] ^ np.uint64(width))
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
            width *= 2
    return h


def anchors(h: np.ndarray) -> np.ndarray:
    """For each start of 100 bytes: the place of its anchor, the last least hash of the window."""
    window = LENGTH - GRAM + 1
    value, place, width = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * width <= window:
        later = value[width:] <= value[:-width]
        value = np.where(later, value[width:], value[:-width])
        place = np.where(later, place[width:], place[:-width])
        width *= 2
    rest = window - width
    return np.where(value[rest:] <= value[: len(value) - rest], place[rest:], place[: len(place) - rest])


def contexts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, first start within it, starts, anchor's offset from there, anchor hash, context hash."""
    sizes = np.diff(bounds)
    if len(data) < LENGTH or not (sizes >= LENGTH).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = gram_hashes(data)
    a = anchors(h)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    start = ragged(bounds[:-1], np.maximum(sizes - LENGTH + 1, 0))
    a = a[start]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])))
    n = np.diff(np.append(first, len(a)))
    text, start, a = text[first], start[first], a[first].astype(np.int64)
    with np.errstate(over="ignore"):
        last = start + n + LENGTH - 1 - GRAM  # where the context's last gram starts
        c = mix64((n.astype(np.uint64) << np.uint64(8)) + (a - start).astype(np.uint64))
        for j in range(0, 2 * LENGTH - GRAM, GRAM):
            c = mix64(c * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(start + j, last)])
    return text, start - bounds[:-1][text], n, a - start, h[a], c


def _emit(ids: np.ndarray, marks: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """Rows of a chunk: of equal contexts only the first takes part in the comparison; the others are repeats already."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    text, start, n, offset, k, c = contexts(data, bounds)
    order = np.lexsort((start, marks[text], ids[text], c, k))
    k_, c_ = k[order], c[order]
    head = np.ones(len(order), bool)
    head[1:] = (k_[1:] != k_[:-1]) | (c_[1:] != c_[:-1])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    repeat = np.zeros(len(order), bool)
    repeat[order] = (ids[text[order]] != ids[text[first]]) | (marks[text[order]] != marks[text[first]]) | (start[order] != start[first])
    with np.errstate(over="ignore"):
        spread = mix64(c + np.arange(len(c), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    what = (marks[text] << 16) | (n << 9) | (offset << 1) | repeat
    cols = [np.where(repeat, spread, k).view(np.int64), c.view(np.int64), ids[text], start, what]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["k", "c", "id", "start", "what"])


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        name, mark = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for i, t in enumerate(utf8(b.column(2))):
            if len(t) < LENGTH:
                continue
            ids.append(name[i])
            marks.append(mark[i])
            texts.append(t)
            size += len(t)
            if size >= CHUNK:
                yield _emit(np.array(ids, np.int64), np.array(marks, np.int64), texts)
                ids, marks, texts, size = [], [], [], 0
    if texts:
        yield _emit(np.array(ids, np.int64), np.array(marks, np.int64), texts)


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by k, c, id, mark, start: repeats (other 0), and the first of each context of an anchor that has several (other: the anchor)."""
    last = None  # anchor and context at hand, and the place of its first row
    seen, pending = 0, None  # contexts of the anchor at hand so far; its first row while it is the only one
    for b in batches:
        k, c, name, start, what = (x.to_numpy() for x in b.columns)
        if not len(k):
            continue
        mark = what >> 16
        new_k = np.append(last is None or k[0] != last[0], k[1:] != k[:-1])
        new_c = new_k | np.append(last is None or c[0] != last[1], c[1:] != c[:-1])
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(k)), -1))
        place = [np.where(head < 0, last[2 + j] if last else 0, x[np.maximum(head, 0)]) for j, x in enumerate((name, mark, start))]
        group = np.cumsum(new_k) - new_k[0]
        count = np.bincount(group, new_c).astype(np.int64)
        goes_on = not new_k[0]
        count[0] += seen if goes_on else 0
        repeat = (name != place[0]) | (mark != place[1]) | (start != place[2]) | (what & 1 == 1)
        several = new_c & (count[group] > 1) & ~repeat
        if pending is not None and goes_on and count[0] > 1:
            yield pending
        if not (goes_on and count[0] == 1):
            pending = None
        take = repeat | several
        if take.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (name, start, what, np.where(several, k, 0))], ["id", "start", "what", "other"])
        seen, last = int(count[-1]), (k[-1], c[-1], *(x[-1] for x in place))
        if seen == 1:
            at = np.flatnonzero(new_c & (group == group[-1]) & ~repeat)[:1]
            if len(at):
                pending = pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (name, start, what, k)], ["id", "start", "what", "other"])


def two_stage(s: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of s in order of their first ``depth`` values; s is of small numbers and ends with its only 0.

    A suffix is of the small kind if it is less than its successor. The small ones are sorted directly, 7 values at a
    time while there are ties. The rest are induced: scanning the buckets of first values from the left, each suffix
    whose predecessor is of the large kind puts that at the front of what is free in its bucket.
    """
    n, top = len(s), int(s.max()) + 1
    change = np.flatnonzero(np.append(s[:-1] != s[1:], True))
    run_end = np.repeat(change, np.diff(np.append(-1, change)))
    small = np.append(s, 0)[run_end + 1] > s[run_end]
    small[-1] = True  # the end itself comes first
    pad = np.append(s, np.zeros(depth + 8, s.dtype)).astype(np.int64)
    word = np.zeros(n + depth, np.int64)
    for j in range(7):
        word = word << 9 | pad[j : j + n + depth]
    order = np.flatnonzero(small)
    order = order[np.argsort(word[order], kind="stable")]
    tie = np.append(False, word[order[1:]] == word[order[:-1]])
    for at in range(7, depth, 7):
        if not tie.any():
            break
        group = np.cumsum(~tie)
        among = tie | np.append(tie[1:], False)
        i = np.flatnonzero(among)
        key = word[order[i] + at]
        by = np.lexsort((key, group[i]))
        order[i] = order[i][by]
        key = word[order + at]
        tie &= np.append(False, key[1:] == key[:-1])
    size = np.bincount(s, minlength=top)
    head = np.cumsum(size) - size
    large = np.bincount(s[~small], minlength=top)
    out = np.full(n, -1, np.int64)
    out[ragged(head + large, size - large)] = order  # small suffixes end their buckets
    free = head.copy()

    def induce(of: np.ndarray) -> None:
        p = of[of > 0] - 1
        p = p[~small[p]]
        if len(p):
            v = s[p]
            by = np.argsort(v, kind="stable")
            v, p = v[by], p[by]
            value, first, count = np.unique(v, return_index=True, return_counts=True)
            out[free[v] + np.arange(len(v)) - np.repeat(first, count)] = p
            free[value] += count

    for v in range(top):
        done, end = head[v], head[v] + large[v]
        while done < end:  # predecessors within the bucket itself come in rounds
            upto = free[v]
            induce(out[done:upto])
            done = upto
        induce(out[end : head[v] + size[v]])
    return out


def first_strings(segments: list[bytes], starts: list[int], ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every 100-byte string of the segments: segment, start within it, and whether an earlier one (ids, then starts) is equal."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 2
    bounds = np.append(0, np.cumsum(sizes + 1))
    raw[bounds[1:] - 1] = 1  # parts segments
    order = two_stage(np.append(raw, 0))
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    valid = np.append(np.arange(len(raw)) - bounds[text] + LENGTH <= sizes[text], False)
    order = order[valid[order]]
    equal = np.zeros(len(order), bool)
    if len(order) > 1:  # the common prefix of neighbours, 100 values or not
        same = np.arange(1, len(order))
        for j in range(LENGTH):
            same = same[raw[order[same] + j] == raw[order[same - 1] + j]]
            if not len(same):
                break
        equal[same] = True
    seg = text[order]
    at = np.array(starts, np.int64)[seg] + order - bounds[seg]
    group = np.cumsum(~equal)
    by = np.lexsort((at, marks[seg], ids[seg], group))
    g, place = group[by], (ids[seg][by], marks[seg][by], at[by])
    head = np.append(True, g[1:] != g[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    return seg[by], (order - bounds[seg])[by], np.logical_or.reduce([x != x[first] for x in place])


def _runs(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(id, mark, start, n) of consecutive starts."""
    out: list[tuple[int, int, int, int]] = []
    for i, m, s in sorted(rows):
        if out and out[-1][:2] == (i, m) and s <= out[-1][2] + out[-1][3]:
            if s == out[-1][2] + out[-1][3]:
                out[-1] = (i, m, out[-1][2], out[-1][3] + 1)
        else:
            out.append((i, m, s, 1))
    return out


def _cut(b: pa.RecordBatch) -> pa.RecordBatch:
    """The two sides of each context that is to be compared, under the hash of what a side must share."""
    from xxhash import xxh3_64_intdigest

    rows = []
    for name, mark, text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
        for x in cuts:
            start, n, a = x["start"], x["what"] >> 9 & 127, x["start"] + (x["what"] >> 1 & 255)
            other = x["other"].to_bytes(8, "little", signed=True)
            if a - SIDE >= start:
                part = text[start : min(start + n - 1, a - SIDE) + LENGTH]
                rows.append((xxh3_64_intdigest(other + b"L" + text[a - SIDE : a]) - (1 << 63), name, mark, start, part))
            if a + GRAM + SIDE <= start + n - 1 + LENGTH:
                low = max(start, a - SIDE)
                rows.append((xxh3_64_intdigest(other + b"R" + text[a + GRAM : a + GRAM + SIDE]) - (1 << 63), name, mark, low, text[low : start + n - 1 + LENGTH]))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["g", "id", "mark", "start", "part"])


def _compare(limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        def solve(rows: list[tuple[int, int, int, int, bytes]], whole: bool) -> pa.RecordBatch:
            """whole: the rows' groups are complete; else also what is first here, to meet other blocks'."""
            out: list[tuple[int, int, int]] = []
            least: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            distinct = []
            for g, i, m, s, part in sorted(rows):
                if least.setdefault((g, part), (i, m, s)) == (i, m, s):
                    distinct.append((g, i, m, s, part))
                else:
                    out += [(i, m, s + j) for j in range(len(part) - LENGTH + 1)]
            counts: dict[int, int] = {}
            for d in distinct:
                counts[d[0]] = counts.get(d[0], 0) + 1
            distinct = [d for d in distinct if counts[d[0]] > 1 or not whole]
            firsts: list[tuple[int, int, int, int, int]] = []
            if distinct:
                seg, at, repeat = first_strings([d[4] for d in distinct], [d[3] for d in distinct], np.array([d[1] for d in distinct], np.int64), np.array([d[2] for d in distinct], np.int64))
                for q, a in zip(seg[repeat].tolist(), at[repeat].tolist(), strict=True):
                    out.append((distinct[q][1], distinct[q][2], distinct[q][3] + a))
                if not whole:
                    for q, a in zip(seg[~repeat].tolist(), at[~repeat].tolist(), strict=True):
                        d = xxh3_128_digest(distinct[q][4][a : a + LENGTH])
                        firsts.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), distinct[q][1], distinct[q][2], distinct[q][3] + a))
            all_ = [(0, 0, i, m, s, n) for i, m, s, n in _runs(list(set(out)))] + [(*f, 0) for f in firsts]
            cols = list(zip(*all_, strict=True)) if all_ else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "id", "mark", "start", "n"])

        ready: list[tuple[int, int, int, int, bytes]] = []
        group: list[tuple[int, int, int, int, bytes]] = []
        ready_size, size, huge, at = 0, 0, False, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != at:
                    if huge and group:
                        yield solve(group, False)
                    elif len(group) > 1:
                        ready += group
                        ready_size += size
                        if ready_size >= limit // 4:
                            yield solve(ready, True)
                            ready, ready_size = [], 0
                    group, size, huge, at = [], 0, False, row[0]
                group.append(row)
                size += len(row[4])
                if size >= limit:
                    yield solve(group, False)
                    group, size, huge = [], 0, True
        if huge and group:
            yield solve(group, False)
        elif len(group) > 1:
            ready += group
        if ready:
            yield solve(ready, True)

    return run


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by a, b, id, mark, start: those after the first of their string."""
    last = first = None
    for b in batches:
        out = []
        for x, y, *place in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (x, y) != last:
                last, first = (x, y), place
            elif place != first:
                out.append((*place, 1))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "mark", "start", "n"])


def _cover(spans: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    """Byte ranges that strings from the given runs of starts cover, merged."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["start"] + x["n"] - 1 + LENGTH) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row a document: doc_id, n_bytes, spans (merged byte ranges removed), kept (the remaining bytes). Ids are whole numbers."""
    src = id_and_text(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    keyed = src.select(F.coalesce(F.col("id").cast("long"), F.lit(_LOWEST)).alias("id"), F.shiftright(F.xxhash64("text"), 17).alias("mark"), F.col("text"), F.col("id").isNull().alias("none"))
    found = keyed.select("id", "mark", "text").mapInArrow(_find, "k bigint, c bigint, id bigint, start bigint, what bigint")
    found = found.repartition("k").sortWithinPartitions("k", "c", "id", F.shiftright("what", 16), "start")
    judged = stage(found.mapInArrow(_judge, "id bigint, start bigint, what bigint, other bigint"), "contexts")
    mark, n = F.shiftright("what", 16).alias("mark"), F.shiftright("what", 9).bitwiseAND(127).alias("n")
    cuts = judged.where("other <> 0").groupBy("id", mark).agg(F.collect_list(F.struct("start", "what", "other")).alias("cuts"))
    parts = narrow(keyed.select("id", "mark", "text").join(cuts, ["id", "mark"]).select("id", "mark", "text", "cuts"), _cut, "g bigint, id bigint, mark bigint, start bigint, part binary")
    compared = parts.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(limit), "a bigint, b bigint, id bigint, mark bigint, start bigint, n bigint")
    compared = stage(compared, "strings")
    across = compared.where("n = 0").select("a", "b", "id", "mark", "start").repartition("a", "b").sortWithinPartitions("a", "b", "id", "mark", "start").mapInArrow(_across, "id bigint, mark bigint, start bigint, n bigint")
    runs = judged.where("other = 0").select("id", mark, "start", n).union(compared.where("n > 0").select("id", "mark", "start", "n")).union(across)
    runs = runs.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def remove(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(b.column(1))
        spans = [_cover(r) for r in b.column(2).to_pylist()]
        kept = []
        for t, cover in zip(texts, spans, strict=True):
            ends = [0, *(e for _, e in cover)]
            kept.append(b"".join(t[a:s] for a, s in zip(ends, [*(s for s, _ in cover), len(t)], strict=True)))
        cols = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"from": s, "to": e} for s, e in c] for c in spans], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "spans", "kept"])

    release(docs.sparkSession)
    back = keyed.join(runs, ["id", "mark"], "left").select(F.when(~F.col("none"), F.col("id")).cast(kind).alias("id"), "text", "runs")
    return narrow(back, remove, f"doc_id {kind}, n_bytes bigint, spans array<struct<`from`: bigint, `to`: bigint>>, kept binary")
