"""Local image descriptors: cropped or edited copies in a binary column of images.

1. Images are decoded (PGM, PPM, or 8-bit grey or RGB PNG without interlace) and equal pixels collapse to the image of least id.
2. Corners: the Harris response on a pyramid of eleven scales, 2**0.125 apart, least suppressed, the ``per_tile`` strongest of each tile of
   24 pixels of each scale: so their number grows with the picture, and a part of it has the points it has in the whole.
   A point is turned by the direction of its patch's intensity centroid, and described by 256 comparisons of smoothed pixels.
3. Hamming tables: a descriptor is filed under nine parts of 28 of its bits, with 64 others beside. Points of a file that differ in
   more than ``_BESIDE`` of those are no pair: of points at the greatest distance that matches (``MATCH`` of 256) 99 in a hundred pass, of nearer ones all but a few. All points of
   a file are paired, so that no link depends on its size: at once in files of up to ``FEW`` points; in larger ones those of the ``CENTRES``
   images of least number with all others as they come, and the others with each other in a second turn.
4. Images are dealt into blocks of about ``limit`` points, and a task holds two blocks at a time with the tables of their points: pairs of images with ``votes`` points or more in common
   are verified there: matched points propose similarity transforms, and a copy needs ``inliers`` points that agree with one. So neither
   points, votes nor pairs are shuffled, only descriptors, and of what is linked each task tells an image's number of links and the least image
   that it reaches. Blocks meet in rounds, in each of which a descriptor is sent four times at most: the disk grows with the input,
   the time with its square. Linked images are joined to classes.

Tables find most, not all: of pairs that the verification accepts, the tests demand nine in ten for crops, noise, blur, brightness,
turns by 15 and 90 degrees, and scaling by 0.75 and 1.33. Defined results: null, empty, undecodable and empty (0 pixels) images have no
points and are alone in their class, but equal bytes among them share one; repeated rows share a class; null ids come after all others and
share the classes of their pixels; an empty table gives an empty result; other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import narrow, stage, through, unstage
from .components import components

PER_TILE = 2
INLIERS = 5
VOTES = 2
MATCH = 48
FEW = 24
CENTRES = 8
LIMIT = 200_000
_RADIUS = 11
_SCALES = tuple(2 ** (-i / 8) for i in range(11))
_TILE = 24
_PARTS, _PART, _BESIDE = 9, 28, 20
#: Pairs of points that are compared at once.
_BLOCK = 1 << 20
#: Rows of a table that are paired at once, and votes that are held before those of pairs with enough are dropped.
_ROWS, _HELD = 1 << 16, 1 << 22
#: Distances between blocks that meet in a round; each sends a descriptor twice.
_TURNS = 2


def write_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, np.uint8).tobytes()


def _png(raw: bytes) -> np.ndarray:
    at, data = 8, b""
    width = height = colour = 0
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in (0, 2) or laced:
                raise ValueError("a kind of PNG that isn't read")
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    c = 3 if colour == 2 else 1
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * c)
    out = np.zeros((height + 1, width + 1, c), np.int64)
    for y in range(height):
        line, how = rows[y, 1:].reshape(width, c).astype(np.int64), rows[y, 0]
        if how in (0, 2):
            out[y + 1, 1:] = (line + (out[y, 1:] if how == 2 else 0)) & 255
        elif how == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        else:
            for x in range(width):
                a, b, d = out[y + 1, x], out[y, x + 1], out[y, x]
                if how == 3:
                    p = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - d), abs(a - d), abs(a + b - 2 * d)
                    p = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, d))
                out[y + 1, x + 1] = (line[x] + p) & 255
    return out[1:, 1:].mean(axis=2)


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values, or None for what can't be read or has no pixels."""
    grey = None
    try:
        if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            grey = _png(raw)
        if raw and raw[:2] in (b"P5", b"P6"):
            kind, width, height, rest = raw.split(maxsplit=3)
            top, body = rest.split(b"\n", 1)
            width, height, c = int(width), int(height), 3 if kind == b"P6" else 1
            if int(top) == 255:
                grey = np.frombuffer(body, np.uint8, width * height * c).reshape(height, width, c).mean(axis=2)
    except (ValueError, zlib.error, struct.error, IndexError):
        pass
    return grey if grey is not None and grey.size else None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1, edges repeated."""
    p = np.pad(np.pad(x, r, mode="edge"), ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    w = 2 * r + 1
    h, v = x.shape
    return (p[w : w + h, w : w + v] - p[:h, w : w + v] - p[w : w + h, :v] + p[:h, :v]) / w**2


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, round(n * scale)) for n in x.shape)
    ys, xs = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    ys, xs = ys.clip(0, x.shape[0] - 1.001), xs.clip(0, x.shape[1] - 1.001)
    y, z = ys.astype(int), xs.astype(int)
    y1, z1 = np.minimum(y + 1, x.shape[0] - 1), np.minimum(z + 1, x.shape[1] - 1)
    a, b = (ys - y)[:, None], (xs - z)[None]
    return (x[np.ix_(y, z)] * (1 - a) + x[np.ix_(y1, z)] * a) * (1 - b) + (x[np.ix_(y, z1)] * (1 - a) + x[np.ix_(y1, z1)] * a) * b


@lru_cache(maxsize=1)
def _tests() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places in a patch, drawn once from a normal distribution, and the disc of the centroid."""
    rng = np.random.default_rng(7)
    pairs = np.clip(rng.normal(0, _RADIUS / 2.2, (256, 2, 2)), -_RADIUS * 0.7, _RADIUS * 0.7)
    y, x = np.mgrid[-_RADIUS : _RADIUS + 1, -_RADIUS : _RADIUS + 1]
    inside = y**2 + x**2 <= _RADIUS**2
    return pairs, y[inside], x[inside]


def features(grey: np.ndarray | None, per_tile: int = PER_TILE) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) in the image's own pixels, and descriptors of 32 bytes, of at most ``per_tile`` corners of each tile of each scale."""
    place: list[np.ndarray] = []
    bits: list[np.ndarray] = []
    pairs, py, px = _tests()
    for scale in _SCALES if grey is not None else ():
        im = _box(_resize(grey, scale) if scale != 1 else grey.astype(float), 1)
        h, w = im.shape
        edge = _RADIUS + 1
        if min(h, w) <= 2 * edge + 2:
            continue
        gy, gx = np.gradient(im)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        c = r[edge : h - edge, edge : w - edge]
        most = np.max([r[edge + i : h - edge + i, edge + j : w - edge + j] for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2)], axis=0)
        y, x = np.nonzero((c == most) & (c > 1e-6))
        if not len(y):
            continue
        tile = (y // _TILE) * (w // _TILE + 1) + x // _TILE
        order = np.lexsort((x, y, -c[y, x], tile))
        first = np.flatnonzero(np.append(True, np.diff(tile[order]) != 0))
        best = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < per_tile]
        y, x = y[best] + edge, x[best] + edge
        disc = im[y[:, None] + py, x[:, None] + px]
        angle = np.arctan2((disc * py).sum(axis=1), (disc * px).sum(axis=1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        u, v = pairs[None, :, :, 0], pairs[None, :, :, 1]
        soft = _box(im, 1)
        at = soft[np.rint(y[:, None, None] + u * sin + v * cos).astype(int), np.rint(x[:, None, None] + u * cos - v * sin).astype(int)]
        place.append(np.stack([(x + 0.5) / scale - 0.5, (y + 0.5) / scale - 0.5, np.full(len(x), 1 / scale), angle], axis=1))
        bits.append(np.packbits(at[:, :, 0] < at[:, :, 1], axis=1))
    if not place:
        return np.zeros((0, 4), np.float32), np.zeros((0, 32), np.uint8)
    return np.concatenate(place).astype(np.float32), np.concatenate(bits)


@lru_cache(maxsize=1)
def _order() -> np.ndarray:
    """A fixed order of a descriptor's bits, from which parts and what is beside them are cut."""
    return np.random.default_rng(1).permutation(256)


def filed(desc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each descriptor: its keys (one a part), and 64 bits beside each."""
    words = np.ascontiguousarray(np.packbits(np.unpackbits(desc, axis=1)[:, _order()], axis=1, bitorder="little")).view("<u8")

    def cut(at: int) -> np.ndarray:
        """64 bits from this place on, the first again after the last."""
        i, shift = at // 64 % 4, np.uint64(at % 64)
        return words[:, i] >> shift | words[:, (i + 1) % 4] << np.uint64(64) - shift if shift else words[:, i]

    keys = [np.int64(t) << _PART | (cut(_PART * t) & np.uint64((1 << _PART) - 1)).astype(np.int64) for t in range(_PARTS)]
    return np.stack(keys, axis=1), np.stack([cut(_PART * (t + 1)).view(np.int64) for t in range(_PARTS)], axis=1)


def share(da: np.ndarray, db: np.ndarray) -> int:
    """How many points of the first image have a partner of the second in a file; what the tables count, two images at a time."""
    (ka, ba), (kb, bb) = filed(da), filed(db)
    i, t, j = np.nonzero(ka[:, :, None] == kb.T[None])
    return len(np.unique(i[np.bitwise_count(ba[i, t] ^ bb[j, t]) <= _BESIDE]))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all descriptors in a from all in b."""
    x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    out = np.zeros((len(x), len(y)), np.int16)
    for i in range(4):
        out += np.bitwise_count(x[:, None, i] ^ y[None, :, i])
    return out


def agree(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray, least: int = 1) -> int:
    """How many matched points agree with the best similarity transform that one match proposes; 0 where fewer than ``least`` match."""
    if not len(da) or not len(db):
        return 0
    d = hamming(da, db)
    i, j = np.arange(len(da)), d.argmin(axis=1)
    ok = (d[i, j] <= MATCH) & (d.argmin(axis=0)[j] == i)
    if ok.sum() < max(1, least):
        return 0
    a, b = pa_[i[ok]].astype(float), pb[j[ok]].astype(float)
    turn, grow = b[:, 3] - a[:, 3], b[:, 2] / a[:, 2]
    cos, sin = np.cos(turn) * grow, np.sin(turn) * grow
    dx, dy = a[None, :, 0] - a[:, None, 0], a[None, :, 1] - a[:, None, 1]
    ex = b[:, None, 0] + cos[:, None] * dx - sin[:, None] * dy - b[None, :, 0]
    ey = b[:, None, 1] + sin[:, None] * dx + cos[:, None] * dy - b[None, :, 1]
    near = np.hypot(ex, ey) <= 2.5 * np.maximum(1, grow)[:, None] + 0.05 * np.hypot(dx, dy) * grow[:, None]
    return int(near.sum(axis=1).max())


def _votes(u: np.ndarray, p: np.ndarray, v: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Distinct (a, b, point of a) of pairs of points (image, point), a the lesser image."""
    less = u < v
    e = np.unique(np.stack([np.where(less, u, v), np.where(less, v, u), np.where(less, p, q)], axis=1)[u != v], axis=0)
    return [np.ascontiguousarray(e[:, i]) for i in range(3)]


_ROW = ["key", "image", "point", "beside"]


def _batch(votes: list[np.ndarray], rows: list[np.ndarray], centre: int = 0) -> pa.RecordBatch:
    """Votes, and rows of large files, the first ``centre`` of them of centres; either lacks the other's columns."""
    n, m = len(votes[0]), len(rows[0])
    left = [pa.concat_arrays([pa.array(c), pa.nulls(m, pa.int64())]) for c in votes]
    right = [pa.concat_arrays([pa.nulls(n, c.type), c]) for c in [*map(pa.array, rows), pa.array(np.arange(m) < centre)]]
    return pa.RecordBatch.from_arrays([*left, *right], ["a", "b", "vote", *_ROW, "centre"])


def _near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, image, point, beside) sorted by key and image: votes in small files and for centres of large ones, and the rows of these.

    Of a file that goes on in the next batch, no more is held than a small file has, or the points of its centres.
    """
    none = [np.zeros(0, np.int64)] * 4

    def few(cols: list[np.ndarray]) -> list[np.ndarray]:
        key, image, point, beside = cols
        out: list[list[np.ndarray]] = [[c] for c in none]
        for step in range(1, min(FEW, len(key))):
            i = np.flatnonzero((key[step:] == key[:-step]) & (image[step:] != image[:-step]))
            i = i[np.bitwise_count((beside[i] ^ beside[i + step]).view(np.uint64)) <= _BESIDE]
            for o, x in zip(out, (image[i], point[i], image[i + step], point[i + step]), strict=True):
                o.append(x)
        return _votes(*map(np.concatenate, out))

    def many(new: list[np.ndarray], centres: list[np.ndarray]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[c] for c in none]
        for image, point, beside in zip(*centres[1:], strict=True):
            i = np.flatnonzero((np.bitwise_count((new[3] ^ beside).view(np.uint64)) <= _BESIDE) & (new[1] != image))
            for o, x in zip(out, (new[1][i], new[2][i], np.full(len(i), image), np.full(len(i), point)), strict=True):
                o.append(x)
        return _votes(*map(np.concatenate, out))

    def centred(cols: list[np.ndarray]) -> list[np.ndarray]:
        """The points of a file's first images."""
        seen = np.cumsum(np.append(True, cols[1][1:] != cols[1][:-1]))
        return [c[seen <= CENTRES] for c in cols]

    held, large = [c[:0] for c in none], False
    for r in batches:
        if not r.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in r.columns]
        if large:
            n = int(np.searchsorted(cols[0], held[0][0], side="right"))
            if n:
                new = [c[:n] for c in cols]
                yield _batch(many(new, held), new)
            if n == len(cols[0]):
                continue
            held, large, cols = [c[:0] for c in none], False, [c[n:] for c in cols]
        cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        first = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
        size = np.diff(np.append(first, len(cols[0])))
        for g in np.flatnonzero(size[:-1] > FEW):  # the last file may go on
            rows = [c[first[g] : first[g] + size[g]] for c in cols]
            start = centred(rows)
            yield _batch(many(rows, start), rows, len(start[0]))
        small = np.repeat((size > 1) & (size <= FEW), size)
        small[first[-1] :] = False
        yield _batch(few([c[small] for c in cols]), [c[:0] for c in none])
        held = [c[first[-1] :] for c in cols]
        start = centred(held)
        large = size[-1] > FEW and len(start[0]) < size[-1]  # all points of its centres have come
        if large:
            yield _batch(many(held, start), held, len(start[0]))
            held = start
    if not large and len(held[0]) > FEW:
        start = centred(held)
        yield _batch(many(held, start), held, len(start[0]))
    elif not large:
        yield _batch(few(held), [c[:0] for c in none])


def _rest(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Votes between different images of each file of rows (key, image, point, beside)."""
    order = np.argsort(cols[0], kind="stable")
    key = cols[0][order]
    for file in np.split(order, np.flatnonzero(key[1:] != key[:-1]) + 1):
        image, point, beside = (c[file] for c in cols[1:])
        step = max(1, _BLOCK // max(1, len(file)))
        for at in range(0, len(file), step):
            i, j = np.nonzero((image[at : at + step, None] != image[None, at:]) & (np.bitwise_count((beside[at : at + step, None] ^ beside[None, at:]).view(np.uint64)) <= _BESIDE))
            i, j = i[i < j] + at, j[i < j] + at
            yield _votes(image[i], point[i], image[j], point[j])


def _tried(desc: np.ndarray, image: np.ndarray, point: np.ndarray, side: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of images with enough points in common, from the tables of these points, sorted by image; where images have sides, only pairs of both."""
    n, places, apart = int(image.max()) + 1, int(point.max()) + 1, bool(side.any())
    keys, beside = filed(desc)
    enough, held, size, most = np.zeros(0, np.int64), [np.zeros(0, np.int64)], 0, _HELD

    def add(a: np.ndarray, b: np.ndarray, vote: np.ndarray) -> None:
        """Of a pair with enough votes, only the pair is kept."""
        nonlocal size
        keep = side[a] != side[b] if apart else slice(None)
        held.append((a[keep] * n + b[keep]) * places + vote[keep])
        size += len(held[-1])
        if size > most:
            drop()

    def drop() -> None:
        nonlocal enough, held, size, most
        codes = np.unique(np.concatenate(held))
        pair, count = np.unique(codes // places, return_counts=True)
        enough = np.union1d(enough, pair[count >= votes])
        held = [codes[~np.isin(codes // places, enough)]]
        size = len(held[0])
        most = max(_HELD, 2 * size)

    for t in range(_PARTS):
        order = np.argsort(keys[:, t], kind="stable")
        key, of = keys[order, t], side[image[order]]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.maximum.reduceat(of, first) != np.minimum.reduceat(of, first) if apart else np.diff(np.append(first, len(key))) > 1
        order = order[np.repeat(several, np.diff(np.append(first, len(key))))]
        rows = [c[order] for c in (keys[:, t], image, point, beside[:, t])]
        large: list[list[np.ndarray]] = [[c[:0]] for c in rows]
        slices = (pa.RecordBatch.from_arrays([pa.array(c[at : at + _ROWS]) for c in rows], _ROW) for at in range(0, len(order), _ROWS))
        for r in _near(slices) if len(order) else ():
            add(*(c.drop_null().to_numpy() for c in r.columns[:3]))
            more = r.filter(pc.and_(r.column("a").is_null(), pc.invert(r.column("centre"))))
            for o, c in zip(large, more.columns[3:7], strict=True):
                o.append(c.to_numpy())
        for got in _rest([np.concatenate(c) for c in large]):
            add(*got)
    drop()
    return enough // n, enough % n


def _least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of n numbers that each reaches by the links (i, j)."""
    found, before = np.arange(n), None
    while before is None or (found != before).any():
        before = found.copy()
        low = np.minimum(found[i], found[j])
        for k in (i, j):
            np.minimum.at(found, before[k], low)
            np.minimum.at(found, k, low)
        found = found[found]
    return found


def _meet(batches: Iterable[pa.RecordBatch], votes: int, inliers: int) -> Iterator[pa.RecordBatch]:
    """Of rows (pair, side, node, features) sorted by pair, those of one pair of blocks held at a time: (a, b, n) for each linked image, the least image that it reaches, and its links."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by("node")
        node, side, blobs = t.column("node").to_numpy(), t.column("side").to_numpy(), t.column("features").to_pylist()
        sizes = [len(f) // 48 for f in blobs]
        place = [np.frombuffer(f, "<f4", 4 * k).reshape(k, 4) for f, k in zip(blobs, sizes, strict=True)]
        desc = [np.frombuffer(f, np.uint8, 32 * k, 16 * k).reshape(k, 32) for f, k in zip(blobs, sizes, strict=True)]
        i, j = _tried(np.concatenate(desc), np.repeat(np.arange(len(node)), sizes), np.concatenate([np.arange(k) for k in sizes]), side, votes)
        linked = np.array([agree(place[a], desc[a], place[b], desc[b], inliers) >= inliers for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[linked], j[linked]
        n = np.bincount(np.concatenate([i, j]), minlength=len(node))
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[_least(i, j, len(node))[some]]), pa.array(n[some].astype(np.int64))], ["a", "b", "n"])

    held: list[pa.RecordBatch] = []
    for r in batches:
        pair = r.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), r.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x < y and held and held[0].column(0)[0].as_py() != pair[x]:
                yield solve(pa.Table.from_batches(held))
                held = []
            if x < y:
                held.append(r.slice(x, y - x))
    if held:
        yield solve(pa.Table.from_batches(held))


def _rounds(images: DataFrame, blocks: int) -> Iterator[tuple[DataFrame, int]]:
    """Rows (pair, side, node, features) of the pairs of blocks of each round, and the number of these: every two blocks meet once.

    Side is 1 or 2 where two blocks meet, 0 where one meets itself.
    """
    x = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    for at in range(0, blocks // 2 + 1, _TURNS):
        roles = []
        for k, apart in enumerate(range(at, min(at + _TURNS, blocks // 2 + 1))):
            first = F.struct((F.lit(k * blocks) + x).alias("pair"), F.lit(min(apart, 1)).alias("side"))
            second = F.struct((F.lit(k * blocks) + (x - apart + blocks) % blocks).alias("pair"), F.lit(2).alias("side"))
            if 2 * apart == blocks:  # two blocks at this distance meet from either side
                roles.append(F.when(x < apart, first).otherwise(second))
            else:
                roles += [first, second] if apart else [first]
        yield images.select("node", "features", F.explode(F.array(*roles)).alias("r")).select("r.pair", "r.side", "node", "features"), _TURNS * blocks


def find_copies(images: DataFrame, *, id_col: str, image_col: str, per_tile: int = PER_TILE, inliers: int = INLIERS, votes: int = VOTES, limit: int = LIMIT) -> DataFrame:
    """One row an image: id, n_points, class_id (least id of its class; null for a class of null ids), n_links (verified links of its pixels)."""
    src = images.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{image_col}`").cast("binary").alias("image"))
    kind = src.schema["id"].dataType.simpleString()

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        keys, sizes, blobs = [], [], []
        for raw in b.column(1).to_pylist():
            grey = decode(raw)
            seen = xxh3_128_digest(b"pixels%dx%d" % grey.shape + grey.astype("<f8").tobytes() if grey is not None else b"bytes" + (raw or b""))
            where, desc = features(grey, per_tile)
            keys.append(seen)
            sizes.append(len(where))
            blobs.append(where.astype("<f4").tobytes() + desc.tobytes())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["id", "pixels", "n_points", "features"])

    every = stage(narrow(src, digest, f"id {kind}, pixels binary, n_points bigint, features binary"), "descriptors")
    one = every.groupBy("pixels").agg(F.min("id").alias("least"), F.first("features").alias("features"))
    one = stage(one.withColumn("node", F.monotonically_increasing_id()), "images")
    whole, every = every, stage(every.select("id", "n_points", "pixels"), "pixels-of")  # features are kept once
    unstage(whole)

    shown = one.where(F.octet_length("features") > 0)
    n, points = shown.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("features")), F.lit(0)) / 48).first()
    blocks = max(1, min(n, math.ceil(points / limit)))
    links: list[DataFrame] = []
    for rows, pairs in _rounds(shown.select("node", "features"), blocks):
        rows = rows.repartitionById(pairs, "pair").sortWithinPartitions("pair")
        links.append(stage(through(rows, lambda b: _meet(b, votes, inliers), "a bigint, b bigint, n bigint"), "links"))
    linked = reduce(DataFrame.union, links)
    roots = components(linked.select("a", "b"))
    degree = linked.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    named = one.join(roots, "node", "left").join(degree, "node", "left").select("pixels", "least", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = stage(named, "classes")
    unstage(*links)
    least = stage(named.groupBy("root").agg(F.min("least").alias("class_id")), "class-ids")
    known = stage(named.join(least, "root").select("pixels", "class_id", "n_links"), "pixels")
    return every.select("id", "n_points", "pixels").join(known, "pixels").select("id", "n_points", "class_id", "n_links")


@lru_cache(maxsize=2)
def _patterns(n: int, side: int) -> np.ndarray:
    """A fixed smooth random pattern for each of n numbers."""
    noise = np.random.default_rng(11).normal(0, 1, (n, side, side))
    out = np.stack([_box(x, 1) for x in noise])
    return (out / out.std(axis=(1, 2), keepdims=True)).reshape(n, -1)


def render(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 72) -> DataFrame:
    """A picture (PGM) of each vector: the sum of fixed patterns weighted by its numbers; near vectors look alike. Null stays null."""
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def draw(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for v in b.column(1).to_pylist():
            if v is None or not v:
                out.append(None)
                continue
            x = np.nan_to_num(np.array([0.0 if y is None else y for y in v]))
            grey = (x / max(float(np.sqrt((x * x).sum())), 1e-12)) @ _patterns(len(x), side)
            out.append(write_pgm(np.clip(np.rint(128 + 40 * grey), 0, 255).reshape(side, side)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "image"])

    return narrow(src, draw, f"id {src.schema['id'].dataType.simpleString()}, image binary")
