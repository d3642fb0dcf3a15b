"""Words of a column of texts as numbers: Arrow splits at ASCII white space and numbers what is distinct."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import mix64

#: Bytes of text handled at once; a longer text is a piece of its own.
PIECE = 1 << 20


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[pa.Array]:
    """The column in consecutive slices of about ``size`` bytes, null as empty."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield column.slice(at, upto - at)
        at = upto


def coded(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of all words in the vocabulary, where each text's begin (and the end), and the vocabulary; A to Z in lower case if asked.

    Words are runs of bytes other than the six ASCII characters of white space.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    known = split.values.dictionary_encode()
    codes, bounds = known.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    empty = pc.index(known.dictionary, "").as_py()
    if empty >= 0:  # stands at the ends of texts
        there = codes != empty
        bounds = np.append(0, np.cumsum(there))[bounds]
        codes = codes[there]
    return codes, bounds, known.dictionary


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and where each string begins (and the end)."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.append(0, np.cumsum(size))
    _, offsets, data = column.buffers()
    if data is None:
        return np.zeros(0, np.uint8), bounds
    start = np.frombuffer(offsets, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8)[start : start + bounds[-1]], bounds


def spelled(data: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string, from its bytes and their places in it."""
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(mix64((place.astype(np.uint64) << np.uint64(8) | data) + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))
        return mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    data, bounds = raw(words)
    return spelled(data, np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds)), bounds)
