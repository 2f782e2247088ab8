"""Words and their hashes, for whole Arrow batches at once.

A batch's texts are read as one byte array. Words are found with a byte class table, hashed with prefix
sums of ``TABLE[byte] * BASE**position`` (mod 2**64), so no Python object is made for a word. Two words
hash alike with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
BLOCK_BYTES = 2 << 20

_SPACES = np.zeros(256, bool)
_SPACES[list(SPACE_BYTES)] = True
_NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
SEPARATORS = {"space": _SPACES, "alnum": _NOT_ALNUM}
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0.. and BASE**-0.., n of each at least."""
    return _powers_of(1 << max(22, int(n).bit_length()))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums; ``(out[e] - out[s]) * BASE**-s`` identifies bytes s to e."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(TABLE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


class Block(NamedTuple):
    """Some consecutive rows: their bytes, each row's bounds, and each row's number in the batch."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


class Words(NamedTuple):
    """Per word: hash, first byte, byte after, row of the block; per row: first word and the one after the last."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    bounds: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and row bounds; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in pieces of about ``size`` bytes; a longer text is a block of its own."""
    if not len(column):
        return
    data, bounds = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield Block(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at)
        at = to


def spans(block: Block, separators: str = "space", lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's bytes (A-Z lower-cased if asked for), and each word's first byte and the byte after it."""
    data = LOWER[block.data] if lower else block.data
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SEPARATORS[separators][data], out=inside[:-1])
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = ~inside
    ends[1:] &= inside[:-1]
    ends[0] = False
    cuts = block.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts - 1]]
    starts[joined] = ends[joined] = True
    return data, np.flatnonzero(starts), np.flatnonzero(ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_hashes(data)
    return mix((sums[ends] - sums[starts]) * powers(len(data))[1][starts])


def words(block: Block, separators: str = "space", lower: bool = True) -> Words:
    """All words of a block; a word never spans two rows."""
    data, starts, ends = spans(block, separators, lower)
    bounds = np.searchsorted(starts, block.bounds)
    return Words(span_hashes(data, starts, ends), starts, ends, np.repeat(np.arange(block.rows), np.diff(bounds)), bounds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position that has k words after it (rows are not minded)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : i + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width <= 16:
        out = values[:n].copy()
        for i in range(1, width):
            np.minimum(out, values[i : i + n], out=out)
        return out
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
