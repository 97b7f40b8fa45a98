"""Byte-level text work on whole Arrow batches: words, hashes, sentence bounds. NumPy only, no loop per character.

A text's UTF-8 bytes are used in place. Hashes are polynomial prefix sums modulo 2**64 over random byte values, so the hash
of any byte range costs two look-ups; a final mix spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(RADIX, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space that the contracts name: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """RADIX**i (or its inverse) for i < n; grown to the longest block seen."""
    if len(_powers[kind]) < n:
        size = max(n, 1 << 20)
        p = np.full(size, RADIX if kind == "up" else _INVERSE, np.uint64)
        p[0] = 1
        _powers[kind] = np.multiply.accumulate(p)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets (n + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def blocks(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def value_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of value * RADIX**k over i <= k < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``value_sums`` of bytes."""
    return value_sums(BYTE_VALUE[data])


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of byte ranges."""
    return (sums[end] - sums[start]) * powers(len(sums), "down")[start]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True; no run crosses a position in ``bounds`` (row offsets)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def exact_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, letters as they are."""
    start, end = runs(~IS_SPACE[data], bounds)
    return mix(range_hash(prefix_sums(data), start, end) + (end - start).astype(np.uint64)), start, end, np.searchsorted(start, bounds)


def released(run):
    """A function of batches that gives Arrow's unused memory back to the system when it ends: idle workers would keep it for long."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def unused(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(columns: list[str]) -> list[str]:
    """Names by place, for calls that take no name with a dot."""
    return [f"c{i}" for i in range(len(columns))]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows: their hashes (A-Z lower-cased), starts, ends, and per row the range of its words (n + 1)."""
    start, end = runs(~IS_SPACE[data], bounds)
    h = mix(range_hash(prefix_sums(LOWER[data]), start, end) + (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(start, bounds)
