"""Words of UTF-8 text, found and hashed a whole Arrow batch at a time.

A batch's texts lie end to end in one buffer, so one pass of array operations
over the bytes finds every word of every text.  Both word classes used by the
operators separate on ASCII bytes only, and every byte of a multi-byte
character is at least 0x80, so working on bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text.
NONALNUM = np.zeros(256, dtype=bool)
NONALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(n: int, _kept: list[np.ndarray] = [np.ones(1, dtype=np.uint64)]) -> np.ndarray:
    if len(_kept[0]) < n:
        steps = np.full(1 << (n - 1).bit_length(), _BASE, dtype=np.uint64)
        steps[0] = 1
        _kept[0] = np.multiply.accumulate(steps)
    return _kept[0]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's start in them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    _, at = buffer_of(batch.column(text))
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()


class Words:
    """The words of a column of texts.

    ``starts`` and ``ends`` are byte positions in ``data``; the words of row i
    are those numbered ``first[i]`` to ``first[i + 1]`` (exclusive).
    """

    def __init__(self, column: pa.Array, separators: np.ndarray, lower: bool = False):
        data, at = buffer_of(column)
        self.data, self.at = LOWER[data] if lower else data, at
        inside = ~separators[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
        after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, at)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        within = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        value = _BYTE[self.data[self._inside]] * _powers(int(lengths.max()))[within]
        return mix(np.add.reduceat(value, heads) + lengths.astype(np.uint64))

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """For each row the sorted distinct hashes of its runs of ``width`` words.

        A text of fewer words has one member, its whole sequence; one without
        words has none.
        """
        h, n = self.hashes(), len(self.starts)
        runs = np.zeros(max(0, n - width + 1), np.uint64)
        for i in range(width):
            runs += h[i : i + len(runs)] * _STEP[i]
        runs = mix(runs)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= width:
                out.append(distinct(runs[a : b - width + 1]))
            elif b > a:
                whole = (h[a:b] * _STEP[32 + np.arange(b - a) % 32]).sum(dtype=np.uint64, keepdims=True)
                out.append(mix(whole + np.array([b - a], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def fingerprint(members: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of hashes."""
    total = mix(members ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.array([len(members)], np.uint64) * U64(_BASE)).view(np.int64)[0])
