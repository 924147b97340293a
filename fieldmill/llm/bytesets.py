"""Vector work on the raw bytes of many texts at once: pieces of an Arrow column, words, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

SEPARATES = np.zeros(256, bool)
SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
#: Also marks: words are then runs of letters and digits of any alphabet.
SEPARATES_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers well mixed, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about `limit` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def text_runs(data: np.ndarray, offsets: np.ndarray, longest: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of runs, text of each run): a text of over `longest` bytes is cut behind white space, or at a code point, so
    that no run is much longer; where it is cut depends on the text alone."""
    sizes = np.diff(offsets)
    if not (sizes > longest).any():
        return offsets, np.arange(len(sizes))
    cuts, owner = [0], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a > longest:
            tail = data[a + longest // 2 : a + longest]
            fit = np.flatnonzero(SEPARATES[tail])
            if not len(fit):
                fit = np.flatnonzero((tail & 0xC0) != 0x80) - 1
            a += longest // 2 + int(fit[-1]) + 1
            cuts.append(a)
            owner.append(i)
        cuts.append(b)
        owner.append(i)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


class Powers:
    """Powers of the hash base and of its inverse, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE + 1)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return cls.up, cls.down


def word_hashes(data: np.ndarray, offsets: np.ndarray, separates: np.ndarray = SEPARATES) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, index of the first word of each text and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separates[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    up, down = Powers.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending; a text of fewer words than `size` has one shingle of them all."""
    words, first = word_hashes(data, offsets)
    mix = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        mix += words[k : k + len(mix)] * _PLACE[k]
    shingles = mixed(mix)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            s = np.sort(shingles[a : b - size + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            mix = words[a:b] * _PLACE[: b - a] if b - a <= len(_PLACE) else words[a:b]
            yield mixed(np.array([mix.sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
