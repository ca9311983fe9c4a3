"""64-bit hashes of the tokens of Arrow text columns, whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd base: its powers can be undone modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Byte classes: 0 parts tokens, equal neighbours join. White space is 0x20 and 0x09-0x0D.
BY_SPACE = np.ones(256, dtype=np.uint8)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
#: The same with runs of ASCII marks as tokens of their own.
BY_MARK = BY_SPACE.copy()
BY_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != ord("_")]] = 2

#: Powers that a worker keeps, for texts of so many bytes.
KEPT_POWERS = 1 << 20
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(way: str, base: int, n: int) -> np.ndarray:
    held = _powers[way]
    if len(held) < n:
        held = np.full(max(n, KEPT_POWERS), base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= KEPT_POWERS:  # a longer text's are not worth a worker's memory
            _powers[way] = held
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a string column without copying; a null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(column: pa.Array, classes: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with A-Z lower-cased, n + 1 offsets of the rows' tokens)."""
    data, rows = text_bytes(column)
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(len(rows), dtype=np.int64)
    data = LOWER[data]
    kind = classes[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[rows] = True
    inside = kind != 0
    starts = np.flatnonzero(inside & cut[:-1])
    ends = np.flatnonzero(inside & cut[1:]) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("down", pow(BASE, -1, 1 << 64), len(data))[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, rows)


def shingles(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's runs of ``size`` words; of fewer words, of all; without words, none."""
    words, at = tokens(column)
    weights = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(size)]
    out = []
    n = len(words)
    runs = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size):
        runs += words[k : k + len(runs)] * np.uint64(weights[k])
    runs = mixed(runs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = sum((int(w) * k for w, k in zip(words[a:b], weights, strict=False)), (b - a) << 56) & MASK
            out.append(mixed(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
