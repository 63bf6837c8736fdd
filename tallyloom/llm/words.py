"""Words and word shingles of whole columns as 64-bit hashes, computed on the UTF-8 bytes.

A word is a run of bytes other than space and \\t..\\r; A-Z count as a-z. Its hash is a polynomial in
its bytes modulo 2**64, taken from prefix sums, then mixed. A shingle's hash mixes its words' hashes.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once, so that the work arrays stay in cache; a longer word is taken whole.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE, PIECE + 1), _powers(_INVERSE, PIECE + 1)


def _piece(data: np.ndarray, space: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one piece; `first` marks bytes where a text begins."""
    after = space.copy()
    after[1:] = space[:-1]
    after[0] = True
    starts = np.flatnonzero(~space & (after | first))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    closes = space | first
    bounds = np.flatnonzero(closes)
    at = np.searchsorted(bounds, starts, "right")
    ends = np.append(bounds, len(data))[at]
    n = len(data)
    powers = _POWERS if n <= PIECE else _powers(_BASE, n + 1)
    inverses = _INVERSES if n <= PIECE else _powers(_INVERSE, n + 1)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * inverses[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's words begin), texts given by bytes and offsets."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            cuts = np.flatnonzero(space[at + 1 : end] | first[at + 1 : end])
            if len(cuts):
                end = at + 1 + int(cuts[-1])
            else:
                more = np.flatnonzero(space[end:] | first[end:])
                end = end + int(more[0]) if len(more) else len(data)
        s, h = _piece(data[at:end], space[at:end], first[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, begins: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, where each text's begin): every run of `width` words of a text; of fewer
    words, the whole sequence as one shingle; of none, nothing. Repeats are still there."""
    counts = np.diff(begins)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_begins = np.concatenate([[0], np.cumsum(made)])
    scale = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(width)]
    out = np.zeros(out_begins[-1], np.uint64)
    owner = np.repeat(np.arange(len(counts)), made)
    source = np.arange(len(out)) - out_begins[:-1][owner] + begins[:-1][owner]
    size = np.minimum(counts, width)[owner]
    for j in range(width):
        if len(hashes):
            inside = size > j
            out += np.where(inside, hashes[np.minimum(source + j, len(hashes) - 1)] * scale[j], np.uint64(0))
    return mixed(out + size.astype(np.uint64)), out_begins
