"""Hashes of the words of texts, a column at a time.

Words are runs of bytes other than ASCII white space, A-Z taken as a-z.  The hash of a word is
a polynomial in its bytes, each mapped to a random number: a running sum over the bytes gives
the hashes of all words of a column by two subtractions each, without a Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time: bounds the arrays, whatever the texts.
CHUNK_BYTES = 1 << 17
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_BASE = 0xD1342543DE82EF95

_values = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_values[65:91] = _values[97:123]
blank = np.zeros(256, dtype=bool)
blank[[9, 10, 11, 12, 13, 32]] = True
_values[blank] = 0


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MULTIPLIERS[1])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MULTIPLIERS[2])
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def reach(self, size: int) -> None:
        while len(self.up) < size:
            n = len(self.up)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * np.uint64(pow(base, n, 1 << 64))]))


_powers = _Powers()


def _hash_chunk(raw: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words in a piece of bytes; ``opens`` are row starts in it."""
    filled = ~blank[raw]
    fresh = np.ones(len(raw), dtype=bool)
    fresh[1:] = ~filled[:-1]
    fresh[opens] = True
    first = np.flatnonzero(filled & fresh)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), first
    _powers.reach(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_values[raw] * _powers.up[: len(raw)], out=sums[1:])
    # Blanks add nothing, so a word's sum runs to the next word's start.
    last = np.append(first[1:], len(raw))
    return mixed((sums[last] - sums[first]) * _powers.down[first]), first


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def ends_of(raw: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words that begin at ``first`` end: at a blank or the end of their text."""
    blanks = np.append(np.flatnonzero(blank[raw]), len(raw))
    return np.minimum(blanks[np.searchsorted(blanks, first)], offsets[np.searchsorted(offsets, first, "right")])


def hash_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in turn, how many words each text has (nulls have none), and the
    places where the words begin among the bytes of the column."""
    return hash_bytes(*bytes_of(column))


def hash_bytes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash_words`` of the bytes of texts that follow each other."""
    texts = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(texts, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found, places, begin = [], [], 0
    while begin < len(raw):
        end = min(begin + CHUNK_BYTES, len(raw))
        while end < len(raw) and not blank[raw[end]]:
            # Not inside a word: back to the last blank or row start, else on to the next.
            blanks = np.flatnonzero(blank[raw[begin:end]])
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            back = max(int(blanks[-1]) + begin + 1 if len(blanks) else begin, row)
            if back > begin:
                end = back
                break
            end = min(end + CHUNK_BYTES, len(raw))
        opens = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin
        hashes, first = _hash_chunk(raw[begin:end], opens)
        found.append(hashes)
        places.append(first + begin)
        begin = end
    at = np.concatenate(places)
    rows = np.searchsorted(offsets, at, "right") - 1
    return np.concatenate(found), np.bincount(rows, minlength=texts), at
