"""Numpy helpers on the texts of one Arrow batch: bytes, words, hashes. No Spark here.

All functions work on the texts of a batch as one byte array with offsets, so there is no Python loop over words.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 never cut a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: The base of the polynomial hashes (modulo 2**64). Such hashes collide on built strings (Thue-Morse words), whatever the
#: base, so whoever uses them verifies what they call equal by its bytes.
BASE = 0x9E3779B97F4A7C15 | 5
#: Powers that a worker keeps; a longer text computes its own.
KEPT_POWERS = 1 << 20
_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1), or its inverses, modulo 2**64."""
    base = _INVERSE if inverse else BASE
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(KEPT_POWERS, n), np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) == KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of ``x`` and of ``seed``."""
    x = x ^ np.uint64((seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pairs (a, b) of hashes."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[t] * BASE ** t over t in [i, j)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the span stands."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its int64 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text_col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each; a longer text makes a slice of its own."""
    offsets = buffers(batch.column(text_col))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The inverse of ``buffers`` for texts without null."""
    large = pa.Array.from_buffers(
        pa.large_binary() if pa.types.is_binary(kind) else pa.large_string(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )
    return large.cast(kind)


class Words:
    """The words of a batch: ``start``, ``end`` (bytes), ``text`` (row of each word), ``first`` (first word of each row, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~SPACE[data]
        # a text that follows directly on another begins a new word
        begin = inside[1:-1] & ~inside[:-2]
        close = inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = inside[1:-1][edges]
        close[edges - 1] = inside[1:-1][edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(close) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word: its bytes go through the finaliser eight at a time. Seeds give independent hashes."""
        size = self.end - self.start
        out = mix(size.astype(np.uint64), 50 + seed)
        eight = eights(self.data)
        short = np.flatnonzero(size <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            short = short[size[short] > at]
            if not len(short):
                break
            block = eight[self.start[short] + at]
            beyond = np.maximum(at + 8 - size[short], 0).astype(np.uint64)
            out[short] = combined(out[short], block >> (np.uint64(8) * beyond))
        for i in np.flatnonzero(size > LONG_WORD):
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, person=b"%d" % seed)
            out[i] = np.frombuffer(digest.digest(), np.uint64)[0]
        return out

    def windows(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words within one text, and the hash of each.

        Hashes of 1, 2, 4 ... words are combined, so a window costs a logarithmic number of steps.
        """
        if len(self) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[size - 1 :] == self.text[: len(self) - size + 1])
        level, width, whole, done = hashes, 1, None, 0
        while True:
            if size & width:
                whole = level if whole is None else combined(whole[: len(level) - done], level[done:])
                done += width
            if 2 * width > size:
                return at, mix(whole[at], size)
            level = combined(level[:-width], level[width:])
            width *= 2

    def joined(self, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The texts as their words (those with the numbers ``kept``), joined by one space: bytes and offsets."""
        data = self.data.copy()
        kept = np.arange(len(self)) if kept is None else kept
        change = np.bincount(self.start[kept], minlength=len(data) + 1) - np.bincount(self.end[kept], minlength=len(data) + 1)
        keep = np.cumsum(change[:-1]) > 0
        # the byte before any but the first kept word of a text is a break: it becomes the space
        later = kept[1:][self.text[kept[1:]] == self.text[kept[:-1]]]
        data[self.start[later] - 1], keep[self.start[later] - 1] = 0x20, True
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[self.offsets]

    def digests(self) -> list[bytes | None]:
        """128 bits of BLAKE2 of the words of each text, None for a text without words."""
        data, offsets = self.joined()
        spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        return [hashlib.blake2b(data[a:b], digest_size=16).digest() if b > a else None for a, b in spans]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenated ranges start[i] .. start[i] + length[i] - 1."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


def covered(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``size`` places that begins at one of ``starts``."""
    change = np.bincount(starts, minlength=total + size + 1) - np.bincount(starts + size, minlength=total + size + 1)
    return np.cumsum(change[:total]) > 0


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros stand behind the end."""
    out = np.zeros(len(data) + 8, np.uint64)
    out[: len(data)] = data
    for step in (1, 2, 4):
        shifted = out << np.uint64(8 * step)
        shifted[:-step] |= out[step:]
        out = shifted
    return out
