"""Vectorised text primitives over Arrow string buffers.

All helpers work on the raw UTF-8 bytes of a whole batch at once, so the cost per
byte is a few array passes and no Python object is made per word.  White space
is always the ASCII set ``[\\x20\\x09-\\x0D]``; lower-casing touches A-Z only.
Neither can split a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one vectorised step; a longer single text is one step.  The arrays of a step fit the cache.
STEP_BYTES = 1 << 18

#: Bytes whose words are hashed at a time.
SPAN = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + (1 << 15))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and n+1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole, offsets - (offsets[0] if len(offsets) else 0)


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes (one row at least)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets = flat(texts)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


class Words:
    """Words of a batch: byte ranges, owner row, and 64-bit hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        raw, self.offsets = flat(texts)
        self.raw = LOWER[raw] if lower else raw
        n = len(self.offsets) - 1
        white = WHITE[raw]
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[self.offsets] = True  # a row's first byte never continues the word before it
        inside = ~white
        after = np.empty(len(raw), dtype=bool)
        if len(raw):
            after[0] = True
            after[1:] = white[:-1]
        self.starts = np.flatnonzero(inside & (after | cut[:-1]))
        nxt = np.ones(len(raw), dtype=bool)
        if len(raw):
            nxt[:-1] = white[1:]
        self.ends = np.flatnonzero(inside & (nxt | cut[1:])) + 1
        first = np.searchsorted(self.starts, self.offsets)
        self.first = first  # n+1 offsets into the words
        self.counts = np.diff(first)
        self.row = np.repeat(np.arange(n), self.counts)

    def hashes(self) -> np.ndarray:
        """Hash of each word's bytes; equal words have equal hashes.  A span of the bytes at a time, so a long text takes no more."""
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + SPAN)))
            lo, hi = int(self.starts[a]), int(self.ends[b - 1])
            up, down = _power(hi - lo + 1)
            run = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((self.raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=run[1:])
            start = self.starts[a:b] - lo
            out[a:b] = mix((run[self.ends[a:b] - lo] - run[start]) * down[start])
            a = b
        return out

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every window of ``size`` words that lies in one row."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        value = h[start]
        for k in range(1, size):
            value = mix(value * _BASE + h[start + k])
        return start, value


def code_points(raw: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte position (len+1)."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
