"""Words and lines of many texts at once, hashed in numpy.

Texts are joined with a newline between them.  A segment's hash is a polynomial over random byte
values modulo 2**64, read off one running sum: ``(S[end] - S[start]) * R**-start``; the inverse of
the odd R exists, so no segment is visited on its own.  The sum runs over blocks of BLOCK bytes and is kept
only where a segment starts or ends, so a long text costs a few bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_R = 0xD6E8FEB86659FD93
_R_INVERSE = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
BLOCK = 1 << 17


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i up to n."""
    both = []
    for base in (_R, _R_INVERSE):
        out = np.ones(1, dtype=np.uint64)
        while len(out) <= n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        both.append(out[: n + 1].copy())
    return both[0], both[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Scan:
    """Words of ``texts``: ``doc`` (which text), ``hash``, ``start``, ``end`` (bytes), in order."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        joined = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=self.n)
        self.text_end = np.cumsum(sizes)  # behind each text's newline
        space = _SPACE[self.bytes]
        edge = [np.flatnonzero(space[at - 1 : at + BLOCK - 1][: len(space) - at] != space[at : at + BLOCK]) + at for at in range(1, len(space), BLOCK)]
        edge = np.concatenate([np.flatnonzero(~space[:1]), *edge])  # the last byte is a space, so edges come in pairs
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.text_end, self.start, side="right")
        self.hash = self.segment(self.start, self.end)
        self.count = np.bincount(self.doc, minlength=self.n)  # words of each text
        self.first = np.cumsum(self.count) - self.count  # each text's first word

    def _blocks(self, *places: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[slice]]]:
        """Each block's offset, bytes, and which of the sorted places lie in it."""
        for at in range(0, len(self.bytes) + 1, BLOCK):
            yield at, self.bytes[at : at + BLOCK], [slice(*np.searchsorted(p, [at, at + BLOCK])) for p in places]

    def segment(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of segments that are sorted by start and by end."""
        up, down = _powers(BLOCK)
        first, last = np.zeros(len(start), dtype=np.uint64), np.zeros(len(end), dtype=np.uint64)
        back = np.zeros(len(start), dtype=np.uint64)
        total, step, inverse = 0, 1, 1  # the sum before the block, R**offset and R**-offset
        sums = np.zeros(BLOCK + 1, dtype=np.uint64)
        for at, block, (a, b) in self._blocks(start, end):
            np.cumsum(_BYTE[block] * up[: len(block)], out=sums[1 : len(block) + 1])
            first[a] = sums[start[a] - at] * np.uint64(step) + np.uint64(total)
            last[b] = sums[end[b] - at] * np.uint64(step) + np.uint64(total)
            back[a] = down[start[a] - at] * np.uint64(inverse)
            total = (total + int(sums[len(block)]) * step) % (1 << 64)
            step, inverse = step * pow(_R, BLOCK, 1 << 64) % (1 << 64), inverse * pow(_R_INVERSE, BLOCK, 1 << 64) % (1 << 64)
        return mix((last - first) * back)

    def codepoints(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of code points of each segment; segments are sorted by start and by end."""
        first, last, total = np.zeros(len(start), dtype=np.int64), np.zeros(len(end), dtype=np.int64), 0
        for at, block, (a, b) in self._blocks(start, end):
            sums = np.r_[0, np.cumsum((block & 0xC0) != 0x80)] + total
            first[a], last[b], total = sums[start[a] - at], sums[end[b] - at], int(sums[-1])
        return last - first

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r"""``(doc, hash, start, first word, behind its last word)`` of each \n-split line that has a word."""
        breaks = np.flatnonzero(self.bytes == 10)
        start = np.r_[0, breaks[:-1] + 1]
        a, b = np.searchsorted(self.start, start), np.searchsorted(self.start, breaks)
        full = b > a
        start, end, a, b = start[full], breaks[full], a[full], b[full]
        return np.searchsorted(self.text_end, start, side="right"), self.segment(start, end), start, a, b

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(first word, hash)`` of each n-word window that lies in one text."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h = np.zeros(k, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(_R) + self.hash[j : j + k]
        inside = np.flatnonzero(self.doc[:k] == self.doc[n - 1 :])
        return inside, mix(h[inside])


def chunks(batch: pa.Array, size: int = 1 << 19) -> Iterator[list[str | None]]:
    """The texts of an Arrow array in runs of about ``size`` characters (a longer text comes alone)."""
    run, total = [], 0
    for at in range(0, len(batch), 64):
        for t in batch.slice(at, 64).to_pylist():
            if run and total + len(t or "") > size:
                yield run
                run, total = [], 0
            run.append(t)
            total += len(t or "")
    if run:
        yield run


def encode(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]
