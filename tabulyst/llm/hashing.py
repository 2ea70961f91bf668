"""Vectorised 64-bit hashes of words and word windows over Arrow text batches.

A word's hash is a polynomial in random per-byte values modulo 2**64, taken from
running sums over the bytes, so a batch costs a few passes and no loop over
words. Everything works on byte ranges of bounded size, so a very long text costs
no more memory than its bytes a few times over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_RANGE = 1 << 18
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            def run(b: int) -> np.ndarray:
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            cls.up, cls.down = run(_BASE), run(pow(_BASE, -1, 1 << 64))
        return cls.up, cls.down


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array (null: empty) and the offsets of its texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (``[^\\x20\\x09-\\x0D]+``) in order, and where each text's words begin (n + 1 places).

    ``lower``: A-Z count as a-z.
    """
    raw, at = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SEPARATOR[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] |= inside[edges]
    stops = np.zeros(len(raw) + 1, bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:] | begins[1:]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops)
    value = _VALUE[_LOWER] if lower else _VALUE
    out = np.empty(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(stop, begin[lo] + _RANGE, side="right")))
        a, b = begin[lo], stop[hi - 1]
        up, down = _Powers.get(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(value[raw[a:b]] * up[: b - a], out=sums[1:])
        s, e = begin[lo:hi] - a, stop[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix64(out), np.searchsorted(begin, at)


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the text of each."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k: k + n]
    valid = np.ones(n, bool)
    for k in range(1, size):
        cut = first[1:] - k
        valid[cut[(cut >= 0) & (cut < n)]] = False
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    return mix64(total[valid]), text[valid]
