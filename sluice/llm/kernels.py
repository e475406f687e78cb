"""Array kernels over whole batches of UTF-8 text: words, their hashes and shingles, without Python loops."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text, or shingles, whose 64-bit intermediates are held at a time, however long a text is.
BLOCK = 1 << 18


def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z and keeps the rest; 0 is a separator in the tables made from it."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def alnum_table() -> np.ndarray:
    """Words of digits, letters and all code points from 0x80 on, A-Z lower-cased."""
    lut = lower_ascii()
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
    lut[~keep] = 0
    return lut


def spaced_table() -> np.ndarray:
    """Words between ASCII white space (space and 0x09 to 0x0D), A-Z lower-cased; a NUL byte is a word byte."""
    lut = lower_ascii()
    lut[0] = 255  # never occurs in UTF-8
    lut[[32, 9, 10, 11, 12, 13]] = 0
    return lut


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _POWERS[i] = np.cumprod(full, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Words:
    """Words of a batch: bytes after the table, start and end of each word, first word of each row (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, from blocks of at most BLOCK bytes or one longer word."""
        size = self.ends - self.starts
        sums = np.empty(len(size), np.uint64)
        up, down = _powers(2 * BLOCK)
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, len(self.data) + BLOCK, BLOCK)))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if size[j - 1] > BLOCK:
                j -= 1
                sums[j] = self._long_sum(int(self.starts[j]), int(self.ends[j]))
            if i == j:
                continue
            first, end = int(self.starts[i]), int(self.ends[j - 1])
            total = np.zeros(end - first + 1, np.uint64)
            np.cumsum(self.data[first:end] * up[: end - first], out=total[1:])
            at = self.starts[i:j] - first
            sums[i:j] = (total[self.ends[i:j] - first] - total[at]) * down[at]
        return mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _long_sum(self, start: int, end: int) -> np.uint64:
        up, _ = _powers(2 * BLOCK)
        total = 0
        for a in range(start, end, BLOCK):
            part = self.data[a : min(a + BLOCK, end)]
            total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), a - start, 1 << 64)
        return np.uint64(total & (1 << 64) - 1)


def words(column: pa.Array, lut: np.ndarray) -> Words:
    """Words of a string column (null: none); ``lut`` gives each byte its value, 0 for separators."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = lut[raw]
    inside = data != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    at = edges[edges < len(data)]
    first[at] = inside[at]
    at = edges[edges > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each row): hashes of all runs of ``size`` words, of the whole row if it has fewer."""
    word = w.hashes()
    counts = np.diff(w.rows)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    rows = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(rows[-1], np.uint64)
    step = np.uint64(0xA0761D6478BD642F)
    with np.errstate(over="ignore"):
        for a in range(0, len(out), BLOCK):
            s = np.arange(a, min(a + BLOCK, len(out)))
            row = np.searchsorted(rows, s, "right") - 1
            at = s - rows[row] + w.rows[row]
            left = np.minimum(counts[row], size)
            total, factor = left.astype(np.uint64), np.uint64(1)
            for k in range(size):
                factor = factor * step
                has = k < left
                total[has] += mix(word[at[has] + k] + np.uint64(k)) * factor
            out[a : a + len(s)] = mix(total)
    return out, rows
