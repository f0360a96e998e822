"""Vectorised text kernels shared by the operators of this subpackage.

A batch of texts is one flat byte array with offsets (an Arrow string column's own layout).  Words, their 64-bit hashes
and n-gram hashes are computed for the whole batch with numpy, without a Python loop over words.

Defined results: a null text counts as an empty one; an empty text has no word; a text of any length is processed
whole (batches are cut between texts, so one long text makes one large batch).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

M64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(M64) * M64(2) + M64(1)
_MUL = M64(0x9E3779B97F4A7C15)
_GRAM = M64(0xD6E8FEB86659FD93)
_pow = np.ones(1, M64)

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~WS
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = np.asarray(h, M64)
    h = (h ^ (h >> M64(30))) * M64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> M64(27))) * M64(0x94D049BB133111EB)
    return h ^ (h >> M64(31))


def powers(n: int) -> np.ndarray:
    """_MUL**0 .. _MUL**(n-1) modulo 2**64."""
    global _pow
    if len(_pow) < n:
        m = max(64, 1 << (n - 1).bit_length())
        out = np.full(m, _MUL, M64)
        out[0] = 1
        _pow = np.cumprod(out)
    return _pow


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def batches(source, column: str = "text", most: int = 2 << 20):
    """Record batches cut so that each holds about ``most`` bytes of text, or one text."""
    for batch in source:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(column)
        if batch.column(i).nbytes <= most:
            yield batch
            continue
        _, off = flat(batch.column(i))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """Words of a batch: ``start`` and ``size`` in bytes, ``doc`` (row), ``hash``; ``count`` words a row, ``first`` word of each row."""

    def __init__(self, texts: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = True, hashes: bool = True):
        self.data, self.off = flat(texts)
        self.lower = lower
        n = len(self.off) - 1
        low = LOWER[self.data] if lower else self.data
        m = inside[low]
        begins = np.zeros(len(m) + 1, bool)
        begins[self.off[:-1]] = True
        begins = begins[:-1]
        s = m.copy()
        if len(m):
            s[1:] &= ~m[:-1] | begins[1:]
        self.start = np.flatnonzero(s)
        total = np.concatenate([[0], np.cumsum(m)])
        upto = total[self.start]
        inner = int(total[-1])
        self.size = np.diff(np.append(upto, inner))
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=n)[:n]
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.low, self.mask = low, m
        self.hash = np.zeros(0, M64)
        if hashes and len(self.start):
            pos = np.arange(inner) - np.repeat(upto, self.size)
            vals = _BYTE[low[m]] * powers(int(self.size.max()))[pos]
            self.hash = mix(np.add.reduceat(vals, upto))

    def __len__(self) -> int:
        return len(self.start)

    def string(self, i: int) -> str:
        return self.low[self.start[i] : self.start[i] + self.size[i]].tobytes().decode("utf-8", "replace")

    def prefix(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the first k bytes of the words ``at``; 0 where a word has fewer than k+1 bytes."""
        return self._part(at, k, self.start[at], k)

    def suffix(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the last k bytes of the words ``at``; 0 where a word has fewer than k+1 bytes."""
        return self._part(at, k, self.start[at] + self.size[at] - k, -k)

    def _part(self, at, k, where, salt):
        ok = self.size[at] > k
        idx = np.where(ok, where, 0)[:, None] + np.arange(k)
        idx = np.minimum(idx, max(len(self.low) - 1, 0))
        h = mix((_BYTE[self.low[idx]] * powers(k)[:k]).sum(1, dtype=M64) + M64(salt * int(_GRAM) % 2**64))
        return np.where(ok, h, M64(0))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (rows are not looked at); len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, M64)
    out = np.zeros(n, M64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _GRAM + h[j : j + n]
    return mix(out + M64(k))


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a row of 1 to k-1 words has its whole sequence as its only shingle."""
    g = grams(w.hash, k)
    out = []
    for a, c in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
        out.append(np.unique(g[a : a + c - k + 1]) if c >= k else grams(w.hash[a : a + c], c) if c else g[:0])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return np.ascontiguousarray(h, M64).view(np.int64)


class Memo:
    """Bounded map from 64-bit hashes to positions in arrays that grow; emptied when full, so it never changes a result."""

    def __init__(self, most: int = 1_500_000):
        self.most, self.at = most, {}

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the distinct ``keys`` (-1 where new) and the indices of the new ones."""
        get = self.at.get
        pos = np.fromiter((get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        return pos, np.flatnonzero(pos < 0)

    def add(self, keys: np.ndarray, base: int) -> None:
        self.at.update(zip(keys.tolist(), range(base, base + len(keys)), strict=True))
