"""Code points, pretokens and token ids of whole batches.

``gpt_starts`` finds the pretokens of byte-level BPE (``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``)
with a deterministic transducer whose chunk state maps are composed by a parallel prefix scan; ``WordIds`` encodes with
the word-level vocabulary, calling its library once for each distinct pretoken.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from . import kernel as K

_tables: dict[str, np.ndarray] = {}
#: White space as \s has it in the tokenizers' patterns (Unicode White_Space): a fixed list.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE = range(4)


def tables() -> dict[str, np.ndarray]:
    """By code point: class (letter, number, other, space), lower case, hash value."""
    if not _tables:
        kind = np.full(0x110000, OTHER, np.uint8)
        low = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kind[c] = LETTER
                x = chr(c).lower()
                if len(x) == 1:
                    low[c] = ord(x)
            elif k == "N":
                kind[c] = NUMBER
        for c in range(0x2160, 0x2170):  # numerals and circled letters have lower case too
            low[c] = c + 16
        for c in range(0x24B6, 0x24D0):
            low[c] = c + 26
        kind[_SPACES] = SPACE
        rng = np.random.Generator(np.random.PCG64(77))
        _tables.update(kind=kind, low=low, hash=rng.integers(1, 2**63, 0x110000, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return _tables


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets by row); nulls are empty."""
    data, off = K.flat(texts)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(data):
        return cp, off
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return cp, at[off]


def piece_hashes(cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the pieces cp[start : start + size], which cover cp without gaps in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    pos = np.arange(len(cp)) - np.repeat(start, size)
    return K.mix(np.add.reduceat(tables()["hash"][cp] * K.powers(int(size.max()))[pos], start))


class Transducer:
    """Table-driven: next[state, symbol], out[state, symbol] (1: a pretoken starts here; 2: one started at the last symbol)."""

    #: States: 0 begin, 1 letters, 2 numbers, 3 others, 4/5 one/more white space with a blank last, 6/7 the same with
    #: another last, 8 apostrophe at a pretoken's start, 9-11 it and r, v, l, 12 a contraction's end.
    #: Symbols: 0 letter, 1 number, 2 other, 3 blank, 4 white space, 5 apostrophe, 6 one of s t m d, 7 r, 8 v, 9 l, 10 e, 11 end of text.
    STATES, SYMBOLS, END = 13, 12, 11

    def __init__(self):
        self.next = np.zeros((self.STATES, self.SYMBOLS), np.uint8)
        self.out = np.zeros((self.STATES, self.SYMBOLS), np.uint8)
        for s in range(self.STATES):
            for a in range(self.SYMBOLS):
                self.next[s, a], self.out[s, a] = self.step(s, a)
        kind = tables()["kind"]
        self.symbol = np.array([0, 1, 2, 4], np.uint8)[kind]
        for chars, a in (" ", 3), ("'", 5), ("stmd", 6), ("r", 7), ("v", 8), ("l", 9), ("e", 10):
            self.symbol[[ord(c) for c in chars]] = a

    @staticmethod
    def step(s: int, a: int) -> tuple[int, int]:
        if (s, a) in ((9, 10), (10, 10), (11, 9)):
            return 12, 0
        out = 0
        if s in (9, 10, 11):  # the letter after the apostrophe began a pretoken after all
            s, out = 1, 2
        if a == 11:
            return 0, out
        if a in (3, 4):
            more = s in (4, 5, 6, 7)
            return (4 if a == 3 else 6) + more, out | (not more)
        if s in (5, 7):
            out |= 2
        if s == 8 and a >= 6:
            if a == 6:
                return 12, out
            if a != 10:
                return a + 2, out
        run = {1: 2, 2: 3, 5: 3}.get(a, 1)
        attached, goes_on = s in (4, 5), s == run or s == 8 and run == 3
        return (8 if a == 5 and not attached and not goes_on else run), out | (not attached and not goes_on)

    def run(self, symbols: np.ndarray, chunk: int = 64) -> np.ndarray:
        """Outputs of all symbols from state 0: chunk maps, their prefix scan, then every chunk from its own state."""
        n = len(symbols)
        rows = -(-n // chunk)
        x = np.full(rows * chunk, self.END, np.uint8)
        x[:n] = symbols
        x = np.ascontiguousarray(x.reshape(rows, chunk).T)
        wide = self.next.reshape(-1)
        maps = np.tile(np.arange(self.STATES, dtype=np.uint8)[:, None], (1, rows))
        for col in x:
            maps = wide[maps.astype(np.int16) * self.SYMBOLS + col]
        gap = 1  # inclusive scan: maps[:, i] becomes the map of chunks 0..i
        while gap < rows:
            maps[:, gap:] = np.take_along_axis(maps[:, gap:], maps[:, :-gap], 0)
            gap *= 2
        state = np.zeros(rows, np.int16)
        state[1:] = maps[0, :-1]
        out = np.empty((chunk, rows), np.uint8)
        flat_out = self.out.reshape(-1)
        for j, col in enumerate(x):
            at = state * self.SYMBOLS + col
            out[j], state = flat_out[at], wide[at].astype(np.int16)
        return out.T.reshape(-1)[:n]


def gpt_starts(t: Transducer, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start positions of all pretokens of all rows."""
    n, rows = len(cp), len(off) - 1
    at = np.arange(n) + np.repeat(np.arange(rows), np.diff(off))
    x = np.full(n + rows, Transducer.END, np.uint8)
    x[at] = t.symbol[cp]
    out = t.run(x)
    start = (out & 1).astype(bool)
    start[:-1] |= (out[1:] & 2).astype(bool)
    return np.flatnonzero(start[at])


class WordIds:
    """Ids of the word-level BPE vocabulary, as its library gives them without added tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self):
        self.memo = K.Memo()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by row)."""
        cp, off = code_points(texts)
        rows = len(off) - 1
        odd = self._odd(texts, cp, off)
        tab = tables()
        low = tab["low"][cp]
        kind = tab["kind"][low]
        start = self._starts(low, kind, off)
        size = np.diff(np.append(start, len(cp)))
        h = piece_hashes(low, start, size)
        word = kind[start] != SPACE if len(start) else np.zeros(0, bool)
        start, size, h = start[word], size[word], h[word]
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.memo.at) + len(keys) > self.memo.most:
            self.reset()
        pos, new = self.memo.split(keys)
        if len(new):
            raw = [low[a : a + n].tobytes().decode("utf-32-le") for a, n in zip(start[first[new]].tolist(), size[first[new]].tolist(), strict=True)]
            got = [x.ids for x in self.library.encode_batch_fast(raw, add_special_tokens=False)]
            base = len(self.off) - 1
            self.memo.add(keys[new], base)
            pos[new] = base + np.arange(len(new))
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])
            flat = np.fromiter((i for x in got for i in x), np.uint32, int(lens.sum()))
            need = int(self.off[-1])
            if need > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), np.uint32)])
            self.ids[need - len(flat) : need] = flat
        pos = pos[back]
        n = self.off[pos + 1] - self.off[pos] if len(pos) else pos
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[np.repeat(self.off[pos] - total[:-1], n) + np.arange(total[-1])] if len(pos) else np.zeros(0, np.uint32)
        bounds = total[np.searchsorted(start, off)]
        if not len(odd):
            return out, bounds
        parts = [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for r in odd:
            parts[r] = np.array(self.library.encode(texts[r].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _odd(self, texts, cp, off) -> list[int]:
        """Rows that the library encodes whole: not in normal form, one character lower-cased to two, or a special string inside."""
        out = set()
        if (cp == 0x130).any():
            out.update((np.searchsorted(off, np.flatnonzero(cp == 0x130), "right") - 1).tolist())
        wide = np.searchsorted(off, np.flatnonzero(cp >= 0x300), "right") - 1
        for r in np.unique(wide).tolist():
            if not unicodedata.is_normalized("NFC", texts[r].as_py()):
                out.add(r)
        bar = np.flatnonzero(cp == 0x7C)
        bar = bar[(bar > 0)]
        bar = bar[cp[bar - 1] == 0x3C]
        for r in np.unique(np.searchsorted(off, bar, "right") - 1).tolist():
            if any(m in texts[r].as_py() for m in self.marks):
                out.add(r)
        return sorted(out)

    @staticmethod
    def _starts(low, kind, off):
        n = len(low)
        if not n:
            return np.zeros(0, np.int64)
        s = np.ones(n + 1, bool)
        s[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        s[off] = True
        ap = np.flatnonzero((low == 0x27) & s[:n])
        if len(ap):
            last = off[np.searchsorted(off, ap, "right")]  # end of the row
            at = lambda i: np.where(ap + i < last, low[np.minimum(ap + i, n - 1)], 0)
            a, b = at(1), at(2)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for ok, k in (one, 2), (two, 3):
                p = ap[ok]
                s[p + 1] = False
                s[p + k] = True
        return np.flatnonzero(s[:n])
