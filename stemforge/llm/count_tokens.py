"""Token counts by a compiled finite-state transducer.

Byte-level BPE is compiled to two deterministic transducers.  The first cuts code points into pretokens
(``pretokens.Transducer``): its chunk state maps are composed by a parallel prefix scan, so all chunks of a batch run
side by side.  The second reads a pretoken's bytes and emits on each transition by how many tokens the encoding of
what was read grows.  Its states are determinised on demand: a state holds, for each position inside the longest read
suffix that may still grow into a vocabulary entry, the last token of the encoding up to there and the token count
relative to here; two prefixes with equal states count alike for ever.  Long pretokens are cut into chunks whose state maps are
composed, so that their chunks run side by side too.  The last token at a position is the only
vocabulary entry that ends there and is compatible with the last token before it (two tokens are compatible when BPE
keeps them apart).

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as one token, as
in the library; repeated rows and rows with a null doc_id give a row each; texts of any length are counted whole; extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import pretokens as P

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others follow from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.marks = [x["content"] for x in spec["added_tokens"]]
        self.vocab = {raw(s) for s in spec["model"]["vocab"] if s not in self.marks}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.starts = {t[:i] for t in self.vocab for i in range(len(t))}
        self.memo: dict[tuple[bytes, bytes], bool] = {}

    def encode(self, text: bytes) -> list[bytes]:
        """BPE by its definition: merge the leftmost pair of lowest rank until none is left."""
        x = [text[i : i + 1] for i in range(len(text))]
        while len(x) > 1:
            r, i = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(x, x[1:], strict=False)))
            if r == 1 << 30:
                break
            x[i : i + 2] = [x[i] + x[i + 1]]
        return x

    def apart(self, a: bytes, b: bytes) -> bool:
        got = self.memo.get((a, b))
        if got is None:
            if len(self.memo) > 2_000_000:
                self.memo.clear()
            got = self.memo[a, b] = self.encode(a + b) == ([a, b] if a else [b])
        return got


class Transitions:
    """Open-addressing map (state, byte) -> (state, tokens emitted) in flat arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.key = np.full(1 << bits, -1, np.int64)
        self.to = np.zeros(1 << bits, np.int32)
        self.grow = np.zeros(1 << bits, np.int16)

    def slot(self, key: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it belongs."""
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        off = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.key) - 1)
            k = self.key[at[off]]
            off = off[(k != key[off]) & (k >= 0)]
        return at

    def put(self, key: np.ndarray, to: np.ndarray, grow: np.ndarray) -> None:
        """Add distinct new keys."""
        self.n += len(key)
        while self.n * 2 >= len(self.key):
            old, n = self.key >= 0, self.n
            kept = self.key[old], self.to[old], self.grow[old]
            self.__init__(self.bits + 1)
            self.put(*kept)
            self.n = n
        while len(key):
            at, first = np.unique(self.slot(key), return_index=True)
            self.key[at], self.to[at], self.grow[at] = key[first], to[first], grow[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, to, grow = key[rest], to[rest], grow[rest]


class Counter:
    """The counting transducer over bytes, its transitions made when first met; it starts anew if it outgrows ``most`` states.

    A state is (tail, past): the read suffix that may still grow into a token, and for each position inside it, from its
    end back, the last token there (times 4096) and 2048 plus how many tokens fewer than here its encoding has."""

    #: Longer pretokens are cut into chunks, whose state maps are composed; bytes that a chunk's likely start state is read from; bytes of a section.
    LONG, CHUNK, WARM, SECTION = 1024, 256, 64, 1 << 16

    def __init__(self, bpe: Bpe, most: int = 200_000):
        self.bpe, self.most = bpe, most
        self.tokens = [b"", *sorted(bpe.vocab)]
        self.id = {t: i for i, t in enumerate(self.tokens) if i}
        self.reset()

    def reset(self):
        self.table = Transitions()
        self.states: list[tuple[bytes, tuple[int, ...]]] = []
        self.number: dict[tuple[bytes, tuple[int, ...]], int] = {}
        self.known: dict[int, tuple[int, int]] = {}
        self.add((b"", (2048,)))

    def add(self, state: tuple[bytes, tuple[int, ...]]) -> int:
        i = self.number.get(state)
        if i is None:
            i = self.number[state] = len(self.states)
            self.states.append(state)
        return i

    def compile(self, key: int) -> tuple[int, int]:
        """(state, tokens emitted) of a key: state * 256 + byte."""
        tail, past = self.states[key >> 8]
        text = tail + bytes([key & 255])
        for n in range(min(len(text), len(past)), 0, -1):
            token = text[-n:]
            if token in self.id:
                last, fewer = past[n - 1] >> 12, (past[n - 1] & 4095) - 2048
                if self.bpe.apart(self.tokens[last], token):
                    grown = 1 - fewer
                    break
        else:
            raise ValueError("no token of the vocabulary ends here")
        while text and text not in self.bpe.starts:
            text = text[1:]
        return self.add((text, (self.id[token] << 12 | 2048, *(p + grown for p in past[: len(text)])))), grown

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each data[start : start + size]."""
        if len(self.states) > self.most:
            self.reset()
        short = size <= self.LONG
        out = np.empty(len(start), np.int64)
        out[short] = self.lanes(data, start[short], size[short], np.zeros(int(short.sum()), np.int64))[1]
        for i in np.flatnonzero(~short).tolist():
            out[i] = self.long(data[start[i] : start[i] + size[i]])
        return out

    def lanes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end state, tokens emitted) of each data[start : start + size] from its own state, all in lockstep, the longest first."""
        order = np.argsort(-size, kind="stable")
        start, size, state = start[order], size[order], state[order]
        total = np.zeros(len(start), np.int64)
        live = len(start)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -j, "left"))
            key = state[:live] * 256 + data[start[:live] + j]
            at = self.table.slot(key)
            miss = np.flatnonzero(self.table.key[at] != key)
            if len(miss):
                new = np.unique(key[miss])
                self.table.put(new, *np.array([self.compile(k) for k in new.tolist()]).T)
                at = self.table.slot(key)
            total[:live] += self.table.grow[at]
            state[:live] = self.table.to[at]
        ends, out = np.empty_like(state), np.empty_like(total)
        ends[order], out[order] = state, total
        return ends, out

    def long(self, data: np.ndarray) -> int:
        """Tokens of one long pretoken, section by section; between sections the transducer may start anew."""
        state, total = 0, 0
        for lo in range(0, len(data), self.SECTION):
            if len(self.states) > self.most:
                now = self.states[state]
                self.reset()
                state = self.add(now)
            state, n = self.section(data[lo : lo + self.SECTION], state)
            total += n
        return total

    def section(self, data: np.ndarray, state: int) -> tuple[int, int]:
        """(end state, tokens emitted) of a section, by the composition of its chunks' maps.

        A chunk's map is evaluated where it is needed: first, for all chunks in lockstep, at the state that the bytes before it lead
        to from the beginning, which is nearly always the true one.  Where every chunk starts as the one before it ends, the
        composition is the sum; else the chunks are composed in order, and missing entries of a map are added (equal chunks share theirs)."""
        first = np.arange(0, len(data), self.CHUNK)
        size = np.minimum(self.CHUNK, len(data) - first)
        warm = np.minimum(first, self.WARM)
        begin = self.lanes(data, first - warm, warm, np.zeros(len(first), np.int64))[0]
        begin[0] = state
        end, n = self.lanes(data, first, size, begin)
        if (begin[1:] == end[:-1]).all():
            return int(end[-1]), int(n.sum())
        chunks = [data[a : a + s].tobytes() for a, s in zip(first.tolist(), size.tolist(), strict=True)]
        maps = dict(zip(zip(chunks, begin.tolist(), strict=True), zip(end.tolist(), n.tolist(), strict=True), strict=True))
        total = 0
        for c in chunks:
            got = maps.get((c, state))
            if got is None:
                got = maps[c, state] = self.walk(c, state)
            state, total = got[0], total + got[1]
        return state, total

    def walk(self, chunk: bytes, state: int) -> tuple[int, int]:
        """One entry of a chunk's map."""
        total = 0
        for b in chunk:
            key = state * 256 + b
            got = self.known.get(key)
            if got is None:
                got = self.known[key] = self.compile(key)
            state, total = got[0], total + got[1]
        return state, total


class TextCounter:
    """Tokens of whole texts: pretokens, then one run of the transducer for each distinct pretoken."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.cut, self.counter = P.Transducer(), Counter(self.bpe)
        self.memo, self.known = K.Memo(), np.zeros(0, np.int32)
        # the library reads special strings from left to right, the longest first
        self.mark = re.compile(b"|".join(re.escape(m.encode()) for m in sorted(self.bpe.marks, key=len, reverse=True))) if self.bpe.marks else None

    def rows(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: those of what lies between special strings, and one for each of these."""
        data, off = K.flat(texts)
        raw = data.tobytes()
        if self.mark is None or self.mark.search(raw) is None:
            return self.plain(texts)
        parts: list[bytes] = []
        owner, extra = [], np.zeros(len(off) - 1, np.int64)
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            for m in self.mark.finditer(raw, a, b):  # within the text, not across texts
                parts.append(raw[a : m.start()])
                owner.append(i)
                extra[i] += 1
                a = m.end()
            parts.append(raw[a:b])
            owner.append(i)
        return extra + np.bincount(owner, self.plain(pa.array(parts, pa.large_binary()).cast(pa.large_string())), len(extra)).astype(np.int64)

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Tokens of texts without special strings."""
        data, _ = K.flat(texts)
        cp, off = P.code_points(texts)
        start = P.gpt_starts(self.cut, cp, off)
        if not len(start):
            return np.zeros(len(texts), np.int64)
        size = np.diff(np.append(start, len(cp)))
        h = P.piece_hashes(cp, start, size)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.memo.at) + len(keys) > self.memo.most:
            self.memo, self.known = K.Memo(), self.known[:0]
        pos, new = self.memo.split(keys)
        if len(new):
            a = start[first[new]]
            raw, bounds = (data, a) if len(cp) == len(data) else (data, np.flatnonzero((data & 0xC0) != 0x80)[a])
            ends = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[a + size[first[new]]]
            base = len(self.known)
            self.known = np.concatenate([self.known, self.counter.count(raw, bounds, ends - bounds).astype(np.int32)])
            self.memo.add(keys[new], base)
            pos[new] = base + np.arange(len(new))
        total = np.concatenate([[0], np.cumsum(self.known[pos][back])])
        return np.diff(total[np.searchsorted(start, off)])


_made: dict[str, TextCounter] = {}


def counter(path: str) -> TextCounter:
    """One compiled counter a Python worker."""
    if path not in _made:
        _made[path] = TextCounter(path)
    return _made[path]


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, counted by the transducers compiled from the vocabulary at ``path``."""

    def run(source):
        c = counter(path)
        for batch in K.batches(source):
            n = c.rows(batch.column("text"))
            _, off = K.flat(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
