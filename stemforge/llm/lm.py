"""Language-model scoring with a log-frequency Bloom filter of words, pairs and triples.

Counting covers every training text, in two passes: words and pairs; then triples, of which only those are sent whose two
pairs were seen twice (no other triple can have been).  Tasks send packed blocks of n-gram hashes and counts, one block a
bucket of the hash range; each bucket is merged on its own, its size bounded by the number of buckets, which follows the
input.  Words are held whatever their count, pairs and triples from a count of two (``LEAST``): those seen once are pruned.

The filter holds, for an n-gram of count c, the keys (n-gram, 1) .. (n-gram, level of c), levels growing with log2 c, and
for a context the sum of the held counts of its continuations, bit by bit (twelve leading bits).  Counts and sums are read
back by probing: levels one after another until one is missing, bits each.  An n-gram has four bits of one 64-bit word a
key.  Each bucket has a segment of its own, and every segment has ``bits_each`` bits a key whatever the corpus, so the
share of errors (about 1 % of probes at 12 bits) does not grow with the input.  A filter of at most ``most_bits`` bits is
broadcast.  Of a larger one, only the pairs' first level and the words are (while they fit): the distinct pairs of each
chunk of texts that pass the first level, and the triples whose two pairs do, are sent as names of 48 bits (all that the
filter looks at) to groups of buckets, read there, and the answers meet the chunk's texts.  Both ways give the same scores.

Score: P(w | context) = t q(w) / m + (1 - t k / m) P(w | shorter context), where q is the n-gram's quantised count, k the
sum of q over the context's held continuations, m the larger of k and the context's own quantised count, and t the share
of all tokens after contexts of that count level whose n-gram is held.  Where nothing is held after a context, the shorter
one decides.  It ends at P(w) = N / (N + V) q(w) / (sum of q) for known words, and V / (N + V) for all unknown words
together, one V-th of it each.  So the probabilities of all words after a context sum to one but for the filter's errors.

Base: add-one unigrams from exact counts.  The ``head`` most frequent words are broadcast (a bounded table); the other
words of each text are joined with their counts by hash, and summed by row.

Defined results: a null or empty text is the end token alone; repeated rows are scored each; rows with a null doc_id are
scored and learnt from (their held_out is false); extra columns are ignored; without training texts N = V = 0, and base
and model give every token probability 1; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import remove, saved

U = np.uint64
END = U(0x5EED0FE4D0000001)
LEAST = {1: 1, 2: 2, 3: 2}
LEVELS = 96
#: The part of the filter that holds the first level of pairs: the sieve of triples and of what is asked.
FIRST = 4
#: Bits of a key that name the word; the others name its context.
WORD = U(28)


def key_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram: 36 bits of its context's name, 28 of its last word's hash."""
    return (context >> WORD << WORD) | (word >> (U(64) - WORD))


def name(key: np.ndarray, order: int) -> np.ndarray:
    """Evenly spread name of an n-gram, by which it is dealt to buckets and is a context of longer ones."""
    return key if order == 1 else K.mix(key)


class Tokens:
    """Word and end-token hashes of a batch in order, with the keys of the pairs and triples that end at each."""

    def __init__(self, texts: pa.Array):
        w = K.Words(texts)
        rows = len(w.count)
        self.count = w.count + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = np.full(int(self.first[-1]), END)
        self.hash[np.arange(len(w)) + w.doc] = w.hash
        self.start = np.zeros(len(self.hash), bool)
        self.start[self.first[:-1]] = True
        self.pair = key_of(self.before(self.hash, END), self.hash)
        self.pair_name = name(self.pair, 2)
        self.triple = key_of(self.before(self.pair_name, name(END, 2)), self.hash)
        self.row = np.repeat(np.arange(rows), self.count)

    def before(self, x: np.ndarray, at_start) -> np.ndarray:
        """x of the token before, ``at_start`` where there is none (the first word follows an end)."""
        out = np.empty_like(x)
        if len(x):
            out[1:] = x[:-1]
            out[self.start] = at_start
        return out


def level(n: np.ndarray, order: int) -> np.ndarray:
    """Highest filter level of a count: 1 for the least held one, then two more for each doubling."""
    return 1 + np.floor(2 * np.log2(np.maximum(n, LEAST[order]) / LEAST[order]) + 1e-9).astype(np.int64)


def value(levels: np.ndarray, order: int) -> np.ndarray:
    """Count that a level stands for: the middle of its range (0 for level 0), a whole number."""
    lo = np.ceil(LEAST[order] * 2.0 ** ((levels - 1) / 2) - 1e-9)
    hi = np.ceil(LEAST[order] * 2.0 ** (levels / 2) - 1e-9) - 1
    return np.where(levels <= 0, 0.0, np.floor((lo + np.maximum(lo, hi)) / 2))


VALUES = {order: value(np.arange(LEVELS + 1), order) for order in LEAST}


def pack_counts(key: np.ndarray, n: np.ndarray) -> bytes:
    """Keys of 8 bytes, then counts of one byte; a larger count repeats its key."""
    more = -(-n // 255)
    key, last = np.repeat(key, more), n - 255 * (more - 1)
    out = np.full(len(key), 255, np.uint8)
    out[np.cumsum(more) - 1] = last
    return key.astype("<u8").tobytes() + out.tobytes()


def unpack_counts(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(block) // 9
    return np.frombuffer(block, "<u8", n).astype(U), np.frombuffer(block, np.uint8, n, n * 8).astype(np.int64)


def merge_counts(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted bucket numbers."""
    if not len(bucket):
        return []
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True))


BLOCK = "kind int, bucket int, block binary"


def _count(bits: int, sieve=None, batch_tokens: int = 3_000_000):
    """Blocks (kind, bucket, block) of words and pairs; with ``sieve`` (a broadcast filter of the held pairs, or of None) of triples."""

    def run(source):
        held: dict[int, list[np.ndarray]] = {1: [], 2: []} if sieve is None else {3: []}
        size = 0

        def out():
            cols = [], [], []
            for kind, keys in held.items():
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                bucket = (name(key, kind) >> U(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, n, bucket = key[order], n[order], bucket[order]
                for b, lo, hi in _by_bucket(bucket):
                    cols[0].append(kind)
                    cols[1].append(b)
                    cols[2].append(pack_counts(key[lo:hi], n[lo:hi]))
                keys.clear()
            return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["kind", "bucket", "block"])

        for batch in K.batches(source):
            t = Tokens(batch.column("text"))
            if sieve is None:
                held[1].append(t.hash)
                held[2].append(t.pair)
            else:
                ok = ~t.start
                if sieve.value is not None:
                    pair = sieve.value.has(FIRST, t.pair_name, 1)
                    ok &= pair & t.before(pair, False)
                held[3].append(t.triple[ok])
            size += len(t.hash)
            if size >= batch_tokens:
                yield out()
                size = 0
        if size:
            yield out()

    return run


TABLE = "kind int, bucket int, part int, types long, total long, keys binary, counts binary"


def _merge(bits: int):
    """Rows sorted by (kind, bucket) -> of each the held keys and counts (part 0), and the sums of held counts by context, dealt to the contexts' buckets (part 1)."""

    def run(source):
        now, held, size = None, [], 0

        def out():
            kind, bucket = now
            key, n = merge_counts(*(np.concatenate(x) for x in zip(*held, strict=True)))
            types, total = len(key), int(n.sum())
            key, n = key[n >= LEAST[kind]], n[n >= LEAST[kind]]
            rows = [(kind, bucket, 0, types, total, key.astype("<u8").tobytes(), n.astype("<u8").tobytes())]
            if kind > 1 and len(key):
                context = key >> WORD
                first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                context, total = context[first], np.add.reduceat(VALUES[kind][level(n, kind)], first).astype(np.int64)
                for b, lo, hi in _by_bucket((context >> (U(64 - bits) - WORD)).astype(np.int64)):
                    rows.append((kind - 1, b, 1, 0, 0, context[lo:hi].astype("<u8").tobytes(), total[lo:hi].astype("<u8").tobytes()))
            types_ = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types_, strict=True)], [f.split()[0] for f in TABLE.split(", ")])

        for batch in source:
            for kind, bucket, block in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "block")), strict=True):
                if (kind, bucket) != now:
                    if held:
                        yield out()
                    now, held, size = (kind, bucket), [], 0
                held.append(unpack_counts(block))
                size += len(held[-1][0])
                if size > 4_000_000:  # keep what is held near the number of distinct keys
                    held = [merge_counts(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = 0
        if held:
            yield out()

    return run


SETTLED = "kind int, bucket int, entries long, keys binary, counts binary, sums binary, tokens array<double>, followed array<double>"


def _settle(source):
    """Rows sorted by (kind, bucket, part) -> a row a bucket: its keys, counts and the held sums after them; quantised tokens by count level, and of those after them the held ones."""
    now, table, sums = None, None, []

    def out():
        kind, bucket = now
        key, n = table
        total = np.zeros(len(key), np.int64)
        if sums and len(key):
            context, s = merge_counts(*(np.concatenate(x) for x in zip(*sums, strict=True)))
            x = name(key, kind) >> WORD
            at = np.minimum(np.searchsorted(context, x), len(context) - 1)
            total = np.where(context[at] == x, s[at], 0)
        lev = level(n, kind) if len(n) else np.zeros(0, np.int64)
        tokens, followed = (np.bincount(lev, w, LEVELS) for w in (VALUES[kind][lev], np.minimum(total, VALUES[kind][lev])))
        entries = int(lev.sum()) + sum(len(k) for k, _ in _sum_entries(key, total))
        return pa.record_batch(
            [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([entries], pa.int64()), *(pa.array([x.astype("<u8").tobytes()], pa.binary()) for x in (key, n, total)), pa.array([tokens]), pa.array([followed])],
            [f.split()[0] for f in SETTLED.split(", ")],
        )

    for batch in source:
        for kind, bucket, part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "part", "keys", "counts")), strict=True):
            if (kind, bucket) != now:
                if table is not None:
                    yield out()
                now, table, sums = (kind, bucket), None, []
            x = np.frombuffer(keys, "<u8").astype(U), np.frombuffer(counts, "<u8").astype(np.int64)
            if part == 0:
                table = x
            else:
                sums.append(x)
    if table is not None:
        yield out()


DIGITS = 12
#: (salt, first bit, end) of a sum's bits: those of a range are only read where an entry says that the sum reaches it, so an error seldom adds a high bit.
RANGES = (200, 0, 3), (199, 3, DIGITS), (201, DIGITS, 20), (198, 20, 32), (197, 32, 48)
#: Masks of four bits of a word.
_MASKS = np.bitwise_or.reduce(U(1) << np.random.Generator(np.random.PCG64(20240602)).random((1 << 14, 64)).argpartition(4, axis=1)[:, :4].astype(U), axis=1)


def _rounded(total: np.ndarray) -> np.ndarray:
    """Sums rounded to their DIGITS leading bits."""
    shift = np.maximum(np.floor(np.log2(np.maximum(total, 1))).astype(np.int64) + 1 - DIGITS, 0)
    return ((total + (1 << shift >> 1)) >> shift) << shift


def _sum_entries(key: np.ndarray, total: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(keys, salt) of the entries of sums: their salt for each range of RANGES that they reach, and 202 + i for bit i."""
    key, total = key[total > 0], _rounded(total[total > 0])
    out = [(key[total >= 1 << lo], salt) for salt, lo, _ in RANGES]
    return out + [(key[(total >> i) & 1 == 1], 202 + i) for i in range(int(total.max(initial=0)).bit_length())]


@dataclass
class Filter:
    """The Bloom filter, in segments: one for each part and bucket, so that buckets fill theirs independently.

    A part is a kind, less the first level of pairs, or ``FIRST``, which is that level; n-grams are looked up by name."""

    words: dict[int, np.ndarray]  # by part, all its segments or those of as many buckets as a power of two
    segment: dict[int, int]  # 64-bit words of a segment
    bits: int

    @staticmethod
    def spot(x: np.ndarray, salt: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """Place within a segment (below 2**32 words) and four bits there, of the 48 leading bits of names."""
        h = ((x >> U(16)) ^ U((salt * 0x9E3779B97F4A7C15 + 0x51ED270B) % 2**64)) * U(0xD6E8FEB86659FD93)
        at = ((h >> U(32)) * U(segment)) >> U(32)
        return at.view(np.int64), _MASKS[((h ^ (h >> U(32))) & U(len(_MASKS) - 1)).view(np.int64)]

    def has(self, part: int, x: np.ndarray, salt: int, base: np.ndarray | int | None = None) -> np.ndarray:
        """Whether the entries (x, salt) are held; ``base``: where their segments begin."""
        if base is None:
            base = self.base(part, x)
        at, mask = self.spot(x, salt, self.segment[part])
        return (self.words[part][base + at] & mask) == mask

    def base(self, part: int, x: np.ndarray) -> np.ndarray:
        buckets = len(self.words[part]) // self.segment[part]
        return ((x >> U(64 - self.bits)) & U(buckets - 1)).view(np.int64) * self.segment[part]

    def levels(self, kind: int, x: np.ndarray) -> np.ndarray:
        """Levels of n-grams: probes go on until one fails."""
        lev = np.zeros(len(x), np.int64)
        live, j = np.arange(len(x)), 0
        if kind == 2:
            live, j = np.flatnonzero(self.has(FIRST, x, 1)), 1
            lev[live] = 1
        some = x[live]
        base = self.base(kind, some)
        while len(live) and j < LEVELS - 1:
            j += 1
            on = self.has(kind, some, j, base)
            live, some, base = live[on], some[on], base[on]
            lev[live] = j
        return lev

    def sums(self, kind: int, x: np.ndarray) -> np.ndarray:
        """Sums of the held counts after contexts."""
        out = np.zeros(len(x), np.int64)
        live, some, base = np.arange(len(x)), x, self.base(kind, x)
        for salt, lo, hi in RANGES:
            on = self.has(kind, some, salt, base)
            live, some, base = live[on], some[on], base[on]
            if not len(live):
                break
            for i in range(lo, hi):
                out[live] |= self.has(kind, some, 202 + i, base).astype(np.int64) << i
        return out

    def entry(self, kind: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels, and the sums after the n-grams that have one."""
        lev = self.levels(kind, x)
        total, some = np.zeros(len(x), np.int64), np.flatnonzero(lev)
        total[some] = self.sums(kind, x[some])
        return lev, total


def _fill(segment: dict[int, int]):
    def run(source):
        for batch in source:
            for kind, bucket, *columns in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "keys", "counts", "sums")), strict=True):
                key, n, total = (np.frombuffer(c, "<u8") for c in columns)
                key, lev, word = key.astype(U), level(n.astype(np.int64), kind) if len(n) else np.zeros(0, np.int64), np.zeros(segment[kind], U)
                key = name(key, kind)
                entries = [(key[lev >= j], j) for j in range(2 if kind == 2 else 1, int(lev.max(initial=0)) + 1)] + _sum_entries(key, total.astype(np.int64))
                for k, salt in entries:
                    np.bitwise_or.at(word, *Filter.spot(k, salt, segment[kind]))
                yield pa.record_batch([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([word.astype("<u8").tobytes()], pa.binary())], ["kind", "bucket", "bits"])

    return run


def _segments(entries: dict[int, int], bits: int, bits_each: float) -> dict[int, int]:
    """64-bit words of a segment of each part."""
    return {part: int(entries.get(part, 0) * bits_each / (64 << bits)) + 16 for part in (*LEAST, FIRST)}


def _filter(rows: DataFrame, segment: dict[int, int], bits: int, parts) -> Filter:
    """Parts of the filter in one place, from the saved rows (kind, bucket, bits): they are filled in parallel, and only read one partition after another."""
    words = {part: np.zeros(segment[part] << bits, U) for part in parts}
    for kind, bucket, part in rows.toLocalIterator(prefetchPartitions=True):
        words[kind][bucket * segment[kind] : (bucket + 1) * segment[kind]] |= np.frombuffer(part, "<u8")
    return Filter(words, segment, bits)


@dataclass
class Model:
    filter: Filter  # the parts of it that are in one place
    asked: bool  # whether others are not, and chunks are looked up
    tokens: int
    types: int
    mass: float  # sum of the words' quantised counts
    share: dict[int, np.ndarray]  # by kind of context and count level: share of the tokens after it that are held
    head_key: np.ndarray  # sorted
    head_count: np.ndarray
    tail: bool  # whether trained words beyond the head exist
    memo: tuple[np.ndarray, ...] | None = None  # words looked up before, a place for each value of 20 bits: word, level, sum

    def word(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels of words, and the sums after them."""
        if self.memo is None:
            self.memo = np.zeros(1 << 20, U), np.zeros(1 << 20, np.uint8), np.zeros(1 << 20, np.int64)
            self.memo[0][0] = U(1 << 63)  # no word of this place
        at = (key >> U(44)).view(np.int64)
        miss = np.flatnonzero(self.memo[0][at] != key)
        lev, total = self.memo[1][at].astype(np.int64), self.memo[2][at]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            got = self.filter.entry(1, new)
            lev[miss], total[miss] = (x[back] for x in got)
            at, first = np.unique(new >> U(44), return_index=True)
            for x, y in zip(self.memo, (new, *got), strict=True):
                x[at.view(np.int64)] = y[first]
        return lev, total

    def look(self, t: Tokens) -> tuple[np.ndarray, ...]:
        """Of each token: the levels of its word, pair and triple, and the sums after its word and its pair."""
        f = self.filter
        word = self.word(t.hash)
        pair, back = np.unique(t.pair_name, return_inverse=True)
        pair = [x[back] for x in f.entry(2, pair)]
        triple = np.zeros(len(t.hash), np.int64)
        some = np.flatnonzero((pair[0] > 0) & (t.before(pair[1], 0) > 0))
        triple[some] = f.levels(3, name(t.triple[some], 3))
        return word[0], pair[0], triple, word[1], pair[1]

    def score(self, t: Tokens, seen: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 probability of each token given the two before it."""
        word, pair, triple, after_word, after_pair = seen
        known = self.tokens / (self.tokens + self.types) if self.tokens else 0.0
        c = VALUES[1][word]
        p = np.where(c > 0, known * c / max(self.mass, 1), (1 - known) / max(self.types, 1))
        # texts begin as often as they end: the first word's context is an end
        end = t.first[1:] - 1
        for kind, lev, total, q in (1, word, after_word, VALUES[2][pair]), (2, pair, after_pair, VALUES[3][triple]):
            lev, total = (t.before(x, x[end] if kind == 1 else 0) for x in (lev, total))
            most = np.maximum(np.maximum(total, VALUES[kind][lev]), 1)
            share = self.share[kind][lev]
            p = np.where(total > 0, share * np.minimum(q, total) / most + (1 - share * total / most) * p, p)
        return np.log10(np.maximum(p, 1e-300))

    def names(self, tokens: list[Tokens], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """What is asked of a chunk's words, pairs or triples: the places of those asked, and their names' 48 leading bits."""
        if kind == 1:
            at, x = None, [t.hash for t in tokens] if 1 not in self.filter.words else []
        else:
            held = [self.filter.has(FIRST, t.pair_name, 1) if FIRST in self.filter.words else np.ones(len(t.hash), bool) for t in tokens]
            if kind == 3:
                held = [h & t.before(h, False) for h, t in zip(held, tokens, strict=True)]
            at = np.flatnonzero(np.concatenate(held))
            x = [t.pair_name[h] if kind == 2 else name(t.triple[h], 3) for h, t in zip(held, tokens, strict=True)]
        x = np.concatenate([*x, np.zeros(0, U)]) >> U(16)
        return np.arange(len(x)) if at is None else at, x

    def tokens_of(self, source):
        """(batch, tokens, what ``look`` gives) of texts, or of chunks that ``_look`` has looked up."""
        if not self.asked:
            for batch in K.batches(source):
                t = Tokens(batch.column("text"))
                yield batch, t, self.look(t)
            return
        for texts, *answers in _gather(source):
            held = [Tokens(b.column("text")) for b in texts]
            n = sum(len(t.hash) for t in held)
            seen = np.zeros((5, n), np.int64)  # levels of words, pairs and triples, and the sums after words and pairs
            for kind, answer in zip(LEAST, answers, strict=True):
                if kind == 1 and 1 in self.filter.words:
                    seen[0], seen[3] = self.word(np.concatenate([t.hash for t in held]))
                    continue
                at, x = self.names(held, kind)
                new, back = np.unique(x, return_inverse=True)
                if len(new) != len(answer[0]):
                    raise ValueError("a chunk of texts is not the one that was looked up: its rows have changed between two readings")
                seen[kind - 1, at] = answer[0][back]
                if kind < 3:
                    seen[kind + 2, at] = answer[1][back]
            seen[2, seen[1] == 0] = 0  # a triple is held with its pair only
            lo = 0
            for batch, t in zip(texts, held, strict=True):
                hi = lo + len(t.hash)
                yield batch, t, tuple(seen[:, lo:hi])
                lo = hi


BLOCKS = "chunk long, kind int, bucket int, at int, block binary"
_BLOCKS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("at", pa.int32()), ("block", pa.binary())])


def _chunks(source, chunk_bytes: int = 12 << 20):
    """(first row_id, batches) of texts of about ``chunk_bytes`` together: the same at each reading."""
    held, size = [], 0
    for batch in K.batches(source):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= chunk_bytes:
            yield held[0].column("row_id")[0].as_py(), held
            held, size = [], 0
    if held:
        yield held[0].column("row_id")[0].as_py(), held


def _texts(source):
    """Of each chunk its batches as Arrow streams (kind 0)."""
    for number, held in _chunks(source):
        for i, batch in enumerate(held):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            yield pa.record_batch([[number], [0], [0], [i], [sink.getvalue().to_pybytes()]], schema=_BLOCKS)


def _ask(model, power: int):
    """Of each chunk the distinct names of its words, pairs and triples that must be asked, six bytes each, in order, by 2**power groups of buckets."""

    def run(source):
        for number, held in _chunks(source):
            tokens, rows = [Tokens(b.column("text")) for b in held], []
            for kind in LEAST:
                x = np.unique(model.value.names(tokens, kind)[1])
                low = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows += [(number, kind, b, 0, low[lo:hi].tobytes()) for b, lo, hi in _by_bucket((x >> U(48 - power)).astype(np.int64))]
            if rows:
                yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=_BLOCKS)

    return run


def _answer(segment: dict[int, int], bits: int, power: int):
    """Rows sorted by (kind, bucket, chunk), a group's segments (chunk -1) before what is asked -> levels of the names, and the sums after them, byte by byte."""
    each = 1 << (bits - power)

    def run(source):
        now, f = None, None
        for batch in source:
            rows = []
            for chunk, kind, bucket, at, block in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "bucket", "at")), batch.column("block"), strict=True):
                block = block.as_buffer()
                if (kind, bucket) != now:
                    parts = (kind, FIRST) if kind == 2 else (kind,)
                    now, f = (kind, bucket), Filter({p: np.zeros(segment[p] * each, U) for p in parts}, segment, bits)
                if chunk < 0:
                    part, at = (FIRST, at - each) if at >= each else (kind, at)
                    f.words[part][at * segment[part] : (at + 1) * segment[part]] = np.frombuffer(block, "<u8")
                    continue
                x = np.zeros((len(block) // 6, 8), np.uint8)
                x[:, 2:] = np.frombuffer(block, np.uint8).reshape(-1, 6)
                x = x.view("<u8")[:, 0].astype(U)
                if kind == 3:
                    got = f.levels(3, x).astype(np.uint8).tobytes()
                else:
                    lev, total = f.entry(kind, x)
                    got = lev.astype(np.uint8).tobytes() + total.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
                rows.append((chunk, kind, bucket, 0, got))
            if rows:
                yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=_BLOCKS)

    return run


def _gather(source):
    """Rows sorted by (chunk, kind, bucket, at) -> of each chunk: its batches, and of its words, pairs and triples the levels and sums in order of names."""
    now, held = None, [[], [], [], []]

    def out():
        texts = [b for t in held[0] for b in pa.ipc.open_stream(t).read_all().to_batches()]
        answers = []
        for kind in LEAST:
            planes = [np.frombuffer(b, np.uint8).reshape(1 if kind == 3 else 7, -1) for b in held[kind]]
            planes = np.concatenate([*planes, np.zeros((1 if kind == 3 else 7, 0), np.uint8)], axis=1)
            total = np.zeros((planes.shape[1], 8), np.uint8)
            total[:, : len(planes) - 1] = planes[1:].T
            answers.append((planes[0].astype(np.int64), total.view("<i8")[:, 0]))
        return texts, *answers

    for batch in source:
        for chunk, kind, block in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "block")), strict=True):
            if chunk != now:
                if now is not None:
                    yield out()
                now, held = chunk, [[], [], [], []]
            held[kind].append(block)
    if now is not None:
        yield out()


def _look(rows: DataFrame, model: Model, segments: DataFrame, segment: dict[int, int], bits: int, group_bytes: int) -> DataFrame:
    """The blocks of each chunk of ``rows`` together: its texts, and what the filter's segments hold of its n-grams."""
    largest = max(8 * segment[3], 8 * (segment[2] + segment[FIRST]), 0 if 1 in model.filter.words else 8 * segment[1]) << bits
    power = int(np.clip(np.ceil(np.log2(largest / group_bytes)), 0, bits))
    each = 1 << (bits - power)
    first = F.col("kind") == FIRST
    field = segments.select(
        F.lit(-1).cast("long").alias("chunk"),
        F.when(first, 2).otherwise(F.col("kind")).alias("kind"),
        F.floor(F.col("bucket") / each).cast("int").alias("bucket"),
        (F.col("bucket") % each + F.when(first, each).otherwise(0)).cast("int").alias("at"),
        F.col("bits").alias("block"),
    )
    asked = rows.mapInArrow(_ask(rows.sparkSession.sparkContext.broadcast(model), power), BLOCKS)
    sent = field.unionAll(asked).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk")
    answers = sent.mapInArrow(_answer(segment, bits, power), BLOCKS)
    return answers.unionAll(rows.mapInArrow(_texts, BLOCKS)).repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket", "at")


def train(spark: SparkSession, rows: DataFrame, *, head: int = 1 << 20, most_bits: int = 1 << 31, bits_each: float = 12.0, block_bytes: int = 8 << 20, group_bytes: int = 16 << 20) -> tuple[Model, DataFrame, DataFrame]:
    """The model learnt from the rows (row_id, doc_id, held_out, text) without held_out, the saved table of words (keys,
    counts) that its tail join reads, and what ``Model.tokens_of`` reads of the rows: these or, where the filter has more
    than ``most_bits`` bits, their chunks, looked up in groups of segments of about ``group_bytes``."""
    texts = rows.where(~F.col("held_out")).select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size, 1) / block_bytes)), 3, 20))

    def counted(sieve=None) -> DataFrame:
        blocks = texts.mapInArrow(_count(bits, sieve), BLOCK).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
        out = saved(blocks.mapInArrow(_merge(bits), TABLE), "ngrams")
        spark.sparkContext._jvm.System.gc()  # the shuffle of the counts goes before the next one comes
        return out

    short = counted()
    pairs = short.where("kind = 2 and part = 0")
    sums = {r[0]: r[1:] for r in short.where("part = 0").groupBy("kind").agg(F.sum("types"), F.sum("total"), F.sum(F.octet_length("keys") / 8)).collect()}
    types, tokens = (int(v or 0) for v in sums.get(1, (0, 0, 0))[:2])
    held_pairs = int(sums.get(2, (0, 0, 0))[2] or 0)
    segment = _segments({FIRST: held_pairs}, bits, bits_each)
    first = None
    if 64 * segment[FIRST] << bits <= most_bits:
        there = saved(pairs.select("bucket", "keys").mapInArrow(_first_level(segment), "kind int, bucket int, bits binary"), "sieve")
        first = _filter(there, segment, bits, (FIRST,))
        remove(there)
    sieve = spark.sparkContext.broadcast(first)
    triples = counted(sieve)
    sieve.unpersist()
    every = short.select("kind", "bucket", "part", "keys", "counts").unionAll(triples.select("kind", "bucket", "part", "keys", "counts"))
    settled = saved(every.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "part").mapInArrow(_settle, SETTLED), "model")
    remove(short)
    remove(triples)

    entries = {r[0]: int(r[1]) for r in settled.groupBy("kind").agg(F.sum("entries")).collect()}
    at = settled.select("kind", F.posexplode(F.arrays_zip("tokens", "followed"))).groupBy("kind", "pos").agg(F.sum("col.tokens"), F.sum("col.followed")).collect()
    by = {kind: np.zeros((2, LEVELS)) for kind in LEAST}
    for kind, pos, n, followed in at:
        by[kind][:, pos] = n, followed
    share = {kind: np.minimum(by[kind][1] / np.maximum(by[kind][0], 1), 0.99) for kind in (1, 2)}
    entries |= {2: entries.get(2, 0) - held_pairs, FIRST: held_pairs}
    segment = _segments(entries, bits, bits_each)
    fits = lambda parts: 64 * sum(segment[p] for p in parts) << bits <= most_bits
    part = "kind int, bucket int, bits binary"
    here = next(p for p in ((1, 2, 3), (1,), ()) if not p or fits((*p, FIRST)))
    held = Filter({}, segment, bits)
    if here:
        there = saved((settled if len(here) == 3 else settled.where("kind = 1")).mapInArrow(_fill(segment), part), "segments")
        held = _filter(there, segment, bits, here)
        remove(there)
    if first is not None:
        held.words |= first.words

    words = settled.where("kind = 1").select("keys", "counts")
    least = _head_floor(words, head)
    top = words.mapInArrow(_head_blocks(least), "keys binary, counts binary").collect()  # at most ``head`` words
    key = np.concatenate([np.frombuffer(r[0], "<u8") for r in top] or [np.zeros(0, "<u8")]).astype(U)
    n = np.concatenate([np.frombuffer(r[1], "<i8") for r in top] or [np.zeros(0, "<i8")])
    order = np.argsort(key)
    model = Model(held, len(here) < 3, tokens, types, float(by[1][0].sum()), share, key[order], n[order], least > 1)
    if model.asked:
        segments = settled.where("kind > 1" if 1 in here else "true").mapInArrow(_fill(segment), part)
        segments = segments.unionAll(settled.where("kind = 2").select("bucket", "keys").mapInArrow(_first_level(segment), part))
        rows = _look(rows, model, segments, segment, bits, group_bytes)
    return model, settled, rows


def _first_level(segment: dict[int, int]):
    """Filter segments of the first level of pairs."""

    def run(source):
        for batch in source:
            for bucket, keys in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys")), strict=True):
                word = np.zeros(segment[FIRST], U)
                np.bitwise_or.at(word, *Filter.spot(name(np.frombuffer(keys, "<u8").astype(U), 2), 1, segment[FIRST]))
                yield pa.record_batch([pa.array([FIRST], pa.int32()), pa.array([bucket], pa.int32()), pa.array([word.astype("<u8").tobytes()], pa.binary())], ["kind", "bucket", "bits"])

    return run


def _head_floor(words: DataFrame, head: int) -> int:
    """The least count that at most ``head`` words reach, from a histogram of counts by powers of two."""

    def run(source):
        h = np.zeros(64, np.int64)
        for batch in source:
            for c in batch.column("counts").to_pylist():
                h += np.bincount(np.log2(np.frombuffer(c, "<u8").astype(float)).astype(np.int64), minlength=64)
        yield pa.record_batch([pa.array(np.arange(64, dtype=np.int32)), pa.array(h)], ["power", "n"])

    by = dict(words.mapInArrow(run, "power int, n long").groupBy("power").agg(F.sum("n")).collect())
    total = 0
    for p in range(63, -1, -1):
        total += by.get(p, 0)
        if total > head:
            return 1 << (p + 1)
    return 1


def _head_blocks(least: int):
    """Words of ``least`` counts or more, packed, a row a bucket."""

    def run(source):
        for batch in source:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                key, n = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                yield pa.record_batch([pa.array([key[n >= least].tobytes()]), pa.array([n[n >= least].tobytes()])], ["keys", "counts"])

    return run


def _tail(least: int):
    """A row for each word of fewer counts."""

    def run(source):
        for batch in source:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                key, n = np.frombuffer(k, "<i8"), np.frombuffer(c, "<i8")
                yield pa.record_batch([pa.array(key[n < least]), pa.array(n[n < least])], ["key", "n"])

    return run


PART = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, keys array<long>, times array<int>"


def _score(model):
    def run(source):
        m = model.value
        floor = float(np.log10(m.tokens + m.types + 1))
        for batch, t, seen in m.tokens_of(source):
            rows = batch.num_rows
            p = m.score(t, seen)
            if len(m.head_key):
                at = np.minimum(np.searchsorted(m.head_key, t.hash), len(m.head_key) - 1)
                c = np.where(m.head_key[at] == t.hash, m.head_count[at], 0)
            else:
                c = np.zeros(len(t.hash), np.int64)
            here = c > 0 if m.tail else np.ones(len(c), bool)
            base = np.bincount(t.row, np.where(here, np.log10(c + 1.0) - floor, 0.0), rows)
            known = np.bincount(t.row[c > 0], minlength=rows)
            keys, times = [[]] * rows, [[]] * rows
            if m.tail:
                rest = ~here
                row, h = t.row[rest], t.hash[rest]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(h)))
                cut = np.searchsorted(row[first], np.arange(rows + 1))
                offsets = pa.array(cut.astype(np.int32))
                keys = pa.ListArray.from_arrays(offsets, pa.array(K.signed(h[first])))
                times = pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))
            else:
                keys, times = pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("row_id"), batch.column("doc_id"), batch.column("held_out"), pa.array(t.count.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.bincount(t.row, p, rows)), keys, times], [f.split()[0] for f in PART.split(", ")])

    return run


def score(spark: SparkSession, docs: DataFrame, held_out: Column, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows with held_out are not learnt from."""
    flag = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), "text")
    model, settled, rows = train(spark, rows, **how)
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), PART)
    base, known = F.col("base_score"), F.col("n_known")
    if model.tail:
        scored = saved(scored, "scored")
        words = settled.where("kind = 1").select("keys", "counts")
        least = _head_floor(words, how.get("head", 1 << 20))
        tail = words.mapInArrow(_tail(least), "key long, n long")
        asked = scored.select("row_id", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row_id", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
        n = F.coalesce("n", F.lit(0))
        floor = float(np.log10(model.tokens + model.types + 1))
        found = asked.join(tail, "key", "left").groupBy("row_id").agg(F.sum(F.col("times") * (F.log10(n + 1.0) - floor)).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
        scored = scored.drop("keys", "times").join(found, "row_id", "left")
        base, known = base + F.coalesce("more", F.lit(0.0)), known + F.coalesce("more_known", F.lit(0)).cast("long")
    elif not model.asked:
        remove(settled)
    return scored.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
