"""Benchmark decontamination by winnowing.

Documents and benchmark items keep the minimum k-gram hash of each sliding window (k + w - 1 = the shortest span that
counts), so every shared span of that length shares a kept fingerprint.  Fingerprints are joined; around each that
meets, the spans that hold it are compared with the items' spans by hash, and neighbouring equal spans extend to one hit.
A span is compared once however often its fingerprints meet, so work grows with the text, not with the pairs of places
where repeated words are alike.  Items shorter than the span are winnowed with a window of one: their whole sequence is
a fingerprint.

A benchmark of up to ``block_bytes`` of text is indexed and broadcast, and a document's task does the join.  Of a larger
one only a Bloom filter of its fingerprints is broadcast (``filter_bits`` bits an entry, checked against ``most_bits``;
beyond that no filter is used): one pass over the documents sends the spans around the fingerprints that it holds, each
once a document, to a shuffled join with the benchmark's spans.

Defined results: null or word-free texts have no words and no hits; a null item text has no window; items with a null
id mark words but have no id to report; repeated documents are reported once per row; rows with a null doc_id are
reported with it; extra columns, whatever their names, are ignored by ``decontaminate`` and kept by ``clean_documents``;
an empty benchmark hits nothing; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import renamed, saved

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(h: np.ndarray, first: np.ndarray, count: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams kept in rows of at least ``span`` words; the rightmost minimum wins a tie."""
    g = K.grams(h, k)
    w = span - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = g[w - 1 : w - 1 + n].copy(), np.arange(w - 1, w - 1 + n)
    for j in range(w - 2, -1, -1):
        less = g[j : j + n] < best
        best[less] = g[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    inside = np.zeros(n, bool)
    long = count >= span
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(first[:-1][long], n), 1)
    np.add.at(edge, np.minimum(first[:-1][long] + count[long] - span + 1, n), -1)
    inside = np.cumsum(edge[:-1]) > 0
    at = np.unique(at[inside])
    return at, g[at]


def item_spans(w: K.Words, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, row) of the distinct windows of each row: ``span`` consecutive words, or all of a shorter row."""
    out = []
    if len(w) >= span:
        g = K.grams(w.hash, span)
        row = w.doc[: len(g)]
        at = np.flatnonzero(row == w.doc[span - 1 :])
        out.append((g[at], np.full(len(at), span), row[at]))
    for n in range(1, span):
        rows = np.flatnonzero(w.count == n)
        if len(rows):
            out.append((K.grams(w.hash, n)[w.first[rows]], np.full(len(rows), n), rows))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, n, row = (np.concatenate(x) for x in zip(*out, strict=True))
    once = np.unique(np.stack([h, n.astype(np.uint64), row.astype(np.uint64)]), axis=1)
    return once[0], once[1].astype(np.int64), once[2].astype(np.int64)


def _held(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def spans_around(w: K.Words, met, span: int, k: int, short: list[int], short_met) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, words, hash) of w's spans that hold a kept fingerprint that ``met`` says is the benchmark's, and of its
    spans of the lengths ``short`` whose hash ``short_met`` knows; each place once, spans within their row."""
    out = [np.zeros((3, 0), np.uint64)]
    end_of = w.first[1:]
    at, fp = winnow(w.hash, w.first, w.count, k, span)
    at = at[met(fp)]
    if len(at):
        near = np.unique((at[:, None] - np.arange(span - k + 1)).ravel())
        near = near[near >= 0]
        near = near[near + span <= end_of[w.doc[near]]]
        g = K.grams(w.hash, span)
        out.append(np.stack([near.astype(np.uint64), np.full(len(near), span, np.uint64), g[near]]))
    for n in short:
        if n > len(w):
            continue
        g = K.grams(w.hash, n)
        p = np.flatnonzero(short_met(g, n))
        p = p[p + n <= end_of[w.doc[p]]]
        out.append(np.stack([p.astype(np.uint64), np.full(len(p), n, np.uint64), g[p]]))
    start, n, h = np.concatenate(out, 1)
    return start.astype(np.int64), n.astype(np.int64), h


class Index:
    """Fingerprints and spans of a benchmark that is held whole."""

    def __init__(self, ids: list, texts: list, span: int, k: int):
        w = K.Words(pa.array(texts, pa.large_string()), K.ALNUM)
        self.span, self.k, self.ids = span, k, ids
        self.fp = np.unique(winnow(w.hash, w.first, w.count, k, span)[1])
        h, n, item = item_spans(w, span)
        self.lengths = np.unique(n[n < span]).tolist()
        self.short = {m: np.unique(h[n == m]) for m in self.lengths}
        order = np.lexsort((item, h, n))
        self.hash, self.size, self.item = h[order], n[order], item[order]
        self.cut = {m: (int(np.searchsorted(self.size, m)), int(np.searchsorted(self.size, m, "right"))) for m in [*self.lengths, span]}

    def hits(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of the spans of w that an item has, and (row, item), each pair once."""
        start, n, h = spans_around(w, lambda f: _held(self.fp, f), self.span, self.k, self.lengths, lambda g, m: _held(self.short[m], g))
        keep, pairs = [], [np.zeros((2, 0), np.int64)]
        for m, (lo, hi) in self.cut.items():
            mine = np.flatnonzero(n == m)
            keys = self.hash[lo:hi]
            mine = mine[_held(keys, h[mine])]
            keep.append(mine)
            # the items of a span are looked up once for each text that has it
            x, first = np.unique(np.stack([w.doc[start[mine]].astype(np.uint64), h[mine]]), axis=1, return_index=True)
            a, times = np.searchsorted(keys, x[1]), np.searchsorted(keys, x[1], "right") - np.searchsorted(keys, x[1])
            at = np.repeat(lo + a - np.cumsum(times) + times, times) + np.arange(times.sum())
            pairs.append(np.stack([np.repeat(x[0].astype(np.int64), times), self.item[at]]))
        keep = np.concatenate(keep)
        row, item = np.unique(np.concatenate(pairs, 1), axis=1)
        return start[keep], start[keep] + n[keep], row, item


def _final(doc_id: list, n_words, n_hit, items: list[set[str]]) -> pa.RecordBatch:
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return pa.record_batch(
        [pa.array(doc_id, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _covered(start, end, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _scan(index):
    def run(source):
        ix = index.value
        for batch in K.batches(source):
            w = K.Words(batch.column("text"), K.ALNUM)
            start, end, row, item = ix.hits(w)
            found: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for r, i in zip(row.tolist(), item.tolist(), strict=True):
                if ix.ids[i] is not None:
                    found[r].add(ix.ids[i])
            hit = np.bincount(w.doc[_covered(start, end, len(w))], minlength=batch.num_rows) if len(w) else np.zeros(batch.num_rows, int)
            yield _final(batch.column("doc_id").to_pylist(), w.count.tolist(), hit.tolist(), found)

    return run


class Sieve:
    """A Bloom filter of fingerprints: four bits of one 64-bit word for each."""

    def __init__(self, words: int):
        self.word = np.zeros(words, np.uint64)

    @staticmethod
    def mask(h: np.ndarray) -> np.ndarray:
        h = K.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        out = np.zeros(len(h), np.uint64)
        for i in range(4):
            out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        return out

    def place(self, h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(32)) * np.uint64(len(self.word))) >> np.uint64(32)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        np.bitwise_or.at(self.word, self.place(h), self.mask(h))

    def has(self, h: np.ndarray) -> np.ndarray:
        m = self.mask(h)
        return (self.word[self.place(h)] & m) == m


ITEM = "item_id string, words int, hash long, part int"


def _benchmark_spans(span: int, k: int):
    """A row a distinct window of each item (part 0), and a row a distinct fingerprint of a batch (part 1)."""

    def run(source):
        for batch in K.batches(source):
            w = K.Words(batch.column("text"), K.ALNUM)
            h, n, row = item_spans(w, span)
            fp = np.unique(winnow(w.hash, w.first, w.count, k, span)[1])
            ids = batch.column("item_id").take(pa.array(row))
            none = pa.nulls(len(fp), pa.string())
            yield pa.record_batch([pa.concat_arrays([ids.cast(pa.string()), none]), pa.array(np.append(n, np.zeros(len(fp), np.int64)), pa.int32()), pa.array(K.signed(np.append(h, fp))), pa.array(np.append(np.zeros(len(h)), np.ones(len(fp))), pa.int32())], ["item_id", "words", "hash", "part"])

    return run


def _fill(words: int):
    """The filter's words that are not 0, a row each, from rows (hash)."""

    def run(source):
        for batch in source:
            s = Sieve(words)
            h = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            at, mask = s.place(h), s.mask(h)
            order = np.argsort(at, kind="stable")
            at, mask = at[order], mask[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
            if len(at):
                yield pa.record_batch([pa.array(at[first]), pa.array(K.signed(np.bitwise_or.reduceat(mask, first)))], ["at", "mask"])

    return run


def _ask(sieve, span: int, k: int, short: list[int]):
    """For each document a row with its number of words (hash null), and a row for each distinct span (hash, words) around a fingerprint that the filter holds, with its places."""

    def run(source):
        s = sieve.value if sieve is not None else None
        met = (lambda f: s.has(f)) if s is not None else (lambda f: np.ones(len(f), bool))
        for batch in K.batches(source):
            w = K.Words(batch.column("text"), K.ALNUM)
            start, n, h = spans_around(w, met, span, k, short, lambda g, m: met(g))
            row = w.doc[start]
            order = np.lexsort((start, h, n, row))
            row, n, h, start = row[order], n[order], h[order], start[order]
            key = np.stack([row.astype(np.uint64), n.astype(np.uint64), h])
            first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))) if len(row) else row
            rows = np.arange(batch.num_rows)
            at = pa.array(np.append(rows, row[first]))
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(len(rows), np.int64), first, [len(row)]]).astype(np.int32)), pa.array(start - w.first[row] if len(row) else start))
            null = np.append(np.ones(len(rows), bool), np.zeros(len(first), bool))
            yield pa.record_batch(
                [batch.column("row_id").take(at), batch.column("doc_id").take(at), pa.array(np.append(w.count, n[first]), pa.int64()), pa.array(np.append(np.zeros(len(rows), np.int64), K.signed(h[first])), mask=null), places],
                ["row_id", "doc_id", "words", "hash", "places"],
            )

    return run


def _merge(source):
    for batch in source:
        hit, found = [], []
        for n, spans, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "spans", "items")), strict=True):
            x = [(p, p + s["words"]) for s in spans for p in s["places"]]
            hit.append(int(_covered(*np.array(x, np.int64).T, n).sum()) if x else 0)
            found.append(set(items))
        yield _final(batch.column("doc_id").to_pylist(), batch.column("n_words").to_pylist(), hit, found)


def _items(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where("text is not null")


def _index(spark: SparkSession, items: DataFrame, span: int, k: int, block_bytes: int):
    """The broadcast index of a benchmark of at most ``block_bytes`` of text, else None."""
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > block_bytes:
        return None
    rows = items.collect()
    return spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], span, k))


def _joined(spark: SparkSession, docs: DataFrame, items: DataFrame, span: int, k: int, filter_bits: int, most_bits: int) -> DataFrame:
    """row_id, doc_id, n_words, spans, items of every document; docs: row_id, doc_id, text."""
    parts = saved(items.mapInArrow(_benchmark_spans(span, k), ITEM), "benchmark-spans")
    windows = parts.where("part = 0").groupBy("hash", "words").agg(F.collect_set("item_id").alias("items"))
    keys = parts.where(f"part = 1 or words < {span}").select("hash")
    short = sorted(r[0] for r in parts.where(f"part = 0 and words < {span}").select("words").distinct().collect())
    n = keys.count()
    sieve = None
    if n * filter_bits <= most_bits:
        s = Sieve(max(1, n * filter_bits // 64))
        for at, mask in keys.mapInArrow(_fill(len(s.word)), "at long, mask long").groupBy("at").agg(F.expr("bit_or(mask)")).toLocalIterator():
            s.word[at] |= np.uint64(mask % 2**64)
        sieve = spark.sparkContext.broadcast(s)
    asked = saved(docs.mapInArrow(_ask(sieve, span, k, short), "row_id long, doc_id long, words long, hash long, places array<long>"), "asked")
    found = asked.where("hash is not null").join(windows, ["hash", "words"]).groupBy("row_id").agg(F.collect_list(F.struct("words", "places")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    whole = asked.where("hash is null").select("row_id", "doc_id", F.col("words").alias("n_words"))
    none = F.array().cast("array<struct<words:bigint,places:array<bigint>>>"), F.array().cast("array<string>")
    return whole.join(found, "row_id", "left").select("row_id", "doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def decontaminate(spark: SparkSession, docs: DataFrame, bench: DataFrame, *, span: int = 10, k: int = 5, block_bytes: int = 16 << 20, filter_bits: int = 16, most_bits: int = 1 << 31) -> DataFrame:
    """One row per document: words, hit words, items with an occurring window (see the module for nulls and ties)."""
    items = _items(bench)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = _index(spark, items, span, k, block_bytes)
    if index is not None:
        return docs.mapInArrow(_scan(index), SCHEMA)
    docs = docs.withColumn("row_id", F.monotonically_increasing_id())
    return _joined(spark, docs, items, span, k, filter_bits, most_bits).mapInArrow(_merge, SCHEMA)


def clean_documents(spark: SparkSession, docs: DataFrame, bench: DataFrame, *, span: int = 10, k: int = 5, block_bytes: int = 16 << 20, filter_bits: int = 16, most_bits: int = 1 << 31) -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns kept; nothing is shuffled where the benchmark is broadcast (beyond that they are saved once, numbered)."""
    items, plain = _items(bench), renamed(docs, "text")
    index = _index(spark, items, span, k, block_bytes)
    if index is not None:
        return plain.mapInArrow(_keep(index), plain.schema).toDF(*docs.columns)
    kept = saved(plain.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    asked = kept.select("row_id", F.lit(None).cast("long").alias("doc_id"), "text")
    dirty = _joined(spark, asked, items, span, k, filter_bits, most_bits).where(F.size("spans") > 0).select("row_id")
    return kept.join(dirty, "row_id", "left_anti").select(*plain.columns).toDF(*docs.columns)


def _keep(index):
    def run(source):
        for batch in K.batches(source):
            w = K.Words(batch.column(batch.schema.get_field_index("text")), K.ALNUM)
            start, _, _, _ = index.value.hits(w)
            ok = np.ones(batch.num_rows, bool)
            ok[w.doc[start]] = False
            yield batch.filter(pa.array(ok))

    return run
