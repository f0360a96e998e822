"""Token-id files coded with a static range asymmetric numeral system (rANS).

One frequency table of all ids, scaled to 2**20, is shared by all files.  A file holds whole documents in ascending
doc_id order.  Its ids are cut into independent blocks; symbol i of a block goes to lane i mod ``LANES``, and each lane
is an rANS coder of its own, so that lanes run side by side.  At every checkpoint the states and read positions of all
lanes are kept: decoding can begin there, and the reader decodes all stretches between checkpoints of all blocks in
lockstep.  Blocks and the header carry CRC-32 sums, which the reader verifies.

Layout, little-endian: magic, header length, header CRC; header = counts, base (ids of earlier files of the same task),
table CRC, doc ids, doc sizes, per block (ids, payload bytes, CRC of its ids); then the payloads.  A payload = number of
checkpoints, lane states (u64) and words read so far (u32) at each, lane lengths (u32), lane words (u32).

Files travel as rows of a Parquet table (``content``), which any store that Spark reaches can hold and whose commit
survives lost executors.

Defined results: a null text is an empty document (its end id alone); documents of one doc_id lie next to each other,
those with equal ids in any order (repeated rows are kept, each with a start of its own); null doc_ids come first; extra
columns, whatever their names, are ignored; texts of any length are encoded whole; an empty table gives no file and no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .pack import encoder
from .shared import drop, scratch

MAGIC = b"RANSIDS1"
BITS = 20
LANES = 32
BLOCK = 1 << 17
EVERY = 1 << 10  # steps of all lanes between checkpoints
LOW = np.uint64(1 << 31)
U = np.uint64
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Table:
    """Frequencies that sum to 2**BITS, every id at least 1 (so ids without a count can be coded too)."""

    def __init__(self, counts: np.ndarray):
        room = (1 << BITS) - len(counts)
        share = counts.astype(np.float64) / max(counts.sum(), 1) * room
        f = np.floor(share).astype(np.int64)
        order = np.argsort(f - share, kind="stable")
        f[order[: room - f.sum()]] += 1
        if f.sum() < room:
            f[0] += room - f.sum()
        self.freq = (f + 1).astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_blocks(t: Table, ids: np.ndarray) -> list[bytes]:
    """Payloads of the blocks of ``ids``, all lanes of all blocks in lockstep, last symbols first."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    lanes = blocks * LANES
    steps = BLOCK // LANES
    wide = np.full(blocks * BLOCK, -1, np.int64)
    wide[:n] = ids
    wide = np.ascontiguousarray(wide.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, lanes)
    used = int((wide[:, :LANES] >= 0).any(1).sum())
    x = np.full(lanes, LOW, U)
    words = np.zeros((lanes, used + 1), np.uint32)
    fill = np.zeros(lanes, np.int64)
    marks = {}
    whole = np.arange(lanes)
    for step in range(used - 1, -1, -1):
        s = wide[step]
        at = whole if s.min() >= 0 else np.flatnonzero(s >= 0)
        f, c = t.freq[s[at]], t.cum[s[at]]
        xs = x[at]
        big = xs >= (LOW >> U(BITS) << U(32)) * f
        b = at[big]
        words[b, fill[b]] = (xs[big] & U(0xFFFFFFFF)).astype(np.uint32)
        fill[b] += 1
        xs = np.where(big, xs >> U(32), xs)
        q = xs // f
        x[at] = (q << U(BITS)) + (xs - q * f) + c
        if step % EVERY == 0:
            marks[step // EVERY] = x.copy(), fill.copy()
    out = []
    for k in range(blocks):
        mine = slice(k * LANES, (k + 1) * LANES)
        size = min(BLOCK, n - k * BLOCK)
        points = -(-(-(-size // LANES)) // EVERY)
        head = [np.array([points], "<u4").tobytes()]
        for j in range(points):
            head += [marks[j][0][mine].astype("<u8").tobytes(), (fill[mine] - marks[j][1][mine]).astype("<u4").tobytes()]
        head.append(fill[mine].astype("<u4").tobytes())
        out.append(b"".join(head) + b"".join(words[i, : fill[i]][::-1].astype("<u4").tobytes() for i in range(mine.start, mine.stop)))
    return out


def decode_blocks(t: Table, sizes: list[int], payloads: list[bytes]) -> np.ndarray:
    """The ids of all blocks; every stretch from a checkpoint to the next is decoded at the same time."""
    state, at, where, last, words = [], [], [], [], []
    base = 0
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for k, (size, p) in enumerate(zip(sizes, payloads, strict=True)):
        points = int(np.frombuffer(p, "<u4", 1)[0])
        pos = 4
        done = []
        for j in range(points):
            state.append(np.frombuffer(p, "<u8", LANES, pos).astype(U))
            done.append(np.frombuffer(p, "<u4", LANES, pos + 8 * LANES).astype(np.int64))
            pos += 12 * LANES
            first = j * EVERY * LANES + np.arange(LANES)
            where.append(starts[k] + first)
            last.append(starts[k] + np.minimum(np.full(LANES, size), (j + 1) * EVERY * LANES))
        fill = np.frombuffer(p, "<u4", LANES, pos).astype(np.int64)
        w = np.frombuffer(p, "<u4", offset=pos + 4 * LANES)
        lane = base + np.concatenate([[0], np.cumsum(fill)[:-1]])
        at += [lane + d for d in done]
        words.append(w)
        base += len(w)
    ids = np.zeros(int(starts[-1]), np.uint32)
    if not state:
        return ids
    x, at, where, last = np.concatenate(state), np.concatenate(at), np.concatenate(where), np.concatenate(last)
    w = np.append(np.concatenate(words), np.uint32(0)).astype(U)
    mask, bits, half = U((1 << BITS) - 1), U(BITS), U(32)
    for _ in range(EVERY):
        live = where < last
        if not live.all():
            x, at, where, last = x[live], at[live], where[live], last[live]
        if not len(x):
            break
        slot = x & mask
        s = t.symbol[slot.astype(np.int64)]
        ids[where] = s
        x = t.freq[s] * (x >> bits) + slot - t.cum[s]
        need = x < LOW
        x = np.where(need, (x << half) | w[at * need], x)
        at = at + need
        where = where + LANES
    return ids


def write_file(t: Table, base: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    payloads = encode_blocks(t, ids)
    block = [(min(BLOCK, len(ids) - k * BLOCK), len(p), zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes())) for k, p in enumerate(payloads)]
    null = np.array([d is None for d in doc_ids], np.uint8)
    header = b"".join([np.array([len(doc_ids), len(ids), len(payloads), base, t.crc], "<i8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), sizes.astype("<i8").tobytes(), np.array(block, "<i8").tobytes()])
    return b"".join([MAGIC, np.array([len(header), zlib.crc32(header)], "<u4").tobytes(), header, *payloads])


def read_file(t: Table, content: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """(base, doc ids, sizes, ids); raises ValueError where a checksum fails."""
    if content[:8] != MAGIC:
        raise ValueError("not a token-id file")
    n, crc = np.frombuffer(content, "<u4", 2, 8)
    header = content[16 : 16 + int(n)]
    if zlib.crc32(header) != crc:
        raise ValueError("the header is damaged")
    docs, total, blocks, base, table = (int(v) for v in np.frombuffer(header, "<i8", 5))
    if table != t.crc:
        raise ValueError("the file was written with another frequency table")
    at = 40
    doc_ids = np.frombuffer(header, "<i8", docs, at).tolist()
    null = np.frombuffer(header, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(header, "<i8", docs, at + 9 * docs)
    block = np.frombuffer(header, "<i8", 3 * blocks, at + 17 * docs).reshape(-1, 3).tolist()
    pos, payloads = 16 + int(n), []
    for _, size, _ in block:
        payloads.append(content[pos : pos + size])
        pos += size
    ids = decode_blocks(t, [b[0] for b in block], payloads)
    if len(ids) != total or any(zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != b[2] for k, b in enumerate(block)):
        raise ValueError("a block is damaged")
    return base, [None if z else d for d, z in zip(doc_ids, null.tolist(), strict=True)], sizes, ids


def width(size: int) -> str:
    """Number type of the ids of a vocabulary of ``size`` in scratch tables: two bytes where they hold every id, else four."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _tokenize(path: str, end_id: int, kind: str):
    def run(source):
        enc = encoder(path)
        for batch in K.batches(source):
            ids, off = enc.encode(batch.column("text"))
            ids = ids.astype(kind)
            tail = np.array([end_id], kind).tobytes()
            raw = [ids[a:b].tobytes() + tail for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "ids"])

    return run


def _count(size: int, kind: str):
    def run(source):
        total = np.zeros(size, np.int64)
        for batch in source:
            column = batch.column("ids").cast(pa.large_binary())
            off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            if off[-1] > off[0]:
                total += np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    return run


def _encode(table, file_ids: int, kind: str):
    def run(source):
        from pyspark import TaskContext

        part, shard, base, each = TaskContext.get().partitionId(), 0, 0, np.dtype(kind).itemsize
        docs, raw, n = [], [], 0

        def out():
            ids = np.frombuffer(b"".join(raw), kind).astype(np.uint32)
            sizes = np.array([len(r) // each for r in raw], np.int64)
            content = write_file(table.value, base, docs, sizes, ids)
            return pa.record_batch([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([content], pa.binary())], ["part", "shard", "n_ids", "content"])

        for batch in source:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                raw.append(ids)
                n += len(ids) // each
                if n >= file_ids:
                    yield out()
                    shard, base, docs, raw, n = shard + 1, base + n, [], [], 0
        if docs:
            yield out()

    return run


def _decode(table, starts):
    def run(source):
        first = starts.value
        for batch in source:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                base, docs, sizes, ids = read_file(table.value, content.as_py())
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(at[:-1] + base + first[part]), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_ids(spark: SparkSession, docs: DataFrame, path: str, to: str, *, end_id: int = 2, file_ids: int = 1 << 21) -> Table:
    """Encode every text and write files to ``to``; the shared table is returned and kept beside them (``to`` + "/table").

    Ids are tokenized once, to a table in the shared scratch folder that is removed in the end; its counts make the
    frequency table (at most a row for each id of the vocabulary reaches the driver); then a range exchange on doc_id puts
    the documents in order."""
    vocabulary = max(encoder(path).library.get_vocab_size(with_added_tokens=True), end_id + 1)
    if vocabulary > 1 << (BITS - 1):
        raise ValueError(f"{vocabulary} ids do not fit into a table of 2**{BITS}")
    kind = width(vocabulary)
    tokens = scratch(spark, "ids")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(path, end_id, kind), "doc_id long, ids binary").write.option("compression", "zstd").parquet(tokens)
    rows = spark.read.schema("doc_id long, ids binary").parquet(tokens)
    counts = np.zeros(vocabulary, np.int64)
    total = 0
    for i, n in rows.mapInArrow(_count(vocabulary, kind), "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
        total += n
    table = Table(counts)
    shared = spark.sparkContext.broadcast(table)
    parts = max(1, min(-(-total // file_ids), 100_000))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_encode(shared, file_ids, kind), "part long, shard long, n_ids long, content binary").write.option("compression", "none").parquet(f"{to}/files")
    spark.createDataFrame([(table.freq.astype("<u4").tobytes(),)], "freq binary").coalesce(1).write.parquet(f"{to}/table")
    drop(spark, tokens)
    return table


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files at ``at``."""
    freq = np.frombuffer(spark.read.parquet(f"{at}/table").first()[0], "<u4").astype(np.int64)
    table = Table.__new__(Table)
    table.freq = freq.astype(np.uint64)
    table.cum = np.concatenate([[0], np.cumsum(table.freq)[:-1]]).astype(np.uint64)
    table.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    table.crc = zlib.crc32(freq.astype("<u4").tobytes())
    files = spark.read.parquet(f"{at}/files")
    size = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())  # one row a write task
    starts = np.zeros(max(size, default=-1) + 2, np.int64)
    for p, n in size.items():
        starts[p + 1] = n
    starts = np.cumsum(starts)
    context = spark.sparkContext
    return files.select("part", "content").mapInArrow(_decode(context.broadcast(table), context.broadcast(starts)), SCHEMA)
