"""Packing by vector bin packing.

Each piece of a document is a vector (tokens, segments, loss-bearing tokens); a sequence is a bin with a limit in each
dimension.  A token bears loss when it has something before it in its piece to be predicted from, and is not one of the
document's first ``prompt`` tokens (a column of counts: the instruction before an answer; none by default).  One bin is
open at a time: the piece with the largest dot product of its vector and what the bin has left goes in, among the pieces
that fit.  Pieces with equal vectors share one class, so a choice costs one product over the distinct vectors.  A
document longer than a sequence is first cut into whole sequences and a rest; when nothing fits into a gap of at least
``least_cut`` tokens, a waiting piece is cut to fill it as far as the loss limit allows.

A task packs the documents it reads in windows of ``window`` tokens and hands the unfilled bin on, so memory is
bounded and nothing is shuffled; a task that runs again reads the same rows and gives the same sequences.  The last
bin of a task is cut into sequences whose lengths are powers of two, which need no padding.

Defined results: a null text is an empty document (its end id alone); repeated documents are packed once per row, with
a null doc_id too; a null prompt is none; every id of every document, however long, lies in exactly one piece; ties go to
the later vector in order; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .pretokens import WordIds

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_made: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder a Python worker."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


class Packer:
    """Places pieces (key, start, length, loss) into bins; ``full`` gets (sequence, offset, piece) of each closed bin."""

    def __init__(self, tokens: int, segments: int, loss: int, least_cut: int):
        self.limit = np.array([tokens, segments, loss], np.int64)
        self.least_cut = least_cut
        self.classes: dict[tuple[int, int], list] = {}
        self.order: list[tuple[int, int]] = []
        self.prompt: dict[object, int] = {}
        self.waiting = 0
        self.sequence = 0
        self.full: list[tuple] = []
        self.open: list[tuple] = []
        self.left = self.limit.copy()

    def loss(self, key, start: int, length: int) -> int:
        """Loss-bearing tokens of a piece."""
        return max(0, start + length - max(start + 1, self.prompt.get(key, 0)))

    def add(self, key, start: int, length: int) -> None:
        k = (length, self.loss(key, start, length))
        if k not in self.classes:
            self.classes[k] = []
            insort(self.order, k)
        self.classes[k].append((key, start))
        self.waiting += length

    def take(self, k) -> tuple:
        key, start = self.classes[k].pop()
        if not self.classes[k]:
            del self.classes[k]
            self.order.remove(k)
        self.waiting -= k[0]
        return key, start, *k

    def place(self, piece: tuple) -> None:
        self.open.append(piece)
        self.left -= [piece[2], 1, piece[3]]

    def close(self) -> None:
        at = 0
        for p in self.open:
            self.full.append((self.sequence, at, p))
            at += p[2]
        self.sequence += 1
        self.open, self.left = [], self.limit.copy()

    def cut(self) -> bool:
        """Fill the gap with the head of the longest waiting piece, as far as the limits allow; whether that was worth a cut."""
        key, start = self.classes[self.order[-1]][-1]
        head = min(int(self.left[0]), self.order[-1][0] - 1)
        over = self.loss(key, start, head) - int(self.left[2])
        head -= max(0, over)
        if head < self.least_cut or not self.left[1]:
            return False
        key, start, length, _ = self.take(self.order[-1])
        self.place((key, start, head, self.loss(key, start, head)))
        self.add(key, start + head, length - head)
        return True

    def pack(self, keep: int = 0) -> None:
        """Fill bins until at most ``keep`` tokens wait."""
        weight = 1.0 / self.limit
        while self.waiting > keep:
            n = len(self.order)
            v = np.empty((n, 3))
            v[:, ::2] = self.order
            v[:, 1] = 1
            whole = True
            while whole and self.waiting > keep and len(self.order) == n:
                fits = (v <= self.left).all(1)
                if fits.any():
                    dot = np.where(fits, v @ (self.left * weight * weight), -1.0)
                    self.place(self.take(self.order[int(dot.argmax())]))
                elif self.left[0] >= self.least_cut and self.cut():
                    whole = False
                else:
                    self.close()
                if not self.left[0]:
                    self.close()

    def finish(self) -> None:
        """Pack all that waits; the last bin becomes sequences whose lengths are powers of two."""
        self.pack()
        pieces, self.open = self.open, []
        total = sum(p[2] for p in pieces)
        for bit in reversed(range(total.bit_length())):
            need = total & (1 << bit)
            while need:
                key, start, length, _ = pieces.pop(0)
                n = min(need, length)
                self.open.append((key, start, n, self.loss(key, start, n)))
                if n < length:
                    pieces.insert(0, (key, start + n, length - n, 0))
                need -= n
            if self.open:
                self.close()


def pack(docs: DataFrame, path: str, *, tokens: int = 2048, segments: int = 256, loss: int | None = None, prompt: Column | None = None, end_id: int = 1, least_cut: int = 16, window: int = 1 << 22) -> DataFrame:
    """One row per piece: where its ids are in their document and in their sequence, and the ids' checksum.

    ``loss`` limits a sequence's loss-bearing tokens; by default it is no tighter than ``tokens``.  ``prompt``: number of a
    document's first tokens that bear none."""
    most_loss = tokens if loss is None else loss

    def run(source):
        from pyspark import TaskContext

        enc, p = encoder(path), Packer(tokens, segments, most_loss, least_cut)
        p.sequence = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}  # row: doc_id, ids as bytes, ids not yet given out
        n = 0

        def out():
            rows = []
            for seq, at, (key, start, length, lossy) in p.full:
                doc, ids, _ = held[key]
                rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, seq, at, lossy))
                held[key][2] -= length
                if not held[key][2]:
                    del held[key]
                    p.prompt.pop(key, None)
            p.full.clear()
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        for batch in K.batches(source):
            ids, off = enc.encode(batch.column("text"))
            for r, (doc, silent) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("prompt").to_pylist(), strict=True)):
                mine = np.append(ids[off[r] : off[r + 1]], end_id).astype("<u4")
                held[n] = [doc, mine.tobytes(), len(mine)]
                if silent:
                    p.prompt[n] = silent
                whole = min(tokens, most_loss + 1)
                for s in range(0, len(mine), whole):
                    p.add(n, s, min(whole, len(mine) - s))
                n += 1
            if p.waiting > window:
                p.pack(window // 8)
                yield out()
        p.finish()
        yield out()

    silent = F.lit(None).cast("long") if prompt is None else prompt.cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", silent.alias("prompt")).mapInArrow(run, SCHEMA)
