"""Language identification with a linear-chain conditional random field over words.

A word's features are hashed to a table of fixed size: the word itself (lexicon), its first and last 1 to 4 bytes
(affixes), and its byte trigrams (n-grams).  Weights and transitions are learned together from a bounded sample of
labelled texts: runs of words from texts of different languages are spliced to code-switched chains, whose
log-likelihood is raised with Adagrad steps on forward-backward expectations.

Prediction labels every word of every text by forward-backward.  All chains of a batch are one sequence with resets;
chunk products of transition matrices are combined by a prefix scan, so that long and short texts run in lockstep.  A
text's language is the label with the most expected words, its score that label's share.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language in
order; without training texts every text is ``und``; texts of any length are labelled whole; rows with a null doc_id are
labelled (their held_out is false) and not learnt from; repeated rows get equal results; extra columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
U = np.uint64
#: Words: runs of ASCII letters and bytes beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[0x61:0x7B] = INSIDE[0x80:] = True


def features(w: K.Words, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, start of each word's) of the words ``at``."""
    n = len(at)
    fixed = [K.mix(w.hash[at] + U(1)), *(w.prefix(at, k) for k in (1, 2, 3, 4)), *(w.suffix(at, k) for k in (1, 2, 3, 4))]
    fixed = np.stack([K.mix(h + U(i)) for i, h in enumerate(fixed)], 1) if n else np.zeros((0, 9), U)
    m = np.maximum(w.size[at] - 2, 0)
    first = np.cumsum(m) - m
    where = np.repeat(w.start[at] - first, m) + np.arange(m.sum())
    b = w.low.astype(U)
    tri = K.mix(b[where] + (b[where + 1] << U(8)) + (b[where + 2] << U(16)) + U(0x77 << 24)) if len(where) else np.zeros(0, U)
    size = m + 9
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), U)
    out[(start[:, None] + np.arange(9)).ravel()] = fixed.ravel()
    out[np.repeat(start + 9 - first, m) + np.arange(len(tri))] = tri
    return (out >> U(64 - bits)).astype(np.int64), start


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    move: np.ndarray  # log transition scores
    begin: np.ndarray
    bits: int

    def emissions(self, w: K.Words) -> np.ndarray:
        """exp scores of each word, scaled to a largest entry of 1; each distinct word is scored once."""
        _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        f, start = features(w, at, self.bits)
        s = np.add.reduceat(self.weights[f], start, axis=0) if len(at) else np.zeros((0, len(self.langs)))
        return np.exp(s - s.max(1, keepdims=True)).astype(np.float64)[back]

    def posteriors(self, w: K.Words, chunk: int = 32) -> np.ndarray:
        """Label probabilities of each word given its whole text."""
        e = self.emissions(w)
        n, size = e.shape
        if not n:
            return e
        a, pi = np.exp(self.move - self.move.max()), np.exp(self.begin - self.begin.max())
        starts = np.zeros(n, bool)
        starts[w.first[:-1][w.count > 0]] = True
        rows = -(-n // chunk)
        pad = rows * chunk - n
        e = np.concatenate([e, np.ones((pad, size))]).reshape(rows, chunk, size)
        reset = np.concatenate([starts, np.ones(pad, bool)]).reshape(rows, chunk)

        def norm(x, axes):
            return x / np.maximum(x.sum(axes, keepdims=True), 1e-300)

        def matrix(j):
            """Of step j of all chunks: what the labels before it pass on; a new text forgets them."""
            m = np.where(reset[:, j, None, None], pi, a)
            return m * e[:, j, None, :]

        product = np.broadcast_to(np.eye(size), (rows, size, size))
        for j in range(chunk):
            product = norm(product @ matrix(j), (1, 2))
        ahead, behind = product.copy(), product.copy()  # products of chunks up to here, and from here on
        gap = 1
        while gap < rows:
            ahead[gap:] = norm(ahead[:-gap] @ ahead[gap:], (1, 2))
            behind[:-gap] = norm(behind[:-gap] @ behind[gap:], (1, 2))
            gap *= 2
        alpha = np.full((rows, size), 1 / size)
        alpha[1:] = norm(ahead[:-1].sum(1), 1)
        beta = np.ones((rows, size))
        beta[:-1] = norm(behind[1:].sum(2), 1)
        forward = np.empty((rows, chunk, size))
        for j in range(chunk):
            alpha = norm(np.where(reset[:, j, None], pi, alpha @ a) * e[:, j], 1)
            forward[:, j] = alpha
        for j in range(chunk - 1, -1, -1):
            forward[:, j] = norm(forward[:, j] * beta, 1)
            v = e[:, j] * beta
            beta = norm(np.where(reset[:, j, None], (v * pi).sum(1, keepdims=True) * np.ones(size), v @ a.T), 1)
        return forward.reshape(-1, size)[:n]


def _chains(words: list[list[int]], labels: list[int], length: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Code-switched chains: runs of 4 to 40 words of random texts, until each word has been used about once."""
    pieces = []
    for text, y in zip(words, labels, strict=True):
        i = 0
        while i < len(text):
            n = int(rng.integers(4, 41))
            pieces.append((text[i : i + n], y))
            i += n
    order = rng.permutation(len(pieces))
    flat = np.concatenate([pieces[i][0] for i in order]) if len(order) else np.zeros(0, np.int64)
    lab = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order]) if len(order) else np.zeros(0, np.int64)
    rows = len(flat) // length
    return flat[: rows * length].reshape(rows, length), lab[: rows * length].reshape(rows, length)


def learn(texts: list[str], labels: list[str], *, bits: int = 18, epochs: int = 3, length: int = 64, batch: int = 64, rate: float = 0.3, seed: int = 7) -> Model:
    """Train on whole texts; the caller bounds their number and size."""
    langs = sorted(set(labels))
    size = len(langs)
    w = K.Words(pa.array(texts, pa.large_string()), INSIDE)
    m = Model(langs, np.zeros((1 << bits, size)), np.zeros((size, size)), np.zeros(size), bits)
    if size < 2 or not len(w):
        return m
    _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    f, start = features(w, at, bits)
    end = np.append(start[1:], len(f))
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(langs)}
    words = [back[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    y = [number[x] for x in labels]
    seen, seen_move, seen_begin = np.full_like(m.weights, 1e-6), np.full((size, size), 1e-6), np.full(size, 1e-6)
    for _ in range(epochs):
        x, gold = _chains(words, y, length, rng)
        for lo in range(0, len(x), batch):
            ids, g = x[lo : lo + batch], gold[lo : lo + batch]
            b = len(ids)
            own, inv = np.unique(ids, return_inverse=True)
            inv = inv.reshape(ids.shape)
            n = end[own] - start[own]
            first = np.cumsum(n) - n
            feat = f[np.repeat(start[own] - first, n) + np.arange(n.sum())]
            s = np.add.reduceat(m.weights[feat], first, axis=0)
            e = np.exp(s - s.max(1, keepdims=True))[inv]
            a, pi = np.exp(m.move), np.exp(m.begin)
            alpha = np.empty((b, length, size))
            scale = np.empty((b, length))
            v = pi * e[:, 0]
            for t in range(length):
                if t:
                    v = (alpha[:, t - 1] @ a) * e[:, t]
                scale[:, t] = v.sum(1)
                alpha[:, t] = v / scale[:, t, None]
            beta = np.ones((b, size))
            post = np.empty_like(alpha)
            pairs = np.zeros((size, size))
            for t in range(length - 1, -1, -1):
                post[:, t] = alpha[:, t] * beta
                if t:
                    u = e[:, t] * beta / scale[:, t, None]
                    pairs += (alpha[:, t - 1].T @ u) * a
                    beta = u @ a.T
            diff = -post
            np.put_along_axis(diff, g[..., None], np.take_along_axis(diff, g[..., None], 2) + 1, 2)
            by_word = np.zeros((len(own), size))
            for k in range(size):
                by_word[:, k] = np.bincount(inv.ravel(), diff[..., k].ravel(), len(own))
            rows, pos = np.unique(feat, return_inverse=True)
            each = np.repeat(by_word, n, axis=0)
            grad = np.stack([np.bincount(pos, each[:, k], len(rows)) for k in range(size)], 1) / b - 1e-5 * m.weights[rows]
            seen[rows] += grad**2
            m.weights[rows] += rate * grad / np.sqrt(seen[rows])
            real = np.zeros((size, size))
            np.add.at(real, (g[:, :-1].ravel(), g[:, 1:].ravel()), 1)
            grad = (real - pairs) / b
            seen_move += grad**2
            m.move += rate * grad / np.sqrt(seen_move)
            grad = np.bincount(g[:, 0], minlength=size) / b - post[:, 0].mean(0)
            seen_begin += grad**2
            m.begin += rate * grad / np.sqrt(seen_begin)
    m.weights = m.weights.astype(np.float32)
    return m


def fit(docs: DataFrame, train: Column, *, texts: int = 300, most_bytes: int = 20_000, **how) -> Model:
    """Learn every label from about ``texts`` of its texts, those of least hash; of a text of more than ``most_bytes`` characters
    a run of that length from a place that its hash chooses.  So the sample is bounded by the number of labels."""
    h = F.xxhash64("doc_id", F.length("text"))
    rows = docs.where(train & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(h, F.lit(1_000_003)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    some = rows.join(F.broadcast(sizes), "lang").where(F.col("h") * F.col("n") <= 1_000_003.0 * texts)
    # equal hashes (repeated rows) do not make the sample longer
    first = F.row_number().over(Window.partitionBy("lang", "h").orderBy("text"))
    some = some.withColumn("first", first).where("first = 1")
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - most_bytes, F.lit(0)) + 1).cast("int") + 1
    got = some.select(F.substring(F.col("text"), place, F.lit(most_bytes)).alias("text"), "lang", "h").toPandas()
    if not len(got):
        return Model([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0), 0)
    got = got.sort_values(["h", "lang", "text"])
    return learn(got["text"].tolist(), got["lang"].tolist(), **how)


def _has_letter(data: bytes) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in data.decode("utf-8", "replace"))


def predict(spark: SparkSession, docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, words and language switches of each row."""
    shared = spark.sparkContext.broadcast(model)

    def run(source):
        m = shared.value
        for batch in K.batches(source, most=2 << 20):
            rows = batch.num_rows
            w = K.Words(batch.column("text"), INSIDE)
            size = len(m.langs)
            lang, score, switches = np.full(rows, size), np.zeros(rows), np.zeros(rows, np.int64)
            if len(w) and size:
                ascii_letter = np.concatenate([[0], np.cumsum((w.low >= 0x61) & (w.low <= 0x7A))])[w.off]
                letters = np.diff(ascii_letter) > 0
                for r in np.flatnonzero(~letters & (w.count > 0)).tolist():
                    letters[r] = _has_letter(w.data[w.off[r] : w.off[r + 1]].tobytes())
                p = m.posteriors(w)
                total = np.zeros((rows, size))
                full = np.flatnonzero(w.count > 0)
                total[full] = np.add.reduceat(p, w.first[full], axis=0)
                top = total.argmax(1)
                lang[letters] = top[letters]
                score[letters] = np.clip(total[np.arange(rows), top] / np.maximum(w.count, 1), 0, 1)[letters]
                label = p.argmax(1)
                change = np.zeros(len(w), bool)
                change[1:] = (label[1:] != label[:-1]) & (w.doc[1:] == w.doc[:-1])
                switches = np.bincount(w.doc[change], minlength=rows)
            names = [*m.langs, "und"]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([names[i] for i in lang.tolist()], pa.string()), pa.array(score), pa.array(w.count.astype(np.int64)), pa.array(switches.astype(np.int64))], ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)
