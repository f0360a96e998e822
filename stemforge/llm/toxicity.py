"""Toxicity by maximum-scoring segments.

Training (a bounded sample of labelled rows): for words, and for 4- to 7-byte beginnings of the others, the log-odds of being in a
toxic document against a clean one, with a Dirichlet prior in proportion to the overall rate; units whose log-odds are
beyond ``z`` standard deviations and ``least`` make the model, at most ``units`` of them.  A word's weight is that of its most
certain unit wherever it comes, else a small negative drift.

Scoring: the linear-time scan for all maximal scoring segments finds the passages of a text.  Segment scores are
calibrated by extreme-value theory: lambda is the root of sum p e^(lambda s) = 1 over the clean words' weights, K the
likeliest constant of the Gumbel law of the clean texts' best segments; s' = lambda s - ln(K n) is a passage's
normalised score and e^(-s') its expected number in a clean text of n words.  A document's evidence is the sum of the
positive s' of its different passages (a passage that is repeated word for word is found each time and counts once); two logistic coefficients, fitted on the sample, turn it into a probability.

Defined results: null, empty and word-free texts have no passage and get the score of no evidence; labels other than
0 and 1 are not learnt from; of several labels of one doc_id the largest counts; without labels of both kinds every
score is 0; texts of any length are read whole; rows with a null doc_id are scored (their held_out is false) and not
learnt from; repeated rows get equal scores; units of equal certainty are taken in order of their hashes; extra columns,
whatever their names, are ignored by ``score`` and kept by ``civil_documents``; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import renamed

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_passages int, evidence double"
PREFIXES = (4, 5, 6, 7)


@dataclass
class Model:
    unit: np.ndarray  # sorted hashes
    weight: np.ndarray
    certainty: np.ndarray
    drift: float
    scale: float = 1.0  # lambda
    log_k: float = 0.0
    a: float = -30.0
    b: float = 0.0

    def weights(self, w: K.Words) -> np.ndarray:
        """The weight of each word of a batch, looked up once for each distinct word."""
        if not len(w) or not len(self.unit):
            return np.full(len(w), -self.drift)
        _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        out, sure = np.full(len(first), -self.drift), np.zeros(len(first))
        for h in (w.hash[first], *(w.prefix(first, k) for k in PREFIXES)):
            at = np.minimum(np.searchsorted(self.unit, h), len(self.unit) - 1)
            ok = (self.unit[at] == h) & (self.certainty[at] > sure)
            out[ok], sure[ok] = self.weight[at[ok]], self.certainty[at[ok]]
        return out[back]

    def normalised(self, scores: np.ndarray, n) -> np.ndarray:
        return self.scale * scores - self.log_k - np.log(np.maximum(n, 1))


def segments(w: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order, in linear time.

    Each candidate keeps the sum before it and after it, and a link to the nearest earlier candidate with a smaller sum
    before it; a new candidate follows the links and joins all it reaches back to when its end is higher."""
    total = np.concatenate([[0.0], np.cumsum(w)])
    stack: list[list] = []  # start, end, sum before, sum after, link
    for i in np.flatnonzero(w > 0).tolist():
        now = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= now[3]:
                now[4] = j
                stack.append(now)
                break
            now[0], now[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


def first_copies(found: list[tuple[int, int, float]], h: np.ndarray) -> np.ndarray:
    """Of each segment of the words ``h``, whether no earlier one has the same words."""
    seen: set[bytes] = set()
    return np.array([not (k in seen or seen.add(k)) for k in (h[s:t].tobytes() for s, t, _ in found)], bool)


def _units(chosen):
    """Documents of each class that hold a unit, summed within the batch: words, or beginnings of the words that are not ``chosen``."""

    def run(source):
        for batch in K.batches(source):
            w = K.Words(batch.column("text"), K.ALNUM)
            if not len(w):
                continue
            key = np.unique(K.mix(w.hash + w.doc.astype(np.uint64)), return_index=True)[1]
            if chosen is not None:
                key = key[~np.isin(w.hash[key], chosen)]
            units = [w.hash[key]] if chosen is None else [w.prefix(key, k) for k in PREFIXES]
            unit, row = np.concatenate(units), np.tile(w.doc[key], len(units))
            unit, row = unit[unit != 0], row[unit != 0]
            once = np.unique(K.mix(unit + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)[row[once]]
            u, back = np.unique(unit[once], return_inverse=True)
            pos = np.bincount(back, toxic, len(u)).astype(np.int64)
            yield pa.record_batch([pa.array(K.signed(u)), pa.array(pos), pa.array(np.bincount(back, minlength=len(u)) - pos)], ["unit", "pos", "neg"])

    return run


def _training(model):
    """For each sampled document: its size, its words' weights but for the drift, its different segments' scores."""

    def run(source):
        m = model.value
        for batch in K.batches(source):
            w = K.Words(batch.column("text"), K.ALNUM)
            x = m.weights(w)
            marks, found = [], []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                mine = x[a:b]
                marks.append(mine[mine != -m.drift])
                here = segments(mine) if (mine > 0).any() else []
                found.append([v[2] for v, new in zip(here, first_copies(here, w.hash[a:b]), strict=True) if new])
            yield pa.record_batch([batch.column("toxic"), pa.array(w.count.astype(np.int64)), pa.array(marks, pa.list_(pa.float64())), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n", "marks", "found"])

    return run


def _lambda(values: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p e^(lambda s) = 1 (the mean is negative and some value positive)."""
    lo, hi = 0.0, 1.0
    f = lambda x: float(p @ np.exp(np.minimum(x * values, 700)))
    while f(hi) < 1 and hi < 64:
        hi *= 2
    lo = hi / 4096
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 1 else (lo, mid)
    return lo


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Coefficients (a, b) of a ridge logistic fit of y on x, by Newton steps with halving."""
    design = np.stack([np.ones_like(x), x], 1)
    c = np.zeros(2)
    loss = lambda c: float(np.logaddexp(0, design @ c).sum() - y @ (design @ c) + ridge * c @ c)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ c))
        grad = design.T @ (p - y) + 2 * ridge * c
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 2 * ridge * np.eye(2), grad)
        t = 1.0
        while loss(c - t * step) > loss(c) and t > 1e-6:
            t /= 2
        c = c - t * step
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column | None = None, *, most_labelled: int = 100_000, units: int = 1 << 16, prior: float = 20.0, z: float = 3.5, least: float = 1.0, drift: float = 0.25) -> Model:
    """Learn from at most ``most_labelled`` rows of each class (those of least hash) that meet ``train``, a condition on doc_id."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null")
    if train is not None:
        rows = rows.where(train)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = None
    for c in (0, 1):
        part = rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
        some = part if some is None else some.unionAll(part)
    # the sample is bounded by most_labelled, so it can be collected and broadcast
    sample = spark.createDataFrame(some.toPandas().astype({"doc_id": "int64", "toxic": "int32"}), "doc_id long, toxic int")
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    n = {r[0]: r[1] for r in learn.groupBy("toxic").count().collect()}
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), drift)
    if not n.get(0) or not n.get(1):
        return empty

    y1, y0 = F.col("pos").cast("double"), F.col("neg").cast("double")
    alpha = prior * (y1 + y0) / float(n[0] + n[1])
    odds = lambda y, m: F.log((y + alpha) / (m + prior - y - alpha))
    delta = odds(y1, float(n[1])) - odds(y0, float(n[0]))
    sure = F.abs(delta) / F.sqrt(1 / (y1 + alpha) + 1 / (y0 + alpha))

    def best(chosen):
        counted = learn.mapInArrow(_units(chosen), "unit long, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        certain = counted.select("unit", delta.alias("weight"), sure.alias("sure")).where((F.col("sure") > z) & (F.abs("weight") >= least))
        return certain.orderBy(F.desc("sure"), "unit").limit(units // 2).toPandas()

    top = best(None)
    # a beginning must owe its odds to words that are not in the model themselves
    top = pd.concat([top, best(np.sort(top["unit"].to_numpy(np.int64).view(np.uint64)))])
    unit = top["unit"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(unit)
    m = Model(unit[order], np.clip(top["weight"].to_numpy(float), -3, 8)[order], top["sure"].to_numpy(float)[order], drift)
    if not (m.weight > 0).any():
        return empty

    rows = learn.mapInArrow(_training(spark.sparkContext.broadcast(m)), "toxic int, n long, marks array<double>, found array<double>").toPandas()
    clean = rows[rows["toxic"] == 0]
    marks = np.concatenate([np.asarray(x, float) for x in clean["marks"]] + [np.zeros(0)])
    words = float(clean["n"].sum())
    # one pseudo-word of each kind of weight: a weight that no clean text shows has a small, not a zero probability
    seen, times = np.unique(np.round(np.concatenate([marks, m.weight[m.weight > 0]]), 2), return_counts=True)
    values = np.append(seen, -drift)
    p = np.append(times.astype(float), max(words - len(marks), 1.0))
    p /= p.sum()
    if p @ values >= 0:
        p[-1] *= 1 + (p @ values) / (drift * p[-1]) + 0.1
        p /= p.sum()
    m.scale = _lambda(values, p)
    best = np.array([max(x, default=0.0) for x in clean["found"]])
    size = clean["n"].to_numpy(float)
    m.log_k = float(np.log(len(clean) / max(float((size * np.exp(-m.scale * best)).sum()), 1e-9)))
    x = np.array([evidence(m, np.asarray(f, float), k) for f, k in zip(rows["found"], rows["n"], strict=True)])
    m.a, m.b = _logistic(np.log1p(x), rows["toxic"].to_numpy(float))
    return m


def evidence(m: Model, scores: np.ndarray, n: int) -> float:
    return float(np.maximum(m.normalised(scores, n), 0).sum()) if len(scores) else 0.0


def _score(model):
    def run(source):
        m = model.value
        for batch in K.batches(source):
            w = K.Words(batch.column(batch.schema.get_field_index("text")), K.ALNUM)
            x = m.weights(w)
            n = np.zeros(batch.num_rows, np.int32)
            e = np.zeros(batch.num_rows)
            for r in np.unique(w.doc[x > 0]).tolist():
                a, b = w.first[r], w.first[r + 1]
                here = segments(x[a:b])
                good = m.normalised(np.array([v[2] for v in here]), w.count[r])
                n[r], e[r] = (good > 0).sum(), np.maximum(good, 0)[first_copies(here, w.hash[a:b])].sum()
            yield batch, n, e, 1 / (1 + np.exp(-np.clip(m.a + m.b * np.log1p(e), -60, 60))) if len(m.unit) else np.zeros(batch.num_rows)

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of each row."""
    scan = _score(spark.sparkContext.broadcast(model))

    def run(source):
        for batch, n, e, p in scan(source):
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n), pa.array(e)], ["doc_id", "held_out", "score", "predicted", "n_passages", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def passages(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_word, n_words, normalised, text of every significant passage (its words lower-cased, joined by blanks)."""
    shared = spark.sparkContext.broadcast(model)

    def run(source):
        m = shared.value
        for batch in K.batches(source):
            w = K.Words(batch.column("text"), K.ALNUM)
            x = m.weights(w)
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for r in np.unique(w.doc[x > 0]).tolist():
                a = int(w.first[r])
                for s, t, v in segments(x[a : w.first[r + 1]]):
                    good = float(m.normalised(np.array([v]), w.count[r])[0])
                    if good > 0:
                        rows.append((ids[r], s, t - s, good, " ".join(w.string(a + i) for i in range(s, t))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], ["doc_id", "first_word", "n_words", "normalised", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first_word long, n_words long, normalised double, text string")


def civil_documents(spark: SparkSession, docs: DataFrame, model: Model, *, limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score below ``limit``, all columns kept."""
    scan = _score(spark.sparkContext.broadcast(model))

    def run(source):
        for batch, _, _, p in scan(source):
            yield batch.filter(pa.array(p < limit))

    plain = renamed(docs, "text")
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
