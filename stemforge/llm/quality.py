"""Quality rules: robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics (``VECTOR``).  For every (lang, source) group, and for every
language, the minimum covariance determinant is sought: among subsets of a share h of the group's rows, the one whose
covariance has the least determinant.  Concentration steps - the h rows of least Mahalanobis distance give new moments,
whose determinant is never larger - lead to it from several deterministic starts (classical, by medians, by ranks, by
normal scores, by hyperbolic tangents, by spatial signs, by the inner half, by the neighbours of up to 24 rows).  The starts run to their end, and the best of them
on by exchanges of single rows, on about
``sample`` rows of a group; the two best then go on over all its rows until no determinant falls any more, and the least
one counts.  A last reweighting step uses all rows inside the 97.5 % ellipsoid.  A document is rejected when its squared
distance is beyond the chi-square quantile ``quantile``, or when it fails the base rules.

All estimates cover all rows that pass the base rules, in DataFrame aggregates with partial sums and quantile
sketches, so a group of any share of the rows is never gathered (the sketch's ranks are exact in groups of up to about
2000 rows, and within 0.05 % in larger ones).  A group of few rows is not set apart: every group's estimate is averaged
with ``prior`` rows' worth of its language's, and a language's with the mean of all languages', so it moves from the
common one to the group's own as the group grows.  Variances get a floor (``FLOOR``): a statistic that is constant in
a group must not reject by a hair.

Defined results: a null text has no words and fails the base rules; a null lang or source is a group of its own; equal
rows get equal verdicts, and ties in distance are all inside; rows with a null doc_id are judged like others; extra
columns, whatever their names, take no part (``good_documents`` keeps them); texts of any length are read whole; an
empty table gives no row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import remove, renamed, saved

#: Symbols of the base rules: fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
VECTOR = ["word_size", "symbols", "capitals", "marks", "repeats", "same_lines"]
#: Least standard deviation of each entry of VECTOR.
FLOOR = np.array([0.12, 0.06, 0.08, 0.08, 0.2, 0.2])
P = len(VECTOR)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Groups whose states (about 250 bytes each) are broadcast at most.
FEW = 50_000
#: Column of the operator's own values beside the documents' columns.
Q = "_quality_"


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts and further ones of each text."""
    w = K.Words(texts, lower=False)
    n = len(texts)
    data, off = w.data, w.off
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    by_row = lambda flags: np.diff(upto(flags)[off])
    table = lambda chars: np.isin(np.arange(256), list(chars))[data]
    symbols = table(SYMBOLS)
    out = {"n_words": w.count, "word_chars": by_row(w.mask & ((data & 0xC0) != 0x80)), "n_symbols": by_row(symbols)}
    out["n_capitals"] = by_row(table(range(0x41, 0x5B)))
    out["n_letters"] = by_row(table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]))
    out["n_marks"] = by_row(table(b"!?;:\"()[]{}=+/\\@^~_`0123456789"))

    lines = K.Words(texts, ~np.isin(np.arange(256), [0x0A]), lower=False)
    filled = upto(w.mask)
    full = filled[np.minimum(lines.start + lines.size, len(data))] > filled[lines.start] if len(lines) else np.zeros(0, bool)
    row, h = lines.doc[full], lines.hash[full]
    key = np.unique(K.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[key], minlength=n)

    g = K.grams(w.hash, 3)
    at = np.flatnonzero(w.doc[: len(g)] == w.doc[2:]) if len(g) else np.zeros(0, np.int64)
    row = w.doc[at]
    _, back, times = np.unique(K.mix(g[at] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    twice = at[times[back] > 1] if len(at) else at
    edge = np.zeros(len(w) + 4, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 3, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(edge)[: len(w)] > 0], minlength=n) if len(w) else np.zeros(n, np.int64)
    return out


def vectors(s: dict[str, np.ndarray]) -> np.ndarray:
    """The transformed statistics; shares become angles, whose spread hardly depends on their size."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    angle = lambda part, whole: np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))
    # words of three-word windows that come again by chance grow with the text's length: measured against its square root
    chance = np.clip(s["n_repeat_words"] / words - 0.002 * np.sqrt(words), 0, 1)
    return np.stack([np.log(chars / words), angle(s["n_symbols"], chars), angle(s["n_capitals"], s["n_letters"]), angle(s["n_marks"], chars), np.arcsin(np.sqrt(chance)), angle(s["n_dup_lines"], s["n_lines"])], 1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a column of their base counts, verdict of the base rules and vector."""
    fields = [*(f"{c} long" for c in BASE), "base_failed boolean", *(f"{c} double" for c in VECTOR)]
    names = [f"{Q}{f.split()[0]}" for f in fields]

    def run(source):
        for batch in K.batches(source):
            s = statistics(batch.column(batch.schema.get_field_index("text")))
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            v = vectors(s)
            own = [*(pa.array(s[c].astype(np.int64)) for c in BASE), pa.array(failed), *(pa.array(v[:, i]) for i in range(P))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *names])

    schema = T.StructType(list(docs.schema.fields))
    for f in fields:
        schema = schema.add(f"{Q}{f.split()[0]}", f.split()[1])
    return docs.mapInArrow(run, schema)


def chi2_quantile(q: float, p: int) -> float:
    """Of the chi-square distribution with p degrees of freedom."""

    def below(x: float) -> float:
        a, x = p / 2, x / 2
        term = total = 1 / a
        n = 1
        while term > total * 1e-15 and n < 10_000:
            term *= x / (a + n)
            total += term
            n += 1
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    lo, hi = 1e-9, 400.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < q else (lo, mid)
    return hi


def chi2_below(x: float, p: int) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_quantile(mid, p) < x else (lo, mid)
    return lo


def _distance(state: str = "state") -> F.Column:
    """Squared Mahalanobis distance: each row of the inverse Cholesky factor times the centred vector."""
    x = [F.col(f"{Q}{c}") - F.col(state)[i] for i, c in enumerate(VECTOR)]
    at, total = P, None
    for i in range(P):
        z = None
        for j in range(i + 1):
            term = x[j] * F.col(state)[at]
            z = term if z is None else z + term
            at += 1
        total = z * z if total is None else total + z * z
    return total


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"p{i}_{j}" for i, j in PAIRS)]


def _square(lower: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for v, (i, j) in zip(lower, PAIRS, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _factor(cov: np.ndarray) -> np.ndarray:
    """Cholesky factor with the floor; rounding may leave a variance just below 0, the floor is far above that."""
    return np.linalg.cholesky(cov + np.diag(FLOOR**2))


def _state(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], float]:
    """(mean and inverse factor, log-determinant)."""
    factor = _factor(cov)
    inv = np.linalg.inv(factor)
    return [*mean.tolist(), *(float(inv[i, j]) for i, j in PAIRS)], 2 * float(np.log(np.diag(factor)).sum())


def _concentrated(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: float, scale: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-determinant, mean, covariance) where concentration steps end."""
    k, least = math.ceil(h * len(x)), math.inf
    while True:
        z = np.linalg.solve(_factor(cov), (x - mean).T)
        inner = x[np.argsort((z * z).sum(0), kind="stable")[:k]]
        new, spread = inner.mean(0), np.cov(inner.T, bias=True) * scale
        det = 2 * float(np.log(np.diag(_factor(spread))).sum())
        if not det < least - 1e-10:
            return least, mean, cov
        least, mean, cov = det, new, spread


def _exchanged(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: float, scale: float, edge: int = 24) -> tuple[float, np.ndarray, np.ndarray]:
    """As ``_concentrated``, gone on by exchanges: of the ``edge`` farthest rows inside and nearest outside, the pair whose exchange
    lowers the determinant most changes sides, until none does."""
    k = math.ceil(h * len(x))
    found = _concentrated(x, mean, cov, h, scale)
    for _ in range(10 * edge):
        z = np.linalg.solve(_factor(found[2]), (x - found[1]).T)
        order = np.argsort((z * z).sum(0), kind="stable")
        inside, out, into = x[order[:k]], x[order[max(0, k - edge) : k]], x[order[k : k + edge]]
        if not len(into):
            break
        # sums and products of every exchange
        total = inside.sum(0) - out[:, None] + into[None]
        products = inside.T @ inside - np.einsum("ai,aj->aij", out, out)[:, None] + np.einsum("bi,bj->bij", into, into)[None]
        m = total / k
        c = (products / k - np.einsum("abi,abj->abij", m, m)) * scale
        det = np.linalg.slogdet(c + np.diag(FLOOR**2))[1]
        a, b = np.unravel_index(int(det.argmin()), det.shape)
        if not det[a, b] < found[0] - 1e-9:
            break
        better = _concentrated(x, m[a, b], c[a, b], h, scale)
        found = better if better[0] < det[a, b] else (float(det[a, b]), m[a, b], c[a, b])
    return found


def starts(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, scatter) guesses for a group's rows."""
    middle = np.median(x, 0)
    width = np.maximum(1.4826 * np.median(np.abs(x - middle), 0), FLOOR)
    z = (x - middle) / width
    norm = np.sqrt((z * z).sum(1))
    rank = (np.argsort(np.argsort(z, 0, kind="stable"), 0, kind="stable") + 0.5) / len(x)
    normal = np.vectorize(NormalDist().inv_cdf)(rank)
    inner = z[np.argsort(norm, kind="stable")[: -(-len(x) // 2)]]
    near = [x[np.argsort(((z - z[i]) ** 2).sum(1), kind="stable")[: max(2, -(-len(x) // 2))]] for i in np.linspace(0, len(x) - 1, min(len(x), 24)).astype(int)]
    shapes = [np.eye(P), *(np.cov(y.T, bias=True) for y in (np.tanh(z), rank * math.sqrt(12), normal, z / np.maximum(norm, 1e-12)[:, None], inner))]
    return [*((y.mean(0), np.cov(y.T, bias=True)) for y in (x, *near)), *((middle, y * np.outer(width, width)) for y in shapes)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(f"{Q}{c}") for c in VECTOR]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(P)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in PAIRS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums, *products)


def _estimates(moments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """(*keys, est, state, logdet) from moments, row by row; est: mean and lower half of the covariance times ``scale``."""
    schema = moments.select(*keys).schema

    def run(source):
        for m in source:
            out = []
            for row in m[MOMENTS].to_numpy(float):
                n = max(row[0], 1.0)
                mean = row[1 : 1 + P] / n
                cov = (_square(row[1 + P :]) / n - np.outer(mean, mean)) * scale
                out.append(([*mean.tolist(), *(float(cov[i, j]) for i, j in PAIRS)], *_state(mean, cov)))
            est, state, dets = zip(*out, strict=True) if out else ([], [], [])
            yield pd.DataFrame({**{k: m[k] for k in keys}, "est": est, "state": state, "logdet": dets})

    return moments.mapInPandas(run, _with_state(schema.add("est", ARRAY)))


ARRAY = T.ArrayType(T.DoubleType())


def _with_state(schema: T.StructType) -> T.StructType:
    return schema.add("state", ARRAY).add("logdet", T.DoubleType())


def _group_key() -> F.Column:
    """Of a row: its language and source, and its language alone."""
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("\0")), F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    return F.array(F.concat(lang, F.lit("\1"), source), F.concat(lang, F.lit("\1\1")))


def _candidates(keyed: DataFrame, sizes: DataFrame, small, h: float, scale: float, sample: float) -> DataFrame:
    """(grp, start, state): the two best ends of concentration on about ``sample`` rows of each group (whole groups of up to that many)."""

    def search(p: pd.DataFrame) -> pd.DataFrame:
        x = p[[f"{Q}{c}" for c in VECTOR]].to_numpy(float)
        ends = sorted((_concentrated(x, m, c, h, scale) for m, c in starts(x)), key=lambda e: e[0])[:6]
        ends = sorted((_exchanged(x, m, c, h, scale) for _, m, c in ends), key=lambda e: e[0])
        two = [ends[0], *(e for e in ends[1:] if e[0] > ends[0][0] + 1e-9)][:2]
        rows = [(p["grp"].iloc[0], i, _state(m, c)[0]) for i, (_, m, c) in enumerate(two)]
        return pd.DataFrame(rows, columns=["grp", "start", "state"])

    some = keyed.join(small(sizes.select("grp", "size")), "grp").where(F.rand(7) * F.col("size") <= sample).drop("size")
    return some.groupBy("grp").applyInPandas(search, T.StructType().add("grp", T.StringType()).add("start", T.IntegerType()).add("state", ARRAY))


def estimate(rows: DataFrame, *, h: float = 0.5, steps: int = 30, prior: float = 50.0, sample: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """((grp, state), (grp, logdet)): the final estimate of each (lang, source) key, and of every key (those of languages end in two
    \\1) the least log-determinant found; rows: saved, of those that pass the base rules."""
    keyed = rows.select(F.explode(_group_key()).alias("grp"), *(f"{Q}{c}" for c in VECTOR))
    sizes = saved(keyed.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("size")).select("grp", "size", F.substring_index("grp", "\1", 1).alias("lang"), F.col("grp").endswith("\1\1").alias("wide")), "sizes")
    # states of few groups are broadcast; of more they are joined, and a hot group's rows are split by the skew join
    small = F.broadcast if sizes.count() <= FEW else lambda d: d
    # the h-part of a normal sample has less scatter than the whole: the factor that makes up for it
    full = h / chi2_below(chi2_quantile(h, P), P + 2)
    state = saved(_candidates(keyed, sizes, small, h, full, sample), "state")
    key, best = ["grp", "start"], None
    for _ in range(steps):
        far = keyed.join(small(state.select(*key, "state")), "grp").withColumn("d2", _distance())
        radius = far.groupBy(*key).agg(F.percentile_approx("d2", h, 2000).alias("radius"))
        new = saved(_estimates(_moments(far.join(small(radius), key).where("d2 <= radius"), key), key, full), "state")
        remove(state)
        if best is not None:  # the least determinant of each start so far; those that do not fall any more are at their end
            before = best.select(*key, F.struct("logdet", "est", "state").alias("was"))
            both = saved(new.join(before, key).withColumn("fell", F.col("logdet") < F.col("was.logdet") - 1e-9), "state")
            fell = both.where("fell").select(*key, "est", "state", "logdet")
            over = best.join(fell.select(*key), key, "left_anti").unionAll(fell)
            kept = saved(over, "state")
            state = saved(fell, "state")
            for d in (best, new, both):
                remove(d)
            best = kept
            if not state.count():
                break
        else:
            best, state = new, saved(new, "state")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))
    least = saved(best.withColumn("rank", rank).where("rank = 1").select("grp", "est", "logdet"), "mcd")
    remove(best)

    # the reweighting step, from averaged estimates, which are averaged again after it
    far = keyed.join(small(_averaged(least, sizes, prior)), "grp").withColumn("d2", _distance())
    final = saved(_estimates(_moments(far.where(F.col("d2") <= chi2_quantile(0.975, P)), ["grp"]), ["grp"], 1.0), "mcd")
    missing = least.join(final, "grp", "left_anti").select("grp", "est")  # no row of theirs is inside
    out = _averaged(final.select("grp", "est").unionAll(missing), sizes, prior).where("not wide")
    return out.select("grp", "state"), least.select("grp", "logdet")


def _averaged(own: DataFrame, sizes: DataFrame, prior: float) -> DataFrame:
    """(grp, wide, state): a group's estimate with ``prior`` rows of its language's, a language's with as many of the mean of all."""
    each = own.join(sizes, "grp").select("grp", "lang", "wide", "size", "est")
    # one row of 27 numbers, null where there is no group at all
    mean = each.where("wide").agg(*(F.sum(F.col("est")[i] * F.col("size")) / F.sum("size") for i in range(P + len(PAIRS)))).first()
    wider = F.array(*(F.lit(float(v or 0.0)) for v in mean))
    with_prior = F.zip_with("est", "wider", lambda a, b: (a * F.col("size") + b * prior) / (F.col("size") + prior))
    langs = each.where("wide").withColumn("wider", wider).select("grp", "lang", "wide", with_prior.alias("est"))
    groups = each.where("not wide").join(langs.select("lang", F.col("est").alias("wider")), "lang").select("grp", "lang", "wide", with_prior.alias("est"))

    def run(source):
        for m in source:
            states = [_state(np.array(e[:P]), _square(e[P:]))[0] for e in m["est"]]
            yield pd.DataFrame({"grp": m["grp"], "wide": m["wide"], "state": states})

    return langs.unionAll(groups).select("grp", "wide", "est").mapInPandas(run, "grp string, wide boolean, state array<double>")


def verdicts(docs: DataFrame, *, quantile: float = 0.999, **how) -> DataFrame:
    """docs with their statistics, squared distance (``d2``) and ``kept``; no document moves unless the states are too many to broadcast."""
    with_all = with_statistics(docs)
    slim = with_statistics(docs.select("text", "lang", "source")).where(~F.col(f"{Q}base_failed")).drop("text")
    vectors = saved(slim, "statistics")
    states = saved(estimate(vectors, **how)[0], "mcd")
    remove(vectors)
    few = F.broadcast if states.count() <= FEW else lambda d: d
    far = with_all.withColumn(f"{Q}grp", _group_key()[0]).join(few(states.select(F.col("grp").alias(f"{Q}grp"), F.col("state").alias(f"{Q}state"))), f"{Q}grp", "left")
    d2 = _distance(f"{Q}state")
    limit = chi2_quantile(quantile, P)
    return far.withColumn(f"{Q}d2", d2).withColumn(f"{Q}kept", ~F.col(f"{Q}base_failed") & (F.coalesce(F.col(f"{Q}d2"), F.lit(0.0)) <= limit))


def quality(docs: DataFrame, **how) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each row."""
    out = verdicts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), **how)
    return out.select("doc_id", *(F.col(f"{Q}{c}").alias(c) for c in [*BASE, "base_failed", "kept"]), F.col(f"{Q}d2").alias("distance2"))


def good_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    plain = renamed(docs, "text", "lang", "source")
    return verdicts(plain, **how).where(f"{Q}kept").select(*plain.columns).toDF(*docs.columns)
