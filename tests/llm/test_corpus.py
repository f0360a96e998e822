"""Join, components, quality, toxicity, language model, language id and the pipeline: brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemforge.llm import kernel as K
from stemforge.llm import langid, lm, ngram_join, quality, toxicity
from stemforge.llm import queries as Q
from stemforge.llm.components import components
from stemforge.llm.shared import saved

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def sets_of(docs, n):
    out = []
    for t in docs:
        w = words(t)
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def brute_components(docs, n, percent):
    s = sets_of(docs, n)
    up = list(range(len(s)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [(len(x), top(i)) for i, x in enumerate(s)]


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda k=400: f"w{rng.randint(0, k)}"
    docs = ["", None, "a b c", "A b  c", "a b", " ", "x"]
    passage = [word() for _ in range(50)]
    for size in (6, 9, 20, 45, 70, 120, 300, 700):
        base = [word() for _ in range(size)]
        docs.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                k = rng.randrange(3)
                at = rng.randrange(len(copy))
                if k == 0:
                    copy[at] = word()
                elif k == 1:
                    copy.insert(at, word())
                elif len(copy) > 5:
                    del copy[at]
            docs.append(" ".join(copy))
        docs.append(" ".join(base[: size // 2] + passage))
    return docs


@pytest.mark.parametrize("n,percent,most", [(4, 85, 4_000_000), (5, 80, 4_000_000), (4, 85, 700)])
def test_ngram_join(spark, n, percent, most):
    docs = near_copies()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark, df, n=n, percent=percent, most=most).collect()}
    assert [got[i] for i in range(len(docs))] == brute_components(docs, n, percent)


def test_ngram_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_join(spark, empty).count() == 0 and ngram_join.one_of_each(spark, empty).count() == 0
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f"), (1, ""), (1, ""), (None, None), (None, near), (None, near + " x"), (9, near + " y"), (3, near), (None, "alone and without id here"), (None, "alone and without id here")]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, component_id string, `set.hash` int").repartition(3)
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.ngram_join(spark, df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (3, 3), (3, 3), (3, 3), (7, 3), (9, 3), (None, 3), (None, 3), (None, None), (None, None), (None, None)], key=str)
    kept = ngram_join.one_of_each(spark, df)
    assert kept.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept == sorted([(1, ""), (1, ""), (None, None), (3, "a b c d e f"), (3, near), (None, "alone and without id here")], key=str)


@pytest.mark.parametrize("n", [30, 90, 400, 513, 900, 3000, 20_000])
def test_matching_sets_always_meet(n):
    """Pairs at the very threshold, of all sizes and with common n-grams, share a meeting point."""
    rng = np.random.default_rng(n)
    for percent in (80, 85):
        for trial in range(20 if n < 1000 else 3):
            x = np.unique(K.mix(rng.integers(0, 2**62, n).astype(np.uint64)))
            gone = len(x) * (100 - percent) // 100
            y = np.delete(x, rng.choice(len(x), gone, replace=False))
            if trial % 2:  # as many new as gone, at the threshold
                swap = (len(x) - ngram_join.needed(len(x), len(x), percent)) * 1
                y = np.unique(np.concatenate([np.delete(x, rng.choice(len(x), swap, replace=False)), K.mix(rng.integers(0, 2**62, swap).astype(np.uint64))]))
            both = len(np.intersect1d(x, y))
            assert 100 * both >= percent * (len(x) + len(y) - both)
            common = np.sort(rng.choice(x, len(x) * (trial % 5) // 5, replace=False))
            assert len(np.intersect1d(ngram_join.signatures(x, percent, common), ngram_join.signatures(y, percent, common)))
            assert len(np.intersect1d(ngram_join.signatures(x, percent, common, False), ngram_join.signatures(y, percent, common, False)))  # nearly surely


@pytest.mark.parametrize("n", [90, 400, 3000])
def test_meeting_points_are_few_and_strong(n):
    """No more parts of a dealing than a partner may differ in, and one; sets that share few n-grams do not meet."""
    rng = np.random.default_rng(n)
    draw = lambda k: K.mix(rng.integers(0, 2**62, k).astype(np.uint64))
    none = np.zeros(0, np.uint64)
    passage = draw(n // 10)
    for percent, exact in ((85, True), (80, False)):
        sets = [np.unique(np.concatenate([passage, draw(n - n // 10)])) for _ in range(12)]
        points = [ngram_join.signatures(x, percent, none, exact) for x in sets]
        assert all(len(p) <= 2 * (n * (100 - percent) // percent + 1) for p in points)
        assert sum(len(np.intersect1d(points[i], points[j])) > 0 for i in range(12) for j in range(i)) <= 6  # of 66 pairs


def test_points_of_sets(spark):
    """Sets at one point are linked in order of size where two sizes may match; texts of other rows are not sent."""
    sets = spark.createDataFrame([(s << 30, n) for s, n in ((3, 100), (5, 110), (9, 125), (11, 200), (13, 90))], "set_hash long, n_shingles int")
    named = [r[0] for r in sets.selectExpr("shiftrightunsigned(set_hash, 24)").collect()]
    met = spark.createDataFrame([(1, x, None, None) for x in named] + [(None, None, 7, 8)], "met long, name long, a long, b long")
    assert {tuple(sorted(r)) for r in ngram_join._meeting_edges(met, sets, 85).collect()} == {(3 << 30, 13 << 30), (3 << 30, 5 << 30), (5 << 30, 9 << 30), (7, 8)}
    texts = spark.range(5000).selectExpr("xxhash64(id) AS row_id", "CAST(id AS STRING) AS text")
    there = texts.where("CAST(text AS INT) % 500 = 0").select("row_id")
    sent = {r.text for r in texts.where(ngram_join._among(spark, there)("row_id")).collect()}
    assert {str(i) for i in range(0, 5000, 500)} <= sent and len(sent) < 1000


@pytest.mark.parametrize("seed", range(6))
def test_trie_links(seed):
    rng = np.random.default_rng(seed)
    base = np.sort(rng.choice(1 << 40, 60, replace=False).astype(np.uint64))
    sets = [np.sort(np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.choice(1 << 40, rng.integers(0, 12)).astype(np.uint64)]))) for _ in range(40)]
    sets = list({s.tobytes(): s for s in sets}.values())

    def groups(links):
        up = list(range(len(sets)))
        for i, j in links:
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
        return up

    want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert groups(ngram_join.trie_links(sets, None, 80)) == groups(want)
    half = len(sets) // 2
    cross = [(i + half, j) for i, j in ngram_join.trie_links(sets[:half], sets[half:], 80)]
    inner = [p for p in want if (p[0] < half) == (p[1] < half)]
    assert groups(cross + inner) == groups(want)


def test_trie_of_many_levels():
    base = np.arange(1, 400, dtype=np.uint64) * np.uint64(1000)
    sets = [np.sort(np.append(np.delete(base, 300), base[i] + np.uint64(1))) for i in range(0, 399, 3)]
    assert len({j for _, j in ngram_join.trie_links(sets, None, 85)} | {i for i, _ in ngram_join.trie_links(sets, None, 85)}) == len(sets)
    assert len(ngram_join.Trie(sets).levels) > 64


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {}
    for u, v in edges:
        if u is not None and u != v:
            label.setdefault(u, u), label.setdefault(v, v)
    for _ in range(300):
        for u, v in edges:
            if u is not None and u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_statistics():
    rng = random.Random(4)
    x = ["", None, " \n ", "a b c a b c", "x\nx\n y\nx", "é* é* <b>|"] + ["".join(rng.choice("ab  \n#é") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    s = quality.statistics(pa.array(x))
    assert list(zip(*(s[c].tolist() for c in quality.BASE), strict=True)) == [brute_statistics(t) for t in x]


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(quality.chi2_quantile(0.999, 6) - 22.457744) < 1e-4


def test_quality(spark, sf):
    docs, labels = Q.table(spark, sf.replace("sf0.001", "sf0.01"), "documents"), Q.table(spark, sf.replace("sf0.001", "sf0.01"), "labels")
    got = quality.quality(docs).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in got if r.quality == 1]
    junk = [r.kept for r in got if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)


def exhaustive_mcd(x, h=0.5):
    """The least log-determinant over all subsets of ceil(h n) rows, scaled and floored as the operator's."""
    import itertools

    k = math.ceil(h * len(x))
    full = h / quality.chi2_below(quality.chi2_quantile(h, quality.P), quality.P + 2)
    least = math.inf
    for rows in itertools.combinations(range(len(x)), k):
        y = x[list(rows)]
        least = min(least, np.linalg.slogdet(np.cov(y.T, bias=True) * full + np.diag(quality.FLOOR**2))[1])
    return least


def test_quality_finds_the_minimum_determinant(spark):
    """Against all subsets of small groups: with far rows in it, and without any."""
    rng = np.random.default_rng(6)
    groups = {}
    for g in range(7):
        a = rng.normal(size=(quality.P, quality.P)) / 3
        x = rng.normal(size=(12, quality.P)) @ a
        if g < 4:
            x[: g + 2] += rng.normal(size=quality.P) * 2 + 4
        groups[f"s{g}"] = x
    rows = [("en", s, *map(float, v)) for s, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{quality.Q}{c} double" for c in quality.VECTOR))
    _, dets = quality.estimate(saved(df, "test"))
    got = {r.grp.split("\1")[1]: r.logdet for r in dets.collect()}
    want = {s: exhaustive_mcd(x) for s, x in groups.items()}
    assert all(got[s] >= want[s] - 1e-6 for s in want)  # none can be less
    assert sum(abs(got[s] - want[s]) < 1e-6 for s in want) >= 5 and all(got[s] < want[s] + 0.5 for s in want)


def test_quality_estimate_moves_with_the_size_of_a_group(spark):
    """A few rows of another kind stay near the common estimate, many have their own; nothing flips between."""
    rng = np.random.default_rng(7)
    rows = [("en", "a", *map(float, v)) for v in rng.normal(0, 0.1, (1500, quality.P))]
    for n in (5, 20, 80, 320):
        rows += [("en", f"n{n:03}", *map(float, v)) for v in rng.normal(1.0, 0.1, (n, quality.P))]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{quality.Q}{c} double" for c in quality.VECTOR))
    states, _ = quality.estimate(saved(df, "test"))
    mean = {r.grp.split("\1")[1]: r.state[0] for r in states.collect()}
    assert set(mean) == {"a", "n005", "n020", "n080", "n320"}
    at = [mean[f"n{n:03}"] for n in (5, 20, 80, 320)]
    assert at == sorted(at) and all(abs(a - n / (n + 50)) < 0.05 for a, n in zip(at, (5, 20, 80, 320), strict=True))


def test_quality_of_clashing_columns_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _quality_kept string, _1 int, grp int"
    df = spark.createDataFrame([(1, text, None, None, 1, "x", "k", 1, 2), (1, text, None, None, 1, "x", "k", 1, 2), (None, text, "en", None, 1, "y", "k", 1, 2), (4, "few", "en", "s", 1, "y", "k", 1, 2), (5, text * 3000, "en", "s", 1, "y", "k", 1, 2)], schema)
    got = quality.good_documents(df)
    assert got.columns == df.columns and sorted((r.doc_id or 0, r["a.b"]) for r in got.collect()) == [(0, "y"), (1, "x"), (1, "x")]
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.quality(df).collect())[-1] == (5, 79 * 3000 + 1, False)


def test_quality_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert quality.quality(empty).count() == 0 and quality.good_documents(empty).columns == empty.columns
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, None, None, 1), (1, text, None, None, 1), (2, None, "en", "s", 0), (3, "short", "en", "s", 5)], DOC)
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in quality.quality(df).collect()) == [(1, False, True), (1, False, True), (2, True, False), (3, True, False)]


def brute_segments(w):
    """All maximal scoring segments by their definition: the best segment, then those left and right of it."""
    if not len(w) or max(w) <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(w)])
    s, i, j = max((total[j] - total[i], -i, -j) for i in range(len(w)) for j in range(i + 1, len(w) + 1))
    i, j = -i, -j
    return brute_segments(w[:i]) + [(i, j, s)] + [(a + j, b + j, v) for a, b, v in brute_segments(w[j:])]


@pytest.mark.parametrize("seed", range(20))
def test_segments(seed):
    w = np.random.default_rng(seed).normal(-0.2, 1, 40)
    got, want = toxicity.segments(w), brute_segments(w)
    assert [g[:2] for g in got] == [v[:2] for v in want]
    assert np.allclose([g[2] for g in got], [v[2] for v in want])


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["vilest", "scum", f"hatexx{rng.randint(0, 99)}"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1001, "vilest scum hatexx7")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(spark, docs, lab, Q.remainder(5) != 0)
    got = toxicity.score(spark, docs, m, Q.remainder(5) == 0).collect()
    held = [r for r in got if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert [r.predicted for r in got if r.doc_id == 1000] == [0]
    spans = toxicity.passages(spark, docs, m).where("doc_id = 1001").collect()
    assert [s.text for s in spans] == ["vilest scum hatexx7"]
    assert toxicity.civil_documents(spark, docs, m).where("doc_id < 1000 and doc_id % 5 = 0").count() < 10
    nothing = toxicity.fit(spark, docs, lab.limit(0))
    assert {r.score for r in toxicity.score(spark, docs, nothing, F.lit(False)).collect()} == {0.0}


def test_calibration_is_the_likeliest():
    """lambda, K and the logistic coefficients against searches over a fine grid."""
    rng = np.random.default_rng(5)
    values, p = np.array([-0.25, -1.0, 2.0, 3.5]), np.array([0.9, 0.06, 0.03, 0.01])
    root = toxicity._lambda(values, p)
    grid = np.linspace(0.01, 4, 400_001)
    f = (p[:, None] * np.exp(np.outer(values, grid))).sum(0) - 1
    assert abs(root - grid[np.flatnonzero(f > 0)[0]]) < 1e-4 and root > 0
    x = rng.gamma(1.0, 1.0, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(2 - 1.5 * x))).astype(float)
    a, b = toxicity._logistic(x, y)
    loss = lambda a, b: np.logaddexp(0, a + b * x).sum() - y @ (a + b * x) + 1e-2 * (a * a + b * b)
    assert all(loss(a, b) <= loss(a + d, b + e) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_toxicity_score_is_its_formula(spark):
    """Scores of the fitted model from brute-force segments: Gumbel constants by definition, evidence, logistic."""
    rng = random.Random(14)
    rows = [(i, " ".join([*(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 40))), *(["vile", "scum"] * (i % 4 == 0))])) for i in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    m = toxicity.fit(spark, docs, labels)
    clean_best, clean_size = [], []
    want = {}
    for i, t in rows:
        w = K.Words(pa.array([t]), K.ALNUM)
        x = m.weights(w)
        found = {w.hash[s:e].tobytes(): v for s, e, v in reversed(brute_segments(x))}
        want[i] = sum(max(0.0, m.scale * v - m.log_k - math.log(len(x))) for v in found.values())
        if i % 4:
            clean_best.append(max(found.values(), default=0.0))
            clean_size.append(len(x))
    # the likeliest K of P(best < s) = exp(-K n e^(-lambda s))
    assert abs(m.log_k - math.log(len(clean_best) / sum(n * math.exp(-m.scale * s) for n, s in zip(clean_size, clean_best, strict=True)))) < 1e-9
    for r in toxicity.score(spark, docs, m, F.lit(False)).collect():
        assert abs(r.evidence - want[r.doc_id]) < 1e-9 and abs(r.score - 1 / (1 + math.exp(-m.a - m.b * math.log1p(want[r.doc_id])))) < 1e-9


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "vile " * 60_000, 2.0, "x"), (None, "vile scum", 2.0, "x"), (None, None, 2.0, "x"), (2, "calm", 2.0, "x"), (2, "calm", 2.0, "x")], "doc_id long, text string, score double, `a.b` string")
    h = np.sort(K.Words(pa.array(["vile scum"]), K.ALNUM).hash)
    m = toxicity.Model(h, np.full(2, 2.0), np.full(2, 9.0), 0.25, scale=1.0, log_k=0.0, a=-3.0, b=3.0)
    assert sorted((r.doc_id or 0, r.predicted, r.held_out) for r in toxicity.score(spark, docs, m, Q.remainder(5) == 0).collect())[:2] == [(0, 0, False), (0, 1, False)]
    kept = toxicity.civil_documents(spark, docs, m)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 2]
    assert toxicity.score(spark, docs.limit(0), m, F.lit(False)).count() == 0


def test_toxicity_of_repeated_words(spark):
    """Words that came before in harmless context, or in an equal passage, count again."""
    unit = {w: K.Words(pa.array([w]), K.ALNUM).hash[0] for w in ("vile", "scum", "filth")}
    h = np.sort(np.array(list(unit.values())))
    m = toxicity.Model(h, np.full(3, 2.0), np.full(3, 9.0), 0.25, scale=1.0, log_k=0.0, a=-3.0, b=3.0)
    calm = lambda n: " ".join(["calm"] * n)
    passage = "vile scum filth vile scum filth"
    scattered = " ".join([calm(60), "vile", calm(60), "scum", calm(60), "filth", calm(60), passage, calm(60)])
    twice = " ".join([calm(5), passage, calm(200), passage, calm(5)])
    docs = spark.createDataFrame([(1, scattered), (2, twice), (3, " ".join([calm(216), passage]))], "doc_id long, text string")
    found = sorted((r.doc_id, r.text) for r in toxicity.passages(spark, docs, m).collect())
    assert found == [(1, passage), (2, passage), (2, passage), (3, passage)]
    got = {r.doc_id: r for r in toxicity.score(spark, docs, m, F.lit(False)).collect()}
    assert [got[i].predicted for i in (1, 2, 3)] == [1, 1, 1] and [got[i].n_passages for i in (1, 2, 3)] == [1, 2, 1]
    assert abs(got[2].evidence - got[3].evidence) < 1e-9  # both have 222 words


@pytest.mark.parametrize("head", [1 << 20, 8])
def test_lm(spark, head):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "of", "And", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(300, None), (301, "zzz the"), (301, "zzz the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lm.score(spark, docs, Q.remainder(7) == 2, head=head).collect()
    c = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), "\0"])
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(words(t)) + 1, sum(c[x] > 0 for x in [*words(t), "\0"]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*words(t), "\0"]), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b " * 50_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.held_out, r.train_tokens) for r in lm.score(spark, docs, F.col("doc_id") == 2).collect())
    assert got == [(0, 4, False, 12), (1, 4, False, 12), (1, 4, False, 12), (2, 100_001, True, 12)]
    assert lm.score(spark, docs.limit(0), F.lit(False)).count() == 0


def test_lm_filter_is_filled_in_parallel(spark, monkeypatch):
    """What the driver reads one partition after another is a saved table: nothing is computed there."""
    read, real = [], lm._filter
    monkeypatch.setattr(lm, "_filter", lambda rows, *how: read.append(rows._jdf.queryExecution().toString()) or real(rows, *how))
    lm.score(spark, spark.createDataFrame([(i, f"a b c{i % 7} d") for i in range(60)], "doc_id long, text string"), F.lit(False)).collect()
    assert len(read) == 2 and not any("MapInArrow" in plan for plan in read)


def test_lm_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(spark, docs, F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_lm_filter_grows(spark):
    """A filter beyond the size that is broadcast keeps its bits an entry: the scores are the same, held out or not."""
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(rng.randint(0, 400)))) for i in range(300)] + [(300, None), (301, "w1 zzz"), (301, "w1 zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    get = lambda **how: sorted((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(spark, docs, Q.remainder(7) == 2, **how).collect())
    assert get() == get(most_bits=1 << 12) == get(most_bits=1 << 12, head=8)


def small_corpus(n=200, seed=12):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["the", "of", "and", f"w{int(rng.paretovariate(0.7)) % 40}"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_lm_asks_by_groups(spark, monkeypatch):
    """What a larger filter is asked goes to a few groups of segments, not to each bucket: the words and the pairs' first level stay in one place while they fit."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 500}" for _ in range(rng.randint(0, 300)))) for i in range(300)] + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asked, real = [], lm._look
    monkeypatch.setattr(lm, "_look", lambda rows, *how: asked.append(real(rows, *how)) or asked[-1])
    get = lambda **how: sorted((r.doc_id, r.score) for r in lm.score(spark, docs, Q.remainder(7) == 2, block_bytes=1 << 10, **how).collect())
    want = get()
    for most_bits, group_bytes, kinds in (5 << 17, 16 << 20, {0, 2, 3}), (1 << 12, 16 << 20, {0, 1, 2, 3}), (1 << 12, 1 << 12, {0, 1, 2, 3}):
        got = get(most_bits=most_bits, group_bytes=group_bytes)
        assert [i for i, _ in got] == [i for i, _ in want] and max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 1e-9
        blocks = asked.pop().select("chunk", "kind", "bucket").collect()
        assert {r.kind for r in blocks} == kinds
        if group_bytes == 16 << 20:
            assert {r.bucket for r in blocks} == {0} and len(blocks) == len({r.chunk for r in blocks}) * len(kinds)


def brute_lm(train):
    """log10 P(token | two before) by dictionaries: quantised counts of words, of pairs and triples seen twice or more."""
    grams = [collections.Counter() for _ in range(4)]
    for t in train:
        w = [*words(t), "\0"]
        for i, x in enumerate(w):
            grams[1][(x,)] += 1
            grams[2][(w[i - 1] if i else "\0", x)] += 1
            if i:
                grams[3][(w[i - 2] if i > 1 else "\0", w[i - 1], x)] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    q = [None] + [{g: int(lm.VALUES[k][int(lm.level(np.array([c]), k)[0])]) for g, c in grams[k].items() if c >= lm.LEAST[k]} for k in (1, 2, 3)]
    after = [None, collections.Counter(), collections.Counter()]
    for k in (1, 2):
        for g, c in q[k + 1].items():
            after[k][g[:-1]] += c
    share = [None]
    for k in (1, 2):
        held, total = collections.Counter(), collections.Counter()
        for g, c in q[k].items():
            total[c] += c
            held[c] += min(after[k][g], c)
        share.append({c: min(held[c] / total[c], 0.99) for c in total})

    def p(x, *context):
        if not context:
            return n / (n + v) * q[1][(x,)] / sum(q[1].values()) if (x,) in q[1] else v / (n + v) / v
        low, k = p(x, *context[1:]), len(context)
        total = after[k][context]
        if not total:
            return low
        c = q[k].get(context, 0)
        t, most = share[k].get(c, 0.0), max(total, c)
        return t * q[k + 1].get((*context, x), 0) / most + (1 - t * total / most) * low

    def score(text):
        w = [*words(text), "\0"]
        return sum(math.log10(p(x, *((w[i - 2] if i > 1 else "\0", w[i - 1]) if i else ("\0",)))) for i, x in enumerate(w))

    return p, score, [g[0] for g in q[1]], v, q


def test_lm_score_is_the_model(spark):
    """The probed score is that of the model by dictionaries, for known and unknown words."""
    rows = small_corpus() + [(300, None), (301, "zzz the of"), (301, "zzz the of"), (302, "the of w1 zzz w2")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(4)
    got = lm.score(spark, docs, Q.remainder(7) == 2, bits_each=400).collect()
    _, score, *_ = brute_lm([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == sorted((i, round(score(t), 6)) for i, t in rows)


def test_lm_sums_to_one(spark):
    """After any context the probabilities of all known words and of the unknown ones together sum to one, in the filter as in the model."""
    rows = small_corpus()
    p, _, known, v, q = brute_lm([t for _, t in rows])
    for context in [(), ("the",), ("w1",), ("zzz",), ("\0",), ("the", "of"), ("of", "w1"), ("zzz", "the"), *list(q[2])[:40]]:
        assert abs(sum(p(x, *context) for x in known) + v * p("unknown word", *context) - 1) < 1e-9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flat = docs.select(F.col("doc_id").alias("row_id"), "doc_id", F.lit(False).alias("held_out"), "text")
    for bits_each, near in (400.0, 1e-6), (12.0, 0.05):
        model, _, _ = lm.train(spark, flat, bits_each=bits_each)
        for context in ["the of", "w1", "of w2", "zzz zzz", "and the"]:
            t = lm.Tokens(pa.array([f"{context} {x}" for x in [*(x for x in known if x != "\0"), "unknownword"]] + [context]))
            logs = model.score(t, model.look(t))
            at = len(context.split())
            each = 10 ** np.array([logs[a + at] for a in t.first[:-1].tolist()])
            each[-2] *= v
            assert abs(each.sum() - 1) < near


def test_lm_tells_copies_apart(spark):
    """Texts that come twice are likelier by the token than nearly all texts that come once."""
    rng = random.Random(13)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.6)) % 2000}" for _ in range(rng.randint(40, 120)))
    once = [text() for _ in range(400)]
    twice = [text() for _ in range(60)]
    rows = list(enumerate(once + twice + twice))
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    limit = np.quantile([got[i] for i in range(400)], 0.95)
    assert np.mean([got[i] > limit for i in range(400, 520)]) > 0.9


def test_lm_filter_levels():
    n = np.array([1, 2, 3, 4, 7, 8, 100, 10_000])
    for kind in (1, 2, 3):
        v = lm.value(lm.level(n, kind), kind)
        assert (np.abs(v - np.maximum(n, lm.LEAST[kind])) <= 0.25 * np.maximum(n, lm.LEAST[kind])).all()
    key, count = np.array([5, 9], np.uint64), np.array([600, 3])
    back = lm.merge_counts(*lm.unpack_counts(lm.pack_counts(key, count)))
    assert back[0].tolist() == [5, 9] and back[1].tolist() == [600, 3]


def test_lm_sums_are_read_back():
    rng = np.random.default_rng(3)
    key = K.mix(np.arange(1, 500, dtype=np.uint64))
    total = np.concatenate([np.arange(0, 400), rng.integers(0, 1 << 30, 99)])
    entries = lm._sum_entries(key, total)
    f = lm.Filter({1: np.zeros(1 << 17, np.uint64)}, {1: 1 << 17}, 3)
    for k, salt in entries:
        np.bitwise_or.at(f.words[1], *lm.Filter.spot(k, salt, 1 << 17))
    got = f.sums(1, key)
    assert (got[:400] == total[:400]).all() and (np.abs(got - total) <= total / 4000).all()


def test_langid(spark):
    rng = random.Random(10)
    syl = {"aa": ["ka", "ro", "mi"], "bb": ["xt", "zq", "wv"], "cc": ["é", "ñu", "oç"]}
    text = lambda g, n: " ".join("".join(rng.choice(syl[g]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(g := rng.choice(list(syl)), rng.randint(1, 80)), g) for i in range(300)]
    rows += [(900, None, "aa"), (901, "123 !! 😀", "bb"), (902, "", None), (903, text("aa", 30) + " " + text("bb", 10), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(docs, Q.remainder(4) != 2)
    got = {r.doc_id: r for r in langid.predict(spark, docs, m, Q.remainder(4) == 2).collect()}
    held = [(got[i].lang_pred, g) for i, _, g in rows if i < 900 and got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "aa" and abs(got[903].score - 0.75) < 0.1 and got[903].n_switches >= 1


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    m = langid.Model(["a", "b", "c"], rng.normal(size=(1 << 10, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), 10)
    w = K.Words(pa.array(["un deux trois", "", "x", " ".join(f"w{i}" for i in range(90))]), langid.INSIDE)
    e, a, pi = m.emissions(w), np.exp(m.move), np.exp(m.begin)
    got = m.posteriors(w, chunk=8)
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        n = hi - lo
        if n:
            f, b = np.zeros((n, 3)), np.ones((n, 3))
            f[0] = pi * e[lo]
            for t in range(1, n):
                f[t] = (f[t - 1] @ a) * e[lo + t]
                f[t] /= f[t].sum()
            for t in range(n - 2, -1, -1):
                b[t] = a @ (e[lo + t + 1] * b[t + 1])
                b[t] /= b[t].sum()
            p = f * b
            assert np.allclose(got[lo:hi], p / p.sum(1, keepdims=True))


def test_langid_learns_every_label(spark):
    """Ninety labels, one of which has long texts alone; clashing columns, repeated rows and null ids."""
    rng = random.Random(11)
    syllable = [[f"{a}{b}{c}" for c in "aeiou"[: 2 + k % 3]] for k, (a, b) in enumerate((a, b) for a in "bcdfghjklm" for b in "npqrstvwx")]
    text = lambda k, n: " ".join("".join(rng.choice(syllable[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(i % 90, 40 if i % 90 else 9000), f"l{i % 90:02}") for i in range(540)]
    docs = spark.createDataFrame([(*r, 0.5) for r in [*rows, rows[3], rows[3], (None, rows[4][1], "l04")]], "doc_id long, text string, lang string, score double")
    m = langid.fit(docs, Q.remainder(4) != 2, bits=15)
    assert len(m.langs) == 90
    got = langid.predict(spark, docs, m, Q.remainder(4) == 2).collect()
    assert len(got) == 543 and sum(r.lang_pred == f"l{r.doc_id % 90:02}" for r in got if r.doc_id is not None and r.held_out) > 0.9 * sum(r.held_out for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert langid.predict(spark, docs.limit(0), m, F.lit(False)).count() == 0


def test_langid_without_training(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    m = langid.fit(docs, F.lit(True))
    assert langid.predict(spark, docs, m, F.lit(False)).first().lang_pred == "und"


def test_pipeline(spark, sf):
    docs = Q.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == Q.table(spark, sf, "documents").columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    kept = {r.doc_id for r in docs.collect()}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == kept and kept


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_registered_queries_run(spark, sf, name):
    """Every registered query gives a row (op6: at least a piece) of each row of its table, with the contract's columns first."""
    got = Q.QUERIES[name](spark, sf)
    first = {
        "op1_toxicity": "doc_id held_out score predicted", "op2_ngram_jaccard": "doc_id n_shingles component_id", "op3_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5_language_id": "doc_id held_out lang_pred score", "op6_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op7_rans": "doc_id start n_tokens ids_crc32", "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9_token_counts": "doc_id n_bytes n_tokens over_limit", "op10_html_text": "page_id url text n_chars",
    }[name].split()
    assert got.columns[: len(first)] == first
    key = first[0]
    ids = sorted(r[0] for r in got.select(key).collect())
    every = sorted(r[0] for r in Q.table(spark, sf, "pages" if name == "op10_html_text" else "documents").select(key).collect())
    assert ids == every if name != "op6_pack" else sorted(set(ids)) == sorted(set(every))


def test_pipeline_of_nothing(spark, sf):
    docs = spark.createDataFrame([], Q.table(spark, sf, "documents").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
