"""Operators that SQL does not say, against brute force on small inputs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemforge.functions import canonical as C
from stemforge.operators import clusters as U
from stemforge.operators import enumeration as E
from stemforge.operators import fingerprints as P
from stemforge.operators import relations as R
from stemforge.operators import similarity as D
from stemforge.operators import stems as S
from stemforge.operators import subgraphs as G

STEM = "sid string, v int, lbegin int, lend int, rbegin int, rend int"


def random_stems(spark, seed, n=60, span=500):
    rng = random.Random(seed)
    rows = []
    for sid, count in (("a", n), ("b", 5), ("c", 1)):
        mine = []
        for _ in range(count):
            lb, w, g = rng.randint(1, span), rng.randint(1, 5), rng.randint(0, rng.choice([3, 60, 300]))
            mine.append((lb, lb + w - 1, lb + w + g, lb + 2 * w - 1 + g))
        rows += [(sid, v, *s) for v, s in enumerate(sorted(mine))]
    return rows, spark.createDataFrame(rows, STEM)


@pytest.mark.parametrize("seed", range(3))
def test_bins_lose_no_pair(spark, seed):
    """Relations by bins equal those of all pairs: edges, overlaps of halves, containment."""
    rows, s = random_stems(spark, seed)
    key = lambda d: sorted(map(tuple, d.collect()))
    for rule in (None, R.edge_type_minlen(3)):
        assert key(R.linked_edges(s, rule)) == key(R.edges(s, rule).where("etype <> 's'"))
    other, t = random_stems(spark, seed + 10)
    got = sorted((r.sid, r.r_v, r.t_v) for r in R.stem_overlaps(s, t).collect())
    assert got == sorted((a[0], a[1], b[1]) for a in rows for b in other if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5])
    held = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and b[2] >= a[3] and b[5] <= a[4]}
    links = {(r.sid, r.parent, r.v) for r in R.containment_links(s).collect()}
    assert links == {(i, p, c) for i, p, c in held if not any((i, p, x) in held and (i, x, c) in held for _, _, x in held)}
    best = {}
    for i, p, c in held:
        x = next(r for r in rows if r[:2] == (i, p))
        best[i, c] = min(best.get((i, c), (1 << 30, 0, 0)), (x[5] - x[2], -x[2], p))
    assert {(r.sid, r.v): r.parent for r in R.containment_parents(s).collect()} == {r[:2]: best.get(r[:2], (0, 0, None))[2] for r in rows}


def test_spans_that_touch_are_apart(spark):
    s = spark.createDataFrame([("s", 0, 1, 2, 9, 10), ("s", 1, 10, 11, 19, 20), ("s", 2, 15, 16, 24, 25)], STEM)
    assert [(r.begin, r.end, r.n) for r in S.strict_segments(s).orderBy("segment").collect()] == [(1, 10, 1), (10, 25, 2)]


def brute_traces(rows, gap, minstem):
    """Every chain of pairs, the best of each linked group: longest shorter half, fewest unpaired, outermost pair."""
    link = {(p, q) for p in rows for q in rows if 1 <= q[0] - p[0] <= gap and 1 <= p[1] - q[1] <= gap}
    group = {p: p for p in rows}
    for _ in rows:
        for p, q in link:
            group[p] = group[q] = min(group[p], group[q])
    chains = [[p] for p in rows]
    for c in chains:
        chains += [[*c, q] for p, q in link if p == c[-1]]
    best = {}
    for c in chains:
        half = min(c[-1][0] - c[0][0], c[0][1] - c[-1][1])
        unpaired = c[-1][0] - c[0][0] + c[0][1] - c[-1][1] - 2 * (len(c) - 1)
        rank = (-half, unpaired, c[0][0], c[0][1])
        best.setdefault(group[c[0]], []).append((rank, len(c), c[-1]))
    out = set()
    for found in best.values():
        least = min(f[0] for f in found)
        out.add((least[2], least[3], -least[0], least[1], frozenset((n, e) for r, n, e in found if r == least and n >= minstem)))
    return {x for x in out if x[4]}


@pytest.mark.parametrize("seed", range(8))
def test_traced_stems(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(a := rng.randint(1, 12), 40 - a - rng.choice([0, 0, 0, 1, 2, 9])) for _ in range(14)})
    got = S.trace_stems(spark.createDataFrame([("s", *r) for r in rows], "sid string, pos int, ppos int"), gap=3, minstem=3).collect()
    want = brute_traces(rows, 3, 3)
    assert len(got) == len(want)
    for r in got:
        assert any((r.lbegin, r.rend, r.unp_n) == (a, b, u) and (r.bp_n, (r.lend, r.rbegin)) in ends for a, b, _, u, ends in want)
        assert r.lvienna.count("(") == r.rvienna.count(")") == r.bp_n and len(r.lvienna) == r.lend - r.lbegin + 1 and len(r.rvienna) == r.rend - r.rbegin + 1
        assert len(r.lvienna) + len(r.rvienna) - 2 * r.bp_n == r.unp_n


def matchings(points):
    if not points:
        yield []
        return
    a, *rest = points
    for b in rest:
        for m in matchings([x for x in rest if x != b]):
            yield [(a, b), *m]


def graph(pairs):
    p = sorted(pairs)
    return [(i, j, "i" if p[i][1] > p[j][1] else "o") for i in range(len(p)) for j in range(i + 1, len(p)) if p[j][0] < p[i][1]]


def test_motif_parents(spark):
    """Of all connected structures to four stems: codes, and what is left of each, where connected, without one stem."""
    want_motifs, want = {}, set()
    for n in (2, 3, 4):
        for m in matchings(list(range(2 * n))):
            code = C.canonical_code(graph(m))
            if code is None or len({v for a, b, _ in graph(m) for v in (a, b)}) < n:
                continue
            want_motifs[code] = n
            for gone in range(n if n > 2 else 0):
                rest = sorted(m)[:gone] + sorted(m)[gone + 1 :]
                parent = C.canonical_code(graph(rest))
                if parent is not None and len({v for a, b, _ in graph(rest) for v in (a, b)}) == n - 1:
                    want.add((code, parent))
    motifs, parents = E.motif_table(spark, 4)
    assert {r.code: r.n_stems for r in motifs.collect()} == want_motifs
    assert {(r.code, r.parent) for r in parents.collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_trees(seed):
    """Merges of a tree against lists and a scan of all pairs, ties included."""
    rng = random.Random(seed)
    ids = [f"x{i}" for i in range(rng.randint(1, 9))]
    d = {(a, b): rng.choice([0.1, 0.2, 0.2, 0.4, rng.random()]) for a, b in itertools.combinations(ids, 2) if rng.random() < 0.8}
    merges, text = U.wpgma(ids, d)
    live = {i: (x, 0.0) for i, x in enumerate(ids)}
    near = {(i, j): d.get((ids[i], ids[j]), 1.0) for i in range(len(ids)) for j in range(i + 1, len(ids))}
    want = []
    while len(live) > 1:
        i, j = min(itertools.combinations(sorted(live), 2), key=lambda p: (near[p], p))
        h = near[i, j] / 2
        want.append((live[i][0], live[j][0], h))
        live[i] = f"({live[i][0]}:{h - live[i][1]:.4g},{live[j][0]}:{h - live[j][1]:.4g})", h
        del live[j]
        for k in live:
            if k != i:
                near[min(i, k), max(i, k)] = (near[min(i, k), max(i, k)] + near[min(j, k), max(j, k)]) / 2
    assert [m[1:3] for m in merges] == [w[:2] for w in want] and np.allclose([m[3] for m in merges], [w[2] for w in want])
    assert text == live[min(live)][0] + ";"


def test_repeated_kmeans(spark):
    """Each run against Lloyd's steps in numpy from the same points; runs together into consensus clusters."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (15, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    df = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in U.repeated_kmeans(df, 3, 4, seed=9).collect():
        got.setdefault(r.run, {})[r.id] = r.cluster
    for run in range(4):
        first = [r.id for r in df.orderBy(F.xxhash64("id", F.lit(9 + run)), "id").limit(3).collect()]
        c, before = {k: x[i] for k, i in enumerate(first)}, None
        for _ in range(50):
            far = {k: np.abs(x - v).sum(1) for k, v in c.items()}
            label = [min(far, key=lambda k: (far[k][i], -k)) for i in range(len(x))]
            error = sum(far[k][i] for i, k in enumerate(label))
            c = {k: x[[i for i, m in enumerate(label) if m == k]].mean(0) for k in set(label)}
            if before is not None and abs(before - error) <= 1e-4 * max(before, 1e-300):
                break
            before = error
        assert [got[run][i] for i in range(len(x))] == label
    runs = spark.createDataFrame([(r, i, c) for r, m in got.items() for i, c in m.items()], "run int, id long, cluster int")
    together = {p: sum(m[p[0]] == m[p[1]] for m in got.values()) for p in itertools.combinations(range(len(x)), 2)}
    label = list(range(len(x)))
    for _ in x:
        for (a, b), n in together.items():
            if n > 2:
                label[a] = label[b] = min(label[a], label[b])
    want = {i: k for i, k in enumerate(label) if any(n and i in p for p, n in together.items())}
    assert {r.id: r.cluster for r in U.consensus_clusters(runs, 2).collect()} == want


def test_principal_components(spark):
    x = np.random.default_rng(2).normal(size=(40, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    got = np.array([r.pc for r in U.principal_components(spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(x)], "id long, x array<double>")).orderBy("id").collect()])
    z = x - x.mean(0)
    want = z @ np.linalg.svd(z, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_common_motifs_in_parts(spark):
    rng = random.Random(4)
    rows = sorted({(i, f"m{min(rng.randint(0, 9), rng.randint(0, 9))}") for i in range(30) for _ in range(6)})
    fp = spark.createDataFrame([(i, c, rng.randint(1, 5)) for i, c in rows], "id long, code string, cnt long")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(D.shared(fp, per=4)) == key(D.shared(fp)) and len(key(D.shared(fp))) > 100
    assert {r.code: r.idx for r in P.motif_index(fp).collect()} == {c: i for i, c in enumerate(sorted({c for _, c in rows}))}


def test_brackets_end_stems_at_other_pairs(spark):
    """A gap within which another stem's base is paired ends a stem, however short it is."""
    d = spark.createDataFrame([("s", "((.[))..]"), ("t", "(([))..]"), ("u", "(.(..).)")], "sid string, vienna string")
    got = sorted((r.sid, r.lbegin, r.lend, r.rbegin, r.rend) for r in S.stems_from_brackets(d).collect())
    assert got == [("s", 1, 2, 5, 6), ("s", 4, 4, 9, 9), ("t", 1, 2, 4, 5), ("t", 3, 3, 8, 8), ("u", 1, 3, 6, 8)]
    split = spark.createDataFrame([("s", "([(]))")], "sid string, vienna string")  # the other's base lies in the gap of one base
    assert sorted((r.lbegin, r.lend, r.rbegin, r.rend) for r in S.stems_from_brackets(split).collect()) == [(1, 1, 6, 6), (2, 2, 4, 4), (3, 3, 5, 5)]
    assert [r.stem for r in S.stems_from_brackets(split).orderBy("stem").collect()] == [0, 1, 2]


def test_relations_and_their_classes(spark):
    """The 70 orders of two stems' ends fall into 23 classes under exchange and reading from the other end."""
    keys = []
    for at in itertools.combinations(range(8), 4):
        n = {"a": 0, "b": 0}
        word = ""
        for i in range(8):
            who = "a" if i in at else "b"
            n[who] += 1
            word += f"{who}{n[who]}"
        keys.append((word,))
    got = spark.createDataFrame(keys, "k string").select(R.overlap_class(F.col("k")).alias("c")).collect()
    assert len(keys) == 70 and len({r.c for r in got}) == 23


@pytest.mark.parametrize("seed", range(2))
def test_grown_patterns(spark, seed):
    """Every connected set of up to three edges of small graphs, its code, and the structures that have it."""
    rng = random.Random(seed)
    rows = [(s, u, v, rng.choice("ijosx")) for s in "abcdef" for u in range(5) for v in range(u + 1, 5) if rng.random() < 0.7]
    got = {(r.code, r.n_edges): r.support for r in G.grown_patterns(spark.createDataFrame(rows, "sid string, u int, v int, etype string"), 2, 3).collect()}
    have: dict = {}
    for s in "abcdef":
        mine = [r[1:] for r in rows if r[0] == s and r[3] in "ijo"]
        for n in (1, 2, 3):
            for part in itertools.combinations(mine, n):
                code = C.canonical_code(part)
                if code is not None and code.count(".") == n:
                    have.setdefault((code, n), set()).add(s)
    assert got == {k: len(v) for k, v in have.items() if len(v) >= 2} and any(n == 3 for _, n in got)


def test_random_structures_are_even(spark):
    """All 15 matchings of three stems come about equally often, and equal seeds give equal rows."""
    rows = [tuple(r.pairs) for r in E.random_structures(spark, 3000, 3, seed=5).collect()]
    n = [rows.count(p) for p in set(rows)]
    assert len(n) == 15 and min(n) > 140 and max(n) < 260
    assert rows == [tuple(r.pairs) for r in E.random_structures(spark, 3000, 3, seed=5).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_stems_at_each_position(spark, seed):
    """Sets of stems over positions against a walk along them; a stem of very many positions costs no row each."""
    rng = random.Random(seed)
    rows = [(s, v, b := rng.randint(0, 150), b + rng.choice([0, 1, 5, 70, 200])) for s in range(4) for v in range(rng.randint(1, 9))] + [(9, 0, 0, 2 * 10**8), (9, 1, 5, 6)]
    want, close = set(), {9: [0, 5, 7]}
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        last = ""
        for pos in close.get(s) or range(-1, 400):
            now = ",".join(str(v) for v in sorted(v for _, v, b, e in mine if b <= pos <= e))
            if now and now != last:
                want.add((s, pos, now))
            last = now
    df = spark.createDataFrame(rows, "sid long, v long, lbegin long, rend long")
    assert {tuple(r) for r in S.stems_per_position(df).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_ids_that_are_together(spark, seed):
    """Co-occurrence and consensus against loops, with ids alike in all runs, ids without a run and ids in two clusters of one."""
    rng = random.Random(seed)
    n, k = 60, 5
    kinds = [[rng.randint(0, 2) for _ in range(k)] for _ in range((6, 60, 6, 6)[seed])]
    own = {i: {(r, c) for r, c in enumerate(rng.choice(kinds))} for i in range(n)} | {99: {(0, 77)}}
    if seed > 1:
        own[7] = {(0, 1)}
        own[8] = own[8] | {(1, 0), (1, 1), (1, 2)}
    runs = spark.createDataFrame([(r, i, c) for i, x in own.items() for r, c in x], "run int, id long, cluster int")
    want = {(i, j): len(own[i] & own[j]) for i in own for j in own if i < j and own[i] & own[j]}
    rows = U.cooccurrence(runs).collect()
    assert len(rows) == len(want) and {(r.id1, r.id2): r.together for r in rows} == want
    for least in ((2,), (3,), (1, 5), (2,))[seed]:
        name = {i: i for p in want for i in p}
        for _ in name:
            for (i, j), t in want.items():
                if t > least:
                    name[i] = name[j] = min(name[i], name[j])
        rows = U.consensus_clusters(runs, least).collect()
        assert len(rows) == len(name) and {r.id: r.cluster for r in rows} == name


def one_matrix(ids, distance, missing=1.0):
    """The tree by one matrix of all ids and a look at all of it for each merge."""
    n, place = len(ids), {x: i for i, x in enumerate(ids)}
    d = np.full((n, n), missing)
    for (a, b), v in distance.items():
        d[place[a], place[b]] = d[place[b], place[a]] = v
    d[np.tril_indices(n)] = np.inf
    names, height, merges = [str(i) for i in ids], np.zeros(n), []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        h = float(d[i, j]) / 2
        merges.append((step, names[i], names[j], h))
        names[i] = f"({names[i]}:{h - height[i]:.4g},{names[j]}:{h - height[j]:.4g})"
        height[i] = h
        row = (np.minimum(d[i], d[:, i]) + np.minimum(d[j], d[:, j])) / 2
        d[i, i + 1 :], d[:i, i] = row[i + 1 :], row[:i]
        d[j, :] = d[:, j] = np.inf
    return merges, names[0] + ";"


@pytest.mark.parametrize("seed", range(30))
def test_trees_by_parts(seed):
    """Trees of connected parts against one matrix: ties, parts without a link, distances at and beyond the missing one."""
    rng = random.Random(seed)
    n, groups = rng.randint(2, 60), rng.randint(1, 6)
    some = (0.1, 0.2, 0.25, 0.5, 1.0, 0.9999999999999999) + ((1.5,) if seed % 5 == 0 else ())
    d = {(a, b): rng.choice([*some, rng.random()]) for a, b in itertools.combinations(range(n), 2) if a % groups == b % groups and rng.random() < 0.6}
    assert U.wpgma(list(range(n)), d) == one_matrix(list(range(n)), d)


def test_tree_of_many_parts():
    """Forty thousand ids in pairs: one matrix would take 12.8 GB."""
    ids = list(range(40_000))
    a = np.arange(0, 40_000, 2)
    merges, text = U.wpgma_of(ids, a, a + 1, np.full(20_000, 0.5))
    assert len(merges) == 39_999 and merges[0][1:] == ("0", "1", 0.25) and merges[-1][3] == 0.5 and text.count("(") == 39_999


@pytest.mark.parametrize("seed", range(2))
def test_filled_rows(spark, seed, monkeypatch):
    """Every id with every motif, across blocks; ids without a name and repeated rows are kept, and no row of the grid is shuffled."""
    rng = random.Random(seed)
    monkeypatch.setattr(P, "BLOCK", 4)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), c, rng.randint(1, 9)) for c in range(21) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "id long, code long, cnt long")
    want = []
    for i in {r[0] for r in rows}:
        for c in {r[1] for r in rows}:
            want += [(i, c, n) for x, y, n in rows if i is not None and (x, y) == (i, c)] or [(i, c, 0)]
    out = P.fill_missing(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan.split("Generate")[0]


@pytest.mark.parametrize("make", [P.fill_missing, P.binary_matrix])
def test_grid_is_made_block_by_block(spark, monkeypatch, make):
    """Each task makes one block of motifs after another, for all its structures: what it writes repeats few motifs."""
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "TILES", 4)
    fp = spark.createDataFrame([(i, c, 1 + i % 3) for i in range(30) for c in range(16) if (i + c) % 5 == 0], "id long, code long, cnt long")
    parts = [[r.code // 4 for r in x] for x in make(fp).rdd.glom().collect() if x]
    assert sum(map(len, parts)) == 30 * 16
    for p in parts:
        assert sum(a != b for a, b in zip(p, p[1:])) == len(set(p)) - 1


def test_trees_keep_links_only(spark, sf, monkeypatch):
    """Of all pairs only the links above the threshold are written to disk."""
    from stemforge.plans import fingerprint_queries as Q

    kept, write = [], U.checkpointed
    monkeypatch.setattr(U, "checkpointed", lambda df: kept.append(write(df)) or kept[-1])
    Q.cluster_trees(spark, sf)
    assert kept and all(x.where("jaccard <= 0.175").count() == 0 for x in kept if "jaccard" in x.columns)


def test_kmeans_points_and_links():
    """Of equal distances the last cluster wins, points with a null have none; links of alike ids are as few as connect them."""
    import pyarrow as pa

    x = U._matrix(pa.array([[0.0, 0.0], [1.0, 0.0], None, [2.0, None], [5.0]]), 2)
    (run, best, far), (other, best2, _) = U._near(x, [(0, 0, [0.0, 0.0]), (0, 1, [2.0, 0.0]), (3, 4, [1.0, 1.0])])
    assert (run, other, best.tolist(), best2.tolist()) == (0, 3, [0, 1, 1, 1, 1], [2] * 5)
    assert far[:2].tolist() == [0.0, 1.0] and np.isnan(far[2:]).all()
    own = [[1, 1, 1], [1, 1, 2], [1, 2, 2], [7, 8, 9]] * 20
    rows = pa.record_batch([pa.array([5] * 80 + [6]), pa.array(range(81)), pa.array([*own, [1, 1, 1]])], ["key", "like", "own"])
    got = [b.to_pydict() for b in U._band_links(1)(iter([rows.slice(0, 30), rows.slice(30)]))]
    up = list(range(81))
    for b in got:
        for i, j in zip(b["id1"], b["id2"], strict=True):
            up = [min(up[i], up[j]) if v in (up[i], up[j]) else v for v in up]
    assert sum(len(b["id1"]) for b in got) == 59 + 19 and up == [i if i == 80 else 3 if i % 4 == 3 else 0 for i in range(81)]
