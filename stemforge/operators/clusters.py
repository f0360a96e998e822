"""Single-linkage clusters, average-linkage trees, k-means with Manhattan distance, co-occurrence, principal components."""

from __future__ import annotations

import atexit
import heapq
import re
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ids of a list that is broadcast at most.
FEW_IDS = 1_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder of spark.checkpoint.dir; where it is unset, one of the session's own, in local mode only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = context.getConf().get("spark.checkpoint.dir")
        if not at:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="stemforge-")
            atexit.register(shutil.rmtree, at, True)
        context.setCheckpointDir(f"{at}/stemforge-{uuid.uuid4().hex}")
    return df.checkpoint()


def single_linkage(pairs: DataFrame, threshold: float, column: str = "jaccard") -> DataFrame:
    """id, cluster: components of the pairs strictly above ``threshold``; every id of ``pairs`` is in a cluster, named by its least id.

    Each round takes the least label of the neighbours and then the label of that label, so rounds grow with the
    logarithm of a component's width; labels are checkpointed."""
    ids = pairs.select(F.col("id1").alias("id")).unionAll(pairs.select("id2")).distinct()
    e = pairs.where(F.col(column) > threshold).select("id1", "id2")
    e = checkpointed(e.unionAll(e.select("id2", "id1")).distinct())
    labels = checkpointed(ids.select("id", F.col("id").alias("cluster")))
    while True:
        near = e.join(labels.withColumnRenamed("id", "id2"), "id2").groupBy(F.col("id1").alias("id")).agg(F.min("cluster").alias("least"))
        hop = labels.join(near, "id", "left").select("id", "cluster", F.least("cluster", F.coalesce("least", "cluster")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("cluster").alias("via"))
        new = checkpointed(hop.join(jump, "new").select("id", "cluster", F.least("new", "via").alias("new")))
        changed = new.where("new <> cluster").limit(1).count()
        labels = new.select("id", F.col("new").alias("cluster"))
        if not changed:
            return labels


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def cluster_pairs(pairs: DataFrame, labels: DataFrame, column: str = "jaccard", big: float = 1.0) -> DataFrame:
    """cluster, id1, id2, distance of pairs inside a cluster."""
    one = labels.select(F.col("id").alias("id1"), "cluster")
    two = labels.select(F.col("id").alias("id2"), F.col("cluster").alias("c2"))
    return pairs.join(one, "id1").join(two, "id2").where("cluster = c2").select("cluster", "id1", "id2", (big - F.col(column)).alias("distance"))


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each place's connected part, by links a - b."""
    top = np.arange(n)
    while len(a):
        low = np.minimum(top[a], top[b])
        new = top.copy()
        for ends in (a, b, top[a], top[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == top).all():
            break
        top = new
    return top


def _part_merges(d: np.ndarray, missing: float):
    """(distance, i, j) of the merges of one matrix (its upper triangle; the rest is infinite) while some distance is below ``missing``.

    Each row's least entry is kept, so a merge looks again only at the rows that it changed."""
    n = len(d)
    at = d.argmin(axis=1)
    least = d[np.arange(n), at]
    while n > 1 and least.min() < missing:
        i = int(least.argmin())
        j = int(at[i])
        yield float(least[i]), i, j
        # rows as seen from both sides of the diagonal; what is merged away stays infinite
        row = (np.minimum(d[i], d[:, i]) + np.minimum(d[j], d[:, j])) / 2
        d[i, i + 1 :], d[:i, i] = row[i + 1 :], row[:i]
        d[j, :] = d[:, j] = np.inf
        nearer = np.flatnonzero((d[:i, i] < least[:i]) | (d[:i, i] == least[:i]) & (i < at[:i]))
        least[nearer], at[nearer] = d[nearer, i], i
        again = np.union1d(np.flatnonzero((at == j) | (at == i) & (d[:, i] != least)), [i, j])
        at[again] = d[again].argmin(axis=1)
        least[again] = d[again, at[again]]


def wpgma_of(ids: list, a: np.ndarray, b: np.ndarray, v: np.ndarray, missing: float = 1.0) -> tuple[list[tuple], str]:
    """As ``wpgma``, of pairs by their places a, b in ids and distances v.

    Places without a way between them of distances below ``missing`` only meet at ``missing``, when no nearer pair is left; so each
    connected part has a matrix of its own, and memory grows with the parts and not with the square of all ids."""
    n = len(ids)
    if not n:
        return [], ";"
    if len(v) and not (v <= missing).all():
        top = np.zeros(n, np.int64)  # what is missing is nearer than what is given: one matrix
        stop = np.inf
    else:
        top, stop = _parts(n, a, b), missing
    members = np.argsort(top, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(top[members]) != 0])
    place = np.empty(n, np.int64)
    place[members] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    order = np.argsort(top[a], kind="stable")
    cut = np.searchsorted(top[a][order], top[members][first])

    def merges_of(mine: np.ndarray, rows: np.ndarray):
        d = np.full((len(mine), len(mine)), missing)
        x, y = place[a[rows]], place[b[rows]]
        d[x, y] = d[y, x] = v[rows]
        d[np.tril_indices(len(mine))] = np.inf
        return [(h, int(mine[i]), int(mine[j])) for h, i, j in _part_merges(d, stop)]

    ends, stops = np.r_[first[1:], n].astype(int), np.r_[cut[1:], len(a)].astype(int)
    return _tree(ids, [merges_of(members[s:e], order[p:q]) for s, e, p, q in zip(first, ends, cut, stops, strict=True) if e - s > 1], missing)


def _tree(ids: list, found: list, missing: float) -> tuple[list[tuple], str]:
    """As ``wpgma``, of the merges (distance, i, j) by places in ids that each part gives in order; the parts themselves meet at ``missing``."""
    n = len(ids)
    names, height, merges = [str(i) for i in ids], np.zeros(n), []
    live = np.ones(n, bool)

    def merge(v: float, i: int, j: int) -> None:
        h = v / 2
        merges.append((len(merges), names[i], names[j], h))
        names[i], names[j] = f"({names[i]}:{h - height[i]:.4g},{names[j]}:{h - height[j]:.4g})", ""
        height[i], live[j] = h, False

    for x in heapq.merge(*found):  # the first of all nearest pairs, as in one matrix
        merge(*x)
    for j in np.flatnonzero(live)[1:].tolist():
        merge(missing, int(live.argmax()), j)
    return merges, names[int(live.argmax())] + ";"


def wpgma(ids: list, distance: dict[tuple, float], missing: float = 1.0) -> tuple[list[tuple], str]:
    """Merges (step, left, right, height) and the Newick text of an unweighted-mean tree; ties go to the first pair in order."""
    place = {x: i for i, x in enumerate(ids)}
    a, b = (np.array([place[p[k]] for p in distance], np.int64) for k in (0, 1))
    return wpgma_of(ids, a, b, np.array(list(distance.values()), float), missing)


def trees(inside: DataFrame, missing: float = 1.0) -> DataFrame:
    """cluster, n, root_height, newick of each cluster of ``cluster_pairs`` (its pairs, and a matrix of each connected part, are held by one function)."""
    kind = inside.schema["cluster"].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        one, two = p["id1"].to_numpy(), p["id2"].to_numpy()
        ids = np.unique(np.concatenate([np.unique(one), np.unique(two)]))
        merges, text = wpgma_of(ids.tolist(), np.searchsorted(ids, one), np.searchsorted(ids, two), p["distance"].to_numpy(float), missing)
        return pd.DataFrame([(p["cluster"].iloc[0], len(ids), merges[-1][3] if merges else 0.0, text)], columns=["cluster", "n", "root_height", "newick"])

    return inside.groupBy("cluster").applyInPandas(run, f"cluster {kind}, n int, root_height double, newick string")


def _linked(n: int):
    """Rows (code, at), ordered by code -> a forest of links (a, b) between places that share a code, at most n - 1 of them."""

    def run(source):
        top, held, size, last = np.arange(n), [], 0, None
        for batch in source:
            if not batch.num_rows:
                continue
            code, at = batch.column("code"), batch.column("at").to_numpy()
            same = code.slice(1)
            same = pc.equal(same, code.slice(0, len(same))).to_numpy(zero_copy_only=False)
            held.append((at[:-1][same], at[1:][same]))
            if last is not None and last[0] == code[0].as_py():
                held.append((np.array([last[1]]), at[:1]))
            last, size = (code[len(code) - 1].as_py(), at[-1]), size + len(at)
            if size >= 1_000_000:
                top = _parts(n, *(np.concatenate([*x, y]) for x, y in zip(zip(*held, strict=True), (np.arange(n), top), strict=True)))
                held, size = [], 0
        if held:
            top = _parts(n, *(np.concatenate([*x, y]) for x, y in zip(zip(*held, strict=True), (np.arange(n), top), strict=True)))
        a = np.flatnonzero(top != np.arange(n))
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(top[a].astype(np.int32))], ["a", "b"])

    return run


def _joined(n: int):
    """Links (a, b) -> a forest of as much."""

    def run(source):
        top = np.arange(n)
        for batch in source:
            a, b = (batch.column(c).to_numpy().astype(np.int64) for c in "ab")
            top = _parts(n, np.concatenate([np.arange(n), a]), np.concatenate([top, b]))
        a = np.flatnonzero(top != np.arange(n))
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(top[a].astype(np.int32))], ["a", "b"])

    return run


def _part_trees(top: np.ndarray, many: np.ndarray, missing: float):
    """Rows (part, code, at), ordered by part and code -> the merges of each part, by places: distances, and both sides."""
    members = np.argsort(top, kind="stable")
    place = np.empty(len(top), np.int64)
    place[members] = np.arange(len(top)) - np.searchsorted(top[members], top[members])

    def run(source):
        now, both, held = None, None, []

        def count():
            """Adds the pairs of what is held: whole codes, or for a code that goes on with the next batch all that is seen of it."""
            code, at = pa.chunked_array([c for c, _ in held]), place[np.concatenate([a for _, a in held])]
            code = code.combine_chunks().dictionary_encode().indices.to_numpy()
            size = np.bincount(code)
            start = np.cumsum(size) - size
            for some in np.array_split(np.arange(len(at)), 1 + (int((size * size).sum()) >> 22)):
                times = size[code[some]]
                y = np.repeat(start[code[some]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                np.add.at(both.reshape(-1), np.repeat(at[some], times) * len(both) + at[y], 1)

        def out():
            count()
            mine = np.flatnonzero(top == now)
            d = np.empty(both.shape)
            for i, n in enumerate(many[mine]):  # row by row, as joins give it: 1 - shared / (sizes - shared)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d[i] = np.where(both[i] > 0, 1.0 - both[i] / (n + many[mine] - both[i]), missing)
                d[i, : i + 1] = np.inf
            h, i, j = (np.array(x) for x in zip(*_part_merges(d, missing), strict=True))
            return pa.record_batch([pa.array([x.tobytes()]) for x in (h.astype("<f8"), mine[i].astype("<i4"), mine[j].astype("<i4"))], ["h", "i", "j"])

        for batch in source:
            part = batch.column("part").to_numpy()
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            for lo, hi in zip(first, [*first[1:], len(part)], strict=bool(len(part))):
                if part[lo] != now:
                    if now is not None:
                        yield out()
                    now = part[lo]
                    both, held = np.zeros((int((top == now).sum()),) * 2, np.int32), []
                held.append((batch.column("code").slice(lo, hi - lo), batch.column("at").slice(lo, hi - lo).to_numpy()))
                if sum(len(a) for _, a in held) >= 200_000:
                    code = pa.chunked_array([c for c, _ in held])
                    last = pc.index(code, code[len(code) - 1]).as_py()  # the last code may go on
                    if last:
                        at, code = np.concatenate([a for _, a in held]), code.combine_chunks()
                        held = [(code.slice(0, last), at[:last])]
                        count()
                        held = [(code.slice(last), at[last:])]
        if now is not None:
            yield out()

    return run


def fingerprint_tree(fp: DataFrame) -> DataFrame:
    """As ``trees`` of the distances 1 - Jaccard of all fingerprints that share a motif with another, as cluster 1: no pair is a row.

    Links along each motif give the connected parts; a part's fingerprints then go to one task, which counts its pairs in a matrix
    and gives its merges alone.  The ids and their sizes are held in one place, and a matrix of each part in one task."""
    spark, missing = fp.sparkSession, 1.0
    gc = lambda: spark.sparkContext._jvm.System.gc()  # noqa: E731  what was shuffled goes before more comes
    sizes = fp.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy("id").toArrow()
    gc()
    n, ids = sizes.num_rows, sizes["id"].combine_chunks()
    places = spark.createDataFrame(pa.table({"at": pa.array(np.arange(n, dtype=np.int32)), "id": ids}), f"at int, id {fp.schema['id'].dataType.simpleString()}")
    rows = fp.where("code is not null").select("id", "code").join(F.broadcast(places), "id").select("code", "at")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forests = rows.repartition(parts, "code").sortWithinPartitions("code").mapInArrow(_linked(n), "a int, b int")
    links = forests.coalesce(8).mapInArrow(_joined(n), "a int, b int").toArrow()  # at most 8 n
    gc()
    top = _parts(n, links["a"].to_numpy().astype(np.int64), links["b"].to_numpy().astype(np.int64))
    alone = np.bincount(top, minlength=n)[top] == 1
    of = spark.createDataFrame(pa.table({"at": pa.array(np.flatnonzero(~alone).astype(np.int32)), "part": pa.array(top[~alone].astype(np.int32))}), "at int, part int")
    dealt = rows.join(F.broadcast(of), "at").select("part", "code", "at").repartition(parts, "part").sortWithinPartitions("part", "code")
    merges = dealt.mapInArrow(_part_trees(top, sizes["n"].to_numpy(), missing), "h binary, i binary, j binary")
    named = [x for x, skip in zip(ids.to_pylist(), alone, strict=True) if not skip]
    place = np.cumsum(~alone) - 1

    def run(source):
        found = []
        for batch in source:
            for h, i, j in zip(*(batch.column(c).to_pylist() for c in "hij"), strict=True):
                found.append(list(zip(np.frombuffer(h, "<f8").tolist(), place[np.frombuffer(i, "<i4")].tolist(), place[np.frombuffer(j, "<i4")].tolist(), strict=True)))
        if found:
            made, text = _tree(named, found, missing)
            yield pa.record_batch([pa.array([1], pa.int32()), pa.array([len(named)], pa.int32()), pa.array([made[-1][3]]), pa.array([text])], ["cluster", "n", "root_height", "newick"])

    return merges.repartition(1).mapInArrow(run, "cluster int, n int, root_height double, newick string")


def indented(newick: str) -> str:
    """A Newick text as an indented outline."""
    out, depth, word = [], 0, ""
    for c in newick:
        if c in "(),;":
            if word.strip():
                out.append("  " * depth + word.strip())
            word = ""
            depth += (c == "(") - (c == ")")
        else:
            word += c
    return "\n".join(out)


def leaves(newick: str) -> list[str]:
    """Names of a Newick text in order."""
    import re

    return re.findall(r"(?<=[(,])([^(),:;]+)(?=[:,)])", newick)


def _nearest(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(run,) id, x, cluster, error: each point's nearest centroid; of equal distances the last cluster wins.

    The centroids of a run travel as one row's array, so a point finds its cluster without a shuffle."""
    run = ["run"] if "run" in centroids.columns else []
    far = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, v: s + v)
    table = centroids.groupBy(*run).agg(F.collect_list(F.struct("cluster", "c")).alias("_all"))
    least = F.array_min(F.transform("_all", lambda z: F.struct(far(z["c"]).alias("d"), (-z["cluster"]).alias("k"))))
    return points.crossJoin(F.broadcast(table)).withColumn("_b", least).select(*run, "id", "x", (-F.col("_b.k")).alias("cluster"), F.col("_b.d").alias("error"))


def manhattan_step(points: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, error) and the mean centroids (cluster, c) of one Lloyd step with Manhattan distance.

    points: id, x (array); centroids: cluster, c (array), k rows.  Of equal distances the last cluster wins; means are
    partial sums."""
    near = _nearest(points, centroids)
    parts = near.select("cluster", F.posexplode("x")).groupBy("cluster", "pos").agg(F.avg("col").alias("m"))
    means = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    return near.select("id", "cluster", "error"), means


def _matrix(x: pa.Array, size: int) -> np.ndarray:
    """Rows of an array column as numbers, null and missing elements as NaN."""
    long = pc.fill_null(pc.list_value_length(x), 0).to_numpy()
    flat = x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if (long == size).all():
        return flat.reshape(-1, size)
    out = np.full((len(x), max(size, int(long.max(initial=0)))), np.nan)
    row = np.repeat(np.arange(len(x)), long)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)] = flat
    out[long > size, 0] = np.nan  # as a missing element: no distance
    return out[:, :size]


def _near(x: np.ndarray, rows: list[tuple]) -> list[tuple]:
    """(run, place of each point's nearest centroid among ``rows``, distance), of centroids (run, cluster, c) in order; of equal distances the last wins.

    Distances are summed element by element, in order, as SQL sums them."""
    far = np.zeros((len(rows), len(x)))
    for i, c in enumerate(np.array([r[2] for r in rows], float).T):
        far += np.abs(x[:, i] - c[:, None])
    run = np.array([r[0] for r in rows])
    out = []
    for r in np.unique(run).tolist():
        at = np.flatnonzero(run == r)
        best = at[len(at) - 1 - far[at[::-1]].argmin(axis=0)]
        out.append((r, best, far[best, np.arange(len(x))]))
    return out


def _step(rows: list[tuple], points: int = 1000):
    """Of each task's points (id, x): run, cluster, count and sum of each element, error."""

    def run(source):
        size = len(rows[0][2])
        n, total, error = np.zeros((len(rows), size), np.int64), np.zeros((len(rows), size)), np.zeros(len(rows))
        for batch in source:
            whole = _matrix(batch.column("x"), size)
            for x in (whole[i : i + points] for i in range(0, len(whole), points)):
                there = ~np.isnan(x)
                for _, best, d in _near(x, rows):
                    order = np.argsort(best, kind="stable")
                    first = np.flatnonzero(np.diff(best[order], prepend=-1))
                    at = best[order][first]
                    n[at] += np.add.reduceat(there[order].astype(np.int64), first)
                    total[at] += np.add.reduceat(np.where(there, x, 0.0)[order], first)
                    error[at] += np.add.reduceat(np.nan_to_num(d)[order], first)
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(n.tolist()), pa.array(total.tolist()), pa.array(error)], ["run", "cluster", "n", "total", "error"])

    return run


def _assign(rows: list[tuple], points: int = 1000):
    """id, and each run's cluster."""

    def run(source):
        size, cluster = len(rows[0][2]), np.array([r[1] for r in rows], np.int32)
        for batch in source:
            whole = _matrix(batch.column("x"), size)
            parts = [np.stack([cluster[best] for _, best, _ in _near(whole[i : i + points], rows)], axis=1) for i in range(0, len(whole), points)]
            for i, part in enumerate(parts):
                every = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.reshape(-1)))
                yield pa.record_batch([batch.column("id").slice(i * points, len(part)), every], ["id", "clusters"])

    return run


def repeated_kmeans(points: DataFrame, k: int, runs: int = 20, *, tolerance: float = 1e-4, most: int = 50, seed: int = 1) -> DataFrame:
    """run, id, cluster: ``runs`` k-means clusterings, each from k random points of its own (those of least hash), all stepped
    at once, a job a step, until no run's error changes by more than ``tolerance`` of itself.

    Tasks measure arrays of points and return sums; a point with a null element (or NaN) has no distance and gets the last cluster."""
    each = points.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "id", "x")
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.xxhash64("id", F.lit(seed) + F.col("run")), "id"))
    start = each.withColumn("rank", rank).where(F.col("rank") <= k).select("run", (F.col("rank") - 1).alias("cluster"), F.col("x").cast("array<double>").alias("c"))
    rows = sorted((tuple(r) for r in start.collect()), key=lambda r: r[:2])  # k rows a run
    if not rows:
        return points.select(F.lit(0).alias("run"), "id", F.lit(0).alias("cluster"))
    plain, before = points.select("id", F.col("x").cast("array<double>").alias("x")), None
    for _ in range(most):
        used, n, total, error = rows, {}, {}, {}
        for r in plain.mapInArrow(_step(rows), "run int, cluster int, n array<long>, total array<double>, error double").toLocalIterator():
            key = r.run, r.cluster
            n[key], total[key] = n.get(key, 0) + np.array(r.n), total.get(key, 0.0) + np.array(r.total)
            error[r.run] = error.get(r.run, 0.0) + r.error
        if before is not None and all(abs(before[r] - e) <= tolerance * max(before[r], 1e-300) for r, e in error.items()):
            break
        before = error
        rows = [(*key, (total[key] / n[key]).tolist()) for key in sorted(n) if n[key].all()] or rows
    kind = points.schema["id"].dataType.simpleString()
    names = sorted({r[0] for r in used})
    best = plain.mapInArrow(_assign(used), f"id {kind}, clusters array<int>")
    return best.select("id", F.posexplode("clusters").alias("_at", "cluster")).select(F.array(*map(F.lit, names))[F.col("_at")].alias("run"), "id", "cluster")


def manhattan_kmeans(points: DataFrame, k: int, *, tolerance: float = 1e-4, most: int = 50, seed: int = 1) -> DataFrame:
    """id, cluster by repeated steps from k random points until the error changes by less than ``tolerance`` of itself."""
    return repeated_kmeans(points, k, 1, tolerance=tolerance, most=most, seed=seed).select("id", "cluster")


def _alike(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, like) and (like, run, cluster): ids that share all of their clusters are alike, and are named by the least of them."""
    whole = runs.where("id is not null and run is not null and cluster is not null")
    own = checkpointed(whole.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "cluster"))).alias("_own")))
    kinds = own.groupBy("_own").agg(F.min("id").alias("like"))
    ids = checkpointed(own.join(kinds, "_own").select("id", "like"))
    return ids, checkpointed(kinds.select("like", F.explode("_own").alias("_r")).select("like", "_r.run", "_r.cluster"))


def _together(a: DataFrame, b: DataFrame) -> DataFrame:
    """like1, like2, together of all ordered pairs of kinds with a common cluster, each kind with itself too."""
    one, two = a.withColumnRenamed("like", "like1"), b.withColumnRenamed("like", "like2")
    return one.join(two, ["run", "cluster"]).groupBy("like1", "like2").agg(F.count(F.lit(1)).alias("together"))


def cooccurrence(runs: DataFrame) -> DataFrame:
    """id1 < id2, together: in how many runs (run, id, cluster) two ids share a cluster.

    Kinds of ids that are alike in all runs are counted, and each pair of kinds gives the pairs of its ids, without a
    shuffle of those, which are as many as they are by definition."""
    ids, kinds = _alike(runs)
    n = ids.count()
    if 8 * kinds.select("like").distinct().count() > n or n > FEW_IDS:
        a, b = runs.select("run", "cluster", F.col("id").alias("id1")), runs.select("run", "cluster", F.col("id").alias("id2"))
        return a.join(b, ["run", "cluster"]).where("id1 < id2").groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("together"))
    one, two = ids.select(F.col("id").alias("id1"), F.col("like").alias("like1")), ids.select(F.col("id").alias("id2"), F.col("like").alias("like2"))
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = _together(kinds, kinds).join(F.broadcast(one), "like1").repartition(parts, "id1")
    return first.join(F.broadcast(two), "like2").where("id1 < id2").select("id1", "id2", "together")


def _band_links(least: int):
    """Rows (key, like, own) sorted by key -> links (id1, id2) that connect all likes of a key whose own have more than ``least`` equal elements."""

    def run(source):
        now, held = None, []

        def out():
            like = pa.concat_arrays([b.column("like") for b in held])
            own = np.concatenate([b.column("own").flatten().to_numpy().reshape(b.num_rows, -1) for b in held])
            todo, a, b = np.arange(len(like)), [], []
            while len(todo) > 1:
                near, todo = [todo[0]], todo[1:]
                while near and len(todo):  # what one link reaches is not looked at again
                    i = near.pop()
                    hit = (own[todo] == own[i]).sum(axis=1) > least
                    found, todo = todo[hit], todo[~hit]
                    a += [i] * len(found)
                    b += found.tolist()
                    near += found.tolist()
            return pa.record_batch([like.take(pa.array(x, pa.int64())) for x in (a, b)], ["id1", "id2"])

        for batch in source:
            key = batch.column("key").to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]).tolist()
            for i, j in zip(first, [*first[1:], len(key)], strict=True):
                if key[i] != now:
                    if held:
                        yield out()
                    now, held = key[i], []
                held.append(batch.slice(i, j - i))
        if held:
            yield out()

    return run


def consensus_clusters(runs: DataFrame, least: int) -> DataFrame:
    """Clusters of ids that share a cluster in more than ``least`` runs; ids without any common cluster are left out.

    Two ids that are together in more than ``least`` of R runs are apart in fewer than R - least, so of that many bands of runs
    one agrees as a whole: kinds of ids meet by band, only those that meet are compared, and what is linked already is not.  (Where an id has no or several
    clusters in a run all pairs are counted.)"""
    ids, kinds = _alike(runs)
    names = sorted(r[0] for r in kinds.select("run").distinct().collect())
    plain = kinds.groupBy("like").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run").alias("k")).where((F.col("n") != len(names)) | (F.col("k") != len(names))).limit(1).count() == 0
    bands = len(names) - least
    if plain and 0 < bands <= len(names):
        at = F.create_map(*(F.lit(x) for i, r in enumerate(names) for x in (r, i % bands)))
        own = kinds.groupBy("like").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "cluster"))), lambda s: F.xxhash64(s["cluster"])).alias("own"))
        keys = kinds.withColumn("_band", at[F.col("run")]).groupBy("like", "_band").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("run", "cluster")))).alias("key"))
        kind = runs.schema["id"].dataType.simpleString()
        met = keys.join(own, "like").select("key", "like", "own").repartition("key").sortWithinPartitions("key")
        pairs = met.mapInArrow(_band_links(least), f"id1 {kind}, id2 {kind}")
    else:
        pairs = _together(kinds, kinds).where((F.col("together") > least) & (F.col("like1") < F.col("like2"))).select(F.col("like1").alias("id1"), F.col("like2").alias("id2"))
    # a kind's own ids are together wherever they have a cluster; one that is alone stays so unless its kind meets another in some run
    linked = single_linkage(checkpointed(pairs).withColumn("jaccard", F.lit(1.0)), 0.5).select(F.col("id").alias("like"), F.col("cluster").alias("_named"))
    sizes = kinds.distinct().join(ids.groupBy("like").agg(F.count(F.lit(1)).alias("n")), "like")
    met = sizes.join(sizes.groupBy("run", "cluster").agg(F.sum("n").alias("of")).where("of > 1"), ["run", "cluster"], "left_semi").select("like").distinct()
    inside = kinds.groupBy("like").agg(F.sum(F.lit(1)).alias("_self"))
    if not plain:
        inside = _together(kinds, kinds).where("like1 = like2").select(F.col("like1").alias("like"), F.col("together").alias("_self"))
    out = ids.join(met, "like", "left_semi").join(linked, "like", "left").join(inside, "like", "left")
    return out.select("id", F.coalesce("_named", F.when(F.col("_self") > least, F.col("like")), "id").alias("cluster"))


def principal_components(points: DataFrame, k: int = 3) -> DataFrame:
    """id, pc (array of k): projections of centred vectors (id, x) on the first k components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = points.select("id", array_to_vector(F.col("x").cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=False).fit(v).transform(v)
    return PCA(k=k, inputCol="z", outputCol="p").fit(centred).transform(centred).select("id", vector_to_array("p").alias("pc"))


def top_loadings(points: DataFrame, names: list[str], k: int = 3, top: int = 6) -> list[list[tuple[str, float]]]:
    """For each component the features of largest absolute loading (the model has features x k numbers)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    v = points.select(array_to_vector(F.col("x").cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=False).fit(v).transform(v)
    m = PCA(k=k, inputCol="z", outputCol="p").fit(centred).pc.toArray()
    return [sorted(zip(names, m[:, j].tolist(), strict=True), key=lambda t: -abs(t[1]))[:top] for j in range(k)]
