"""Connected subgraphs of structures' edge graphs: declarative for 3 and 4 stems, generated beyond; sampling; segments.

A subgraph's labelled key is the upper triangle of its edge types row by row, stems in order, '.' where there is no i,
j or o edge.  There are few distinct keys, so subgraphs are counted by key before a canonical code is computed.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_code, code_of_key, key_code


def _linked(edges: DataFrame) -> DataFrame:
    """i, j and o edges in both directions: sid, u, v, e (as seen from u)."""
    e = edges.where("etype in ('i', 'j', 'o')").select("sid", "u", "v", F.col("etype").alias("e"))
    return e.unionAll(e.select("sid", F.col("v").alias("u"), F.col("u").alias("v"), F.translate("e", "ij", "ji").alias("e")))


def triples(edges: DataFrame) -> DataFrame:
    """sid, a < b < c, key of all connected 3-stem subgraphs.

    Every connected triple has a middle vertex with two edges: joining edges at a vertex yields each triple once for a
    path and three times for a triangle; one row of each is kept.  The join key is (sid, vertex), not the structure, so
    a large structure spreads over many tasks."""
    e = _linked(edges)
    two = e.alias("x").join(e.alias("y"), (F.col("x.sid") == F.col("y.sid")) & (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v")))
    sets = two.select(F.col("x.sid").alias("sid"), F.array_sort(F.array("x.u", "x.v", "y.v")).alias("s")).distinct()
    sets = sets.select("sid", F.get("s", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b"), F.get("s", F.lit(2)).alias("c"))
    return with_key(sets, edges, ["a", "b", "c"])


def with_key(sets: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """Vertex sets (ascending columns) with their labelled key, one left join a pair of columns."""
    e = edges.where("etype in ('i', 'j', 'o')")
    parts = []
    for i, p in enumerate(names):
        for q in names[i + 1 :]:
            side = e.select("sid", F.col("u").alias(p), F.col("v").alias(q), F.col("etype").alias(f"_{p}{q}"))
            sets = sets.join(side, ["sid", p, q], "left")
            parts.append(F.coalesce(f"_{p}{q}", F.lit(".")))
    return sets.select("sid", *names, F.concat(*parts).alias("key"))


def quadruples(edges: DataFrame) -> DataFrame:
    """sid, a < b < c < d, key of all connected 4-stem subgraphs: connected triples and one more linked stem, each set once."""
    e = _linked(edges)
    t = triples(edges).select("sid", F.array("a", "b", "c").alias("s"))
    more = t.withColumn("u", F.explode("s")).join(e.select("sid", "u", "v"), ["sid", "u"]).where(~F.array_contains("s", F.col("v")))
    sets = more.select("sid", F.array_sort(F.concat("s", F.array("v"))).alias("s")).distinct()
    names = ["a", "b", "c", "d"]
    return with_key(sets.select("sid", *(F.get("s", F.lit(i)).alias(n) for i, n in enumerate(names))), edges, names)


def key_counts(subgraphs: DataFrame) -> DataFrame:
    """sid, key, cnt."""
    return subgraphs.groupBy("sid", "key").agg(F.count(F.lit(1)).alias("cnt"))


def code_counts(keys: DataFrame) -> DataFrame:
    """sid, code, cnt from sid, key, cnt: codes are computed once for each distinct key."""
    codes = keys.select("key").distinct().withColumn("code", key_code("key"))
    return keys.join(codes, "key").where("code is not null").groupBy("sid", "code").agg(F.sum("cnt").alias("cnt"))


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """sid, v, members: for each stem the stems that are not serial to it, itself included, ascending."""
    e = edges.where("etype <> 's'").select("sid", "u", "v")
    both = e.unionAll(e.select("sid", F.col("v").alias("u"), F.col("u").alias("v")))
    loops = edges.select("sid", F.col("u").alias("v")).unionAll(edges.select("sid", "v")).distinct()
    both = both.unionAll(loops.select("sid", F.col("v").alias("u"), "v"))
    return both.groupBy("sid", F.col("u").alias("v")).agg(F.array_sort(F.collect_set(both["v"])).alias("members"))


def _pieces(near: dict[int, set[int]], limit: int) -> list[tuple[int, ...]]:
    """Candidate vertex sets of at most ``limit``: each stem with all that are linked to it; where these are too many, the
    stem with runs of them in order, so that each of its links lies in a piece."""
    out = []
    for v, around in near.items():
        others = sorted(around - {v})
        if len(others) < limit:
            out.append((v, *others))
        else:
            out += [(v, *others[i : i + limit - 1]) for i in range(0, len(others), limit - 1)]
    return out


def segments_of(near: dict[int, set[int]], limit: int) -> list[list[int]]:
    """Vertex sets of at most ``limit`` that cover all stems; near: each stem's neighbour set, itself included.

    Sets are numbers with a bit a stem.  A candidate is taken, the larger first (of equal ones that of the greater stem),
    while it has a stem that none before it has; pieces of sets beyond the limit only come after the whole ones.  Then, from
    the smallest on, a set is laid into all larger ones that it meets where the union stays within the limit; what fits
    nowhere is a segment."""
    bit = {v: 1 << i for i, v in enumerate(sorted(near))}
    ranked = sorted(((len(near[p[0]]) <= limit, len(p), p[0], sum(bit[w] for w in p)) for p in _pieces(near, limit)), reverse=True)
    covered, layers = 0, []
    for *_, mask in ranked:
        if mask & ~covered:
            covered |= mask
            layers.insert(0, mask)
    layers.sort(key=int.bit_count)  # stable: of equal sizes the one taken last comes first
    final = []
    for i, small in enumerate(layers):
        hosts = [j for j in range(i + 1, len(layers)) if layers[j] & small and (layers[j] | small).bit_count() <= limit]
        for j in hosts:
            layers[j] |= small
        if not hosts:
            final.append(small)
    return sorted([v for v, b in bit.items() if m & b] for m in final)


def connected_subsets(near: dict[int, set[int]], k: int):
    """Every connected k-vertex set of a graph once: extension only by vertices beyond the root that are not next to an earlier member."""

    def grow(members: tuple, border: set[int], reach: set[int], root: int):
        if len(members) == k:
            yield members
            return
        border = set(border)
        while border:
            w = border.pop()
            fresh = {x for x in near[w] if x > root and x not in reach}
            yield from grow((*members, w), border | fresh, reach | fresh, root)

    for root in near:
        first = {x for x in near[root] if x > root}
        yield from grow((root,), first, first | {root}, root)


def _labelled(members, types: dict) -> str:
    m = sorted(members)
    return "".join(types.get((a, b), ".") for i, a in enumerate(m) for b in m[i + 1 :])


def _packed(edges: DataFrame) -> DataFrame:
    """sid, edges: a row a structure, so that a batch holds many structures and a call to Python is not made for each."""
    return edges.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "etype"))).alias("edges"))


def _triple(edges) -> list[tuple[int, int, str]]:
    return [(x["u"], x["v"], x["etype"]) for x in edges]


def _graph(rows: list[tuple[int, int, str]]) -> tuple[dict[int, set[int]], dict[tuple[int, int], str]]:
    near: dict[int, set[int]] = {}
    types = {}
    for u, v, e in rows:
        if e in "ijo" and u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
            types[(u, v) if u < v else (v, u)] = e if u < v else {"i": "j", "j": "i"}.get(e, e)
    return near, types


def exhaustive_fingerprint(edges: DataFrame, k: int = 7, limit: int = 20) -> DataFrame:
    """sid, code, cnt of all connected subgraphs of max(3, min(segment - 1, k)) stems of each segment.

    Structures become segments of at most ``limit`` stems, a row each, so a large structure spreads over tasks; a task
    sends counts by labelled key, and codes are computed once for each distinct key.  Edges of x are no links.

    Every stem is in a segment.  Not counted: subgraphs whose stems are not together in one segment, which bounds the work
    for structures with more stems than ``limit``."""
    sid = edges.schema["sid"].dataType.simpleString()

    def split(source):
        for p in source:
            rows = []
            for name, edge in zip(p["sid"], p["edges"], strict=True):
                near, types = _graph(_triple(edge))
                for n, s in enumerate(segments_of({v: x | {v} for v, x in near.items()}, limit)):
                    inside = set(s)
                    rows.append((name, n, [{"u": a, "v": b, "etype": e} for (a, b), e in types.items() if a in inside and b in inside]))
            yield pd.DataFrame(rows, columns=["sid", "segment", "edges"])

    def count(source):
        for p in source:
            rows = []
            for name, edge in zip(p["sid"], p["edges"], strict=True):
                near, types = _graph(_triple(edge))
                size = max(3, min(len(near) - 1, k))
                rows += [(name, key, n) for key, n in Counter(_labelled(s, types) for s in connected_subsets(near, size)).items()]
            yield pd.DataFrame(rows, columns=["sid", "key", "cnt"])

    linked = edges.where("etype in ('i', 'j', 'o')").select("sid", "u", "v", "etype")
    parts = _packed(linked).mapInPandas(split, f"sid {sid}, segment int, edges array<struct<u:int,v:int,etype:string>>")
    keys = parts.repartition("sid", "segment").mapInPandas(count, f"sid {sid}, key string, cnt bigint")
    keys = keys.groupBy("sid", "key").agg(F.sum("cnt").alias("cnt"))
    return code_counts(keys)


def sampled_fingerprint(edges: DataFrame, k: int = 7, limit: int = 10_000, coverage: int = 3, seed: int = 1) -> DataFrame:
    """sid, code, cnt of randomly grown connected subgraphs of k stems (fewer where a part is smaller; at least 4).

    A sample starts at a random stem and takes random neighbours; a stem that excludes a chosen one (x) is out.  It ends
    after ``limit`` samples, or as soon as every motif seen has ``coverage`` counts.  Equal seeds give equal samples."""
    sid = edges.schema["sid"].dataType.simpleString()

    def one(name, rows: list[tuple[int, int, str]], codes: dict[str, str | None]) -> Counter:
        near, types = _graph(rows)
        vertices, counts = sorted(near), Counter()
        bit = {v: 1 << i for i, v in enumerate(vertices)}
        linked = [sum(bit[w] for w in near[v]) for v in vertices]
        barred = [0] * len(vertices)
        for u, v, e in rows:
            if e == "x" and u in bit and v in bit:
                barred[bit[u].bit_length() - 1] |= bit[v]
                barred[bit[v].bit_length() - 1] |= bit[u]
        draw = random.Random(f"{seed}:{name}").random
        border: dict[int, list[int]] = {}  # of a set of stems, those that may join it; sets come again and again
        code_of: dict[int, str | None] = {}
        for n in range(limit if vertices else 0):
            chosen, size = 1 << int(draw() * len(vertices)), 1
            while size < k:
                joins = border.get(chosen)
                if joins is None:
                    inside = [i for i in range(len(vertices)) if chosen >> i & 1]
                    free = functools.reduce(int.__or__, (linked[i] for i in inside)) & ~chosen & ~functools.reduce(int.__or__, (barred[i] for i in inside))
                    joins = border[chosen] = [1 << i for i in range(free.bit_length()) if free >> i & 1]
                if not joins:
                    break
                chosen |= joins[int(draw() * len(joins))]
                size += 1
            if size < 4:
                continue
            if chosen not in code_of:
                key = _labelled((v for v in vertices if chosen & bit[v]), types)
                if key not in codes:
                    codes[key] = code_of_key(key)
                code_of[chosen] = codes[key]
            if code_of[chosen] is not None:
                counts[code_of[chosen]] += 1
            if n % 100 == 99 and counts and min(counts.values()) >= coverage:
                break
        return counts

    def run(source):
        codes: dict[str, str | None] = {}
        for p in source:
            rows = [(name, c, n) for name, edge in zip(p["sid"], p["edges"], strict=True) for c, n in sorted(one(name, _triple(edge), codes).items())]
            yield pd.DataFrame(rows, columns=["sid", "code", "cnt"])

    return _packed(edges.where("etype <> 's'")).mapInPandas(run, f"sid {sid}, code string, cnt bigint")


def sampled_vertices(edges: DataFrame, k: int, count: int, *, weights: dict[str, float] | None = None, forbid_x: bool = True, seed: int = 1) -> DataFrame:
    """sid, sample, members (ascending): ``count`` grown vertex sets of up to k stems of each structure.

    ``weights`` give each edge type the odds with which a neighbour over it is taken (i, j and o alike by default; a type
    without a weight is no link); with ``forbid_x`` a stem that excludes a chosen one is out.  Equal seeds, equal rows."""
    sid = edges.schema["sid"].dataType.simpleString()
    odds = weights or {"i": 1.0, "j": 1.0, "o": 1.0}

    def run(p: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        barred: dict[int, set[int]] = {}
        for u, v, e in zip(p["u"].tolist(), p["v"].tolist(), p["etype"].tolist(), strict=True):
            if odds.get(e, 0) > 0:
                near.setdefault(u, []).append((v, odds[e]))
                near.setdefault(v, []).append((u, odds[e]))
            if e == "x" and forbid_x:
                barred.setdefault(u, set()).add(v)
                barred.setdefault(v, set()).add(u)
        rng = random.Random(f"{seed}:{p['sid'].iloc[0]}")
        vertices, rows = sorted(near), []
        for n in range(count if vertices else 0):
            chosen = {rng.choice(vertices)}
            out = set().union(*(barred.get(v, set()) for v in chosen))
            while len(chosen) < k:
                border: dict[int, float] = {}
                for v in sorted(chosen):
                    for w, x in near[v]:
                        if w not in chosen and w not in out:
                            border[w] = border.get(w, 0.0) + x
                if not border:
                    break
                names = sorted(border)
                w = rng.choices(names, [border[b] for b in names])[0]
                chosen.add(w)
                out |= barred.get(w, set())
            rows.append((p["sid"].iloc[0], n, sorted(chosen)))
        return pd.DataFrame(rows, columns=["sid", "sample", "members"])

    return edges.groupBy("sid").applyInPandas(run, f"sid {sid}, sample int, members array<int>")


def embeddings(edges: DataFrame, motif: list[tuple[int, int, str]]) -> DataFrame:
    """All injective placements of a motif's edges in each structure: sid, m0, m1, ..; one equality join for each motif edge."""
    e = _linked(edges)
    placed: list[int] = []
    out = None
    todo = list(motif)
    while todo:
        i = next((i for i, (a, b, _) in enumerate(todo) if out is None or a in placed or b in placed), None)
        if i is None:
            raise ValueError("the motif is not connected")
        a, b, t = todo.pop(i)
        side = e.where(F.col("e") == t).select("sid", F.col("u").alias(f"m{a}"), F.col("v").alias(f"m{b}"))
        known = [v for v in (a, b) if v in placed]
        out = side if out is None else out.join(side, ["sid", *(f"m{v}" for v in known)])
        for v in (a, b):
            if v not in placed:
                for w in placed:
                    out = out.where(F.col(f"m{v}") != F.col(f"m{w}"))
                placed.append(v)
    return out.select("sid", *(f"m{v}" for v in sorted(placed)))


def frequent_codes(counts: DataFrame, support: int) -> DataFrame:
    """code, support of the codes in at least ``support`` structures."""
    return counts.groupBy("code").agg(F.countDistinct("sid").alias("support")).where(F.col("support") >= support)


def _edge_codes(sets: DataFrame) -> DataFrame:
    """sets (edges: sorted array of u, v, e) with the code of each: vertices are renumbered in order, and a code is computed once for each distinct form."""
    order = F.array_sort(F.array_distinct(F.flatten(F.transform("edges", lambda x: F.array(x["u"], x["v"])))))
    at = lambda v: (F.array_position("_order", v) - 1).cast("string")
    form = F.array_join(F.transform("edges", lambda x: F.concat(at(x["u"]), x["e"], at(x["v"]))), " ")
    keyed = sets.withColumn("_order", order).withColumn("form", form).drop("_order")

    def run(source):
        for p in source:
            graphs = [[(int(a), int(b), e) for a, e, b in re.findall(r"(\d+)([ijo])(\d+)", f)] for f in p["form"]]
            yield pd.DataFrame({"form": p["form"], "code": [canonical_code(g) for g in graphs]})

    codes = keyed.select("form").distinct().mapInPandas(run, "form string, code string")
    return keyed.join(codes, "form").drop("form")


def grown_patterns(edges: DataFrame, support: int, max_edges: int = 3) -> DataFrame:
    """code, n_edges, support of all connected patterns of up to ``max_edges`` edges that are in at least ``support`` structures.

    Patterns grow by an edge: places of a frequent pattern are joined with the edges at their stems, and only those of
    patterns that are frequent again go on (a pattern is in no more structures than any part of it).  A place is a set of
    edges, so a pattern is any part of a structure, with or without the other edges between its stems."""
    from .clusters import checkpointed

    e = edges.where("etype in ('i', 'j', 'o')").select("sid", F.least("u", "v").cast("int").alias("u"), F.greatest("u", "v").cast("int").alias("v"), F.when(F.col("u") < F.col("v"), F.col("etype")).otherwise(F.translate("etype", "ij", "ji")).alias("e")).where("u <> v")
    one = F.struct("u", "v", "e")
    ends = e.select("sid", F.explode(F.array("u", "v")).alias("w"), one.alias("x"))
    now, out = e.select("sid", F.array(one).alias("edges")), None
    for n in range(1, max_edges + 1):
        coded = checkpointed(_edge_codes(now))
        good = coded.groupBy("code").agg(F.countDistinct("sid").alias("support")).where(F.col("support") >= support)
        found = good.select("code", F.lit(n).alias("n_edges"), "support")
        out = found if out is None else out.unionAll(found)
        if n < max_edges:
            places = coded.join(good.select("code"), "code", "left_semi").select("sid", "edges")
            more = places.withColumn("w", F.explode(F.array_distinct(F.flatten(F.transform("edges", lambda x: F.array(x["u"], x["v"])))))).join(ends, ["sid", "w"])
            now = more.where(~F.array_contains("edges", F.col("x"))).select("sid", F.array_sort(F.concat("edges", F.array("x"))).alias("edges")).distinct()
    return out


def extended_sets(sets: DataFrame) -> DataFrame:
    """sid, v, members: each neighbour set (as ``neighbour_sets``) with those of its greater members."""
    more = sets.select("sid", "v", F.explode("members").alias("u")).where("u > v").join(sets.select("sid", F.col("v").alias("u"), F.col("members").alias("others")), ["sid", "u"])
    union = sets.select("sid", "v", "members").unionAll(more.select("sid", "v", F.col("others").alias("members")))
    return union.select("sid", "v", F.explode("members").alias("m")).groupBy("sid", "v").agg(F.array_sort(F.collect_set("m")).alias("members"))


def common_members(sets: DataFrame) -> DataFrame:
    """sid, u < v, members: what the neighbour sets of two stems that are in each other's have in common."""
    pair = sets.select("sid", F.col("v").alias("u"), F.col("members").alias("a"), F.explode("members").alias("v")).where("u < v")
    return pair.join(sets.select("sid", "v", F.col("members").alias("b")), ["sid", "v"]).select("sid", "u", "v", F.array_sort(F.array_intersect("a", "b")).alias("members"))


def disjoint_sets(sets: DataFrame, most_common: int = 0) -> DataFrame:
    """The sets of each structure, the larger first and then in order of v, that have at most ``most_common`` members in common with every one kept before (order matters: one function a structure)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        rows = []
        for i in sorted(range(len(p)), key=lambda i: (-len(p["members"].iloc[i]), p["v"].iloc[i])):
            mine = set(p["members"].iloc[i])
            if all(len(mine & k) <= most_common for k in kept):
                kept.append(mine)
                rows.append(i)
        return p.iloc[sorted(rows)]

    return sets.groupBy("sid").applyInPandas(run, sets.schema)


def code_of_graph(edges: list[tuple[int, int, str]]) -> str | None:
    return canonical_code(edges)
