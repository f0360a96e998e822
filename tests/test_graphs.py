"""Codes, notations, relations, stems, subgraphs and enumerations: literal examples, brute force, invariance."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from stemforge.functions import canonical as C
from stemforge.functions import codes as K
from stemforge.functions import names as N
from stemforge.functions import notation as T
from stemforge.operators import enumeration as E
from stemforge.operators import relations as R
from stemforge.operators import stems as S
from stemforge.operators import subgraphs as G


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(*xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<int>")


SHAPES = {
    "0i1.": [(0, 1, "i")],
    "0i1.1i2.2j0.": [(0, 1, "i"), (0, 2, "i"), (1, 2, "i")],
    "0o1.": [(0, 1, "o")],
    "0i1.0i2.": [(0, 1, "i"), (0, 2, "i")],
    "0i1.1i2.2j0.1i3.3j0.0i4.0i5.0i6.": K,
}


@pytest.mark.parametrize("code", [c for c, g in SHAPES.items() if g is not K])
def test_known_codes(code):
    assert C.canonical_code(SHAPES[code]) == code


def parse(code):
    import re

    return [(int(a), int(b), e) for a, e, b in re.findall(r"(\d+)([ijo])(\d+)", code)]


@pytest.mark.parametrize("code", ["0i1.1o2.2j0.0i3.0i4.", "0i1.1j2.2o0.2i3.3j0.2o4.", "0i1.0i2.0o3.3o4.", "0i1.1o2.2o0.0i3.0o4.", "0i1.1i2.2j0.2j3.3o0.3o1.3o4.", "0i1.1i2.2j0.2j3.3j0.3o1.3o4.4j0.", "0i1.1j2.2o0.2i3.3o0.2o4."])
def test_codes_of_the_old_tables_are_fixed_points(code):
    assert C.canonical_code(parse(code)) == code


@pytest.mark.parametrize("seed", range(30))
def test_code_is_invariant(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 8)
    edges = [(i, j, rng.choice("ijo")) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
    code = C.canonical_code(edges)
    for k in range(5):
        assert C.canonical_code(C.shuffled(edges, k)) == code if edges else True
    if code:
        assert C.canonical_code(parse(code)) == code
        assert len(parse(code)) == len(edges)


def certificate(n, types):
    inv = {"i": "j", "j": "i"}
    get = lambda a, b: types.get((a, b)) or inv.get(types.get((b, a)), types.get((b, a))) or "."
    return min("".join(get(p[a], p[b]) for a in range(n) for b in range(a + 1, n)) for p in itertools.permutations(range(n)))


def test_codes_part_graphs_like_permutations_do():
    n, pairs = 4, [(a, b) for a in range(4) for b in range(a + 1, 4)]
    seen, back = {}, {}
    for types in itertools.product("io.", repeat=len(pairs)):
        key = "".join(types)
        if C.connected_key(key):
            cert = certificate(n, {p: e for p, e in zip(pairs, types, strict=True) if e != "."})
            code = C.code_of_key(key)
            assert seen.setdefault(cert, code) == code and back.setdefault(code, cert) == cert


def test_all_o_triangle_in_every_order():
    assert {C.canonical_code(list(p)) for p in itertools.permutations([(0, 1, "o"), (1, 2, "o"), (0, 2, "o")])} == {"0o1.1o2.2o0."}


def test_no_code():
    assert C.canonical_code([]) is None and C.canonical_code([(0, 1, "x")]) is None
    assert C.canonical_code([(0, 1, "i"), (2, 3, "i")]) is None


def test_codecs(spark):
    code = "0i1.1i2.2j0.1i3.3j0.0i4.0i5.0i6."
    g = K.human_decode(F.lit(code))
    assert one(spark, K.human_encode(g)) == code and one(spark, K.code_vertices(F.lit(code))) == 7
    assert one(spark, K.decode_dfs(F.lit("0428412c61101418"))) == code
    assert one(spark, K.hex_encode(g)) == "0428412c61101418"
    wide = K.human_decode(F.lit("30o2.7s29.0j1."))
    for enc, dec in (K.hex2_encode, K.hex2_decode), (K.ascii_encode, K.ascii_decode):
        assert one(spark, K.human_encode(dec(enc(wide)))) == "30o2.7s29.0j1."
    assert one(spark, K.human_encode(g, 2)).startswith("00i01.") and one(spark, K.human_encode(K.hex_decode(F.lit("")))) == ""


@pytest.mark.parametrize("enc,text", [(K.hex_encode, "8i1."), (K.hex_encode, "0x1."), (K.hex2_encode, "128i1."), (K.ascii_encode, "31i1.")])
def test_codecs_refuse(spark, enc, text):
    with pytest.raises(Exception, match="beyond"):
        one(spark, enc(K.human_decode(F.lit(text))))


def test_edge_algebra(spark):
    g = K.human_decode(F.lit("5i9.9j5.2o5."))
    assert one(spark, K.human_encode(K.relabel(g))) == "0i1.1j0.2o0."
    assert one(spark, K.human_encode(K.flip_j(g))) == "5i9.5i9.2o5."
    assert one(spark, K.human_encode(F.transform(g, K.reverse_edge))) == "9j5.5i9.5o2."
    assert one(spark, K.human_encode(K.graph_from_text(F.lit("(0,1,0) (1,2,0) (2,0,1)")))) == "0i1.1i2.2j0."
    assert one(spark, K.human_encode(K.graph_from_text(F.lit("['a',13,'i'],[11,12,'i'],[12,'a','j']")))) == "0i1.2i3.3j0."
    assert [one(spark, K.reverse_type(F.lit(e))) for e in "ijosx"] == ["j", "i", "o", "s", "x"]
    assert one(spark, K.human_encode(K.graph_from_text(F.lit("")))) == ""


def test_serial_and_pairs(spark):
    s = lit(3, 2, 0, 2, 0, 3)
    assert one(spark, T.serial_canonical(s)) == [0, 1, 2, 1, 2, 0]
    assert one(spark, T.serial_to_pairs(s)) == [0, 5, 1, 3, 2, 4]
    assert one(spark, T.pairs_to_serial(T.serial_to_pairs(s))) == [0, 1, 2, 1, 2, 0]
    assert one(spark, T.pairs_canonical(lit(2, 3, 0, 4))) == [0, 3, 1, 2]
    assert one(spark, T.pairs_reverse(lit(0, 2, 1, 4, 3, 5))) == [0, 2, 1, 4, 3, 5]
    assert one(spark, T.pairs_duplicate(lit(0, 1))) == [0, 1, 2, 3]
    assert one(spark, T.pairs_depth(lit(0, 3, 1, 2))) == [1, 2, 2, 1]
    assert [one(spark, T.pairs_connected(lit(*p))) for p in ([0, 1, 2, 3], [0, 2, 1, 3], [0, 3, 1, 2])] == [False, True, True]
    assert one(spark, T.serial_connected(lit(0, 0, 1, 2, 1, 2))) == [[0, 0], [1, 2, 1, 2]]
    assert one(spark, T.serial_from_text(F.lit("1 2 2 3 3 4 4 1"))) == [1, 2, 2, 3, 3, 4, 4, 1]


def test_long_structures(spark):
    """Depths and edges of 120 stems against loops: what a lambda needs is made once and not for each element (minutes otherwise)."""
    rng = random.Random(5)
    serial = [i % 120 for i in range(240)]
    rng.shuffle(serial)
    ends = sorted((serial.index(s), 239 - serial[::-1].index(s)) for s in set(serial))
    df = spark.createDataFrame([(serial,)] * 50, "serial array<int>")
    p = T.serial_to_pairs(F.col("serial"))
    start = time.time()
    got = df.select(T.pairs_depth(p).alias("d"), T.pairs_to_graph(p).alias("e"), T.pairs_to_graph(p, True).alias("s")).distinct().collect()
    assert len(got) == 1 and time.time() - start < 60
    assert got[0].d == [sum(l <= c <= r for l, r in ends) for c in range(240)]  # noqa: E741
    kind = lambda a, b: "s" if a[1] < b[0] else "i" if a[1] > b[1] else "o"
    every = [(i, j, kind(ends[i], ends[j])) for i in range(120) for j in range(i + 1, 120)]
    assert [tuple(x) for x in got[0].s] == every and [tuple(x) for x in got[0].e] == [x for x in every if x[2] != "s"]


@pytest.mark.parametrize("pairs,code", [([0, 1, 2, 3], ""), ([0, 2, 1, 3], "0o1."), ([0, 3, 1, 2], "0i1."), ([0, 5, 1, 2, 3, 4], "0i1.0i2.")])
def test_pair_graphs(spark, pairs, code):
    assert one(spark, K.human_encode(T.pairs_to_graph(lit(*pairs)))) == code


@pytest.mark.parametrize("text", ["(())", "()(())", "([)]", "<([>])", "<[(>])", "([)(])", "..((..).)", ""])
def test_brackets(text):
    p = T.parse_brackets(text)
    again = T.write_brackets(p, len(text))
    assert T.parse_brackets(again) == p


def test_brackets_that_do_not_match():
    assert T.parse_brackets("(") is None and T.parse_brackets(")(") is None and T.parse_brackets(None) is None


def test_names(spark):
    assert one(spark, N.group_of(F.lit("rnasep_a1.Buchnera"))) == "rnasep" and one(spark, N.group_of(F.lit("5S.x"))) == "5S"
    assert one(spark, N.parameters(F.lit("a.w4.d5.xios"))) == {"w": 4, "d": 5}
    assert tuple(one(spark, N.folder_parameters(F.lit("x/p_290_50_3/y")))) == (290.0, 50.0, 3.0)
    assert one(spark, N.fixed_bases(F.lit("acgNx-u"))) == "ACGAAAU" and one(spark, N.bad_bases(F.lit("acgNx-u"))) == 3
    assert one(spark, N.wrapped(F.lit("abcdefg"), 3)) == "abc\ndef\ng" and one(spark, N.wrapped(F.lit("abcdef"), 3)) == "abc\ndef"
    assert one(spark, N.derived_name(F.lit("a/b.c.fa"), "out/", ".ct", w=4)) == "out/b.c.w4.ct"
    assert one(spark, N.divided(F.lit(1.0), F.lit(0.0))) == 0.0


def stems(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "sid string, v int, lbegin int, lend int, rbegin int, rend int")


def test_edge_types(spark):
    s = stems(spark, [(1, 3, 30, 32), (5, 7, 20, 22), (9, 11, 25, 27), (40, 42, 50, 52), (2, 4, 29, 31)])
    got = {(r.u, r.v): r.etype for r in R.edges(s).collect()}
    assert got[0, 1] == "i" and got[1, 2] == "o" and got[0, 3] == "s" and got[0, 4] == "x"
    both = {(r.u, r.v): r.etype for r in R.edges_both(s).collect()}
    assert both[1, 0] == "j" and both[2, 1] == "o" and all(both[k] == v for k, v in got.items() if k[1] != 4)
    assert R.edge_list(R.edges(s), "x").count() == sum(v == "x" for v in got.values())


def test_edge_types_minlen(spark):
    s = stems(spark, [(1, 8, 50, 57), (6, 13, 40, 47)])
    assert R.edges(s).first().etype == "x" and R.edges(s, R.edge_type_minlen(3)).first().etype == "i"
    assert R.edges(s, R.edge_type_minlen(6)).first().etype == "x"


def test_overlap_class(spark):
    keys = ["a1a2b1b2a3a4b3b4", "b1b2a1a2b3b4a3a4"]
    assert len({one(spark, R.overlap_class(F.lit(k))) for k in keys}) == 1


def pairs(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "sid string, pos int, ppos int")


def test_stems_from_pairs(spark):
    got = S.stems_from_pairs(pairs(spark, [(1, 30), (2, 29), (4, 28), (8, 27), (9, 26), (10, 26 + 5)])).orderBy("stem").collect()
    assert [(r.lbegin, r.lend, r.rbegin, r.rend, r.n_pairs, r.lvienna, r.rvienna) for r in got] == [(1, 4, 28, 30, 3, "((.(", ")))"), (8, 9, 26, 27, 2, "((", "))"), (10, 10, 31, 31, 1, "(", ")")]


def test_traced_stems(spark):
    rows = [(1, 30), (2, 29), (3, 28), (3, 27), (5, 26), (50, 60)]
    got = S.trace_stems(pairs(spark, rows), gap=3, minstem=3).collect()
    assert [(r.lbegin, r.lend, r.rbegin, r.rend, r.bp_n) for r in got] == [(1, 5, 26, 30, 4)]
    assert got[0].lvienna == "(((.(" and got[0].rvienna in (").)))", "))))." , ")).))", ").))" )


def test_energies_at_the_limit(spark):
    """The limit is the first energy and one number, not two added in turn."""
    mfe = [-i / 100 for i in range(0, 6000, 3)]
    rows = [(i, k, e) for i, m in enumerate(mfe) for k, e in enumerate((m, round(m + 40.01, 2)))]
    got = {(r.sid, r.struct_no) for r in S.energy_takewhile(spark.createDataFrame(rows, "sid long, struct_no long, energy double"), 40.0).collect()}
    assert got == {(i, k) for i, k, e in rows if not e > mfe[i] + 40.01}


def test_segments_and_mountain(spark):
    s = stems(spark, [(1, 2, 9, 10), (4, 4, 5, 5), (12, 13, 20, 21)])
    assert [(r.begin, r.end, r.n) for r in S.strict_segments(s).orderBy("segment").collect()] == [(1, 10, 2), (12, 21, 1)]
    assert {(r.pos, r.height) for r in S.mountain(s).collect()} == {(1, 1), (4, 2), (6, 1), (11, 0), (12, 1), (22, 0)}


def test_drop_contained(spark):
    s = stems(spark, [(1, 5, 20, 25), (2, 4, 21, 24), (1, 5, 20, 25), (30, 31, 40, 41)])
    assert sorted(r.v for r in S.drop_contained(s).collect()) == [0, 3]
    assert sorted(r.v for r in S.drop_contained_runs(s.withColumn("lvienna", F.lit("((("))).collect()) == [0, 3]


def test_merge(spark):
    got = S.merge_stems(stems(spark, [(1, 4, 40, 44), (3, 7, 37, 42), (60, 62, 70, 72)])).orderBy("v").collect()
    assert [tuple(r)[2:] for r in got] == [(1, 7, 37, 44), (60, 62, 70, 72)]


def random_edges(spark, n, seed, p=0.45):
    rng = random.Random(seed)
    rows = [("s", i, j, rng.choice("iosx")) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    return rows, spark.createDataFrame(rows, "sid string, u int, v int, etype string")


@pytest.mark.parametrize("k", [3, 4])
def test_subgraphs(spark, k):
    rows, e = random_edges(spark, 9, k)
    near = {}
    for _, a, b, t in rows:
        if t in "io":
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)

    def connected(s):
        seen, todo = {s[0]}, [s[0]]
        while todo:
            for w in near.get(todo.pop(), set()) & set(s) - seen:
                seen.add(w)
                todo.append(w)
        return len(seen) == len(s)

    want = {s for s in itertools.combinations(range(9), k) if connected(s)}
    got = (G.triples if k == 3 else G.quadruples)(e).collect()
    assert {tuple(r)[1:-1] for r in got} == want and len(got) == len(want)
    assert {tuple(sorted(s)) for s in G.connected_subsets(near, k)} == want
    types = {(a, b): t for _, a, b, t in rows if t in "io"}
    assert all(r.key == "".join(types.get(p, ".") for p in itertools.combinations(tuple(r)[1:-1], 2)) for r in got)


def test_exhaustive_equals_triples(spark):
    _, e = random_edges(spark, 8, 5)
    a = {(r.code, r.cnt) for r in G.exhaustive_fingerprint(e, k=3, limit=20).collect()}
    b = {(r.code, r.cnt) for r in G.code_counts(G.key_counts(G.triples(e))).collect()}
    assert a == b


def test_sampling_is_reproducible(spark):
    _, e = random_edges(spark, 10, 6)
    run = lambda seed: {(r.code, r.cnt) for r in G.sampled_fingerprint(e, k=4, limit=200, seed=seed).collect()}
    assert run(1) == run(1) and run(1) != run(2)
    assert {c for c, _ in run(1)} <= {r.code for r in G.exhaustive_fingerprint(e, k=4, limit=20).collect()}


def test_sampled_vertices(spark):
    rows, e = random_edges(spark, 10, 7)
    got = G.sampled_vertices(e, 4, 50, seed=4).collect()
    barred = {frozenset((a, b)) for _, a, b, t in rows if t == "x"}
    assert len(got) == 50 and all(len(set(r.members)) == len(r.members) <= 4 for r in got)
    assert not any(frozenset(p) in barred for r in got for p in itertools.combinations(r.members, 2))
    only_o = G.sampled_vertices(e, 3, 20, weights={"o": 1.0}, forbid_x=False, seed=4).collect()
    linked = {frozenset((a, b)) for _, a, b, t in rows if t == "o"}
    assert all(any(frozenset((v, w)) in linked for w in r.members if w != v) for r in only_o for v in r.members if len(r.members) > 1)


def test_containment(spark):
    s = stems(spark, [(1, 2, 50, 51), (5, 6, 40, 41), (10, 11, 20, 21), (25, 26, 30, 31), (60, 61, 70, 71)])
    assert {(r.parent, r.v) for r in R.containment_links(s).collect()} == {(0, 1), (1, 2), (1, 3)}
    assert {r.v: r.parent for r in R.containment_parents(s).collect()} == {0: None, 1: 0, 2: 1, 3: 1, 4: None}
    assert {(r.parent, r.children) for r in R.child_counts(R.containment_parents(s)).collect()} == {(None, 2), (0, 1), (1, 2)}
    assert R.containment_links(s, center=3).count() < 3


def test_brackets_to_stems(spark):
    d = spark.createDataFrame([("s", "((..((.)).)).."), ("t", "([)]"), ("u", "....")], "sid string, vienna string")
    got = {(r.sid, r.lbegin, r.lend, r.rbegin, r.rend) for r in S.stems_from_brackets(d).collect()}
    assert ("s", 1, 6, 8, 12) in got and {g[0] for g in got} == {"s", "t"}


def test_segment_sets():
    near = {i: {i, i + 1, max(0, i - 1)} for i in range(9)} | {9: {9, 8}}
    segs = G.segments_of(near, 5)
    assert set().union(*map(set, segs)) == set(near) and all(len(s) <= 5 for s in segs)
    # a stem linked to more than the limit: its links are dealt to pieces, and every stem is in a segment
    hub = {0: set(range(9))} | {i: {0, i} for i in range(1, 9)}
    segs = G.segments_of(hub, 5)
    assert set().union(*map(set, segs)) == set(hub) and all(len(s) <= 5 for s in segs)
    whole = {i: set(range(7)) for i in range(7)}
    segs = G.segments_of(whole, 4)
    assert set().union(*map(set, segs)) == set(whole) and all(len(s) <= 4 for s in segs)
    assert G.segments_of({}, 5) == []
    # the smallest set goes into every larger one that it meets within the limit
    assert G.segments_of({0: {0, 1, 2}, 1: {0, 1, 2}, 2: {0, 1, 2, 3}, 3: {2, 3, 4}, 4: {3, 4, 5}, 5: {4, 5}}, 4)


def test_embeddings(spark):
    e = spark.createDataFrame([("s", 0, 1, "i"), ("s", 0, 2, "i"), ("s", 1, 2, "o"), ("s", 2, 3, "o")], "sid string, u int, v int, etype string")
    got = {(r.m0, r.m1, r.m2) for r in G.embeddings(e, [(0, 1, "i"), (1, 2, "o")]).collect()}
    assert got == {(0, 1, 2), (0, 2, 1), (0, 2, 3)}


def test_pairings(spark):
    n = {r.stems: r["count"] for r in E.pairings(spark, 5).groupBy("stems").count().collect()}
    assert n == {1: 1, 2: 2, 3: 10, 4: 74, 5: 706}


def test_motif_table(spark):
    motifs, parents = E.motif_table(spark, 3)
    m = {r.code: r.n_stems for r in motifs.collect()}
    assert {c for c, n in m.items() if n == 2} == {"0i1.", "0o1."}
    p = {(r.code, r.parent) for r in parents.collect()}
    assert ("0i1.1i2.2j0.", "0i1.") in p and all(b in m for _, b in p)
    assert [r.total for r in E.level_counts(motifs).orderBy("n_stems").collect()][0] == 2


def test_ancestors(spark):
    p = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "a")], "code string, parent string")
    assert {(r.code, r.parent) for r in E.ancestors(p).collect()} == {("d", "c"), ("d", "b"), ("d", "a"), ("c", "b"), ("c", "a"), ("b", "a"), ("x", "a")}


def test_growth(spark):
    n = {r.stems: r["count"] for r in E.grow_structures(spark, 3).groupBy("stems").count().collect()}
    assert n[1] == 1 and n[2] == 3 and n[3] == 11  # all matchings of 4 and 6 points, one of each mirror pair
    one_ = spark.sql("select array(0, 0) as serial")
    assert E.add_stem_all(one_).count() == 3 and E.add_stem_zero(one_).count() == 3
    assert E.add_stem_left(one_).count() >= 2


def test_random_structures(spark):
    a = E.random_structures(spark, 50, 4, seed=2)
    assert a.collect() == E.random_structures(spark, 50, 4, seed=2).collect()
    assert all(sorted(r.pairs) == list(range(8)) for r in a.collect())


def test_registered_fingerprints_are_whole(spark, sf, monkeypatch):
    """The registered fingerprints have the operators' own sizes and limits."""
    import inspect

    from stemforge.plans import graph_queries

    asked = []
    for name in ("exhaustive_fingerprint", "sampled_fingerprint"):
        f = getattr(G, name)
        monkeypatch.setattr(graph_queries.G, name, lambda edges, f=f, **how: asked.append((f.__name__, how, inspect.signature(f))))
        getattr(graph_queries, name)(spark, sf)
    assert [n for n, _, _ in asked] == ["exhaustive_fingerprint", "sampled_fingerprint"]
    assert all(how[x] == own.parameters[x].default for _, how, own in asked for x in ("k", "limit"))


def test_queries_without_sql_take_whole_tables(spark, sf, monkeypatch):
    """Trees of more than 30 structures, all embeddings, structures of more than 12 stems."""
    from stemforge.plans import fingerprint_queries, function_queries

    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert max(ids) >= 200 and {r.id for r in fingerprint_queries.consensus_clusters(spark, sf).collect()} == ids
    motifs = spark.createDataFrame([(i, i % 7 + j, 1) for i in range(1, 41) for j in range(7)], "id long, code long, cnt long")
    monkeypatch.setattr(fingerprint_queries.B, "motifs", lambda *_: motifs)
    assert [r.n for r in fingerprint_queries.wpgma_tree(spark, sf).collect()] == [40]
    serial = [x for i in range(1, 15) for x in (i, i)]
    monkeypatch.setattr(function_queries, "serials", lambda *_: spark.createDataFrame([(1, serial)], "sid long, serial array<int>"))
    assert [(r.sid, r.same) for r in function_queries.brackets_round_trip(spark, sf).collect()] == [(1, True)]
