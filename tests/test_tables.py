"""Fingerprints, similarity, clusters, evaluation, sources, streaming, workflows."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from stemforge.functions import canonical as C
from stemforge.operators import clusters as L
from stemforge.operators import evaluation as V
from stemforge.operators import fingerprints as P
from stemforge.operators import relations as R
from stemforge.operators import similarity as D
from stemforge.plans import workflow as W
from stemforge.sources import ct, tables
from stemforge.sources import structure_xml as xml
from stemforge.streaming import incremental as I  # noqa: E741

THREE = {1: {"dummy": 1, "dummier": 1, "dummiest": 5}, 2: {"dummier": 5, "x": 1, "y": 1}, 3: {"dummiest": 5, "x": 1, "dummy": 1}}


@pytest.fixture(scope="module")
def fp(spark):
    return spark.createDataFrame([(i, c, n) for i, m in THREE.items() for c, n in m.items()], "id long, code string, cnt long")


def test_measures(fp):
    got = {(r.id1, r.id2): r for r in D.measures(fp).collect()}
    assert [round(got[p].jaccard, 6) for p in ((1, 2), (1, 3), (2, 3))] == [0.2, 0.5, 0.2]
    assert [round(got[p].count_similarity * 14) for p in ((1, 2), (1, 3), (2, 3))] == [2, 12, 2]
    assert round(got[1, 3].overlap, 6) == round(2 / 3, 6) and round(got[1, 2].bray_curtis, 6) == round(1 - 2 / 6, 6)


def test_empty_sides(spark, fp):
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    got = {(r.id1, r.id2): (r.jaccard, r.bray_curtis) for r in D.all_pairs(ids, D.measures(fp)).collect()}
    assert got[1, 9] == got[2, 9] == (0.0, 1.0) and len(got) == 3


def test_multisets(fp):
    got = {r.id: r for r in P.totals(fp).collect()}
    assert got[1].total == 7 and got[1].mincount == 1 and got[1].minkey == "dummier" and got[2].n_motifs == 3
    assert P.totals(fp.where("id = 9")).count() == 0


def test_document_frequency(fp):
    g = fp.withColumn("grp", F.when(F.col("id") < 3, "a").otherwise("b"))
    got = {(r.grp, r.code): r.df for r in P.df_by_group(g).collect()}
    assert got["all", "dummiest"] == 2 and got["a", "dummiest"] == 1 and got["b", "x"] == 1 and got["all", "y"] == 1
    assert {(r.grp, r.n) for r in P.group_sizes(g).collect()} == {("a", 2), ("b", 1), ("all", 3)}
    p = {}
    for r in P.group_priors(g, least=0, most=10).collect():
        p[r.grp] = p.get(r.grp, 0) + r.p
    assert all(abs(v - 1) < 1e-9 for v in p.values())


def test_parents_and_membership(spark, fp):
    up = spark.createDataFrame([("dummiest", "top"), ("x", "top")], "code string, parent string")
    got = {(r.id, r.code): r.cnt for r in P.add_parents(fp, up).collect()}
    assert got[3, "top"] == 6 and got[1, "top"] == 5 and got[1, "dummiest"] == 5
    m = {r.code: r.side for r in P.membership(fp.where("id = 1"), fp.where("id = 3")).collect()}
    assert m == {"dummy": 3, "dummiest": 3, "dummier": 1, "x": 2}
    c = P.compare_sets(fp.where("id = 1"), fp.where("id = 3")).first()
    assert (c.n_both, c.n_a, c.n_b) == (2, 1, 1) and round(c.jaccard, 3) == 0.5


def test_matrices(fp):
    assert P.binary_matrix(fp).agg(F.sum("present"), F.count("*")).first()[:] == (9, 15)
    index = P.motif_index(fp)
    assert sorted((r.code, r.idx) for r in index.collect()) == [(c, i) for i, c in enumerate(sorted({c for m in THREE.values() for c in m}))]
    assert {r.n for r in P.bitmaps(fp, index).groupBy("id").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n")).collect()} == {3}


def test_entropy_and_divergence(spark):
    c = spark.createDataFrame([("a", "m", 2), ("b", "m", 2), ("a", "k", 4)], "grp string, code string, n long")
    assert {r.code: round(r.entropy, 6) for r in D.entropies(c).collect()} == {"m": 1.0, "k": 0.0}
    sizes = spark.createDataFrame([("a", 4), ("b", 4)], "grp string, size long")
    assert {(r.grp, r.code): round(r.entropy, 6) for r in D.binary_entropies(c, sizes).collect()} == {("a", "m"): 1.0, ("b", "m"): 1.0, ("a", "k"): 0.0}
    p = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 0.0), ("a", "k", 0.0), ("b", "k", 1.0)], "grp string, code string, p double")
    assert abs(D.group_divergence(p).first().jsd - math.log(2)) < 1e-9


def test_coverage(spark):
    r = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d")], "rank long, feature string")
    assert [tuple(x) for x in D.feature_coverage(r, 0.5).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_single_linkage(spark):
    rows = [(i, i + 1, 0.9) for i in range(0, 20)] + [(50, 51, 0.5), (52, 53, 0.9), (60, 61, 0.1)]
    got = {r.id: r.cluster for r in L.single_linkage(spark.createDataFrame(rows, "id1 long, id2 long, jaccard double"), 0.5).collect()}
    assert {got[i] for i in range(21)} == {0} and got[50] == 50 and got[51] == 51 and got[53] == 52 and got[61] == 61


def test_trees(spark):
    merges, text = L.wpgma(["a", "b", "c"], {("a", "b"): 0.2, ("a", "c"): 0.6, ("b", "c"): 0.8})
    assert text == "((a:0.1,b:0.1):0.25,c:0.35);" and [m[3] for m in merges] == [0.1, 0.35]
    assert L.wpgma(["a"], {})[1] == "a;" and L.wpgma([], {})[1] == ";"
    assert L.leaves(text) == ["a", "b", "c"] and L.indented(text).count("\n") >= 3
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (7, 8, 0.9)], "id1 long, id2 long, jaccard double")
    t = L.trees(L.cluster_pairs(pairs, L.single_linkage(pairs, 0.5))).orderBy("cluster").collect()
    assert [(r.cluster, r.n) for r in t] == [(1, 3), (7, 2)]


def test_fingerprint_tree(spark):
    """The tree of fingerprints equals the tree of their pairs as rows, by one and by several parts, and no join makes pairs."""
    kinds = [("1 one", 0), ("2 parts", 1000)]
    for _, apart in kinds:
        rows = [(i, c + apart * (i % 3), 1 + c % 4) for i in range(1, 60) for c in range(50) if (i * 7 + c * c) % 13 < 3]
        fp = spark.createDataFrame([*rows, (None, 1, 2), (70, None, 2), (71, -1, 2), (3, None, 1)], "id long, code long, cnt long")
        want = L.trees(D.to_distance(D.measures(fp)).withColumn("cluster", F.lit(1)))
        got = L.fingerprint_tree(fp)
        assert got.schema.simpleString() == want.schema.simpleString() and got.collect() == want.collect()
        assert "Join Inner, (code" not in got._jdf.queryExecution().toString()
    assert L.fingerprint_tree(fp.where("id is null or id > 69")).collect() == []


def test_every_pair(spark):
    """Pairs made in place equal those of the joins, in stripes of any width, and nothing is shuffled after the fingerprints are packed."""
    rows = [(i, c, 1 + (i * c) % 5) for i in range(1, 30) for c in range(40) if (i * 7 + c * c) % 11 < 3]
    fp = spark.createDataFrame([*rows, (None, 1, 2), (99, 1, 2)], "id long, code long, cnt long")
    ids = spark.createDataFrame([(i,) for i in [*range(1, 34), 5, None]], "id long")
    want = sorted(map(tuple, D.all_pairs(ids.distinct(), D.measures(fp)).collect()))
    for cells in (1, 70, 1 << 20):
        got = D.every_pair(ids, fp, cells=cells)
        assert sorted(map(tuple, got.collect())) == want
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()
    assert len(want) == 33 * 32 // 2 and D.every_pair(ids.limit(0), fp).count() == 0


def test_kmeans(spark):
    rows = [(i, [float(i % 2 * 10 + i * 0.01), 0.0]) for i in range(20)]
    got = {r.id: r.cluster for r in L.manhattan_kmeans(spark.createDataFrame(rows, "id long, x array<double>"), 2, seed=3).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == 1 and got[0] != got[1]
    c = spark.createDataFrame([(0, [1.0]), (1, [3.0])], "cluster int, c array<double>")
    best, _ = L.manhattan_step(spark.createDataFrame([(1, [2.0])], "id long, x array<double>"), c)
    assert best.first().cluster == 1  # the last of equal distances


def test_cooccurrence(spark):
    runs = spark.createDataFrame([(r, i, c) for r in (1, 2) for i, c in ((1, 0), (2, 0), (3, r))], "run int, id long, cluster int")
    assert {(r.id1, r.id2): r.together for r in L.cooccurrence(runs).collect()} == {(1, 2): 2}
    assert {r.id: r.cluster for r in L.consensus_clusters(runs, 1).collect()} == {1: 1, 2: 1}


def test_components_of_vectors(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    out = L.principal_components(spark.createDataFrame(rows, "id long, x array<double>"), 1)
    assert abs(out.agg(F.sum(F.get("pc", F.lit(0)))).first()[0]) < 1e-9
    assert L.top_loadings(spark.createDataFrame(rows, "id long, x array<double>"), ["a", "b", "c"], 1, 1)[0][0][0] == "b"


def test_roc(spark):
    data, label = [9, 8, 6, 6, 6, 6, 5, 4, 4, 2, 2], [1, 1, 1, 0, 1, 1, 0, 0, 1, 0, 0]
    s = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(data, label, strict=True)], "score double, is_pos boolean")
    want = sum((a > c) + (a == c) / 2 for a, b in zip(data, label, strict=True) if b for c, d in zip(data, label, strict=True) if not d) / (6 * 5)
    r = V.roc_auc(s).first()
    assert (r.n_pos, r.n_neg) == (6, 5) and abs(r.auc - want) < 1e-9
    assert V.roc_points(s).where("score = 6").first()[:] == (6.0, 3, 1, 5, 1)
    assert V.roc_auc(s.where("is_pos")).first().auc is None
    assert V.roc_auc(s.withColumn("score", F.lit(1.0))).first().auc == 0.5


def test_overlap_measures(spark):
    schema = "sid string, v int, lbegin int, lend int, rbegin int, rend int"
    ref = spark.createDataFrame([("s", 0, 1, 4, 20, 23), ("s", 1, 30, 33, 40, 43), ("t", 0, 1, 2, 5, 6)], schema)
    test = spark.createDataFrame([("s", 0, 2, 5, 19, 22), ("s", 1, 1, 1, 23, 23)], schema)
    b = R.best_matches(R.stem_overlaps(ref, test)).collect()
    assert [(r.r_v, r.t_v, r.both, r.f1) for r in b] == [(0, 0, 6, 0.75)]
    a = {r.sid: (r.n_ref, r.n_test, r.tp_ref, r.tp_test, r.recall) for r in V.stem_accuracy(ref, test).collect()}
    assert a == {"s": (2, 2, 1, 2, 0.5), "t": (1, 0, 0, 0, 0.0)}
    base = {r.sid: (r.n_ref, r.n_test, r.n_both) for r in V.base_accuracy(V.base_bits(ref, test)).collect()}
    assert base == {"s": (16, 10, 8), "t": (4, 0, 0)}


def test_corpus_edges_equal_the_stored_ones(spark, corpus):
    raw = xml.read_raw(spark, corpus["xios"]).cache()
    stems, stored = xml.stems(raw), xml.edges(raw)
    assert raw.count() == 206 and stems.count() == 3844 and stored.count() == 56317
    own = R.edges(stems.withColumnRenamed("structure_id", "sid"))
    same = own.join(stored.select(F.col("structure_id").alias("sid"), "u", "v", F.col("etype").alias("old")), ["sid", "u", "v"])
    assert same.where("etype = old").count() == 56317
    newer = R.edges(stems.withColumnRenamed("structure_id", "sid"), R.edge_type_minlen(3))
    assert newer.join(stored.select(F.col("structure_id").alias("sid"), "u", "v", F.col("etype").alias("old")), ["sid", "u", "v"]).where("etype = old").count() >= 56311


def test_structures_with_one_motif(spark, corpus):
    """Seven stems, all of them in the one motif that an older sampler found: both codes are of one graph."""
    raw = xml.read_raw(spark, corpus["xios"])
    seven = xml.stems(raw).groupBy("structure_id").count().where("count = 7").select("structure_id")
    old = tables.read_old_fingerprints(spark, corpus["xpt"])
    one = old.join(old.groupBy("structure_id").count().where("count = 1"), "structure_id").join(seven, "structure_id", "left_semi").select("structure_id", "code")
    graphs: dict[str, list] = {}
    for r in xml.edges(raw).join(one, "structure_id").where("etype in ('i', 'j', 'o')").collect():
        graphs.setdefault(r.structure_id, [r.code, []])[1].append((r.u, r.v, r.etype))
    parse = lambda c: [(int(a), int(b), t) for a, t, b in __import__("re").findall(r"(\d+)([ijo])(\d+)", c)]
    same = [C.canonical_code(e) == C.canonical_code(parse(code)) for code, e in graphs.values() if len({v for a, b, _ in e for v in (a, b)}) == 7 and len(e) == len(parse(code))]
    assert same and all(same)


def test_read_files(spark, corpus):
    info = xml.structures(xml.read_raw(spark, corpus["xios"]))
    assert info.where("sequence is not null and sequence <> ''").count() == 8
    fasta = tables.read_fasta(spark, corpus["fa"])
    assert fasta.count() == 206 and fasta.agg(F.min(F.length("sequence")), F.max(F.length("sequence"))).first()[:] == (68, 2411)
    fps = tables.read_fingerprints(spark, corpus["fpt"])
    assert fps.count() == 3966
    facts = tables.read_fingerprint_info(spark, corpus["fpt"]).collect()
    assert [r.value for r in facts if r.key == "total"] == ["50001"] * 8
    old = tables.read_old_fingerprints(spark, corpus["xpt"])
    assert old.select("structure_id").distinct().count() == 206
    assert abs(tables.read_old_headers(spark, corpus["xpt"]).agg(F.sum("time_elapsed")).first()[0] - 1389019) < 5
    d = tables.read_distances(spark, corpus["distance"])
    assert d.count() == 409 and d.agg(F.min("jaccard"), F.max("bray_curtis")).first()[0] >= 0


def test_read_ct(spark, corpus):
    b = ct.read(spark, corpus["ct"], strict=True).cache()
    h = ct.headers(b).groupBy("sid").agg(F.count("*").alias("n"), F.min("energy").alias("lo"), F.max("energy").alias("hi")).orderBy("n").collect()
    assert [tuple(r)[1:] for r in h] == [(1, None, None), (19, -49.3, -44.4)] and b.count() == 20 * 240
    assert ct.headers(ct.within_ddg(b, 4.0)).count() == 14 + 1 and ct.headers(ct.within_ddg(b, 1.75)).count() == 3 + 1
    assert {len(r.sequence) for r in ct.sequences(b).collect()} == {240}
    assert ct.stems(b).where("sid like '%:0'").count() > 5


def test_ct_round_trip(spark, tmp_path):
    text = "# note\n 4 ENERGY = -1.5 sq\n 1 A 0 2 4 1\n 2 C 1 3 0 2\n\n 3 G 2 4 0 3\n 4 U 3 0 1 4\n 4 ENERGY = -1.0 sq\n 1 A 0 2 0 1\n 2 C 1 3 0 2\n 3 G 2 4 0 3\n 4 U 3 0 0 4\n"
    (tmp_path / "a.ct").write_text(text)
    b = ct.read(spark, str(tmp_path / "a.ct"))
    out = ct.write(b).first()
    (tmp_path / "b.ct").write_text(out.text)
    key = lambda d: sorted(tuple(r)[1:] for r in d.collect())
    assert key(ct.read(spark, str(tmp_path / "b.ct"))) == key(b) and b.count() == 8
    (tmp_path / "bad.ct").write_text(text + "what is this\n")
    with pytest.raises(Exception, match="not a CT line"):
        ct.read(spark, str(tmp_path / "bad.ct"), strict=True).collect()


def test_structure_round_trip(spark, corpus, tmp_path):
    raw = xml.read_raw(spark, corpus["xios"]).where("structure_id < '5'")
    docs = xml.documents(xml.structures(raw), xml.stems(raw), xml.edges(raw))
    for r in docs.collect():
        (tmp_path / f"{r.structure_id}.xios").write_text(r.text)
    again = xml.read_raw(spark, f"{tmp_path}/*.xios")
    cols = ["structure_id", "v", "lbegin", "lend", "rbegin", "rend"]
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(xml.stems(again).select(cols)) == rows(xml.stems(raw).select(cols))
    assert rows(xml.edges(again)) == rows(xml.edges(raw))


def test_graphml(spark):
    e = spark.createDataFrame([("a", 0, 1, "i"), ("a", 0, 2, "s"), ("a", 1, 3, "o")], "structure_id string, u int, v int, etype string")
    text = xml.graphml(e).first().text
    assert text.count("<node ") == 3 and text.count("<edge ") == 2 and __import__("xml.dom.minidom", fromlist=["x"]).parseString(text)


def test_pair_lines(spark):
    d = spark.createDataFrame([("s", "# x\n 1 9\n2 8\nno\n")], "sid string, value string")
    assert sorted((r.pos, r.ppos) for r in ct.pairs_from_text(d).collect()) == [(1, 9), (2, 8)]


def test_fingerprint_round_trip(spark, tmp_path):
    fp = spark.createDataFrame([("a", "0i1.", 5), ("a", "0o1.", 7), ("b", "0i1.", 1)], "structure_id string, code string, cnt long")
    info = spark.createDataFrame([("a", "Date", "it's now")], "structure_id string, key string, value string")
    for r in tables.fingerprint_text(fp, info).collect():
        (tmp_path / f"{r.structure_id}.fpt").write_text(r.text)
    (tmp_path / "empty.fpt").write_text("")
    assert sorted(map(tuple, tables.read_fingerprints(spark, f"{tmp_path}/*.fpt").collect())) == sorted(map(tuple, fp.collect()))
    import yaml

    spec = yaml.safe_load((tmp_path / "a.fpt").read_text())[0]["fingerprint"]
    assert spec[0]["information"]["Date"] == "it's now" and spec[1]["total"] == 12 and list(spec[3]["motif"]) == ["0o1.", "0i1."]
    j = {r.structure_id: r.json for r in tables.fingerprint_json(fp).collect()}
    assert __import__("json").loads(j["a"]) == {"total": 12, "nmotif": 2, "motif": {"0i1.": 5, "0o1.": 7}}


def test_motif_files(spark, tmp_path):
    m = spark.createDataFrame([("0i1.", 2), ("0i1.0i2.", 3)], "code string, n_stems int")
    p = spark.createDataFrame([("0i1.0i2.", "0i1.")], "code string, parent string")
    tables.write_motif_table(m, p, str(tmp_path / "db"))
    assert tables.read_motif_table(spark, str(tmp_path / "db"))[0].count() == 2
    lines = tables.motif_json(m, p)
    m2, p2 = tables.motifs_from_json(lines)
    assert sorted(map(tuple, m2.collect())) == sorted(map(tuple, m.collect())) and p2.collect() == p.collect()
    with pytest.raises(Exception, match="checksum"):
        tables.motifs_from_json(lines.withColumn("value", F.replace("value", F.lit(":3"), F.lit(":4"))))[0].collect()
    tables.motif_list_lines(spark.createDataFrame([("0i1.", 4)], "code string, df long")).write.text(str(tmp_path / "l"))
    assert tables.read_motif_list(spark, str(tmp_path / "l")).first()[:] == ("0i1.", 4)
    (tmp_path / "diff.txt").write_text("head\nA motifs only\n0i1.  3\n0o1.\n\nB motifs only\nzz\n\n")
    assert [r.code for r in tables.read_only_list(spark, str(tmp_path / "diff.txt")).collect()] == ["0i1.", "0o1."]


def test_each_file_once(spark, tmp_path):
    schema = "id long, code string, cnt long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write([(1, "a", 2)])
    go = lambda: I.run(I.file_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/log")
    go()
    write([(2, "b", 3)])
    go()
    go()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    seen = []
    I.run_batches(I.file_stream(spark, f"{tmp_path}/in", schema), lambda b, n: seen.extend(r.id for r in b.collect()), f"{tmp_path}/log2")
    assert sorted(seen) == [1, 2]
    once = I.first_of_each(I.file_stream(spark, f"{tmp_path}/in", schema).select("code"), ["code"])
    assert I.collected(once, "once").count() == 2
    total = I.running_fingerprints(I.file_stream(spark, f"{tmp_path}/in", schema))
    assert I.collected(total, "total", "complete").count() == 2


def test_workflow(spark, tmp_path):
    calls = []
    work = lambda s, p: calls.append(p) or s.range(p["n"])
    w = lambda restart=False: W.Workflow(spark, [W.Stage("one", work, f"{tmp_path}/one", {"n": 3})], restart).run()
    assert [x[1] for x in (*w(), *w(), *w(True))] == ["ran", "skipped", "ran"] and len(calls) == 2
    assert W.versioned(spark, f"{tmp_path}/one") == f"{tmp_path}/one.1" and W.versioned(spark, f"{tmp_path}/new") == f"{tmp_path}/new"
    assert W.parse("definitions: {a: x, b: $a/y}\nstage: [$b/z]")["stage"] == ["x/y/z"]
    with pytest.raises(ValueError, match="circle"):
        W.expand("$a", {"a": "$b", "b": "$a"})
    assert W.fill("-t <T> <U>", {"T": 3}) == "-t 3 <U>"
    assert W.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6 and len(W.combinations({"a": ["1"], "b": ["2", "3"]})) == 2
    for n in "ab":
        (tmp_path / f"{n}.in").write_text("x")
    (tmp_path / "a.out").write_text("x")
    todo = W.pending(W.files(spark, f"{tmp_path}/*.in"), W.files(spark, f"{tmp_path}/*.out"), F.regexp_replace("path", r"\.in$", ".out"))
    assert [os.path.basename(r.path) for r in todo.collect()] == ["b.in"]
