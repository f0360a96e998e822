"""Readers and writers on small files of their own."""

from __future__ import annotations

import pytest

from stemforge.operators import relations as R
from stemforge.sources import ct, structure_xml, tables

STRUCTURE = """<XIOS version='{version}'>
  <information>
    <sequence>
      <id>
      seq.1
      </id>
      <doc>
      a &lt;b&gt; &amp; c
      </doc>
      <unformatted>
      ACGU
      ACG
      </unformatted>
    </sequence>
    <comment_list>
      <comment>
      first
      </comment>
      <comment> second </comment>
    </comment_list>
  </information>
  <stem_list>
   0   21.0  [  1  4  38  41 ]   ((((  ))))
   1   15.5  [  6  8  23  25 ]   (((  )))

   2   31.0  [ 10 12  50  52 ]
  </stem_list>
  <edge_list>
    0:  1i  2o
  </edge_list>
  <adjacency>
       0  1  2
    0  {d}  i  o
    1  j  {d}  o
    2  o  o  {d}
  </adjacency>
</XIOS>
"""


@pytest.mark.parametrize("version,diagonal", [("2.1", "0"), ("2.0", "-"), ("1.59.2.7", "0")])
def test_structures(spark, tmp_path, version, diagonal):
    (tmp_path / "tRNA.one.xios").write_text(STRUCTURE.format(version=version, d=diagonal))
    raw = structure_xml.read_raw(spark, f"{tmp_path}/*.xios")
    head = structure_xml.structures(raw).first()
    assert tuple(head) == ("tRNA.one", version, "seq.1", "a <b> & c", "ACGUACG", ["first", "second"])
    got = [tuple(r)[1:] for r in structure_xml.stems(raw).orderBy("v").collect()]
    assert got == [(0, "0", 21.0, 1, 4, 38, 41, "((((", "))))"), (1, "1", 15.5, 6, 8, 23, 25, "(((", ")))"), (2, "2", 31.0, 10, 12, 50, 52, None, None)]
    stored = {(r.u, r.v): r.etype for r in structure_xml.edges(raw).collect()}
    own = {(r.u, r.v): r.etype for r in R.edges(structure_xml.stems(raw).withColumnRenamed("structure_id", "sid")).collect()}
    assert stored == own == {(0, 1): "i", (0, 2): "o", (1, 2): "o"}


def test_structures_are_written_as_read(spark, tmp_path):
    (tmp_path / "a.xios").write_text(STRUCTURE.format(version="2.2", d="0"))
    raw = structure_xml.read_raw(spark, f"{tmp_path}/a.xios")
    text = structure_xml.documents(structure_xml.structures(raw), structure_xml.stems(raw), structure_xml.edges(raw)).first().text
    (tmp_path / "b.xios").write_text(text)
    again = structure_xml.read_raw(spark, f"{tmp_path}/b.xios")
    key = lambda d: sorted((tuple(r)[1:] for r in d.collect()), key=str)
    for part in (structure_xml.edges, structure_xml.structures):
        assert key(part(again)) == key(part(raw))
    assert [r[3:9] for r in key(structure_xml.stems(again))][0][:4] == [r[3:9] for r in key(structure_xml.stems(raw))][0][:4]


OLD = """<?xml version="1.0"?>
<XIOS_fingerprint>
    <query><query_id>/x/tRNA.a.xios</query_id><query_vertex>4</query_vertex><query_edge>5</query_edge></query>
    <fingerprint><type>random</type><iteration>500000</iteration><program>sampler</program><time_elapsed>246.5</time_elapsed></fingerprint>
    <database><database_id>db</database_id></database>
    <motif_list>
        <motif_n>2</motif_n>
        <motif><id>3_7</id><count>31</count><first_observed>23</first_observed><encoded_dfs>042841</encoded_dfs><mapping>1</mapping></motif>
        <motif><id>3_8</id><count>7</count><first_observed>24</first_observed><encoded_dfs>0428</encoded_dfs><mapping>1</mapping></motif>
        <motif><id>3_8</id><count>9</count><first_observed>30</first_observed><encoded_dfs>0428</encoded_dfs><mapping>1</mapping></motif>
    </motif_list>
</XIOS_fingerprint>
"""


def test_old_fingerprints(spark, tmp_path):
    (tmp_path / "tRNA.a.xios.xpt").write_text(OLD)
    got = sorted(tuple(r) for r in tables.read_old_fingerprints(spark, f"{tmp_path}/*.xpt").collect())
    assert got == [("tRNA.a", "0i1.1i2.", 9), ("tRNA.a", "0i1.1i2.2j0.", 31)]
    h = tables.read_old_headers(spark, f"{tmp_path}/*.xpt").first()
    assert (h.structure_id, h.query_vertex, h.query_edge, h.iteration, h.program, h.time_elapsed, h.motif_n) == ("tRNA.a", 4, 5, 500000, "sampler", 246.5, 2)


YAML = """- fingerprint:
  - information:
      Date: '2022-05-06 09:31:08'
      File: ./a.fpt
  - total: 14
  - nmotif: 2
  - motif:
      0i1.1i2.2j0.: 9
      0i1.1o2.: 5
"""


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.fpt").write_text(YAML)
    (tmp_path / "none.fpt").write_text("- fingerprint:\n  - information: {}\n  - total: 0\n  - nmotif: 0\n  - motif:\n")
    got = sorted(tuple(r) for r in tables.read_fingerprints(spark, f"{tmp_path}/*.fpt").collect())
    assert got == [("a", "0i1.1i2.2j0.", 9), ("a", "0i1.1o2.", 5)]
    facts = {(r.structure_id, r.key): r.value for r in tables.read_fingerprint_info(spark, f"{tmp_path}/*.fpt").collect()}
    assert facts["a", "total"] == "14" and facts["a", "Date"] == "2022-05-06 09:31:08" and facts["none", "nmotif"] == "0"


def test_distances(spark, tmp_path):
    (tmp_path / "d.distance").write_text("fpt1    fpt2    jaccard bray-curtis\n# note\ntRNA.a.fpt   tmRNA.b.fpt     0.019   0.986\ntRNA.a.fpt\ttRNA.c.fpt\t1.000\t0.971\n")
    got = sorted(tuple(r) for r in tables.read_distances(spark, str(tmp_path / "d.distance")).collect())
    assert got == [("tRNA.a.fpt", "tRNA.c.fpt", 1.0, 0.971, True), ("tRNA.a.fpt", "tmRNA.b.fpt", 0.019, 0.986, False)]


def test_decimals_are_those_of_the_binary_value(spark):
    from pyspark.sql import functions as F

    xs = [a / b for b in range(1, 500) for a in range(0, b + 1, 1 + b // 40)] + [0.0225, 0.0075, 0.0625, 0.1875, 0.0005, 1e-300, 1 / 3, 123456.0625, 7e8 + 0.0625, 1e15, -0.0625, -0.0225]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tables.three_decimals(F.col("x")).alias("t")).collect()
    assert len(got) == len(xs) and not [r for r in got if r.t != f"{r.x:.3f}"]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first doc\nACG\nU\n>two\nacgn\n\n")
    assert [tuple(r) for r in tables.read_fasta(spark, f"{tmp_path}/*.fa").orderBy("id").collect()] == [("x.fa", "one", "first doc", "ACGU"), ("x.fa", "two", "", "acgn")]


CT = "    6  ENERGY = -5.0    s\n" + "".join(f"{i:5d} {b} {i - 1:7d} {(i + 1) % 7:4d} {p:4d} {i:4d}\n" for i, b, p in zip(range(1, 7), "ACGUAC", (6, 5, 0, 0, 2, 1), strict=True))


def test_structures_of_a_ct_file(spark, tmp_path):
    """The loop over energy limits: structures of a file to stems and edges at each limit."""
    (tmp_path / "a.ct").write_text(CT + CT.replace("-5.0", "-4.0") + "# comment\n\n" + CT.replace("-5.0", "-1.0"))
    (tmp_path / "p.ct").write_text("    6  plain\n" + CT.split("\n", 1)[1])
    bases = ct.read(spark, f"{tmp_path}/*.ct", strict=True)
    assert {(r.sid, r.struct_no, r.energy) for r in ct.headers(bases).collect()} == {("a", 0, -5.0), ("a", 1, -4.0), ("a", 2, -1.0), ("p", 0, None)}
    assert {r.sid: r.sequence for r in ct.sequences(bases).collect()} == {"a": "ACGUAC", "p": "ACGUAC"}
    stems, edges = ct.stems_and_edges(bases, [0.5, 2.0, 9.0], minbp=2)
    assert sorted({(r.ddg, r.sid) for r in stems.collect()}) == [(0.5, "a:0"), (0.5, "p:0"), (2.0, "a:0"), (2.0, "a:1"), (2.0, "p:0"), (9.0, "a:0"), (9.0, "a:1"), (9.0, "a:2"), (9.0, "p:0")]
    assert {(r.lbegin, r.lend, r.rbegin, r.rend) for r in stems.collect()} == {(1, 2, 5, 6)} and edges.count() == 0
    with pytest.raises(Exception, match="not a CT line"):
        ct.parse(spark.createDataFrame([("b", "what is this\n")], "file string, value string"), strict=True).collect()


def test_edges_at_each_energy_limit(spark):
    lines = [(1, 30), (2, 29), (3, 28), (10, 20), (11, 19), (12, 18)]
    pair = {a: b for x, y in lines for a, b in ((x, y), (y, x))}
    rows = [("f", 0, "s", 30, -3.0, i, "A", i - 1, i + 1, pair.get(i, 0)) for i in range(1, 31)]
    bases = spark.createDataFrame(rows, "file string, struct_no int, seq_id string, seq_len int, energy double, pos int, base string, prev int, next int, ppos int")
    stems, edges = ct.stems_and_edges(bases, [1.0], minbp=3)
    assert stems.count() == 2 and [tuple(r) for r in edges.collect()] == [(1.0, "f:0", 0, 1, "i")]


def test_lists_of_several_reports(spark, tmp_path):
    (tmp_path / "r1.txt").write_text("Motifs only in a\n  m1 3\n  m2 4\n\nx\nmotifs only in b\n  m3\n")
    (tmp_path / "r2.txt").write_text("motifs only in a\n\nmotifs only in b\n  m4\n\n  m5\n")
    got = lambda block: sorted(tuple(r) for r in tables.read_only_list(spark, f"{tmp_path}/*.txt", block).collect())
    assert got(1) == [("r1.txt", "m1"), ("r1.txt", "m2")] and got(2) == [("r1.txt", "m3"), ("r2.txt", "m4")]
