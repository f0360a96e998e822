"""Queries that write the driver's tables in the library's file formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import enumeration as E
from ..operators import fingerprints as P
from ..operators import relations as R
from ..operators import similarity as D
from ..operators import stems as S
from ..sources import ct, structure_xml, tables
from . import bindings as B
from .registry import query, table


def _structures(spark, sf):
    """Structure documents of all customers, parsed again."""
    s = B.stems(spark, sf)
    size = lambda h: (F.col(f"{h}end") - F.col(f"{h}begin") + 1).cast("int")
    names = s.select(F.col("sid").cast("string").alias("structure_id"), F.col("v").cast("int").alias("v"), *(F.col(c).cast("int").alias(c) for c in R.HALF), F.repeat(F.lit("("), size("l")).alias("lvienna"), F.repeat(F.lit(")"), size("r")).alias("rvienna"))
    e = R.edges(s).select(F.col("sid").cast("string").alias("structure_id"), F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "etype")
    header = names.select("structure_id").distinct().select("structure_id", F.concat(F.lit("seq <"), "structure_id").alias("sequence_id"), F.lit("a & b").alias("doc"), F.lit("ACGU").alias("sequence"), F.array(F.lit("made here")).alias("comments"))
    return structure_xml.raw_from_text(structure_xml.documents(header, names, e))


@query(
    "structure_stems",
    f"""WITH {B.STEMS_SQL}
SELECT CAST(sid AS VARCHAR) AS structure_id, CAST(v AS INTEGER) AS v, CAST(v AS VARCHAR) AS name, round((lbegin + rend) / 2, 1) AS center, CAST(lbegin AS INTEGER) AS lbegin, CAST(lend AS INTEGER) AS lend,
  CAST(rbegin AS INTEGER) AS rbegin, CAST(rend AS INTEGER) AS rend, repeat('(', lend - lbegin + 1) AS lvienna, repeat(')', rend - rbegin + 1) AS rvienna FROM stems""",
)
def structure_stems(spark, sf):
    return structure_xml.stems(_structures(spark, sf))


@query(
    "structure_edges",
    f"""WITH {B.EDGES_SQL}
SELECT CAST(sid AS VARCHAR) AS structure_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, etype FROM edges""",
)
def structure_edges(spark, sf):
    return structure_xml.edges(_structures(spark, sf))


@query(
    "structure_headers",
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS structure_id, '2.2' AS version, 'seq <' || o_custkey AS sequence_id, 'a & b' AS doc, 'ACGU' AS sequence, 'made here' AS comment FROM orders",
)
def structure_headers(spark, sf):
    return structure_xml.structures(_structures(spark, sf)).withColumn("comment", F.array_join("comments", "|")).drop("comments")


@query(
    "graphml_edges",
    f"""WITH {B.IJO_SQL}
SELECT CAST(sid AS VARCHAR) AS structure_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, etype FROM ijo""",
)
def graphml_edges(spark, sf):
    """GraphML of all structures, its edges read again."""
    e = R.edges(B.stems(spark, sf)).select(F.col("sid").cast("string").alias("structure_id"), "u", "v", "etype")
    rx = r'<edge source="n(\d+)" target="n(\d+)"><data key="t">(.)</data></edge>'
    rows = structure_xml.graphml(e).select("structure_id", F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("x"))
    return rows.select("structure_id", F.regexp_extract("x", rx, 1).cast("int").alias("u"), F.regexp_extract("x", rx, 2).cast("int").alias("v"), F.regexp_extract("x", rx, 3).alias("etype"))


_CT = """
ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events),
ct AS (SELECT CAST(user_id AS VARCHAR) AS file, CAST((n - 1) // 4 AS INTEGER) AS struct_no, CAST((n - 1) % 4 + 1 AS INTEGER) AS pos, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 5 - ((n - 1) % 4 + 1) END AS INTEGER) AS ppos, user_id FROM ev)"""


def _ct(spark, sf):
    """Bases of a small CT file a user, four a structure, written and parsed."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select("user_id", "event_id", n.alias("n"))
    pos = F.pmod(F.col("n") - 1, F.lit(4)) + 1
    struct_no = F.floor((F.col("n") - 1) / 4).cast("int")
    bases = e.select(
        F.col("user_id").cast("string").alias("file"), struct_no.alias("struct_no"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("seq_id"), F.lit(4).alias("seq_len"), (struct_no / 2 - 10).cast("double").alias("energy"),
        pos.cast("int").alias("pos"), F.element_at(F.array(*(F.lit(c) for c in "ACGU")), pos.cast("int")).alias("base"), (pos - 1).cast("int").alias("prev"), F.pmod(pos + 1, F.lit(5)).cast("int").alias("next"),
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(5 - pos).cast("int").alias("ppos"),
    )
    return ct.parse(ct.write(bases).select("file", F.concat(F.lit("# comment\n"), "text", F.lit("\n\n")).alias("value")), strict=True)


@query("ct_bases", f"WITH {_CT}\nSELECT file, struct_no, 's' || user_id AS seq_id, 4 AS seq_len, struct_no / 2 - 10 AS energy, pos, substr('ACGU', pos, 1) AS base, pos - 1 AS prev, (pos + 1) % 5 AS \"next\", ppos FROM ct")
def ct_bases(spark, sf):
    return _ct(spark, sf)


@query("ct_within_ddg", f"WITH {_CT}\nSELECT file AS sid, struct_no, max(struct_no / 2 - 10) AS energy, 4 AS seq_len FROM ct WHERE struct_no <= 4 GROUP BY 1, 2")
def ct_within_ddg(spark, sf):
    return ct.headers(ct.within_ddg(_ct(spark, sf), 2.0))


@query("unpaired_histogram", f"WITH {_CT}\nSELECT file AS sid, pos, ppos, count(*) AS cnt FROM ct GROUP BY 1, 2, 3")
def unpaired_histogram(spark, sf):
    """Pair counts of all structures of a file, unpaired bases (0) counted too."""
    return S.pair_histogram(_ct(spark, sf).withColumnRenamed("file", "sid"), unpaired=True)


_LETTERS = "regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')"


@query("fasta_records", f"SELECT doc_id || '' AS id, 'from ' || coalesce(source, '?') AS doc, md5({_LETTERS}) AS md5, len({_LETTERS}) AS n FROM documents")
def fasta_records(spark, sf):
    """Letters of every document as FASTA, wrapped and read again."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("from "), F.coalesce("source", F.lit("?"))).alias("doc"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("sequence"))
    got = tables.parse_fasta(tables.fasta_text(d).select(F.lit("all.fa").alias("file"), F.col("text").alias("value")))
    return got.select("id", "doc", F.md5("sequence").alias("md5"), F.length("sequence").cast("long").alias("n"))


def _fingerprints(spark, sf):
    """YAML fingerprints of all suppliers as whole texts."""
    fp = B.motifs(spark, sf).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("structure_id"), F.concat(F.lit("0i"), F.col("code").cast("string"), F.lit(".")).alias("code"), "cnt")
    info = fp.select("structure_id").distinct().select("structure_id", F.lit("File").alias("key"), F.concat(F.lit("it's "), "structure_id").alias("value"))
    return tables.fingerprint_text(fp, info).select(F.concat("structure_id", F.lit(".fpt")).alias("file"), F.col("text").alias("value"))


@query("fingerprint_files", f"WITH {B.MOTIFS_SQL}\nSELECT 's' || id AS structure_id, '0i' || code || '.' AS code, cnt FROM fp")
def fingerprint_files(spark, sf):
    return tables.parse_fingerprints(_fingerprints(spark, sf))


@query("fingerprint_totals_in_files", f"WITH {B.MOTIFS_SQL}\nSELECT 's' || id AS structure_id, unnest(['total', 'nmotif']) AS key, CAST(unnest([sum(cnt), count(*)]) AS VARCHAR) AS value FROM fp GROUP BY id")
def fingerprint_totals_in_files(spark, sf):
    return tables.parse_fingerprint_info(_fingerprints(spark, sf)).where("key in ('total', 'nmotif')")


@query("distance_files", f"WITH {B.PAIRS_SQL}\nSELECT 'g' || id1 % 7 || '.' || id1 AS id1, 'g' || id2 % 7 || '.' || id2 AS id2, CAST(printf('%.3f', jaccard) AS DOUBLE) AS jaccard, CAST(printf('%.3f', bray_curtis) AS DOUBLE) AS bray_curtis, sim.id1 % 7 = sim.id2 % 7 AS is_pos FROM sim")
def distance_files(spark, sf):
    """Distances of all suppliers with a common motif, written with three decimals and read again; a family is the remainder by 7."""
    name = lambda c: F.concat(F.lit("g"), (F.col(c) % 7).cast("string"), F.lit("."), F.col(c).cast("string")).alias(c)
    return tables.parse_distances(tables.distance_lines(D.measures(B.motifs(spark, sf)).select(name("id1"), name("id2"), "jaccard", "bray_curtis")))


@query("motif_list_files", f"WITH {B.MOTIFS_SQL}\nSELECT 'm' || code AS code, count(DISTINCT id) AS df FROM fp GROUP BY 1")
def motif_list_files(spark, sf):
    d = P.select_min_max(B.motifs(spark, sf), 1, 1 << 30).select(F.concat(F.lit("m"), F.col("code").cast("string")).alias("code"), "df")
    return tables.parse_motif_list(tables.motif_list_lines(d))


@query("motif_json_lines", "SELECT p_brand AS code, CAST(min(p_size) AS INTEGER) AS n_stems, count(DISTINCT p_type) AS parents FROM part GROUP BY 1")
def motif_json_lines(spark, sf):
    """Brands as motifs with their types as parents, through JSON lines with checksums."""
    p = table(spark, sf, "part")
    motifs, parents = tables.motifs_from_json(tables.motif_json(p.groupBy(F.col("p_brand").alias("code")).agg(F.min("p_size").cast("int").alias("n_stems")), p.select(F.col("p_brand").alias("code"), F.col("p_type").alias("parent")).distinct()))
    return motifs.join(parents.groupBy("code").agg(F.count(F.lit(1)).alias("parents")), "code")


@query("only_lists", "SELECT DISTINCT 'r' || l_suppkey || '.txt' AS file, 'm' || l_partkey AS code FROM lineitem")
def only_lists(spark, sf):
    """The second list of a report of two, a report each supplier."""
    rows = B.motifs(spark, sf).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  m"), F.col("code").cast("string"), F.lit("  x")))), "\n").alias("rows"))
    text = F.concat(F.lit("# report\nmotifs only in a\n  z1\n\nMotifs only in b\n"), "rows", F.lit("\n\n  after\n"))
    return tables.parse_only_list(rows.select(F.concat(F.lit("r"), F.col("id").cast("string"), F.lit(".txt")).alias("file"), text.alias("value")), 2)


@query("file_matches", "SELECT r.c_custkey AS ref, t.o_orderkey AS test FROM orders t JOIN customer r ON r.c_custkey = t.o_custkey")
def file_matches(spark, sf):
    """Test files matched with the reference of their base name."""
    from ..operators.evaluation import paired

    ref = table(spark, sf, "customer").select(F.concat(F.lit("/ref/c"), F.col("c_custkey").cast("string"), F.lit(".xios")).alias("path"))
    test = table(spark, sf, "orders").select(F.concat(F.lit("/test/"), F.col("o_orderkey").cast("string"), F.lit("/c"), F.col("o_custkey").cast("string"), F.lit(".xios")).alias("path"))
    both, _ = paired(ref, test, N.base_name(F.col("path")))
    return both.select(F.regexp_extract("ref_path", r"c(\d+)\.", 1).cast("long").alias("ref"), F.regexp_extract("test_path", r"test/(\d+)/", 1).cast("long").alias("test"))


@query("distances_of_similarities", f"WITH {B.PAIRS_SQL}\nSELECT id1, id2, round(1 - overlap, 6) AS distance FROM sim")
def distances_of_similarities(spark, sf):
    return D.to_distance(D.measures(B.motifs(spark, sf)), 1.0, "overlap").withColumn("distance", F.round("distance", 6))


@query("ancestor_pairs", "WITH RECURSIVE up AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS code, p_brand AS parent FROM part UNION SELECT DISTINCT p_brand, p_type FROM part), anc AS (SELECT code, parent FROM up UNION SELECT anc.code, up.parent FROM anc JOIN up ON up.code = anc.parent) SELECT code, count(*) AS n FROM anc GROUP BY 1")
def ancestor_pairs(spark, sf):
    p = table(spark, sf, "part")
    up = p.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_brand").alias("parent")).union(p.select("p_brand", "p_type")).distinct()
    return E.ancestors(up).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
