"""The driver's tables seen as structures, stems, motifs and pairs; each binding as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import table

# -- stems: a structure for each customer, a stem for each order --------------------------------------------------

STEMS_SQL = """
s0 AS (SELECT o_custkey AS sid, o_orderkey AS ok, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS lb,
  2 + o_orderkey % 4 AS w, 1 + CAST(floor(o_totalprice) AS BIGINT) % 400 AS g FROM orders),
stems AS (SELECT sid, ok, row_number() OVER (PARTITION BY sid ORDER BY lb, lb + w - 1 + g, ok) - 1 AS v,
  lb AS lbegin, lb + w - 1 AS lend, lb + w - 1 + g AS rbegin, lb + 2 * w - 2 + g AS rend FROM s0)"""
EDGE_CASE = """CASE WHEN a.rend < b.lbegin THEN 's' WHEN a.lend < b.lbegin AND a.rbegin > b.lend AND a.rend < b.rbegin THEN 'o'
  WHEN a.lend < b.lbegin AND a.rbegin > b.rend THEN 'i' ELSE 'x' END"""
EDGES_SQL = f"{STEMS_SQL},\nedges AS (SELECT a.sid, a.v AS u, b.v AS v, {EDGE_CASE} AS etype FROM stems a JOIN stems b ON a.sid = b.sid AND a.v < b.v)"
IJO_SQL = f"{EDGES_SQL},\nijo AS (SELECT * FROM edges WHERE etype IN ('i', 'j', 'o'))"


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    o = o.select(
        F.col("o_custkey").alias("sid"),
        F.col("o_orderkey").alias("ok"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long").alias("lb"),
        (2 + F.col("o_orderkey") % 4).alias("w"),
        (1 + F.floor("o_totalprice").cast("long") % 400).alias("g"),
    )
    o = o.select("sid", "ok", F.col("lb").alias("lbegin"), (F.col("lb") + F.col("w") - 1).alias("lend"), (F.col("lb") + F.col("w") - 1 + F.col("g")).alias("rbegin"), (F.col("lb") + 2 * F.col("w") - 2 + F.col("g")).alias("rend"))
    v = F.row_number().over(Window.partitionBy("sid").orderBy("lbegin", "rbegin", "ok")) - 1
    return o.withColumn("v", v.cast("long"))


# -- a test set of stems: most reference stems, moved ----------------------------------------------------------------

TEST_SQL = f"""{STEMS_SQL},
test AS (SELECT sid, ok, v, lbegin + ok % 11 - 5 AS lbegin, lend + ok % 11 - 5 AS lend, rbegin + ok % 7 - 3 AS rbegin, rend + ok % 7 - 3 AS rend
  FROM stems WHERE ok % 5 <> 0)"""


def test_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = F.col("ok") % 11 - 5, F.col("ok") % 7 - 3
    s = stems(spark, sf_dir).where("ok % 5 <> 0")
    return s.select("sid", "ok", "v", (F.col("lbegin") + left).alias("lbegin"), (F.col("lend") + left).alias("lend"), (F.col("rbegin") + right).alias("rbegin"), (F.col("rend") + right).alias("rend"))


# -- motif multisets: a structure for each supplier, a motif for each part ----------------------------------------------

MOTIFS_SQL = """
fp AS (SELECT l_suppkey AS id, l_partkey AS code, count(*) AS cnt FROM lineitem GROUP BY 1, 2)"""
GROUPED_SQL = f"""{MOTIFS_SQL},
grp AS (SELECT s_suppkey AS id, CAST(n_regionkey AS VARCHAR) AS grp, s_nationkey AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey),
gfp AS (SELECT fp.id, grp.grp, code, cnt FROM fp JOIN grp USING (id))"""


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("code")).agg(F.count(F.lit(1)).alias("cnt"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp (region), nation of each supplier."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("grp"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("id"), "grp", F.col("s_nationkey").alias("nation"))


def grouped_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs(spark, sf_dir).join(groups(spark, sf_dir).select("id", "grp"), "id").select("id", "grp", "code", "cnt")


# -- base pairs --------------------------------------------------------------------------------------------------------

HISTOGRAM_SQL = """
pairs AS (SELECT l_suppkey % 2 AS sid, l_suppkey % 50 + 1 AS pos, 110 - l_partkey % 50 AS ppos FROM lineitem)"""


def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 2).alias("sid"), (F.col("l_suppkey") % 50 + 1).alias("pos"), (110 - F.col("l_partkey") % 50).alias("ppos"))


SEQUENCE_SQL = """
seq AS (SELECT user_id AS sid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type <> 'error'),
bp AS (SELECT sid, pos, 400 - pos - CASE WHEN event_id % 7 = 0 THEN 5 ELSE event_id % 3 END AS ppos FROM seq)"""


def pair_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = e.select(F.col("user_id").alias("sid"), "event_id", pos.alias("pos"))
    return e.select("sid", "pos", (400 - F.col("pos") - F.when(F.col("event_id") % 7 == 0, 5).otherwise(F.col("event_id") % 3)).alias("ppos"))


# -- similarities of suppliers ---------------------------------------------------------------------------------------

PAIRS_SQL = f"""{MOTIFS_SQL},
size AS (SELECT id, count(*) AS n, sum(cnt) AS s FROM fp GROUP BY 1),
shr AS (SELECT a.id AS id1, b.id AS id2, count(*) AS n_both, sum(least(a.cnt, b.cnt)) AS min_sum FROM fp a JOIN fp b ON a.code = b.code AND a.id < b.id GROUP BY 1, 2),
sim AS (SELECT id1, id2, n_both / (x.n + y.n - n_both) AS jaccard, n_both / least(x.n, y.n) AS overlap,
  2 * min_sum / (x.s + y.s) AS count_similarity, 1 - 2 * n_both / (x.n + y.n) AS bray_curtis
  FROM shr JOIN size x ON x.id = id1 JOIN size y ON y.id = id2)"""
