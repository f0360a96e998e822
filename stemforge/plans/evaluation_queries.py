"""Queries that measure accuracy against a reference, and ROC curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import relations as R
from ..operators import similarity as D
from . import bindings as B
from .registry import query, table

_OVERLAPS = f"""{B.TEST_SQL},
ov AS (SELECT r.sid, r.v AS r_v, t.v AS t_v,
  least(r.lend, t.lend) - greatest(r.lbegin, t.lbegin) + 1 + least(r.rend, t.rend) - greatest(r.rbegin, t.rbegin) + 1 AS "both",
  r.lend - r.lbegin + 1 + r.rend - r.rbegin + 1 AS rlen, t.lend - t.lbegin + 1 + t.rend - t.rbegin + 1 AS tlen,
  greatest(r.lend - r.lbegin, t.lend - t.lbegin) + 1 + greatest(r.rend - r.rbegin, t.rend - t.rbegin) + 1 AS maxlen
  FROM stems r JOIN test t ON t.sid = r.sid AND t.lbegin <= r.lend AND t.lend >= r.lbegin AND t.rbegin <= r.rend AND t.rend >= r.rbegin)"""


def rounded(d, *columns):
    return d.withColumns({c: F.round(c, 6) for c in columns})


def _overlaps(spark, sf):
    return R.stem_overlaps(B.stems(spark, sf), B.test_stems(spark, sf))


@query("stem_overlaps", f"WITH {_OVERLAPS}\nSELECT * FROM ov")
def stem_overlaps(spark, sf):
    return _overlaps(spark, sf)


@query(
    "stem_overlap_pr",
    f"""WITH {_OVERLAPS},
m AS (SELECT sid, count(DISTINCT r_v) AS tp_ref, count(DISTINCT t_v) AS tp_test FROM ov GROUP BY 1),
a AS (SELECT sid, count(*) AS n FROM stems GROUP BY 1), b AS (SELECT sid, count(*) AS n FROM test GROUP BY 1),
x AS (SELECT coalesce(a.sid, b.sid) AS sid, coalesce(a.n, 0) AS n_ref, coalesce(b.n, 0) AS n_test FROM a FULL JOIN b ON a.sid = b.sid)
SELECT x.sid, n_ref, n_test, coalesce(tp_ref, 0) AS tp_ref, coalesce(tp_test, 0) AS tp_test, round(coalesce(coalesce(tp_ref, 0) / nullif(n_ref, 0), 0), 6) AS recall,
  round(coalesce(coalesce(tp_test, 0) / nullif(n_test, 0), 0), 6) AS "precision", round(coalesce((coalesce(tp_ref, 0) + coalesce(tp_test, 0)) / nullif(n_ref + n_test, 0), 0), 6) AS jaccard
FROM x LEFT JOIN m ON m.sid = x.sid""",
)
def stem_overlap_pr(spark, sf):
    return rounded(V.stem_accuracy(B.stems(spark, sf), B.test_stems(spark, sf)), "recall", "precision", "jaccard")


@query(
    "best_match",
    f"""WITH {_OVERLAPS},
f AS (SELECT *, 2 * ("both" / rlen) * ("both" / tlen) / ("both" / rlen + "both" / tlen) AS f1, ("both" / rlen + "both" / tlen) / 2 AS f1_mean FROM ov)
SELECT sid, r_v, t_v, round(f1, 6) AS f1, round(f1_mean, 6) AS f1_mean FROM f QUALIFY row_number() OVER (PARTITION BY sid, r_v ORDER BY f1 DESC, t_v) = 1""",
)
def best_match(spark, sf):
    return rounded(R.best_matches(_overlaps(spark, sf)).select("sid", "r_v", "t_v", "f1", "f1_mean"), "f1", "f1_mean")


@query(
    "base_bits_pr",
    f"""WITH {B.TEST_SQL},
p AS (SELECT sid, unnest(list_distinct(list_concat(range(lbegin, lend + 1), range(rbegin, rend + 1)))) AS pos, 1 AS bit FROM stems
  UNION ALL SELECT sid, unnest(list_distinct(list_concat(range(lbegin, lend + 1), range(rbegin, rend + 1)))), 2 FROM test),
b AS (SELECT sid, pos, bit_or(bit) AS bits FROM p GROUP BY 1, 2),
n AS (SELECT sid, count(*) FILTER (WHERE bits & 1 = 1) AS n_ref, count(*) FILTER (WHERE bits & 2 = 2) AS n_test, count(*) FILTER (WHERE bits = 3) AS n_both FROM b GROUP BY 1),
r AS (SELECT *, coalesce(n_both / nullif(n_ref, 0), 0) AS recall, coalesce(n_both / nullif(n_test, 0), 0) AS "precision" FROM n)
SELECT sid, n_ref, n_test, n_both, round(recall, 6) AS recall, round("precision", 6) AS "precision", round((recall + "precision") / 2, 6) AS f1_mean,
  round(coalesce(2 * recall * "precision" / nullif(recall + "precision", 0), 0), 6) AS f1 FROM r""",
)
def base_bits_pr(spark, sf):
    return rounded(V.base_accuracy(V.base_bits(B.stems(spark, sf), B.test_stems(spark, sf))), "recall", "precision", "f1_mean", "f1")


@query(
    "pknot_recall",
    f"""WITH {_OVERLAPS},
o AS (SELECT a.sid, a.v AS u, b.v AS v FROM stems a JOIN stems b ON a.sid = b.sid AND a.v < b.v WHERE {B.EDGE_CASE} = 'o'),
h AS (SELECT DISTINCT sid, r_v FROM ov),
k AS (SELECT o.sid, CASE WHEN x.r_v IS NOT NULL AND y.r_v IS NOT NULL THEN 1 ELSE 0 END AS ok FROM o LEFT JOIN h x ON x.sid = o.sid AND x.r_v = o.u LEFT JOIN h y ON y.sid = o.sid AND y.r_v = o.v)
SELECT sid, count(*) AS n_pairs, CAST(sum(ok) AS BIGINT) AS n_found, round(avg(ok), 6) AS recall FROM k GROUP BY 1""",
)
def pknot_recall(spark, sf):
    return rounded(V.pseudoknot_recall(R.edges(B.stems(spark, sf)), _overlaps(spark, sf)), "recall")


_ACCURACY = f"""{_OVERLAPS},
m AS (SELECT sid, count(DISTINCT r_v) AS tp FROM ov GROUP BY 1), a AS (SELECT sid, count(*) AS n FROM stems GROUP BY 1),
q AS (SELECT a.sid, c_mktsegment AS segment, c_nationkey % 3 AS param, coalesce(tp, 0) / n AS recall FROM a LEFT JOIN m ON m.sid = a.sid JOIN customer ON c_custkey = a.sid)"""


def _accuracy(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("sid"), F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).alias("param"))
    return V.stem_accuracy(B.stems(spark, sf), B.test_stems(spark, sf)).where("n_ref > 0").join(c, "sid")


@query("report_by_family", f"WITH {_ACCURACY}\nSELECT param, coalesce(segment, 'all') AS segment, count(*) AS n, round(avg(recall), 6) AS recall FROM q GROUP BY GROUPING SETS ((param, segment), (param))")
def report_by_family(spark, sf):
    return rounded(V.report(_accuracy(spark, sf), ["param"], "segment", ["recall"]), "recall")


@query("best_parameters", f"WITH {_ACCURACY}\nSELECT param, round(avg(recall), 6) AS recall FROM q GROUP BY 1")
def best_parameters(spark, sf):
    return rounded(V.best_parameters(_accuracy(spark, sf), ["param"], "recall"), "recall")


@query("best_condition", f"WITH {_ACCURACY},\ng AS (SELECT segment, param, avg(recall) AS recall FROM q GROUP BY 1, 2)\nSELECT segment, param, round(recall, 6) AS recall FROM g QUALIFY row_number() OVER (PARTITION BY segment ORDER BY recall DESC, param) = 1")
def best_condition(spark, sf):
    return rounded(V.best_condition(_accuracy(spark, sf), "segment", "param", "recall"), "recall")


@query("replicate_stats", f"WITH {_ACCURACY}\nSELECT count(*) AS n, round(avg(recall), 6) AS mean, round(stddev_samp(recall), 6) AS stdev FROM q")
def replicate_stats(spark, sf):
    return rounded(V.replicate_stats(_accuracy(spark, sf), "recall"), "mean", "stdev")


_SCORED = f"{B.PAIRS_SQL},\nsc AS (SELECT round(jaccard, 6) AS score, x.s_nationkey = y.s_nationkey AS is_pos FROM sim JOIN supplier x ON x.s_suppkey = id1 JOIN supplier y ON y.s_suppkey = id2)"
_ROC = f"{_SCORED},\ng AS (SELECT score, count(*) FILTER (WHERE is_pos) AS pos, count(*) FILTER (WHERE NOT is_pos) AS neg FROM sc GROUP BY 1),\nr AS (SELECT *, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM g)"


def _scored(spark, sf):
    g = B.groups(spark, sf).select("id", F.col("nation").alias("grp"))
    return D.labelled(D.measures(B.motifs(spark, sf)), g).select(F.round("jaccard", 6).alias("score"), "is_pos")


@query("roc_points", f"WITH {_ROC}\nSELECT score, pos, neg, tp, fp FROM r")
def roc_points(spark, sf):
    return V.roc_points(_scored(spark, sf))


@query("roc_auc", f"WITH {_ROC}\nSELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum((tp - pos / 2) * neg) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM r")
def roc_auc(spark, sf):
    return rounded(V.roc_auc(_scored(spark, sf)), "auc")


@query(
    "missing_outputs",
    """SELECT p.p AS param, s.s_suppkey AS id FROM (VALUES (0), (1), (2)) p(p), supplier s
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_partkey % 50 = p.p)""",
)
def missing_outputs(spark, sf):
    want = table(spark, sf, "supplier").select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("param"), F.col("s_suppkey").alias("id"))
    found = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).cast("int").alias("param"), F.col("l_suppkey").alias("id")).distinct()
    return V.missing_outputs(want, found, ["param", "id"])
