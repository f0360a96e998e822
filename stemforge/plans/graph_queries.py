"""Queries over stems, edges and subgraphs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions.canonical import code_of_key, connected_key
from ..operators import relations as R
from ..operators import stems as S
from ..operators import subgraphs as G
from . import bindings as B
from .registry import ORACLES, query, table


def count(d, *keys):
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("stem_edges", f"WITH {B.EDGES_SQL}\nSELECT sid, u, v, etype FROM edges WHERE etype <> 's'")
def stem_edges(spark, sf):
    return R.linked_edges(B.stems(spark, sf))


@query("edge_type_totals", f"WITH {B.EDGES_SQL}\nSELECT etype, count(*) AS n FROM edges GROUP BY 1")
def edge_type_totals(spark, sf):
    return R.edge_totals(R.edges(B.stems(spark, sf)))


@query("edge_list_ijo", f"WITH {B.EDGES_SQL}\nSELECT sid, u, v, etype FROM edges WHERE etype IN ('i', 'j', 'o')")
def edge_list_ijo(spark, sf):
    return R.edge_list(R.linked_edges(B.stems(spark, sf)))


@query("pseudoknots", f"WITH {B.EDGES_SQL}\nSELECT sid, u, v, etype FROM edges WHERE etype = 'o'")
def pseudoknots(spark, sf):
    return R.pseudoknots(R.linked_edges(B.stems(spark, sf)))


@query(
    "edges_both_directions",
    f"""WITH {B.EDGES_SQL},
shr AS (SELECT sid, u, v, etype FROM edges UNION ALL SELECT sid, v, u, CASE etype WHEN 'i' THEN 'j' ELSE etype END FROM edges)
SELECT etype, count(*) AS n, CAST(sum(u) AS BIGINT) AS sum_u FROM shr GROUP BY 1""",
)
def edges_both_directions(spark, sf):
    return R.edges_both(B.stems(spark, sf)).groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"))


_HALVES = "[{'b': a.lbegin, 'n': '1il', 'e': a.lend}, {'b': a.rbegin, 'n': '2ir', 'e': a.rend}, {'b': b.lbegin, 'n': '3jl', 'e': b.lend}, {'b': b.rbegin, 'n': '4jr', 'e': b.rend}]"
_CLASH = " OR ".join(f"(h[{j}].b < h[{i}].e AND (h[{j}].b - h[{i}].b < 3 OR h[{j}].e - h[{i}].e < 3))" for i in range(1, 5) for j in range(i + 1, 5))


@query(
    "edges_minlen_v22",
    f"""WITH {B.STEMS_SQL},
p AS (SELECT a.sid, a.v AS u, b.v AS v, a.rend < b.lbegin AS serial, list_sort({_HALVES}) AS h FROM stems a JOIN stems b ON a.sid = b.sid AND a.v < b.v),
t AS (SELECT sid, u, v, CASE WHEN serial THEN 's' WHEN {_CLASH} THEN 'x'
  ELSE CASE h[1].n[2:] || h[2].n[2:] || h[3].n[2:] || h[4].n[2:] WHEN 'iljlirjr' THEN 'o' WHEN 'iljljrir' THEN 'i' WHEN 'ilirjljr' THEN 's' ELSE 'x' END END AS etype FROM p)
SELECT sid, u, v, etype FROM t WHERE etype <> 's'""",
)
def edges_minlen_v22(spark, sf):
    return R.linked_edges(B.stems(spark, sf), R.edge_type_minlen(3))


_POINTS = ", ".join(f"{{'x': {t}.{c}, 'n': '{t}{i}'}}" for t in "ab" for i, c in enumerate(R.HALF, 1))


@query(
    "overlap_order_key",
    f"""WITH {B.STEMS_SQL}
SELECT array_to_string(list_transform(list_sort([{_POINTS}]), lambda h: h.n), '') AS key, count(*) AS n
FROM stems a JOIN stems b ON a.sid = b.sid AND a.v < b.v GROUP BY 1""",
)
def overlap_order_key(spark, sf):
    return count(R.pairs_of_stems(B.stems(spark, sf)).select(R.overlap_order().alias("key")), "key")


_K = "regexp_extract_all(key, '[ab][1-4]')"
_FORMS = [f"array_to_string(list_transform({'list_reverse(' + _K + ')' if back else _K}, lambda t: translate(translate(t, 'ab', '{w}'), '1234', '{e}')), '')" for w, e, back in (("ab", "1234", False), ("ba", "1234", False), ("ab", "4321", True), ("ba", "4321", True))]


@query(
    "overlap_classes",
    f"""WITH {B.STEMS_SQL},
k AS (SELECT array_to_string(list_transform(list_sort([{_POINTS}]), lambda h: h.n), '') AS key FROM stems a JOIN stems b ON a.sid = b.sid AND a.v < b.v),
c AS (SELECT key, count(*) AS n FROM k GROUP BY 1)
SELECT least({', '.join(_FORMS)}) AS class, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
)
def overlap_classes(spark, sf):
    keys = overlap_order_key(spark, sf)
    return keys.groupBy(R.overlap_class(F.col("key")).alias("class")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))


_TRIPLES_SQL = f"""{B.IJO_SQL},
t AS (SELECT a.sid, a.v AS a, b.v AS b, c.v AS c, coalesce(x.etype, '.') || coalesce(y.etype, '.') || coalesce(z.etype, '.') AS key
  FROM stems a JOIN stems b ON a.sid = b.sid AND a.v < b.v JOIN stems c ON a.sid = c.sid AND b.v < c.v
  LEFT JOIN ijo x ON x.sid = a.sid AND x.u = a.v AND x.v = b.v LEFT JOIN ijo y ON y.sid = a.sid AND y.u = a.v AND y.v = c.v
  LEFT JOIN ijo z ON z.sid = a.sid AND z.u = b.v AND z.v = c.v
  WHERE (x.etype IS NOT NULL)::INT + (y.etype IS NOT NULL)::INT + (z.etype IS NOT NULL)::INT >= 2)"""


def _triples(spark, sf):
    return G.triples(R.linked_edges(B.stems(spark, sf)))


@query("subgraph3_keys", f"WITH {_TRIPLES_SQL}\nSELECT key, count(*) AS n, count(DISTINCT sid) AS structures FROM t GROUP BY 1")
def subgraph3_keys(spark, sf):
    return _triples(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("structures"))


@query("fingerprint3", f"WITH {_TRIPLES_SQL}\nSELECT sid, key, count(*) AS cnt FROM t GROUP BY 1, 2")
def fingerprint3(spark, sf):
    return G.key_counts(_triples(spark, sf))


def _code_values(n: int) -> str:
    keys = ["".join(k) for k in product("ijo.", repeat=n * (n - 1) // 2)]
    return ", ".join(f"('{k}', '{code_of_key(k)}')" for k in keys if connected_key(k))


@query("fingerprint3_codes", f"WITH {_TRIPLES_SQL},\ncodes(key, code) AS (VALUES {_code_values(3)})\nSELECT sid, code, count(*) AS cnt FROM t JOIN codes USING (key) GROUP BY 1, 2")
def fingerprint3_codes(spark, sf):
    return G.code_counts(G.key_counts(_triples(spark, sf)))


@query("frequent_codes", f"WITH {_TRIPLES_SQL},\ncodes(key, code) AS (VALUES {_code_values(3)})\nSELECT code, count(DISTINCT sid) AS support FROM t JOIN codes USING (key) GROUP BY 1 HAVING count(DISTINCT sid) >= 20")
def frequent_codes(spark, sf):
    return G.frequent_codes(fingerprint3_codes(spark, sf), 20)


@query(
    "subgraph4_counts",
    f"""WITH {B.IJO_SQL},
near AS (SELECT sid, u, v FROM ijo UNION ALL SELECT sid, v, u FROM ijo),
two AS (SELECT DISTINCT x.sid, list_sort([x.u, x.v, y.v]) AS s FROM near x JOIN near y ON x.sid = y.sid AND x.u = y.u AND x.v < y.v),
four AS (SELECT DISTINCT t.sid, list_sort(list_append(t.s, n.v)) AS s FROM (SELECT sid, s, unnest(s) AS u FROM two) t JOIN near n ON n.sid = t.sid AND n.u = t.u WHERE NOT list_contains(t.s, n.v)),
k AS (SELECT q.sid, q.s, string_agg(coalesce(e.etype, '.'), '' ORDER BY i, j) AS key
  FROM (SELECT sid, s, i, j FROM four, (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) p(i, j)) q
  LEFT JOIN ijo e ON e.sid = q.sid AND e.u = q.s[q.i] AND e.v = q.s[q.j] GROUP BY q.sid, q.s)
SELECT key, count(*) AS n FROM k GROUP BY 1""",
)
def subgraph4_counts(spark, sf):
    return count(G.quadruples(R.linked_edges(B.stems(spark, sf))), "key")


@query(
    "vset_sizes",
    f"""WITH {B.EDGES_SQL},
n AS (SELECT sid, u, v FROM edges WHERE etype <> 's' UNION ALL SELECT sid, v, u FROM edges WHERE etype <> 's' UNION SELECT sid, u, u FROM edges UNION SELECT sid, v, v FROM edges)
SELECT sid, u AS v, count(DISTINCT n.v) AS n FROM n GROUP BY 1, 2""",
)
def vset_sizes(spark, sf):
    return G.neighbour_sets(R.edges(B.stems(spark, sf))).select("sid", "v", F.size("members").cast("long").alias("n"))


_NEAR = f"""{B.EDGES_SQL},
n AS (SELECT sid, u, v FROM edges WHERE etype <> 's' UNION SELECT sid, v, u FROM edges WHERE etype <> 's' UNION SELECT sid, u, u FROM edges UNION SELECT sid, v, v FROM edges)"""


def _near(spark, sf):
    return G.neighbour_sets(R.edges(B.stems(spark, sf)))


def _joined(d, *keys):
    return d.select(*keys, F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(
    "vset_extended",
    f"""WITH {_NEAR},
x AS (SELECT sid, u AS v, v AS m FROM n UNION SELECT a.sid, a.u, b.v FROM n a JOIN n b ON b.sid = a.sid AND b.u = a.v AND a.v > a.u)
SELECT sid, v, string_agg(m, ',' ORDER BY m) AS members FROM x GROUP BY 1, 2""",
)
def vset_extended(spark, sf):
    return _joined(G.extended_sets(_near(spark, sf)), "sid", "v")


@query(
    "vset_common",
    f"""WITH {_NEAR}
SELECT a.sid, a.u, a.v, string_agg(x.v, ',' ORDER BY x.v) AS members FROM n a JOIN n x ON x.sid = a.sid AND x.u = a.u JOIN n y ON y.sid = a.sid AND y.u = a.v AND y.v = x.v WHERE a.u < a.v GROUP BY 1, 2, 3""",
)
def vset_common(spark, sf):
    return _joined(G.common_members(_near(spark, sf)), "sid", "u", "v")


@query(
    "vset_disjoint",
    f"""WITH RECURSIVE {_NEAR.strip()},
o AS (SELECT sid, v, m, row_number() OVER (PARTITION BY sid ORDER BY len(m) DESC, v) AS k FROM (SELECT sid, u AS v, list(v ORDER BY v) AS m FROM n GROUP BY 1, 2)),
r AS (SELECT sid, k, v, m, true AS ok, m AS taken FROM o WHERE k = 1
  UNION ALL SELECT sid, k, v, m, good, CASE WHEN good THEN list_concat(taken, m) ELSE taken END FROM (SELECT o.sid, o.k, o.v, o.m, r.taken, len(list_intersect(r.taken, o.m)) = 0 AS good FROM r JOIN o ON o.sid = r.sid AND o.k = r.k + 1))
SELECT sid, v, array_to_string(m, ',') AS members FROM r WHERE ok""",
)
def vset_disjoint(spark, sf):
    return _joined(G.disjoint_sets(_near(spark, sf)), "sid", "v")


_SHAPES = ", ".join(f"('{a}{b}', '{G.code_of_graph([(0, 1, a), (0, 2, b)])}')" for a, b in ("ii", "ij", "io", "jj", "jo", "oo"))


@query(
    "grown_patterns",
    f"""WITH {B.IJO_SQL},
l AS (SELECT sid, u, v, etype AS e FROM ijo UNION ALL SELECT sid, v, u, translate(etype, 'ij', 'ji') FROM ijo),
shapes(key, code) AS (VALUES {_SHAPES}),
p AS (SELECT 1 AS n_edges, CASE etype WHEN 'o' THEN '0o1.' ELSE '0i1.' END AS code, sid FROM ijo
  UNION ALL SELECT 2, code, x.sid FROM l x JOIN l y ON x.sid = y.sid AND x.u = y.u AND x.v < y.v JOIN shapes ON key = least(x.e || y.e, y.e || x.e))
SELECT code, n_edges, count(DISTINCT sid) AS support FROM p GROUP BY 1, 2 HAVING count(DISTINCT sid) >= 20""",
)
def grown_patterns(spark, sf):
    return G.grown_patterns(R.linked_edges(B.stems(spark, sf)), 20, 2)


@query(
    "induced_edges",
    f"""WITH {B.IJO_SQL}
SELECT sid, u, v, etype FROM ijo WHERE u % 2 = 0 AND v % 2 = 0""",
)
def induced_edges(spark, sf):
    s = B.stems(spark, sf)
    return R.induced(R.edges(s), s.where("v % 2 = 0")).select("sid", "u", "v", "etype")


@query(
    "motif_embeddings",
    f"""WITH {B.IJO_SQL},
l AS (SELECT sid, u, v, etype AS e FROM ijo UNION ALL SELECT sid, v, u, CASE etype WHEN 'i' THEN 'j' WHEN 'j' THEN 'i' ELSE etype END FROM ijo)
SELECT x.sid, x.u AS m0, x.v AS m1, y.v AS m2 FROM l x JOIN l y ON x.sid = y.sid AND x.v = y.u AND y.v <> x.u WHERE x.e = 'i' AND y.e = 'o'""",
)
def motif_embeddings(spark, sf):
    return G.embeddings(R.linked_edges(B.stems(spark, sf)), [(0, 1, "i"), (1, 2, "o")])


@query(
    "segments_strict",
    f"""WITH {B.STEMS_SQL},
n AS (SELECT *, max(rend) OVER (PARTITION BY sid ORDER BY lbegin, rend, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM stems),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR lbegin >= before THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY lbegin, rend, v) - 1 AS segment FROM n)
SELECT sid, CAST(segment AS BIGINT) AS segment, min(lbegin) AS "begin", max(rend) AS "end", count(*) AS n FROM s GROUP BY 1, 2""",
)
def segments_strict(spark, sf):
    return S.strict_segments(B.stems(spark, sf))


@query(
    "mountain_height",
    f"""WITH {B.STEMS_SQL},
e AS (SELECT sid, lbegin AS pos, 1 AS d FROM stems UNION ALL SELECT sid, rend + 1, -1 FROM stems),
g AS (SELECT sid, pos, sum(d) AS d FROM e GROUP BY 1, 2)
SELECT sid, pos, CAST(sum(d) OVER (PARTITION BY sid ORDER BY pos) AS BIGINT) AS height FROM g""",
)
def mountain_height(spark, sf):
    return S.mountain(B.stems(spark, sf))


@query(
    "stems_per_position",
    f"""WITH {B.STEMS_SQL},
p AS (SELECT sid, v, unnest(range(lbegin, rend + 1)) AS pos FROM stems),
a AS (SELECT sid, pos, array_to_string(list_sort(list(v)), ',') AS active FROM p GROUP BY 1, 2),
w AS (SELECT *, lag(active) OVER o AS x, lag(pos) OVER o AS y FROM a WINDOW o AS (PARTITION BY sid ORDER BY pos))
SELECT sid, pos, active FROM w WHERE x IS NULL OR x <> active OR y <> pos - 1""",
)
def stems_per_position(spark, sf):
    return S.stems_per_position(B.stems(spark, sf))


@query(
    "stem_dedup_containment",
    f"""WITH {B.STEMS_SQL}
SELECT sid, v, lbegin, lend, rbegin, rend FROM stems a WHERE NOT EXISTS (SELECT 1 FROM stems o WHERE o.sid = a.sid
  AND a.lbegin >= o.lbegin AND a.lend <= o.lend AND a.rbegin >= o.rbegin AND a.rend <= o.rend
  AND (NOT (a.lbegin = o.lbegin AND a.lend = o.lend AND a.rbegin = o.rbegin AND a.rend = o.rend) OR o.v < a.v))""",
)
def stem_dedup_containment(spark, sf):
    return S.drop_contained(B.stems(spark, sf)).select("sid", "v", *R.HALF)


@query(
    "stem_dedup_runs",
    f"""WITH RECURSIVE {B.STEMS_SQL.strip()},
o AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY lbegin, rbegin, lbegin - lend, v) AS k FROM stems),
r AS (SELECT sid, k, v, lbegin, lend, rbegin, rend, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.sid, o.k,
    CASE WHEN o.lend <= r.lend AND o.rbegin >= r.rbegin AND o.rend <= r.rend AND o.lbegin >= r.lbegin THEN r.v ELSE o.v END,
    CASE WHEN o.lend <= r.lend AND o.rbegin >= r.rbegin AND o.rend <= r.rend AND o.lbegin >= r.lbegin THEN r.lbegin ELSE o.lbegin END,
    CASE WHEN o.lend <= r.lend AND o.rbegin >= r.rbegin AND o.rend <= r.rend AND o.lbegin >= r.lbegin THEN r.lend ELSE o.lend END,
    CASE WHEN o.lend <= r.lend AND o.rbegin >= r.rbegin AND o.rend <= r.rend AND o.lbegin >= r.lbegin THEN r.rbegin ELSE o.rbegin END,
    CASE WHEN o.lend <= r.lend AND o.rbegin >= r.rbegin AND o.rend <= r.rend AND o.lbegin >= r.lbegin THEN r.rend ELSE o.rend END,
    NOT (o.lend <= r.lend AND o.rbegin >= r.rbegin AND o.rend <= r.rend AND o.lbegin >= r.lbegin)
  FROM r JOIN o ON o.sid = r.sid AND o.k = r.k + 1)
SELECT sid, v, lbegin, lend, rbegin, rend FROM r WHERE kept""",
)
def stem_dedup_runs(spark, sf):
    s = B.stems(spark, sf).withColumn("lvienna", F.repeat(F.lit("("), (F.col("lend") - F.col("lbegin") + 1).cast("int")))
    return S.drop_contained_runs(s).select("sid", "v", *R.HALF)


@query(
    "containment_parent",
    f"""WITH {B.STEMS_SQL},
r AS (SELECT c.sid, c.v, p.v AS parent, row_number() OVER (PARTITION BY c.sid, c.v ORDER BY p.rend - p.lbegin, -p.lbegin, p.v) AS k
  FROM stems c JOIN stems p ON c.sid = p.sid AND c.lbegin >= p.lend AND c.rend <= p.rbegin AND c.v <> p.v)
SELECT s.sid, s.v, r.parent FROM stems s LEFT JOIN r ON r.sid = s.sid AND r.v = s.v AND r.k = 1""",
)
def containment_parent(spark, sf):
    return R.containment_parents(B.stems(spark, sf))


@query(
    "containment_children",
    f"""WITH {B.STEMS_SQL},
r AS (SELECT c.sid, c.v, p.v AS parent, row_number() OVER (PARTITION BY c.sid, c.v ORDER BY p.rend - p.lbegin, -p.lbegin, p.v) AS k
  FROM stems c JOIN stems p ON c.sid = p.sid AND c.lbegin >= p.lend AND c.rend <= p.rbegin AND c.v <> p.v)
SELECT s.sid, r.parent, count(*) AS children FROM stems s LEFT JOIN r ON r.sid = s.sid AND r.v = s.v AND r.k = 1 GROUP BY 1, 2""",
)
def containment_children(spark, sf):
    return R.child_counts(containment_parent(spark, sf))


_OVER = {s: f"(a.{s}begin <= b.{s}end AND b.{s}begin <= a.{s}end)" for s in "lr"}
_IN = "((a.lbegin >= b.lbegin AND a.lend <= b.lend AND a.rbegin >= b.rbegin AND a.rend <= b.rend) OR (b.lbegin >= a.lbegin AND b.lend <= a.lend AND b.rbegin >= a.rbegin AND b.rend <= a.rend))"
_MID = "abs((a.lbegin + a.lend + a.rbegin + a.rend) / 4 - (b.lbegin + b.lend + b.rbegin + b.rend) / 4) <= 6"
_LGAP, _RGAP = "(b.lbegin - a.lend - 1)", "(a.rbegin - b.rend - 1)"
_MERGE = {
    1: _IN,
    2: f"NOT {_IN} AND {_OVER['l']} AND {_OVER['r']} AND {_MID}",
    3: f"{_LGAP} BETWEEN 0 AND 4 AND {_RGAP} BETWEEN 0 AND 4",
    4: f"({_OVER['l']} AND NOT {_OVER['r']} AND abs({_RGAP}) <= 4) OR ({_OVER['r']} AND NOT {_OVER['l']} AND abs({_LGAP}) <= 4)",
    5: f"NOT {_OVER['l']} AND NOT {_OVER['r']} AND a.rbegin <= b.lend AND b.lbegin <= a.rend",
}


def _merge_query(case: int) -> None:
    @query(
        f"merge_case_{case}",
        f"""WITH {B.STEMS_SQL}
SELECT a.sid, a.v AS u, b.v AS v, least(a.lbegin, b.lbegin) AS lbegin, greatest(a.lend, b.lend) AS lend, least(a.rbegin, b.rbegin) AS rbegin, greatest(a.rend, b.rend) AS rend
FROM stems a JOIN stems b ON a.sid = b.sid AND a.v < b.v WHERE {_MERGE[case]}""",
    )
    def run(spark, sf):
        return R.merge_candidates(B.stems(spark, sf), case)


for _case in _MERGE:
    _merge_query(_case)


_PAIR_OVER = "(x.a <= y.b AND y.a <= x.b AND x.c <= y.d AND y.c <= x.d AND abs((x.a + x.b + x.c + x.d) - (y.a + y.b + y.c + y.d)) / 4 <= 6)"
_PAIR_NEAR = f"({_PAIR_OVER} OR (y.a - x.b - 1 BETWEEN 0 AND 4 AND x.c - y.d - 1 BETWEEN 0 AND 4) OR (x.a <= y.a AND y.b <= x.b AND x.c <= y.c AND y.d <= x.d))"


@query(
    "merged_stems",
    f"""WITH RECURSIVE {B.STEMS_SQL.strip()},
m AS (SELECT sid, 0 AS step, list_sort(list({{'a': lbegin, 'b': lend, 'c': rbegin, 'd': rend}})) AS s FROM stems GROUP BY sid
  UNION ALL SELECT sid, step + 1, list_sort(list_append(list_filter(s, lambda z, n: n <> i AND n <> j),
      {{'a': least(s[i].a, s[j].a), 'b': greatest(s[i].b, s[j].b), 'c': least(s[i].c, s[j].c), 'd': greatest(s[i].d, s[j].d)}}))
  FROM (SELECT sid, step, s, p.i AS i, p.j AS j FROM (SELECT sid, step, s, (
      SELECT min({{'i': i, 'j': j}}) FROM (SELECT i, j, s[i] AS x, s[j] AS y FROM range(1, len(s) + 1) t(i), range(1, len(s) + 1) u(j) WHERE i < j) WHERE {_PAIR_NEAR}) AS p FROM m) WHERE p IS NOT NULL)),
e AS (SELECT sid, arg_max(s, step) AS s FROM m GROUP BY sid)
SELECT sid, CAST(n - 1 AS INTEGER) AS v, CAST(x.a AS INTEGER) AS lbegin, CAST(x.b AS INTEGER) AS lend, CAST(x.c AS INTEGER) AS rbegin, CAST(x.d AS INTEGER) AS rend
FROM (SELECT sid, unnest(range(1, len(s) + 1)) AS n, unnest(s) AS x FROM e)""",
)
def merged_stems(spark, sf):
    return S.merge_stems(B.stems(spark, sf))


_LEFT, _RIGHT = "(x.a <= y.b AND y.a <= x.b)", "(x.c <= y.d AND y.c <= x.d)"
_PAIR_ANY = f"({_PAIR_NEAR} OR (y.a <= x.a AND x.b <= y.b AND y.c <= x.c AND x.d <= y.d) OR ({_LEFT} AND NOT {_RIGHT} AND abs(x.c - y.d - 1) <= 4) OR ({_RIGHT} AND NOT {_LEFT} AND abs(y.a - x.b - 1) <= 4) OR (NOT {_LEFT} AND NOT {_RIGHT} AND x.c <= y.b AND y.a <= x.d))"


@query("merged_stems_all_rules", ORACLES["merged_stems"].replace(_PAIR_NEAR, _PAIR_ANY))
def merged_stems_all_rules(spark, sf):
    return S.merge_stems(B.stems(spark, sf), rules=(1, 2, 3, 4, 5))


@query(
    "merged_only_children",
    f"""WITH RECURSIVE {B.STEMS_SQL.strip()},
q AS (SELECT c.sid, c.v, p.v AS parent, c.lbegin - p.lend - 1 AS lgap, p.rbegin - c.rend - 1 AS rgap, row_number() OVER (PARTITION BY c.sid, c.v ORDER BY p.rend - p.lbegin, -p.lbegin, p.v) AS k
  FROM stems c JOIN stems p ON c.sid = p.sid AND c.lbegin >= p.lend AND c.rend <= p.rbegin AND c.v <> p.v),
o AS (SELECT *, count(*) OVER (PARTITION BY sid, parent) AS children FROM q WHERE k = 1),
up AS (SELECT sid, v, parent FROM o WHERE children = 1 AND lgap <= 12 AND rgap <= 12),
r AS (SELECT sid, v, v AS top FROM stems s WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.sid = s.sid AND up.v = s.v) UNION ALL SELECT up.sid, up.v, r.top FROM r JOIN up ON up.sid = r.sid AND up.parent = r.v)
SELECT sid, r.top AS v, min(lbegin) AS lbegin, max(lend) AS lend, min(rbegin) AS rbegin, max(rend) AS rend, count(*) AS n FROM r JOIN stems USING (sid, v) GROUP BY 1, 2""",
)
def merged_only_children(spark, sf):
    return S.merge_only_children(B.stems(spark, sf), gap=12)


@query("pair_histogram", f"WITH {B.HISTOGRAM_SQL}\nSELECT sid, pos, ppos, count(*) AS cnt FROM pairs GROUP BY 1, 2, 3")
def pair_histogram(spark, sf):
    return S.pair_histogram(B.sampled_pairs(spark, sf))


@query("pair_filter", f"WITH {B.HISTOGRAM_SQL}\nSELECT sid, pos, ppos, count(*) AS cnt FROM pairs GROUP BY 1, 2, 3 HAVING count(*) >= 20")
def pair_filter(spark, sf):
    return S.frequent_pairs(pair_histogram(spark, sf), 20)


@query(
    "stems_from_pairs",
    f"""WITH {B.SEQUENCE_SQL},
l AS (SELECT *, lag(pos) OVER o AS p, lag(ppos) OVER o AS q FROM bp WHERE ppos > pos WINDOW o AS (PARTITION BY sid ORDER BY pos, ppos)),
n AS (SELECT *, CASE WHEN p IS NULL OR pos - p - 1 > 2 OR q - ppos - 1 > 2 OR ppos >= q THEN 1 ELSE 0 END AS brk FROM l),
i AS (SELECT *, sum(brk) OVER (PARTITION BY sid ORDER BY pos, ppos) - 1 AS stem FROM n)
SELECT sid, CAST(stem AS BIGINT) AS stem, min(pos) AS lbegin, max(pos) AS lend, min(ppos) AS rbegin, max(ppos) AS rend, count(*) AS n_pairs,
  string_agg(repeat('.', CASE WHEN brk = 1 THEN 0 ELSE pos - p - 1 END) || '(', '' ORDER BY pos) AS lvienna,
  string_agg(')' || repeat('.', CASE WHEN brk = 1 THEN 0 ELSE q - ppos - 1 END), '' ORDER BY pos DESC) AS rvienna
FROM i GROUP BY 1, 2""",
)
def stems_from_pairs(spark, sf):
    return S.stems_from_pairs(B.pair_sequence(spark, sf)).withColumn("stem", F.col("stem").cast("long"))


@query(
    "long_stems",
    f"""WITH {B.SEQUENCE_SQL},
l AS (SELECT *, lag(pos) OVER o AS p, lag(ppos) OVER o AS q FROM bp WHERE ppos > pos WINDOW o AS (PARTITION BY sid ORDER BY pos, ppos)),
n AS (SELECT *, CASE WHEN p IS NULL OR pos - p - 1 > 2 OR q - ppos - 1 > 2 OR ppos >= q THEN 1 ELSE 0 END AS brk FROM l),
i AS (SELECT *, sum(brk) OVER (PARTITION BY sid ORDER BY pos, ppos) - 1 AS stem FROM n)
SELECT sid, CAST(stem AS BIGINT) AS stem, count(*) AS n_pairs FROM i GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def long_stems(spark, sf):
    return S.long_stems(stems_from_pairs(spark, sf), 3).select("sid", "stem", "n_pairs")


@query("traced_stems")
def traced_stems(spark, sf):
    return S.trace_stems(S.frequent_pairs(pair_histogram(spark, sf), 2), gap=3, minstem=3)


def _rounded_energy(name: str):
    """Six decimals; a negative zero stays one, as in SQL."""
    return F.when(F.col(name) == 0, F.col(name)).otherwise(F.round(name, 6)).alias(name)


@query(
    "ct_energy_takewhile",
    """WITH s AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS struct_no, -value AS energy FROM events),
f AS (SELECT *, first_value(energy) OVER (PARTITION BY sid ORDER BY struct_no) AS mfe FROM s),
t AS (SELECT *, max(CASE WHEN energy > mfe + 40.01 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY struct_no) AS seen FROM f)
SELECT sid, struct_no, round(energy, 6) AS energy FROM t WHERE seen = 0""",
)
def ct_energy_takewhile(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    s = e.select(F.col("user_id").alias("sid"), n.alias("struct_no"), (-F.col("value")).alias("energy"))
    return S.energy_takewhile(s, 40.0).select("sid", "struct_no", _rounded_energy("energy"))


@query(
    "first_energy",
    "SELECT user_id AS sid, round(arg_min(-value, event_id), 6) AS mfe FROM events GROUP BY 1",
)
def first_energy(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("struct_no"), (-F.col("value")).alias("energy"))
    return S.first_energy(e).select("sid", _rounded_energy("mfe"))


@query(
    "stem_centers",
    f"""WITH {B.STEMS_SQL}
SELECT sid, v, round((lbegin + rend) / 2, 1) AS center, (lbegin + lend + rbegin + rend) / 4 AS middle FROM stems""",
)
def stem_centers(spark, sf):
    return S.stem_centers(B.stems(spark, sf)).select("sid", "v", "center", "middle")


@query(
    "greedy_by_energy",
    f"""WITH RECURSIVE {B.STEMS_SQL.strip()},
o AS (SELECT stems.*, row_number() OVER (PARTITION BY sid ORDER BY -o_totalprice, v) AS k FROM stems JOIN orders ON o_orderkey = ok),
r AS (SELECT sid, k, v, lbegin, lend, rbegin, rend, true AS ok, [{{'a': lbegin, 'b': lend, 'c': rbegin, 'd': rend}}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT sid, k, v, lbegin, lend, rbegin, rend, good, CASE WHEN good THEN list_append(kept, {{'a': lbegin, 'b': lend, 'c': rbegin, 'd': rend}}) ELSE kept END
  FROM (SELECT o.sid, o.k, o.v, o.lbegin, o.lend, o.rbegin, o.rend, r.kept, len(list_filter(r.kept, lambda x: o.lbegin <= x.b AND o.lend >= x.a AND o.rbegin <= x.d AND o.rend >= x.c)) = 0 AS good
    FROM r JOIN o ON o.sid = r.sid AND o.k = r.k + 1))
SELECT sid, v, lbegin, lend, rbegin, rend FROM r WHERE ok""",
)
def greedy_by_energy(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ok"), (-F.col("o_totalprice")).alias("energy"))
    return S.greedy_by_energy(B.stems(spark, sf).join(o, "ok")).select("sid", "v", *R.HALF)


@query("exhaustive_fingerprint")
def exhaustive_fingerprint(spark, sf):
    return G.exhaustive_fingerprint(R.linked_edges(B.stems(spark, sf)), k=7, limit=20)


@query("sampled_fingerprint")
def sampled_fingerprint(spark, sf):
    return G.sampled_fingerprint(R.linked_edges(B.stems(spark, sf)), k=7, limit=10_000, coverage=3, seed=11)
