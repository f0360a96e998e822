"""Queries over names, codecs, notations, enumerations, grids and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as K
from ..functions import names as N
from ..functions import notation as T
from ..operators import enumeration as E
from . import bindings as B
from .registry import query, table
from .workflow import grid

_UP = "upper(text)"


@query(
    "fasta_fix",
    f"SELECT doc_id, length(regexp_replace({_UP}, '[ACGTU]', '', 'g')) AS bad, md5(regexp_replace({_UP}, '[^ACGTU]', 'A', 'g')) AS fixed FROM (SELECT doc_id, replace(text, 'ß', 'SS') AS text FROM documents)",
)
def fasta_fix(spark, sf):
    # upper case of ß is SS in one engine and ß in the other: it is written out on both sides
    d = table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("ß"), F.lit("SS")))
    return d.select("doc_id", N.bad_bases(F.col("text")).cast("long").alias("bad"), F.md5(N.fixed_bases(F.col("text"))).alias("fixed"))


@query("bad_letters", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(p_name), '[^ACGTU]'))), '') AS letters FROM part")
def bad_letters(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(N.bad_letters(F.col("p_name")), "").alias("letters"))


@query("group_prefix", "SELECT regexp_extract(split_part(url, '/', 3), '^(.[^._]*)', 1) AS grp, count(*) AS n FROM pages GROUP BY 1")
def group_prefix(spark, sf):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return table(spark, sf, "pages").groupBy(N.group_of(host).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


_NAME = "'s' || o_custkey || '.w' || (o_orderkey % 7) || '.d' || (o_orderkey % 5) || '.xios'"


def _names(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.concat(F.lit("s"), "o_custkey", F.lit(".w"), F.col("o_orderkey") % 7, F.lit(".d"), F.col("o_orderkey") % 5, F.lit(".xios")).alias("name"))


@query("param_parse", f"SELECT o_orderkey, CAST(regexp_extract({_NAME}, '\\.w(\\d+)', 1) AS INTEGER) AS w, CAST(regexp_extract({_NAME}, '\\.d(\\d+)', 1) AS INTEGER) AS d FROM orders")
def param_parse(spark, sf):
    p = N.parameters(F.col("name"))
    return _names(spark, sf).select("o_orderkey", p["w"].alias("w"), p["d"].alias("d"))


@query("derived_names", f"SELECT o_orderkey, '../fpt/' || regexp_replace({_NAME}, '\\.[^.]*$', '') || '.k7.fpt' AS output FROM orders")
def derived_names(spark, sf):
    return _names(spark, sf).select("o_orderkey", N.derived_name(F.concat(F.lit("a/b/"), "name"), "../fpt", ".fpt", k=7).alias("output"))


@query("wrapped_sequences", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '(.{60})', '\\1\n', 'g')) AS wrapped FROM documents")
def wrapped_sequences(spark, sf):
    s = F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", "")
    w = N.wrapped(s, 60)
    # a sequence whose length is a multiple of the width gets no last line feed here, and one there
    return table(spark, sf, "documents").select("doc_id", F.md5(F.when((F.length(s) % 60 == 0) & (F.length(s) > 0), F.concat(w, F.lit("\n"))).otherwise(w)).alias("wrapped"))


@query("divided", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE round(p_partkey / (p_size % 5), 6) END AS q FROM part")
def divided(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(N.divided(F.col("p_partkey").cast("double"), (F.col("p_size") % 5).cast("double")), 6).alias("q"))


@query("fold_percent", "SELECT s_suppkey, CAST(trunc(-100 * 5.0 / -(1 + s_suppkey % 40)) AS INTEGER) + 1 AS percent FROM supplier")
def fold_percent(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", N.fold_percent(F.lit(5.0), -(1 + F.col("s_suppkey") % 40)).alias("percent"))


_EDGES = "SELECT o_orderkey, o_orderkey % 7 AS a, (o_orderkey + 1 + o_custkey % 6) % 7 AS b, ['i', 'j', 'o'][1 + o_custkey % 3] AS e FROM orders"


def _coded(spark, sf):
    o = table(spark, sf, "orders")
    e = F.element_at(F.array(F.lit("i"), F.lit("j"), F.lit("o")), (1 + F.col("o_custkey") % 3).cast("int"))
    a, b = (F.col("o_orderkey") % 7).cast("int"), ((F.col("o_orderkey") + 1 + F.col("o_custkey") % 6) % 7).cast("int")
    edge = F.struct(a.alias("v0"), b.alias("v1"), e.alias("e"))
    return o.select("o_orderkey", F.array(edge, K.reverse_edge(edge)).alias("g"))


@query(
    "human_codec",
    f"WITH g AS ({_EDGES})\nSELECT o_orderkey, a || e || b || '.' || b || translate(e, 'ij', 'ji') || a || '.' AS code, lpad(a::VARCHAR, 2, '0') || e || lpad(b::VARCHAR, 2, '0') || '.' || lpad(b::VARCHAR, 2, '0') || translate(e, 'ij', 'ji') || lpad(a::VARCHAR, 2, '0') || '.' AS wide, greatest(a, b) + 1 AS vertices FROM g",
)
def human_codec(spark, sf):
    g = _coded(spark, sf)
    back = K.human_encode(K.human_decode(K.human_encode(F.col("g"), 2)))
    return g.select("o_orderkey", back.alias("code"), K.human_encode(F.col("g"), 2).alias("wide"), K.code_vertices(back).cast("long").alias("vertices"))


_BYTE = "lower(printf('%02x', {a} * 32 + {b} * 4 + strpos('ijo', {e}) - 1))"


@query(
    "decode_hex_dfs",
    f"WITH g AS ({_EDGES})\nSELECT o_orderkey, {_BYTE.format(a='a', b='b', e='e')} || {_BYTE.format(a='b', b='a', e=chr(116) + 'ranslate(e, ' + chr(39) + 'ij' + chr(39) + ', ' + chr(39) + 'ji' + chr(39) + ')')} AS hex, a || e || b || '.' || b || translate(e, 'ij', 'ji') || a || '.' AS code FROM g",
)
def decode_hex_dfs(spark, sf):
    g = _coded(spark, sf).withColumn("hex", K.hex_encode(F.col("g")))
    return g.select("o_orderkey", "hex", K.decode_dfs(F.col("hex")).alias("code"))


@query(
    "hex2_codec",
    f"""WITH g AS ({_EDGES}),
t AS (SELECT *, strpos('ijo', e) - 1 AS n FROM g)
SELECT o_orderkey, printf('%02x%02x', (n // 2) * 128 + a, (n % 2) * 128 + b) AS hex, a || e || b || '.' AS code FROM t""",
)
def hex2_codec(spark, sf):
    g = _coded(spark, sf).select("o_orderkey", F.slice("g", 1, 1).alias("g")).withColumn("hex", K.hex2_encode(F.col("g")))
    return g.select("o_orderkey", "hex", K.human_encode(K.hex2_decode(F.col("hex"))).alias("code"))


@query(
    "ascii_codec",
    f"""WITH g AS ({_EDGES}),
t AS (SELECT *, strpos('ijo', e) - 1 AS n FROM g)
SELECT o_orderkey, chr(((n // 2) * 64 + a + 33)::INT) || chr(((n % 2) * 64 + b + 33)::INT) AS text, a || e || b || '.' AS code FROM t""",
)
def ascii_codec(spark, sf):
    g = _coded(spark, sf).select("o_orderkey", F.slice("g", 1, 1).alias("g")).withColumn("text", K.ascii_encode(F.col("g")))
    return g.select("o_orderkey", "text", K.human_encode(K.ascii_decode(F.col("text"))).alias("code"))


@query("graph_text", f"WITH g AS ({_EDGES})\nSELECT o_orderkey, CASE WHEN e = 'j' THEN '1i0.' ELSE '0' || e || '1.' END AS code FROM g WHERE a <> b")
def graph_text(spark, sf):
    g = _coded(spark, sf).select("o_orderkey", F.get("g", F.lit(0)).alias("x")).where("x.v0 <> x.v1")
    text = F.format_string("(%d, %d, %s)", "x.v0", "x.v1", "x.e")
    return g.select("o_orderkey", K.human_encode(K.flip_j(K.graph_from_text(text))).alias("code"))


_SERIAL = f"""{B.STEMS_SQL},
h AS (SELECT sid, v, lbegin AS x, 0 AS r FROM stems UNION ALL SELECT sid, v, rbegin, 1 FROM stems),
s AS (SELECT sid, list(v::INT ORDER BY x, r, v) AS serial FROM h GROUP BY 1)"""


def serials(spark, sf):
    """A serial structure for each customer: stem numbers in order of their halves' beginnings."""
    s = B.stems(spark, sf)
    h = s.select("sid", "v", F.col("lbegin").alias("x"), F.lit(0).alias("r")).unionAll(s.select("sid", "v", F.col("rbegin").alias("x"), F.lit(1).alias("r")))
    rows = F.array_sort(F.collect_list(F.struct("x", "r", F.col("v").cast("int").alias("v"))))
    return h.groupBy("sid").agg(F.transform(rows, lambda z: z["v"]).alias("serial"))


@query(
    "serial_pairs",
    f"""WITH {_SERIAL},
p AS (SELECT sid, array_to_string(list_transform(list_distinct(serial), lambda z: 1), '') AS one, serial, unnest(range(0, len(serial) // 2)) AS k FROM s)
SELECT sid, k, list_position(serial, k::INT) - 1 AS l, len(serial) - list_position(list_reverse(serial), k::INT) AS r FROM p""",
)
def serial_pairs(spark, sf):
    p = serials(spark, sf).select("sid", T.serial_to_pairs(T.serial_canonical(F.col("serial"))).alias("p"), "serial")
    k = F.sequence(F.lit(0), (F.size("p") / 2).cast("int") - 1)
    first = F.array_distinct("serial")
    out = p.select("sid", F.explode(F.transform(k, lambda i: F.struct(F.get(first, i).cast("long").alias("k"), F.get("p", 2 * i).cast("long").alias("l"), F.get("p", 2 * i + 1).cast("long").alias("r")))).alias("x"))
    return out.select("sid", "x.k", "x.l", "x.r")


@query(
    "serial_depth",
    f"""WITH {_SERIAL},
e AS (SELECT sid, unnest(range(0, len(serial))) AS pos, serial FROM s)
SELECT sid, max(d) AS depth FROM (SELECT sid, pos, len(list_distinct(list_intersect(serial[1:pos + 1], serial[pos + 1:]))) AS d FROM e) GROUP BY 1""",
)
def serial_depth(spark, sf):
    return serials(spark, sf).select("sid", F.array_max(T.pairs_depth(T.serial_to_pairs(F.col("serial")))).cast("long").alias("depth"))


@query(
    "serial_parts",
    f"""WITH {_SERIAL},
e AS (SELECT sid, unnest(range(1, len(serial) + 1)) AS pos, serial FROM s)
SELECT sid, count(*) FILTER (WHERE len(list_intersect(serial[1:pos], serial[pos + 1:])) = 0) AS parts FROM e GROUP BY 1""",
)
def serial_parts(spark, sf):
    return serials(spark, sf).select("sid", F.size(T.serial_connected(F.col("serial"))).cast("long").alias("parts"))


_SPANS = f"""{_SERIAL},
q AS (SELECT sid, serial, unnest(list_distinct(serial)) AS stem FROM s),
spans AS (SELECT sid, stem, list_position(serial, stem) - 1 AS l, len(serial) - list_position(list_reverse(serial), stem) AS r FROM q)"""


@query(
    "serial_graph_edges",
    f"""WITH {_SPANS}
SELECT a.sid, CASE WHEN a.r > b.r THEN 'i' ELSE 'o' END AS e, count(*) AS n FROM spans a JOIN spans b ON a.sid = b.sid AND a.l < b.l AND b.l < a.r GROUP BY 1, 2""",
)
def serial_graph_edges(spark, sf):
    g = serials(spark, sf).select("sid", F.explode(T.serial_to_graph(F.col("serial"))).alias("x"))
    return g.groupBy("sid", "x.e").agg(F.count(F.lit(1)).alias("n"))


@query(
    "brackets_round_trip",
    f"""WITH RECURSIVE {_SPANS.strip()},
o AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY l) AS k, count(*) OVER (PARTITION BY sid) AS n FROM spans),
g AS (SELECT sid, 0 AS k, CAST([[], [], [], []] AS STRUCT(l BIGINT, r BIGINT)[][]) AS used FROM (SELECT DISTINCT sid FROM o)
  UNION ALL SELECT sid, k, list_transform(used, lambda mine, i: CASE WHEN i = kind THEN list_append(mine, {{'l': l, 'r': r}}) ELSE mine END)
  FROM (SELECT o.sid, o.k, o.l, o.r, g.used, list_position(list_transform(g.used, lambda mine: len(list_filter(mine, lambda p: p.l < o.l AND o.l < p.r AND p.r < o.r)) = 0), true) AS kind
    FROM g JOIN o ON o.sid = g.sid AND o.k = g.k + 1) WHERE kind IS NOT NULL AND kind > 0),
done AS (SELECT g.sid, used, o.n FROM g JOIN o ON o.sid = g.sid AND o.k = g.k AND g.k = o.n),
c AS (SELECT sid, i, unnest(used[i]) AS p FROM (SELECT sid, used, unnest([1, 2, 3, 4]) AS i FROM done)),
t AS (SELECT sid, p.l AS place, substr('([{{<', i, 1) AS ch FROM c UNION ALL SELECT sid, p.r, substr(')]}}>', i, 1) FROM c)
SELECT sid, string_agg(ch, '' ORDER BY place) AS vienna, true AS same FROM t GROUP BY 1""",
)
def brackets_round_trip(spark, sf):
    p = serials(spark, sf).select("sid", T.serial_to_pairs(F.col("serial")).alias("p"))
    p = p.withColumn("vienna", T.pairs_to_brackets("p")).where("vienna is not null")
    return p.select("sid", "vienna", (T.brackets_to_pairs("vienna") == F.col("p")).alias("same"))


@query(
    "enumerate_pairings",
    """WITH RECURSIVE r AS (SELECT n AS stems, 1 AS p, [0] AS "open", 1 AS used FROM range(1, 6) t(n)
UNION ALL SELECT stems, p + 1, x."open", x.used FROM (SELECT stems, p, unnest(list_concat(
  CASE WHEN used < stems THEN [{'open': list_append("open", used::INT), 'used': used + 1}] ELSE [] END,
  CASE WHEN p = 2 * stems - 1 OR len("open") > 1 THEN list_transform("open", lambda s: {'open': list_filter("open", lambda y: y <> s), 'used': used}) ELSE [] END)) AS x
  FROM r WHERE p < 2 * stems) q)
SELECT CAST(stems AS INTEGER) AS stems, count(*) AS n FROM r WHERE p = 2 * stems AND len("open") = 0 AND used = stems GROUP BY 1""",
)
def enumerate_pairings(spark, sf):
    return E.pairings(spark, 5).groupBy("stems").agg(F.count(F.lit(1)).alias("n"))


@query("motif_parents")
def motif_parents(spark, sf):
    return E.motif_table(spark, 5)[1]


_CONNECTED = """r AS (SELECT n AS stems, 1 AS p, [0] AS serial, [0] AS "open", 1 AS used FROM range(2, 6) t(n)
  UNION ALL SELECT stems, p + 1, x.serial, x."open", x.used FROM (SELECT stems, p, unnest(list_concat(
    CASE WHEN used < stems THEN [{'serial': list_append(serial, used::INT), 'open': list_append("open", used::INT), 'used': used + 1}] ELSE [] END,
    CASE WHEN p = 2 * stems - 1 OR len("open") > 1 THEN list_transform("open", lambda s: {'serial': list_append(serial, s), 'open': list_filter("open", lambda y: y <> s), 'used': used}) ELSE [] END)) AS x
    FROM r WHERE p < 2 * stems) q),
m AS (SELECT stems, serial FROM r WHERE p = 2 * stems AND len("open") = 0 AND used = stems)"""


@query(
    "motif_levels",
    f"""WITH RECURSIVE {_CONNECTED},
perm AS (SELECT n, 0 AS k, CAST([] AS BIGINT[]) AS o FROM range(2, 6) t(n) UNION ALL SELECT n, k + 1, list_append(o, x) FROM (SELECT n, k, o, unnest(list_filter(range(n), lambda x: NOT list_contains(o, x))) AS x FROM perm WHERE k < n)),
spans AS (SELECT stems, serial, list_transform(range(stems), lambda x: list_position(serial, x::INT)) AS l, list_transform(range(stems), lambda x: len(serial) + 1 - list_position(list_reverse(serial), x::INT)) AS r FROM m),
named AS (SELECT stems, serial, list_aggregate(flatten(list_transform(range(1, stems + 1), lambda i: list_transform(range(i + 1, stems + 1), lambda j:
    CASE WHEN r[o[i] + 1] < l[o[j] + 1] OR r[o[j] + 1] < l[o[i] + 1] THEN '.' WHEN l[o[i] + 1] < l[o[j] + 1] AND r[o[i] + 1] > r[o[j] + 1] THEN 'i' WHEN l[o[i] + 1] > l[o[j] + 1] AND r[o[i] + 1] < r[o[j] + 1] THEN 'j' ELSE 'o' END))), 'string_agg', '') AS key
  FROM spans JOIN perm ON perm.n = stems AND perm.k = stems),
least AS (SELECT stems, serial, min(key) AS key FROM named GROUP BY 1, 2)
SELECT CAST(stems AS INTEGER) AS n_stems, count(DISTINCT key) AS n, CAST(sum(count(DISTINCT key)) OVER (ORDER BY stems) AS BIGINT) AS total FROM least GROUP BY stems""",
)
def motif_levels(spark, sf):
    """Motifs of two to five stems: as many as there are graphs that no renumbering makes equal."""
    return E.level_counts(E.motif_table(spark, 5)[0])


_MATCHINGS = """r AS (SELECT n AS stems, 1 AS p, [0] AS serial, [0] AS "open", 1 AS used FROM range(1, 7) t(n)
  UNION ALL SELECT stems, p + 1, x.serial, x."open", x.used FROM (SELECT stems, p, unnest(list_concat(
    CASE WHEN used < stems THEN [{'serial': list_append(serial, used::INT), 'open': list_append("open", used::INT), 'used': used + 1}] ELSE [] END,
    list_transform("open", lambda s: {'serial': list_append(serial, s), 'open': list_filter("open", lambda y: y <> s), 'used': used}))) AS x
    FROM r WHERE p < 2 * stems) q),
m AS (SELECT stems, serial FROM r WHERE p = 2 * stems AND len("open") = 0 AND used = stems)"""
#: A list of stem numbers renumbered by first appearance.
_RENUMBERED = "list_transform({x}, lambda z: len(list_distinct({x}[1:list_position({x}, z)])) - 1)"


@query(
    "grown_structures",
    f"""WITH RECURSIVE {_MATCHINGS},
b AS (SELECT stems, serial, list_reverse(serial) AS back FROM m),
k AS (SELECT stems, array_to_string(serial, ' ') AS a, array_to_string({_RENUMBERED.format(x='back')}, ' ') AS b FROM b)
SELECT CAST(stems AS INTEGER) AS stems, count(DISTINCT least(a, b)) AS n FROM k GROUP BY 1""",
)
def grown_structures(spark, sf):
    return E.grow_structures(spark, 6).groupBy("stems").agg(F.count(F.lit(1)).alias("n"))


@query(
    "subtracted_structures",
    f"""WITH RECURSIVE {_MATCHINGS.replace('range(1, 7)', 'range(2, 6)')},
f AS (SELECT serial, list_filter(serial, lambda x: x <> gone) AS rest FROM (SELECT serial, unnest(list_distinct(serial)) AS gone FROM m)),
c AS (SELECT serial, rest, list_filter(range(1, len(rest) + 1), lambda i: len(list_intersect(rest[1:i], rest[i + 1:])) = 0) AS cuts FROM f),
p AS (SELECT serial, rest[begin + 1:finish] AS part FROM (SELECT serial, rest, unnest(cuts) AS finish, unnest(list_concat([0], cuts[:-2])) AS begin FROM c))
SELECT DISTINCT array_to_string(serial, ',') AS serial, array_to_string({_RENUMBERED.format(x='part')}, ',') AS less FROM p WHERE len(part) > 2""",
)
def subtracted_structures(spark, sf):
    """Every structure of two to five stems without one of its stems."""
    now = grow = spark.sql("select array(0, 0) as serial")
    for _ in range(4):
        grow = E.add_stem_all(grow)
        now = now.unionAll(grow)
    return E.subtract_stem(now).select(F.array_join("serial", ",").alias("serial"), F.array_join("less", ",").alias("less"))


@query("random_structures")
def random_structures(spark, sf):
    return E.graph_codes(E.connected_only(E.random_structures(spark, 500, 4, seed=3))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("parameter_grid", "SELECT CAST(t AS BIGINT) AS t, CAST(c AS BIGINT) AS c, CAST(m AS BIGINT) AS m FROM range(260, 350, 9) a(t), range(10, 210, 10) b(c), range(2, 6) d(m)")
def parameter_grid(spark, sf):
    return grid(spark, t=list(range(260, 350, 9)), c=list(range(10, 210, 10)), m=list(range(2, 6)))


@query("incremental_files", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def incremental_files(spark, sf):
    """The events table read as a stream of files, each once, and counted: equal to the batch result."""
    from ..streaming.incremental import collected, file_stream

    e = file_stream(spark, f"{sf}/events.parque[t]", "event_id long, ts timestamp, user_id long, event_type string, value double, props string", files_per_batch=1)
    out = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return collected(out, "incremental_files", "complete").select("event_type", "n", F.round("total", 4).alias("total"))


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
