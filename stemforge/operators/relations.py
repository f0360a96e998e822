"""Relations between stems: edges, interval overlaps, containment.

Joins have the structure as an equality key.  All pairs of a structure (``edges``) are as many as they are by definition;
relations that need a common place (every edge but serial ones, overlaps of halves, containment) are joined on the
structure and a bin of ``BIN`` positions, so that a structure with very many stems spreads over its bins and no pair
that cannot be related is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF = ["lbegin", "lend", "rbegin", "rend"]
#: Positions of a bin.
BIN = 64


def bin_of(position: Column) -> Column:
    return F.floor(position / BIN).cast("long")


def bins_of(begin: Column, end: Column) -> Column:
    """The bins that an interval touches, exploded; none where it is empty."""
    return F.explode(F.when(end >= begin, F.sequence(bin_of(begin), bin_of(end))).otherwise(F.array().cast("array<bigint>")))


def meeting(a: DataFrame, b: DataFrame, a_span: tuple[Column, Column], b_span: tuple[Column, Column]) -> DataFrame:
    """Rows of a and b of one structure whose closed intervals have a common position, each pair once: in the bin of the later begin."""
    left, right = a.withColumns({"_ab": a_span[0], "_ae": a_span[1]}), b.withColumns({"_bb": b_span[0], "_be": b_span[1]})
    left, right = left.withColumn("_bin", bins_of(F.col("_ab"), F.col("_ae"))), right.withColumn("_bin", bins_of(F.col("_bb"), F.col("_be")))
    later = F.greatest("_ab", "_bb")
    return left.join(right, ["sid", "_bin"]).where((later <= F.least("_ae", "_be")) & (F.col("_bin") == bin_of(later))).drop("_bin", "_ab", "_ae", "_bb", "_be")


def prefixed(stems: DataFrame, prefix: str, *more: str) -> DataFrame:
    return stems.select("sid", *(F.col(c).alias(f"{prefix}{c}") for c in ("v", *HALF, *more)))


def edge_type(a: str = "a_", b: str = "b_") -> Column:
    """s, o, i or x of two stems, a before b: by strict inequalities of their halves."""
    c = lambda p, n: F.col(f"{p}{n}")
    return (
        F.when(c(a, "rend") < c(b, "lbegin"), "s")
        .when((c(a, "lend") < c(b, "lbegin")) & (c(a, "rbegin") > c(b, "lend")) & (c(a, "rend") < c(b, "rbegin")), "o")
        .when((c(a, "lend") < c(b, "lbegin")) & (c(a, "rbegin") > c(b, "rend")), "i")
        .otherwise("x")
    )


def edge_type_all(a: str = "a_", b: str = "b_") -> Column:
    """As ``edge_type`` in either order, with j where a lies inside b."""
    forward = (F.col(f"{a}lbegin") < F.col(f"{b}lbegin")) | (F.col(f"{a}lbegin") == F.col(f"{b}lbegin")) & (F.col(f"{a}v") < F.col(f"{b}v"))
    return F.when(forward, edge_type(a, b)).otherwise(F.translate(edge_type(b, a), "i", "j"))


def edge_type_minlen(minlen: int = 3, a: str = "a_", b: str = "b_") -> Column:
    """s, o, i or x where halves may overlap as long as ``minlen`` bases remain on both sides of the overlap; unknown orders are x."""
    half = lambda p, side, name: F.struct(F.col(f"{p}{side}begin").alias("b"), F.lit(name).alias("n"), F.col(f"{p}{side}end").alias("e"))
    four = F.array_sort(F.array(half(a, "l", "1il"), half(a, "r", "2ir"), half(b, "l", "3jl"), half(b, "r", "4jr")))
    clash = None
    for i in range(4):
        for j in range(i + 1, 4):
            p, q = F.get(four, F.lit(i)), F.get(four, F.lit(j))
            bad = (q["b"] < p["e"]) & ((q["b"] - p["b"] < minlen) | (q["e"] - p["e"] < minlen))
            clash = bad if clash is None else clash | bad
    order = F.array_join(F.transform(four, lambda h: F.substring(h["n"], 2, 2)), "")
    return (
        F.when(F.col(f"{a}rend") < F.col(f"{b}lbegin"), "s")
        .when(clash, "x")
        .when(order == "iljlirjr", "o")
        .when(order == "iljljrir", "i")
        .when(order == "ilirjljr", "s")
        .otherwise("x")
    )


def overlap_order(a: str = "a_", b: str = "b_") -> Column:
    """The eight coordinates' order as text, e.g. a1a2b1b2..: a key of the relation of two stems."""
    at = lambda p, n, name: F.struct(F.col(f"{p}{n}").alias("x"), F.lit(name).alias("n"))
    points = [at(p, c, f"{s}{i}") for p, s in ((a, "a"), (b, "b")) for i, c in enumerate(HALF, 1)]
    return F.array_join(F.transform(F.array_sort(F.array(*points)), lambda h: h["n"]), "")


#: The four symmetries of a relation of two stems, as changes of the letters of ``overlap_order``.
_SYMMETRIES = {"same": ("ab", "1234", False), "swapped": ("ba", "1234", False), "mirrored": ("ab", "4321", True), "both": ("ba", "4321", True)}


def overlap_class(key: Column) -> Column:
    """The least of the four symmetric forms of an order key: stems exchanged, read from the other end, or both."""
    tokens = F.regexp_extract_all(key, F.lit("[ab][1-4]"), F.lit(0))

    def form(who: str, ends: str, back: bool) -> Column:
        return F.array_join(F.transform(F.reverse(tokens) if back else tokens, lambda t: F.translate(F.translate(t, "ab", who), "1234", ends)), "")

    return F.least(*(form(*s) for s in _SYMMETRIES.values()))


def pairs_of_stems(stems: DataFrame, both: bool = False) -> DataFrame:
    """All pairs of stems of a structure (a_v < b_v, or a_v <> b_v)."""
    a, b = prefixed(stems, "a_"), prefixed(stems, "b_")
    return a.join(b, "sid").where("a_v <> b_v" if both else "a_v < b_v")


def edges(stems: DataFrame, rule: Column | None = None) -> DataFrame:
    """sid, u, v, etype for u < v."""
    return pairs_of_stems(stems).select("sid", F.col("a_v").alias("u"), F.col("b_v").alias("v"), (edge_type() if rule is None else rule).alias("etype"))


def linked_edges(stems: DataFrame, rule: Column | None = None) -> DataFrame:
    """``edges`` without the serial ones: only pairs whose spans have a common position are made.

    Halves are in order within a stem, and stems in order of their left ends, as ``edges`` has them."""
    c = F.col
    p = meeting(prefixed(stems, "a_"), prefixed(stems, "b_"), (c("a_lbegin"), F.greatest("a_rend", "a_lbegin")), (c("b_lbegin"), F.greatest("b_rend", "b_lbegin"))).where("a_v < b_v")
    return p.select("sid", c("a_v").alias("u"), c("b_v").alias("v"), (edge_type() if rule is None else rule).alias("etype")).where("etype <> 's'")


def edges_both(stems: DataFrame) -> DataFrame:
    """Edges in both directions, with j."""
    return pairs_of_stems(stems, both=True).select("sid", F.col("a_v").alias("u"), F.col("b_v").alias("v"), edge_type_all().alias("etype"))


def edge_list(edges_: DataFrame, include: str = "ijo", whole: bool = False) -> DataFrame:
    """Edges of the included types; v > u unless ``whole``."""
    out = edges_.where(F.col("etype").isin(*include))
    return out.where("v <> u") if whole else out.where("v > u")


def pseudoknots(edges_: DataFrame) -> DataFrame:
    return edge_list(edges_, "o")


def edge_totals(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy("etype").agg(F.count(F.lit(1)).alias("n"))


def induced(edges_: DataFrame, vertices: DataFrame) -> DataFrame:
    """i, j and o edges with both ends in ``vertices`` (sid, v)."""
    one = vertices.select("sid", F.col("v").alias("u")).distinct()
    return edge_list(edges_).join(one, ["sid", "u"], "left_semi").join(vertices.select("sid", "v").distinct(), ["sid", "v"], "left_semi")


def stem_overlaps(ref: DataFrame, test: DataFrame) -> DataFrame:
    """Pairs of reference and test stems whose left halves and right halves overlap, with the overlaps' sizes.

    both, rlen, tlen, maxlen: common bases, bases of the reference stem, of the test stem, and of the longer halves."""
    r, t = prefixed(ref, "r_"), prefixed(test, "t_")
    on = (F.col("t_lbegin") <= F.col("r_lend")) & (F.col("t_lend") >= F.col("r_lbegin")) & (F.col("t_rbegin") <= F.col("r_rend")) & (F.col("t_rend") >= F.col("r_rbegin"))
    size = lambda p, s: F.col(f"{p}{s}end") - F.col(f"{p}{s}begin") + 1
    common = lambda s: F.least(f"r_{s}end", f"t_{s}end") - F.greatest(f"r_{s}begin", f"t_{s}begin") + 1
    span = lambda p: (F.col(f"{p}lbegin"), F.col(f"{p}lend"))
    return (
        meeting(r, t, span("r_"), span("t_"))
        .where(on)
        .select(
            "sid",
            "r_v",
            "t_v",
            (common("l") + common("r")).alias("both"),
            (size("r_", "l") + size("r_", "r")).alias("rlen"),
            (size("t_", "l") + size("t_", "r")).alias("tlen"),
            (F.greatest(size("r_", "l"), size("t_", "l")) + F.greatest(size("r_", "r"), size("t_", "r"))).alias("maxlen"),
        )
    )


def overlap_stats(overlaps: DataFrame) -> DataFrame:
    """Recall, precision, their mean and harmonic mean of each pair."""
    r, p = F.col("both") / F.col("rlen"), F.col("both") / F.col("tlen")
    return overlaps.withColumns({"recall": r, "precision": p, "f1_mean": (r + p) / 2, "f1": 2 * r * p / (r + p)})


def best_matches(overlaps: DataFrame) -> DataFrame:
    """The best test stem of each reference stem by f1; ties go to the lower stem number."""
    w = Window.partitionBy("sid", "r_v").orderBy(F.desc("f1"), "t_v")
    return overlap_stats(overlaps).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _held(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs whose inner stem begins inside the outer one's loop."""
    return meeting(inner, outer, (F.col("c_lbegin"), F.col("c_lbegin")), (F.col("p_lend"), F.col("p_rbegin")))


def containment_parents(stems: DataFrame) -> DataFrame:
    """sid, v, parent: the tightest stem whose loop holds stem v (its left end before, its right begin after), or null.

    The parent is the container with the shortest span; ties go to the greater lbegin, then the lower number."""
    inner, outer = prefixed(stems, "c_"), prefixed(stems, "p_")
    held = _held(inner, outer).where((F.col("c_lbegin") >= F.col("p_lend")) & (F.col("c_rend") <= F.col("p_rbegin")) & (F.col("c_v") != F.col("p_v")))
    least = held.groupBy("sid", F.col("c_v").alias("v")).agg(F.min_by("p_v", F.struct(F.col("p_rend") - F.col("p_lbegin"), -F.col("p_lbegin"), "p_v")).alias("parent"))
    return stems.select("sid", "v").join(least, ["sid", "v"], "left")


def containment_links(stems: DataFrame, center: float | None = None) -> DataFrame:
    """sid, parent, v: direct containments of the reticulated graph (a stem may have several parents).

    A link is direct when no third stem lies between: the transitive reduction, as an anti-join of the containments
    with their own composition.  With ``center`` only stems whose middles are at most that far apart are related."""
    inner, outer = prefixed(stems, "c_"), prefixed(stems, "p_")
    on = (F.col("c_lbegin") >= F.col("p_lend")) & (F.col("c_rend") <= F.col("p_rbegin")) & (F.col("c_v") != F.col("p_v"))
    if center is not None:
        mid = lambda p: (F.col(f"{p}lbegin") + F.col(f"{p}lend") + F.col(f"{p}rbegin") + F.col(f"{p}rend")) / 4
        on = on & (F.abs(mid("c_") - mid("p_")) <= center)
    held = _held(inner, outer).where(on).select("sid", F.col("p_v").alias("parent"), F.col("c_v").alias("v"))
    longer = held.withColumnRenamed("v", "between").join(held.withColumnRenamed("parent", "between"), ["sid", "between"]).select("sid", "parent", "v")
    return held.join(longer, ["sid", "parent", "v"], "left_anti")


def child_counts(parents: DataFrame) -> DataFrame:
    """Children of each stem in the containment forest; parent null are the roots."""
    return parents.groupBy("sid", "parent").agg(F.count(F.lit(1)).alias("children"))


def merge_candidates(stems: DataFrame, case: int, center: float = 6, gap: int = 4) -> DataFrame:
    """Pairs u < v that a merge rule applies to, with the merged halves.

    1 both halves of one lie in the other's; 2 both halves overlap and centers are near; 3 nested with small gaps on
    both sides; 4 one half overlaps and the other's gap is small; 5 serial siblings whose neighbouring halves overlap."""
    c = F.col
    p = pairs_of_stems(stems)
    within = lambda x, y, s: (c(f"{x}{s}begin") >= c(f"{y}{s}begin")) & (c(f"{x}{s}end") <= c(f"{y}{s}end"))
    over = lambda s: (c(f"a_{s}begin") <= c(f"b_{s}end")) & (c(f"b_{s}begin") <= c(f"a_{s}end"))
    mid = lambda x: (c(f"{x}lbegin") + c(f"{x}lend") + c(f"{x}rbegin") + c(f"{x}rend")) / 4
    lgap, rgap = c("b_lbegin") - c("a_lend") - 1, c("a_rbegin") - c("b_rend") - 1
    inside = within("a_", "b_", "l") & within("a_", "b_", "r") | within("b_", "a_", "l") & within("b_", "a_", "r")
    rule = {
        1: inside,
        2: ~inside & over("l") & over("r") & (F.abs(mid("a_") - mid("b_")) <= center),
        3: (lgap >= 0) & (rgap >= 0) & (lgap <= gap) & (rgap <= gap),
        4: over("l") & ~over("r") & (F.abs(rgap) <= gap) | over("r") & ~over("l") & (F.abs(lgap) <= gap),
        5: ~over("l") & ~over("r") & (c("a_rbegin") <= c("b_lend")) & (c("b_lbegin") <= c("a_rend")),
    }[case]
    low = lambda n: F.least(f"a_{n}", f"b_{n}").alias(n)
    high = lambda n: F.greatest(f"a_{n}", f"b_{n}").alias(n)
    return p.where(rule).select("sid", c("a_v").alias("u"), c("b_v").alias("v"), low("lbegin"), high("lend"), low("rbegin"), high("rend"))
