"""Connected components of large sparse graphs by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node links its neighbours (the larger ones, or the smaller ones and itself) to its least neighbour.

    The least neighbour is a pre-aggregated minimum that is joined back, so that no task gathers a hub's neighbours."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: longs); component is the least node that is reachable.

    Loops and repeated edges are allowed; an edge with a null end is no edge; no edge gives no row.  Each round is a
    table in the shared folder, so that a lost executor costs at most one round."""
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    for _ in range(most):
        mark = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        new = saved(_star(_star(now, True), False), name)
        remove(now)
        now = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
