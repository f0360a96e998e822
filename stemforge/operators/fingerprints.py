"""Fingerprints: multisets of motifs by structure, document frequencies, selection, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Motifs of a block, of blocks that are broadcast at most, and the least number of parts that a grid is dealt to.
BLOCK, FEW_CODES, TILES = 1 << 12, 4_000_000, 256


def fingerprint(rows: DataFrame) -> DataFrame:
    """id, code, cnt summed."""
    return rows.groupBy("id", "code").agg(F.sum("cnt").alias("cnt"))


def totals(fp: DataFrame) -> DataFrame:
    """id, total, n_motifs, least count and a motif that has it (the first in order); null where there is none."""
    return fp.groupBy("id").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_motifs"), F.min("cnt").alias("mincount"), F.min_by("code", F.struct("cnt", "code")).alias("minkey"))


def motif_totals(fp: DataFrame) -> DataFrame:
    return fp.groupBy("code").agg(F.sum("cnt").alias("total"))


def df_by_group(fp: DataFrame) -> DataFrame:
    """grp, code, df: structures with the motif in each group, and in all under grp 'all' (grouping sets, one pass)."""
    d = fp.select("id", "grp", "code").distinct()
    view = d.groupingSets([[F.col("grp"), F.col("code")], [F.col("code")]], F.col("grp"), F.col("code"))
    return view.agg(F.count(F.lit(1)).alias("df")).select(F.coalesce("grp", F.lit("all")).alias("grp"), "code", "df")


def group_sizes(fp: DataFrame) -> DataFrame:
    """grp, n: structures of each group and of all."""
    return fp.select("id", "grp").distinct().rollup("grp").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("grp", F.lit("all")).alias("grp"), "n")


def select_min_max(fp: DataFrame, least: int, most: int) -> DataFrame:
    """code, df, selected: whether the motif's document frequency lies in [least, most]."""
    d = fp.groupBy("code").agg(F.countDistinct("id").alias("df"))
    return d.withColumn("selected", F.col("df").between(least, most))


def restrict(fp: DataFrame, motifs: DataFrame) -> DataFrame:
    """Only the rows of listed motifs."""
    return fp.join(motifs.select("code").distinct(), "code", "left_semi").select(*fp.columns)


def fill_missing(fp: DataFrame) -> DataFrame:
    """Every structure with every motif that occurs, 0 where it has none: structures times motifs rows by definition, so restrict the motifs first.

    The motifs travel as ordered blocks of ``BLOCK``; each of a structure's own rows gives itself and the zeros between it and the one
    before it in its block, and a mark after each block the rest, so rows of the grid are made in place and not shuffled.  A task makes
    its blocks one after another, each for all its structures: so a column of a Parquet file repeats few motifs, and takes little room."""
    ids, codes = fp.select("id").distinct(), motif_index(fp)
    codes = codes.withColumn("_block", F.floor(F.col("idx") / BLOCK).cast("int")).withColumn("_at", (F.col("idx") % BLOCK).cast("int"))
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("_at", "code"))), lambda x: x["code"])
    blocks = codes.groupBy("_block").agg(F.max("_at").alias("_last"), all_of.alias("_all"))
    marks = ids.crossJoin(F.broadcast(blocks.select("_block", (F.col("_last") + 1).alias("_at")))).select("id", "_block", "_at", F.lit(None).cast("long").alias("cnt"), F.lit(False).alias("_own"))
    own = fp.where("id is not null").join(codes, "code").select("id", "_block", "_at", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"), F.lit(True).alias("_own"))
    before = F.lag("_at", 1, -1).over(Window.partitionBy("_block", "_deal", "id").orderBy("_at"))
    n = codes.count()
    deal = F.pmod(F.xxhash64("id"), F.lit(-(-TILES // -(-max(n, 1) // BLOCK)))).cast("int")  # few blocks are dealt by structures too
    rows = own.unionAll(marks).withColumn("_deal", deal).repartition("_block", "_deal").withColumn("_from", F.least(before + 1, F.col("_at")))
    rows = rows.withColumn("_n", F.col("_at") - F.col("_from") + F.col("_own").cast("int")).where("_n > 0")
    if n <= FEW_CODES:
        blocks = F.broadcast(blocks)
    part = F.posexplode(F.slice("_all", F.col("_from") + 1, F.col("_n"))).alias("_k", "code")
    out = rows.join(blocks.select("_block", "_all"), "_block").select("id", "cnt", "_own", "_n", part)
    return out.select("id", "code", F.when(F.col("_own") & (F.col("_k") == F.col("_n") - 1), F.col("cnt")).otherwise(F.lit(0)).cast("long").alias("cnt"))


def binary_matrix(fp: DataFrame) -> DataFrame:
    """id, code, present (0 or 1) of all pairs."""
    return fill_missing(fp).select("id", "code", (F.col("cnt") > 0).cast("int").alias("present"))


def pivoted(fp: DataFrame, codes: list[str]) -> DataFrame:
    """One column a motif of ``codes``."""
    return fp.groupBy("id").pivot("code", codes).agg(F.sum("cnt")).fillna(0)


def motif_index(fp: DataFrame) -> DataFrame:
    """code, idx: motifs numbered in order: running counts over range partitions, so no single task sorts all motifs."""
    from .ordered import running_sums

    rows = fp.select("code").distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sums(rows, F.asc("code"), {"_one": "idx"}).select("code", (F.col("idx") - 1).alias("idx"))


def bitmaps(fp: DataFrame, index: DataFrame) -> DataFrame:
    """id, bucket, bits: membership bitmaps of 32768 motifs each."""
    return fp.join(index, "code").groupBy("id", F.expr("bitmap_bucket_number(idx)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(idx))").alias("bits"))


def add_parents(fp: DataFrame, parents: DataFrame) -> DataFrame:
    """Every motif's count also added to each of its listed ancestors."""
    up = fp.join(parents, "code").select("id", F.col("parent").alias("code"), "cnt")
    return fingerprint(fp.select("id", "code", "cnt").unionAll(up))


def unknown_motifs(fp: DataFrame, motifs: DataFrame) -> DataFrame:
    """Motifs of fingerprints that the motif table lacks."""
    return fp.select("code").distinct().join(motifs, "code", "left_anti")


def membership(a: DataFrame, b: DataFrame) -> DataFrame:
    """code, side: 1 only in a, 2 only in b, 3 in both."""
    both = a.select("code", F.lit(1).alias("bit")).unionAll(b.select("code", F.lit(2).alias("bit")))
    return both.groupBy("code").agg(F.bit_or("bit").cast("int").alias("side"))


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_both, n_a, n_b, recall, precision, jaccard of two motif sets, a the reference."""
    n = membership(a, b).agg(*(F.count_if(F.col("side") == s).alias(x) for s, x in ((3, "n_both"), (1, "n_a"), (2, "n_b"))))
    both = F.col("n_both")
    return n.select(
        "*",
        F.try_divide(both, both + F.col("n_a")).alias("recall"),
        F.try_divide(both, both + F.col("n_b")).alias("precision"),
        F.try_divide(both, both + F.col("n_a") + F.col("n_b")).alias("jaccard"),
    )


def group_priors(fp: DataFrame, least: int = 5, most: int = 160) -> DataFrame:
    """grp, code, p: motif shares by group after dropping motifs outside least < df < most, smoothed by each motif's overall share.

    The prior of a motif is its document frequency over the sum of those kept, so priors sum to 1."""
    d = fp.select("id", "grp", "code").distinct()
    kept = d.groupBy("code").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") > least) & (F.col("df") < most))
    total = kept.agg(F.sum("df").alias("total"))
    prior = kept.crossJoin(F.broadcast(total)).select("code", (F.col("df") / F.col("total")).alias("prior"))
    n = d.join(prior, "code", "left_semi").groupBy("grp", "code").agg(F.count(F.lit(1)).alias("n"))
    groups = d.select("grp").distinct().agg(F.array_sort(F.collect_set("grp")).alias("_groups"))  # one row; groups are few by what they are
    grid = prior.crossJoin(F.broadcast(groups)).select(F.explode("_groups").alias("grp"), "code", "prior").join(n, ["grp", "code"], "left").withColumn("x", F.coalesce("n", F.lit(0)) + F.col("prior"))
    row = grid.groupBy("grp").agg(F.sum("x").alias("row"))
    return grid.join(row, "grp").select("grp", "code", (F.col("x") / F.col("row")).alias("p"))
