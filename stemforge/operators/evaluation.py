"""Accuracy of stems, bases, pairs and motifs against a reference; ROC curves; reports by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sums
from .relations import pseudoknots, stem_overlaps


def matched_ids(overlaps: DataFrame) -> DataFrame:
    """sid, tp_ref, tp_test: stems of either side with a partner."""
    return overlaps.groupBy("sid").agg(F.countDistinct("r_v").alias("tp_ref"), F.countDistinct("t_v").alias("tp_test"))


def stem_accuracy(ref: DataFrame, test: DataFrame) -> DataFrame:
    """sid, n_ref, n_test, tp_ref, tp_test, recall, precision, jaccard of every structure on either side."""
    n = lambda d, c: d.groupBy("sid").agg(F.count(F.lit(1)).alias(c))
    out = n(ref, "n_ref").join(n(test, "n_test"), "sid", "full").join(matched_ids(stem_overlaps(ref, test)), "sid", "left").fillna(0)
    return out.select(
        "*",
        F.coalesce(F.try_divide("tp_ref", "n_ref"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide("tp_test", "n_test"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp_ref") + F.col("tp_test"), F.col("n_ref") + F.col("n_test")), F.lit(0.0)).alias("jaccard"),
    )


def pseudoknot_recall(edges: DataFrame, overlaps: DataFrame) -> DataFrame:
    """sid, n_pairs, n_found, recall: o pairs of the reference whose stems are both matched."""
    hit = overlaps.select("sid", "r_v").distinct()
    o = pseudoknots(edges)
    one = hit.select("sid", F.col("r_v").alias("u"), F.lit(1).alias("hu"))
    two = hit.select("sid", F.col("r_v").alias("v"), F.lit(1).alias("hv"))
    both = o.join(one, ["sid", "u"], "left").join(two, ["sid", "v"], "left").withColumn("ok", (F.col("hu").isNotNull() & F.col("hv").isNotNull()).cast("int"))
    return both.groupBy("sid").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("ok").alias("n_found"), F.avg("ok").alias("recall"))


def base_bits(ref: DataFrame, test: DataFrame) -> DataFrame:
    """sid, pos, bits: 1 in a reference half-stem, 2 in a test half-stem (3 in both); every test stem is mapped."""

    def at(d, bit):
        halves = F.array_union(F.sequence("lbegin", "lend"), F.sequence("rbegin", "rend"))
        return d.select("sid", F.explode(halves).alias("pos"), F.lit(bit).alias("bit"))

    return at(ref, 1).unionAll(at(test, 2)).groupBy("sid", "pos").agg(F.bit_or("bit").alias("bits"))


def base_accuracy(bits: DataFrame) -> DataFrame:
    """sid, n_ref, n_test, n_both, recall, precision, f1_mean, f1."""
    n = lambda k: F.count_if(F.col("bits").bitwiseAND(F.lit(k)) == k)
    out = bits.groupBy("sid").agg(n(1).alias("n_ref"), n(2).alias("n_test"), n(3).alias("n_both"))
    r, p = F.coalesce(F.try_divide("n_both", "n_ref"), F.lit(0.0)), F.coalesce(F.try_divide("n_both", "n_test"), F.lit(0.0))
    return out.select("*", r.alias("recall"), p.alias("precision"), ((r + p) / 2).alias("f1_mean"), F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0)).alias("f1"))


def roc_points(scored: DataFrame, high: bool = True) -> DataFrame:
    """score, pos, neg, tp, fp in order of score: one row for all equal scores, so ties are one step; scored: score, is_pos."""
    g = scored.groupBy("score").agg(F.count_if("is_pos").alias("pos"), F.count_if(~F.col("is_pos")).alias("neg"))
    return running_sums(g, F.desc("score") if high else F.asc("score"), {"pos": "tp", "neg": "fp"})


def roc_auc(scored: DataFrame, high: bool = True) -> DataFrame:
    """n_pos, n_neg, auc by trapezoids; auc is null where a class is empty."""
    return roc_points(scored, high).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.try_divide(F.sum((F.col("tp") - F.col("pos") / 2) * F.col("neg")), F.sum("pos") * F.sum("neg")).alias("auc"),
    )


def report(rows: DataFrame, params: list[str], family: str, values: list[str]) -> DataFrame:
    """Means of values by parameters and family, and by parameters over all families ('all'), in one pass."""
    keys = [F.col(p) for p in params]
    view = rows.groupingSets([[*keys, F.col(family)], keys], *keys, F.col(family))
    view = view.agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))
    return view.select(*params, F.coalesce(F.col(family).cast("string"), F.lit("all")).alias(family), "n", *values)


def best_parameters(rows: DataFrame, params: list[str], value: str) -> DataFrame:
    """Parameters in order of their mean value, best first."""
    return rows.groupBy(*params).agg(F.avg(value).alias(value)).orderBy(F.desc(value), *params)


def best_condition(rows: DataFrame, family: str, condition: str, value: str) -> DataFrame:
    """The condition with the largest mean value of each family; ties go to the lesser condition."""
    m = rows.groupBy(family, condition).agg(F.avg(value).alias(value))
    w = Window.partitionBy(family).orderBy(F.desc(value), condition)
    return m.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def missing_outputs(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(found, keys, "left_anti")


def replicate_stats(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"))


def paired(ref: DataFrame, test: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """(matches, missing) of two file lists on a name derived alike: missing are test files without a reference."""
    r, t = ref.withColumn("name", name), test.withColumn("name", name)
    return t.withColumnRenamed("path", "test_path").join(r.withColumnRenamed("path", "ref_path"), "name"), t.join(r, "name", "left_anti")
