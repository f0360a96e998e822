"""Pairwise similarity of fingerprints and group distributions.

Pairs come from an inverted index: fingerprints are joined on their motifs; a motif of very many fingerprints is dealt to
several parts, so that its pairs, which are as many as its fingerprints' square, are made by several tasks.  (Leave out
motifs that are common by ``fingerprints.restrict`` where they tell nothing.)  Pairs without a common motif have
similarity 0 and are only made by ``all_pairs``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .clusters import checkpointed
from .ordered import running_sums


def shared(fp: DataFrame, per: int = 2000) -> DataFrame:
    """id1 < id2, n_both, min_sum of all pairs with a common motif; a motif of more than ``per`` fingerprints is dealt to parts."""
    a = fp.select(F.col("id").alias("id1"), "code", F.col("cnt").alias("c1"))
    b = fp.select(F.col("id").alias("id2"), "code", F.col("cnt").alias("c2"))
    on = ["code"]
    hot = fp.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per).select("code", F.ceil(F.col("n") / per).cast("int").alias("parts"))
    if hot.limit(1).count():
        parts = F.coalesce("parts", F.lit(1))
        a = a.join(hot, "code", "left").withColumn("part", F.pmod(F.xxhash64("id1"), parts).cast("int")).drop("parts")
        b = b.join(hot, "code", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        on = ["code", "part"]
    return a.join(b, on).where("id1 < id2").groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n_both"), F.sum(F.least("c1", "c2")).alias("min_sum"))


def sized_pairs(fp: DataFrame) -> DataFrame:
    """Pairs with a common motif and both sides' sizes: n1, n2 motifs, s1, s2 counts."""
    size = fp.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("s"))
    one = size.select(F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("s").alias("s1"))
    two = size.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    return shared(fp).join(one, "id1").join(two, "id2")


def with_measures(pairs: DataFrame) -> DataFrame:
    """jaccard, overlap (shared over the smaller set), count_similarity (2 sum min / sum), bray_curtis (1 - 2 shared / sizes)."""
    both = F.col("n_both")
    return pairs.select(
        "id1",
        "id2",
        (both / (F.col("n1") + F.col("n2") - both)).alias("jaccard"),
        (both / F.least("n1", "n2")).alias("overlap"),
        (2 * F.col("min_sum") / (F.col("s1") + F.col("s2"))).alias("count_similarity"),
        (1 - 2 * both / (F.col("n1") + F.col("n2"))).alias("bray_curtis"),
    )


def measures(fp: DataFrame) -> DataFrame:
    return with_measures(sized_pairs(fp))


def all_pairs(ids: DataFrame, pairs: DataFrame, bray_curtis_empty: float = 1.0) -> DataFrame:
    """Every pair of ids: 0 similarity and distance 1 where no motif is shared, also where one side is empty.

    The result has n(n-1)/2 rows by definition; it is for reports on sets of structures of a chosen size."""
    one, two = ids.select(F.col("id").alias("id1")), ids.select(F.col("id").alias("id2"))
    grid = one.join(two, F.col("id1") < F.col("id2"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("jaccard", "overlap", "count_similarity")}
    return grid.join(pairs, ["id1", "id2"], "left").withColumns(zero | {"bray_curtis": F.coalesce("bray_curtis", F.lit(bray_curtis_empty))})


def _packed(source, least: int = 100_000):
    """Rows (at, code, c), ordered by code -> blocks of whole codes: how many rows each has, and these rows' places and counts."""
    held, rows = [], 0

    def out(table: pa.Table) -> pa.RecordBatch:
        code = table["code"].combine_chunks().dictionary_encode().indices.to_numpy()
        size = np.diff(np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)))
        c = table["c"].to_numpy()
        c = c.astype("u1" if c.max() < 256 else "<i8")
        return pa.record_batch([pa.array([x.tobytes()]) for x in (size.astype("<i4"), table["at"].to_numpy().astype("<i4"), c)], ["size", "at", "c"])

    for batch in source:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            last = pc.index(table["code"], table["code"][rows - 1]).as_py()  # the last code may go on
            if last:
                yield out(table.slice(0, last))
            held, rows = table.slice(last).to_batches(), rows - last
    if rows:
        yield out(pa.Table.from_batches(held))


def _stripes(ids: pa.Array, per: int, many: np.ndarray, total: np.ndarray, bray_curtis_empty: float):
    """Rows (stripe, size, at, c), a stripe's blocks together -> the measures of all pairs whose first id is in the stripe."""
    n = len(ids)

    def run(source):
        now = both = least = None

        def out():
            for i in range(now * per, min(n, now * per + per)):
                for j in range(i + 1, n, 10_000):
                    to = slice(j, min(n, j + 10_000))
                    x, m, t = both[i - now * per, to], many[i] + many[to], total[i] + total[to]
                    some = x > 0
                    part = lambda a, b, none=0.0: np.divide(a, b, out=np.full(len(x), none), where=some)  # noqa: B023, E731
                    bray = np.where(some, 1 - part(2 * x, m), bray_curtis_empty)
                    measures = part(x, m - x), part(x, np.minimum(many[i], many[to])), part(2 * least[i - now * per, to], t), bray
                    yield pa.record_batch([pa.repeat(ids[i], len(x)), ids.slice(j, len(x)), *map(pa.array, measures)], PAIRS)

        for batch in source:
            for k, stripe in enumerate(batch.column("stripe").to_pylist()):
                if stripe != now:
                    if now is not None:
                        yield from out()
                    now, both, least = stripe, np.zeros((per, n), np.int64), np.zeros((per, n), np.int64)
                size, at = (np.frombuffer(batch.column(c)[k].as_buffer(), "<i4") for c in ("size", "at"))
                c = batch.column("c")[k].as_buffer()
                c = np.frombuffer(c, "u1" if len(at) == c.size else "<i8").astype(np.int64)
                start = np.cumsum(size) - size
                mine = np.flatnonzero((at >= now * per) & (at < now * per + per))
                code = np.searchsorted(start, mine, "right") - 1
                for some in np.array_split(np.arange(len(mine)), 1 + (int(size[code].sum()) >> 22)):
                    times = size[code[some]]
                    x = np.repeat(mine[some], times)
                    y = np.repeat(start[code[some]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    cell = (at[x] - now * per).astype(np.int64) * n + at[y]
                    np.add.at(both.reshape(-1), cell, 1)
                    np.add.at(least.reshape(-1), cell, np.minimum(c[x], c[y]))
        if now is not None:
            yield from out()

    return run


PAIRS = ["id1", "id2", "jaccard", "overlap", "count_similarity", "bray_curtis"]


def every_pair(ids: DataFrame, fp: DataFrame, bray_curtis_empty: float = 1.0, cells: int = 16_000_000) -> DataFrame:
    """As ``all_pairs`` of ``measures(fp)``, made in place: fingerprints are packed once, by motif, and each task counts the pairs of
    a stripe of first ids in arrays of about ``cells`` (or one id's) while it reads them all; no pair is shuffled.

    The result has n(n-1)/2 rows, and the work grows as they do; the ids and their sizes are held in one place."""
    spark = ids.sparkSession
    size = fp.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("s"))
    order = ids.where("id is not null").distinct().join(size, "id", "left").orderBy("id").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "s"))).toArrow()
    n, name, kind = order.num_rows, order["id"].combine_chunks(), ids.schema["id"].dataType
    places = spark.createDataFrame(pa.table({"at": pa.array(np.arange(n, dtype=np.int32)), "id": name}), StructType([StructField("at", IntegerType()), StructField("id", kind)]))
    rows = fp.where("code is not null").join(F.broadcast(places), "id").select("at", "code", F.col("cnt").cast("long").alias("c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = checkpointed(rows.repartition(parts, "code").sortWithinPartitions("code").mapInArrow(_packed, "size binary, at binary, c binary"))
    per = max(1, min(cells // max(n, 1), -(-n // parts)))
    each = spark.range(0, -(-n // per), 1, max(1, -(-n // per))).select(F.col("id").cast("int").alias("stripe"))
    # an empty block, so that a stripe without motifs has its rows too
    blocks = packed.unionAll(spark.createDataFrame([(bytearray(), bytearray(), bytearray())], packed.schema)).coalesce(1)
    run = _stripes(name, per, order["n"].to_numpy(), order["s"].to_numpy(), bray_curtis_empty)
    return each.hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(run, StructType([StructField(c, kind if i < 2 else DoubleType()) for i, c in enumerate(PAIRS)]))


def labelled(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs with is_pos: both ids of one group (id, grp)."""
    one = groups.select(F.col("id").alias("id1"), F.col("grp").alias("g1"))
    two = groups.select(F.col("id").alias("id2"), F.col("grp").alias("g2"))
    return pairs.join(one, "id1").join(two, "id2").withColumn("is_pos", F.col("g1") == F.col("g2")).drop("g1", "g2")


def distance_report(pairs: DataFrame) -> DataFrame:
    """The distance table as written: three decimals."""
    return pairs.select("id1", "id2", F.round("overlap", 3).alias("jaccard"), F.round("bray_curtis", 3).alias("bray_curtis"))


def extremes(pairs: DataFrame) -> DataFrame:
    one = lambda c: [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return pairs.agg(*one("jaccard"), *one("bray_curtis"), F.count_if("is_pos").alias("n_pos"), F.count_if(~F.col("is_pos")).alias("n_neg"))


def entropies(counts: DataFrame, prior: float = 0.0) -> DataFrame:
    """code, entropy (bits) of each motif's distribution over groups, less a prior entropy; counts: grp, code, n."""
    total = counts.groupBy("code").agg(F.sum("n").alias("total"))
    f = F.col("n") / F.col("total")
    return counts.join(total, "code").groupBy("code").agg((-F.sum(F.when(F.col("n") > 0, f * F.log2(f)).otherwise(0.0)) - prior).alias("entropy"))


def binary_entropies(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """grp, code, entropy (bits) of having the motif or not among the group's structures; counts: grp, code, n; sizes: grp, size."""
    p = F.col("n") / F.col("size")
    part = lambda x: F.when((x > 0) & (x < 1), -x * F.log2(x)).otherwise(0.0)
    return counts.join(sizes, "grp").select("grp", "code", (part(p) + part(1 - p)).alias("entropy"))


def jensen_shannon(p: DataFrame) -> DataFrame:
    """grp1 < grp2, code, jsd: each motif's part of the divergence (natural logarithm) of two groups' distributions (grp, code, p)."""
    a = p.select(F.col("grp").alias("grp1"), "code", F.col("p").alias("p1"))
    b = p.select(F.col("grp").alias("grp2"), "code", F.col("p").alias("p2"))
    m = (F.col("p1") + F.col("p2")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    return a.join(b, "code").where("grp1 < grp2").select("grp1", "grp2", "code", ((part("p1") + part("p2")) / 2).alias("jsd"))


def group_divergence(p: DataFrame) -> DataFrame:
    return jensen_shannon(p).groupBy("grp1", "grp2").agg(F.sum("jsd").alias("jsd"))


def feature_coverage(ranked: DataFrame, share: float = 0.9) -> DataFrame:
    """Rows of (rank, feature) up to the first rank at which more than ``share`` of all features have been seen: rank, seen.

    A feature counts at its first rank, so the running number of distinct features is a running sum over ranks."""
    first = ranked.groupBy("feature").agg(F.min("rank").alias("rank"))
    new = first.groupBy("rank").agg(F.count(F.lit(1)).alias("new"))
    steps = ranked.select("rank").distinct().join(new, "rank", "left").select("rank", F.coalesce("new", F.lit(0)).alias("new"))
    total = first.agg(F.count(F.lit(1)).alias("total"))  # one row
    seen = running_sums(steps, F.asc("rank"), {"new": "seen"}).crossJoin(F.broadcast(total))
    return seen.where(F.col("seen") - F.col("new") <= share * F.col("total")).select("rank", "seen")


def to_distance(pairs: DataFrame, big: float = 1.0, column: str = "jaccard") -> DataFrame:
    return pairs.select("id1", "id2", (big - F.col(column)).alias("distance"))
