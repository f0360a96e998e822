"""Enumeration of structures and motifs: perfect matchings, serial structures, motif tables with their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import with_codes
from ..functions.notation import pairs_canonical, pairs_connected, pairs_reverse, pairs_to_graph, serial_canonical, serial_connected, serial_strings, serial_to_graph


def pairings(spark: SparkSession, n: int) -> DataFrame:
    """stems, pairs: all indecomposable perfect matchings of 2m points for m = 1..n (no prefix of the points is closed).

    A recursion over positions: each point opens a stem or closes one of the open ones; the count of open stems must not
    fall to zero before the end.  ``serial`` is the stem at each point so far, ``open`` the open stems."""
    # one level for each point: a level is a projection with an explode, and the plan has 2n of them
    now = spark.range(1, n + 1).select(F.col("id").cast("int").alias("stems"), F.array(F.lit(0)).alias("serial"), F.array(F.lit(0)).alias("open"), F.lit(1).alias("used"))
    for at in range(1, 2 * n):
        live = F.col("stems") * 2 > at
        opened = F.when(F.col("used") < F.col("stems"), F.array(F.struct(F.concat("serial", F.array("used")).alias("serial"), F.concat("open", F.array("used")).alias("open"), (F.col("used") + 1).alias("used")))).otherwise(F.array().cast("array<struct<serial:array<int>,open:array<int>,used:int>>"))
        last = F.col("stems") * 2 == at + 1
        can_close = last | (F.size("open") > 1)
        closed = F.transform(F.col("open"), lambda s: F.struct(F.concat("serial", F.array(s)).alias("serial"), F.array_remove("open", s).alias("open"), F.col("used").alias("used")))
        steps = F.concat(opened, F.when(can_close, closed).otherwise(F.array().cast("array<struct<serial:array<int>,open:array<int>,used:int>>")))
        done = F.array(F.struct("serial", "open", "used"))
        now = now.select("stems", F.explode(F.when(live, steps).otherwise(done)).alias("x")).select("stems", "x.*")
        # enough points must be left to close what is open
        now = now.where(F.size("open") <= F.greatest(F.col("stems") * 2 - at - 1, F.lit(0)))
    return now.where((F.size("open") == 0) & (F.col("used") == F.col("stems"))).select("stems", "serial")


def motif_table(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """(motifs: code, n_stems; parents: code, parent) of all connected graphs of structures of 2 to n stems.

    One of two mirror structures is enough (their graphs have one code up to the direction of reading, and both are
    kept where codes differ); immediate parents lack one stem and are connected."""
    from .clusters import checkpointed

    # enumerated once: the list is read for the motifs and for their parents
    all_ = checkpointed(pairings(spark, n).where("stems > 1"))
    with_code = checkpointed(with_codes(all_, serial_to_graph(F.col("serial")))).where("code is not null")
    motifs = with_code.groupBy("code").agg(F.max("stems").alias("n_stems"))
    one = with_code.groupBy("code").agg(F.min_by("serial", F.array_join("serial", ",")).alias("serial"), F.max("stems").alias("stems"))
    less = one.where("stems > 2").select("code", F.explode(F.array_distinct("serial")).alias("gone"), "serial")
    less = less.select("code", serial_canonical(F.filter("serial", lambda x: x != F.col("gone"))).alias("serial"))
    less = less.where(F.size(serial_connected(F.col("serial"))) == 1)
    parents = with_codes(less, serial_to_graph(F.col("serial")), "parent").select("code", "parent").where("parent is not null").distinct()
    return motifs, parents


def ancestors(parents: DataFrame, most: int = 20) -> DataFrame:
    """code, parent over any number of steps, each pair once, by joins until nothing new is found."""
    from .clusters import checkpointed

    known = checkpointed(parents.select("code", "parent").distinct())
    size = known.count()
    for _ in range(most):
        step = known.join(known.select(F.col("code").alias("parent"), F.col("parent").alias("up")), "parent").select("code", F.col("up").alias("parent"))
        known = checkpointed(known.unionAll(step).distinct())
        now = known.count()
        if now == size:
            break
        size = now
    return known


def level_counts(motifs: DataFrame) -> DataFrame:
    """n_stems, n, total: motifs of each size and up to it."""
    from pyspark.sql import Window

    n = motifs.groupBy("n_stems").agg(F.countDistinct("code").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.orderBy("n_stems").rowsBetween(Window.unboundedPreceding, 0)))


def add_stem_all(serial: DataFrame) -> DataFrame:
    """Every structure with one more stem at every pair of places, in canonical form, each once; serial: a column of arrays."""
    n = F.size("serial")
    s = serial.select("serial", F.explode(F.sequence(F.lit(0), n)).alias("i")).select("serial", "i", F.explode(F.sequence(F.col("i"), n)).alias("j"))
    new = (n / 2).cast("int")
    put = F.concat(F.slice("serial", 1, F.col("i")), F.array(new), F.slice("serial", F.col("i") + 1, F.col("j") - F.col("i")), F.array(new), F.slice("serial", F.col("j") + 1, n))
    return s.select(serial_canonical(put).alias("serial")).distinct()


def add_stem_left(serial: DataFrame) -> DataFrame:
    """As ``add_stem_all``, the new stem beginning in the left half of the places."""
    n = F.size("serial")
    s = serial.select("serial", F.explode(F.sequence(F.lit(0), (n / 2).cast("int"))).alias("i")).select("serial", "i", F.explode(F.sequence(F.col("i"), n)).alias("j"))
    new = (n / 2).cast("int")
    put = F.concat(F.slice("serial", 1, F.col("i")), F.array(new), F.slice("serial", F.col("i") + 1, F.col("j") - F.col("i")), F.array(new), F.slice("serial", F.col("j") + 1, n))
    return s.select(serial_canonical(put).alias("serial")).distinct()


def add_stem_zero(serial: DataFrame) -> DataFrame:
    """The new stem begins before everything."""
    n = F.size("serial")
    s = serial.select("serial", F.explode(F.sequence(F.lit(0), n)).alias("j"))
    new = (n / 2).cast("int")
    return s.select(serial_canonical(F.concat(F.array(new), F.slice("serial", 1, F.col("j")), F.array(new), F.slice("serial", F.col("j") + 1, n))).alias("serial")).distinct()


def subtract_stem(serial: DataFrame) -> DataFrame:
    """serial, less: every structure without one of its stems, split to connected canonical parts of more than one stem."""
    s = serial.select("serial", F.explode(F.array_distinct("serial")).alias("gone"))
    parts = s.select("serial", F.explode(serial_connected(F.filter("serial", lambda x: x != F.col("gone")))).alias("part"))
    return parts.select("serial", serial_canonical(F.col("part")).alias("less")).where(F.size("less") > 2).distinct()


def grow_structures(spark: SparkSession, n: int) -> DataFrame:
    """stems, serial of all structures of 1 to n stems, one of each pair of mirror images, by growth from a single stem."""
    from .clusters import checkpointed

    now = spark.sql("select array(0, 0) as serial")
    out = now.select(F.lit(1).alias("stems"), "serial")
    for k in range(2, n + 1):
        now = add_stem_all(now).withColumn("_key", serial_strings(F.col("serial"))["first"])
        now = checkpointed(now.groupBy("_key").agg(F.min_by("serial", F.array_join("serial", " ")).alias("serial")).drop("_key"))
        out = out.unionAll(now.select(F.lit(k).alias("stems"), "serial"))
    return out


def new_structures(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pair structures (pairs) of ``found`` that ``known`` has in neither direction."""
    key = lambda d: d.withColumn("_key", F.least(F.array_join(pairs_canonical(F.col("pairs")), ","), F.array_join(pairs_reverse(F.col("pairs")), ",")))
    return key(found).dropDuplicates(["_key"]).join(key(known).select("_key"), "_key", "left_anti").drop("_key")


def random_structures(spark: SparkSession, count: int, stems: int, seed: int = 1) -> DataFrame:
    """id, pairs: random perfect matchings of 2 * stems points, every matching equally likely; equal seeds give equal rows."""
    n = 2 * stems
    shuffled = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("id"), i).alias("h"), i.alias("i")))), lambda x: x["i"].cast("int"))
    return spark.range(count).select("id", pairs_canonical(shuffled).alias("pairs"))


def connected_only(structures: DataFrame) -> DataFrame:
    return structures.where(pairs_connected(F.col("pairs")))


def graph_codes(structures: DataFrame) -> DataFrame:
    """Structures with their graph's canonical code (null where no two stems are linked)."""
    return with_codes(structures, pairs_to_graph(F.col("pairs")))
