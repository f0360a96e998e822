"""Connectivity-table (CT) files with one or many structures: parsed as whole texts, a file a row.

Header lines: ``n ENERGY = e id``, ``n dG = e id`` or ``n id`` (no energy).  Base lines have six columns.  Blank lines and
comments (#) are skipped; a line that is neither raises an error in the strict reader and is dropped otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name


def is_header(f: Column) -> Column:
    """Of the tokens of a line."""
    marked = F.upper(F.coalesce(F.get(f, F.lit(1)), F.lit(""))).isin("ENERGY", "DG")
    return F.get(f, F.lit(0)).rlike(r"^\d+$") & (marked | (F.size(f) == 2))


def is_data(f: Column) -> Column:
    return (F.size(f) == 6) & F.forall(F.array(*(F.get(f, F.lit(i)) for i in (0, 2, 3, 4, 5))), lambda x: x.rlike(r"^-?\d+$"))


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """file, struct_no, seq_id, seq_len, energy, pos, base, prev, next, ppos: a row a base."""
    return parse(spark.read.text(path, wholetext=True).select(base_name(F.col("_metadata.file_path")).alias("file"), "value"), strict)


def parse(files: DataFrame, strict: bool = False) -> DataFrame:
    """Bases of whole texts (file, value)."""
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("f", F.filter(F.split(F.trim(F.regexp_replace("line", "=", " = ")), r"\s+"), lambda x: x != "")).where((F.size("f") > 0) & ~F.col("line").startswith("#"))
    lines = lines.withColumns({"head": is_header(F.col("f")), "data": is_data(F.col("f"))})
    if strict:
        lines = lines.withColumn("data", F.when(F.col("head") | F.col("data"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("not a CT line: "), F.col("line"))).cast("boolean")))
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line_no")
    has_energy = F.upper(F.get("f", F.lit(1))).isin("ENERGY", "DG")
    h = F.when(F.col("head"), F.struct(F.get("f", F.lit(0)).cast("int").alias("seq_len"), F.when(has_energy, F.get("f", F.lit(3)).cast("double")).alias("energy"), F.when(has_energy, F.get("f", F.lit(4))).otherwise(F.get("f", F.lit(1))).alias("seq_id")))
    lines = lines.withColumns({"h": F.last(h, ignorenulls=True).over(w), "struct_no": (F.sum(F.col("head").cast("int")).over(w) - 1).cast("int")})
    n = lambda i: F.get("f", F.lit(i)).cast("int")
    return lines.where("data and not head and h is not null").select(
        "file", "struct_no", F.col("h.seq_id").alias("seq_id"), F.col("h.seq_len").alias("seq_len"), F.col("h.energy").alias("energy"), n(0).alias("pos"), F.get("f", F.lit(1)).alias("base"), n(2).alias("prev"), n(3).alias("next"), n(4).alias("ppos")
    )


def headers(bases: DataFrame) -> DataFrame:
    """sid (file), struct_no, energy, seq_len: a row a structure."""
    return bases.groupBy(F.col("file").alias("sid"), "struct_no").agg(F.max("energy").alias("energy"), F.max("seq_len").alias("seq_len"))


def sequences(bases: DataFrame) -> DataFrame:
    """sid, sequence: of each file's first structure."""
    first = bases.where("struct_no = 0").groupBy(F.col("file").alias("sid"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("sequence"))


def within_ddg(bases: DataFrame, ddg: float = 4.0) -> DataFrame:
    """Bases of the structures before the first one whose energy is above the first's by more than ddg; files without energies are kept."""
    from ..operators.stems import energy_takewhile

    good = energy_takewhile(headers(bases).where("energy is not null"), ddg).select(F.col("sid").alias("file"), "struct_no")
    plain = headers(bases).where("energy is null").select(F.col("sid").alias("file"), "struct_no")
    return bases.join(good.unionAll(plain), ["file", "struct_no"], "left_semi")


def stems(bases: DataFrame, unpaired: int = 2) -> DataFrame:
    """Stems of every structure (sid = file:struct_no), as ``operators.stems.stems_from_pairs``."""
    from ..operators.stems import stems_from_pairs

    p = bases.where("ppos > pos").select(F.concat_ws(":", "file", F.col("struct_no").cast("string")).alias("sid"), "pos", "ppos")
    return stems_from_pairs(p, unpaired)


def stems_and_edges(bases: DataFrame, ddgs: list[float], minbp: int = 3, unpaired: int = 2, minlen: int = 3) -> tuple[DataFrame, DataFrame]:
    """(ddg, stems; ddg, sid, u, v, etype) of the structures within each energy limit, the way from a CT file to its graphs.

    Stems are found once and numbered along each structure; a limit only chooses structures (files without energies are
    kept at each).  Short stems go with their edges."""
    from pyspark.sql import Window

    from ..operators.relations import edge_type_minlen, edges
    from ..operators.stems import long_stems

    found = long_stems(stems(bases, unpaired), minbp).withColumn("v", F.row_number().over(Window.partitionBy("sid").orderBy("lbegin", "rbegin", "stem")) - 1)
    chosen = None
    for ddg in ddgs:
        one = headers(within_ddg(bases, ddg)).select(F.lit(float(ddg)).alias("ddg"), F.concat_ws(":", "sid", F.col("struct_no").cast("string")).alias("sid"))
        chosen = one if chosen is None else chosen.unionAll(one)
    linked = edges(found, edge_type_minlen(minlen))
    return chosen.join(found, "sid"), chosen.join(linked, "sid").select("ddg", "sid", "u", "v", "etype")


def write(bases: DataFrame) -> DataFrame:
    """file, text: CT text of each file, its structures in order."""
    energy = F.when(F.col("energy").isNotNull(), F.concat(F.lit("  ENERGY = "), F.col("energy").cast("string"))).otherwise(F.lit(""))
    base = F.format_string("%5d %s %7d %4d %4d %4d", "pos", "base", "prev", "next", "ppos", "pos")
    rows = bases.groupBy("file", "struct_no").agg(F.max(F.format_string("%5d", "seq_len")).alias("n"), F.max(energy).alias("e"), F.max("seq_id").alias("id"), F.array_sort(F.collect_list(F.struct("pos", base.alias("t")))).alias("rows"))
    block = F.concat(F.col("n"), F.col("e"), F.lit("   "), F.col("id"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["t"]), "\n"))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("struct_no", block.alias("t")))), lambda r: r["t"]), "\n").alias("text"))


def pairs_from_text(texts: DataFrame) -> DataFrame:
    """sid, pos, ppos of texts (sid, value) of pair lines ``pos ppos``."""
    lines = texts.select("sid", F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\d+)\s+(\d+)\s*$"), F.lit(0))).alias("line"))
    f = F.split(F.trim("line"), r"\s+")
    return lines.select("sid", F.get(f, F.lit(0)).cast("int").alias("pos"), F.get(f, F.lit(1)).cast("int").alias("ppos"))
