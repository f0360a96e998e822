"""FASTA, fingerprint, distance, motif-list and motif-table files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import decode_dfs
from ..functions.names import base_name, group_of, wrapped


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


# -- FASTA ---------------------------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, id, doc, sequence of every record."""
    return parse_fasta(_whole(spark, path))


def parse_fasta(texts: DataFrame) -> DataFrame:
    """Records of whole texts (file, value)."""
    records = texts.select("file", F.explode(F.filter(F.split("value", r"(?m)^>"), lambda x: F.trim(x) != "")).alias("r"))
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    return records.select("file", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("doc"), F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s+", "").alias("sequence"))


def fasta_text(records: DataFrame, width: int = 100) -> DataFrame:
    """id, text: one FASTA record each, wrapped."""
    return records.select("id", F.concat(F.lit(">"), F.trim(F.concat_ws(" ", "id", "doc")), F.lit("\n"), wrapped(F.col("sequence"), width), F.lit("\n")).alias("text"))


# -- fingerprints ----------------------------------------------------------------------------------------------------


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, code, cnt of YAML fingerprint files: the lines after ``- motif:``; an empty file has no row."""
    return parse_fingerprints(_whole(spark, path))


def parse_fingerprints(texts: DataFrame) -> DataFrame:
    """Motifs of whole texts (file, value)."""
    lines = texts.select(base_name(F.col("file")).alias("structure_id"), F.explode(F.split(F.regexp_extract("value", r"(?s)- motif:(.*)$", 1), "\n")).alias("line"))
    rx = r"^\s*(\S+?):\s*(\d+)\s*$"
    return lines.where(F.col("line").rlike(rx)).select("structure_id", F.regexp_extract("line", rx, 1).alias("code"), F.regexp_extract("line", rx, 2).cast("long").alias("cnt"))


def read_fingerprint_info(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, key, value of the information block, with total and nmotif."""
    return parse_fingerprint_info(_whole(spark, path))


def parse_fingerprint_info(texts: DataFrame) -> DataFrame:
    """Facts of whole texts (file, value)."""
    lines = texts.select(base_name(F.col("file")).alias("structure_id"), F.explode(F.split(F.regexp_replace("value", r"(?s)- motif:.*$", ""), "\n")).alias("line"))
    rx = r"^\s*-?\s*([A-Za-z][^:]*?):\s+(.+?)\s*$"
    return lines.where(F.col("line").rlike(rx)).select("structure_id", F.regexp_extract("line", rx, 1).alias("key"), F.regexp_replace(F.regexp_extract("line", rx, 2), "^'|'$", "").alias("value"))


def fingerprint_text(fp: DataFrame, info: DataFrame | None = None, by_count: bool = True) -> DataFrame:
    """structure_id, text: YAML of each fingerprint, motifs by falling count (or in order of code)."""
    key = F.struct((-F.col("cnt")).alias("k"), "code", "cnt") if by_count else F.struct(F.lit(0).alias("k"), "code", "cnt")
    out = fp.groupBy("structure_id").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("m"))
    rows = F.array_join(F.transform("m", lambda r: F.concat(F.lit("      "), r["code"], F.lit(": "), r["cnt"].cast("string"))), "\n")
    facts = F.lit("")
    if info is not None:
        line = F.concat(F.lit("      "), F.col("key"), F.lit(": '"), F.replace(F.col("value"), F.lit("'"), F.lit("''")), F.lit("'"))
        info = info.groupBy("structure_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("facts"))
        out = out.join(info, "structure_id", "left")
        facts = F.coalesce(F.concat(F.lit("  - information:\n"), F.col("facts"), F.lit("\n")), F.lit("  - information: {}\n"))
    text = F.concat(F.lit("- fingerprint:\n"), facts, F.lit("  - total: "), F.col("total").cast("string"), F.lit("\n  - nmotif: "), F.col("n").cast("string"), F.lit("\n  - motif:\n"), rows, F.lit("\n"))
    return out.select("structure_id", text.alias("text"))


def fingerprint_json(fp: DataFrame) -> DataFrame:
    """structure_id, json with total, nmotif and the motifs as a map."""
    m = fp.groupBy("structure_id").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("nmotif"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "cnt")))).alias("motif"))
    return m.select("structure_id", F.to_json(F.struct("total", "nmotif", "motif")).alias("json"))


def read_old_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, code, cnt of old XML fingerprints; hexadecimal codes become string codes; of repeated motifs the last counts."""
    spec = "id string, count long, first_observed long, encoded_dfs string, mapping string"
    raw = spark.read.format("xml").option("rowTag", "motif").schema(spec).load(path)
    raw = raw.select(F.regexp_replace(base_name(F.col("_metadata.file_name")), r"\.xios$", "").alias("structure_id"), decode_dfs(F.col("encoded_dfs")).alias("code"), F.col("count").alias("cnt"), "first_observed")
    return raw.where("code <> ''").groupBy("structure_id", "code").agg(F.max_by("cnt", "first_observed").alias("cnt"))


def read_old_headers(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, query, program and run figures of old XML fingerprints."""
    spec = "query struct<query_id:string,query_vertex:int,query_edge:int>, fingerprint struct<type:string,iteration:long,program:string,time_elapsed:double>, database struct<database_id:string>, motif_list struct<motif_n:int>"
    raw = spark.read.format("xml").option("rowTag", "XIOS_fingerprint").schema(spec).load(path)
    return raw.select(F.regexp_replace(base_name(F.col("_metadata.file_name")), r"\.xios$", "").alias("structure_id"), "query.*", "fingerprint.*", "database.*", "motif_list.*")


# -- distances and motif lists --------------------------------------------------------------------------------------


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """id1, id2, jaccard, bray_curtis, is_pos: columns apart by any white space, a header and # lines skipped; is_pos: one family."""
    return parse_distances(spark.read.text(path))


def parse_distances(lines: DataFrame) -> DataFrame:
    """Distances of lines (value)."""
    f = F.split(F.trim("value"), r"\s+")
    d = lines.where(~F.col("value").startswith("#")).select(*(F.get(f, F.lit(i)).alias(c) for i, c in enumerate(("id1", "id2", "a", "b"))))
    d = d.select("id1", "id2", F.expr("try_cast(a as double)").alias("jaccard"), F.expr("try_cast(b as double)").alias("bray_curtis")).where("jaccard is not null")
    return d.withColumn("is_pos", group_of(F.col("id1")) == group_of(F.col("id2")))


def three_decimals(x: Column) -> Column:
    """x as ``%.3f`` of C and Python writes it: its binary value rounded, exact halves to even (Java rounds its shortest decimals).

    1000 x is formed without error as the sum of two numbers, so a half and what lies beside it are told apart."""
    upper = x * 134217729.0 - (x * 134217729.0 - x)  # the upper 26 bits
    a, b = upper * 1000, (x - upper) * 1000
    s = a + b
    rest = (a - (s - (s - a))) + (b - (s - a))
    n = F.when((s - F.floor(s) == 0.5) & (rest != 0), s + F.signum(rest) / 2).otherwise(F.rint(s))
    return F.format_string("%.3f", F.when(F.abs(x) < 1e9, n / 1000).otherwise(x))


def distance_lines(pairs: DataFrame) -> DataFrame:
    """value: tab-separated rows with three decimals."""
    three = lambda c: three_decimals(F.col(c))
    return pairs.select(F.concat_ws("\t", F.col("id1").cast("string"), F.col("id2").cast("string"), three("jaccard"), three("bray_curtis")).alias("value"))


def read_motif_list(spark: SparkSession, path: str) -> DataFrame:
    """code, df of a selected-motif list."""
    return parse_motif_list(spark.read.text(path))


def parse_motif_list(lines: DataFrame) -> DataFrame:
    """Motifs of lines (value)."""
    f = F.split("value", r"\t")
    return lines.where("value not like '#%' and trim(value) <> ''").select(F.get(f, F.lit(0)).alias("code"), F.get(f, F.lit(1)).cast("long").alias("df"))


def motif_list_lines(motifs: DataFrame) -> DataFrame:
    return motifs.select(F.concat_ws("\t", "code", F.col("df").cast("string")).alias("value"))


def read_only_list(spark: SparkSession, path: str, block: int = 1) -> DataFrame:
    """file, code: the motifs of the given "motifs only" block of each difference report, up to its blank line."""
    return parse_only_list(_whole(spark, path), block)


def parse_only_list(texts: DataFrame, block: int = 1) -> DataFrame:
    """Of whole texts (file, value): the state "after the marker" is a running count of a file's markers, and of blank lines after each."""
    lines = texts.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("mark", F.lower("line").contains("motifs only")).withColumn("block", F.sum(F.col("mark").cast("int")).over(w))
    lines = lines.where(F.col("block") == block)
    lines = lines.withColumn("blank", F.max((F.trim("line") == "").cast("int")).over(w)).where("blank = 0 and not mark")
    return lines.select("file", F.regexp_extract("line", r"^\s*(\S+)", 1).alias("code"))


# -- motif tables ----------------------------------------------------------------------------------------------------


def write_motif_table(motifs: DataFrame, parents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    motifs.write.mode(mode).parquet(f"{path}/motifs")
    parents.write.mode(mode).parquet(f"{path}/parents")


def read_motif_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/motifs"), spark.read.parquet(f"{path}/parents")


def motif_json(motifs: DataFrame, parents: DataFrame) -> DataFrame:
    """One row a motif as JSON (code, n_stems, parents, checksum), for JSON lines."""
    p = parents.groupBy("code").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    m = motifs.join(p, "code", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    m = m.withColumn("checksum", F.crc32(F.concat_ws(",", "code", F.col("n_stems").cast("string"), F.array_join("parents", ","))))
    return m.select(F.to_json(F.struct("code", "n_stems", "parents", "checksum")).alias("value"))


def motifs_from_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(motifs, parents) of JSON lines; a wrong checksum raises an error."""
    x = lines.select(F.from_json("value", "code string, n_stems int, parents array<string>, checksum long").alias("x")).select("x.*")
    good = F.crc32(F.concat_ws(",", "code", F.col("n_stems").cast("string"), F.array_join("parents", ","))) == F.col("checksum")
    x = x.withColumn("code", F.when(good, F.col("code")).otherwise(F.raise_error(F.lit("a motif's checksum is wrong"))))
    return x.select("code", "n_stems"), x.select("code", F.explode("parents").alias("parent"))
