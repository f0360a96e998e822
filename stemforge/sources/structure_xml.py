"""Structure XML files: reader and writer.

The reader uses the XML data source with a fixed schema (versions such as 1.59.2.7 are not numbers) and parses the text
blocks with column expressions.  Edges come from the adjacency block; the edge list block is derived and ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.names import base_name


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """structure_id (file name without extension) and the XML's fields, a row a file."""
    raw = spark.read.format("xml").option("rowTag", "XIOS").schema(schema.STRUCTURE_XML).load(path)
    return raw.withColumn("structure_id", base_name(F.col("_metadata.file_name")))


def raw_from_text(texts: DataFrame) -> DataFrame:
    """As ``read_raw``, from whole documents (structure_id, text)."""
    return texts.select("structure_id", F.from_xml("text", schema.STRUCTURE_XML).alias("x")).select("structure_id", "x.*")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def structures(raw: DataFrame) -> DataFrame:
    """structure_id, version, sequence_id, doc, sequence, comments (trimmed)."""
    s = F.col("information.sequence")
    clean = lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return raw.select(
        "structure_id",
        F.col("_version").alias("version"),
        clean(s["id"]).alias("sequence_id"),
        clean(s["doc"]).alias("doc"),
        F.regexp_replace(s["unformatted"], r"\s+", "").alias("sequence"),
        F.transform("information.comment_list.comment", clean).alias("comments"),
    )


def stems(raw: DataFrame) -> DataFrame:
    """The stem list: v counts the lines; brackets are null where a line has none."""
    lines = raw.select("structure_id", F.posexplode(_lines(F.col("stem_list"))).alias("v", "line"))
    f = F.filter(F.split(F.regexp_replace("line", r"[\[\]]", " "), r"\s+"), lambda x: x != "")
    at = lambda i: F.get("f", F.lit(i))
    lines = lines.withColumn("f", f)
    number = lambda i: at(i).cast("int")
    return lines.select(
        "structure_id", "v", at(0).alias("name"), at(1).cast("double").alias("center"), number(2).alias("lbegin"), number(3).alias("lend"), number(4).alias("rbegin"), number(5).alias("rend"), at(6).alias("lvienna"), at(7).alias("rvienna")
    )


def edges(raw: DataFrame) -> DataFrame:
    """u < v, etype from the adjacency block (header line, then a label and a type for each column)."""
    rows = raw.select("structure_id", F.posexplode(F.slice(_lines(F.col("adjacency")), 2, 1 << 30)).alias("u", "line"))
    cells = F.slice(F.split(F.trim("line"), r"\s+"), 2, 1 << 30)
    return rows.select("structure_id", "u", F.posexplode(cells).alias("v", "etype")).where("v > u")


def format_stems(stems_: DataFrame) -> DataFrame:
    """structure_id, stem_list: fixed-width lines in order of stems; the center is computed anew."""
    center = F.format_string("%.1f", (F.col("lbegin") + F.col("rend")) / 2.0)
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, " ")
    line = F.concat(
        pad("v", 4), F.lit(" "), F.lpad(center, 6, " "), F.lit(" [ "), pad("lbegin", 4), F.lit(" "), pad("lend", 4), F.lit(" "), pad("rbegin", 4), F.lit(" "), pad("rend", 4), F.lit(" ]  "),
        F.coalesce("lvienna", F.lit("")), F.lit("  "), F.coalesce("rvienna", F.lit("")),
    )
    return stems_.groupBy("structure_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", line.alias("line")))), lambda x: x["line"]), "\n").alias("stem_list"))


def format_edges(stems_: DataFrame, edges_: DataFrame) -> DataFrame:
    """structure_id, edge_list (without s), adjacency (both directions, 0 on the diagonal)."""
    both = edges_.select("structure_id", "u", "v", "etype").unionAll(edges_.select("structure_id", F.col("v").alias("u"), F.col("u").alias("v"), F.translate("etype", "ij", "ji")))
    both = both.unionAll(stems_.select("structure_id", F.col("v").alias("u"), "v", F.lit("0").alias("etype")))
    row = F.array_sort(F.collect_list(F.struct("v", "etype")))
    rows = both.groupBy("structure_id", "u").agg(row.alias("cells"))
    label = F.concat(F.lpad(F.col("u").cast("string"), 5, " "))
    listed = F.filter("cells", lambda c: (c["v"] > F.col("u")) & (c["etype"] != "s"))
    rows = rows.select(
        "structure_id",
        "u",
        F.concat(label, F.lit(": "), F.array_join(F.transform(listed, lambda c: F.concat(F.lpad(c["v"].cast("string"), 4, " "), c["etype"])), " ")).alias("edge_line"),
        F.concat(label, F.array_join(F.transform("cells", lambda c: F.concat(F.lit("  "), c["etype"])), "")).alias("row_line"),
        F.lpad(F.col("u").cast("string"), 3, " ").alias("head"),
    )
    lines = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("u", F.col(c).alias("line")))), lambda x: x["line"])
    return rows.groupBy("structure_id").agg(
        F.array_join(lines("edge_line"), "\n").alias("edge_list"), F.concat(F.lit("     "), F.array_join(lines("head"), ""), F.lit("\n"), F.array_join(lines("row_line"), "\n")).alias("adjacency")
    )


def documents(header: DataFrame, stems_: DataFrame, edges_: DataFrame, version: str = "2.2") -> DataFrame:
    """structure_id, text: a whole XML document for each structure."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda n, c: F.concat(F.lit(f"<{n}>\n"), c, F.lit(f"\n</{n}>\n"))
    d = header.join(format_stems(stems_), "structure_id", "left").join(format_edges(stems_, edges_), "structure_id", "left")
    comments = F.array_join(F.transform(F.coalesce("comments", F.array().cast("array<string>")), lambda c: tag("comment", esc(c))), "")
    sequence = tag("sequence", F.concat(tag("id", esc(F.col("sequence_id"))), tag("doc", esc(F.col("doc"))), tag("unformatted", esc(F.col("sequence")))))
    information = tag("information", F.concat(sequence, tag("comment_list", comments)))
    body = F.concat(information, *(tag(c, F.coalesce(c, F.lit(""))) for c in ("stem_list", "edge_list", "adjacency")))
    return d.select("structure_id", F.concat(F.lit(f"<XIOS version='{version}'>\n"), body, F.lit("</XIOS>\n")).alias("text"))


def graphml(edges_: DataFrame) -> DataFrame:
    """structure_id, text: each structure's i, j and o edges as a GraphML graph with labelled edges."""
    e = edges_.where("etype in ('i', 'j', 'o')")
    edge = F.format_string('<edge source="n%d" target="n%d"><data key="t">%s</data></edge>', "u", "v", "etype")
    g = e.groupBy("structure_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("u", "v"))))).alias("nodes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", "v", edge.alias("x")))), lambda r: r["x"]), "\n").alias("edges"),
    )
    nodes = F.array_join(F.transform("nodes", lambda n: F.format_string('<node id="n%d"/>', n)), "\n")
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="t" for="edge" attr.name="type" attr.type="string"/>\n<graph edgedefault="directed">\n'
    return g.select("structure_id", F.concat(F.lit(head), nodes, F.lit("\n"), F.col("edges"), F.lit("\n</graph>\n</graphml>\n")).alias("text"))


def write(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text row a structure; the text source splits at lines, so each document is one partitioned file."""
    docs.write.mode(mode).partitionBy("structure_id").option("lineSep", "\n").text(path)
