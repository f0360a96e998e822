"""Graph codecs and edge algebra as column expressions.

A graph column is array<struct<v0 int, v1 int, e string>> (``schema.GRAPH``).  Codecs round-trip; a vertex or edge type
beyond a codec's range raises an error instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(\d+)([ijosx])(\d+)"


def _edge(v0: Column, v1: Column, e: Column) -> Column:
    return F.struct(v0.cast("int").alias("v0"), v1.cast("int").alias("v1"), e.alias("e"))


def etype_number(e: Column) -> Column:
    """i j o s x -> 0 1 2 3 4."""
    return F.position(e, F.lit("ijosx")) - 1


def etype_letter(n: Column) -> Column:
    return F.substring(F.lit("ijosx"), n.cast("int") + 1, F.lit(1))


def reverse_type(e: Column) -> Column:
    """The type seen from the other end: i and j change places."""
    return F.translate(e, "ij", "ji")


def reverse_edge(edge: Column) -> Column:
    """The same relation with its ends exchanged."""
    return _edge(edge["v1"], edge["v0"], reverse_type(edge["e"]))


def flip_j(graph: Column) -> Column:
    """Every j edge turned round to an i edge."""
    return F.transform(graph, lambda x: F.when(x["e"] == "j", reverse_edge(x)).otherwise(x))


def relabel(graph: Column) -> Column:
    """Vertices renumbered 0, 1, .. in order of first appearance."""
    seen = F.array_distinct(F.flatten(F.transform(graph, lambda x: F.array(x["v0"], x["v1"]))))
    at = lambda v: F.array_position(seen, v) - 1
    return F.transform(graph, lambda x: _edge(at(x["v0"]), at(x["v1"]), x["e"]))


def graph_from_text(text: Column) -> Column:
    """Edges of a text of triples in any punctuation, types as letters or numbers; vertices as numbers or names."""
    flat = F.filter(F.split(F.regexp_replace(text, r"[^0-9A-Za-z]+", " "), " "), lambda w: w != "")
    n = (F.size(flat) / 3).cast("int")
    triples = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(flat, i * 3).alias("a"), F.get(flat, i * 3 + 1).alias("b"), F.get(flat, i * 3 + 2).alias("c")))).otherwise(F.array().cast("array<struct<a:string,b:string,c:string>>"))
    seen = F.array_distinct(F.flatten(F.transform(triples, lambda t: F.array(t["a"], t["b"]))))
    letter = lambda c: F.when(c.rlike("^[0-4]$"), F.translate(c, "01234", "ijosx")).otherwise(c)
    return F.transform(triples, lambda t: _edge(F.array_position(seen, t["a"]) - 1, F.array_position(seen, t["b"]) - 1, letter(t["c"])))


def human_encode(graph: Column, width: int = 1) -> Column:
    """0i1.1i2.2j0. with vertices padded to ``width`` digits."""
    number = lambda v: F.when(F.length(v.cast("string")) < width, F.lpad(v.cast("string"), width, "0")).otherwise(v.cast("string"))
    return F.array_join(F.transform(graph, lambda x: F.concat(number(x["v0"]), x["e"], number(x["v1"]), F.lit("."))), "")


def human_decode(code: Column) -> Column:
    rows = F.regexp_extract_all(code, F.lit(_EDGE), F.lit(0))
    part = lambda r, k: F.regexp_extract(r, _EDGE, k)
    return F.transform(rows, lambda r: _edge(part(r, 1), part(r, 3), part(r, 2)))


def code_vertices(code: Column) -> Column:
    """Number of vertices of a code: its largest vertex and one."""
    return F.array_max(F.transform(F.regexp_extract_all(code, F.lit(r"\d+"), F.lit(0)), lambda v: v.cast("int"))) + 1


def _checked(graph: Column, most_vertex: int, most_type: int) -> Column:
    bad = F.exists(graph, lambda x: (x["v0"] > most_vertex) | (x["v1"] > most_vertex) | (etype_number(x["e"]) > most_type) | (etype_number(x["e"]) < 0))
    return F.when(bad, F.raise_error(F.lit("a vertex or edge type is beyond this codec")).cast(_GRAPH)).otherwise(graph)


_GRAPH = "array<struct<v0:int,v1:int,e:string>>"


def _byte(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n.cast("long"))), 2, "0")


def _number(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("int")


def hex_encode(graph: Column) -> Column:
    """One byte an edge: three bits of each vertex (up to 7), two of the type (i, j, o, s)."""
    one = lambda x: _byte(F.shiftleft(x["v0"], 5).bitwiseOR(F.shiftleft(x["v1"], 2)).bitwiseOR(etype_number(x["e"])))
    return F.array_join(F.transform(_checked(graph, 7, 3), one), "")


def hex_decode(text: Column) -> Column:
    def one(i):
        n = _number(F.substring(text, i, F.lit(2)))
        return _edge(F.shiftright(n, 5), F.shiftright(n, 2).bitwiseAND(F.lit(7)), etype_letter(n.bitwiseAND(F.lit(3))))

    return F.when(F.length(text) < 2, F.array().cast(_GRAPH)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 1, F.lit(2)), one))


def decode_dfs(text: Column) -> Column:
    """The string code of an old one-byte hexadecimal code."""
    return human_encode(hex_decode(text))


def hex2_encode(graph: Column) -> Column:
    """Two bytes an edge: seven bits of each vertex, the type's two bits on top of them."""

    def one(x):
        e = etype_number(x["e"])
        return F.concat(_byte(F.shiftleft(e.bitwiseAND(F.lit(2)), 6).bitwiseOR(x["v0"])), _byte(F.shiftleft(e.bitwiseAND(F.lit(1)), 7).bitwiseOR(x["v1"])))

    return F.array_join(F.transform(_checked(graph, 127, 3), one), "")


def hex2_decode(text: Column) -> Column:
    def one(i):
        a, b = _number(F.substring(text, i, F.lit(2))), _number(F.substring(text, i + 2, F.lit(2)))
        e = F.shiftright(a.bitwiseAND(F.lit(128)), 6) + F.shiftright(b, 7)
        return _edge(a.bitwiseAND(F.lit(127)), b.bitwiseAND(F.lit(127)), etype_letter(e))

    return F.when(F.length(text) < 4, F.array().cast(_GRAPH)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 3, F.lit(4)), one))


def ascii_encode(graph: Column) -> Column:
    """Two printable characters an edge: vertex + 33 in six bits (up to 30), one bit of the type above each."""

    def one(x):
        e = etype_number(x["e"])
        return F.concat(F.char(F.shiftleft(e.bitwiseAND(F.lit(2)), 5) + x["v0"] + 33), F.char(F.shiftleft(e.bitwiseAND(F.lit(1)), 6) + x["v1"] + 33))

    return F.array_join(F.transform(_checked(graph, 30, 3), one), "")


def ascii_decode(text: Column) -> Column:
    def one(i):
        a, b = F.ascii(F.substring(text, i, F.lit(1))), F.ascii(F.substring(text, i + 1, F.lit(1)))
        e = F.shiftright(a.bitwiseAND(F.lit(64)), 5) + F.shiftright(b.bitwiseAND(F.lit(64)), 6)
        return _edge(a.bitwiseAND(F.lit(63)) - 33, b.bitwiseAND(F.lit(63)) - 33, etype_letter(e))

    return F.when(F.length(text) < 2, F.array().cast(_GRAPH)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 1, F.lit(2)), one))
