"""Serial, pair and bracket notations of structures.

Serial: the stem number at each half-stem in order (0,1,0,1 is a pseudoknot).  Pairs: flat [l0, r0, l1, r1, ..] of
abstract coordinates.  Brackets: ( [ { < and dots.  Array notations convert by array expressions; brackets need a
stack for each kind and use an Arrow function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN, _CLOSE = "([{<", ")]}>"


def _let(value: Column, f) -> Column:
    """f(value), with value made once: an expression inside a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def serial_canonical(serial: Column) -> Column:
    """Stems renumbered by first appearance."""
    return _let(serial, lambda s: _let(F.array_distinct(s), lambda seen: F.transform(s, lambda x: (F.array_position(seen, x) - 1).cast("int"))))


def serial_reverse(serial: Column) -> Column:
    return serial_canonical(F.reverse(serial))


def serial_strings(serial: Column) -> Column:
    """The lesser and the greater of the two reading directions' strings."""
    a, b = F.array_join(serial_canonical(serial), " "), F.array_join(serial_reverse(serial), " ")
    return F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def serial_from_text(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\D+"), lambda x: x != ""), lambda x: x.cast("int"))


def serial_to_pairs(serial: Column) -> Column:
    """Flat pairs in order of the left halves."""
    n = F.size(serial)
    ends = F.transform(F.array_distinct(serial), lambda s: F.array((F.array_position(serial, s) - 1).cast("int"), (n - F.array_position(F.reverse(serial), s)).cast("int")))
    return F.flatten(ends)


def _pair_structs(pairs: Column) -> Column:
    n = lambda q: (F.size(q) / 2).cast("int")
    each = lambda q: lambda k: F.struct(F.least(F.get(q, k * 2), F.get(q, k * 2 + 1)).alias("l"), F.greatest(F.get(q, k * 2), F.get(q, k * 2 + 1)).alias("r"))
    return _let(pairs, lambda q: F.when(n(q) > 0, F.array_sort(F.transform(F.sequence(F.lit(0), n(q) - 1), each(q)))).otherwise(F.array().cast("array<struct<l:int,r:int>>")))


def pairs_canonical(pairs: Column) -> Column:
    """Coordinates compressed to ranks, stems in order of their left ends."""
    rank = lambda order, x: (F.array_position(order, x) - 1).cast("int")
    return _let(pairs, lambda q: _let(F.array_sort(q), lambda order: F.flatten(F.transform(_pair_structs(q), lambda p: F.array(rank(order, p["l"]), rank(order, p["r"]))))))


def pairs_to_serial(pairs: Column) -> Column:
    """The number of the stem that has an end at each coordinate."""
    sides = lambda p: F.struct(F.transform(p, lambda x: x["l"]).alias("l"), F.transform(p, lambda x: x["r"]).alias("r"))
    at = lambda z, c: F.when(F.array_contains(z["l"], c), F.array_position(z["l"], c)).otherwise(F.array_position(z["r"], c))
    return _let(pairs, lambda q: _let(_let(_pair_structs(q), sides), lambda z: F.transform(F.array_sort(q), lambda c: (at(z, c) - 1).cast("int"))))


def pairs_reverse(pairs: Column) -> Column:
    """The structure read from its other end."""
    return pairs_canonical(_let(pairs, lambda q: _let(F.array_max(q), lambda top: F.transform(q, lambda x: top - x))))


def pairs_duplicate(pairs: Column) -> Column:
    """Two copies side by side."""
    return _let(pairs_canonical(pairs), lambda p: F.concat(p, F.transform(p, lambda x: x + F.size(p))))


def pairs_push(pairs: Column, left: Column, right: Column) -> Column:
    """One more stem at the given coordinates."""
    return F.concat(pairs, F.array(left.cast("int"), right.cast("int")))


def pairs_connected(pairs: Column) -> Column:
    """Whether no cut leaves stems on both sides: the running right end reaches every next left end."""
    p = _pair_structs(pairs)
    run = F.aggregate(p, F.struct(F.lit(True).alias("ok"), F.lit(None).cast("int").alias("end")), lambda s, x: F.struct((s["ok"] & (s["end"].isNull() | (x["l"] < s["end"]))).alias("ok"), F.greatest(F.coalesce(s["end"], x["r"]), x["r"]).alias("end")))
    return run["ok"]


def pairs_depth(pairs: Column) -> Column:
    """Number of stems that span each position from 0 to the last end, both ends included."""
    over = lambda p, c: F.size(F.filter(p, lambda x: (x["l"] <= c) & (c <= x["r"])))
    return _let(pairs, lambda q: _let(_pair_structs(q), lambda p: F.transform(F.sequence(F.lit(0), F.array_max(q)), lambda c: over(p, c))))


def serial_connected(serial: Column) -> Column:
    """The connected parts of a serial structure, in order."""
    closed = lambda s: lambda i: F.size(F.array_intersect(F.slice(s, 1, i), F.slice(s, i + 1, F.size(s)))) == 0
    cuts = lambda s: F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(1), F.size(s)), closed(s))).otherwise(F.array().cast("array<int>"))
    before = lambda at, k: F.when(k == 0, 0).otherwise(F.get(at, k - 1))
    return _let(serial, lambda s: _let(cuts(s), lambda at: F.transform(at, lambda c, k: F.slice(s, before(at, k) + 1, c - before(at, k)))))


def serial_to_graph(serial: Column) -> Column:
    return pairs_to_graph(serial_to_pairs(serial))


def pairs_to_graph(pairs: Column, serial_edges: bool = False) -> Column:
    """Edges of all stems i < j in order of left ends: i (inside), o (overlapping), and s where asked for."""
    kind = lambda a, b: F.when(a["r"] < b["l"], "s").when(a["r"] > b["r"], "i").otherwise("o")
    edge = lambda a, b: F.struct(a["j"].alias("v0"), b["j"].alias("v1"), kind(a, b).alias("e"))
    after = lambda p, a: F.filter(p, lambda b: (b["j"] > a["j"]) & (F.lit(serial_edges) | (b["l"] <= a["r"])))
    numbered = F.transform(_pair_structs(pairs), lambda x, j: F.struct(x["l"].alias("l"), x["r"].alias("r"), j.cast("int").alias("j")))
    return _let(numbered, lambda p: F.flatten(F.transform(p, lambda a: F.transform(after(p, a), lambda b: edge(a, b)))))


def parse_brackets(text: str | None) -> list[int] | None:
    """Flat pairs of positions, each kind of bracket with a stack of its own; null where brackets do not match."""
    if text is None:
        return None
    stacks: dict[str, list[int]] = {c: [] for c in _CLOSE}
    pairs = []
    for i, c in enumerate(text):
        if c in _OPEN:
            stacks[_CLOSE[_OPEN.index(c)]].append(i)
        elif c in _CLOSE:
            if not stacks[c]:
                return None
            pairs.append((stacks[c].pop(), i))
    if any(stacks.values()):
        return None
    return [x for p in sorted(pairs) for x in p]


def write_brackets(pairs: list[int] | None, length: int = 0) -> str | None:
    """Brackets of flat pairs: each stem takes the first kind in which it crosses no earlier stem; null beyond four kinds."""
    if pairs is None:
        return None
    out = ["."] * max([length, *(int(x) + 1 for x in pairs)])
    used: list[list[tuple[int, int]]] = [[] for _ in _OPEN]
    for a, b in sorted((min(int(x), int(y)), max(int(x), int(y))) for x, y in zip(pairs[::2], pairs[1::2], strict=True)):
        for kind, mine in enumerate(used):
            if all(not (c < a < d < b) for c, d in mine):
                mine.append((a, b))
                out[a], out[b] = _OPEN[kind], _CLOSE[kind]
                break
        else:
            return None
    return "".join(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def brackets_to_pairs(text: pd.Series) -> pd.Series:
    return text.map(parse_brackets)


@F.pandas_udf(T.StringType())
def pairs_to_brackets(pairs: pd.Series) -> pd.Series:
    return pairs.map(lambda p: write_brackets(None if p is None else list(p)))


def half_stem_brackets(length: Column, letter: str) -> Column:
    """A half stem written as ``length`` times its bracket."""
    return F.repeat(F.lit(letter), length.cast("int"))


def paired_in(vienna: Column) -> Column:
    """Base pairs of a left half in brackets."""
    return F.length(vienna) - F.length(F.replace(vienna, F.lit("("), F.lit("")))


def trimmed(vienna: Column) -> Column:
    """Brackets without outer dots."""
    return F.regexp_replace(vienna, r"^\.+|\.+$", "")
