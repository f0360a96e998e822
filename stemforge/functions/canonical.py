"""Canonical codes of small labelled graphs.

The code of a connected graph is its least depth-first code.  Rows follow a depth-first order of the vertices: a
forward row discovers a vertex from the latest vertex that still has an undiscovered neighbour; it is followed by the
backward rows of the new vertex, to earlier vertices in ascending order.  Rows compare by: backward before forward;
forward from a later vertex first, then by type; backward to an earlier vertex first, then by type; types i < j < o.

All least partial orders are carried along in parallel, block by block (a forward row and its backward rows), so the
result is a true invariant: every start and orientation is tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INVERSE = {"i": "j", "j": "i", "o": "o"}
_RANK = {"i": 0, "j": 1, "o": 2}


def canonical_code(edges: Iterable[tuple[int, int, str]]) -> str | None:
    """The code of a graph given as (v0, v1, type); types s and x are no edges.  Null if no edge is left or it is not connected."""
    near: dict[int, dict[int, str]] = {}
    for a, b, e in edges:
        if e in _RANK and a != b:
            near.setdefault(a, {})[b] = e
            near.setdefault(b, {})[a] = _INVERSE[e]
    if not near:
        return None
    first = min((e for x in near.values() for e in x.values()), key=_RANK.get)
    orders = [(a, b) for a, x in near.items() for b, e in x.items() if e == first]
    rows = [f"0{first}1."]
    for _ in range(len(near) - 2):
        best, kept = None, []
        for order in orders:
            at = {v: i for i, v in enumerate(order)}
            source = next((v for v in reversed(order) if any(w not in at for w in near[v])), None)
            if source is None:
                return None
            fresh = {w: e for w, e in near[source].items() if w not in at}
            least = min(_RANK[e] for e in fresh.values())
            for w, e in fresh.items():
                if _RANK[e] == least:
                    back = sorted((at[x], _RANK[t]) for x, t in near[w].items() if x in at and x != source)
                    # a row that goes on backward is less than one that goes forward: the end counts as the largest
                    key = (-at[source], least, *(n for p in back for n in p), 1 << 30)
                    if best is None or key < best[0]:
                        best, kept = (key, at[source], e, back), []
                    if key == best[0]:
                        kept.append((*order, w))
        new = len(orders[0])
        _, source, e, back = best
        rows.append(f"{source}{e}{new}.")
        rows += [f"{new}{'ijo'[t]}{v}." for v, t in back]
        orders = kept
    return "".join(rows)


def code_of_key(key: str) -> str | None:
    """Code of a labelled key: the upper triangle of types row by row, '.' where there is no edge."""
    n = int((1 + (1 + 8 * len(key)) ** 0.5) / 2)
    pairs = ((i, j) for i in range(n) for j in range(i + 1, n))
    return canonical_code((i, j, e) for (i, j), e in zip(pairs, key, strict=True) if e in _RANK)


def connected_key(key: str) -> bool:
    return code_of_key(key) is not None and set(range(_size(key))) == _touched(key)


def _size(key: str) -> int:
    return int((1 + (1 + 8 * len(key)) ** 0.5) / 2)


def _touched(key: str) -> set[int]:
    n = _size(key)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    return {v for p, e in zip(pairs, key, strict=True) if e in _RANK for v in p}


@F.pandas_udf(T.StringType())
def key_code(key: pd.Series) -> pd.Series:
    """Codes of labelled keys; apply it to distinct keys."""
    return key.map(lambda k: code_of_key(k) if k else None)


@F.pandas_udf(T.StringType())
def text_code(code: pd.Series) -> pd.Series:
    """Canonical codes of graphs written as string codes."""
    row = re.compile(r"(\d+)([ijosx])(\d+)")
    return code.map(lambda c: canonical_code((int(a), int(b), e) for a, e, b in row.findall(c)) if c else None)


def with_codes(rows: DataFrame, graph: Column, name: str = "code") -> DataFrame:
    """rows with the canonical code of a graph column.

    The graph's text is a column of its own below a map over batches: array functions with lambdas are evaluated by
    Spark there, and never become arguments of a Python function."""
    from .codes import human_encode

    row = re.compile(r"(\d+)([ijosx])(\d+)")

    def run(source):
        for p in source:
            p[name] = [canonical_code((int(a), int(b), e) for a, e, b in row.findall(t)) if t else None for t in p.pop("_graph")]
            yield p

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    return rows.withColumn("_graph", human_encode(graph)).mapInPandas(run, schema)


def shuffled(edges: list[tuple[int, int, str]], seed: int) -> list[tuple[int, int, str]]:
    """The same graph with other vertex numbers, edge order and edge directions, to test invariance."""
    rng = np.random.default_rng(seed)
    old = sorted({v for a, b, _ in edges for v in (a, b)})
    new = dict(zip(old, rng.permutation(len(old)).tolist(), strict=True))
    out = [(new[a], new[b], e) if rng.random() < 0.5 else (new[b], new[a], _INVERSE.get(e, e)) for a, b, e in edges]
    return [out[i] for i in rng.permutation(len(out))]
