"""Workflows: stages with symbols and parameter grids, run over the files that still lack their outputs.

A workflow is a mapping: project, definitions (symbols), stages (in order: name, work, output).  Symbols ``$name`` are
expanded in all strings until none is left.  Work runs on Spark's own scheduler; what is done is known from the
outputs, so a restart goes on with what is missing.
"""

from __future__ import annotations

import itertools
import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("stemforge")


def expand(value, symbols: dict[str, str], most: int = 50):
    """value with all ``$name`` symbols replaced, in nested lists and maps too; an unknown symbol or a circle is an error."""
    if isinstance(value, dict):
        return {k: expand(v, symbols) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, symbols) for v in value]
    if not isinstance(value, str):
        return value
    for _ in range(most):
        new = re.sub(r"\$(\w+)", lambda m: str(symbols[m[1]]), value)
        if new == value:
            return value
        value = new
    raise ValueError(f"symbols of {value!r} go round in a circle")


def parse(text: str) -> dict:
    """A YAML workflow with its symbols expanded."""
    import yaml

    spec = yaml.safe_load(text) or {}
    return expand({k: v for k, v in spec.items() if k != "definitions"}, spec.get("definitions") or {}) | {"definitions": spec.get("definitions") or {}}


def fill(template: str, values: dict[str, object]) -> str:
    """A template with <NAME> placeholders filled in; a placeholder without a value stays."""
    return re.sub(r"<(\w+)>", lambda m: str(values.get(m[1], m[0])), template)


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the axes' values: a row each (the product of short lists that the caller gives)."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(F.broadcast(axis))
    return out


def combinations(lists: dict[str, list[str]]) -> list[dict[str, str]]:
    """The same on the driver, for file name templates."""
    return [dict(zip(lists, c, strict=True)) for c in itertools.product(*lists.values())]


def pending(inputs: DataFrame, outputs: DataFrame, name: F.Column) -> DataFrame:
    """Input paths whose derived output is not there."""
    return inputs.withColumn("output", name).join(outputs.select(F.col("path").alias("output")), "output", "left_anti").select("path", name.alias("output"))


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """path of each file that a pattern names; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path")


@dataclass
class Stage:
    name: str
    work: Callable[[SparkSession, dict], DataFrame]
    output: str
    params: dict = field(default_factory=dict)


@dataclass
class Workflow:
    """Stages run in order; a stage whose output has a success mark is skipped unless ``restart``."""

    spark: SparkSession
    stages: list[Stage]
    restart: bool = False

    def done(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def run(self) -> list[tuple[str, str, float]]:
        """(stage, "ran" or "skipped", seconds) of each stage."""
        out = []
        for s in self.stages:
            start = time.time()
            if not self.restart and self.done(s.output):
                log.info("%s: there already", s.name)
                out.append((s.name, "skipped", 0.0))
                continue
            s.work(self.spark, s.params).write.mode("overwrite").parquet(s.output)
            log.info("%s: written in %.1f s", s.name, time.time() - start)
            out.append((s.name, "ran", time.time() - start))
        return out


def versioned(spark: SparkSession, path: str, most: int = 10_000) -> str:
    """path, or the first of path.1, path.2, .. that does not exist."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for n in range(most):
        name = path if n == 0 else f"{path}.{n}"
        p = jvm.org.apache.hadoop.fs.Path(name)
        if not p.getFileSystem(conf).exists(p):
            return name
    raise FileExistsError(path)
