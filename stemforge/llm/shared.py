"""Scratch tables in the shared checkpoint folder, and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, one of this process, removed at exit,
    in local mode only (what one process writes it can read)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        at = getattr(folder, "own", None)
        if at is None:
            at = folder.own = tempfile.mkdtemp(prefix="stemforge-")
            atexit.register(shutil.rmtree, at, True)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    at = f"{folder(spark)}/stemforge/{name}-{uuid.uuid4().hex}"
    _made.append(at)
    return at


@contextmanager
def swept(spark: SparkSession):
    """Scratch paths that are made within are removed at the end, but for the last one: the result."""
    before = len(_made)
    try:
        yield
    finally:
        drop(spark, *_made[before:-1])


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and no executor holds the only copy."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove scratch paths that no later read needs."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(df: DataFrame) -> None:
    """Remove what ``saved`` wrote for df."""
    drop(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def renamed(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with places for names, but for the ``needed`` columns: names of any form pass through Arrow functions so, and clash with none."""
    return docs.toDF(*(c if c in needed else f"_{i}" for i, c in enumerate(docs.columns)))
