"""Incremental file discovery as Structured Streaming.

Each file of an input folder is processed exactly once: the file source logs what it has read in the query's
checkpoint, so a restarted query goes on after the last committed batch.  ``available_now`` processes what is there and
stops; otherwise new files are looked for again and again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """A stream of rows with the file that each is from (``file``)."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path).withColumn("file", F.col("_metadata.file_name"))


def run(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True, every: str = "5 seconds", partition_by: tuple[str, ...] = ()):
    """Append the stream's rows to a Parquet folder; returns the query (finished, if available_now)."""
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
    if available_now:
        q.awaitTermination()
    return q


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "5 seconds"):
    """Call work(batch, number) for each micro-batch; work must write idempotently by number, as a batch may come again after a failure."""
    w = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
    if available_now:
        q.awaitTermination()
    return q


def first_of_each(stream: DataFrame, keys: list[str], ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows with keys not seen before; with a time column, state is dropped once the watermark is past."""
    if ts is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def running_fingerprints(stream: DataFrame) -> DataFrame:
    """id, code, cnt so far of a stream of motif observations (complete or update mode)."""
    return stream.groupBy("id", "code").agg(F.sum("cnt").alias("cnt"))


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """start, key, n of tumbling windows, given out when the watermark has passed them (append mode)."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All results of a stream over the files that are there, as a table in memory (for checks)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
