"""Incremental ingest: micro-batches, each added once, with content dedup against what is stored."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def add_batch(batch: DataFrame, batch_id: int, target: str, key: str) -> None:
    """Append the rows of a batch whose key is new, as partition ``batch`` of the target.

    A batch that is tried again overwrites its own partition only, so each counts once. Keys are hashed
    content; within a batch the first row by the other columns' order stays. Of what is stored only the keys are read.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c != key]
    fresh = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*").select(*batch.columns)
    stored = _stored(spark, target)
    if stored is not None:
        fresh = fresh.join(stored.where(F.col("batch") != batch_id).select(key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str, files_done: bool = True) -> StreamingQuery:
    """Start the ingest of a stream; with ``files_done`` it stops when all present files are read."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: add_batch(df, i, target, key))
    return (writer.trigger(availableNow=True) if files_done else writer).start()


def text_stream(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """Records of FASTA files as they arrive, a bounded number of files in each batch."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_each).text(path)
    record = F.regexp_replace("value", "^>", "")
    return raw.where(F.trim("value") != "").select(F.regexp_extract(record, r"^(\S*)", 1).alias("id"), F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\s", "").alias("sequence")).withColumn("seq_hash", F.sha2("sequence", 256))


def with_retry(work: Callable[[], object], tries: int = 3, first_wait: float = 0.5, factor: float = 2.0, most_wait: float = 30.0, errors: tuple = (OSError,), wait: Callable[[float], None] = time.sleep) -> object:
    """What ``work`` gives, tried again after growing waits on the errors named; the last error surfaces."""
    for k in range(tries):
        try:
            return work()
        except errors:
            if k == tries - 1:
                raise
            wait(min(most_wait, first_wait * factor**k))
    raise ValueError("tries has to be 1 or more")


def next_batch_size(size: int, seconds: float, wanted: float, memory_share: float = 0.0, least: int = 1, most: int = 100_000) -> int:
    """Files of the next batch: in proportion to the time wanted, doubled or halved at most; halved where over four fifths of the
    memory is taken."""
    scale = 0.5 if memory_share > 0.8 else min(2.0, max(0.5, wanted / max(seconds, 1e-9)))
    return max(least, min(most, round(size * scale)))


def window_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of event kinds in windows of event time. An addition: the stored history has no event-time windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
