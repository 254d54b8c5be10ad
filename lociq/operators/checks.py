"""Checks of stored state: consistency, garbage, integrity of a reduction, progress of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consistency(manifest: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows (key, issue): chunks of the manifest that are missing or listed twice, and stored ones that it lacks."""
    listed = manifest.groupBy(key).agg(F.count("*").alias("_n"))
    both = listed.join(stored.select(key).distinct().withColumn("_s", F.lit(True)), key, "full_outer")
    issues = F.array_compact(F.array(F.when(F.col("_n").isNull(), "orphaned"), F.when(F.col("_s").isNull(), "missing"), F.when(F.col("_n") > 1, "duplicate")))
    return both.select(key, F.explode(issues).alias("issue"))


def garbage(deltas: DataFrame, live: DataFrame, reference: str, size: str) -> DataFrame:
    """Row (n_deleted, bytes_freed, n_kept): deltas whose reference is not live."""
    marked = deltas.join(live.select(reference).distinct().withColumn("_l", F.lit(True)), reference, "left")
    gone = F.col("_l").isNull()
    return marked.agg(F.count(F.when(gone, 1)).alias("n_deleted"), F.coalesce(F.sum(F.when(gone, F.col(size))), F.lit(0)).alias("bytes_freed"), F.count(F.when(~gone, 1)).alias("n_kept"))


def reduction_errors(rows: DataFrame, selection: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, error): input rows without a role, and children whose reference is none."""
    lost = rows.select(id_col).join(selection.select(id_col), id_col, "left_anti").select(id_col, F.lit("lost").alias("error"))
    refs = selection.where("role = 'reference'").select(F.col(id_col).alias("reference_id"))
    orphans = selection.where("role = 'child'").join(refs, "reference_id", "left_anti").select(id_col, F.lit("reference missing").alias("error"))
    return lost.unionByName(orphans)


def broken(states: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """``states`` that break a rule, with the first broken rule's name as error and what mends it as recovery."""
    error = F.coalesce(*(F.when(holds, F.struct(F.lit(name).alias("error"), F.lit(mend).alias("recovery"))) for name, holds, mend in rules))
    return states.withColumn("_e", error).where("_e is not null").select("*", "_e.error", "_e.recovery").drop("_e")


#: How a file's first bytes tell its compression.
MAGIC = {"28B52FFD": "zstd", "1F8B": "gzip", "425A68": "bzip2", "50415231": "parquet"}


def codec_of(content: Column) -> Column:
    """The compression of bytes by how they begin, else 'plain'."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("plain")
    for magic, name in MAGIC.items():
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def storage_analysis(chunks: DataFrame, key: str, size: str, compressed: str) -> DataFrame:
    """Row (n_chunks, total_size, dedup_savings, compression_savings, recommended): repeated chunks but for one each, and two
    thirds of plain chunks over 1 KiB; worth it from a million and from five million bytes on."""
    counted = chunks.groupBy(key).agg(F.count("*").alias("_k"), F.max(size).alias("_s"), F.max(compressed).alias("_c"))
    third = F.expr("_s div 3")
    plain = ~F.col("_c") & (F.col("_s") > 1024)
    zero = F.lit(0)
    sums = counted.agg(F.coalesce(F.sum("_k"), zero).alias("n_chunks"), F.coalesce(F.sum("_s"), zero).alias("total_size"), F.coalesce(F.sum(F.col("_s") * (F.col("_k") - 1)), zero).alias("dedup_savings"), F.coalesce(F.sum(F.when(plain, F.col("_s") - third)), zero).alias("compression_savings"))
    names = F.array_compact(F.array(F.when(F.col("dedup_savings") > 1_000_000, "deduplication"), F.when(F.col("compression_savings") > 5_000_000, "compression")))
    return sums.withColumn("recommended", F.array_join(names, ","))


def throughput(events: DataFrame, kind: str, seconds: str, hit: Column, slow: float) -> DataFrame:
    """Rows (kind, n, mean_seconds, hit_rate, bottleneck): what takes longer than ``slow`` on average, or is found less than half the time."""
    sums = events.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(seconds), 6).alias("mean_seconds"), F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"))
    return sums.withColumn("bottleneck", F.when(F.col("mean_seconds") > slow, "latency").when(F.col("hit_rate") < 0.5, "misses"))


def progress(done: DataFrame, n_all: int, at: str, expires: Column, stored: tuple[str, str], current: tuple[str, str]) -> DataFrame:
    """Row (n_all, n_done, percent, is_expired, can_resume) of a job over ``n_all`` chunks, ``done`` a row each.

    Its state expires where the last chunk was done before ``expires``; it can go on if the manifest's hash and version
    are those it was begun with.
    """
    counted = done.agg(F.count("*").alias("n_done"), F.max(at).alias("_at"))
    percent = F.round(100.0 * F.col("n_done") / F.lit(max(n_all, 1)), 4)
    return counted.select(F.lit(n_all).cast("long").alias("n_all"), "n_done", percent.alias("percent"), (F.col("_at") < expires).alias("is_expired"), F.lit(stored == current).alias("can_resume"))
