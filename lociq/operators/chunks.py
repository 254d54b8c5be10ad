"""Packing rows into chunks, chunk statistics, interleaving, and chunk queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.sampling import numbered, numbered_within, running_sum
from lociq.storage import stash

#: A record's estimated size, the size from which a chunk is closed, and the records it then holds at least.
RECORD_BYTES = 1000
CHUNK_BYTES = 10 * 1024 * 1024
MIB = 1024 * 1024
SIZE_EDGES = [(10 * MIB, "<10MiB"), (50 * MIB, "<50MiB"), (100 * MIB, "<100MiB")]


def per_chunk(record_bytes: int = RECORD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Records in a full chunk: the first whole number of them over the size."""
    return chunk_bytes // record_bytes + 1


def pack(rows: DataFrame, group: Column, order: str, size: int) -> DataFrame:
    """``rows`` with chunk_no: slices of ``size`` rows of each group in the order of a whole number.

    Rows of a group are numbered by range buckets of the order and offsets of these, not in one task: a
    bucket holds about a slice, so one bucket is what a task orders.
    """
    keyed = rows.withColumn("_g", group)
    bounds = keyed.groupBy("_g").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count("*").alias("_n"))
    width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) * F.lit(size) / F.col("_n")), F.lit(1))
    placed = keyed.join(bounds, "_g").withColumn("_b", F.floor((F.col(order) - F.col("_lo")) / width))
    counts = placed.groupBy("_g", "_b").agg(F.count("*").alias("_k"))
    ahead = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", "_b", F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_g", "_b").orderBy(order)
    numbered = placed.withColumn("_r", F.row_number().over(within)).join(offsets, ["_g", "_b"])
    return numbered.select(*rows.columns, F.expr(f"(_before + _r - 1) div {size}").cast("long").alias("chunk_no"))


def chunk_stats(chunks: DataFrame, group: str) -> DataFrame:
    """Rows (group, chunk_no, n_sequences, size)."""
    return chunks.groupBy(group, "chunk_no").agg(F.count("*").alias("n_sequences"), (F.count("*") * RECORD_BYTES).alias("size"))


def interleave(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with turn: the i-th of each group, so ordering by (turn, group) deals groups out in rounds."""
    return numbered_within(rows, group, [order], "turn").withColumn("turn", F.col("turn") + 1)


def size_bucket(size: Column, edges: list[tuple[int, str]] | None = None, last: str = ">=100MiB") -> Column:
    out = F.lit(last)
    for edge, label in reversed(edges or SIZE_EDGES):
        out = F.when(size < edge, label).otherwise(out)
    return out


def distribution(chunks: DataFrame, size: Column, category: Column) -> DataFrame:
    """Rows (bucket, model, pathogen, environmental, other): chunks of each size by category."""
    names = ["model", "pathogen", "environmental", "other"]
    edges = [(n * MIB, f"<{n}MiB") for n in (1, 10, 50, 200)]
    bucket = size_bucket(size, edges, ">=200MiB").alias("bucket")
    return chunks.select(bucket, category.alias("_c")).groupBy("bucket").pivot("_c", names).count().fillna(0, names)


def lookup(members: DataFrame, chunk: str, wanted: Column, size: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Rows (chunk, n_sequences, size, relevance): chunks with wanted members, of so many members at least and that size at
    most; relevance is the wanted share. Order by it, descending."""
    sums = members.groupBy(chunk).agg(F.count("*").alias("n_sequences"), F.sum(size).alias("size"), F.round(F.count(F.when(wanted, 1)) / F.count("*"), 6).alias("relevance"))
    met = sums.where((F.col("relevance") > 0) & (F.col("n_sequences") >= least))
    return met if most is None else met.where(F.col("size") <= most)


def dedup_estimate(n: Column, stored: Column) -> Column:
    """200 bytes for each sequence over the bytes stored, from 1 to 100."""
    return F.least(F.greatest(n * 200.0 / stored, F.lit(1.0)), F.lit(100.0))


def compressible(chunks: DataFrame, size: str, compressed: str) -> DataFrame:
    """Row (n_chunks, current_size, estimated_size, saved, recommended): plain chunks over 1 KiB, taken to shrink to a third;
    worth it from 5 million bytes on."""
    met = chunks.where(~F.col(compressed) & (F.col(size) > 1024))
    third = F.expr(f"{size} div 3")
    out = met.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(size), F.lit(0)).alias("current_size"), F.coalesce(F.sum(third), F.lit(0)).alias("estimated_size"))
    return out.withColumn("saved", F.col("current_size") - F.col("estimated_size")).withColumn("recommended", F.col("saved") > 5_000_000)


def batches_by_size(rows: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """``rows`` with batch: a new one wherever the running size passes a multiple of ``most``; any number of rows."""
    placed = stash(numbered(rows, order, "_p"), "placed")
    summed = running_sum(placed, "_p", size)
    return summed.select(*rows.columns, F.expr(f"(upto - {size}) div {most}").cast("long").alias("batch"))


def merge_hierarchy(members: DataFrame, chunk: str, delta: str, seq: str) -> DataFrame:
    """Rows (chunk, n_new, kept) for distinct rows (chunk, delta, seq): in the order of delta, then of the chunk's name, a chunk
    is kept if over half of its sequences are in none that was kept before.

    In rounds over tables: a chunk is decided once no open chunk before it shares a sequence with it.
    """
    rows = stash(members.select(F.col(chunk).alias("chunk"), F.struct(F.col(delta).alias("d"), F.col(chunk).alias("c")).alias("o"), F.col(seq).alias("seq")), "members")
    sizes = stash(rows.groupBy("chunk").agg(F.count("*").alias("n")), "sizes")
    open_, done = rows, []
    while not open_.isEmpty():
        first = open_.groupBy("seq").agg(F.min("o").alias("m"))
        ready = open_.join(first, "seq").groupBy("chunk").agg(F.min((F.col("o") == F.col("m")).cast("int")).alias("r")).where("r = 1").select("chunk")
        ready = stash(ready, "ready")
        covered = None
        for part in done:
            held = part.where("kept").select("chunk")
            covered = held if covered is None else covered.unionByName(held)
        now = rows.join(ready, "chunk", "left_semi")
        fresh = now if covered is None else now.join(rows.join(covered, "chunk", "left_semi").select("seq").distinct(), "seq", "left_anti")
        counted = ready.join(fresh.groupBy("chunk").agg(F.count("*").alias("n_new")), "chunk", "left").join(sizes, "chunk")
        decided = counted.select("chunk", F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"), (F.coalesce("n_new", F.lit(0)) > F.expr("n div 2")).alias("kept"))
        done.append(stash(decided, "decided"))
        open_ = stash(open_.join(ready, "chunk", "left_anti"), "open")
    if not done:
        return sizes.select(F.col("chunk").alias(chunk), F.col("n").alias("n_new"), F.lit(True).alias("kept"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("chunk", chunk)


def members_of(chunks: DataFrame, refs: str, canonical: DataFrame, representations: DataFrame, key: str) -> DataFrame:
    """The sequences of chunks: their refs, the canonical row of each, and its representation; missing ones drop out."""
    refs_ = chunks.select(*(c for c in chunks.columns if c != refs), F.explode(refs).alias(key))
    return refs_.join(canonical, key).join(representations, key)


def query(chunks: DataFrame, taxa: str, wanted: list, size: str, least: int, most: int, limit: int) -> DataFrame:
    """Chunks that hold any wanted taxon, within a size, at most ``limit`` of them by size and first columns."""
    met = chunks.where(F.arrays_overlap(F.col(taxa), F.lit(wanted)) & F.col(size).between(least, most))
    return met.orderBy(F.desc(size), chunks.columns[0]).limit(limit)


def profile_representatives(rows: DataFrame, group: str, id_col: str, length: str, score: Column, width: int = 50) -> DataFrame:
    """Rows (group, bin, id): of each length bin up to three rows are all kept, of more the ceil(40 %) with the
    highest score, ties by id."""
    binned = rows.withColumn("bin", F.expr(f"{length} div {width}")).withColumn("_score", score)
    bins = Window.partitionBy(group, "bin")
    placed = binned.withColumn("_n", F.count("*").over(bins)).withColumn("_k", F.row_number().over(bins.orderBy(F.desc("_score"), id_col)))
    keep = (F.col("_n") <= 3) | (F.col("_k") <= F.ceil(F.col("_n") * 4 / 10))
    return placed.where(keep).select(group, "bin", id_col)


def centrality_estimate(n: Column, avg: Column, taxa: Column, size: Column) -> Column:
    """0.5 min(n/avg, 1) + 0.3 min(taxa/100, 1) + 0.2 min(size/100 MiB, 1)."""
    one = F.lit(1.0)
    return 0.5 * F.least(n / avg, one) + 0.3 * F.least(taxa / 100.0, one) + 0.2 * F.least(size / (100.0 * MIB), one)
