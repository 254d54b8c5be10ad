"""Content addressing, representations, duplicates and existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(rows: DataFrame, text: str, id_col: str) -> DataFrame:
    """Rows (seq_hash, first_id, n_copies, length): one per distinct body. Only hashes and ids are shuffled."""
    keyed = rows.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("seq_hash"), F.col(id_col).alias("_id"), F.length(text).cast("long").alias("_len"))
    return keyed.groupBy("seq_hash").agg(F.min("_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("_len").alias("length"))


def representations(rows: DataFrame, text: str, source: str, header: Column, seen: str) -> DataFrame:
    """Rows (seq_hash, source, header, last_seen): distinct by hash, source and header, the latest sighting."""
    keyed = rows.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("seq_hash"), F.col(source).alias("source"), header.alias("header"), F.col(seen).alias("_seen"))
    return keyed.groupBy("seq_hash", "source", "header").agg(F.max("_seen").alias("last_seen"))


def pick_representation(rows: DataFrame, text: str, source: str, id_col: str, preferred: str) -> DataFrame:
    """Rows (seq_hash, id, source): of each body the row of the preferred source, else of the smallest id.

    A minimum of a struct is taken with partial aggregation, so a body with very many copies is no hot task.
    """
    order = F.struct((F.col(source) != preferred).alias("other"), F.col(id_col).alias("id"), F.col(source).alias("source"))
    best = rows.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("seq_hash")).agg(F.min(order).alias("best"))
    return best.select("seq_hash", F.col("best.id").alias(id_col), F.col("best.source").alias("source"))


def upsert(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Canonical rows after a batch: first ids and counts of both sides merged by hash."""
    return known.unionByName(batch).groupBy("seq_hash").agg(F.min("first_id").alias("first_id"), F.sum("n_copies").alias("n_copies"), F.first("length").alias("length"))


def dedup_ratio(rows: DataFrame, key: Column) -> DataFrame:
    """Row (n_total, n_distinct, ratio): 1 for an empty table."""
    counts = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count("*").alias("n_distinct"))
    return sums.withColumn("ratio", F.when(F.col("n_distinct") == 0, 1.0).otherwise(F.round(F.col("n_total") / F.col("n_distinct"), 6)))


def duplicate_groups(rows: DataFrame, key: Column, id_col: str, name: str = "seq_hash") -> DataFrame:
    """Rows (key, n, first_id, last_id) of keys that occur more than once."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("n > 1")


def existing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_semi")


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def union_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose key it lacks."""
    return first.unionByName(missing(second, first, key))


def resolve_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, values, is_conflict): the distinct values of each key, sorted and joined by commas."""
    found = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.col(value).cast("string"))).alias("v"))
    return found.select(key, F.array_join("v", ",").alias("conflict_values"), (F.size("v") > 1).alias("is_conflict"))


def newest(rows: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """The ``n`` rows of each key with the largest ``order``; Spark cuts each key to ``n`` rows before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")
