"""Set algebra between two collections, snapshots or manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, old_value, new_value, change): Added, Removed, Modified or Unchanged, by one full outer join."""
    a = old.select(F.col(key), F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(F.col(key), F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "Added").when(F.col("_b").isNull(), "Removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "Unchanged").otherwise("Modified")
    return a.join(b, key, "full_outer").select(key, "old_value", "new_value", change.alias("change"))


def moved(old: DataFrame, new: DataFrame, key: str, size: str) -> DataFrame:
    """Rows (key, change, size_delta): Added, Removed, or Moved for an equal key of another size."""
    both = compare(old, new, key, size).where("change <> 'Unchanged'")
    change = F.when(F.col("change") == "Modified", "Moved").otherwise(F.col("change"))
    return both.select(key, change.alias("change"), (F.coalesce("new_value", F.lit(0)) - F.coalesce("old_value", F.lit(0))).alias("size_delta"))


def change_stats(changes: DataFrame) -> DataFrame:
    """Rows (change, n, percent)."""
    counts = changes.groupBy("change").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row (n_left, n_right, n_shared, n_left_only, n_right_only, left_percent, right_percent) of distinct keys."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    count = lambda c: F.count(F.when(c, 1))
    out = each.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"), count(F.expr("l = 1 and r = 1")).alias("n_shared"), count(F.expr("l = 1 and r = 0")).alias("n_left_only"), count(F.expr("l = 0 and r = 1")).alias("n_right_only"))
    share = lambda n: F.when(F.col(n) == 0, 0.0).otherwise(F.round(100.0 * F.col("n_shared") / F.col(n), 4))
    return out.withColumn("left_percent", share("n_left")).withColumn("right_percent", share("n_right"))


def shared_top(left: DataFrame, right: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Rows (key, n_left, n_right, n_total): the shared keys with the most rows in both, ties by key."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key).withColumn("n_total", F.col("n_left") + F.col("n_right"))
    return both.orderBy(F.desc("n_total"), key).limit(n)


def collection_stats(old: DataFrame, new: DataFrame, length: str, taxon: str) -> DataFrame:
    """Rows (side, n, total_length, avg_length, n_taxa, taxa) of two collections; taxa are those that only that side has."""
    def one(side: str, rows: DataFrame, other: DataFrame) -> DataFrame:
        own = rows.select(taxon).distinct().join(other.select(taxon).distinct(), taxon, "left_anti").agg(F.nullif(F.array_join(F.array_sort(F.collect_set(taxon)), ","), F.lit("")).alias("taxa"))
        sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("total_length"), F.count_distinct(taxon).alias("n_taxa"))
        average = F.expr("if(n = 0, 0, total_length div n)")
        return sums.crossJoin(own).select(F.lit(side).alias("side"), "n", "total_length", average.alias("avg_length"), "n_taxa", "taxa")  # a row each

    return one("old", old, new).unionByName(one("new", new, old))


def sync_plan(here: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows (key, step): what only this side has is sent, what only the other has is fetched."""
    a, b = here.select(key).distinct(), there.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("step", F.lit("send")).unionByName(b.join(a, key, "left_anti").withColumn("step", F.lit("fetch")))


def migration(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, step, undo, place) from one version to the next: what is new is added first, what is gone removed last."""
    step = F.when(F.col("change") == "Added", "add").when(F.col("change") == "Removed", "remove").otherwise("replace")
    undo = F.when(F.col("change") == "Added", "remove").when(F.col("change") == "Removed", "add").otherwise("replace")
    place = F.when(F.col("change") == "Added", 1).when(F.col("change") == "Removed", 3).otherwise(2)
    return compare(old, new, key, value).where("change <> 'Unchanged'").select(key, step.alias("step"), undo.alias("undo"), place.alias("place"))


def change_log(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """The rows that bring ``old`` to ``new``: key, op (insert, update, delete) and the new value."""
    op = F.create_map(F.lit("Added"), F.lit("insert"), F.lit("Modified"), F.lit("update"), F.lit("Removed"), F.lit("delete"))
    return compare(old, new, key, value).where("change <> 'Unchanged'").select(key, op[F.col("change")].alias("op"), F.col("new_value").alias(value))


def apply_log(old: DataFrame, log: DataFrame, key: str, value: str) -> DataFrame:
    """``old`` (key, value) after a change log."""
    kept = old.select(key, value).join(log.select(key), key, "left_anti")
    return kept.unionByName(log.where("op <> 'delete'").select(key, value))


def alignment_quality(truth: DataFrame, found: DataFrame, query: str, subject: str) -> DataFrame:
    """Row (tp, fp, fn, precision, recall) of distinct (query, subject) pairs, over the queries of ``truth``."""
    t = truth.select(query, subject).distinct().withColumn("_t", F.lit(1))
    f = found.select(query, subject).distinct().join(truth.select(query).distinct(), query, "left_semi").withColumn("_f", F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    both = t.join(f, [query, subject], "full_outer").agg(n(F.expr("_t = 1 and _f = 1")).alias("tp"), n(F.expr("_t is null")).alias("fp"), n(F.expr("_f is null")).alias("fn"))
    rate = lambda part, rest: F.when(F.col(part) + F.col(rest) == 0, 0.0).otherwise(F.round(F.col(part) / (F.col(part) + F.col(rest)), 6))
    return both.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))


def share_of(rows: DataFrame, group: str, by: Column) -> DataFrame:
    """Rows (group, by, n, percent of the group), as a taxon's share within a chunk."""
    counts = rows.groupBy(group, by.alias("by")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 4))
