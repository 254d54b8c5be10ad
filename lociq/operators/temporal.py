"""As-of, interval and change queries over version timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.storage import stash


#: Rows that one task of an as-of join orders, if no single unit of time has more.
BUCKET_ROWS = 500_000


def asof(queries: DataFrame, versions: DataFrame, q_time: str, v_time: str, value: str, unit: str = "hour") -> DataFrame:
    """``queries`` with the value and time of the latest version at or before each query's time.

    Both sides are cut into runs of calendar units that hold about BUCKET_ROWS rows together, found from the count of each
    unit, so busy times are as many tasks as they need. Within a bucket a running last value over the merged rows
    finds the version; a query before its bucket's first version takes the last one of the buckets before,
    carried over one row per bucket. So no task orders a whole timeline. Of versions at the same
    time the largest value counts. No earlier version gives null. A null time matches nothing.
    """
    v = versions.where(F.col(v_time).isNotNull()).groupBy(F.col(v_time).alias("_t")).agg(F.max(value).alias("_v"))
    v = v.withColumn("_u", F.date_trunc(unit, "_t"))
    q = queries.withColumn("_t", F.col(q_time)).withColumn("_u", F.date_trunc(unit, F.col(q_time)))
    units = v.select("_u").unionAll(q.select("_u")).where("_u is not null").groupBy("_u").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_u")) - F.col("_n")  # a row for each unit
    runs = stash(units.select("_u", F.floor(upto / BUCKET_ROWS).alias("_b")), "units")
    v = v.join(runs, "_u").drop("_u")
    q = q.join(runs, "_u", "left").drop("_u")
    merged = q.withColumn("_v", F.lit(None).cast(v.schema["_v"].dataType)).withColumn("_q", F.lit(1)).unionByName(v.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("_b").orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("_q") == 0, F.struct(F.col("_v").alias("value"), F.col("_t").alias("time")))
    placed = merged.withColumn("_hit", F.last(seen, ignorenulls=True).over(order)).where("_q = 1")
    ends = v.groupBy("_b").agg(F.max(F.struct(F.col("_t").alias("time"), F.col("_v").alias("value"))).alias("_end"))
    buckets = ends.join(q.select("_b").distinct(), "_b", "full_outer")
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("_b", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    joined = placed.join(carried, "_b", "left")
    pick = lambda f: F.when(F.col("_t").isNull(), None).otherwise(F.coalesce(F.col(f"_hit.{f}"), F.col(f"_carry.{f}")))
    return joined.select(*queries.columns, pick("value").alias("asof_value"), pick("time").alias("asof_time"))


def snapshot(rows: DataFrame, key: str, time: str, at: Column, value: str) -> DataFrame:
    """Rows (key, value): the latest value of each key at or before a time; ties take the larger value."""
    latest = rows.where(F.col(time) <= at).groupBy(key).agg(F.max(F.struct(F.col(time), F.col(value))).alias("_l"))
    return latest.select(key, F.col(f"_l.{value}").alias(value))


def intervals(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows (key, value, valid_from, valid_to): each stay of a value, open at the end; repeats are joined."""
    order = Window.partitionBy(key).orderBy(time, value)
    changed = rows.withColumn("_p", F.lag(value).over(order)).withColumn("_f", F.row_number().over(order)).where((F.col("_f") == 1) | ~F.col("_p").eqNullSafe(F.col(value)))
    return changed.select(key, value, F.col(time).alias("valid_from"), F.lead(time).over(order).alias("valid_to"))


def valid_at(spans: DataFrame, queries: DataFrame, key: str, q_time: str) -> DataFrame:
    """``queries`` with the value whose interval holds their time: an equi-join on the key, then the range."""
    s = spans.withColumnRenamed(key, "_k")
    holds = (F.col("_k") == F.col(key)) & (F.col("valid_from") <= F.col(q_time)) & (F.col("valid_to").isNull() | (F.col(q_time) < F.col("valid_to")))
    return queries.join(s, holds).drop("_k", "valid_from", "valid_to")


def changes(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows (key, time, old_value, new_value, change): Created at first, then Reclassified where it changes."""
    order = Window.partitionBy(key).orderBy(time, value)
    marked = rows.select(key, time, F.lag(value).over(order).alias("old_value"), F.col(value).alias("new_value"), F.row_number().over(order).alias("_n"))
    kind = F.when(F.col("_n") == 1, "Created").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "Reclassified")
    return marked.withColumn("change", kind).where("change is not null").drop("_n")


def temporal_join(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (old_value, new_value, n): keys in both snapshots whose value changed."""
    a, b = before.select(key, F.col(value).alias("old_value")), after.select(key, F.col(value).alias("new_value"))
    return a.join(b, key).where(~F.col("old_value").eqNullSafe(F.col("new_value"))).groupBy("old_value", "new_value").agg(F.count("*").alias("n"))


def turnover(rows: DataFrame, period: Column, member: str) -> DataFrame:
    """Rows (period, n_members, n_added, n_removed): members of each period against the one before it."""
    present = rows.select(period.alias("period"), member).distinct()
    periods = present.select("period").distinct()
    order = Window.partitionBy(F.lit(1)).orderBy("period")  # one row per period
    numbered = periods.withColumn("_n", F.row_number().over(order))
    p = present.join(numbered, "period")
    own = Window.partitionBy(member).orderBy("_n")
    flagged = p.withColumn("_added", (F.col("_n") - F.coalesce(F.lag("_n").over(own), F.lit(-1)) != 1).cast("int")).withColumn("_gone", (F.coalesce(F.lead("_n").over(own), F.lit(-1)) - F.col("_n") != 1).cast("int"))
    stats = flagged.groupBy("_n").agg(F.count("*").alias("n_members"), F.sum("_added").alias("n_added"), F.sum("_gone").alias("_gone"))
    removed = stats.select((F.col("_n") + 1).alias("_n"), F.col("_gone").alias("n_removed"))
    return numbered.join(stats.drop("_gone"), "_n").join(removed, "_n", "left").select("period", "n_members", "n_added", F.coalesce("n_removed", F.lit(0)).alias("n_removed"))


def lineage_of_versions(versions: DataFrame, time: str, count: str) -> DataFrame:
    """``versions``, one row each, with the previous version's time and the change of a count."""
    order = Window.partitionBy(F.lit(1)).orderBy(time)
    return versions.withColumn("parent_time", F.lag(time).over(order)).withColumn("count_delta", F.col(count) - F.coalesce(F.lag(count).over(order), F.lit(0)))


def mass_changes(changed: DataFrame, period: Column, least: int) -> DataFrame:
    """Rows (period, old_value, new_value, n): changes made by at least that many keys in a period."""
    return changed.where("change = 'Reclassified'").groupBy(period.alias("period"), "old_value", "new_value").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def prune(rows: DataFrame, time: str, cutoff: Column) -> DataFrame:
    return rows.where(F.col(time) >= cutoff)


def append_history(log: DataFrame | None, records: DataFrame) -> DataFrame:
    """A log with more records; in any order, as reading sorts them out."""
    return records if log is None else log.unionByName(records)


def history_between(log: DataFrame, key: list[str], time: str, written: str, start: Column, end: Column) -> DataFrame:
    """Records of a log from ``start`` to before ``end``; of those of one key the one written last counts, so a late or
    repeated record overwrites."""
    met = log.where((F.col(time) >= start) & (F.col(time) < end))
    last = met.groupBy(*key).agg(F.max_by(F.struct(*log.columns), written).alias("_r"))
    return last.select("_r.*")


def timeline(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows (time, kind) of several tables: (table, time column, kind)."""
    frames = [df.select(F.col(time).alias("time"), F.lit(kind).alias("kind")) for df, time, kind in parts]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
