"""Exact and evenly spaced samples, and orders that scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.storage import stash


def numbered(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``rows`` with their place from 0 in an order, for any size: parts of a range sort are numbered by themselves
    and moved by the counts of the parts before. ``order`` has to tell all rows apart for the same places on every run."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stash(sorted_, "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*rows.columns, (F.col("_before") + own).alias(name))


def numbered_within(rows: DataFrame, group: str, order: list, name: str = "position") -> DataFrame:
    """``rows`` with their place from 0 within their group; a group of any size is spread over tasks."""
    placed = stash(numbered(rows, [group, *order], name), "numbered")
    first = placed.groupBy(F.col(group).alias("_g")).agg(F.min(name).alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_g"))).select(*rows.columns, (F.col(name) - F.col("_first")).alias(name))


def running_sum(rows: DataFrame, position: str, n: str, block: int = 100_000) -> DataFrame:
    """``rows`` with upto: the sum of a column up to and with each place, by blocks of places and sums of the blocks before."""
    placed = rows.withColumn("_b", F.expr(f"{position} div {block}"))
    sums = placed.groupBy("_b").agg(F.sum(n).alias("_s"))
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    ahead = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_b").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_w", F.sum(n).over(within)).join(ahead, "_b").select(*rows.columns, (F.col("_before") + F.col("_w")).alias("upto"))


def exact_sample(rows: DataFrame, id_col: str, share: float, seed: int = 1) -> DataFrame:
    """floor(n * share) rows, those of the smallest md5 of seed and id; the same rows on every run.

    The cut is found from counts of hash prefixes, so only the rows of one prefix are ranked.
    """
    keyed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))).withColumn("_p", F.substring("_h", 1, 3))
    counts = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    all_ = Window.partitionBy(F.lit(1))
    order = all_.orderBy("_p")
    cut = counts.withColumn("_want", F.expr(f"cast(floor(sum(_n) over (partition by 1) * {share}D) as bigint)") - (F.sum("_n").over(order) - F.col("_n"))).where("_want > 0").select("_p", "_n", "_want")
    met = keyed.join(cut, "_p")
    whole = met.where("_want >= _n").select(*rows.columns)
    part = met.where("_want < _n").withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_h", id_col))).where("_k <= _want")
    return whole.unionByName(part.select(*rows.columns))


def evenly_spaced(rows: DataFrame, id_col: str, n: int, buckets: int = 1024) -> DataFrame:
    """Every (count / n)-th row by id, from the first; numbered by offsets of id ranges."""
    ends = rows.agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi"))
    width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(buckets)), F.lit(1))
    placed = rows.crossJoin(ends).withColumn("_b", F.floor((F.col(id_col) - F.col("_lo")) / width)).drop("_lo", "_hi")
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    all_ = Window.partitionBy(F.lit(1))
    ahead = counts.select("_b", (F.sum("_n").over(all_.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(all_).alias("_all"))
    numbered = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(id_col))).join(ahead, "_b")
    step = F.expr(f"greatest(_all div {n}, 1)")
    return numbered.where((F.col("_before") + F.col("_r") - 1) % step == 0).select(*rows.columns)


def top(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(n)


def rare(counts: DataFrame, n: str, under: int = 5) -> DataFrame:
    return counts.where(F.col(n) < under)


def hot_and_cold(accesses: DataFrame, key: str, hot: int, cold: int) -> DataFrame:
    """Rows (key, n, heat): hot from that many accesses, cold under that many, else warm."""
    counts = accesses.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("heat", F.when(F.col("n") >= hot, "hot").when(F.col("n") < cold, "cold").otherwise("warm"))
