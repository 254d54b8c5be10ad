"""Ranks, quantiles and nearest neighbours by length, from the table of distinct lengths.

A global sort or window puts all rows into one task. Lengths are small whole numbers, so everything
that depends on their order is worked out on one row per distinct length and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.sampling import numbered


def by_length(rows: DataFrame, length: str) -> DataFrame:
    """Rows (len, n): how many rows have each length; null lengths are left out."""
    return rows.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("len")).agg(F.count("*").alias("n"))


def _whole() -> Window:
    return Window.partitionBy(F.lit(1))


def running(lengths: DataFrame, descending: bool = False) -> DataFrame:
    """Add before and upto, the rows of shorter (or longer) and of no longer (or shorter) lengths."""
    order = _whole().orderBy(F.desc("len") if descending else F.col("len"))
    return lengths.withColumn("upto", F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))


def upper_median(lengths: DataFrame) -> DataFrame:
    """Row (median): the length at place floor(n / 2) from 0 in ascending order."""
    ranked = running(lengths).withColumn("half", F.expr("sum(n) over (partition by 1) div 2"))
    return ranked.where("before <= half and half < upto").select(F.col("len").alias("median"))


def nx(lengths: DataFrame, percents: tuple[int, ...] = (50, 90)) -> DataFrame:
    """One row with n50, n90 ..: the length at which the longest rows hold that share of all characters."""
    order = _whole().orderBy(F.desc("len"))
    walked = lengths.withColumn("held", F.sum(F.col("len") * F.col("n")).over(order)).withColumn("total", F.sum(F.col("len") * F.col("n")).over(_whole()))
    return walked.agg(*(F.max(F.when(F.col("held") >= F.floor(F.col("total") * p / 100), F.col("len"))).alias(f"n{p}") for p in percents))


def walked(lengths: DataFrame) -> DataFrame:
    """Add held: the characters of rows of that length or longer."""
    return lengths.withColumn("held", F.sum(F.col("len") * F.col("n")).over(_whole().orderBy(F.desc("len"))))


def longest(rows: DataFrame, id_col: str, length: str, ratio: float) -> DataFrame:
    """Rows (id) of the floor(n * ratio) longest, ties by smaller id.

    Lengths over the one where the target falls are taken whole; only rows of that one length are ranked, by ranges
    of ids, so very many rows of one length are many tasks.
    """
    ranked = running(by_length(rows, length), descending=True)
    target = F.expr(f"cast(floor(sum(n) over (partition by 1) * {ratio}D) as bigint)")
    cut = ranked.withColumn("target", target).withColumn("want", F.least(F.col("n"), F.greatest(F.col("target") - F.col("before"), F.lit(0))))
    wanted = cut.where("want > 0").select("len", "n", "want")
    met = rows.select(id_col, F.col(length).cast("long").alias("len")).join(wanted, "len")
    some = numbered(met.where("want < n"), [id_col], "k").where("k < want").select(id_col)
    return met.where("want = n").select(id_col).unionByName(some)


def nearest(children: DataFrame, references: DataFrame, id_col: str, length: str) -> DataFrame:
    """Rows (id, reference_id): the reference of the nearest length, ties by smaller reference id.

    The nearest below and above are last and first values over the distinct lengths of both sides.
    """
    refs = references.groupBy(F.col(length).cast("long").alias("len")).agg(F.min(id_col).alias("ref"))
    kids = children.select(F.col(length).cast("long").alias("len")).distinct()
    both = kids.join(refs, "len", "full_outer")
    mark = F.when(F.col("ref").isNotNull(), F.struct("len", "ref"))
    up = _whole().orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    down = _whole().orderBy("len").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("lo", F.last(mark, ignorenulls=True).over(up)).withColumn("hi", F.first(mark, ignorenulls=True).over(down))
    choice = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("len") - F.col(f"{side}.len")).alias("d"), F.col(f"{side}.ref").alias("ref")))
    best = found.select("len", F.array_min(F.array_compact(F.array(choice("lo"), choice("hi"))))["ref"].alias("reference_id"))
    return children.select(id_col, F.col(length).cast("long").alias("len")).join(best, "len").select(id_col, "reference_id")


def simple_select(rows: DataFrame, id_col: str, length: str, ratio: float = 0.3, least: int = 50) -> DataFrame:
    """Rows (id, role, reference_id): the longest share become references, other rows their children by
    nearest length, rows under ``least`` (or without a length) are discarded."""
    eligible = rows.where(F.col(length) >= least).select(id_col, length)
    chosen = longest(eligible, id_col, length, ratio)
    references = eligible.join(chosen, id_col, "left_semi")
    children = nearest(eligible.join(chosen, id_col, "left_anti"), references, id_col, length)
    short = rows.where(F.col(length).isNull() | (F.col(length) < least)).select(id_col)
    none = F.lit(None).cast("long")
    return (
        chosen.select(id_col, F.lit("reference").alias("role"), none.alias("reference_id"))
        .unionByName(children.select(id_col, F.lit("child").alias("role"), F.col("reference_id").cast("long").alias("reference_id")))
        .unionByName(short.select(id_col, F.lit("discarded").alias("role"), none.alias("reference_id")))
    )


def bucketed(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first edge that ``value`` is under, else ``last``."""
    out = F.lit(last)
    for edge, label in reversed(edges):
        out = F.when(value < edge, label).otherwise(out)
    return out
