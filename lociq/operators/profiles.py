"""Choosing by seeds and coverage, stored profiles of a reduction, and batches of deltas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.sequence import kmers
from lociq.operators.sampling import numbered_within

# Ranks and the bytes from which a chunk of that rank is wanted.
RANK_BYTES = {"superkingdom": 100 << 20, "kingdom": 50 << 20, "phylum": 20 << 20, "class": 10 << 20, "order": 5 << 20, "family": 2 << 20, "genus": 1 << 20, "species": 500 << 10, "subspecies": 100 << 10}


def rank_bytes(rank: Column) -> Column:
    """The least size of a chunk of a rank; 1 MiB for others."""
    out = F.lit(1 << 20)
    for name, size in RANK_BYTES.items():
        out = F.when(rank == name, F.lit(size)).otherwise(out)
    return out


def taxonomy_weight(shared: Column, depth: Column) -> Column:
    """From 0.8 for nothing shared with the reference lineage to 1.5 for all of it; 1 if unknown."""
    return F.when(depth.isNull() | shared.isNull() | (depth == 0), 1.0).otherwise(0.8 + 0.7 * F.least(shared / depth, F.lit(1.0)))


def suggested_clusters(n: Column, size: int = 1000) -> Column:
    """The whole part of n / size, from 1 to 1000."""
    return F.least(F.greatest(F.floor(n / size), F.lit(1)), F.lit(1000)).cast("long")


def memory_estimate(n: Column, total: Column) -> Column:
    """MiB for sequences of a total size: ten times it, and a hundredth of all pairs' lengths."""
    return F.floor(total * 10 / (1 << 20)) + F.floor(n * total / (1 << 20) / 100)


def seed_cover(rows: DataFrame, group: str, id_col: str, text: str, k: int = 12, gain: int = 10) -> DataFrame:
    """Rows (group, id, n_new): within each group, the first row by id and each that has over ``gain`` new k-mers.

    What a row adds depends on all chosen before it, so a group is one task; groups are meant to be clades
    of bounded size, and k-mers are hashed to 8 bytes before they leave the JVM.
    """
    keyed = rows.select(F.col(group).alias("g"), F.col(id_col).cast("long").alias("id"), F.transform(kmers(F.col(text), k), lambda x: F.xxhash64(x)).alias("ks"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        out = []
        for row in pdf.sort_values("id").itertuples():
            new = set(row.ks) - seen
            if not out or len(new) > gain:
                seen |= new
                out.append((row.g, row.id, len(new)))
        return pd.DataFrame(out, columns=["g", "id", "n_new"])

    kind = rows.schema[group].dataType.simpleString()
    return keyed.groupBy("g").applyInPandas(run, f"g {kind}, id long, n_new long").withColumnRenamed("g", group)


def auto_select(rows: DataFrame, id_col: str, length: str, kmers_col: Column, target: float = 0.95) -> DataFrame:
    """Rows (id, gain, coverage): longest first, how much of all distinct k-mers the rows so far cover, up to
    the target. The first owner of each k-mer is a minimum, so nothing is decided row by row."""
    ranked = rows.select(F.col(id_col).alias("id"), F.struct((-F.col(length)).alias("l"), F.col(id_col).alias("i")).alias("o"), F.explode(kmers_col).alias("kmer"))
    owners = ranked.groupBy("kmer").agg(F.min("o").alias("o")).groupBy("o").agg(F.count("*").alias("gain"))
    total = owners.agg(F.sum("gain").alias("total"))
    by_length = owners.groupBy(F.col("o.l").alias("l")).agg(F.sum("gain").alias("g"))
    ahead = by_length.select("l", (F.sum("g").over(Window.partitionBy(F.lit(1)).orderBy("l")) - F.col("g")).alias("before"))
    within = Window.partitionBy("o.l").orderBy("o.i")
    placed = owners.withColumn("_r", F.sum("gain").over(within)).join(ahead, F.col("o.l") == F.col("l")).crossJoin(total)
    covered = (F.col("before") + F.col("_r")) / F.col("total")
    earlier = (F.col("before") + F.col("_r") - F.col("gain")) / F.col("total")
    return placed.where(earlier < target).select(F.col("o.i").alias("id"), "gain", F.round(covered, 6).alias("coverage"))


def batched(rows: DataFrame, group: str, order: str, most: int = 1000) -> DataFrame:
    """``rows`` with batch_no: up to ``most`` deltas of a reference in each."""
    placed = numbered_within(rows, group, [order], "_place")
    return placed.select(*rows.columns, F.expr(f"_place div {most}").cast("long").alias("batch_no"))


def save_profile(selection: DataFrame, path: str, database: str, version: str, profile: str) -> None:
    """Write a reduction below database, version and profile; writing it again replaces that profile only."""
    selection.write.mode("overwrite").parquet(f"{path}/database={database}/version={version}/profile={profile}")


def load_profile(spark, path: str, database: str, version: str, profile: str) -> DataFrame:  # noqa: ANN001
    return spark.read.parquet(f"{path}/database={database}/version={version}/profile={profile}")
