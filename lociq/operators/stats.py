"""Statistics of a collection of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions import sequence as S
from lociq.operators import lengths as L

# The histogram edges and labels.
LENGTH_EDGES = [(100, "<100"), (500, "100-499"), (1000, "500-999"), (5000, "1000-4999"), (10000, "5000-9999")]
LENGTH_LAST = ">=10000"
GC_EDGES = [(20, "0-20"), (40, "20-40"), (60, "40-60"), (80, "60-80")]
GC_LAST = "80-100"


def summary(rows: DataFrame, text: str) -> DataFrame:
    """One row: count, total, average, shortest, longest, upper median, n50, n90, GC and gap counts."""
    body = F.col(text)
    measured = rows.where(body.isNotNull()).select(F.length(body).cast("long").alias("len"), S.count_of(body, "GC").alias("gc"), S.count_of(body, "ATU").alias("at"), (F.length(body) - F.length(F.translate(body, "-.", ""))).alias("gaps"), S.count_of(body, S.AMBIGUOUS).alias("ambiguous"))
    sums = measured.agg(F.count("*").alias("n_sequences"), F.sum("len").alias("total_length"), F.min("len").alias("min_length"), F.max("len").alias("max_length"), F.sum("gc").alias("n_gc"), F.sum("at").alias("n_at"), F.sum("gaps").alias("n_gaps"), F.sum("ambiguous").alias("n_ambiguous"))
    lengths = L.by_length(measured, "len")
    wide = sums.crossJoin(L.upper_median(lengths)).crossJoin(L.nx(lengths))  # one row each
    return wide.withColumn("avg_length", F.round(F.col("total_length") / F.col("n_sequences"), 4))


def labelled_counts(rows: DataFrame, label: Column, labels: list[str], name: str) -> DataFrame:
    """Rows (name, n) for every label, zero where none has it."""
    counts = rows.groupBy(label.alias(name)).agg(F.count("*").alias("n"))
    all_ = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{name} string")
    return all_.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def length_histogram(rows: DataFrame, length: Column) -> DataFrame:
    labels = [x for _, x in LENGTH_EDGES] + [LENGTH_LAST]
    return labelled_counts(rows.where(length.isNotNull()), L.bucketed(length, LENGTH_EDGES, LENGTH_LAST), labels, "bucket")


def gc_histogram(rows: DataFrame, text: Column) -> DataFrame:
    labels = [x for _, x in GC_EDGES] + [GC_LAST]
    return labelled_counts(rows.where(text.isNotNull()), L.bucketed(S.gc_percent(text), GC_EDGES, GC_LAST), labels, "bucket")


def residue_frequencies(rows: DataFrame, text: str) -> DataFrame:
    """Rows (residue, n, percent) of all characters; counted within each row first, so few rows shuffle."""
    each = rows.select(F.explode(S.letters(F.col(text))).alias("residue"))
    counts = each.groupBy("residue").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def dataset_entropy(rows: DataFrame, text: str) -> DataFrame:
    """Row (n_residues, entropy): Shannon entropy in bits of all characters."""
    counts = residue_frequencies(rows, text).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    return counts.agg(F.count("*").alias("n_residues"), F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"))


def length_diversity(rows: DataFrame, length: str) -> DataFrame:
    """Row (n, diversity): 1 less the sum of squared shares of the total length."""
    share = F.col(length).cast("double")
    return rows.agg(F.count(length).alias("n"), F.round(1 - F.sum(share * share) / (F.sum(share) * F.sum(share)), 9).alias("diversity"))


def type_distribution(rows: DataFrame, text: str) -> DataFrame:
    """Rows (kind, n, is_primary): protein is primary only if it has strictly more rows."""
    counts = rows.groupBy(S.sequence_type(F.col(text)).alias("kind")).agg(F.count("*").alias("n"))
    protein = F.coalesce(F.sum(F.when(F.col("kind") == "Protein", F.col("n"))).over(Window.partitionBy(F.lit(1))), F.lit(0))
    rest = F.coalesce(F.sum(F.when(F.col("kind") != "Protein", F.col("n"))).over(Window.partitionBy(F.lit(1))), F.lit(0))
    return counts.withColumn("is_primary", F.when(protein > rest, F.col("kind") == "Protein").otherwise(F.col("kind") != "Protein"))


def high_diversity_groups(rows: DataFrame, group: str, length: str, least: int = 10, spread: float = 0.5) -> DataFrame:
    """Rows (group, n, cv, is_diverse): ten or more rows with a coefficient of variation over one half."""
    stats = rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.stddev_pop(length) / F.avg(length), 6).alias("cv"))
    return stats.withColumn("is_diverse", (F.col("n") >= least) & (F.col("cv") > spread))


def low_complexity_windows(rows: DataFrame, id_col: str, text: str, window: int = 20, most: int = 14) -> DataFrame:
    """Rows (id, n_windows, n_low): windows stepping a hundredth of the length, low if one residue fills it."""
    step = F.greatest(F.expr(f"length({text}) div 100"), F.lit(1))
    starts = F.sequence(F.lit(1), F.length(text) - window + 1, step)
    fullest = lambda w: F.array_max(F.transform(F.array_distinct(S.letters(w)), lambda c: F.length(w) - F.length(F.replace(w, c, F.lit("")))))
    windows = F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(window)))
    counted = rows.where(F.length(text) >= window).select(id_col, F.transform(windows, fullest).alias("w"))
    return counted.select(id_col, F.size("w").cast("long").alias("n_windows"), F.size(F.filter("w", lambda k: k > most)).cast("long").alias("n_low"))
