"""Grouping and packing by clade: rank-wise chunks, balanced clusters, special organisms, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.taxonomy import pair_distances

# Organisms of a category, and parts of names that tell it.
MODEL_ORGANISMS = (9606, 10090, 10116, 7227, 6239, 7955, 3702, 4932, 559292, 511145, 83333, 224308)
PATHOGENS = (1773, 1280, 573, 287, 470, 666, 662, 90371, 28901, 550, 1352, 5207, 5476, 36329, 5833, 5811, 10245, 11320, 11520, 2697049, 694009, 1335626, 11103, 10407, 11676, 11709, 10376, 10298, 10310)
ENVIRONMENTAL = (1883, 1423, 316, 303, 1735, 1148, 1140, 146891, 312, 192, 29413, 2287, 2234)
PATHOGEN_NAMES = ("pathogen", "virulent", "disease", "infectious", "outbreak", "epidemic", "clinical isolate", "hospital")
ENVIRONMENTAL_NAMES = ("environmental", "uncultured", "marine", "ocean", "soil", "sediment", "freshwater", "lake", "river", "compost", "rhizosphere", "symbiont", "endophyte", "thermophil", "psychrophil", "halophil", "extremophil", "metagenom", "microbiome")


def category(taxon: Column, name: Column | None = None) -> Column:
    """'model', 'pathogen', 'environmental' or 'other', the first that holds by id or by name."""
    lower = F.lower(F.lit("") if name is None else F.coalesce(name, F.lit("")))
    any_of = lambda words: lower.rlike("|".join(words))
    model = taxon.isin(*MODEL_ORGANISMS) | lower.contains("model organism") | (lower.contains("laboratory") & any_of(("strain", "isolate")))
    pathogen = taxon.isin(*PATHOGENS) | any_of(PATHOGEN_NAMES) | (lower.contains("resistant") & ~lower.contains("antibiotic-sensitive"))
    environmental = taxon.isin(*ENVIRONMENTAL) | any_of(ENVIRONMENTAL_NAMES)
    return F.when(model, "model").when(pathogen, "pathogen").when(environmental, "environmental").otherwise("other")


def attached(counts: DataFrame, paths: DataFrame, preferred: list, least: int, most: int, near: float = 0.3) -> DataFrame:
    """Rows (node, cluster) of counts (node, n): preferred nodes, and those of ``least`` rows at least, are anchors of clusters
    of their own; every other node goes to the nearest anchor under a distance of ``near``, ties by name, as long as the
    cluster stays within ``most`` rows, nodes in order of their names; the rest are clusters by themselves.

    Only pairs under a common ancestor that is near enough for such a distance are compared, never all with all.
    """
    is_anchor = (F.col("n") >= least) | (F.col("node").isin(*preferred) if preferred else F.lit(False))
    marked = counts.select("node", "n", is_anchor.alias("_a"))
    deepest = paths.agg(F.max("hops") + 1).first()[0] or 1
    close = paths.where(F.col("hops") <= F.lit(2 * near * deepest))
    side = lambda anchor, name: marked.where(F.col("_a") == anchor).select("node").join(close, "node").select(F.col("node").alias(name), "ancestor")
    pairs = side(False, "a").join(side(True, "b"), "ancestor").select("a", "b").distinct()
    met = pair_distances(paths, pairs).where(F.col("distance") < near)
    best = met.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("distance", "b")).alias("m")).select("node", F.col("m.b").alias("_to"))
    wanted = marked.where(~F.col("_a")).join(best, "node", "left")
    room = marked.where("_a").select(F.col("node").alias("_to"), F.col("n").alias("_own"))
    held = F.sum("n").over(Window.partitionBy("_to").orderBy("node"))
    placed = wanted.where("_to is not null").withColumn("_held", held).join(room, "_to")
    fits = F.col("_own") + F.col("_held") <= most
    out = placed.select("node", F.when(fits, F.col("_to")).otherwise(F.col("node")).alias("cluster"))
    alone = wanted.where("_to is null").select("node", F.col("node").alias("cluster"))
    return out.unionByName(alone).unionByName(marked.where("_a").select("node", F.col("node").alias("cluster")))


def diversity(distances: DataFrame, cluster: str) -> DataFrame:
    """Rows (cluster, n_pairs, diversity): the mean distance of its pairs."""
    return distances.groupBy(cluster).agg(F.count("*").alias("n_pairs"), F.round(F.avg("distance"), 6).alias("diversity"))


def may_cluster(pairs: DataFrame, isolated: list, most: float) -> DataFrame:
    """``pairs`` (a, b, distance) with together: an isolated taxon only with itself, others within a distance."""
    alone = F.col("a").isin(*isolated) | F.col("b").isin(*isolated) if isolated else F.lit(False)
    return pairs.withColumn("together", F.when(alone, F.col("a") == F.col("b")).otherwise(F.col("distance") <= most))


def priority(taxon: Column, n: Column, preferred: list, isolated: list) -> Column:
    """The number of sequences, ten times it for a preferred taxon and a hundred times for an isolated one."""
    times = lambda among, k: F.when(taxon.isin(*among), k).otherwise(1) if among else F.lit(1)
    return (n * times(preferred, 10) * times(isolated, 100)).cast("double")


def cluster_errors(clusters: DataFrame, cluster: str, taxon: str, n: str, isolated: list, least: int, most: int) -> DataFrame:
    """Rows (cluster, error) of clusters that are too small, too large or hold two isolated taxa."""
    alone = F.count_distinct(F.when(F.col(taxon).isin(*isolated), F.col(taxon)))
    sums = clusters.groupBy(cluster).agg(F.sum(n).alias("_n"), alone.alias("_i"))
    error = F.when(F.col("_n") < least, "too small").when(F.col("_n") > most, "too large").when(F.col("_i") > 1, "isolated taxa together")
    return sums.select(cluster, error.alias("error")).where("error is not null")


def by_every_rank(paths: DataFrame, ranks: DataFrame, members: DataFrame, node: str) -> DataFrame:
    """Rows (rank, ancestor, n): members under each ancestor of their lineage; each counts at every rank."""
    met = members.select(F.col(node).alias("node")).groupBy("node").agg(F.count("*").alias("k")).join(paths, "node")
    return met.join(ranks.select(F.col("node").alias("ancestor"), "rank"), "ancestor").groupBy("rank", "ancestor").agg(F.sum("k").alias("n"))


def packed_by_rank(groups: DataFrame, least: dict[str, int]) -> DataFrame:
    """Rows (rank, ancestor, n, n_chunks): groups of a rank that reach its least size, cut at twice that size."""
    size = F.coalesce(*(F.when(F.col("rank") == rank, F.lit(n)) for rank, n in least.items()))
    sized = groups.withColumn("_least", size).where(F.col("n") >= F.col("_least"))
    return sized.select("rank", "ancestor", "n", F.ceil(F.col("n") / (2 * F.col("_least"))).cast("long").alias("n_chunks"))


def clusters(counts: DataFrame, node: str, parent: str, most: int) -> DataFrame:
    """Rows (node, cluster): nodes of more than ``most`` rows by themselves, smaller ones packed with their
    siblings in order until a cluster is full; the running sum is per parent."""
    order = Window.partitionBy(parent).orderBy(F.desc("n"), node)
    small = counts.where(F.col("n") <= most).withColumn("_before", F.sum("n").over(order) - F.col("n"))
    packed = small.select(node, F.concat_ws(":", parent, F.expr(f"_before div {most}").cast("string")).alias("cluster"))
    return packed.unionByName(counts.where(F.col("n") > most).select(node, F.concat_ws(":", parent, F.lit("own"), F.col(node).cast("string")).alias("cluster")))


def near_taxa(distances: DataFrame, most: float) -> DataFrame:
    """Rows of pair_distances within a distance."""
    return distances.where((F.col("a") != F.col("b")) & (F.col("distance") <= most))


def impact(changes: DataFrame, members: DataFrame, node: str) -> DataFrame:
    """Rows (change, n_taxa, n_sequences): what a new tree version touches; ``changes`` from tree_diff."""
    counts = members.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n"))
    return changes.select("node", "change").join(counts, "node", "left").groupBy("change").agg(F.count("*").alias("n_taxa"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sequences"))
