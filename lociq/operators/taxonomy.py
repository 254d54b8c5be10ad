"""Trees given as (id, parent) rows: closure, ancestors, distances and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.storage import stash


def closure(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """Rows (node, ancestor, hops), each node with itself at 0 hops.

    Pointers double each round, so a tree of depth d takes about log2(d) joins; each round's rows are written to
    the shared folder. A root has a null parent
    or itself; a parent that is no node counts as an ancestor without further ones. Any depth will do; a cycle is an error.
    """
    edges = tree.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(node))).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"))
    nodes = tree.select(F.col(node).alias("node")).unionByName(edges.select(F.col("ancestor").alias("node"))).distinct()
    reach = stash(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops")).unionByName(edges.withColumn("hops", F.lit(1))), "closure")
    far = 1
    while True:
        # from all ancestors at ``far`` hops to those of up to twice as many
        tips = reach.where(F.col("hops") == far).select("node", F.col("ancestor").alias("mid"))
        beyond = reach.where("hops > 0").select(F.col("node").alias("mid"), "ancestor", "hops")
        more = stash(tips.join(beyond, "mid").select("node", "ancestor", (F.col("hops") + far).alias("hops")), "closure")
        same, met = F.col("node") == F.col("ancestor"), F.col("hops") == 2 * far
        n, cycles, farthest = more.agg(F.count("*"), F.count(F.when(same, 1)), F.count(F.when(met, 1))).first()
        if cycles:
            raise ValueError("the tree has a cycle")
        if n:
            reach = reach.unionByName(more)
        if not farthest:
            break
        far *= 2
    return reach


def lineage(paths: DataFrame) -> DataFrame:
    """Rows (node, depth, lineage): the ids from the root to the node, joined by /."""
    ordered = F.sort_array(F.collect_list(F.struct("hops", F.col("ancestor").cast("string").alias("a"))), asc=False)
    return paths.groupBy("node").agg((F.count("*") - 1).alias("depth"), F.array_join(F.transform(ordered, lambda x: x["a"]), "/").alias("lineage"))


def descendants(paths: DataFrame, top: Column) -> DataFrame:
    return paths.where(F.col("ancestor") == top).select("node", "hops")


def pair_distances(paths: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (a, b, lca, hops, distance): the last common ancestor, the hops over it, and the
    distance (la + lb - 2c) / (2 max(la, lb)) for lineages of la and lb nodes that share c, 0 for a = b."""
    depth = paths.groupBy("node").agg((F.max("hops") + 1).alias("size"))
    side = lambda name: paths.select(F.col("node").alias(name), "ancestor", F.col("hops").alias(f"hops_{name}"))
    common = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).join(side("a"), "a").join(side("b"), ["b", "ancestor"])
    best = common.groupBy("a", "b").agg(F.min(F.struct((F.col("hops_a") + F.col("hops_b")).alias("hops"), "ancestor")).alias("m"))
    sized = best.join(depth.select(F.col("node").alias("a"), F.col("size").alias("la")), "a").join(depth.select(F.col("node").alias("b"), F.col("size").alias("lb")), "b")
    distance = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.least(F.lit(1.0), F.col("m.hops") / (2.0 * F.greatest("la", "lb"))))
    return sized.select("a", "b", F.col("m.ancestor").alias("lca"), F.col("m.hops").cast("long").alias("hops"), F.round(distance, 6).alias("distance"))


def ancestor_at_rank(paths: DataFrame, ranks: DataFrame, rank: str) -> DataFrame:
    """Rows (node, ancestor): each node's nearest ancestor of a rank; ``ranks`` has (node, rank)."""
    named = ranks.where(F.col("rank") == rank).select(F.col("node").alias("ancestor"))
    return paths.join(named, "ancestor").groupBy("node").agg(F.min(F.struct("hops", "ancestor")).alias("m")).select("node", F.col("m.ancestor").alias("ancestor"))


def rollup(paths: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (ancestor, own, total): ``counts`` (node, n) added up along the lineages; unobserved nodes too."""
    sums = paths.join(counts, "node", "left").groupBy("ancestor")
    own = F.coalesce(F.sum(F.when(F.col("hops") == 0, F.col("n"))), F.lit(0)).cast("long")
    return sums.agg(own.alias("own"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def coverage(paths: DataFrame, counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows (rank, n_taxa, n_sequences, percent): observed ancestors of each rank and what lies below them."""
    met = counts.join(paths, "node").join(ranks.select(F.col("node").alias("ancestor"), "rank"), "ancestor")
    total = counts.agg(F.sum("n").alias("_total"))
    sums = met.groupBy("rank").agg(F.count_distinct("ancestor").alias("n_taxa"), F.sum("n").alias("n_sequences"))
    return sums.crossJoin(total).select("rank", "n_taxa", "n_sequences", F.round(100.0 * F.col("n_sequences") / F.col("_total"), 4).alias("percent"))


def tree_diff(old: DataFrame, new: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Rows (node, old_parent, new_parent, change): New, Deprecated, Reparented, or Merged for a node that
    went and whose children that stayed all have one same new parent."""
    a = old.select(F.col(node).alias("node"), F.col(parent).alias("old_parent"), F.lit(1).alias("_a"))
    b = new.select(F.col(node).alias("node"), F.col(parent).alias("new_parent"), F.lit(1).alias("_b"))
    both = a.join(b, "node", "full_outer")
    kind = F.when(F.col("_a").isNull(), "New").when(F.col("_b").isNull(), "Deprecated").when(~F.col("old_parent").eqNullSafe(F.col("new_parent")), "Reparented")
    found = both.withColumn("change", kind).where("change is not null")
    into = found.where("change = 'Reparented'").groupBy(F.col("old_parent").alias("node")).agg(F.count_distinct("new_parent").alias("_n"), F.min("new_parent").alias("_into"))
    merged = (F.col("change") == "Deprecated") & (F.col("_n") == 1)
    out = found.join(into, "node", "left")
    return out.select("node", "old_parent", F.when(merged, F.col("_into")).otherwise(F.col("new_parent")).alias("new_parent"), F.when(merged, "Merged").otherwise(F.col("change")).alias("change"))


def remap(members: DataFrame, mapping: DataFrame, chunk: str, taxon: str) -> DataFrame:
    """Rows (chunk, taxa): each chunk's taxa after ``mapping`` (old, new), distinct, sorted, joined by commas."""
    mapped = members.join(mapping.select(F.col("old").alias(taxon), "new"), taxon, "left").select(chunk, F.coalesce("new", taxon).alias("t"))
    return mapped.groupBy(chunk).agg(F.array_join(F.array_sort(F.collect_set("t")).cast("array<string>"), ",").alias("taxa"))


def by_name(names: DataFrame, wanted: str) -> DataFrame:
    """The one row (node, name) that fits best: exact in any case, else the first substring hit, by smaller id."""
    exact = (F.lower("name") != wanted.lower()).cast("int")
    return names.where(F.contains(F.lower("name"), F.lit(wanted.lower()))).orderBy(exact, "node").limit(1)


def at_rank(ranks: DataFrame, rank: str) -> DataFrame:
    return ranks.where(F.col("rank") == rank).select("node")


def common_rank(paths: DataFrame, ranks: DataFrame, pairs: DataFrame, close: str) -> DataFrame:
    """Rows (a, b, common_rank, is_close): the rank of the last common ancestor, and whether it is ``close``."""
    tops = pair_distances(paths, pairs).select("a", "b", F.col("lca").alias("node"))
    return tops.join(ranks.select("node", "rank"), "node").select("a", "b", F.col("rank").alias("common_rank"), (F.col("rank") == close).alias("is_close"))


def siblings(paths: DataFrame, ranks: DataFrame, rank: str) -> DataFrame:
    """Rows (ancestor, n): how many nodes share each ancestor of a rank."""
    return ancestor_at_rank(paths, ranks, rank).groupBy("ancestor").agg(F.count("*").alias("n"))


def ranked_children(totals: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows (parent, node, total, place): children by total downward, ties by id, as a tree shows them."""
    order = Window.partitionBy("parent").orderBy(F.desc("total"), "node")
    return totals.select(F.col("ancestor").alias("node"), "total").join(parents, "node").withColumn("place", F.row_number().over(order))
