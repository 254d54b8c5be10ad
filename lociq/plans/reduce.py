"""The whole reduction: filter, choose references, encode the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators import filters, lengths, select, similarity
from lociq.operators.align import delta, delta_cost
from lociq.storage import stash

# The similarity thresholds that target aligners work with.
TARGETS = {"blast": 0.85, "lambda": 0.8, "kraken": 0.85, "diamond": 0.9}


@dataclass(frozen=True)
class Reduction:
    """selection: (id, role, reference_id); deltas: (id, reference_id, ops, cost); long_children: not encoded."""

    selection: DataFrame
    deltas: DataFrame
    long_children: DataFrame


def reduce(rows: DataFrame, id_col: str, text: str, ratio: float = 0.3, target: str | None = None, k: int = 3, least: int = 50, entropy: float = 0.0, longest: int = 10_000) -> Reduction:
    """Choose references and encode the other rows against them, losing nothing.

    Rows under the length or entropy go (role 'discarded'). Without a target the longest share become
    references and the others go to the one of nearest length; with a target aligner, references are chosen
    greedily at its similarity threshold, and ``ratio`` is not used. Children over ``longest`` stay whole.
    """
    body = rows.where(F.col(text).isNotNull()).select(id_col, text, F.length(text).cast("long").alias("len"))
    clear = filters.complex_enough(body, text, entropy, least) if entropy > 0 else body.where(F.col("len") >= least)
    if target is None:
        found = lengths.simple_select(clear, id_col, "len", ratio, least)
    else:
        edges = similarity.jaccard_pairs(clear, id_col, text, k, TARGETS[target])
        chosen = select.greedy(clear, edges, id_col, "len")
        role = F.when(F.col("reference_id").isNull(), "reference").otherwise("child")
        found = chosen.select(F.col("id").alias(id_col), role.alias("role"), "reference_id")
    gone = rows.join(clear, id_col, "left_anti").select(id_col, F.lit("discarded").alias("role"), F.lit(None).cast("long").alias("reference_id"))
    selection = stash(found.unionByName(gone), "selection")
    children = selection.where("role = 'child'").select(id_col, "reference_id").join(body, id_col)
    references = body.select(F.col(id_col).alias("reference_id"), F.col(text).alias("_reference"))
    coded = children.where(F.col("len") <= longest).join(references, "reference_id").withColumn("ops", delta(F.col("_reference"), F.col(text)))
    return Reduction(selection, coded.select(id_col, "reference_id", "ops", delta_cost(F.col("ops")).alias("cost")), children.where(F.col("len") > longest).select(id_col, "reference_id"))
