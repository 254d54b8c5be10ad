"""Connected components of an edge table, by stars, all in tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import discard, stash

#: Nodes that a task holds while it thins edges; beyond them it begins anew, and more edges stay.
HELD_NODES = 500_000


def thin(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what ``edges`` connect: each task leaves out those between nodes that its earlier
    ones connect, so a group in which all are linked with all is a few edges a node before anything is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):  # noqa: ANN001, ANN202
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if (x := top(x)) != (y := top(y)):
                    above[x] = y
                    kept.append(k)
            if len(above) > HELD_NODES:
                above.clear()
            if kept:
                yield batch.take(pa.array(kept))

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is the smallest node.

    The two columns have one type that has an order, such as long or binary. Edges are thinned where they are;
    then come rounds of two steps until nothing changes. In the large step each node hands its smallest neighbour
    to its larger neighbours; in the small step, to its smaller ones. Both keep connectivity, and the
    edges end as stars around each smallest node. Every round's edges are written to the shared folder, so the
    plan stays short, and those of the round before are deleted. A minimum is taken with partial aggregation and
    joined back, so that a node with very many neighbours is one row on one side of the join, and Spark can split the
    other.

    Edges with a null end or to the same node are ignored; direction and repeats make no difference. An
    empty table gives no rows.
    """
    small, large = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    some = thin(edges.where(F.col(a) != F.col(b)).select(large.alias("u"), small.alias("v")))
    now = stash(some.distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        before, now = now, stash(_small(_large(now)), "edges")
        discard(before)
        if (after := _mark(now)) == mark:
            break
        mark = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
