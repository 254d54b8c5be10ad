"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the ordered nearest of some reference vectors, the pivots. Inverted lists hold
for each pivot the vectors that have it among their nearest. Vectors that share enough pivots are
candidates, and their cosine is verified in double precision. A pair is taken in the list of the first
pivot that it shares, so a vector needs only as many lists as leave too few pivots to share outside of
them. A long list is cut by the second shared pivot, and what is long even then is compared block by
block. Only counts and the edges of a spanning forest leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import stash
from lociq.llm.components import components

#: Pivots at most: they are a bounded sample of the vectors, broadcast to all tasks.
MOST_PIVOTS = 32_768
#: Bytes, in double precision, of the sample that they are chosen from at most.
SAMPLE_BYTES = 1 << 27
#: Cosines under which two pivots stay, the later ones only where the earlier leave too few pivots: near
#: copies of one vector would share its list among them.
PIVOTS_APART = (0.7, 0.8, 0.9, 0.95, 0.98)
#: Vectors that one task compares with each other, or of each of two blocks.
BLOCK = 2048
#: Cosines held at once while pivots are chosen or found.
CELLS = 1 << 22


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest component first, so nothing overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True)) + 0.0


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit rows of lists of ``dim`` numbers."""
    joined = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return _unit(joined.flatten().to_numpy(zero_copy_only=False).reshape(len(joined), dim))


def _key(vector: Column) -> Column:
    """16 bytes that stand for the components; null for vectors that are null, empty or zero, or hold a null
    or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    linkable = F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), vector)), 16, "0") for seed in (1, 2)]
    return F.when(linkable, F.unhex(F.concat(*halves)))


def spread(candidates: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` of the candidates in their order, none closer to another than the first bar of
    PIVOTS_APART; where these are too few, more by the next bar, and so on."""
    kept = np.zeros(0, int)
    for bar in PIVOTS_APART:
        for start in range(0, len(candidates), 512):
            at = np.setdiff1d(np.arange(start, min(start + 512, len(candidates))), kept)
            far = at[(candidates[at] @ candidates[kept].T < bar).all(axis=1)] if len(kept) else at
            near = candidates[far] @ candidates[far].T >= bar
            chosen: list[int] = []
            for k in range(len(far)):
                if len(kept) + len(chosen) < wanted and not near[k, chosen].any():
                    chosen.append(k)
            kept = np.append(kept, far[chosen])
    return candidates[kept]


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, the nearest first; ties by number."""
    out = np.zeros((len(rows), min(nearest, len(pivots))), np.int64)
    step = max(1, CELLS // max(1, len(pivots)))
    for k in range(0, len(rows), step):
        cosine = rows[k : k + step].astype(np.float32) @ pivots.T
        some = np.argpartition(-cosine, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(pivots) else np.tile(np.arange(len(pivots)), (len(cosine), 1))
        some.sort(axis=1)
        order = np.argsort(-np.take_along_axis(cosine, some, 1), axis=1, kind="stable")
        out[k : k + step] = np.take_along_axis(some, order, 1)
    return out


def choose_pivots(sample: np.ndarray, wanted: int, nearest: int) -> np.ndarray:
    """Pivots that are spread over the sample, those with the shortest lists in the sample first."""
    pivots = spread(sample, wanted).astype(np.float32)
    return pivots[np.argsort(np.bincount(nearest_pivots(sample, pivots, nearest).ravel(), minlength=len(pivots)), kind="stable")]


def describe(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """``classes`` (key, dim, vec and others) with perm: the numbers of the nearest pivots in order.

    A vector of another dimension than the pivots' is padded with zeros or cut for this only.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        width = pivots.shape[1]
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                dims = part.column("dim").to_numpy()
                rows = np.zeros((part.num_rows, width), np.float32)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    rows[at, : min(dim, width)] = _matrix(part.column("vec").take(pa.array(at)), int(dim))[:, :width]
                perm = nearest_pivots(rows, pivots, nearest) if len(pivots) else np.zeros((len(rows), 1), int)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(perm.tolist(), pa.list_(pa.int32()))], names=[*part.schema.names, "perm"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("perm", T.ArrayType(T.IntegerType()))]))


class _Forest:
    """Edges that connect what all edges so far connect."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)
        self.edges: list[tuple[int, int]] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for k in range(0, len(left), 4096):
            a, b = left[k : k + 4096], right[k : k + 4096]
            open_ = self.root[a] != self.root[b]
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                return x

            for x, y in zip(a[open_].tolist(), b[open_].tolist()):
                rx, ry = find(int(self.root[x])), find(int(self.root[y]))
                if rx != ry:
                    root[ry] = rx
                    self.edges.append((x, y))
            if root:
                label = np.arange(len(self.root))
                for x in list(root):
                    label[x] = find(x)
                self.root = label[self.root]


def _taken(left: np.ndarray, right: np.ndarray, pivot: int, second: int, least: int) -> np.ndarray:
    """Whether each pair of sorted pivot rows shares ``least`` of them, ``pivot`` first and ``second`` next (-1: any)."""
    same = left[:, :, None] == right[:, None, :]
    hit = same.any(axis=2)
    enough = hit.sum(axis=1) >= least
    rank = np.cumsum(hit, axis=1)
    enough &= (np.where(hit & (rank == 1), left, -1).max(axis=1)) == pivot
    return enough if second < 0 else enough & ((np.where(hit & (rank == 2), left, -1).max(axis=1)) == second)


def _compare(pivot: int, second: int, split: np.ndarray, ns: np.ndarray, units: np.ndarray, perms: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The weighted number of links of each row in one list, and a forest of them.

    Rows are compared with each other, or, where ``split`` has both of its values, those of one with those of the other.
    """
    two = split.any() and not split.all()
    first, other = (np.flatnonzero(split), np.flatnonzero(~split)) if two else (np.arange(len(split)), np.arange(len(split)))
    counts = np.zeros(len(split), np.int64)
    forest = _Forest(len(split))
    for k in range(0, len(first), 512):
        rows = first[k : k + 512]
        against = other if two else other[k:]
        a, b = np.nonzero(units[rows] @ units[against].T >= threshold)
        a, b = rows[a], against[b]
        if not two:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            good = _taken(perms[x], perms[y], pivot, second, least)
            x, y = x[good], y[good]
            np.add.at(counts, x, ns[y])
            np.add.at(counts, y, ns[x])
            forest.add(x, y)
    return counts, forest.edges


def _lists(described: DataFrame, least: int) -> DataFrame:
    """Rows (key, dim, pivot, second, i, j, split): the lists, or pairs of blocks of lists, that compare a vector.

    ``perm`` of ``described`` is sorted. Lists of more than BLOCK vectors are cut by second pivots.
    """
    last = F.size("perm") - F.least(F.lit(least), F.size("perm"))
    own = described.select("key", "dim", "perm", F.posexplode(F.slice("perm", F.lit(1), last + 1)).alias("at", "pivot"))
    sizes = own.groupBy("dim", "pivot").agg(F.count("*").alias("_size"))
    sized = own.join(stash(sizes, "lists"), ["dim", "pivot"])
    short = sized.where(F.col("_size") <= BLOCK).select("key", "dim", "pivot", F.lit(-1).alias("second"), F.lit(1).alias("_blocks"))
    long_ = sized.where(F.col("_size") > BLOCK)
    if least > 1:
        rest = F.slice("perm", F.col("at") + 2, F.size("perm"))
        long_ = long_.select("key", "dim", "pivot", F.explode(rest).alias("second"))
    else:
        long_ = long_.select("key", "dim", "pivot", F.lit(-1).alias("second"))
    cut = long_.groupBy("dim", "pivot", "second").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    long_ = long_.join(stash(cut, "cut-lists"), ["dim", "pivot", "second"]).select("key", "dim", "pivot", "second", "_blocks")
    block = F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    pairs = short.unionByName(long_).withColumn("_block", block).withColumn("_other", others)
    return pairs.select("key", "dim", "pivot", "second", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), (F.col("_block") < F.col("_other")).alias("split"))


def near_vectors(df: DataFrame, threshold: float = 0.95, nearest: int = 6, shared_least: int = 2, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, n_links, component_id, kept) for every row.

    n_links counts the other rows whose cosine is ``threshold`` or more and that were found; all found
    links are verified. component_id is the smallest id reachable, the own included. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different dimensions. Ids are longs; rows of equal id count as rows of their own. A null id links as any
    other, is never the smallest id, and is not kept; component_id is null where no reachable row has an id.
    Other columns are not read. An empty table gives no rows. A vector has to fit a task, ``BLOCK`` of them a worker.

    Equal vectors are one class with its size, so copies never meet. There are 2 sqrt(classes) pivots,
    64 to MOST_PIVOTS, taken by ``spread`` from twice as many classes, the first by their hash; only this
    sample, of SAMPLE_BYTES at most, comes to the driver. ``nearest`` pivots describe a vector, and candidates share ``shared_least`` of them.
    A vector is copied for ``nearest - shared_least + 1`` lists, and for each two of its pivots at most where lists are
    long; only beyond BLOCK vectors that share both of two pivots does the number of copies grow with the table.
    """
    keyed = df.select(F.col(id_col).cast("long").alias("id"), _key(F.col(vector_col)).alias("key"), F.col(vector_col).alias("vec"))
    rows = stash(keyed.select("id", "key", F.when(F.col("key").isNotNull(), F.size("vec")).alias("dim")), "vectors")
    distinct = rows.where("key is not null").select("key", "dim").distinct()
    dims = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").collect()
    size = sum(r["count"] for r in dims)
    pivot_rows = np.zeros((0, 1), np.float32)
    if dims:
        most = min(MOST_PIVOTS, SAMPLE_BYTES // (16 * dims[0]["dim"]))
        wanted = pivots or max(64, min(most, 2 * math.isqrt(size)))
        sample = distinct.where(F.col("dim") == dims[0]["dim"]).select("key").orderBy("key").limit(2 * wanted)
        found = keyed.join(F.broadcast(stash(sample, "sample")), "key").groupBy("key").agg(F.first("vec").alias("vec")).orderBy("key").select("vec").toArrow()
        pivot_rows = choose_pivots(_matrix(found.column(0), dims[0]["dim"]), wanted, nearest)
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("dim", F.size("vec"))
    described = stash(describe(classes, pivot_rows, nearest).withColumn("perm", F.sort_array("perm")), "described")
    least = min(shared_least, nearest, max(1, len(pivot_rows)))
    lists = _lists(described, least).join(described.select("key", "n", "vec", "perm"), "key")

    def compare(group: pa.Table) -> pa.Table:
        one = {c: group.column(c)[0].as_py() for c in ("pivot", "second", "dim")}
        ns, keys = group.column("n").to_numpy(), group.column("key").to_pylist()
        perms = group.column("perm").combine_chunks().flatten().to_numpy().reshape(len(ns), -1)
        counts, forest = _compare(one["pivot"], one["second"], group.column("split").to_numpy(), ns, _matrix(group.column("vec"), one["dim"]), perms, threshold, least)
        some = np.flatnonzero(counts).tolist()
        a = [keys[x] for x in some] + [keys[x] for x, _ in forest]
        b = [None] * len(some) + [keys[y] for _, y in forest]
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*counts[some].tolist(), *[0] * len(forest)], pa.int64())], names=["a", "b", "n"])

    found = stash(lists.groupBy("dim", "pivot", "second", "i", "j").applyInArrow(compare, "a binary, b binary, n long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("_n"))
    parts = components(found.where("b is not null"))
    own = described.select("key", "n", "rep")
    linked = own.join(parts, own.key == parts.node)
    smallest = linked.groupBy("component").agg(F.min("rep").alias("_rep"))
    groups = stash(linked.join(smallest, "component").select("key", "_rep"), "groups")
    n_links = (F.col("n") - 1 + F.coalesce("_n", F.lit(0))).alias("n_links")
    labelled = own.join(counts, F.col("key") == F.col("a"), "left").join(groups.withColumn("_in", F.lit(True)), "key", "left")
    labelled = labelled.select("key", n_links, F.when(F.col("_in"), F.col("_rep")).otherwise(F.col("rep")).alias("_component"))
    joined = rows.select("id", "key").join(labelled, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("_component"))
    out = joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
