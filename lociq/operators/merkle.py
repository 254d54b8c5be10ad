"""Merkle roots and proofs over ordered hashes, level by level."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.storage import stash


def numbered(leaves: DataFrame, hash_col: str) -> DataFrame:
    """Rows (pos, hash) in the order of distinct hashes: ranks within hash prefixes plus the prefix's offset."""
    keyed = leaves.select(F.col(hash_col).alias("hash")).where("hash is not null").distinct().withColumn("_p", F.substring("hash", 1, 3))
    counts = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_p").orderBy("hash")
    return keyed.withColumn("_r", F.row_number().over(within)).join(offsets, "_p").select((F.col("_before") + F.col("_r") - 1).alias("pos"), "hash")


def _up(level: DataFrame, duplicate: bool) -> DataFrame:
    pairs = level.groupBy(F.expr("pos div 2").alias("pos")).agg(F.min_by("hash", "pos").alias("l"), F.when(F.count("*") > 1, F.max_by("hash", "pos")).alias("r"))
    right = F.coalesce("r", "l") if duplicate else F.col("r")
    joined = F.sha2(F.concat(F.unhex("l"), F.unhex(right)), 256)
    return pairs.select("pos", F.when(right.isNull(), F.col("l")).otherwise(joined).alias("hash"))


def levels(leaves: DataFrame, hash_col: str, duplicate: bool = False) -> list[DataFrame]:
    """All levels from the leaves to the root; an odd node moves up, or is paired with itself."""
    level = stash(numbered(leaves, hash_col), "merkle")
    out = [level]
    n = level.count()
    while n > 1:
        level = stash(_up(level, duplicate), "merkle")
        out.append(level)
        n = (n + 1) // 2
    return out


def _up_many(level: DataFrame, steps: int, duplicate: bool) -> DataFrame:
    """``steps`` levels at once: 2^steps neighbours are one row and are paired in it; only the last can be odd."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
    groups = level.groupBy(F.shiftright("pos", steps).alias("pos")).agg(ordered.alias("a"))

    def pair(nodes: Column, i: Column) -> Column:
        left, right = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        both = lambda other: F.sha2(F.concat(F.unhex(left), F.unhex(other)), 256)
        return F.when(right.isNotNull(), both(right)).otherwise(both(left) if duplicate else left)

    half = lambda nodes, _: F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: pair(nodes, i))
    return groups.select("pos", F.get(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), "a", half), F.lit(0)).alias("hash"))


def root(leaves: DataFrame, hash_col: str, duplicate: bool = False) -> DataFrame:
    """Row (n_leaves, root); no row without leaves. Eight levels are one job."""
    level = stash(numbered(leaves, hash_col), "merkle")
    n = level.agg(F.count("*").alias("n_leaves"))
    left = level.count()
    while left > 1:
        steps = min(8, (left - 1).bit_length())
        level = stash(_up_many(level, steps, duplicate), "merkle")
        left = (left + (1 << steps) - 1) >> steps
    return n.crossJoin(level.select(F.col("hash").alias("root")))


def proof(tree: list[DataFrame], pos: int, with_level: bool = False) -> list[tuple]:
    """The siblings from a leaf to the root, each with its side, and before them the level if wanted; one row is looked
    up in each level."""
    path = []
    for k, level in enumerate(tree[:-1]):
        row = level.where(F.col("pos") == (pos ^ 1)).first()
        if row:
            path.append((*[k] * with_level, row["hash"], "left" if pos & 1 else "right"))
        pos //= 2
    return path


def verify(leaf: str, path: list[tuple[str, str]], root_hash: str) -> bool:
    now = bytes.fromhex(leaf)
    for sibling, side in path:
        other = bytes.fromhex(sibling)
        now = hashlib.sha256(other + now if side == "left" else now + other).digest()
    return now.hex() == root_hash


def mismatches(chunks: DataFrame, hash_col: str, body: str) -> DataFrame:
    """Chunks whose content no longer has its hash, or is gone."""
    return chunks.where(F.col(body).isNull() | (F.sha2(body, 256) != F.col(hash_col)))


def seal(sequence_root: str, taxonomy_root: str, at: str) -> str:
    """The hash that binds both roots to a time; a temporal proof is two proofs and this."""
    return hashlib.sha256(f"{sequence_root}:{taxonomy_root}:{at}".encode()).hexdigest()


def verify_temporal(leaves: tuple[str, str], paths: tuple[list, list], roots: tuple[str, str], at: str, sealed: str) -> bool:
    """Whether both leaves lead to their roots and the roots and the time to the seal."""
    return all(verify(leaf, path, root_) for leaf, path, root_ in zip(leaves, paths, roots)) and seal(*roots, at) == sealed
