"""Databases, versions, manifests and indexes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def databases(rows: DataFrame, name: Column, size: str) -> DataFrame:
    """Rows (database, n_sequences, total_size), to be ordered as wanted."""
    return rows.groupBy(name.alias("database")).agg(F.count("*").alias("n_sequences"), F.sum(size).alias("total_size"))


def accession_index(rows: DataFrame, key: str, accessions: Column) -> DataFrame:
    """Rows (accession, key): one for each accession of a row."""
    return rows.select(F.explode(accessions).alias("accession"), key).distinct()


def digest_of(rows: DataFrame, keys: list[str], hash_col: str, digits: int = 2) -> DataFrame:
    """Rows (keys, digest) of hex hashes: those that begin alike are joined in order and hashed, and these again.

    So a group of any size is in parts of one 256th of it (more digits: less), and no row holds all of its hashes.
    """
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list(hash_col)), ""), 256)
    parts = rows.where(F.col(hash_col).isNotNull()).groupBy(*keys, F.substring(hash_col, 1, digits).alias("_p")).agg(joined.alias("_d"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"])
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


def manifest(members: DataFrame, chunk: list[str], member_hash: str, taxon: str, size: str) -> DataFrame:
    """Rows (chunk, chunk_hash, taxa, n_sequences, size); a chunk's hash is the digest of its members' hashes."""
    sums = members.groupBy(*chunk).agg(F.array_join(F.array_sort(F.collect_set(taxon)), ",").alias("taxa"), F.count("*").alias("n_sequences"), F.sum(size).alias("size"))
    return sums.join(digest_of(members, chunk, member_hash).withColumnRenamed("digest", "chunk_hash"), chunk).select(*chunk, "chunk_hash", "taxa", "n_sequences", "size")


def manifest_digest(index: DataFrame) -> DataFrame:
    """Row (n_chunks, digest): equal for manifests of equal chunk hashes, in any order; sums of 64 hash bits."""
    part = F.conv(F.substring("chunk_hash", 1, 15), 16, 10).cast("decimal(38,0)")
    return index.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def manifest_errors(index: DataFrame, hash_col: str, n: str, size: str) -> DataFrame:
    """Rows (hash, error): empty, negative or repeated chunks."""
    counted = index.groupBy(hash_col).agg(F.count("*").alias("_k"), F.min(n).alias("_n"), F.min(size).alias("_s"))
    error = F.when(F.col(hash_col).isNull(), "no hash").when(F.col("_k") > 1, "repeated").when(F.col("_n") <= 0, "empty").when(F.col("_s") < 0, "negative size")
    return counted.select(hash_col, error.alias("error")).where("error is not null")


def occurrences(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """Rows (key, first_version, last_version, n_versions) over all versions."""
    return rows.groupBy(key).agg(F.min(version).alias("first_version"), F.max(version).alias("last_version"), F.count_distinct(version).alias("n_versions"))


def resolve_alias(wanted: DataFrame, versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (reference, version): a version itself, else the alias of that name, else the newest for 'current'."""
    newest = versions.agg(F.max("version").alias("_newest"))
    direct = versions.select(F.col("version").alias("reference"), F.col("version").alias("_direct"))
    named = aliases.select(F.col("alias").alias("reference"), F.col("version").alias("_named"))
    joined = wanted.join(direct, "reference", "left").join(named, "reference", "left").crossJoin(newest)  # one row
    return joined.select("reference", F.coalesce("_direct", "_named", F.when(F.col("reference") == "current", F.col("_newest"))).alias("version"))


def detect_version(text: Column) -> Column:
    """The first release of a text: Release 2024_01, release 220, 2024-01-02 or 20240102; else null."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)release[ :]+(\d{4}_\d{2})", r"(?i)release[ :]+(\d+)", r"(\d{4}-\d{2}-\d{2})", r"\b(\d{8})\b")]
    return F.coalesce(*found)


def breakdown(selection: DataFrame, role: str) -> DataFrame:
    """Rows (role, n, percent) of a reduction."""
    counts = selection.groupBy(role).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def weighted_score(edges: DataFrame, weights: DataFrame, node: str, score: str, default: float = 1.0) -> DataFrame:
    """Rows (node, total): the sum of score times the node's weight."""
    joined = edges.join(weights.select(node, "weight"), node, "left")
    return joined.groupBy(node).agg(F.round(F.sum(F.col(score) * F.coalesce("weight", F.lit(default))), 6).alias("total"))


def enrich(rows: DataFrame, mapping: DataFrame, key: str, taxon: str) -> DataFrame:
    """``rows`` with mapped_taxon by key, and the source that the taxon came from; all rows stay."""
    joined = rows.join(mapping.select(key, F.col(taxon).alias("mapped_taxon")), key, "left")
    return joined.withColumn("taxon_source", F.when(F.col("mapped_taxon").isNotNull(), "mapping").otherwise("none"))


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n keys and a false-positive rate."""
    import math

    bits = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def bloom_bits(n: Column, p: float) -> Column:
    return F.greatest(F.ceil(-n * F.log(F.lit(p)) / F.log(F.lit(2.0)) ** 2), F.lit(1)).cast("long")


def bloom_hashes(n: Column, bits: Column) -> Column:
    return F.greatest(F.round(bits / n * F.log(F.lit(2.0))), F.lit(1)).cast("long")


def bloom_count(bits: Column, hashes: Column, ones: Column) -> Column:
    """About how many keys set ``ones`` of the bits; a full filter counts as one bit short of it."""
    return -bits * F.log(1 - F.least(ones, bits - 1) / bits) / hashes


def with_prefix(pairs: DataFrame, key: str, prefix: str) -> DataFrame:
    """Pairs whose key begins so; Parquet statistics prune what can't."""
    return pairs.where(F.col(key).startswith(prefix))


def lookup(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows by equality with any of some values of an index column; pushed down to the scan."""
    return rows.where(F.col(column).isin(*values))


def chain_depth(links: DataFrame, child: str, parent: str) -> DataFrame:
    """Rows (node, depth): deltas between a chunk and the full chunk that it goes back to."""
    from lociq.operators.taxonomy import closure

    return closure(links, child, parent).groupBy("node").agg(F.max("hops").cast("long").alias("depth"))


def plateau(steps: DataFrame, step: str, coverage: str, back: int = 9, gain: float = 0.001, least_steps: int = 100, least: float = 0.1) -> DataFrame:
    """Row (stop): the first step at which coverage has gained less than ``gain`` over the last ``back``.

    ``steps`` has a row for each chosen reference of one run, so the window is short.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(step)
    gained = steps.withColumn("_g", F.col(coverage) - F.lag(coverage, back).over(order)).withColumn("_n", F.row_number().over(order))
    return gained.where((F.col("_g") < gain) & (F.col("_n") >= least_steps) & (F.col(coverage) >= least)).agg(F.min(step).alias("stop"))


def dag_hashes(tree: DataFrame, node: str, parent: str, label: Column) -> DataFrame:
    """Rows (node, hash): a leaf's hash is that of its label, an inner node's that of its label and the digest of its
    children's hashes; worked out from the deepest level up, one written table a level."""
    from lociq.operators.taxonomy import closure
    from lociq.storage import stash

    depth = closure(tree, node, parent).groupBy("node").agg(F.max("hops").alias("depth"))
    rows = stash(tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"), label.alias("label")).join(depth, "node"), "dag")
    deepest = rows.agg(F.max("depth")).first()[0]
    done = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        at = rows.where(F.col("depth") == level)
        if done is None:
            hashed = at.select("node", "parent", F.sha2("label", 256).alias("hash"))
        else:
            below = digest_of(done.where(F.col("level") == level + 1).select(F.col("parent").alias("node"), "hash"), ["node"], "hash").withColumnRenamed("digest", "below")
            hashed = at.join(below, "node", "left").select("node", "parent", F.sha2(F.concat("label", F.coalesce("below", F.lit(""))), 256).alias("hash"))
        part = stash(hashed.withColumn("level", F.lit(level)), "dag")
        done = part if done is None else done.unionByName(part)
    if done is None:
        return rows.select("node", F.lit("").alias("hash"))
    return done.select("node", "hash")
