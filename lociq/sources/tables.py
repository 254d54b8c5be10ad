"""Taxonomy dumps, accession mappings, alignment tables and delta files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The twelve columns of tabular alignments.
M8 = "query string, subject string, identity double, length bigint, mismatches bigint, gaps bigint, q_start bigint, q_end bigint, s_start bigint, s_end bigint, evalue double, bitscore double"


def _dump(spark: SparkSession, path: str) -> DataFrame:
    parts = F.transform(F.split(F.regexp_replace("value", r"\t?\|$", ""), r"\|"), lambda x: F.trim(F.regexp_replace(x, r"^\t|\t$", "")))
    return spark.read.text(path).select(parts.alias("p"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Rows (taxon_id, name) of names.dmp: the scientific names."""
    return _dump(spark, path).where(F.get("p", F.lit(3)) == "scientific name").select(F.get("p", F.lit(0)).cast("long").alias("taxon_id"), F.get("p", F.lit(1)).alias("name"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (taxon_id, parent_id, rank) of nodes.dmp; a root that is its own parent has none."""
    node, parent = F.get("p", F.lit(0)).cast("long"), F.get("p", F.lit(1)).cast("long")
    return _dump(spark, path).select(node.alias("taxon_id"), F.nullif(parent, node).alias("parent_id"), F.get("p", F.lit(2)).alias("rank"))


def read_taxonomy(spark: SparkSession, names: str, nodes: str) -> DataFrame:
    """Rows (taxon_id, parent_id, rank, name) of taxa that are in both files."""
    return read_nodes(spark, nodes).join(read_names(spark, names), "taxon_id")


def read_idmapping(spark: SparkSession, path: str) -> DataFrame:
    """Rows (accession, taxon_id) of a three-column mapping: the lines of kind NCBI_TaxID."""
    rows = spark.read.csv(path, sep="\t", schema="accession string, kind string, value string")
    return rows.where("kind = 'NCBI_TaxID'").select("accession", F.col("value").cast("long").alias("taxon_id"))


def read_accession2taxid(spark: SparkSession, path: str) -> DataFrame:
    """Rows (accession, taxon_id): each accession with and without its version, distinct."""
    rows = spark.read.csv(path, sep="\t", header=True)
    names = [c.lower() for c in rows.columns]
    taxon = next((k for k, c in enumerate(names) if "taxid" in c), 2)
    rows = rows.toDF(*(f"c{k}" for k in range(len(names))))
    both = F.array_distinct(F.array("c0", "c1", F.regexp_replace("c1", r"\.[^.]*$", "")))
    return rows.select(F.explode(both).alias("accession"), F.col(f"c{taxon}").cast("long").alias("taxon_id")).where("accession is not null").distinct()


def with_fallback(first: DataFrame, second: DataFrame, key: str = "accession") -> DataFrame:
    """All rows of the first mapping, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def write_accession2taxid(rows: DataFrame, path: str) -> None:
    """Rows (accession, version, taxon_id) as a mapping file with a header; a null taxon is 0."""
    named = rows.select(F.col("accession"), F.concat_ws(".", "accession", F.col("version").cast("string")).alias("accession.version"), F.coalesce("taxon_id", F.lit(0)).alias("taxid"), F.lit(0).alias("gi"))
    named.write.csv(path, sep="\t", header=True)


def read_taxids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (taxon_id) of files of numbers divided by commas or lines; what follows # is a comment."""
    plain = F.regexp_replace("value", "#.*$", "")
    words = F.filter(F.split(plain, r"[,\s]+"), lambda x: x != "")
    return spark.read.text(path).select(F.explode(F.transform(words, lambda x: x.cast("long"))).alias("taxon_id"))


def read_m8_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns only: rows (query, subject)."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 2))
    return lines.select(F.get(parts, F.lit(0)).alias("query"), F.get(parts, F.lit(1)).alias("subject"))


def read_m8(spark: SparkSession, path: str) -> DataFrame:
    """Twelve typed columns, identity from 0 to 1; comments, blank and short lines go, bad numbers are 0."""
    names = [c.split(" ") for c in M8.split(", ")]
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts.alias("p")).where(F.size("p") >= len(names))
    typed = [F.get("p", F.lit(k)).alias(n) if kind == "string" else F.coalesce(F.get("p", F.lit(k)).try_cast(kind), F.lit(0).cast(kind)).alias(n) for k, (n, kind) in enumerate(names)]
    return lines.select(*typed).withColumn("identity", F.col("identity") / 100)


def read_ref2children(spark: SparkSession, path: str) -> DataFrame:
    """Rows (reference, child) of lines of a reference and its children."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(F.get(parts, F.lit(0)).alias("reference"), F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("child"))


_ESCAPES = ((r"\\", r"\\\\"), ("\t", r"\\t"), ("\n", r"\\n"), ("\r", r"\\r"), (",", r"\\x2C"), (">", r"\\x3E"))


def escaped(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.regexp_replace(text, plain, written)
    return text


def unescaped(text: Column) -> Column:
    """The reverse of escaped: escapes are read from left to right, by cutting at each."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\\\\|\\[tnr]|\\x[0-9A-F]{2}|[^\\]+)"), F.lit(1))
    plain = lambda p: F.when(p == "\\\\", "\\").when(p == "\\t", "\t").when(p == "\\n", "\n").when(p == "\\r", "\r").when(p.startswith("\\x"), F.char(F.conv(F.substring(p, 3, 2), 16, 10).cast("int"))).otherwise(p)
    return F.array_join(F.transform(pieces, plain), "")


def write_deltas(rows: DataFrame, path: str) -> None:
    """Lines of child, reference, taxon:N and one field kind:start>end,text for each operation."""
    ops = F.transform("ops", lambda o: F.concat(o["kind"], F.lit(":"), o["start"].cast("string"), F.lit(">"), o["end"].cast("string"), F.lit(","), escaped(o["text"])))
    taxon = F.concat(F.lit("taxon:"), F.coalesce(F.col("taxon_id").cast("string"), F.lit("")))
    rows.select(F.concat_ws("\t", "child_id", "reference_id", taxon, F.array_join(ops, "\t"))).write.text(path)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Rows (child_id, reference_id, taxon_id, ops) of such lines."""
    parts = F.split("value", "\t")
    field = F.filter(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), lambda x: x != "")
    piece = lambda x, k: F.regexp_extract(x, r"^([a-z]+):(\d+)>(\d+),(.*)$", k)
    ops = F.transform(field, lambda x: F.struct(piece(x, 1).alias("kind"), piece(x, 2).cast("long").alias("start"), piece(x, 3).cast("long").alias("end"), unescaped(piece(x, 4)).alias("text")))
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("child_id"), F.get(parts, F.lit(1)).alias("reference_id"), F.regexp_extract(F.get(parts, F.lit(2)), r"^taxon:(\d+)$", 1).try_cast("long").alias("taxon_id"), ops.alias("ops"))
