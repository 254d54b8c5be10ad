"""The queries of the corpus operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from lociq.llm import bpe, embeddings, licenses, line_dedup, mixing, oracles, pii, quality, secrets, simhash, token_count
from lociq.llm.common import host_of, table

# ---- 1: mixing ----------------------------------------------------------------------------------------

LEVELS = ["domain", "lang", "source"]
MIX_SHARE = (3, 5)
MIX_EPOCHS = 3


def mix_domain() -> Column:
    """A source's domain by the parity of its number: web or reference; other without a number."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").when(number.cast("int") % 2 == 0, "web").otherwise("reference")


def mix_weights() -> dict:
    return {
        "domain": F.expr("CASE domain WHEN 'web' THEN 3 WHEN 'reference' THEN 2 ELSE 1 END"),
        "lang": F.expr("CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"),
        "source": F.expr("CASE source WHEN 'src0' THEN 2 ELSE 1 END"),
    }


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", mix_domain().alias("domain"), "lang", "source", mixing.word_count(F.col("text")).alias("tokens"))
    return mixing.mix(rows, "doc_id", LEVELS, mix_weights(), share=MIX_SHARE, max_epochs=MIX_EPOCHS)


# ---- 2: line dedup ------------------------------------------------------------------------------------

LINE_RATIO = 0.1
#: A line of one page alone is no boilerplate; by the ratio alone a host of under ten pages would lose every line.
LINE_PAGES = 2


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kept = line_dedup.drop_boilerplate(pages, host_of(F.col("url")), line_dedup.page_text(F.col("html")), LINE_RATIO, LINE_PAGES)
    return kept.select("row.page_id", "host", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# ---- 3 to 10 ------------------------------------------------------------------------------------------


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.MarkovModel.fit(secrets.labelled_samples(spark))
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), model)
    base = F.concat("assign", "access", "hex")
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.concat(base, F.col("markov"))).alias("spans"), F.size("markov").cast("long").alias("n_markov"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_each=3, distance=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = bpe.read_ranks(lines)
    return bpe.token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return token_count.count_tokens(table(spark, sf_dir, "documents"), model)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_vectors": op4_near_vectors,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_personal_data": op7_personal_data,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_licenses": op10_licenses,
}

#: DuckDB SQL for those that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_mixing": oracles.mixing_sql(MIX_SHARE, MIX_EPOCHS),
    "op2_line_dedup": oracles.line_dedup_sql(LINE_RATIO, LINE_PAGES),
    "op3_quality_rules": oracles.quality_sql(),
}
