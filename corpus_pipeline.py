"""From raw documents to token ids: five stages, each one operator of lociq.llm over all that came before.

Quality rules reject documents; boilerplate lines of a source go; one document of each group of near
copies stays; domains, languages and sources are mixed to their weights; what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import bpe, line_dedup, mixing, quality, simhash
from lociq.llm.common import stash, table
from lociq.llm.queries import LEVELS, LINE_PAGES, LINE_RATIO, mix_domain, mix_weights

#: Nine tenths of the tokens are dealt, and a source is read twice at most.
SHARE = (9, 10)
EPOCHS = 2
#: Words of a shingle, and the bits in which near copies differ at most.
SHINGLE_WORDS = 5
SIMHASH_BITS = 6


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest policy."""
    return quality.passing(docs)


def line_dedup_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in too many documents of their source."""
    return line_dedup.without_boilerplate(docs, F.col("source"), "text", LINE_RATIO, LINE_PAGES, "n_chars")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return simhash.keep_one(docs, SHINGLE_WORDS, SIMHASH_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each epoch that takes them."""
    rows = docs.select("doc_id", mix_domain().alias("domain"), "lang", "source", mixing.word_count(F.col("text")).alias("tokens"))
    return mixing.take(docs, mixing.mix(rows, "doc_id", LEVELS, mix_weights(), share=SHARE, max_epochs=EPOCHS), "doc_id")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and the digests of ids and decoded bytes, for each row."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = bpe.read_ranks(lines)
    return bpe.token_digests(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_by_source),
    ("simhash near-dedup", simhash_dedup),
    ("source mixing", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: SQL can express neither the fingerprints nor the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
