"""The stages one by one against brute force, and the SQL of the queries that have some."""

import hashlib
import os
import struct

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lociq.llm import bpe, mixing, quality, simhash
from lociq.llm.queries import LEVELS, LINE_PAGES, LINE_RATIO, ORACLES, QUERIES, mix_domain, mix_weights

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    ours, theirs = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in ours.collect()) == sorted(str([r[k] for k in at]) for r in theirs.fetchall())


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_pipeline_stage_by_stage(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "simhash near-dedup", "source mixing", "byte-level BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema

    def step(name, df):
        out = stages[name](spark, df, SF)
        return out if name == "byte-level BPE" else spark.createDataFrame(rows(out), schema)

    good = step("quality rules", docs)
    bits = {r.doc_id: r.fail_bits for r in quality.ledger(docs).collect()}
    assert sorted(rows(good)) == sorted(r for r in rows(docs) if bits[r[0]] == 0)

    lines = step("line dedup", good)
    pages, counts = {}, {}
    for _, text, _, source, _ in rows(good):
        pages[source] = pages.get(source, 0) + 1
        for key in {x.strip(" \t\x0b\x0c\r") for x in text.split("\n")} - {""}:
            counts[source, key] = counts.get((source, key), 0) + 1
    want = []
    for i, text, lang, source, _ in rows(good):
        n = lambda x: counts.get((source, x.strip(" \t\x0b\x0c\r")), 0)  # noqa: E731, B023
        text = "\n".join(x for x in text.split("\n") if not (n(x) >= LINE_PAGES and n(x) > LINE_RATIO * pages[source]))
        want.append((i, text, lang, source, len(text)))
    assert sorted(rows(lines)) == sorted(want)

    one = step("simhash near-dedup", lines)
    fp = {r[0]: simhash.fingerprint(r[1], 5) for r in rows(lines)}
    label = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if bin((fp[a] ^ fp[b]) & (1 << 64) - 1).count("1") <= corpus_pipeline.SIMHASH_BITS:
                    label[a] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in label):
            break
    assert sorted(rows(one)) == sorted(r for r in rows(lines) if label[r[0]] == r[0])

    mixed = step("source mixing", one)
    chosen = mixing.mix(one.select("doc_id", mix_domain().alias("domain"), "lang", "source", mixing.word_count(F.col("text")).alias("tokens")), "doc_id", LEVELS, mix_weights(), share=corpus_pipeline.SHARE, max_epochs=corpus_pipeline.EPOCHS).collect()
    text = {r[0]: r for r in rows(one)}
    assert sorted(rows(mixed)) == sorted(text[r.doc_id] for r in chosen)

    last = step("byte-level BPE", mixed).collect()
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f), special_tokens={})
    want = []
    for i, text, *_ in rows(mixed):
        ids = library.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == sorted(want)
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in last)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_stages_with_odd_rows(spark):
    clashing = "tokens epoch _hit _drop _host _text _n_lines _n_dropped _id _epoch _m_n_words row host drop hit key fp rep bits choice component_id weight cap budget domain".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing)
    clean = " ".join(f"word{chr(97 + k // 20)}{chr(97 + k % 20)}" for k in range(70))
    odd = [(1, clean, None, None, None, "x", 1), (1, clean, None, None, None, "x", 1), (None, clean + " more", "en", "src1", 1, None, None), (2, None, None, None, None, None, None), (3, "", "de", "", 0, "", 0), (4, " ".join(f"long{chr(97 + k // 400 % 20)}{chr(97 + k // 20 % 20)}{chr(97 + k % 20)}" for k in range(8000)), "fr", "src99999999999", 5, "y", 2)]
    for data in (odd, []):
        own = [(i, text, lang, source, n, *(f"{c} stays" for c in clashing)) for i, text, lang, source, n, *_ in data]
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "byte-level BPE":
                assert all(r[c] == f"{c} stays" for r in out.collect() for c in clashing), name
            if name != "byte-level BPE":
                assert out.columns == docs.columns, name
            assert (out.count() > 0) is bool(data), name


def test_entry_has_all_queries():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
