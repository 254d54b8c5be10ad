"""Queries whose registered SQL has a bound that the query no longer has, against SQL without it or brute force."""

import hashlib
import random

import duckdb

from lociq.operators.align import decode_delta, encode_delta
from lociq.plans import QUERIES

SF = "/root/testdata/sf0.01"


def duck(sql: str, *names: str) -> list[tuple]:
    con = duckdb.connect()
    for name in names:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return sorted(con.sql(sql).fetchall())


def test_remap_takes_every_order(spark):
    want = duck("SELECT l_orderkey, string_agg(DISTINCT t::VARCHAR, ',' ORDER BY t::VARCHAR) AS taxa FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 10 = 0 THEN l_suppkey + 1000 ELSE l_suppkey END AS t FROM lineitem) GROUP BY 1", "lineitem")
    got = sorted(map(tuple, QUERIES["taxonomy_remap"](spark, SF).collect()))
    assert got == want and got[-1][0] > 2000


def test_every_child_makes_the_round_trip(spark):
    children = QUERIES["simple_select"](spark, SF).where("role = 'child'")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = sorted((r.doc_id, r.reference_id, hashlib.sha256(texts[r.doc_id].encode()).hexdigest()) for r in children.collect())
    assert sorted(map(tuple, QUERIES["delta_roundtrip"](spark, SF).select("doc_id", "reference_id", "decoded_sha256").collect())) == want
    lengths = [len(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").join(children, "doc_id").select("text").collect()]
    assert len(want) == len(lengths) and max(lengths) > 400


def test_delta_of_long_texts():
    rng = random.Random(6)
    reference = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    child = reference[30_000:50_000] + "éß𝄞" + reference[:29_000] + reference[29_001:]
    ops = encode_delta(reference, child)
    assert decode_delta(reference, ops) == child and len(ops) == 4
    for a, b in [("a" * 50_000, "a" * 40_000 + "b" + "a" * 20_000), ("", "x" * 99), ("x" * 99, ""), (reference, reference)]:
        assert decode_delta(a, encode_delta(a, b)) == b


def test_every_document_is_transformed(spark):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    complement = str.maketrans("ATGCatgc", "TACGTACG")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (digest(r.text.translate(complement)[::-1]), digest("".join(c.upper() if "a" <= c <= "z" else c for c in r.text))) for r in rows}
    got = {r.doc_id: (r.rc_hash, r.upper_hash) for r in QUERIES["transform_reverse_complement"](spark, SF).collect()}
    assert got == want and any(not r.text.isascii() for r in rows)


def test_selection_over_documents(spark):
    """Greedy choice over every distinct text, against brute force."""
    small = "/root/testdata/sf0.001"
    first: dict = {}
    for r in sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()):
        first.setdefault(r.text, r.doc_id)
    rows = sorted(((len(t), i, {t[k : k + 3] for k in range(len(t) - 2)}) for t, i in first.items()), key=lambda r: (-r[0], r[1]))
    near = lambda x, y: x[2] and y[2] and min(x[0], y[0]) >= 0.8 * max(x[0], y[0]) and len(x[2] & y[2]) >= 0.7 * len(x[2] | y[2])
    want: dict = {}
    for k, row in enumerate(rows):
        if row[1] not in want:
            want[row[1]] = None
            want |= {other[1]: row[1] for other in rows[k + 1 :] if other[1] not in want and near(row, other)}
    assert {r.id: r.reference_id for r in QUERIES["greedy_redundancy"](spark, small).collect()} == want
    for name in ("set_cover", "centrality"):
        assert sorted(r.id for r in QUERIES[name](spark, small).collect()) == sorted(want)
