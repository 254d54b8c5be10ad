import json

import pytest
from pyspark.sql import functions as F

from lociq.operators import catalog, clades, profiles
from lociq.operators.reports import Report


def test_dag_changes_with_a_leaf(spark):
    rows = [("a", None), ("b", "a"), ("c", "a"), ("d", "b")]
    tree = spark.createDataFrame(rows, "node string, parent string")
    first = {r.node: r.hash for r in catalog.dag_hashes(tree, "node", "parent", F.col("node")).collect()}
    other = {r.node: r.hash for r in catalog.dag_hashes(tree, "node", "parent", F.when(F.col("node") == "d", "x").otherwise(F.col("node"))).collect()}
    assert {n for n in first if first[n] != other[n]} == {"a", "b", "d"}
    assert catalog.dag_hashes(tree.limit(0), "node", "parent", F.col("node")).count() == 0


def test_plateau(spark):
    steps = spark.createDataFrame([(k, min(0.5, 0.01 * k)) for k in range(1, 200)], "step int, coverage double")
    assert catalog.plateau(steps, "step", "coverage").first().stop == 100
    assert catalog.plateau(steps, "step", "coverage", least_steps=20).first().stop == 59


def test_bloom_size():
    assert catalog.bloom_size(1000, 0.01) == (9586, 7)


def test_versions(spark):
    rows = spark.createDataFrame([("Release: 2024_03 x",), ("release 220",), ("made 2023-05-06",), ("on 20230506",), ("none",)], "t string")
    assert [r[0] for r in rows.select(catalog.detect_version(F.col("t"))).collect()] == ["2024_03", "220", "2023-05-06", "20230506", None]


def test_clusters_keep_all(spark):
    counts = spark.createDataFrame([(k, k % 3, 5 * k) for k in range(1, 30)], "node int, parent int, n int")
    got = {r.node: r.cluster for r in clades.clusters(counts, "node", "parent", 50).collect()}
    assert set(got) == set(range(1, 30))
    assert all(("own" in got[k]) == (5 * k > 50) for k in got)


def test_seed_cover(spark):
    rows = spark.createDataFrame([("g", 1, "abcdefghijklmnopqrstuvwxyz"), ("g", 2, "abcdefghijklmnopqrstuvwxyz"), ("g", 3, "zyxwvutsrqponmlkjihgfedcba"), ("h", 4, "short")], "g string, id long, t string")
    got = {(r.g, r.id, r.n_new) for r in profiles.seed_cover(rows, "g", "id", "t").collect()}
    assert got == {("g", 1, 15), ("g", 3, 15), ("h", 4, 0)}


def test_profiles(spark, tmp_path):
    rows = spark.createDataFrame([(1, "reference")], "id int, role string")
    for _ in range(2):
        profiles.save_profile(rows, str(tmp_path), "u", "v1", "auto")
    assert [tuple(r) for r in profiles.load_profile(spark, str(tmp_path), "u", "v1", "auto").collect()] == [(1, "reference")]


def test_small_functions(spark):
    df = spark.createDataFrame([("genus", 2, 4, 1500, 1 << 20), ("odd", None, None, 0, 0)], "r string, s int, d int, n long, t long")
    got = df.select(profiles.rank_bytes(F.col("r")), F.round(profiles.taxonomy_weight(F.col("s"), F.col("d")), 6), profiles.suggested_clusters(F.col("n")), profiles.memory_estimate(F.col("n"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1 << 20, 1.15, 1, 25), (1 << 20, 1.0, 1, 0)]


def test_report(spark):
    rows = spark.createDataFrame([("a<b", 1), (None, 2)], "k string, n int")
    report = Report("Title").add("Part", rows)
    assert json.loads(report.render("json"))["sections"]["Part"][0] == {"k": "a<b", "n": 1}
    assert "a&lt;b" in report.render("html")
    assert report.render("csv").splitlines() == ["section,k,n", "Part,a<b,1", "Part,,2"]
    assert report.render().splitlines()[0] == "Title"
    with pytest.raises(ValueError):
        report.add("long", spark.range(10_001))
