import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lociq.operators import chunks, dedup, lengths, merkle, sampling, select, similarity, taxonomy
from lociq.operators import diff as D
from lociq.operators import temporal as T


def test_simple_select_ties_and_nulls(spark):
    rows = [(1, 100), (2, 100), (3, 100), (4, 60), (5, 10), (6, None)]
    got = {r[0]: tuple(r[1:]) for r in lengths.simple_select(spark.createDataFrame(rows, "id long, n int"), "id", "n", 0.5).collect()}
    assert got == {1: ("reference", None), 2: ("reference", None), 3: ("child", 1), 4: ("child", 1), 5: ("discarded", None), 6: ("discarded", None)}
    assert lengths.simple_select(spark.createDataFrame([], "id long, n int"), "id", "n").count() == 0


def test_jaccard_pairs_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    texts += texts[:8]
    for threshold in (0.2, 0.5, 1.0):
        sets = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts]
        want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
        assert {(r.a, r.b) for r in similarity.jaccard_pairs(df, "id", "t", 2, threshold).collect()} == want


EDGES = [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7), (6, 7, 0.9)]


@pytest.fixture
def graph(spark):
    rows = spark.createDataFrame([(i, 10 * i) for i in range(1, 9)], "id long, len int")
    return rows, spark.createDataFrame(EDGES, "a long, b long, similarity double")


def test_components(graph):
    rows, edges = graph
    assert {tuple(r) for r in select.connected(edges, rows, "id").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 6), (8, 8)}


def test_greedy_set_cover_centrality(graph):
    rows, edges = graph
    got = {r.id: r.reference_id for r in select.greedy(rows, edges, "id", "len").collect()}
    assert got == {4: None, 3: 4, 2: None, 1: 2, 7: None, 6: 7, 5: None, 8: None}
    got = {r.id: r.reference_id for r in select.set_cover(rows, edges, "id", "len").collect()}
    assert got == {2: None, 1: 2, 3: 2, 4: None, 6: None, 7: 6, 5: None, 8: None}
    got = {r.id: r.reference_id for r in select.centrality(rows, edges, "id", "len").collect()}
    assert set(got) == set(range(1, 9)) and sum(v is None for v in got.values()) >= 4


def test_betweenness_of_a_path():
    near = {1: {2: 0.5}, 2: {1: 0.5, 3: 0.5}, 3: {2: 0.5, 4: 0.5}, 4: {3: 0.5}}
    assert select.betweenness([1, 2, 3, 4], near) == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
@pytest.mark.parametrize("duplicate", [False, True])
def test_merkle(spark, n, duplicate):
    leaves = sorted(hashlib.sha256(str(k).encode()).hexdigest() for k in range(n))
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        last = [level[-1]] if len(level) % 2 else []
        pairs = [hashlib.sha256(level[k] + level[k + 1]).digest() for k in range(0, len(level) - 1, 2)]
        level = pairs + ([hashlib.sha256(last[0] * 2).digest()] if last and duplicate else last)
    df = spark.createDataFrame([(x,) for x in leaves], "h string")
    row = merkle.root(df, "h", duplicate).first()
    assert (row.n_leaves, row.root) == (n, level[0].hex())
    if not duplicate:
        tree = merkle.levels(df, "h")
        for pos in (0, n - 1):
            path = merkle.proof(tree, pos)
            assert merkle.verify(leaves[pos], path, row.root)
            assert not merkle.verify("00" * 32, path, row.root)


def test_chunk_packing(spark):
    rows = [(i, "a" if i % 3 else "b") for i in random.Random(1).sample(range(10_000), 500)]
    got = chunks.pack(spark.createDataFrame(rows, "id long, g string"), F.col("g"), "id", 7).collect()
    for g in "ab":
        ids = sorted(i for i, x in rows if x == g)
        assert {r.id: r.chunk_no for r in got if r.g == g} == {i: k // 7 for k, i in enumerate(ids)}


def test_samples(spark):
    df = spark.range(1000)
    a, b = (sampling.exact_sample(df, "id", 0.25, seed=5).collect() for _ in range(2))
    assert len(a) == 250 and sorted(a) == sorted(b)
    assert sorted(r.id for r in sampling.evenly_spaced(df, "id", 10).collect()) == list(range(0, 1000, 100))


def test_closure_cycle_and_dangling(spark):
    tree = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (9606, 9605)], "node long, parent long")
    got = {(r.node, r.ancestor, r.hops) for r in taxonomy.closure(tree, "node", "parent").collect()}
    assert {(3, 1, 2), (9606, 9605, 1), (1, 1, 0), (9605, 9605, 0)} <= got and len(got) == 9


def test_asof_edges(spark):
    q = spark.sql("select * from values (1, timestamp_ntz'2024-01-01'), (2, timestamp_ntz'2024-03-01'), (3, null), (4, timestamp_ntz'2023-01-01') as t(id, t)")
    v = spark.sql("select * from values (timestamp_ntz'2024-01-01', 5), (timestamp_ntz'2024-01-01', 6), (timestamp_ntz'2024-02-02', 7) as t(t, v)")
    assert {r.id: r.asof_value for r in T.asof(q, v, "t", "t", "v").collect()} == {1: 6, 2: 7, 3: None, 4: None}


def test_log_round_trip(spark):
    old = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, v int")
    new = spark.createDataFrame([(2, 5), (3, None), (4, 4)], "k int, v int")
    log = D.change_log(old, new, "k", "v")
    assert {(r.k, r.op) for r in log.collect()} == {(1, "delete"), (2, "update"), (4, "insert")}
    assert sorted(map(tuple, D.apply_log(old, log, "k", "v").collect()), key=lambda r: r[0]) == [(2, 5), (3, None), (4, 4)]


def test_upsert(spark):
    first = dedup.canonical(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, t string"), "t", "id")
    second = dedup.canonical(spark.createDataFrame([(9, "a"), (8, "b")], "id long, t string"), "t", "id")
    assert {(r.first_id, r.n_copies) for r in dedup.upsert(first, second).collect()} == {(1, 3), (8, 1)}


def test_greedy_by_group(spark, graph):
    rows, edges = graph
    grouped = rows.withColumn("g", F.when(F.col("id") <= 2, "x").when(F.col("id") <= 4, "y"))
    got = {r.id: r.reference_id for r in select.greedy_by_group(grouped, edges, "id", "len", "g").collect()}
    assert got == {1: 2, 2: None, 3: 4, 4: None, 5: None, 6: None, 7: None, 8: None}


def test_temporal_proof(spark):
    leaves = sorted(hashlib.sha256(str(k).encode()).hexdigest() for k in range(5))
    tree = merkle.levels(spark.createDataFrame([(x,) for x in leaves], "h string"), "h")
    root = tree[-1].first()["hash"]
    paths = (merkle.proof(tree, 1), merkle.proof(tree, 4))
    sealed = merkle.seal(root, root, "2024-01-01")
    assert merkle.verify_temporal((leaves[1], leaves[4]), paths, (root, root), "2024-01-01", sealed)
    assert not merkle.verify_temporal((leaves[1], leaves[4]), paths, (root, root), "2024-01-02", sealed)


@pytest.mark.parametrize("target", [None, "lambda"])
def test_reduce(spark, target):
    from lociq.operators.align import apply_delta
    from lociq.plans.reduce import reduce

    rng = random.Random(8)
    base = ["".join(rng.choice("acgt") for _ in range(150)) for _ in range(4)]
    texts = [b[:70] + rng.choice("acgt") + b[71:] for b in base for _ in range(3)] + base + ["short", None, "a" * 80]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    out = reduce(rows, "id", "t", target=target, k=5, entropy=0.1, longest=149 if target else 10_000)
    roles = {r.id: (r.role, r.reference_id) for r in out.selection.collect()}
    assert set(roles) == set(range(len(texts)))
    assert [roles[k][0] for k in range(16, 19)] == ["discarded"] * 3
    coded = out.deltas.join(rows.select(F.col("id").alias("reference_id"), F.col("t").alias("r")), "reference_id").join(rows, "id")
    assert all(row[0] == row[1] for row in coded.select(apply_delta(F.col("r"), F.col("ops")), "t").collect())
    children = sum(role == "child" for role, _ in roles.values())
    assert out.deltas.count() + out.long_children.count() == children > 0


def test_greedy_and_cover_in_rounds(spark):
    """On random graphs and a path, as one by one: rounds over tables give the same references and children."""
    import random

    from lociq.operators import select

    for seed in range(3):
        rng = random.Random(seed)
        n = 40 if seed else 10
        pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(70)) if a < b} if seed else {(k, k + 1) for k in range(n - 1)}
        edges = [(a, b, rng.choice([0.5, 0.7, 0.9])) for a, b in sorted(pairs)]
        length = [rng.randrange(5, 12) if seed else n - k for k in range(n)]
        rows = spark.createDataFrame([(k, length[k]) for k in range(n)], "id long, len int")
        frame = spark.createDataFrame(edges, "a long, b long, similarity double")
        near = {k: {} for k in range(n)}
        for a, b, s in edges:
            near[a][b] = near[b][a] = s
        want = {}
        for i in sorted(range(n), key=lambda k: (-length[k], k)):
            if i not in want:
                want[i] = None
                want.update({j: i for j in near[i] if j not in want})
        assert {r.id: r.reference_id for r in select.greedy(rows, frame, "id", "len").collect()} == want
        want, open_ = {}, set(range(n))
        while open_:
            best = max(open_, key=lambda i: (round(sum(s for j, s in near[i].items() if j in open_), 9), -i))
            taken = {j for j in near[best] if j in open_}
            want |= {best: None, **dict.fromkeys(taken, best)}
            open_ -= taken | {best}
        assert {r.id: r.reference_id for r in select.set_cover(rows, frame, "id", "len").collect()} == want


def test_numbered_is_the_global_order(spark):
    from lociq.operators import sampling

    rows = spark.createDataFrame([(k, (k * 37) % 50, k % 3 if k % 5 else None) for k in range(500)], "id long, v int, g int")
    got = {r.id: r.position for r in sampling.numbered(rows, ["v", "id"]).collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(((k, (k * 37) % 50) for k in range(500)), key=lambda r: (r[1], r[0])))}
    inside = sampling.numbered_within(rows, "g", ["id"]).collect()
    for g in (None, 0, 1, 2):
        mine = sorted((r.position, r.id) for r in inside if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)
    total = {r.position: r.upto for r in sampling.running_sum(sampling.numbered(rows, ["id"]), "position", "v", block=7).collect()}
    assert all(total[k] == sum((j * 37) % 50 for j in range(k + 1)) for k in range(500))


def test_closure_of_deep_trees_and_cycles(spark):
    import pytest

    from lociq.operators import taxonomy

    deep = spark.createDataFrame([(k, k - 1 if k else None) for k in range(150)], "node int, parent int")
    assert taxonomy.closure(deep, "node", "parent").where("node = 149").count() == 150
    with pytest.raises(ValueError):
        taxonomy.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node int, parent int"), "node", "parent")


def test_asof_in_small_buckets(spark, monkeypatch):
    import random
    from datetime import datetime, timedelta

    from lociq.operators import temporal

    rng = random.Random(2)
    day = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 20))
    queries, versions = [(k, day()) for k in range(300)] + [(300, None)], [(day(), k) for k in range(80)]
    q, v = spark.createDataFrame(queries, "id int, t timestamp"), spark.createDataFrame(versions, "vt timestamp, v int")
    want = {i: max(((vt, n) for vt, n in versions if t and vt <= t), default=(None, None))[1] for i, t in queries}
    for rows in (7, 10**6):
        monkeypatch.setattr(temporal, "BUCKET_ROWS", rows)
        assert {r.id: r.asof_value for r in temporal.asof(q, v, "t", "vt", "v").collect()} == want
