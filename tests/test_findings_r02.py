"""Cases of the second round's findings, each against a plainer way."""

import heapq
import random
import time

import pandas as pd
import pytest

from lociq import storage
from lociq.operators import align, select, similarity
from lociq.plans import QUERIES


def test_compaction_is_one_file_of_any_size(spark):
    """tables over the size of a file, and sums of doubles that depend on their order."""
    small, large = storage.scratch(spark, "small"), storage.scratch(spark, "large")
    rows = spark.range(5000).selectExpr("id", "sha2(cast(id as string), 256) as t")
    rows.repartition(7).write.parquet(small)
    assert storage.compact(spark, small, large, file_bytes=50_000, one_file=True) == 1
    assert storage.files(spark, large, "*.parquet").count() == 1
    back = spark.read.parquet(large)
    assert back.dtypes == rows.dtypes and sorted(back.collect()) == sorted(rows.collect())

    folder = storage.scratch(spark, "sf")
    spark.createDataFrame([(k, p) for k, p in enumerate([1e16] + [1.0] * 1000 + [-1e16])], "o_orderkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    assert tuple(QUERIES["compaction"](spark, folder).first()) == (1, 1002, 1000.0)
    empty, into = storage.scratch(spark, "empty"), storage.scratch(spark, "into")
    rows.limit(0).write.parquet(empty)
    storage.compact(spark, empty, into, one_file=True)
    assert spark.read.parquet(into).count() == 0


def test_many_paths_are_those_of_one_by_one():
    """pairs aligned together, among them ties, gaps, empty and long texts, by each scoring."""
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for letters in ("AC", "ACGT", "ACDEFGHIKLMNPQRSTVWY#b"):
        pairs = [(word(letters, rng.randrange(0, 30)), word(letters, rng.randrange(0, 30))) for _ in range(400)]
        for a, _ in list(pairs):
            k, j = sorted((rng.randrange(len(a) + 1), rng.randrange(len(a) + 1)))
            pairs += [(a, a[:k] + a[j:]), (a[:k] + a[j:], a), (a, a[:k] + "#" + a[k + 1 :])]
        for free_end in (False, True):
            assert align.best_paths(pairs, free_end=free_end) == [align.best_path(a, b, free_end=free_end) for a, b in pairs]
    own = align.Scoring(1, -1, -2, -1)
    assert align.best_paths([("AAAA", "AATAA"), ("A", "")], own) == [align.best_path("AAAA", "AATAA", own), align.best_path("A", "", own)]
    long = word("ACGT", 1600)
    assert align.best_paths([(long, long[:700] + long[900:])])[0] == align.best_path(long, long[:700] + long[900:])


def test_equal_and_missing_pairs(spark):
    """a pair is aligned once in a batch, and a null text has no edits."""
    rows = [(k, "ACDEF", ("ACDEF", "ACEF", None, "")[k % 4]) for k in range(4000)]
    df = spark.createDataFrame(rows, "k long, a string, b string").coalesce(1)
    got = df.select("k", align.edits("a", "b").alias("e"), align.alignment_identity("a", "b").alias("s")).collect()
    assert all((r.e is None) == (r.s is None) == (r.k % 4 == 2) for r in got)
    assert {(r.k % 4, tuple(map(tuple, r.e or ()))) for r in got} == {(0, ()), (1, ((2, "D", "-"),)), (2, ()), (3, tuple((i, c, "-") for i, c in enumerate("ACDEF")))}
    assert {r.s for r in got if r.k % 4 == 0} == {1.0}


def test_many_pairs_take_seconds():
    """20,000 different pairs in seconds, where one by one took some 3 ms each."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(align.AMINO_ACIDS) for _ in range(30)) for _ in range(20_000)]
    began = time.perf_counter()
    paths = align.best_paths([(t, t[:4] + "#" + t[5:]) for t in texts])
    assert time.perf_counter() - began < 20 and all(set(p.steps) == {align.BOTH} for p in paths)


def test_block_pairs_against_brute_force(spark, monkeypatch):
    """blocks of one and of many texts, sets that share bits, and the plain join."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdéf𝄞 ") for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    texts += [t[:k] + t[k + 1 :] for t in texts for k in (3, 20)] + texts[:9]
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "id long, t string")
    for k, threshold, ratio in ((3, 0.7, 0.8), (2, 0.4, 0.0), (1, 1.0, 0.9)):
        sets = [{t[i : i + k] for i in range(len(t) - k + 1)} for t in texts]
        near = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and min(len(texts[a]), len(texts[b])) >= ratio * max(len(texts[a]), len(texts[b]))  # noqa: E731, B023
        want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if near(a, b)}
        assert {tuple(r) for r in similarity.jaccard_pairs(df, "id", "t", k, threshold, ratio).collect()} == {tuple(r) for r in similarity.block_pairs(df, "id", "t", k, threshold, ratio).collect()}
        monkeypatch.setattr(similarity, "LEAST_BLOCK", 100_000)
        monkeypatch.setattr(similarity, "MOST_BLOCK", 100_000)
        assert {(r.a, r.b) for r in similarity.block_pairs(df, "id", "t", k, threshold, ratio).collect()} == want
        monkeypatch.undo()
    frame = pd.DataFrame({"id": range(len(texts)), "len": [len(t) for t in texts], "block": 0, "codes": [similarity.kmer_codes(t, 3).tobytes() for t in texts]})
    want = similarity._close(frame, True, 0, 0.7, 0.8)
    monkeypatch.setattr(similarity, "MOST_BITS", 128)
    monkeypatch.setattr(similarity, "FIRST_BITS", 64)
    assert len(want) > 20 and similarity._close(frame, True, 0, 0.7, 0.8).equals(want)
    assert similarity.block_pairs(df.limit(0), "id", "t", 3, 0.7, 0.8).count() == 0


def test_choices_in_one_task_are_those_of_rounds(spark, monkeypatch):
    """the last open edges go one by one in a task; with none left to it, all goes in rounds."""
    rng = random.Random(5)
    for n, m in ((40, 60), (25, 200)):
        rows = spark.createDataFrame([(i, rng.randrange(5)) for i in range(n)], "id long, len int")
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        edges = spark.createDataFrame([(a, b, rng.randrange(1, 6) / 5) for a, b in pairs], "a long, b long, similarity double")
        for choose in (select.greedy, select.set_cover):
            once = sorted(map(tuple, choose(rows, edges, "id", "len").collect()))
            with monkeypatch.context() as patch:
                patch.setattr(select, "TASK_EDGES", 0)
                assert sorted(map(tuple, choose(rows, edges, "id", "len").collect()), key=lambda r: r[0]) == once


def plain_betweenness(nodes: list, near: dict) -> dict:
    """Brandes' sums from a heap, one node at a time."""
    score = dict.fromkeys(nodes, 0.0)
    for source in nodes:
        seen, dist, count, before, stack, heap = {source: 0.0}, {}, {source: 1.0}, {source: []}, [], [(0.0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            stack.append(v)
            for w, s in near.get(v, {}).items():
                way = d + max(1.0 - s, 1e-9)
                if w not in dist and (w not in seen or way < seen[w] - 1e-12):
                    seen[w], count[w], before[w] = way, count[v], [v]
                    heapq.heappush(heap, (way, w))
                elif w not in dist and abs(way - seen[w]) <= 1e-12:
                    count[w] += count[v]
                    before[w].append(v)
        part = dict.fromkeys(stack, 0.0)
        for w in reversed(stack):
            for v in before[w]:
                part[v] += count[v] / count[w] * (1 + part[w])
            if w != source:
                score[w] += part[w] / 2
    return score


def test_centrality_against_brute_force(spark, monkeypatch):
    """a component's sources in one task and in many, with ties of ways, copies and rows that touch no other."""
    rng = random.Random(9)
    n = 60
    size = {i: rng.randrange(100) for i in range(n)}
    edges = {}
    while len(edges) < 130:
        a, b = sorted(rng.sample(range(n - 4), 2))
        if a % 3 and b % 3 or a % 3 == b % 3:
            edges[a, b] = rng.choice((0.5, 0.7, 0.75, 0.8, 1.0))
    near: dict = {}
    for (a, b), s in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = s
    between = plain_betweenness(list(range(n)), near)
    assert select.betweenness(list(range(n)), near) == pytest.approx(between) and max(between.values()) > 50
    want = {}
    left = set(range(n))
    while left:
        todo, part = [min(left)], set()
        while todo:
            if (i := todo.pop()) not in part:
                part.add(i)
                todo += near.get(i, {})
        left -= part
        m = len(part)
        score = {i: round(0.5 * len(near.get(i, {})) + 0.3 * between[i] * 100 / max(1, (m - 1) * (m - 2) / 2) + 0.2 * size[i] / 1000, 9) for i in part}
        refs = set(sorted(part, key=lambda i: (-score[i], i))[: max(1, m // 10)])
        for i in part:
            best = max(((s, -j) for j, s in near.get(i, {}).items() if j in refs), default=None)
            want[i] = (-best[1], best[0]) if best and i not in refs else (None, None)
    rows = spark.createDataFrame(list(size.items()), "id long, len int")
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, similarity double")
    for work in (1 << 29, 1000):
        monkeypatch.setattr(select, "TASK_WORK", work)
        got = {r.id: (r.reference_id, r.similarity) for r in select.centrality(rows, pairs, "id", "len").collect()}
        assert got == want and sum(r is not None for r, _ in got.values()) > 10
