import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lociq.llm import embeddings, line_dedup, simhash
from lociq.llm.components import components, thin


def slow_components(edges):
    label = {x: x for e in edges for x in e}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(500, k) for k in range(501, 540)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + chain + star
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long")
    want = slow_components([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_thinned_edges_connect_the_same(spark, monkeypatch):
    """All links of a group of 60 become a few a node in each task, and components stay, also where a task begins anew."""
    group = [(a, b) for a in range(60) for b in range(a)]
    rng = random.Random(3)
    edges = group + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    kept = [tuple(r) for r in thin(df).collect()]
    assert len(kept) <= 4 * (60 + 100) and set(kept) <= set(edges)
    assert slow_components([e for e in kept if e[0] != e[1]]) == slow_components([e for e in edges if e[0] != e[1]])
    names = df.select(F.col("a").cast("string").cast("binary").alias("a"), F.col("b").cast("string").cast("binary").alias("b"))
    assert len({bytes(r.component) for r in components(names).collect()}) == len(set(slow_components([e for e in edges if e[0] != e[1]]).values()))


def slow_fingerprint(text, size):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("distance", "n"), [(2, 10), (2, 10**12), (6, 300_000), (6, 10**8)])
def test_close_pairs_share_a_key(spark, distance, n):
    """Any ``distance`` flipped bits leave some choice of spare blocks alone; keys grow with n."""
    spare = simhash.spare_blocks(distance, n)
    assert 64 * spare / (distance + spare) >= np.log2(n / simhash.KEY_ROWS) or spare == 8
    rng = random.Random(7)
    rows = []
    for _ in range(60):
        fp = rng.getrandbits(64)
        other = fp ^ sum(1 << k for k in rng.sample(range(64), distance))
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (fp, other)))
    keys = lambda c: simhash._keys(F.col(c), simhash._masks(distance, spare))
    assert all(r[0] for r in spark.createDataFrame(rows, "a long, b long").select(F.size(F.array_intersect(keys("a"), keys("b"))) > 0).collect())


WORDS = "alpha beta gamma delta Epsilon zeta ETA theta É ßtraße".split()


def texts(n, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(1, 4)):
            out.append(" ".join(base))
            if base:
                base = base[:]
                base[rng.randrange(len(base))] = "changed"
    return out + ["", " \t", "one", "one two", "one\x0btwo", "one\x85two"]


@pytest.mark.parametrize(("size", "distance"), [(3, 2), (5, 6)])
def test_simhash_against_brute_force(spark, size, distance):
    docs = texts(60)
    rows = [(k, t, "clash") for k, t in enumerate(docs)] + [(3, docs[3], "again"), (None, docs[5], None), (900, None, "null")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want_fp = [slow_fingerprint(t or "", size) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    n = len(rows)
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if bin(want_fp[a] ^ want_fp[b]).count("1") <= distance]
    label = slow_components(edges + [(k, k) for k in range(n)])
    groups = {}
    for k in range(n):
        groups.setdefault(label[k], []).append(k)
    smallest = {k: min((ids[x] for x in g if ids[x] is not None), default=None) for g in groups.values() for k in g}
    want = sorted((ids[k] if ids[k] is not None else -1, want_fp[k], smallest[k]) for k in range(n))
    got = sorted((r.doc_id if r.doc_id is not None else -1, int(r.hex, 16), r.component_id) for r in simhash.near_duplicates(df, size, distance).withColumn("hex", simhash.hex_digits(F.col("fp"))).collect())
    assert got == want
    kept = simhash.keep_one(df, size, distance)
    assert kept.columns == df.columns
    kept_ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in kept_ids if i is not None) == sorted({s for s in smallest.values() if s is not None})
    assert kept_ids.count(None) == 1
    assert simhash.near_duplicates(df.limit(0), size, distance).count() == 0


def test_simhash_without_ids_links(spark):
    """A chain of fingerprints of which the middle one, and a whole group, has no id."""
    chain = [(1, 0), (None, 3), (9, 15), (None, -1), (None, -4), (4, 0xF0F0F0 << 30)]
    df = spark.createDataFrame(chain, "doc_id long, fp long")
    got = {(r.fp): r.component_id for r in simhash._labels(df, 2, "doc_id").collect()}
    assert got == {0: 1, 3: 1, 15: 1, -1: None, -4: None, 0xF0F0F0 << 30: 4}


def test_one_of_equal_ids_stays_whatever_the_order(spark):
    rows = [(5, f"text {k} of this id", k, {"a": k}) for k in range(20)] + [(6, None, None, None), (6, "", 1, None), (None, "text 0 of this id", 0, None)]
    keep = lambda rows: sorted(map(str, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _ int, m map<string,int>").repartition(5, "_")).collect()))
    kept = keep(rows)
    assert len(kept) == 3 and kept == keep(rows[::-1])


def vectors(seed=3, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(40):
        center = rng.normal(size=dim)
        for _ in range(rng.integers(1, 6)):
            out.append((center + rng.normal(scale=0.12, size=dim)).tolist())
        if rng.random() < 0.4:
            out += [out[-1]] * 3
    return out


def slow_links(rows, threshold):
    unit = []
    for v in rows:
        ok = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        v = np.array(v) / np.abs(v).max() if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    return [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold]


def expected_links(rows, threshold=0.95):
    """(id, n_links, component_id, kept) of each row of (id, vector), by comparing all pairs."""
    edges = slow_links([v for _, v in rows], threshold)
    label = slow_components(edges + [(k, k) for k in range(len(rows))])
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(label[k], []).append(i)
    least = {root: min((i for i in group if i is not None), default=None) for root, group in ids.items()}
    degree = [sum(k in e for e in edges) for k in range(len(rows))]
    return sorted((str(i), degree[k], str(least[label[k]]), i is not None and least[label[k]] == i) for k, (i, _) in enumerate(rows))


def found_links(df, **settings):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_vectors(df, **settings).collect())


@pytest.mark.parametrize(("block", "shared"), [(2048, 1), (7, 1), (7, 2)])
def test_vectors_against_brute_force(spark, monkeypatch, block, shared):
    """Few pivots, so that all links are found, also where lists are cut by second pivots and into blocks."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.01], [1e300] * 16, [1e-300] * 16]
    rows = list(enumerate(vectors() + odd))
    df = spark.createDataFrame([(k, v, k) for k, v in rows], "vec_id long, embedding array<double>, unit long")
    assert found_links(df, nearest=8, shared_least=shared, pivots=12) == expected_links(rows)


def test_vectors_without_ids_link(spark):
    """Classes of which no row has an id count as links, connect others and take their smallest id."""
    line = [[1.0, 0.25 * k, 0.0] for k in range(5)]
    rows = [(None, line[0]), (9, line[1]), (None, line[2]), (None, line[2]), (4, line[3]), (4, line[3]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.01, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_links(df) == expected_links(rows)


def near_pairs(n, dim, cone, seed=5):
    """``n`` vectors around one direction (0: everywhere), and for each another at a cosine of 0.95 to 0.99."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.normal(size=(n, dim)))
    a = unit(cone * unit(rng.normal(size=(1, dim))) + a)
    side = rng.normal(size=(n, dim))
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    cosine = rng.uniform(0.951, 0.99, size=(n, 1))
    return np.vstack([a, cosine * a + np.sqrt(1 - cosine**2) * side])


@pytest.mark.parametrize(("n", "dim", "cone", "threshold"), [(1500, 64, 0.0, 0.95), (1500, 256, 1.5, 0.95), (1000, 256, 3.4, 0.985), (400, 8, 1.0, 0.95)])
def test_vector_recall_with_production_settings(spark, n, dim, cone, threshold):
    """At least nine of ten links, as the query is set up, for vectors that are spread, in cones, and clustered."""
    m = near_pairs(n, dim, cone).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>")
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    truth = int((unit @ unit.T >= threshold).sum() - len(m))
    found = embeddings.near_vectors(df, threshold).agg(F.sum("n_links")).first()[0]
    assert truth > 0 and 0.9 * truth <= found <= truth


def test_pivots_in_a_narrow_cone():
    m = near_pairs(1000, 256, 3.4)[:1000]
    assert len(embeddings.spread(m, 80)) == 80
    assert len(embeddings.spread(np.vstack([m[:1]] * 50), 10)) == 1


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None), (1, None), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(((r.vec_id or -1), r.n_links, r.kept) for r in embeddings.near_vectors(df).collect()) == [(-1, 0, False), (1, 0, True), (1, 0, True)]


def slow_lines(rows, ratio, least):
    pages, counts = {}, {}
    for host, text in rows:
        host = host or ""
        pages[host] = pages.get(host, 0) + 1
        for key in {x.strip(" \t\x0b\x0c\r") for x in (text or "").split("\n")} - {""}:
            counts[host, key] = counts.get((host, key), 0) + 1
    out = []
    for host, text in rows:
        host = host or ""
        if text is None:
            out.append((host, None, 0, 0))
            continue
        gone = lambda x: (n := counts.get((host, x.strip(" \t\x0b\x0c\r")), 0)) >= least and n > ratio * pages[host]  # noqa: E731, B023
        lines = text.split("\n")
        out.append((host, "\n".join(x for x in lines if not gone(x)), sum(bool(x.strip(" \t\x0b\x0c\r")) for x in lines), sum(gone(x) for x in lines)))
    return sorted(map(str, out))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_lines_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    rng = random.Random(6)
    lines = ["menu", " menu ", "footer\r", "", "  ", "A", "a"] + [f"line {k}" for k in range(60)]
    rows = [(rng.choice(["h1", "h2", "h3", None, ""]), "\n".join(rng.choice(lines[:7] if rng.random() < 0.4 else lines) for _ in range(rng.randrange(9)))) for _ in range(150)]
    rows += [("h1", None), ("alone", "only\nonly"), rows[0], rows[0], ("h1", "x" * 100_000)]
    df = spark.createDataFrame([(h, t, 5) for h, t in rows], "host string, text string, pages int")
    out = line_dedup.drop_boilerplate(df, F.col("host"), F.col("text"), 0.2, 3)
    assert sorted(str((r.host, r.text, r.n_lines, r.n_dropped)) for r in out.collect()) == slow_lines(rows, 0.2, 3)
    assert all(r.row.host == (r.host or r.row.host) and r.row.pages == 5 for r in out.collect())
    alone = line_dedup.drop_boilerplate(df, F.col("host"), F.col("text"), 0.2)
    assert sorted(str((r.host, r.text, r.n_lines, r.n_dropped)) for r in alone.collect()) == slow_lines(rows, 0.2, 1)
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("host"), F.col("text")).count() == 0


def test_lines_with_clashing_columns(spark):
    names = ["host", "text", "drop", "line", "_hit", "_drop", "_host", "_text", "_n_lines", "n_lines", "pages", "row", "hit", "n"]
    df = spark.createDataFrame([("h", "a\nb", *range(len(names) - 2))] * 3, names)
    out = line_dedup.without_boilerplate(df, F.col("host"), "text", 0.5, 3, "n")
    assert out.columns == names
    assert [tuple(r) for r in out.collect()] == [("h", "", *range(len(names) - 3), 0)] * 3


def test_page_text(spark):
    html = "<html><head><script>var t='<p>';</script><style>p{}</style></head><!-- <p>no</p> --><body><p>One <b>two</b></p><ul><li>a</li><li>b</li></ul></body>"
    text = spark.createDataFrame([(html,)], "h string").select(line_dedup.page_text(F.col("h"))).first()[0]
    assert [x for x in text.split("\n") if x] == ["One two", "a", "b"]
