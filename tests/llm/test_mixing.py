import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lociq.llm import mixing

LEVELS = ["domain", "lang", "source"]


def weight():
    return {"domain": F.expr("if(domain = 'a', 3, 1)"), "lang": F.lit(1), "source": F.expr("if(source = 's0', 5, 1)")}


def slow_deal(total, caps, weights):
    """Fill the children by weight; who is full leaves, and the rest is dealt again."""
    open_, left, out = set(caps), Fraction(total), {}
    while True:
        w = sum(weights[c] for c in open_)
        full = {c for c in open_ if caps[c] <= left * weights[c] / w}
        if not full:
            break
        worst = min(full, key=lambda c: Fraction(caps[c], weights[c]))
        out[worst] = caps[worst]
        left -= caps[worst]
        open_.remove(worst)
        if not open_:
            return out, set()
    return out | {c: left * weights[c] / w for c in open_}, open_


def weights_of(level, keys):
    return {k: (3 if k == "a" else 1) if level == 0 else 1 if level == 1 else (5 if k == "s0" else 1) for k in keys}


@pytest.mark.parametrize(("share", "epochs"), [((3, 5), 1), ((1, 1), 2), ((9, 1), 3), ((1, 100), 1)])
def test_mix_against_brute_force(spark, share, epochs):
    rng = random.Random(epochs)
    rows = []
    for k in range(400):
        d, l, s = rng.choice("aab"), rng.choice(["en", "de", None]), f"s{min(rng.randrange(12), 5)}"
        rows.append((k, d, l, s, rng.choice([0, 1, 7, 50, 300]) if s != "s4" else 1))
    rows += [(None, "a", "en", "s0", 9), (5, "b", "de", "s1", None), (6, *rows[6][1:]), (7, "a", None, None, 10_000_000)]
    rows += [(None, "a", "de", "s1", 1 + k % 3) for k in range(300)] + [(77, "b", "en", "s2", 5)] * 100
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    got = mixing.mix(df, "doc_id", LEVELS, weight(), share=share, max_epochs=epochs).collect()
    leaves = {}
    for i, d, l, s, n in rows:
        if n:
            leaves.setdefault((d or "", l or "", s or ""), []).append((i, n))
    caps = {k: sum(n for _, n in v) * epochs for k, v in leaves.items()}
    total = min(sum(caps.values()), sum(caps.values()) // epochs * share[0] // share[1])
    taken = {}
    for r in got:
        taken.setdefault((r.domain, r.lang, r.source), []).append((r.doc_id, r.epoch, r.take_tokens))
    spent = {k: sum(x[2] for x in v) for k, v in taken.items()}
    assert sum(spent.values()) == total

    def check(prefix, budget):
        level = len(prefix)
        if level == 3:
            return
        under = {k[level]: 0 for k in caps if k[:level] == prefix}
        got_, cap_ = dict(under), dict(under)
        for k, c in caps.items():
            if k[:level] == prefix:
                cap_[k[level]] += c
                got_[k[level]] += spent.get(k, 0)
        want, _ = slow_deal(budget, cap_, weights_of(level, under))
        for key in under:
            assert abs(got_[key] - want[key]) < 1 + len(under), (prefix, key)
            check((*prefix, key), got_[key])

    check((), total)
    for k, v in leaves.items():
        size = sum(n for _, n in v)
        full, rest = divmod(spent.get(k, 0), size)
        order = sorted(v, key=lambda x: (hashlib.md5(f"7:{full}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), -1 if x[0] is None else x[0], x[1]))
        want = [(i, e, n) for i, n in v for e in range(full)]
        for i, n in order:
            if rest > 0:
                want.append((i, full, min(n, rest)))
                rest -= n
        assert sorted(taken.get(k, []), key=str) == sorted(want, key=str)


def test_small_buckets_make_no_difference(spark, monkeypatch):
    rows = [(k, "a", "en", "s", 1 + k % 9) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    one = sorted(mixing.mix(df, "doc_id", LEVELS, weight(), share=(1, 3)).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1 / 16)
    assert sorted(mixing.mix(df, "doc_id", LEVELS, weight(), share=(1, 3)).collect()) == one


def test_many_rows_alike(spark, monkeypatch):
    """A leaf of one missing id: few rows until the end, and no array of all its copies."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    df = spark.range(5000).selectExpr("cast(null as long) as doc_id", "'a' as domain", "'en' as lang", "'s' as source", "2 as tokens")
    got = mixing.mix(df, "doc_id", LEVELS, weight(), total=12_345).groupBy("epoch", "take_tokens").count().collect()
    assert sorted(map(tuple, got)) == [(0, 2, 5000), (1, 1, 1), (1, 2, 1172)]


def test_take_and_empty(spark):
    docs = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (None, "z", 7), (1, "x", 5)], "doc_id long, text string, epoch int")
    chosen = spark.createDataFrame([(1, 0), (1, 1), (None, 0)], "doc_id long, epoch long")
    assert mixing.take(docs, chosen.where("doc_id = 2"), "doc_id").count() == 0
    got = mixing.take(docs, chosen, "doc_id")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or -1), r.text) for r in got.collect()) == [(-1, "z"), (1, "x"), (1, "x"), (1, "x"), (1, "x")]
    empty = spark.createDataFrame([], "doc_id long, domain string, lang string, source string, tokens long")
    assert mixing.mix(empty, "doc_id", LEVELS, weight()).count() == 0


def test_word_count(spark):
    df = spark.createDataFrame([("a b\tc\n\x0bd",), ("",), (None,), ("\x85 x",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [4, 0, 0, 2]
