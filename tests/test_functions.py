import math
import random
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociq.functions import formats, headers
from lociq.functions import sequence as S
from lociq.operators import align
from lociq.operators.filters import TaxonFilter


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_sequence_functions(spark):
    t = F.col("t")
    got = values(spark, [("ACGT",), ("",), ("MEEPQ",), ("aaaa",), ("ACGU",)], "t string", S.gc_percent(t), S.sequence_type(t), S.sequence_kind(t), F.round(S.entropy(t), 6), S.normalised_entropy(t), S.reverse_complement(t))
    assert got[0] == (50.0, "Nucleotide", "DNA", 2.0, 1.0, "ACGT")
    assert got[1] == (0.0, "Nucleotide", "Unknown", 0.0, 0.0, "")
    assert got[2][1:3] == ("Protein", "Protein")
    assert got[3][3:5] == (0.0, 0.0)
    assert got[4][2] == "RNA"


def test_kmers_jaccard_and_identity(spark):
    got = values(spark, [("abcab", "abc"), ("ab", "abc"), ("", "")], "a string, b string", S.kmers(F.col("a"), 3), F.round(S.jaccard(S.kmers(F.col("a"), 3), S.kmers(F.col("b"), 3)), 4), S.positional_identity(F.col("a"), F.col("b")))
    assert sorted(got[0][0]) == ["abc", "bca", "cab"]
    assert got[0][1] == 0.3333
    assert got[1] == ([], 0.0, 2 / 3)
    assert got[2] == ([], 0.0, 0.0)


def test_sanitize_and_wrap(spark):
    t = F.col("t")
    got = values(spark, [("A" * 19 + "X",), ("AAX",), ("XX",), ("ab\n" * 3,)], "t string", S.sanitized(t), S.wrapped(t, 8))
    assert got[0] == ("A" * 19, "AAAAAAAA\nAAAAAAAA\nAAAX")
    assert [g[0] for g in got[1:3]] == [None, None]


def test_taxon_ids(spark):
    d = F.col("d")
    rows = [("x TaxID=9 OX=5",), ("x TaxID=0 OX=666 PE=1",), ("taxon:562",), ("tax_id=7",), ("none",), ("[taxid:12]",)]
    got = values(spark, rows, "d string", headers.taxon_id(d), headers.taxon_id_ox_first(d), headers.taxon_id_any(d))
    assert got == [(9, 5, 9), (666, 666, 0), (562, None, 1), (7, None, 7), (None, None, 1), (None, None, 12)]


def test_header_round_trip(spark):
    h = headers.header(F.col("i"), F.col("d"), F.col("x"))
    rows = [("a", "some TaxID=3 text", 7), ("a", None, None), ("a", "text", None), ("a", None, 7)]
    assert [v[0] for v in values(spark, rows, "i string, d string, x long", h)] == [">a some text TaxID=7", ">a", ">a text", ">a TaxID=7"]


def test_accessions(spark):
    i = F.col("i")
    rows = [("sp|P12345|NAME_HUMAN",), ("gi|123|ref|NP_001.2|",), ("WP_5.1",), ("plain",)]
    got = values(spark, rows, "i string", headers.accession(i), headers.accessions(i))
    assert [g[0] for g in got] == ["P12345", "NP_001", "WP_5", "plain"]
    assert got[1][1] == ["123", "NP_001", "NP_001.2"]


def test_formats(spark):
    assert str(formats.DatabaseReference.parse("u/s")) == "u/s@current:auto"
    assert formats.DatabaseReference.parse("u/s@v1:p").profile == "p"
    with pytest.raises(ValueError):
        formats.DatabaseReference.parse("nothing")
    now = datetime(2024, 5, 6, 7, tzinfo=UTC)
    assert formats.parse_time("yesterday", now) == datetime(2024, 5, 5, tzinfo=UTC)
    assert formats.parse_time("2024-01-02").day == 2
    assert formats.parse_taxids("1, 2\n# no\n3 # yes") == [1, 2, 3]
    assert formats.version_key("v1.10") > formats.version_key("v1.9")
    got = values(spark, [("Genus",), ("domain",), ("odd",), (None,)], "r string", formats.rank_depth(F.col("r")))
    assert [g[0] for g in got] == [6, 0, 10, 10]


@pytest.mark.parametrize(
    ("text", "taxa", "want"),
    [("bacteria AND NOT e.coli", {2}, True), ("bacteria AND NOT e.coli", {2, 562}, False), ("1 OR 2 AND 3", {1}, True), ("(1 OR 2) AND 3", {1}, False), ("NOT 1 AND 2", {2}, True), ("nothing", {1}, False), ("NOT (1 OR 2)", {3}, True)],
)
def test_taxon_filter(spark, text, taxa, want):
    expression = TaxonFilter.parse(text)
    assert expression.matches(taxa) is want
    got = values(spark, [(sorted(taxa),)], "t array<int>", expression.column(F.col("t")))
    assert got == [(want,)]


@pytest.mark.parametrize("text", ["", "1 AND", "(1", "1 2", "AND 1", "1 )"])
def test_taxon_filter_errors(text):
    with pytest.raises(ValueError):
        TaxonFilter.parse(text)


def slow_score(a, b):
    """The best affine-gap score by three full tables."""
    low = -math.inf
    n, m = len(a), len(b)
    d = [[low] * (m + 1) for _ in range(n + 1)]
    up, left = [r[:] for r in d], [r[:] for r in d]
    d[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                up[i][j] = max(d[i - 1][j] + align.GAP_OPEN, up[i - 1][j] + align.GAP_EXTEND)
            if j:
                left[i][j] = max(d[i][j - 1] + align.GAP_OPEN, left[i][j - 1] + align.GAP_EXTEND)
            if i and j:
                d[i][j] = d[i - 1][j - 1] + (align.MATCH if a[i - 1] == b[j - 1] else align.MISMATCH)
            if i or j:
                d[i][j] = max(d[i][j], up[i][j], left[i][j])
    return d[n][m]


def test_alignment_scores():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        matches, columns, score = align.align(a, b)
        assert score == slow_score(a, b), (a, b)
        assert matches <= min(len(a), len(b)) and max(len(a), len(b)) <= columns <= len(a) + len(b)
    assert align.align("ACGT", "ACGT")[:2] == (4, 4)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_delta_round_trip(reference, child):
    assert align.decode_delta(reference, align.encode_delta(reference, child)) == child


def test_delta_in_sql(spark):
    rows = [("ACGTACGT", "ACGGACGTT"), ("", "abc"), ("abc", ""), ("same", "same"), (None, "x")]
    df = spark.createDataFrame(rows, "r string, c string").withColumn("ops", align.delta(F.col("r"), F.col("c")))
    got = df.select("c", align.apply_delta(F.col("r"), F.col("ops")).alias("d"), align.delta_cost(F.col("ops")).alias("n")).collect()
    assert [g.d for g in got] == ["ACGGACGTT", "abc", "", "same", None]
    assert got[3].n == 16


def test_best_path_in_blocks_of_rows():
    """Rows worked out again between kept ones give the path of one table, also for a free end, in little memory."""
    import tracemalloc

    rng = random.Random(4)
    for free_end in (False, True):
        for _ in range(120):
            a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 60))) for _ in range(2))
            path = align.best_path(a, b, free_end=free_end)
            assert sum(s != align.SECOND for s in path.steps) == len(a) and sum(s != align.FIRST for s in path.steps) == len(b)
            score, run, tail = 0, None, (path.steps[::-1] + b"\x00").find(b"\x00") if free_end else 0
            i = j = 0
            for k, step in enumerate(path.steps):
                if step == align.BOTH:
                    score += align.MATCH if a[i] == b[j] else align.MISMATCH
                elif not free_end or k < len(path.steps) - tail:
                    score += align.GAP_EXTEND if run == step else align.GAP_OPEN
                i, j, run = i + (step != align.SECOND), j + (step != align.FIRST), step
            assert score == path.score if not free_end else score >= path.score - 1000
    long_a = "".join(rng.choice("ACGT") for _ in range(12_000))
    long_b = long_a[:3000] + long_a[3500:9000] + "T" * 40 + long_a[9000:]
    tracemalloc.start()
    matches, columns, _ = align.align(long_a, long_b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert columns == 12_040 and matches >= 11_480
    assert peak < 100_000_000


def test_scores_of_proteins_and_case():
    assert align.scoring_for("ACGT") is align.NUCLEOTIDE and align.scoring_for("acdef") is align.PROTEIN
    table = align.PROTEIN.table
    assert len(table) == 20 and all(table[i][j] == table[j][i] for i in range(20) for j in range(20))
    assert table[align.AMINO_ACIDS.index("W")][align.AMINO_ACIDS.index("W")] == 11
    assert align.align("ACDEFGHIKLM", "acdefghlklm")[:2] == (10, 11)
    assert align.align("ATGCATGC", "atgcatgc") == (8, 8, 80)
    assert align.align("ATGCAAATGC", "ATGCATGC")[:2] == (8, 10)
    own = align.Scoring(1, -1, -2, -1)
    assert align.align("AAAA", "AATAA", own) == (4, 5, 2)
    assert align.align("ATGC", "")[:2] == (0, 4)


def test_banded_delta():
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        b = "".join(b)
        blocks = align.common_blocks(a, b, 60)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert sum(n for _, _, n in blocks) == table[-1][-1]
        assert all(a[x : x + n] == b[y : y + n] for x, y, n in blocks)
        ops, cost = align.banded_delta(a, b, 60)
        assert align.decode_delta(a, [o for o in ops if o[0] != "skip"]) == b
        assert cost == sum(16 if o[0] == "copy" else 8 + len(o[3].encode()) for o in ops)
    assert align.common_blocks("a" * 50, "b" * 50, 10) is None
    assert align.banded_delta("a" * 50, "b" * 50, 10) == ([("insert", 0, 0, "b" * 50)], 58)
