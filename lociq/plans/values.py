"""Queries of column functions: headers, bodies, ranks, sources of a taxon, times and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import formats, headers
from lociq.functions import sequence as S
from lociq.operators import catalog, chunks, clades, filters, profiles
from lociq.plans.catalog import CATEGORY_SQL
from lociq.plans.collection import _HEADER_SQL, SIMPLE_SELECT, _headers, docs, simple_select
from lociq.plans.registry import query
from lociq.session import table

_CLEAN = "trim(regexp_replace(regexp_replace(d, '\\s*TaxID=\\d+', '', 'g'), '\\s*taxon:\\d+', '', 'g'))"


@query(f"""WITH h AS ({_HEADER_SQL}) SELECT h.p_partkey, CASE h.p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN 0 WHEN 4 THEN p_size + 1 ELSE 1 END::BIGINT AS taxon, '>' || id || ' ' || {_CLEAN} || ' TaxID=' || h.p_partkey AS rebuilt FROM h JOIN part ON part.p_partkey = h.p_partkey""")
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxon by any spelling, the root without one; and the header rebuilt with a taxon of its own."""
    return _headers(spark, sf_dir).select("p_partkey", headers.taxon_id_any(F.col("d")).alias("taxon"), headers.header(F.col("id"), F.col("d"), F.col("p_partkey")).alias("rebuilt"))


@query("""WITH g AS (SELECT CASE p_partkey % 5 WHEN 0 THEN p_type || ' OX=' || p_size WHEN 3 THEN p_type ELSE CASE p_partkey % 4 WHEN 0 THEN 'sp' WHEN 1 THEN 'gi' WHEN 2 THEN 'WP' ELSE 'lcl' END END AS taxonomy FROM part) SELECT taxonomy, count(*) AS n FROM g GROUP BY 1""")
def header_taxonomy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).groupBy(headers.taxonomy_text(F.col("id"), F.col("d")).alias("taxonomy")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_partkey, p_name, length(p_name) AS len, unnest(regexp_extract_all(p_name, '(?s).')) AS ch FROM part), k AS (SELECT p_partkey, p_name, len, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT p_partkey, regexp_matches(p_name, '(?i)[BJOUZX]') AS has_ambiguous, round(sum(-(n / len) * log2(n / len)) / 4.32, 6) AS complexity,
 list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: ord(substr(p_name, i, 1))::HUGEINT)), lambda a, b: ((a + b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS checksum FROM k GROUP BY p_partkey, p_name, len""")
def body_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.has_ambiguous(name).alias("has_ambiguous"), F.round(S.complexity(name), 6).alias("complexity"), S.checksum(name).alias("checksum"))


_NEIGHBOURS = "q AS (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@query(f"""WITH {_NEIGHBOURS}, k AS (SELECT *, greatest(length(a), length(b)) AS long_, least(length(a), length(b)) AS short_, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS x, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS y FROM q)
SELECT p_partkey, CASE WHEN (long_ - short_) * 2 > long_ THEN 0 ELSE round(len(list_filter(range(1, short_ + 1), lambda i: substr(a, i, 1) = substr(b, i, 1))) / long_, 6) END::DOUBLE AS identity,
 CASE WHEN (long_ - short_) * 5 > long_ THEN 0 ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) END::DOUBLE AS similarity FROM k""")
def pair_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    both = part.select("p_partkey", F.col("p_name").alias("a")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return both.select("p_partkey", F.round(S.positional_identity(F.col("a"), F.col("b")), 6).alias("identity"), F.round(S.export_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_RANK_NAMES = (*formats.RANKS, "Domain", "varietas", "unheard")


@query(f"""WITH r AS (SELECT p_partkey, p_size, {list(_RANK_NAMES)}[p_partkey % {len(_RANK_NAMES)} + 1] AS rank FROM part), d AS (SELECT *, CASE lower(rank) WHEN 'domain' THEN 'superkingdom' WHEN 'varietas' THEN 'strain' ELSE lower(rank) END AS name FROM r)
SELECT p_partkey, coalesce(nullif(list_position({list(formats.RANKS)}, name), 0) - 1, 10)::INT AS depth, CASE rank WHEN 'superkingdom' THEN 100 << 20 WHEN 'kingdom' THEN 50 << 20 WHEN 'phylum' THEN 20 << 20 WHEN 'class' THEN 10 << 20 WHEN 'order' THEN 5 << 20 WHEN 'family' THEN 2 << 20 WHEN 'species' THEN 500 << 10 WHEN 'subspecies' THEN 100 << 10 ELSE 1 << 20 END::BIGINT AS bytes,
 round(0.8 + 0.7 * least(p_size / 40.0, 1.0), 6)::DOUBLE AS weight, least(greatest(p_partkey // 30, 1), 1000)::BIGINT AS n_clusters, (p_partkey * 100000 * 10) // 1048576 + floor(p_size * (p_partkey * 100000) / 1048576 / 100)::BIGINT AS mib FROM d""")
def rank_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.lit(list(_RANK_NAMES))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.get(names, (F.col("p_partkey") % len(_RANK_NAMES)).cast("int")).alias("rank"))
    size = F.col("p_partkey") * 100_000
    return rows.select(
        "p_partkey",
        formats.rank_depth(F.col("rank")).alias("depth"),
        profiles.rank_bytes(F.col("rank")).cast("long").alias("bytes"),
        F.round(profiles.taxonomy_weight(F.col("p_size"), F.lit(40)), 6).alias("weight"),
        profiles.suggested_clusters(F.col("p_partkey"), 30).alias("n_clusters"),
        profiles.memory_estimate(F.col("p_size"), size).alias("mib"),
    )


_SOURCES = "s AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS b, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey % 5 END AS c FROM orders)"


@query(f"""WITH {_SOURCES}, n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS k, len(list_distinct([a, b, c])) AS different FROM s)
SELECT o_orderkey, CASE WHEN different = 0 THEN 'None' WHEN different = 1 THEN 'Unanimous' ELSE 'Conflicted' END AS resolution,
 round(CASE WHEN k > 1 AND a IS NOT DISTINCT FROM b AND b IS NOT DISTINCT FROM c THEN 1.0 ELSE ((a IS NOT NULL)::INT * 0.33 + (b IS NOT NULL)::INT * 0.33 + (c IS NOT NULL)::INT * 0.34) / CASE WHEN k > 1 THEN 2 ELSE 1 END END, 4)::DOUBLE AS confidence FROM n""")
def resolution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, k, least: F.when(F.col(c) % k > least, F.col(c) % k)
    three = part("o_custkey", 3, 0), part("o_orderkey", 4, 0), part("o_orderkey", 5, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", headers.resolution(*three).alias("resolution"), headers.confidence(*three).alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN 'up/sw' || o_custkey END AS dataset, CASE WHEN o_orderkey % 5 IN (1, 3) THEN strftime(o_orderdate, '%Y%m%d_000000') WHEN o_orderkey % 5 < 4 THEN 'current' END AS version, CASE WHEN o_orderkey % 5 >= 4 THEN NULL WHEN o_orderkey % 5 >= 2 THEN 'fast' ELSE 'auto' END AS profile,
 o_orderdate::DATE::VARCHAR AS day, 'W/"' || substr(md5(o_orderkey::VARCHAR), 1, 8) || '-' || substr(md5(o_custkey::VARCHAR), 1, 8) || '"' AS etag FROM orders""")
def reference_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database references with and without version and profile, the instants of versions, and tags of two versions."""
    k, cust = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    stamp = F.date_format("o_orderdate", "yyyyMMdd'_000000'")
    text = F.concat(F.lit("up/sw"), cust, F.when(k.isin(1, 3), F.concat(F.lit("@"), stamp)).otherwise(""), F.when(k >= 2, ":fast").otherwise(""), F.when(k == 4, "/more").otherwise(""))
    found = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", formats.reference_parts(text).alias("r"), stamp.alias("stamp"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    same = formats.version_time(F.col("stamp")) == formats.time_of(F.col("day"))
    tag = formats.etag(F.md5(F.col("o_orderkey").cast("string")), F.md5(F.col("o_custkey").cast("string")))
    return found.select("o_orderkey", F.concat_ws("/", "r.source", "r.dataset").alias("d"), F.col("r.version").alias("version"), F.col("r.profile").alias("profile"), F.when(same, F.col("day")).alias("day"), tag.alias("etag")).withColumn("dataset", F.nullif("d", F.lit(""))).drop("d")


# ---- filters and lookups ------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 100 AND 5000 AND contains(source, 'src1') AND lang <> 'en'")
def criteria_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, a literal part and a predicate of the caller's."""
    met = filters.containing(filters.by_length(docs(spark, sf_dir), "text", 100, 5000), "source", "src1")
    return met.where(F.col("lang") != "en").select("doc_id")


@query(f"SELECT reference_id, count(*) AS n_children FROM ({SIMPLE_SELECT}) JOIN documents USING (doc_id) WHERE role = 'child' AND n_chars <= 300 GROUP BY 1")
def short_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = simple_select(spark, sf_dir).where("role = 'child'").select("doc_id", "reference_id").join(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    return filters.with_short_children(children, "reference_id", "n_chars", 300)


@query("SELECT c_name FROM customer WHERE contains(c_name, '00001') ORDER BY c_name LIMIT 20")
def id_substring_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.containing(table(spark, sf_dir, "customer"), "c_name", "00001", 20).select("c_name")


_RANGES = "r AS (SELECT o_custkey, CASE WHEN o_custkey % 7 > 0 THEN min(o_orderkey) END AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)"


@query(f"WITH {_RANGES} SELECT o_custkey FROM r WHERE 500 BETWEEN lo AND hi OR lo IS NULL")
def range_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return filters.in_range_or_unknown(ranges.withColumn("lo", F.when(F.col("o_custkey") % 7 > 0, F.col("lo"))), "lo", "hi", 500).select("o_custkey")


@query("SELECT source, count(*) AS n_sequences, sum(n_chars)::BIGINT AS size, round(count(*) FILTER (lang = 'fr') / count(*), 6) AS relevance FROM documents GROUP BY 1 HAVING relevance > 0 AND n_sequences >= 3 AND size <= 1000000 ORDER BY relevance DESC, source")
def ranked_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a taxon, by its share, within a least number of members and a largest size."""
    found = chunks.lookup(docs(spark, sf_dir), "source", F.col("lang") == "fr", "n_chars", 3, 1_000_000)
    return found.orderBy(F.desc("relevance"), "source")


@query("SELECT p_brand, count(*) AS n_sequences, sum(p_size)::BIGINT AS size, round(count(*) FILTER (contains(lower(p_name), 'widget')) / count(*), 6) AS relevance FROM part GROUP BY 1 HAVING relevance > 0")
def organism_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.lookup(table(spark, sf_dir, "part"), "p_brand", F.contains(F.lower("p_name"), F.lit("widget")), "p_size")


@query("SELECT 'key:' || o_orderkey AS k, o_totalprice AS v FROM orders WHERE starts_with('key:' || o_orderkey, 'key:12')")
def key_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.concat(F.lit("key:"), F.col("o_orderkey").cast("string")).alias("k"), F.col("o_totalprice").alias("v"))
    return catalog.with_prefix(pairs, "k", "key:12")


@query("SELECT doc_id, 'taxa' AS found_by FROM documents WHERE lang IN ('fr', 'de') UNION ALL SELECT doc_id, 'database' FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, 'accession' FROM documents WHERE doc_id = 17")
def index_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By taxa, by database and by accession."""
    found = [("taxa", "lang", ["fr", "de"]), ("database", "source", ["src1"]), ("accession", "doc_id", [17])]
    parts = [catalog.lookup(docs(spark, sf_dir), column, values).select("doc_id", F.lit(kind).alias("found_by")) for kind, column, values in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT doc_id, reference_id, 'of the child' AS found_by FROM ({SIMPLE_SELECT}) WHERE role = 'child' AND doc_id = (SELECT min(doc_id) FROM ({SIMPLE_SELECT}) WHERE role = 'child') UNION ALL SELECT doc_id, reference_id, 'of the reference' FROM ({SIMPLE_SELECT}) WHERE role = 'child' AND reference_id = (SELECT min(reference_id) FROM ({SIMPLE_SELECT}) WHERE role = 'child')")
def delta_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta of a child, and all deltas of a reference."""
    from lociq.storage import stash

    deltas = stash(simple_select(spark, sf_dir).where("role = 'child'").select("doc_id", "reference_id"), "children")
    child, reference = deltas.agg(F.min("doc_id"), F.min("reference_id")).first()
    of = lambda column, value, kind: catalog.lookup(deltas, column, [value]).withColumn("found_by", F.lit(kind))
    return of("doc_id", child, "of the child").unionByName(of("reference_id", reference, "of the reference"))


# ---- chunk tables -------------------------------------------------------------------------------------


def _chunk_name() -> Column:
    return F.concat(F.when(F.col("p_size") == 7, "marine ").when(F.col("p_size") == 9, "Hospital ").otherwise(""), "p_name")


@query("""WITH c AS (SELECT p_partkey, p_retailprice * 30000 AS size, p_partkey AS taxon, lower(CASE WHEN p_size = 7 THEN 'marine ' WHEN p_size = 9 THEN 'Hospital ' ELSE '' END || p_name) AS name FROM part), k AS (SELECT CASE WHEN size < 1 << 20 THEN '<1MiB' WHEN size < 10 << 20 THEN '<10MiB' WHEN size < 50 << 20 THEN '<50MiB' WHEN size < 200 << 20 THEN '<200MiB' ELSE '>=200MiB' END AS bucket, CATEGORY AS c FROM c)
SELECT bucket, count(*) FILTER (c = 'model') AS model, count(*) FILTER (c = 'pathogen') AS pathogen, count(*) FILTER (c = 'environmental') AS environmental, count(*) FILTER (c = 'other') AS other FROM k GROUP BY 1""".replace("CATEGORY", CATEGORY_SQL))
def chunk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.distribution(table(spark, sf_dir, "part"), F.col("p_retailprice") * 30_000, clades.category(F.col("p_partkey"), _chunk_name()))


@query("SELECT p_brand, round(least(greatest(count(*) * 200.0 / sum(p_size), 1.0), 100.0), 6)::DOUBLE AS ratio FROM part GROUP BY 1")
def dedup_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(chunks.dedup_estimate(F.count("*"), F.sum("p_size")), 6).alias("ratio"))


@query("SELECT count(*) AS n_chunks, sum(n_chars)::BIGINT AS current_size, sum(n_chars // 3)::BIGINT AS estimated_size, sum(n_chars - n_chars // 3)::BIGINT AS saved, sum(n_chars - n_chars // 3) > 5000000 AS recommended FROM documents WHERE lang <> 'en' AND n_chars > 1024")
def compressible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.compressible(docs(spark, sf_dir).withColumn("is_compressed", F.col("lang") == "en"), "n_chars", "is_compressed")


@query("SELECT bits, hashes, n, round(-bits * ln(1 - least(ones, bits - 1) / bits) / hashes, 3) AS estimate FROM (SELECT n, bits, greatest(round(bits / n * ln(2)), 1)::BIGINT AS hashes, n * 2 AS ones FROM (SELECT count(*) AS n, ceil(-count(*) * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS bits FROM customer GROUP BY c_nationkey))")
def bloom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits and hash functions for each nation's customers, and the number of keys that twice as many set bits tell."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    sized = n.withColumn("bits", catalog.bloom_bits(F.col("n"), 0.01)).withColumn("hashes", catalog.bloom_hashes(F.col("n"), F.col("bits")))
    return sized.select("bits", "hashes", "n", F.round(catalog.bloom_count(F.col("bits"), F.col("hashes"), F.col("n") * 2), 3).alias("estimate"))
