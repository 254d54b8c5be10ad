"""Queries over a collection of bodies: statistics, functions, filters, dedup, selection, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import formats, headers
from lociq.functions import sequence as S
from lociq.operators import chunks, dedup, filters, lengths, merkle, sampling, select, similarity, stats
from lociq.operators import diff as D
from lociq.plans.registry import query
from lociq.session import table
from lociq.storage import stash

SIMPLE_SELECT = """
WITH d AS (SELECT doc_id, n_chars AS len FROM documents),
e AS (SELECT *, row_number() OVER (ORDER BY len DESC, doc_id) AS k, floor(count(*) OVER () * 0.3) AS want FROM d WHERE len >= 50),
r AS (SELECT len, min(doc_id) AS ref FROM e WHERE k <= want GROUP BY len),
c AS (SELECT doc_id, len FROM e WHERE k > want),
lo AS (SELECT c.doc_id, c.len, r.len AS rl, r.ref FROM c ASOF LEFT JOIN r ON c.len >= r.len),
hi AS (SELECT c.doc_id, r.len AS rl, r.ref FROM c ASOF LEFT JOIN r ON c.len <= r.len),
b AS (SELECT lo.doc_id, CASE WHEN lo.ref IS NULL THEN hi.ref WHEN hi.ref IS NULL THEN lo.ref
        WHEN lo.len - lo.rl < hi.rl - lo.len THEN lo.ref WHEN lo.len - lo.rl > hi.rl - lo.len THEN hi.ref ELSE least(lo.ref, hi.ref) END AS ref
      FROM lo JOIN hi USING (doc_id))
SELECT doc_id, 'reference' AS role, NULL::BIGINT AS reference_id FROM e WHERE k <= want
UNION ALL SELECT doc_id, 'child', ref FROM b
UNION ALL SELECT doc_id, 'discarded', NULL FROM d WHERE len IS NULL OR len < 50"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(SIMPLE_SELECT)
def simple_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.simple_select(docs(spark, sf_dir), "doc_id", "n_chars")


@query("""
WITH l AS (SELECT length(text) AS len, length(text) - length(translate(text, 'GCgc', '')) AS gc, length(text) - length(translate(text, 'ATUatu', '')) AS at_,
  length(text) - length(translate(text, '-.', '')) AS gaps, length(text) - length(translate(text, 'BJOUZXbjouzx', '')) AS amb FROM documents WHERE text IS NOT NULL),
w AS (SELECT len, sum(len) OVER (ORDER BY len DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, sum(len) OVER () AS total, row_number() OVER (ORDER BY len) - 1 AS pos, count(*) OVER () AS n FROM l)
SELECT (SELECT count(*) FROM l) AS n_sequences, (SELECT sum(len)::BIGINT FROM l) AS total_length, (SELECT min(len) FROM l) AS min_length, (SELECT max(len) FROM l) AS max_length,
  (SELECT sum(gc)::BIGINT FROM l) AS n_gc, (SELECT sum(at_)::BIGINT FROM l) AS n_at, (SELECT sum(gaps)::BIGINT FROM l) AS n_gaps, (SELECT sum(amb)::BIGINT FROM l) AS n_ambiguous,
  (SELECT len FROM w WHERE pos = n // 2) AS median, (SELECT max(len) FROM w WHERE held >= floor(total * 0.5)) AS n50, (SELECT max(len) FROM w WHERE held >= floor(total * 0.9)) AS n90,
  (SELECT round(sum(len) / count(*), 4) FROM l) AS avg_length""")
def seq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(docs(spark, sf_dir), "text")


@query("""
WITH w AS (SELECT source, n_chars AS len, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, max(CASE WHEN held >= floor(total * 0.5) THEN len END) AS n50, max(CASE WHEN held >= floor(total * 0.9) THEN len END) AS n90 FROM w GROUP BY source""")
def nx_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = docs(spark, sf_dir).groupBy("source", F.col("n_chars").alias("len")).agg(F.count("*").alias("n"))
    mass = F.col("len") * F.col("n")
    order = Window.partitionBy("source").orderBy(F.desc("len"))
    walked = counts.withColumn("held", F.sum(mass).over(order)).withColumn("total", F.sum(mass).over(Window.partitionBy("source")))
    share = lambda p: F.max(F.when(F.col("held") >= F.floor(F.col("total") * p / 100), F.col("len")))
    return walked.groupBy("source").agg(share(50).alias("n50"), share(90).alias("n90"))


@query("""
SELECT b.bucket, count(d.doc_id) AS n FROM (VALUES ('<100', 0, 100), ('100-499', 100, 500), ('500-999', 500, 1000), ('1000-4999', 1000, 5000), ('5000-9999', 5000, 10000), ('>=10000', 10000, 1e18)) b(bucket, lo, hi)
LEFT JOIN documents d ON d.n_chars >= lo AND d.n_chars < hi GROUP BY b.bucket""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_histogram(docs(spark, sf_dir), F.col("n_chars"))


_GC = "CASE WHEN length(text) = length(translate(text, 'GCATUgcatu', '')) THEN 0.0 ELSE 100.0 * (length(text) - length(translate(text, 'GCgc', ''))) / (length(text) - length(translate(text, 'GCATUgcatu', ''))) END"


@query(f"""
WITH g AS (SELECT {_GC} AS gc FROM documents WHERE text IS NOT NULL)
SELECT b.bucket, count(gc) AS n FROM (VALUES ('0-20', -1, 20), ('20-40', 20, 40), ('40-60', 40, 60), ('60-80', 60, 80), ('80-100', 80, 1000)) b(bucket, lo, hi) LEFT JOIN g ON gc >= lo AND gc < hi GROUP BY b.bucket""")
def gc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.gc_histogram(docs(spark, sf_dir), F.col("text"))


@query("""
WITH c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS residue FROM documents), k AS (SELECT residue, count(*) AS n FROM c GROUP BY residue)
SELECT residue, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM k""")
def residue_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.residue_frequencies(docs(spark, sf_dir), "text")


@query("""
WITH c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS residue FROM documents), k AS (SELECT residue, count(*) AS n FROM c GROUP BY residue), p AS (SELECT n / sum(n) OVER () AS p FROM k)
SELECT count(*) AS n_residues, round(sum(-p * log2(p)), 6) AS entropy FROM p""")
def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dataset_entropy(docs(spark, sf_dir), "text")


@query("SELECT count(n_chars) AS n, round(1 - sum(n_chars::DOUBLE * n_chars) / (sum(n_chars::DOUBLE) * sum(n_chars::DOUBLE)), 9) AS diversity FROM documents")
def simpson_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_diversity(docs(spark, sf_dir), "n_chars")


@query("""
WITH t AS (SELECT CASE WHEN regexp_matches(text, '(?i)[EFILPQXZ]') THEN 'Protein' ELSE 'Nucleotide' END AS kind, count(*) AS n FROM documents GROUP BY 1),
s AS (SELECT sum(CASE WHEN kind = 'Protein' THEN n ELSE 0 END) > sum(CASE WHEN kind <> 'Protein' THEN n ELSE 0 END) AS p FROM t)
SELECT kind, n, CASE WHEN p THEN kind = 'Protein' ELSE kind <> 'Protein' END AS is_primary FROM t, s""")
def type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_distribution(docs(spark, sf_dir), "text")


@query("SELECT source, count(*) AS n, round(stddev_pop(n_chars) / avg(n_chars), 6) AS cv, count(*) >= 10 AND round(stddev_pop(n_chars) / avg(n_chars), 6) > 0.5 AS is_diverse FROM documents GROUP BY source")
def high_diversity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.high_diversity_groups(docs(spark, sf_dir), "source", "n_chars")


@query("""
WITH c AS (SELECT doc_id, length(text) AS len, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents WHERE length(text) > 1), k AS (SELECT doc_id, len, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id, round(sum(-(n / len) * log2(n / len)), 6) AS entropy, round(sum(-(n / len) * log2(n / len)) / log2(len), 6) AS normalised FROM k GROUP BY doc_id, len""")
def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, sf_dir).where(F.length(text) > 1).select("doc_id", F.round(S.entropy(text), 6).alias("entropy"), F.round(S.normalised_entropy(text), 6).alias("normalised"))


@query("""
WITH c AS (SELECT doc_id, length(text) AS len, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents WHERE length(text) >= 50), k AS (SELECT doc_id, len, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id FROM k GROUP BY doc_id, len HAVING round(sum(-(n / len) * log2(n / len)) / log2(len), 9) >= 0.4""")
def low_complexity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = filters.by_length(docs(spark, sf_dir), "text", 50)
    return long.where(F.round(S.normalised_entropy(F.col("text")), 9) >= 0.4).select("doc_id")


@query("""
WITH s AS (SELECT doc_id, length(text) AS len, translate(text, 'BJOUZXbjouzx', '') AS clean FROM documents)
SELECT doc_id, length(clean) AS clean_length, len - length(clean) AS n_removed, sha256(clean) AS clean_hash FROM s WHERE length(clean) > 0 AND (len - length(clean)) * 10 <= len""")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("_n", F.length("text"))
    return filters.sanitize(rows, "text").select("doc_id", F.length("text").cast("long").alias("clean_length"), (F.col("_n") - F.length("text")).cast("long").alias("n_removed"), F.sha2("text", 256).alias("clean_hash"))


@query("SELECT doc_id, sha256(reverse(translate(text, 'ATGCatgc', 'TACGTACG'))) AS rc_hash, sha256(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS upper_hash, sha256(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower_hash FROM documents")
def transform_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(S.reverse_complement(F.col("text")), 256).alias("rc_hash"), F.sha2(S.upper(F.col("text")), 256).alias("upper_hash"), F.sha2(S.lower(F.col("text")), 256).alias("lower_hash"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) = 0 THEN 'Unknown' WHEN (length(p_name) - length(translate(p_name, 'ATGCUNatgcun', ''))) * 10 > length(p_name) * 9
  THEN CASE WHEN length(p_name) > length(translate(p_name, 'Uu', '')) THEN 'RNA' ELSE 'DNA' END ELSE 'Protein' END AS kind, round(100.0 * (length(p_name) - length(translate(p_name, 'GCgc', ''))) / nullif(length(p_name) - length(translate(p_name, 'GCATUgcatu', '')), 0), 6) AS gc FROM part""")
def sequence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.sequence_kind(name).alias("kind"), F.when(S.count_of(name, "GCATU") > 0, F.round(S.gc_percent(name), 6)).alias("gc"))


# ---- headers ------------------------------------------------------------------------------------------

_HEADER_SQL = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sp|P' || p_partkey || '|' || replace(p_brand, '#', '_') WHEN 1 THEN 'gi|' || p_partkey || '|ref|NM_' || p_partkey || '.2|' WHEN 2 THEN 'WP_' || p_partkey || '.1' ELSE 'lcl_' || p_partkey END AS id, CASE p_partkey % 5 WHEN 0 THEN p_name || ' OS=' || p_type || ' OX=' || p_size || ' GN=' || p_brand || ' PE=1 SV=2' WHEN 1 THEN p_name || ' TaxID=0 OX=' || p_size WHEN 2 THEN p_name || ' taxon:' || p_size WHEN 3 THEN p_name || ' [' || p_type || ']' ELSE p_name || ' tax_id=' || p_size || ' TaxID=' || (p_size + 1) END AS d FROM part"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    four, five = F.col("p_partkey") % 4, F.col("p_partkey") % 5
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    ident = F.when(four == 0, c("sp|P", p, "|", F.replace(brand, F.lit("#"), F.lit("_")))).when(four == 1, c("gi|", p, "|ref|NM_", p, ".2|")).when(four == 2, c("WP_", p, ".1")).otherwise(c("lcl_", p))
    text = F.when(five == 0, c(name, " OS=", kind, " OX=", s, " GN=", brand, " PE=1 SV=2")).when(five == 1, c(name, " TaxID=0 OX=", s)).when(five == 2, c(name, " taxon:", s)).when(five == 3, c(name, " [", kind, "]")).otherwise(c(name, " tax_id=", s, " TaxID=", (F.col("p_size") + 1).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", ident.alias("id"), text.alias("d"))


@query(f"""
WITH h AS ({_HEADER_SQL}), x AS (SELECT *, try_cast(regexp_extract(d, 'TaxID=(\\d+)', 1) AS BIGINT) a, try_cast(regexp_extract(d, 'OX=(\\d+)', 1) AS BIGINT) b, try_cast(regexp_extract(d, 'taxon:(\\d+)', 1) AS BIGINT) c, try_cast(regexp_extract(d, 'tax_id=(\\d+)', 1) AS BIGINT) e FROM h)
SELECT p_partkey, coalesce(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END, CASE WHEN c > 0 THEN c END, CASE WHEN e > 0 THEN e END) AS taxon_id, coalesce(b, a) AS ox_first, trim(regexp_replace(regexp_replace(d, '\\s*TaxID=\\d+', '', 'g'), '\\s*taxon:\\d+', '', 'g')) AS cleaned,
  nullif(regexp_extract(d, 'OS=(.*?)(?: OX=| GN=| PE=| SV=|$)', 1), '') AS organism, nullif(regexp_extract(d, 'GN=(.*?)(?: OS=| OX=| PE=| SV=|$)', 1), '') AS gene FROM x""")
def parse_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _headers(spark, sf_dir).select("p_partkey", headers.taxon_id(d).alias("taxon_id"), headers.taxon_id_ox_first(d).alias("ox_first"), headers.without_taxon(d).alias("cleaned"), headers.tag(d, "OS").alias("organism"), headers.tag(d, "GN").alias("gene"))


@query(f"""
WITH h AS ({_HEADER_SQL})
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN 'NM_' || p_partkey WHEN 2 THEN 'WP_' || p_partkey ELSE id END AS accession,
 CASE p_partkey % 4 WHEN 1 THEN array_to_string(list_sort(list_distinct(list_filter([p_partkey::VARCHAR, 'NM_' || p_partkey || '.2', 'NM_' || p_partkey], lambda x: length(x) > 2))), ',') WHEN 0 THEN array_to_string(list_sort(list_filter(['P' || p_partkey, split_part(id, '|', 3)], lambda x: length(x) > 2)), ',')
  WHEN 2 THEN 'WP_' || p_partkey || ',WP_' || p_partkey || '.1' ELSE id END AS accessions FROM h""")
def accession_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("p_partkey", headers.accession(F.col("id")).alias("accession"), F.array_join(headers.accessions(F.col("id")), ",").alias("accessions"))


@query("SELECT orders.o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_entities FROM orders GROUP BY 1")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_entities"))


# ---- dedup and sets -----------------------------------------------------------------------------------


@query("SELECT sha256(text) AS seq_hash, min(doc_id) AS first_id, count(*) AS n_copies, any_value(length(text)) AS length FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.canonical(docs(spark, sf_dir), "text", "doc_id")


@query("SELECT seq_hash, doc_id, source FROM (SELECT sha256(text) AS seq_hash, doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source <> 'src0', doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k = 1")
def representation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.pick_representation(docs(spark, sf_dir), "text", "source", "doc_id", "src0")


@query("SELECT sha256(text) AS seq_hash, source, lang AS header, max(doc_id) AS last_seen FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.representations(docs(spark, sf_dir), "text", "source", F.col("lang"), "doc_id")


@query("SELECT count(*) AS n_total, count(DISTINCT text) AS n_distinct, round(count(*) / count(DISTINCT text), 6) AS ratio FROM documents")
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_ratio(docs(spark, sf_dir), F.sha2("text", 256))


@query("SELECT sha256(text) AS seq_hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(docs(spark, sf_dir), F.sha2("text", 256), "doc_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def orphan_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return dedup.missing(table(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def existence_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return dedup.existing(table(spark, sf_dir, "customer"), large, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS conflict_values, count(DISTINCT event_type) > 1 AS is_conflict FROM events WHERE event_type IS NOT NULL GROUP BY user_id")
def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.resolve_conflicts(table(spark, sf_dir, "events"), "user_id", "event_type")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping databases: content hashes of the sources of even numbers and of those under 10."""
    keyed = docs(spark, sf_dir).select(F.sha2("text", 256).alias("seq_hash"), "lang", "n_chars", F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("k"))
    return keyed.where("k % 2 = 0"), keyed.where("k < 10")


_TWO = "WITH k AS (SELECT sha256(text) AS seq_hash, lang, n_chars, regexp_extract(source, '(\\d+)', 1)::INT AS k FROM documents), a AS (SELECT * FROM k WHERE k % 2 = 0), b AS (SELECT * FROM k WHERE k < 10)"


@query(_TWO + """, da AS (SELECT seq_hash, max(n_chars) AS v FROM a GROUP BY 1), db AS (SELECT seq_hash, min(n_chars) AS v FROM b GROUP BY 1)
SELECT coalesce(da.seq_hash, db.seq_hash) AS seq_hash, da.v AS old_value, db.v AS new_value, CASE WHEN da.seq_hash IS NULL THEN 'Added' WHEN db.seq_hash IS NULL THEN 'Removed' WHEN da.v IS NOT DISTINCT FROM db.v THEN 'Unchanged' ELSE 'Modified' END AS change FROM da FULL JOIN db ON da.seq_hash = db.seq_hash""")
def db_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return D.compare(a.groupBy("seq_hash").agg(F.max("n_chars").alias("v")), b.groupBy("seq_hash").agg(F.min("n_chars").alias("v")), "seq_hash", "v")


@query(_TWO + """, e AS (SELECT seq_hash, max(l) AS l, max(r) AS r FROM (SELECT seq_hash, 1 AS l, 0 AS r FROM a UNION ALL SELECT seq_hash, 0, 1 FROM b) GROUP BY 1)
SELECT sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right, count(*) FILTER (l = 1 AND r = 1) AS n_shared, count(*) FILTER (l = 1 AND r = 0) AS n_left_only, count(*) FILTER (l = 0 AND r = 1) AS n_right_only, round(100.0 * count(*) FILTER (l = 1 AND r = 1) / sum(l), 4) AS left_percent, round(100.0 * count(*) FILTER (l = 1 AND r = 1) / sum(r), 4) AS right_percent FROM e""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.overlap(*_two(spark, sf_dir), "seq_hash")


@query(_TWO + ", x AS (SELECT lang, count(*) AS n_left FROM a GROUP BY 1), y AS (SELECT lang, count(*) AS n_right FROM b GROUP BY 1) SELECT lang, n_left, n_right, n_left + n_right AS n_total FROM x JOIN y USING (lang) ORDER BY n_total DESC, lang LIMIT 3")
def taxon_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.shared_top(*_two(spark, sf_dir), "lang", 3)


_VERSIONS = "WITH o AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    count = lambda when: orders.where(when).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    return count("o_orderdate < timestamp_ntz'1996-01-01'"), count("o_orderdate >= timestamp_ntz'1995-01-01'")


@query(_VERSIONS + " SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'Added' WHEN n.k IS NULL THEN 'Removed' ELSE 'Moved' END AS change, coalesce(n.v, 0) - coalesce(o.v, 0) AS size_delta FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.moved(*_versions(spark, sf_dir), "k", "v")


@query(_VERSIONS + ", c AS (SELECT CASE WHEN o.k IS NULL THEN 'Added' WHEN n.k IS NULL THEN 'Removed' WHEN o.v = n.v THEN 'Unchanged' ELSE 'Modified' END AS change, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1) SELECT change, n, round(100.0 * n / sum(n) OVER (), 4) AS percent FROM c")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.change_stats(D.compare(*_versions(spark, sf_dir), "k", "v"))


@query(_VERSIONS + " SELECT k, v FROM n")
def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying the change log of two versions to the old one gives the new one."""
    old, new = _versions(spark, sf_dir)
    return D.apply_log(old, D.change_log(old, new, "k", "v"), "k", "v")


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS s FROM lineitem WHERE l_quantity >= 10), f0 AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS s FROM lineitem WHERE l_discount < 0.05), f AS (SELECT * FROM f0 WHERE q IN (SELECT q FROM t)),
c AS (SELECT count(*) FILTER (t.q IS NOT NULL AND f.q IS NOT NULL) AS tp, count(*) FILTER (t.q IS NULL) AS fp, count(*) FILTER (f.q IS NULL) AS fn FROM t FULL JOIN f ON t.q = f.q AND t.s = f.s)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def alignment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("s"), "l_quantity", "l_discount")
    return D.alignment_quality(pairs.where("l_quantity >= 10"), pairs.where("l_discount < 0.05"), "q", "s")


@query("SELECT source, lang AS by, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 4) AS percent FROM documents GROUP BY source, lang")
def taxon_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.share_of(docs(spark, sf_dir), "source", F.col("lang"))


# ---- chunks, samples, orders --------------------------------------------------------------------------

PER_CHUNK = 40


@query(f"SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // {PER_CHUNK} AS chunk_no FROM documents")
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    return chunks.pack(rows, F.coalesce("lang", F.lit("")), "doc_id", PER_CHUNK)


@query(f"SELECT lang, chunk_no, count(*) AS n_sequences, count(*) * 1000 AS size FROM (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // {PER_CHUNK} AS chunk_no FROM documents) GROUP BY ALL")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_stats(chunk_packing(spark, sf_dir), "lang")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents")
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.interleave(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id").withColumn("turn", F.col("turn").cast("long"))


@query("""SELECT lang, bin, doc_id FROM (SELECT lang, n_chars // 50 AS bin, doc_id, count(*) OVER (PARTITION BY lang, n_chars // 50) AS n, row_number() OVER (PARTITION BY lang, n_chars // 50 ORDER BY len(list_distinct(regexp_extract_all(text, '(?s).'))) DESC, doc_id) AS k FROM documents) WHERE n <= 3 OR k <= ceil(n * 4 / 10)""")
def profile_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.profile_representatives(docs(spark, sf_dir), "lang", "doc_id", "n_chars", F.size(F.array_distinct(S.letters(F.col("text")))))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('1:' || o_orderkey), o_orderkey) AS k, floor(count(*) OVER () * 0.1) AS want FROM orders) WHERE k <= want")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_sample(table(spark, sf_dir, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, greatest(count(*) OVER () // 100, 1) AS step FROM orders) WHERE k % step = 0")
def evenly_spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 80 THEN 'hot' WHEN count(*) < 60 THEN 'cold' ELSE 'warm' END AS heat FROM events GROUP BY 1")
def hot_and_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hot_and_cold(table(spark, sf_dir, "events"), "user_id", 80, 60)


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top(docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")), "n", 5, "source")


@query("""WITH g AS (SELECT source, list_distinct(list(lang)) AS taxa, sum(n_chars)::BIGINT AS size FROM documents GROUP BY 1)
SELECT source, size FROM g WHERE list_has_any(taxa, ['fr', 'de']) AND size BETWEEN 1000 AND 1000000000 ORDER BY size DESC, source LIMIT 10""")
def chunk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = docs(spark, sf_dir).groupBy("source").agg(F.collect_set("lang").alias("taxa"), F.sum("n_chars").alias("size"))
    return chunks.query(groups, "taxa", ["fr", "de"], "size", 1000, 1_000_000_000, 10).select("source", "size")


@query("""WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS taxa FROM orders GROUP BY 1)
SELECT o_custkey, (list_contains(taxa, '1-URGENT') OR (list_contains(taxa, '2-HIGH') AND NOT list_contains(taxa, '5-LOW'))) AS met FROM g""")
def taxon_filter_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("taxa"))
    expression = filters.TaxonFilter.parse('"1-URGENT" OR "2-HIGH" AND NOT "5-LOW"', names={})
    return groups.select("o_custkey", expression.column(F.col("taxa")).alias("met"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice < 1024 THEN printf('%.2f B', p_retailprice) ELSE printf('%.2f KB', p_retailprice / 1024.0) END AS size_text FROM part""")
def format_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", formats.format_bytes(F.col("p_retailprice")).alias("size_text"))


# ---- similarity and selection -------------------------------------------------------------------------

_SETS = "s AS (SELECT item_id, length(text) AS len, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS ks FROM benchmark)"
_PAIRS = _SETS + ", p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.ks, b.ks)) AS i, len(a.ks) + len(b.ks) AS n FROM s a JOIN s b ON a.item_id < b.item_id), j AS (SELECT a, b, round(i / (n - i), 6) AS similarity FROM p WHERE i >= 0.2 * (n - i))"


@query("WITH k AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS kmer FROM benchmark) SELECT kmer, count(*) AS df FROM k GROUP BY 1")
def kmer_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.document_frequency(table(spark, sf_dir, "benchmark"), "item_id", "text", 3)


@query("WITH k AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS kmer FROM benchmark), d AS (SELECT kmer, count(*) AS df FROM k GROUP BY 1) SELECT item_id, round(sum(1.0 / df), 6) AS score FROM k JOIN d USING (kmer) GROUP BY 1")
def kmer_rarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.rarity(table(spark, sf_dir, "benchmark"), "item_id", "text", 3)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_pairs(table(spark, sf_dir, "benchmark"), "item_id", "text", 3, 0.2)


@query("WITH " + _PAIRS + " SELECT a, b, similarity FROM j")
def kmer_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query("WITH " + _PAIRS + ", e AS (SELECT a AS id, similarity FROM j UNION ALL SELECT b, similarity FROM j) SELECT id, count(*) AS degree, round(sum(similarity), 6) AS weight FROM e GROUP BY 1")
def similarity_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.degrees(_edges(spark, sf_dir))


@query("WITH RECURSIVE " + _PAIRS + ", e AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r(id, o) AS (SELECT item_id, item_id FROM benchmark UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a) SELECT id, min(o) AS component FROM r GROUP BY 1")
def similarity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.connected(_edges(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id")


#: Selection over documents: 3-mer Jaccard of the similarity matrix, and the length ratio of similar texts.
SIMILAR, LENGTH_RATIO = 0.7, 0.8


def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, text, len): each text once, under its smallest id."""
    kept = docs(spark, sf_dir).where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("_h")).agg(F.min("doc_id").alias("doc_id"))
    return kept.join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", "text", F.length("text").alias("len"))


def _selection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str, str]:
    rows = stash(distinct_texts(spark, sf_dir), "texts")
    return rows, similarity.block_pairs(rows, "doc_id", "text", 3, SIMILAR, LENGTH_RATIO), "doc_id", "len"


#: Ids that are copied to all tasks rather than joined.
COPIED_IDS = 1 << 20


def _selection_tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ids of distinct texts, and the members and tiles of their blocks; texts are read where they lie, and up to COPIED_IDS not dealt out."""
    all_ = docs(spark, sf_dir).where("text IS NOT NULL")
    ids = stash(all_.groupBy(F.sha2("text", 256).alias("_h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "ids")
    rows = all_.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= COPIED_IDS else ids, "doc_id", "left_semi")
    return ids, *similarity.block_tiles(rows, "doc_id", "text", 3, SIMILAR, LENGTH_RATIO)


@query()
def greedy_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.greedy_tiles(*_selection_tiles(spark, sf_dir), "doc_id")


@query()
def set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.set_cover_tiles(*_selection_tiles(spark, sf_dir), "doc_id")


@query()
def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.centrality(*_selection(spark, sf_dir))


@query(f"""WITH s AS ({SIMPLE_SELECT}), m AS (SELECT s.role, d.lang, d.n_chars FROM s JOIN documents d USING (doc_id))
SELECT count(*) FILTER (role = 'reference') AS n_references, count(*) FILTER (role = 'child') AS n_children, round(count(*) FILTER (role <> 'discarded') / count(*), 6) AS sequence_coverage,
 round(count(DISTINCT CASE WHEN role <> 'discarded' THEN lang END) / count(DISTINCT lang), 6) AS group_coverage, 1 - round(sum(CASE WHEN role = 'reference' THEN n_chars ELSE 0 END) / sum(n_chars), 6) AS size_reduction FROM m""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.quality(simple_select(spark, sf_dir), docs(spark, sf_dir), "doc_id", "lang", "n_chars")


@query()
def nw_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment identity of the similar benchmark pairs."""
    from lociq.operators.align import alignment_identity

    texts = table(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = _edges(spark, sf_dir).join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return pairs.select("a", "b", F.round(alignment_identity("text_a", "text_b"), 6).alias("identity"))


#: Shares of one reference's children.
SHARES = 64


@query("SELECT doc_id, reference_id, sha256(text) AS decoded_sha256 FROM (" + SIMPLE_SELECT + ") JOIN documents USING (doc_id) WHERE role = 'child'")
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child encoded against its reference and decoded again.

    Most children go to the shortest reference, so children are dealt out by id and the few references that
    have any are copied to each share.
    """
    from lociq.operators.align import apply_delta, delta

    chosen = simple_select(spark, sf_dir).where("role = 'child'").select("doc_id", "reference_id")
    texts = docs(spark, sf_dir).select("doc_id", "text")
    used = texts.select(F.col("doc_id").alias("reference_id"), F.col("text").alias("reference")).join(chosen.select("reference_id").distinct(), "reference_id", "left_semi")
    dealt = chosen.join(texts, "doc_id").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int"))
    pairs = dealt.join(used.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["reference_id", "share"])
    coded = pairs.withColumn("ops", delta("reference", "text"))
    return coded.select("doc_id", "reference_id", F.sha2(apply_delta(F.col("reference"), F.col("ops")), 256).alias("decoded_sha256"))


@query("""WITH RECURSIVE l0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS pos, h FROM (SELECT DISTINCT sha256(text) AS h FROM documents)),
r AS (SELECT 0 AS lvl, pos, h, count(*) OVER () AS n FROM l0
 UNION ALL
 SELECT lvl + 1, pos // 2, CASE WHEN count(*) = 2 THEN sha256(unhex(min_by(h, pos)) || unhex(max_by(h, pos))) ELSE min(h) END, (any_value(n) + 1) // 2 FROM r WHERE n > 1 GROUP BY lvl, pos // 2)
SELECT (SELECT count(*) FROM l0) AS n_leaves, h AS root FROM r WHERE n = 1""")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.root(docs(spark, sf_dir).select(F.sha2("text", 256).alias("h")), "h")
