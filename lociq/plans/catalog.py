"""Queries over catalogs, manifests, indexes and clades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import headers
from lociq.operators import catalog, clades, sampling, select, similarity, stats, taxonomy
from lociq.plans.collection import _HEADER_SQL, _headers, docs, simple_select
from lociq.plans.collection import SIMPLE_SELECT as SELECTED
from lociq.plans.history import _PATHS, _TREE, paths, taxonomy_version_diff, tree
from lociq.plans.registry import ORACLES, query
from lociq.session import table
from lociq.storage import stash


@query("SELECT source AS database, count(*) AS n_sequences, sum(n_chars)::BIGINT AS total_size FROM documents GROUP BY 1")
def list_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.databases(docs(spark, sf_dir), F.col("source"), "n_chars")


@query(f"""WITH h AS ({_HEADER_SQL}), a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN [p_partkey::VARCHAR, 'NM_' || p_partkey || '.2', 'NM_' || p_partkey] WHEN 0 THEN ['P' || p_partkey, split_part(id, '|', 3)] WHEN 2 THEN ['WP_' || p_partkey, 'WP_' || p_partkey || '.1'] ELSE [id] END AS l FROM h)
SELECT DISTINCT accession, p_partkey FROM (SELECT p_partkey, unnest(l) AS accession FROM a) WHERE length(accession) > 2""")
def accession_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.accession_index(_headers(spark, sf_dir), "p_partkey", headers.accessions(F.col("id")))


_CHUNKS = "d AS (SELECT source, lang, substr(sha256(text), 1, 2) AS p, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS part FROM documents GROUP BY ALL), dd AS (SELECT source, lang, sha256(string_agg(part, '' ORDER BY p)) AS chunk_hash FROM d GROUP BY ALL), c AS (SELECT source, lang, any_value(chunk_hash) AS chunk_hash, string_agg(DISTINCT lang, ',' ORDER BY lang) AS taxa, count(*) AS n_sequences, sum(n_chars)::BIGINT AS size FROM documents JOIN dd USING (source, lang) GROUP BY source, lang)"


@query(f"WITH {_CHUNKS} SELECT source, lang, chunk_hash, taxa, n_sequences, size FROM c")
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = docs(spark, sf_dir).withColumn("h", F.sha2("text", 256)).withColumn("taxon", F.col("lang"))
    return catalog.manifest(members.select("source", "lang", "h", "taxon", "n_chars"), ["source", "lang"], "h", "taxon", "n_chars")


@query(f"WITH {_CHUNKS} SELECT count(*) AS n_chunks, sum(('0x' || substr(chunk_hash, 1, 15))::BIGINT)::VARCHAR AS digest FROM c")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.manifest_digest(manifest_build(spark, sf_dir))


@query("SELECT sha256(text) AS h, 'repeated' AS error FROM documents GROUP BY 1 HAVING count(*) > 1")
def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.sha2("text", 256).alias("h"), "n_chars")
    return catalog.manifest_errors(rows, "h", "n_chars", "n_chars")


@query("SELECT l_partkey, min(year(l_shipdate))::INT AS first_version, max(year(l_shipdate))::INT AS last_version, count(DISTINCT year(l_shipdate)) AS n_versions FROM lineitem GROUP BY 1")
def occurrence_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.occurrences(table(spark, sf_dir, "lineitem"), "l_partkey", F.year("l_shipdate"))


@query("WITH y AS (SELECT year(o_orderdate)::INT AS version, count(*) AS n FROM orders GROUP BY 1) SELECT version, n FROM y ORDER BY version DESC LIMIT 5")
def version_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("version")).agg(F.count("*").alias("n"))
    return years.orderBy(F.desc("version")).limit(5)


@query("""WITH v AS (SELECT DISTINCT year(o_orderdate)::VARCHAR AS version FROM orders), a(alias, version) AS (VALUES ('stable', '1995'), ('old', '1992')), w(reference) AS (VALUES ('1996'), ('stable'), ('current'), ('nothing'))
SELECT reference, coalesce(v.version, a.version, CASE WHEN reference = 'current' THEN (SELECT max(version) FROM v) END) AS version FROM w LEFT JOIN v ON v.version = reference LEFT JOIN a ON a.alias = reference""")
def version_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("version")).distinct()
    aliases = spark.createDataFrame([("stable", "1995"), ("old", "1992")], "alias string, version string")
    wanted = spark.createDataFrame([("1996",), ("stable",), ("current",), ("nothing",)], "reference string")
    return catalog.resolve_alias(wanted, versions, aliases)


@query(f"WITH s AS ({SELECTED}), c AS (SELECT role, count(*) AS n FROM s GROUP BY 1) SELECT role, n, round(100.0 * n / sum(n) OVER (), 4) AS percent FROM c")
def reduction_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.breakdown(simple_select(spark, sf_dir), "role")


@query("SELECT reference_id, doc_id FROM (" + SELECTED + ") WHERE role = 'child'")
def child_reference_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_select(spark, sf_dir).where("role = 'child'").select("reference_id", "doc_id")


@query("SELECT d.doc_id, l.quality AS mapped_taxon, CASE WHEN l.quality IS NULL THEN 'none' ELSE 'mapping' END AS taxon_source FROM documents d LEFT JOIN labels l USING (doc_id)")
def taxonomy_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.enrich(docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "mapped_taxon", "taxon_source")


@query("SELECT l_suppkey, round(sum(l_discount * coalesce(w.weight, 1.0)), 6) AS total FROM lineitem LEFT JOIN (SELECT s_suppkey AS l_suppkey, 1.5 AS weight FROM supplier WHERE s_acctbal > 5000) w USING (l_suppkey) GROUP BY 1")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1.5).alias("weight"))
    return catalog.weighted_score(table(spark, sf_dir, "lineitem"), weights, "l_suppkey", "l_discount")


@query(f"WITH RECURSIVE {_PATHS} SELECT node, max(hops)::BIGINT AS depth FROM p GROUP BY 1")
def chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chain_depth(tree(spark, sf_dir), "node", "parent")


def _digests(level: str, name: str) -> str:
    """SQL for the digest of the hashes of each parent's children."""
    return f"{name} AS (SELECT node, sha256(string_agg(part, '' ORDER BY p)) AS d FROM (SELECT parent AS node, substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS part FROM {level} GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH {_TREE}, l3 AS (SELECT node, parent, sha256(node) AS h FROM t WHERE rank IN ('customer', 'supplier')),
{_digests('l3', 'd3')}, l2 AS (SELECT t.node, t.parent, sha256(t.node || coalesce(d, '')) AS h FROM t LEFT JOIN d3 ON d3.node = t.node WHERE rank = 'nation'),
{_digests('l2', 'd2')}, l1 AS (SELECT t.node, t.parent, sha256(t.node || coalesce(d, '')) AS h FROM t LEFT JOIN d2 ON d2.node = t.node WHERE rank = 'region'),
{_digests('l1', 'd1')}, l0 AS (SELECT t.node, t.parent, sha256(t.node || coalesce(d, '')) AS h FROM t LEFT JOIN d1 ON d1.node = t.node WHERE rank = 'root')
SELECT node, h AS hash FROM l3 UNION ALL SELECT node, h FROM l2 UNION ALL SELECT node, h FROM l1 UNION ALL SELECT node, h FROM l0""")
def taxonomy_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dag_hashes(tree(spark, sf_dir), "node", "parent", F.col("node"))


_RANKED = f"{_PATHS}, o AS (SELECT 'c:' || o_custkey AS node, count(*) AS k FROM orders GROUP BY 1), g AS (SELECT t.rank, p.ancestor, sum(k)::BIGINT AS n FROM o JOIN p USING (node) JOIN t ON t.node = p.ancestor GROUP BY 1, 2)"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("node"))
    return clades.by_every_rank(paths(spark, sf_dir), tree(spark, sf_dir), members, "node")


@query(f"WITH RECURSIVE {_RANKED} SELECT rank, ancestor, n FROM g")
def hierarchical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir)


@query(f"WITH RECURSIVE {_RANKED}, s AS (SELECT *, CASE rank WHEN 'region' THEN 200 WHEN 'nation' THEN 40 WHEN 'customer' THEN 12 END AS least FROM g) SELECT rank, ancestor, n, ceil(n / (2 * least))::BIGINT AS n_chunks FROM s WHERE n >= least")
def rank_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clades.packed_by_rank(_grouped(spark, sf_dir), {"region": 200, "nation": 40, "customer": 12})


@query("""WITH n AS (SELECT c_nationkey AS node, n_regionkey AS parent, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY parent ORDER BY n DESC, node ROWS UNBOUNDED PRECEDING) - n AS before FROM n WHERE n <= 60)
SELECT node, parent || ':' || (before // 60)::BIGINT AS cluster FROM s UNION ALL SELECT node, parent || ':own:' || node FROM n WHERE n > 60""")
def clade_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("parent"))
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count("*").alias("n")).join(nation, "node")
    return clades.clusters(counts, "node", "parent", 60)


CATEGORY_SQL = f"CASE WHEN taxon IN {clades.MODEL_ORGANISMS} THEN 'model' WHEN taxon IN {clades.PATHOGENS} OR name SIMILAR TO '.*({'|'.join(clades.PATHOGEN_NAMES)}).*' THEN 'pathogen' WHEN taxon IN {clades.ENVIRONMENTAL} OR name SIMILAR TO '.*({'|'.join(clades.ENVIRONMENTAL_NAMES)}).*' THEN 'environmental' ELSE 'other' END"


@query(f"WITH c AS (SELECT p_partkey AS taxon, CASE WHEN p_size = 7 THEN 'marine ' WHEN p_size = 9 THEN 'Hospital ' ELSE '' END || p_name AS n FROM part), k AS (SELECT {CATEGORY_SQL.replace('name SIMILAR', 'lower(n) SIMILAR')} AS category FROM c) SELECT category, count(*) AS n FROM k GROUP BY 1")
def organism_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_size") == 7, "marine ").when(F.col("p_size") == 9, "Hospital ").otherwise(""), "p_name")
    return table(spark, sf_dir, "part").groupBy(clades.category(F.col("p_partkey"), name).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH d AS ({ORACLES['taxonomy_version_diff']}), m AS (SELECT 'c:' || o_custkey AS node, count(*) AS n FROM orders GROUP BY 1) SELECT change, count(*) AS n_taxa, coalesce(sum(n), 0)::BIGINT AS n_sequences FROM d LEFT JOIN m USING (node) GROUP BY 1")
def impact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("node"))
    return clades.impact(taxonomy_version_diff(spark, sf_dir), members, "node")


@query("SELECT s_suppkey AS old, s_suppkey + 1000 AS new_taxon, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate <= TIMESTAMP '1995-06-01' AND s_suppkey % 10 = 0 GROUP BY ALL")
def retroactive_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past sequences under a newer taxonomy: rows shipped by a time whose taxon a later version renames."""
    mapping = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1000).alias("new_taxon"))
    past = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1995-06-01'").select(F.col("l_suppkey").alias("old"))
    return past.join(mapping, "old").groupBy("old", "new_taxon").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY event_type")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-20'")
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT user_id, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS n_old, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n_new, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') - count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS delta FROM events GROUP BY 1""")
def bitemporal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each entity before and from a time on; the difference is signed."""
    new = F.col("ts") >= F.expr("timestamp_ntz'2024-01-16'")
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.when(~new, 1)).alias("n_old"), F.count(F.when(new, 1)).alias("n_new"))
    return counts.withColumn("delta", F.col("n_new") - F.col("n_old"))


@query("SELECT o_orderkey, coalesce(nullif(regexp_extract('Release ' || year(o_orderdate) || '_0' || (o_orderkey % 9 + 1), '(?i)release[ :]+(\\d{4}_\\d{2})', 1), ''), '') AS version FROM orders")
def version_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Release "), F.year("o_orderdate").cast("string"), F.lit("_0"), (F.col("o_orderkey") % 9 + 1).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.detect_version(text).alias("version"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) < 60")
def rare_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rare(docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")), "n", 60)


@query("""WITH w AS (SELECT doc_id, letters, unnest(range(1, len(letters) - 18, greatest(len(letters) // 100, 1))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS letters FROM documents WHERE length(text) >= 20)), c AS (SELECT doc_id, i, unnest(letters[i:i + 19]) AS letter FROM w), k AS (SELECT doc_id, i, letter, count(*) AS k FROM c GROUP BY ALL), m AS (SELECT doc_id, i, max(k) AS fullest FROM k GROUP BY ALL)
SELECT doc_id, count(*) AS n_windows, count(*) FILTER (fullest > 4) AS n_low FROM m GROUP BY 1""")
def low_complexity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.low_complexity_windows(docs(spark, sf_dir), "doc_id", "text", most=4)


@query()
def cascaded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy representatives at falling thresholds: each round goes over the references of the one before."""
    rows = table(spark, sf_dir, "benchmark").withColumn("len", F.length("text"))
    out = None
    for level, threshold in enumerate((0.3, 0.2)):
        edges = similarity.jaccard_pairs(rows, "item_id", "text", 3, threshold)
        found = stash(select.greedy(rows, edges, "item_id", "len"), "level")
        part = found.where("reference_id is not null").withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        rows = stash(rows.join(found.where("reference_id is null").select(F.col("id").alias("item_id")), "item_id", "left_semi"), "rows")
    last = rows.select(F.col("item_id").alias("id"), F.lit(None).cast("long").alias("reference_id"), F.lit(None).cast("double").alias("similarity"), F.lit(-1).alias("level"))
    return out.unionByName(last)


@query(f"WITH RECURSIVE {ORACLES['lca'].split('WITH RECURSIVE ', 1)[1].rsplit(' SELECT m.a', 1)[0]}, z AS (SELECT m.a, m.b, round(least(1.0, hops / (2.0 * greatest(x.size, y.size))), 6) AS distance FROM m JOIN d x ON x.node = a JOIN d y ON y.node = b WHERE k = 1) SELECT a, b, distance FROM z WHERE a <> b AND distance <= 0.5")
def near_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.plans.history import _pairs

    return clades.near_taxa(taxonomy.pair_distances(paths(spark, sf_dir), _pairs(spark, sf_dir)), 0.5).select("a", "b", "distance")


_OWNERS = "k AS (SELECT item_id, length(text) AS len, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS kmer FROM benchmark), o AS (SELECT kmer, min_by(item_id, (-len, item_id)) AS item_id FROM k GROUP BY 1), g AS (SELECT item_id, length(text) AS len, gain FROM (SELECT item_id, count(*) AS gain FROM o GROUP BY 1) JOIN benchmark USING (item_id)), c AS (SELECT *, sum(gain) OVER (ORDER BY len DESC, item_id ROWS UNBOUNDED PRECEDING) AS upto, sum(gain) OVER () AS total FROM g)"


@query(f"WITH {_OWNERS} SELECT item_id AS id, gain, round(upto / total, 6) AS coverage FROM c WHERE (upto - gain) / total < 0.95")
def auto_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.functions.sequence import kmers
    from lociq.operators.profiles import auto_select as choose

    rows = table(spark, sf_dir, "benchmark").withColumn("len", F.length("text"))
    return choose(rows, "item_id", "len", kmers(F.col("text"), 3))


@query()
def seed_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.operators.profiles import seed_cover as cover

    return cover(docs(spark, sf_dir).withColumn("clade", F.concat_ws("/", "lang", "source")), "clade", "doc_id", "text")


@query("SELECT reference_id, doc_id, (row_number() OVER (PARTITION BY reference_id ORDER BY doc_id) - 1) // 10 AS batch_no FROM (" + SELECTED + ") WHERE role = 'child'")
def delta_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.operators.profiles import batched

    return batched(child_reference_map(spark, sf_dir), "reference_id", "doc_id", 10)


@query("SELECT user_id, ts, prev AS old_header, event_type AS new_header FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS prev, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS k FROM events) WHERE k > 1 AND prev IS DISTINCT FROM event_type")
def header_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.operators.temporal import changes

    found = changes(table(spark, sf_dir, "events"), "user_id", "ts", "event_type").where("change = 'Reclassified'")
    return found.select("user_id", "ts", F.col("old_value").alias("old_header"), F.col("new_value").alias("new_header"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract('>' || source || '_' || doc_id || ' text', '^>(\\S+)', 1), ''), '') AS name, n_chars AS length FROM documents")
def sequence_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit(">"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(" text"))
    return docs(spark, sf_dir).select("doc_id", F.regexp_extract(header, r"^>(\S+)", 1).alias("name"), F.col("n_chars").alias("length"))
