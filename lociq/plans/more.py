"""Queries of selection, chunks, proofs, checks, trees and histories that build on the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import catalog, checks, chunks, clades, lengths, merkle, processors, reports, sampling, select, similarity, stats, taxonomy, temporal
from lociq.operators import diff as D
from lociq.plans import history
from lociq.plans.collection import SIMPLE_SELECT, docs, simple_select
from lociq.plans.history import _PATHS, _TREE, paths, tree
from lociq.plans.registry import ORACLES, query
from lociq.session import table
from lociq.storage import stash

# ---- selection over a small collection ----------------------------------------------------------------


def _ks(k: int) -> str:
    letters = " || ".join(f"c[i + {j}]" if j else "c[i]" for j in range(k))
    return f"s AS (SELECT item_id, len(c) AS len, list_distinct(list_transform(range(1, len(c) - {k} + 2), lambda i: {letters})) AS ks FROM (SELECT item_id, regexp_extract_all(text, '(?s).') AS c FROM benchmark))"


def _edges_sql(k: int, threshold: float, ratio: float, also: str = "") -> str:
    return f"{_ks(k)}, j AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.ks, b.ks)) AS i, len(a.ks) + len(b.ks) AS n FROM s a JOIN s b ON a.item_id < b.item_id AND least(a.len, b.len) >= {ratio} * greatest(a.len, b.len) AND least(len(a.ks), len(b.ks)) >= {threshold} * greatest(len(a.ks), len(b.ks))), e AS (SELECT a, b, round(i / (n - i), 6) AS similarity FROM j WHERE i >= {threshold} * (n - i){also})"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text", F.length("text").alias("len"), (F.col("item_id") % 3).alias("taxon"))


def _item_edges(spark: SparkSession, sf_dir: str, k: int = 3, threshold: float = 0.25, ratio: float = 0.0) -> DataFrame:
    return similarity.jaccard_pairs(_items(spark, sf_dir), "item_id", "text", k, threshold, ratio)


@query(f"WITH {_edges_sql(2, 0.2, 0.5)} SELECT a, b, similarity FROM e")
def loose_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-mers, a fifth shared, lengths within a half: the pairs of the automatic selection."""
    return _item_edges(spark, sf_dir, 2, 0.2, 0.5)


#: Greedy choice as a recursion over the rows in their order, with the references so far.
_GREEDY = """, b AS (SELECT a AS u, b AS v, similarity FROM e UNION ALL SELECT b, a, similarity FROM e), q AS (SELECT item_id AS id, row_number() OVER (ORDER BY length(text) DESC, item_id) AS k FROM benchmark),
near AS (SELECT q.id, q.k, list(b.v) FILTER (b.v IS NOT NULL) AS vs FROM q LEFT JOIN b ON b.u = q.id GROUP BY ALL),
r(k, refs) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT near.k, CASE WHEN list_has_any(coalesce(vs, []), refs) THEN refs ELSE list_append(refs, near.id) END FROM r JOIN near ON near.k = r.k + 1),
refs AS (SELECT unnest(refs) AS id FROM r WHERE k = (SELECT max(k) FROM r)),
g AS (SELECT q.id, CASE WHEN refs.id IS NULL THEN (SELECT min_by(b.v, p.k) FROM b JOIN q p ON p.id = b.v JOIN refs x ON x.id = b.v WHERE b.u = q.id) END AS reference_id FROM q LEFT JOIN refs USING (id))"""


@query(f"WITH RECURSIVE {_edges_sql(3, 0.25, 0.0)}{_GREEDY} SELECT g.id, reference_id, similarity FROM g LEFT JOIN b ON b.u = g.id AND b.v = reference_id")
def greedy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.SELECTORS["greedy"](_items(spark, sf_dir), _item_edges(spark, sf_dir), "item_id", "len")


@query(f"WITH RECURSIVE {_edges_sql(2, 0.2, 0.5)}{_GREEDY} SELECT g.id, reference_id, similarity, reference_id IS NULL AS is_reference FROM g LEFT JOIN b ON b.u = g.id AND b.v = reference_id")
def auto_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed similarity, until enough is covered; so few items never reach the least number of references."""
    return select.SELECTORS["auto"](_items(spark, sf_dir), _item_edges(spark, sf_dir, 2, 0.2, 0.5), "item_id", "len")


@query(f"""WITH RECURSIVE {_edges_sql(3, 0.25, 0.0)}, b AS (SELECT a AS u, b AS v, similarity AS s FROM e UNION ALL SELECT b, a, similarity FROM e),
r(open_, ref) AS (SELECT (SELECT list(item_id) FROM benchmark), NULL::BIGINT UNION ALL
 SELECT list_filter(open_, lambda x: x <> best AND NOT list_contains(taken, x)), best FROM (SELECT open_, best, (SELECT coalesce(list(v), []) FROM b WHERE u = best) AS taken FROM (SELECT open_, (SELECT max_by(id, (g, -id)) FROM (SELECT x.id, round(coalesce(sum(CASE WHEN list_contains(open_, b.v) THEN s END), 0), 9) AS g FROM (SELECT unnest(open_) AS id) x LEFT JOIN b ON b.u = x.id GROUP BY 1)) AS best FROM r WHERE len(open_) > 0))),
o AS (SELECT ref, row_number() OVER (ORDER BY len(open_) DESC) AS k FROM r WHERE ref IS NOT NULL)
SELECT item_id AS id, CASE WHEN o.ref IS NULL THEN m.ref END AS reference_id, CASE WHEN o.ref IS NULL THEN m.s END AS similarity FROM benchmark LEFT JOIN o ON o.ref = item_id LEFT JOIN (SELECT u, min_by(v, k) AS ref, min_by(s, k) AS s FROM b JOIN o ON o.ref = v GROUP BY 1) m ON m.u = item_id""")
def cover_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.SELECTORS["set_cover"](_items(spark, sf_dir), _item_edges(spark, sf_dir), "item_id", "len")


@query(f"WITH RECURSIVE {_edges_sql(3, 0.25, 0.0, ' AND a % 3 = b % 3')}{_GREEDY} SELECT g.id, reference_id, similarity FROM g LEFT JOIN b ON b.u = g.id AND b.v = reference_id")
def greedy_within_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.greedy_by_group(_items(spark, sf_dir), _item_edges(spark, sf_dir), "item_id", "len", "taxon")


_TOP = "t AS (SELECT item_id FROM benchmark WHERE item_id % 4 = 0), b AS (SELECT a AS u, b AS v, similarity FROM e UNION ALL SELECT b, a, similarity FROM e)"


@query(f"WITH {_edges_sql(3, 0.2, 0.0)}, {_TOP} SELECT u AS id, min_by(v, (-similarity, v)) AS reference_id, max(similarity) AS similarity FROM b JOIN t ON t.item_id = v WHERE u NOT IN (SELECT item_id FROM t) GROUP BY 1")
def best_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each other item against the references, all of them: the most similar."""
    refs = _items(spark, sf_dir).where("item_id % 4 = 0").select("item_id")
    return similarity.best_reference(_item_edges(spark, sf_dir, 3, 0.2), refs, "item_id")


@query(f"""WITH s AS ({SIMPLE_SELECT}) SELECT s.doc_id, s.role, s.reference_id, CASE WHEN s.role = 'child' AND c.n_chars <= 2000 THEN sha256(c.text) END AS decoded_sha256 FROM s JOIN documents c USING (doc_id)""")
def reduce_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole reduction, stored under a profile, read again, and every delta decoded."""
    from lociq.operators.align import apply_delta
    from lociq.operators.profiles import load_profile, save_profile
    from lociq.plans.reduce import reduce
    from lociq.storage import scratch

    found = reduce(docs(spark, sf_dir), "doc_id", "text", longest=2000)
    path = scratch(spark, "profiles")
    save_profile(found.selection, path, "docs", "v1", "third")
    selection = load_profile(spark, path, "docs", "v1", "third")
    texts = docs(spark, sf_dir).select(F.col("doc_id").alias("reference_id"), F.col("text").alias("_r"))
    decoded = found.deltas.join(texts, "reference_id").select("doc_id", F.sha2(apply_delta(F.col("_r"), F.col("ops")), 256).alias("decoded_sha256"))
    return selection.join(decoded, "doc_id", "left").select("doc_id", "role", "reference_id", "decoded_sha256")


#: The same over the distinct texts of documents.
_TEXTS = "WITH RECURSIVE x AS (SELECT min(doc_id) AS item_id, text FROM documents WHERE text IS NOT NULL GROUP BY text), "
ORACLES["greedy_redundancy"] = _TEXTS + ORACLES["greedy_items"].removeprefix("WITH RECURSIVE ").replace(_edges_sql(3, 0.25, 0.0), _edges_sql(3, 0.7, 0.8)).replace("benchmark", "x")
ORACLES["set_cover"] = _TEXTS + ORACLES["cover_items"].removeprefix("WITH RECURSIVE ").replace(_edges_sql(3, 0.25, 0.0), _edges_sql(3, 0.7, 0.8)).replace("benchmark", "x")


# ---- orders, sums, plateaus ---------------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS by_length, row_number() OVER (ORDER BY lang, n_chars, doc_id) - 1 AS by_taxon FROM documents")
def length_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of rows in two orders: by length, and by taxon and length."""
    rows = docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    first = sampling.numbered(rows, ["n_chars", "doc_id"], "by_length")
    return sampling.numbered(first, ["lang", "n_chars", "doc_id"], "by_taxon").select("doc_id", "by_length", "by_taxon")


@query("SELECT n_chars AS len, count(*) AS n, sum(sum(n_chars)) OVER (ORDER BY n_chars DESC)::BIGINT AS held FROM documents GROUP BY 1")
def cumulative_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.walked(lengths.by_length(docs(spark, sf_dir), "n_chars")).select("len", "n", "held")


_STEPS = "d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS step, sum(n) OVER (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) / (SELECT count(*) FROM orders) AS coverage FROM d)"


@query(f"WITH {_STEPS}, g AS (SELECT step, coverage, coverage - lag(coverage, 9) OVER (ORDER BY step) AS gain FROM w) SELECT min(step) AS stop FROM g WHERE gain < 0.05 AND step >= 39 AND coverage >= 0.1")
def plateau_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step at which customers by orders add little; running sums by blocks."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    steps = stash(sampling.numbered(counts, [F.desc("n"), "o_custkey"], "step"), "steps")
    total = table(spark, sf_dir, "orders").count()
    covered = sampling.running_sum(steps, "step", "n").select("step", (F.col("upto") / F.lit(float(total))).alias("coverage"))
    return catalog.plateau(covered, "step", "coverage", gain=0.05, least_steps=40)


# ---- chunks -------------------------------------------------------------------------------------------

_REFS = "c AS (SELECT source AS chunk, sha256(text) AS seq_hash FROM documents GROUP BY ALL), k AS (SELECT sha256(text) AS seq_hash, min(doc_id) AS first_id FROM documents GROUP BY 1), r AS (SELECT sha256(text) AS seq_hash, min(lang) AS header FROM documents WHERE lang <> 'es' GROUP BY 1)"


@query(f"WITH {_REFS} SELECT chunk, seq_hash, first_id, header FROM c JOIN k USING (seq_hash) JOIN r USING (seq_hash)")
def chunk_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's refs, the canonical row of each, and its representation; some have none."""
    keyed = docs(spark, sf_dir).select("source", "lang", "doc_id", F.sha2("text", 256).alias("seq_hash"))
    held = keyed.groupBy(F.col("source").alias("chunk")).agg(F.collect_set("seq_hash").alias("refs"))
    canonical = keyed.groupBy("seq_hash").agg(F.min("doc_id").alias("first_id"))
    shown = keyed.where("lang <> 'es'").groupBy("seq_hash").agg(F.min("lang").alias("header"))
    return chunks.members_of(held, "refs", canonical, shown, "seq_hash").select("chunk", "seq_hash", "first_id", "header")


_HIERARCHY = "m AS (SELECT DISTINCT 'full:' || lang || ':' || (doc_id % 2) AS chunk, 0 AS delta, sha256(text) AS seq FROM documents UNION SELECT DISTINCT 'delta:' || source, 1, sha256(text) FROM documents WHERE doc_id % 3 > 0 UNION SELECT DISTINCT 'full:z', 0, sha256(text) FROM documents WHERE doc_id % 5 = 0)"


@query(f"""WITH RECURSIVE {_HIERARCHY}, q AS (SELECT chunk, list(seq) AS seqs, row_number() OVER (ORDER BY min(delta), chunk) AS k FROM m GROUP BY chunk),
r(k, chunk, held, new_, kept) AS (SELECT 0::BIGINT, '', []::VARCHAR[], 0::BIGINT, false UNION ALL SELECT q.k, q.chunk, CASE WHEN n > len(seqs) // 2 THEN list_concat(held, seqs) ELSE held END, n, n > len(seqs) // 2 FROM (SELECT q.*, r.held, len(list_filter(seqs, lambda x: NOT list_contains(r.held, x))) AS n FROM r JOIN q ON q.k = r.k + 1) q)
SELECT chunk, new_ AS n_new, kept FROM r WHERE k > 0""")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two ranks: full ones first, each kept if over half of it is in none kept before."""
    keyed = docs(spark, sf_dir).select("doc_id", "lang", "source", F.sha2("text", 256).alias("seq"))
    named = lambda rows, name, delta: rows.select(name.alias("chunk"), F.lit(delta).alias("delta"), "seq")
    full = named(keyed, F.concat(F.lit("full:"), "lang", F.lit(":"), (F.col("doc_id") % 2).cast("string")), 0)
    low = named(keyed.where("doc_id % 3 > 0"), F.concat(F.lit("delta:"), "source"), 1)
    more = named(keyed.where("doc_id % 5 = 0"), F.lit("full:z"), 0)
    return chunks.merge_hierarchy(full.unionByName(low).unionByName(more).distinct(), "chunk", "delta", "seq")


@query("WITH b AS (SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars) // 50000 AS batch FROM documents) SELECT batch::BIGINT AS batch, count(*) AS n, min(doc_id) AS first_id FROM b GROUP BY 1")
def bounded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that begin with every 50,000 characters."""
    rows = docs(spark, sf_dir).select("doc_id", "n_chars")
    return chunks.batches_by_size(rows, ["doc_id"], "n_chars", 50_000).groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


# ---- proofs and checks --------------------------------------------------------------------------------

_LEVELS = """l0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS pos, h FROM (SELECT DISTINCT sha256(text) AS h FROM documents)),
r AS (SELECT 0 AS lvl, pos, h, count(*) OVER () AS n FROM l0 UNION ALL
 SELECT lvl + 1, pos // 2, CASE WHEN count(*) = 2 THEN sha256(unhex(min_by(h, pos)) || unhex(max_by(h, pos))) ELSE ODD END, (any_value(n) + 1) // 2 FROM r WHERE n > 1 GROUP BY lvl, pos // 2)"""


@query("WITH RECURSIVE " + _LEVELS.replace("ODD", "sha256(unhex(min(h)) || unhex(min(h)))") + " SELECT h AS root FROM r WHERE n = 1")
def taxonomy_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the verifier builds it: an odd node is paired with itself."""
    return merkle.root(docs(spark, sf_dir).select(F.sha2("text", 256).alias("h")), "h", duplicate=True).select("root")


@query("WITH RECURSIVE " + _LEVELS.replace("ODD", "min(h)") + ", p AS (SELECT 0 AS leaf UNION ALL SELECT 5) SELECT leaf::BIGINT AS leaf, lvl::BIGINT AS level, h AS sibling, CASE WHEN ((leaf >> lvl) & 1) = 1 THEN 'left' ELSE 'right' END AS side FROM p JOIN r ON r.pos = xor(leaf >> lvl, 1) WHERE n > 1")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The siblings from two leaves up, if the proofs verify."""
    tree_ = merkle.levels(docs(spark, sf_dir).select(F.sha2("text", 256).alias("h")), "h")
    root = tree_[-1].first()["hash"]
    found = []
    for leaf in (0, 5):
        path = merkle.proof(tree_, leaf, with_level=True)
        start = tree_[0].where(F.col("pos") == leaf).first()["hash"]
        sealed = merkle.seal(root, root, "now")
        sides = [(sibling, side) for _, sibling, side in path]
        if merkle.verify_temporal((start, start), (sides, sides), (root, root), "now", sealed):
            found += [(leaf, level, sibling, side) for level, sibling, side in path]
    return spark.createDataFrame(found, "leaf long, level long, sibling string, side string")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 10 = 4")
def content_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some contents changed since they were hashed, others gone."""
    hashed = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"), F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 10 != 4, F.col("text")).alias("text"))
    return merkle.mismatches(hashed, "h", "text").select("doc_id")


_MANIFEST = "m AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE doc_id % 7 > 0), st AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 11 > 0)"


@query(f"WITH {_MANIFEST} SELECT h, 'missing' AS issue FROM m WHERE h NOT IN (SELECT h FROM st) GROUP BY 1 UNION ALL SELECT h, 'duplicate' FROM m GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT h, 'orphaned' FROM st WHERE h NOT IN (SELECT h FROM m)")
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    return checks.consistency(keyed.where("doc_id % 7 > 0").select("h"), keyed.where("doc_id % 11 > 0").select("h").distinct(), "h")


@query(f"WITH s AS ({SIMPLE_SELECT}), d AS (SELECT s.doc_id, reference_id, n_chars FROM s JOIN documents USING (doc_id) WHERE role = 'child'), live AS (SELECT doc_id FROM s WHERE role = 'reference' AND doc_id % 5 > 0) SELECT count(*) AS n_deleted, coalesce(sum(n_chars), 0)::BIGINT AS bytes_freed, (SELECT count(*) FROM d) - count(*) AS n_kept FROM d WHERE reference_id NOT IN (SELECT doc_id FROM live)")
def delta_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas whose reference is gone."""
    found = stash(simple_select(spark, sf_dir), "selection")
    deltas = found.where("role = 'child'").join(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    live = found.where("role = 'reference' and doc_id % 5 > 0").select(F.col("doc_id").alias("reference_id"))
    return checks.garbage(deltas, live, "reference_id", "n_chars")


@query(f"WITH s AS ({SIMPLE_SELECT}) SELECT error, count(*) AS n FROM (SELECT CASE WHEN c.reference_id % 6 = 0 THEN 'reference missing' WHEN c.doc_id % 6 = 1 THEN 'lost' END AS error FROM s c WHERE c.role = 'child') WHERE error IS NOT NULL GROUP BY 1")
def reduction_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every input row has to be a reference, a child of one, or discarded."""
    whole = simple_select(spark, sf_dir)
    damaged = whole.where("not (role = 'child' and doc_id % 6 = 1 and reference_id % 6 <> 0) and not (role = 'reference' and doc_id % 6 = 0)")
    lost = checks.reduction_errors(docs(spark, sf_dir).join(whole.where("role = 'reference' and doc_id % 6 = 0").select("doc_id"), "doc_id", "left_anti"), damaged, "doc_id")
    return lost.groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, CASE WHEN o_totalprice < 2000 THEN 'size' WHEN o_orderstatus = 'P' THEN 'incomplete' END AS error, CASE WHEN o_totalprice < 2000 THEN 'fetch again' WHEN o_orderstatus = 'P' THEN 'resume' END AS recovery FROM orders WHERE o_totalprice < 2000 OR o_orderstatus = 'P'")
def state_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("size", F.col("o_totalprice") < 2000, "fetch again"), ("incomplete", F.col("o_orderstatus") == "P", "resume")]
    return checks.broken(table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")), rules).select("k", "error", "recovery")


# ---- databases and versions ---------------------------------------------------------------------------

_TWO = "k AS (SELECT sha256(text) AS h, lang, n_chars, regexp_extract(source, '(\\d+)', 1)::INT AS s FROM documents), a AS (SELECT * FROM k WHERE s % 2 = 0 AND lang <> 'es'), b AS (SELECT * FROM k WHERE s < 10 AND lang <> 'fr')"


@query(f"WITH {_TWO} SELECT side, n, total_length, avg_length, n_taxa, taxa FROM (SELECT 'old' AS side, count(*) AS n, sum(n_chars)::BIGINT AS total_length, sum(n_chars)::BIGINT // count(*) AS avg_length, count(DISTINCT lang) AS n_taxa, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM a WHERE lang NOT IN (SELECT lang FROM b)) AS taxa FROM a UNION ALL SELECT 'new', count(*), sum(n_chars)::BIGINT, sum(n_chars)::BIGINT // count(*), count(DISTINCT lang), (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM b WHERE lang NOT IN (SELECT lang FROM a)) FROM b)")
def database_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and taxa of two databases; of the old one the taxa that went, of the new one those that came."""
    keyed = docs(spark, sf_dir).select("lang", "n_chars", F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("s"))
    return D.collection_stats(keyed.where("s % 2 = 0 and lang <> 'es'"), keyed.where("s < 10 and lang <> 'fr'"), "n_chars", "lang")


@query(f"WITH {_TWO} SELECT h, 'send' AS step FROM a WHERE h NOT IN (SELECT h FROM b) GROUP BY 1 UNION ALL SELECT h, 'fetch' FROM b WHERE h NOT IN (SELECT h FROM a) GROUP BY 1")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = docs(spark, sf_dir).select("lang", F.sha2("text", 256).alias("h"), F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("s"))
    return D.sync_plan(keyed.where("s % 2 = 0 and lang <> 'es'"), keyed.where("s < 10 and lang <> 'fr'"), "h")


_OLD_NEW = "o AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)"


@query(f"WITH {_OLD_NEW}, x AS (SELECT coalesce(o.k, n.k) AS k, o.v AS ov, n.v AS nv FROM o FULL JOIN n ON o.k = n.k) SELECT k, CASE WHEN ov IS NULL THEN 'add' WHEN nv IS NULL THEN 'remove' ELSE 'replace' END AS step, CASE WHEN ov IS NULL THEN 'remove' WHEN nv IS NULL THEN 'add' ELSE 'replace' END AS undo, CASE WHEN ov IS NULL THEN 1 WHEN nv IS NULL THEN 3 ELSE 2 END AS place FROM x WHERE ov IS DISTINCT FROM nv")
def migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.plans.collection import _versions

    return D.migration(*_versions(spark, sf_dir), "k", "v")


@query("SELECT user_id, ts, event_type FROM (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log to which records came in two batches, the later ones first; of records of one id and time the last written
    counts; read between two times."""
    events = table(spark, sf_dir, "events")
    late = events.select("user_id", "ts", "event_type", F.col("event_id").alias("written"))
    log = temporal.append_history(temporal.append_history(None, late.where("ts >= timestamp_ntz'2024-01-07'")), late.where("ts < timestamp_ntz'2024-01-07'"))
    return temporal.history_between(log, ["user_id", "ts"], "ts", "written", F.expr("timestamp_ntz'2024-01-05'"), F.expr("timestamp_ntz'2024-01-09'")).select("user_id", "ts", "event_type")


@query("WITH d AS (SELECT o_orderkey % 40 AS chunk, max(o_orderdate) AS at_ FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT 40::BIGINT AS n_all, count(*) AS n_done, round(100.0 * count(*) / 40, 4)::DOUBLE AS percent, max(at_) < TIMESTAMP '1999-01-01' AS is_expired, true AS can_resume FROM d")
def operation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a job over 40 chunks has come, and whether it may go on: the manifest is the same."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy((F.col("o_orderkey") % 40).alias("chunk")).agg(F.max("o_orderdate").alias("at"))
    return checks.progress(done, 40, "at", F.expr("timestamp_ntz'1999-01-01'"), ("hash", "v1"), ("hash", "v1"))


# ---- trees and clusters -------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_PATHS}, q AS (SELECT 's:' || s_suppkey AS a, 'c:' || s_suppkey AS b FROM supplier), m AS (SELECT a, b, min_by(x.ancestor, (x.hops + y.hops, x.ancestor)) AS top FROM q JOIN p x ON x.node = a JOIN p y ON y.node = b AND y.ancestor = x.ancestor GROUP BY 1, 2) SELECT a, b, t.rank AS common_rank, t.rank = 'nation' AS is_close FROM m JOIN t ON t.node = top")
def common_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest rank that two taxa share, and whether it is the one of close kin."""
    return taxonomy.common_rank(paths(spark, sf_dir), tree(spark, sf_dir), history._pairs(spark, sf_dir), "nation")


@query(f"WITH {_TREE} SELECT node FROM t WHERE rank = 'nation'")
def taxa_at_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.at_rank(tree(spark, sf_dir), "nation")


@query("WITH w(wanted) AS (VALUES ('FRANCE'), ('nation_1'), ('NATION_11'), ('nothing')), m AS (SELECT wanted, n_nationkey AS node, n_name AS name, row_number() OVER (PARTITION BY wanted ORDER BY lower(n_name) <> lower(wanted), n_nationkey) AS k FROM w JOIN nation ON contains(lower(n_name), lower(wanted))) SELECT wanted, node, name FROM m WHERE k = 1")
def taxon_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))
    out = None
    for wanted in ("FRANCE", "nation_1", "NATION_11", "nothing"):
        one = taxonomy.by_name(names, wanted).select(F.lit(wanted).alias("wanted"), "node", "name")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH RECURSIVE {_PATHS}, o AS (SELECT 'c:' || o_custkey AS node, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT p.ancestor, coalesce(sum(n), 0)::BIGINT AS total FROM p LEFT JOIN o ON o.node = p.node GROUP BY 1), d AS (SELECT node, max(hops) AS depth FROM p GROUP BY 1) SELECT repeat('  ', depth::INT) || d.node || ' (' || total || ')' AS line FROM d JOIN r ON r.ancestor = d.node WHERE depth <= 2")
def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree to the depth of nations, as lines with cumulative counts."""
    lines = paths(spark, sf_dir)
    totals = taxonomy.rollup(lines, history._counts(spark, sf_dir)).select(F.col("ancestor").alias("node"), "total")
    depth = lines.groupBy("node").agg(F.max("hops").alias("depth")).where("depth <= 2")
    return reports.tree_lines(depth.join(totals, "node"), "depth", "node", "total")


_KIN = "q AS (SELECT 'n:' || x.n_nationkey AS a, 'n:' || y.n_nationkey AS b, x.n_regionkey AS cluster FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey)"
_KIN_DISTANCE = f"{_PATHS}, {_KIN}, m AS (SELECT a, b, cluster, min(x.hops + y.hops) AS hops FROM q JOIN p x ON x.node = a JOIN p y ON y.node = b AND y.ancestor = x.ancestor GROUP BY ALL), d AS (SELECT node, count(*) AS size FROM p GROUP BY 1), z AS (SELECT m.*, round(least(1.0, hops / (2.0 * greatest(u.size, v.size))), 6) AS distance FROM m JOIN d u ON u.node = a JOIN d v ON v.node = b)"


def _kin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node"), "n_nationkey", F.col("n_regionkey").alias("cluster"))
    pairs = nation.alias("x").join(nation.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey")))
    named = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.cluster").alias("cluster"))
    return named, taxonomy.pair_distances(paths(spark, sf_dir), named)


@query(f"WITH RECURSIVE {_KIN_DISTANCE} SELECT cluster, count(*) AS n_pairs, round(avg(distance), 6) AS diversity FROM z GROUP BY 1")
def cluster_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, distances = _kin(spark, sf_dir)
    return clades.diversity(distances.join(named, ["a", "b"]), "cluster")


@query(f"WITH RECURSIVE {_KIN_DISTANCE} SELECT a, b, CASE WHEN a IN ('n:3', 'n:4') OR b IN ('n:3', 'n:4') THEN false ELSE distance <= 0.4 END AS together FROM z")
def cluster_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clades.may_cluster(_kin(spark, sf_dir)[1], ["n:3", "n:4"], 0.4).select("a", "b", "together")


@query("WITH n AS (SELECT c_nationkey AS taxon, count(*) AS n FROM customer GROUP BY 1) SELECT taxon, (n * CASE WHEN taxon IN (1, 2, 3) THEN 10 ELSE 1 END * CASE WHEN taxon IN (3, 4) THEN 100 ELSE 1 END)::DOUBLE AS priority, taxon IN (1, 2, 3, 4) AS is_anchor FROM n")
def taxon_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("taxon")).agg(F.count("*").alias("n"))
    return n.select("taxon", clades.priority(F.col("taxon"), F.col("n"), [1, 2, 3], [3, 4]).alias("priority"), F.col("taxon").isin(1, 2, 3, 4).alias("is_anchor"))


@query("WITH g AS (SELECT n_regionkey, count(*) AS n, count(DISTINCT CASE WHEN n_nationkey < 8 THEN n_nationkey END) AS i FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), m AS (SELECT min(n) + 1 AS lo, max(n) - 1 AS hi FROM g) SELECT n_regionkey, CASE WHEN n < lo THEN 'too small' WHEN n > hi THEN 'too large' WHEN i > 1 THEN 'isolated taxa together' END AS error FROM g, m WHERE n < lo OR n > hi OR i > 1")
def cluster_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(table(spark, sf_dir, "nation"), "n_nationkey")
    low, high = n.groupBy("n_regionkey").agg(F.sum("n").alias("k")).agg(F.min("k"), F.max("k")).first()
    return clades.cluster_errors(n, "n_regionkey", "n_nationkey", "n", list(range(8)), low + 1, high - 1)


# ---- processors ---------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT * FROM documents WHERE length(text) >= 200), b AS (SELECT * FROM a WHERE lang <> 'es')
SELECT 'long enough' AS step, (SELECT count(*) FROM documents) AS n_in, (SELECT count(*) FROM a) AS n_out UNION ALL SELECT 'language', (SELECT count(*) FROM a), (SELECT count(*) FROM b) UNION ALL SELECT 'upper case', (SELECT count(*) FROM b), (SELECT count(*) FROM b) UNION ALL SELECT 'taxon', (SELECT count(*) FROM b), (SELECT count(*) FROM b)""")
def processor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, a transform and an enrichment in order, counted in the one pass."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    line = processors.Pipeline()
    line.filter("long enough", F.length("text") >= 200).filter("language", F.col("lang") != "es")
    line.transform("upper case", "text", F.upper("text")).enrich("taxon", lambda df: df.join(labels, "doc_id", "left"))
    done = line.run(docs(spark, sf_dir))
    done.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(line.counts(), "step string, n_in long, n_out long")


# ---- edits --------------------------------------------------------------------------------------------

_PAIR = "w AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) || 'ACDEFGHIKLMNPQRSTVWY' AS a FROM part), v AS (SELECT *, substr(a, 1, 4) || '#' || substr(a, 6) AS b, substr(a, 1, 10) || '#%&' || substr(a, 14) AS c FROM w)"


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter changed in b, three in c."""
    a = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit("ACDEFGHIKLMNPQRSTVWY"))
    b, c = F.expr("concat(substr(a, 1, 4), '#', substr(a, 6))"), F.expr("concat(substr(a, 1, 10), '#%&', substr(a, 14))")
    dealt = table(spark, sf_dir, "part").select("p_partkey", a.alias("a")).repartition("p_partkey")  # a small file may be few tasks
    return dealt.withColumn("b", b).withColumn("c", c)


@query(f"WITH {_PAIR} SELECT p_partkey, '4:' || substr(a, 5, 1) || '>#' AS changed, sha256(b) AS decoded_sha256, round((length(a) - 1) / length(a), 6) AS identity FROM v")
def substitution_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences of the best alignment by protein scores, and the second text made of the first by them."""
    from lociq.operators.align import ALIGNERS, alignment_identity, apply_edits

    found = _edited(spark, sf_dir).withColumn("e", ALIGNERS["best"]("a", "b"))
    told = F.array_join(F.transform("e", lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["old"], F.lit(">"), x["new"])), ",")
    return found.select("p_partkey", told.alias("changed"), F.sha2(apply_edits(F.col("a"), F.col("e")), 256).alias("decoded_sha256"), F.round(alignment_identity("a", "b"), 6).alias("identity"))


@query(f"WITH {_PAIR} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN substr(a, 3, 6) WHEN 1 THEN 'new' WHEN 2 THEN b END AS decoded FROM v")
def operation_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored operations of four kinds; the sequence of the last is gone."""
    from lociq.operators.align import decode_operation, edits

    kinds = F.get(F.array(*(F.lit(k) for k in ("use", "insert", "modify", "delete"))), (F.col("p_partkey") % 4).cast("int"))
    found = _edited(spark, sf_dir).withColumn("e", edits(F.when(kinds == "modify", F.col("a")), F.col("b")))
    return found.select("p_partkey", decode_operation(kinds, F.col("a"), F.lit(2), F.lit(6), F.lit("new"), F.col("e")).alias("decoded"))


@query(f"WITH {_PAIR} SELECT p_partkey, 51::BIGINT AS cost, 51 < 0.8 * length(c) AS is_stored, sha256(c) AS decoded_sha256 FROM v")
def banded_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy, an insert, a skip and a copy, decoded again."""
    from lociq.operators.align import apply_banded, banded, worth_storing

    found = _edited(spark, sf_dir).withColumn("d", banded("a", "c"))
    return found.select("p_partkey", F.col("d.cost").alias("cost"), worth_storing(F.col("d.cost"), F.col("c")).alias("is_stored"), F.sha2(apply_banded(F.col("a"), F.col("d.ops")), 256).alias("decoded_sha256"))


# ---- clusters, files and metrics ----------------------------------------------------------------------


@query("""WITH n AS (SELECT 'n:' || c_nationkey AS node, n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), m AS (SELECT *, n >= (SELECT avg(n) FROM n) OR node = 'n:0' AS a FROM n), b AS (SELECT r, min(node) AS to_ FROM m WHERE a GROUP BY r),
w AS (SELECT m.*, b.to_, sum(m.n) OVER (PARTITION BY b.to_ ORDER BY m.node) AS held FROM m LEFT JOIN b USING (r) WHERE NOT a)
SELECT node, node AS cluster FROM m WHERE a UNION ALL SELECT w.node, CASE WHEN w.to_ IS NOT NULL AND o.n + held <= 4 * (SELECT avg(n) FROM n) THEN w.to_ ELSE w.node END FROM w LEFT JOIN m o ON o.node = w.to_""")
def anchored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with many customers, and those near them."""
    n = stash(table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("node")).agg(F.count("*").alias("n")), "counts")
    mean = n.agg(F.avg("n")).first()[0]
    nations = tree(spark, sf_dir).where("rank in ('root', 'region', 'nation')")
    return clades.attached(n, taxonomy.closure(nations, "node", "parent"), ["n:0"], mean, 4 * mean, 0.4)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'zstd' WHEN 1 THEN 'gzip' WHEN 2 THEN 'parquet' ELSE 'plain' END AS codec FROM part")
def chunk_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.get(F.array(*(F.lit(h) for h in ("28B52FFD", "1F8B", "50415231", "00"))), (F.col("p_partkey") % 4).cast("int"))
    content = F.concat(F.unhex(head), F.encode("p_name", "utf-8"))
    return table(spark, sf_dir, "part").select("p_partkey", checks.codec_of(content).alias("codec"))


@query("SELECT 1::BIGINT AS n_files, count(*) AS n_rows, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS total FROM orders")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of forty files as one."""
    from lociq import storage

    small, large = storage.scratch(spark, "small"), storage.scratch(spark, "large")
    table(spark, sf_dir, "orders").repartition(40).write.parquet(small)
    storage.compact(spark, small, large, one_file=True)
    n = storage.files(spark, large, "*.parquet").agg(F.count("*").alias("n_files"))
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(28,10)")), 2).cast("double")  # sums of doubles depend on their order
    return n.crossJoin(spark.read.parquet(large).agg(F.count("*").alias("n_rows"), total.alias("total")))  # one row each


@query("WITH c AS (SELECT sha256(text) AS h, count(*) AS k, max(n_chars) AS s, bool_or(lang = 'en') AS c FROM documents GROUP BY 1), m AS (SELECT sum(k)::BIGINT AS n_chunks, sum(s)::BIGINT AS total_size, sum(s * (k - 1))::BIGINT AS dedup_savings, sum(CASE WHEN NOT c AND s > 1024 THEN s - s // 3 ELSE 0 END)::BIGINT AS compression_savings FROM c) SELECT *, concat_ws(',', CASE WHEN dedup_savings > 1000000 THEN 'deduplication' END, CASE WHEN compression_savings > 5000000 THEN 'compression' END) AS recommended FROM m")
def storage_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.sha2("text", 256).alias("h"), "n_chars", (F.col("lang") == "en").alias("c"))
    return checks.storage_analysis(rows, "h", "n_chars", "c")


@query("WITH s AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_seconds, round(avg((user_id % 3 = 0)::INT), 6) AS hit_rate FROM events GROUP BY 1) SELECT *, CASE WHEN mean_seconds > 50 THEN 'latency' WHEN hit_rate < 0.5 THEN 'misses' END AS bottleneck FROM s")
def throughput_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.throughput(table(spark, sf_dir, "events"), "event_type", "value", F.col("user_id") % 3 == 0, 50.0)


@query("SELECT 'part-' || o_orderstatus AS name, true AS has_rows FROM orders GROUP BY 1")
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a store by folder, without reading them."""
    from lociq import storage

    folder = storage.scratch(spark, "store")
    table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("part-"), "o_orderstatus").alias("name")).write.partitionBy("name").parquet(folder)
    found = storage.files(spark, folder, "*.parquet")
    return found.groupBy(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name")).agg((F.sum("length") > 0).alias("has_rows"))
