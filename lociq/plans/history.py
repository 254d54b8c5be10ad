"""Queries over trees and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import dedup, taxonomy
from lociq.operators import temporal as T
from lociq.plans.registry import query
from lociq.session import table

_TREE = """t(node, parent, rank) AS (SELECT 'root', NULL, 'root' UNION ALL SELECT 'r:' || r_regionkey, 'root', 'region' FROM region UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'nation' FROM nation
 UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'customer' FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'supplier' FROM supplier)"""
_PATHS = _TREE + ", p(node, ancestor, hops) AS (SELECT node, node, 0 FROM t UNION ALL SELECT p.node, t.parent, p.hops + 1 FROM p JOIN t ON t.node = p.ancestor WHERE t.parent IS NOT NULL)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, regions, nations, customers and suppliers as (node, parent, rank)."""
    part = lambda name, tag, key, up, parent, rank: table(spark, sf_dir, name).select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("node"), (F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(up)).alias("parent"), F.lit(rank).alias("rank"))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("root").alias("rank"))
    return root.unionByName(part("region", "r:", "r_regionkey", "root", None, "region")).unionByName(part("nation", "n:", "n_nationkey", "r:", "n_regionkey", "nation")).unionByName(part("customer", "c:", "c_custkey", "n:", "c_nationkey", "customer")).unionByName(part("supplier", "s:", "s_suppkey", "n:", "s_nationkey", "supplier"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.closure(tree(spark, sf_dir), "node", "parent")


@query(f"WITH RECURSIVE {_PATHS} SELECT node, count(*) - 1 AS depth, string_agg(ancestor, '/' ORDER BY hops DESC) AS lineage FROM p GROUP BY node")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.lineage(paths(spark, sf_dir))


@query(f"WITH RECURSIVE {_PATHS} SELECT node, hops FROM p WHERE ancestor = 'r:1'")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.descendants(paths(spark, sf_dir), F.lit("r:1"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier and the customer of the same number."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("c:"), F.col("s_suppkey").cast("string")).alias("b"))


_LCA = _PATHS + ", q AS (SELECT 's:' || s_suppkey AS a, 'c:' || s_suppkey AS b FROM supplier), m AS (SELECT a, b, x.ancestor, x.hops + y.hops AS hops, row_number() OVER (PARTITION BY a, b ORDER BY x.hops + y.hops, x.ancestor) AS k FROM q JOIN p x ON x.node = a JOIN p y ON y.node = b AND y.ancestor = x.ancestor), d AS (SELECT node, count(*) AS size FROM p GROUP BY 1)"


@query(f"WITH RECURSIVE {_LCA} SELECT m.a, m.b, ancestor AS lca, hops::BIGINT AS hops, round(least(1.0, hops / (2.0 * greatest(x.size, y.size))), 6) AS distance FROM m JOIN d x ON x.node = a JOIN d y ON y.node = b WHERE k = 1")
def lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.pair_distances(paths(spark, sf_dir), _pairs(spark, sf_dir))


@query(f"WITH RECURSIVE {_LCA} SELECT hops::BIGINT AS hops, count(*) AS n, round(avg(round(least(1.0, hops / (2.0 * greatest(x.size, y.size))), 6)), 6) AS mean_distance FROM m JOIN d x ON x.node = a JOIN d y ON y.node = b WHERE k = 1 GROUP BY 1")
def phylo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taxonomy.pair_distances(paths(spark, sf_dir), _pairs(spark, sf_dir))
    return found.groupBy("hops").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query(f"WITH RECURSIVE {_PATHS} SELECT p.node, p.ancestor FROM p JOIN t ON t.node = p.ancestor WHERE t.rank = 'region'")
def ancestor_at_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.ancestor_at_rank(paths(spark, sf_dir), tree(spark, sf_dir), "region")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("node")).agg(F.count("*").alias("n"))


_N = ", o AS (SELECT 'c:' || o_custkey AS node, count(*) AS n FROM orders GROUP BY 1)"


@query(f"WITH RECURSIVE {_PATHS}{_N} SELECT t.rank, count(DISTINCT p.ancestor) AS n_taxa, sum(o.n)::BIGINT AS n_sequences, round(100.0 * sum(o.n) / (SELECT sum(n) FROM o), 4) AS percent FROM o JOIN p ON p.node = o.node JOIN t ON t.node = p.ancestor GROUP BY t.rank")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.coverage(paths(spark, sf_dir), _counts(spark, sf_dir), tree(spark, sf_dir))


@query(f"WITH RECURSIVE {_PATHS}{_N} SELECT p.ancestor, coalesce(sum(CASE WHEN hops = 0 THEN n END), 0)::BIGINT AS own, coalesce(sum(n), 0)::BIGINT AS total FROM p LEFT JOIN o ON o.node = p.node GROUP BY 1")
def tree_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.rollup(paths(spark, sf_dir), _counts(spark, sf_dir))


@query(f"""WITH {_TREE}, n AS (SELECT node, CASE WHEN parent = 'n:3' THEN 'n:4' WHEN node = 'c:10' THEN 'n:9' ELSE parent END AS parent FROM t WHERE node <> 'n:3' AND node <> 'c:11' UNION ALL SELECT 'n:99', 'r:1'),
b AS (SELECT coalesce(t.node, n.node) AS node, t.parent AS old_parent, n.parent AS new_parent, t.node IS NULL AS is_new, n.node IS NULL AS is_gone FROM t FULL JOIN n ON t.node = n.node),
f AS (SELECT *, CASE WHEN is_new THEN 'New' WHEN is_gone THEN 'Deprecated' WHEN old_parent IS DISTINCT FROM new_parent THEN 'Reparented' END AS change FROM b), i AS (SELECT old_parent AS node, count(DISTINCT new_parent) AS k, min(new_parent) AS into_ FROM f WHERE change = 'Reparented' GROUP BY 1)
SELECT f.node, f.old_parent, CASE WHEN change = 'Deprecated' AND k = 1 THEN into_ ELSE f.new_parent END AS new_parent, CASE WHEN change = 'Deprecated' AND k = 1 THEN 'Merged' ELSE change END AS change FROM f LEFT JOIN i ON i.node = f.node WHERE change IS NOT NULL""")
def taxonomy_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tree(spark, sf_dir).select("node", "parent")
    moved = F.when(F.col("parent") == "n:3", "n:4").when(F.col("node") == "c:10", "n:9").otherwise(F.col("parent"))
    new = old.where("node not in ('n:3', 'c:11')").withColumn("parent", moved).unionByName(spark.range(1).select(F.lit("n:99").alias("node"), F.lit("r:1").alias("parent")))
    return taxonomy.tree_diff(old, new)


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), r AS (SELECT l_orderkey, CASE WHEN l_suppkey % 10 = 0 THEN l_suppkey + 1000 ELSE l_suppkey END AS t FROM m)
SELECT l_orderkey, string_agg(DISTINCT t::VARCHAR, ',' ORDER BY t::VARCHAR) AS taxa FROM r GROUP BY 1""")
def taxonomy_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    mapping = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1000).alias("new"))
    found = taxonomy.remap(members, mapping, "l_orderkey", "l_suppkey")
    return found.select("l_orderkey", F.array_join(F.array_sort(F.split("taxa", ",")), ",").alias("taxa"))


# ---- timelines ----------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT o_orderdate AS t, max(o_orderkey) AS v FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, v.v AS asof_value, v.t AS asof_time FROM lineitem ASOF LEFT JOIN v ON lineitem.l_shipdate >= v.t""")
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return T.asof(queries, table(spark, sf_dir, "orders"), "l_shipdate", "o_orderdate", "o_orderkey").drop("l_shipdate")


@query("""WITH s AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE k = 1),
x AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-20') WHERE k = 1)
SELECT s.user_id, s.event_type AS seq_value, x.event_type AS tax_value FROM s JOIN x USING (user_id)""")
def bitemporal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = lambda day, name: T.snapshot(events, "user_id", "ts", F.expr(f"timestamp_ntz'{day}'"), "event_type").withColumnRenamed("event_type", name)
    return at("2024-01-15", "seq_value").join(at("2024-01-20", "tax_value"), "user_id")


@query("WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) SELECT day, n, lag(day) OVER (ORDER BY day) AS parent_time, n - coalesce(lag(n) OVER (ORDER BY day), 0) AS count_delta FROM d")
def version_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return T.lineage_of_versions(days, "day", "n")


@query("SELECT o_orderdate AS time, 'order' AS kind FROM orders UNION ALL SELECT l_shipdate, 'ship' FROM lineitem UNION ALL SELECT ts, 'event' FROM events")
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.timeline((table(spark, sf_dir, "orders"), "o_orderdate", "order"), (table(spark, sf_dir, "lineitem"), "l_shipdate", "ship"), (table(spark, sf_dir, "events"), "ts", "event"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def prune_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.prune(table(spark, sf_dir, "orders"), "o_orderdate", F.expr("timestamp_ntz'1997-01-01'")).select("o_orderkey", "o_orderdate")


_AT = "WITH a AS (SELECT user_id, max_by(event_type, (ts, event_type)) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT user_id, max_by(event_type, (ts, event_type)) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-25' GROUP BY 1)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    at = lambda day: T.snapshot(events, "user_id", "ts", F.expr(f"timestamp_ntz'{day}'"), "event_type")
    return at("2024-01-10"), at("2024-01-25")


@query(_AT + " SELECT a.v AS old_value, b.v AS new_value, count(*) AS n FROM a JOIN b USING (user_id) WHERE a.v IS DISTINCT FROM b.v GROUP BY 1, 2")
def temporal_join_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.temporal_join(*_snapshots(spark, sf_dir), "user_id", "event_type")


@query(_AT + " SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS old_value, b.v AS new_value, CASE WHEN a.user_id IS NULL THEN 'Added' WHEN b.user_id IS NULL THEN 'Removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'Unchanged' ELSE 'Modified' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id")
def temporal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.operators.diff import compare

    return compare(*_snapshots(spark, sf_dir), "user_id", "event_type")


_LAG = "w AS (SELECT user_id, ts, event_type, event_id, lag(event_type) OVER o AS prev, row_number() OVER o AS k FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_type))"


@query(f"WITH {_LAG} SELECT user_id, ts, prev AS old_value, event_type AS new_value, CASE WHEN k = 1 THEN 'Created' ELSE 'Reclassified' END AS change FROM w WHERE k = 1 OR prev IS DISTINCT FROM event_type")
def evolution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.changes(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@query(f"WITH {_LAG}, c AS (SELECT * FROM w WHERE k = 1 OR prev IS DISTINCT FROM event_type) SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS valid_to FROM c")
def scd2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.intervals(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@query(f"WITH {_LAG}, c AS (SELECT * FROM w WHERE k = 1 OR prev IS DISTINCT FROM event_type), s AS (SELECT user_id, event_type, ts AS f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS t FROM c), q AS (SELECT user_id, TIMESTAMP '2024-01-05' + INTERVAL (d) DAY AS at_ FROM (SELECT DISTINCT user_id FROM events), range(0, 20, 5) g(d)) SELECT q.user_id, at_ AS time, event_type FROM q JOIN s ON s.user_id = q.user_id AND f <= at_ AND (t IS NULL OR at_ < t)")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    days = F.explode(F.array(*(F.expr(f"timestamp_ntz'2024-01-{day:02d}'") for day in (5, 10, 15, 20))))
    queries = events.select("user_id").distinct().select("user_id", days.alias("time"))
    return T.valid_at(T.intervals(events, "user_id", "ts", "event_type"), queries, "user_id", "time").select("user_id", "time", "event_type")


@query("""WITH p AS (SELECT DISTINCT ts::DATE AS period, user_id FROM events), n AS (SELECT period, row_number() OVER (ORDER BY period) AS k FROM (SELECT DISTINCT period FROM p)), m AS (SELECT k, user_id FROM p JOIN n USING (period))
SELECT n.period, (SELECT count(*) FROM m WHERE m.k = n.k) AS n_members, (SELECT count(*) FROM m WHERE m.k = n.k AND NOT EXISTS (SELECT 1 FROM m x WHERE x.k = n.k - 1 AND x.user_id = m.user_id)) AS n_added,
 (SELECT count(*) FROM m WHERE m.k = n.k - 1 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.k = n.k AND x.user_id = m.user_id)) AS n_removed FROM n""")
def turnover_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.turnover(table(spark, sf_dir, "events"), F.col("ts").cast("date"), "user_id")


@query(f"WITH {_LAG} SELECT ts::DATE AS period, prev AS old_value, event_type AS new_value, count(*) AS n FROM w WHERE k > 1 AND prev IS DISTINCT FROM event_type GROUP BY ALL HAVING count(*) >= 5")
def mass_reclassification(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = T.changes(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")
    return T.mass_changes(changed, F.col("ts").cast("date"), 5)


_THREE = """s AS (SELECT l_orderkey, min(l_linestatus) AS mapped, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS inferred FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS parsed, mapped, inferred FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
d AS (SELECT *, CASE WHEN parsed IS NULL AND mapped IS NULL AND inferred IS NULL THEN 'Missing' WHEN parsed <> mapped THEN 'Conflict' WHEN mapped <> inferred THEN 'Outdated' WHEN parsed <> inferred THEN 'Mismatch' END AS kind FROM x)"""


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.functions.headers import discrepancy

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("mapped"), F.when(F.count_distinct("l_linestatus") == 1, F.min("l_linestatus")).alias("inferred"))
    parsed = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", parsed.alias("parsed")).join(lines, "o_orderkey", "left")
    return joined.withColumn("kind", discrepancy(F.col("parsed"), F.col("mapped"), F.col("inferred")))


@query(f"WITH {_THREE} SELECT o_orderkey, parsed, mapped, inferred, kind FROM d WHERE kind IS NOT NULL")
def discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).where("kind is not null")


@query(f"WITH {_THREE} SELECT kind, least(parsed, mapped) AS a, greatest(parsed, mapped) AS b, count(*) AS n FROM d WHERE kind IS NOT NULL GROUP BY ALL")
def discrepancy_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).where("kind is not null").groupBy("kind", F.least("parsed", "mapped").alias("a"), F.greatest("parsed", "mapped").alias("b")).agg(F.count("*").alias("n"))


@query(f"WITH {_THREE} SELECT o_orderkey, coalesce(mapped, parsed, inferred) AS chosen, CASE WHEN parsed IS NULL AND mapped IS NULL AND inferred IS NULL THEN 'None' WHEN len(list_distinct(list_filter([parsed, mapped, inferred], lambda v: v IS NOT NULL))) = 1 THEN 'Unanimous' ELSE 'Conflicted' END AS resolution FROM d")
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.functions.headers import priority_taxon, resolution

    none = F.lit(None).cast("string")
    rows = _three(spark, sf_dir)
    return rows.select("o_orderkey", priority_taxon(none, none, F.col("mapped"), F.col("parsed"), F.col("inferred")).alias("chosen"), resolution(F.col("parsed"), F.col("mapped"), F.col("inferred")).alias("resolution"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 3")
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(order)).where("k <= 3").select("user_id", "event_id", "ts")


@query("SELECT min(o_orderdate) AS oldest, max(o_orderdate) AS newest, count(DISTINCT o_orderdate) AS n_versions, date_diff('day', min(o_orderdate), max(o_orderdate)) AS age_days FROM orders")
def temporal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"), F.count_distinct("o_orderdate").alias("n_versions"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("age_days"))


@query("WITH a AS (SELECT DISTINCT c_nationkey AS k, 'customer' AS src FROM customer), b AS (SELECT DISTINCT s_nationkey AS k, 'supplier' AS src FROM supplier) SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)")
def union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("k")).distinct().withColumn("src", F.lit(name))
    return dedup.union_first(part("customer", "c_nationkey"), part("supplier", "s_nationkey"), "k")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
