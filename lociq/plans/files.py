"""Queries over files: each writes the driver's rows in a format and gives what the reader makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq import storage
from lociq.operators import reports
from lociq.plans.collection import docs
from lociq.plans.registry import query
from lociq.session import table
from lociq.sources import fasta, tables
from lociq.streaming import ingest

_BODY = "repeat(upper(replace(p_name, ' ', '')), 9)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (id, description, sequence, taxon_id) of the parts."""
    body = F.repeat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit(9))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("description"), body.alias("sequence"), F.col("p_size").cast("long").alias("taxon_id"))


def _text(spark: SparkSession, line: DataFrame, name: str, **options: str) -> str:
    path = storage.scratch(spark, name)
    line.write.options(**options).text(path)
    return path


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


_PARTS = f"SELECT 'p' || p_partkey AS id, p_name || ' TaxID=' || p_size AS description, {_BODY} AS sequence, p_size::BIGINT AS taxon_id FROM part"


@query(_PARTS)
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with lines of 80 letters, and read in parallel, split at the records."""
    path = storage.scratch(spark, "fasta")
    fasta.write_sequences(_parts(spark, sf_dir), path)
    return fasta.read_fasta(spark, path)


@query(_PARTS)
def fasta_scan_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "fasta-gz")
    fasta.write_sequences(_parts(spark, sf_dir), path, compression="gzip")
    return fasta.read_fasta(spark, path)


@query("""SELECT 'p' || p_partkey || part AS id, CASE WHEN part = 'a' THEN p_name END AS description, CASE WHEN part = 'a' THEN 'ACGT' ELSE 'MKV' END || upper(replace(p_name, ' ', '')) AS sequence, NULL::BIGINT AS taxon_id
FROM part, (VALUES ('a'), ('b')) v(part)""")
def fasta_from_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records in one value of bytes for each part."""
    key, body = F.col("p_partkey").cast("string"), F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    blob = _joined(">p", key, "a ", F.col("p_name"), "\nac gt\n", body, "\n>p", key, "b\r\nMKV\n", body, "\n").cast("binary")
    return fasta.parse_fasta(table(spark, sf_dir, "part").select(blob.alias("blob")), "blob")


@query("SELECT 'q' || p_partkey AS id, p_name || ' TaxID=0 OS=' || p_type || ' OX=' || p_size || ' PE=1 3 SV=1' AS description, 'MIYQACDE' AS sequence, p_size::BIGINT AS taxon_id FROM part")
def fasta_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that go on for two lines, the second of which ends in the body."""
    head = _joined(">q", F.col("p_partkey").cast("string"), " ", F.col("p_name"), " TaxID=0\nOS=", F.col("p_type"), " OX=", F.col("p_size").cast("string"), " PE=1\n3 SV=1MIYQ\nacde")
    return fasta.read_fasta(spark, _text(spark, table(spark, sf_dir, "part").select(head), "broken"))


@query(f"SELECT unnest(string_split('@p' || p_partkey || ' ' || p_name || chr(10) || {_BODY} || chr(10) || '+' || chr(10) || repeat('I', length({_BODY})), chr(10))) AS value FROM part")
def fastq_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "fastq")
    fasta.write_sequences(_parts(spark, sf_dir), path, "fastq")
    return spark.read.text(path)


@query(f"SELECT 'p' || p_partkey || chr(9) || p_name || chr(9) || {_BODY} || chr(9) || p_size AS value FROM part")
def tsv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "tsv")
    fasta.write_sequences(_parts(spark, sf_dir), path, "tsv")
    return spark.read.text(path).where(~F.col("value").startswith("id\t"))


@query(f"""SELECT '{{"id":"p' || p_partkey || '","description":"' || p_name || '","sequence":"' || {_BODY} || '","taxon_id":' || p_size || '}}' AS value FROM part""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "json")
    fasta.write_sequences(_parts(spark, sf_dir), path, "json")
    return spark.read.text(path)


@query("""WITH l AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01' GROUP BY 1)
SELECT unnest(['>c' || o_custkey || ' TaxID=' || c_nationkey, 'ORDER' || last]) AS value FROM l JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT unnest(['; Bi-Temporal Export', '; Sequence Date: 1995-06-01', '; Taxonomy Date: 1996-01-01', '; Sequence Root: s', '; Taxonomy Root: t'])""")
def bitemporal_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order as of a time, under the nations of another, with the preamble."""
    past = table(spark, sf_dir, "orders").where("o_orderdate <= timestamp_ntz'1995-06-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last"))
    named = past.join(table(spark, sf_dir, "customer"), "c_custkey")
    rows = named.select(_joined("c", F.col("c_custkey").cast("string")).alias("id"), F.lit("").alias("description"), _joined("ORDER", F.col("last").cast("string")).alias("sequence"), F.col("c_nationkey").cast("long").alias("taxon_id"))
    path = storage.scratch(spark, "as-of")
    fasta.write_as_of(rows, path, "1995-06-01", "1996-01-01", ("s", "t"))
    return spark.read.text([f"{path}/preamble", f"{path}/fasta"])


@query("SELECT n_nationkey + 100 AS taxon_id, CASE WHEN n_nationkey = 0 THEN NULL ELSE n_regionkey + 200 END::BIGINT AS parent_id, 'nation' AS rank, n_name AS name FROM nation")
def taxonomy_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names.dmp with synonyms and nodes.dmp of the nations; the first is its own parent, a root."""
    nation = table(spark, sf_dir, "nation")
    key = (F.col("n_nationkey") + 100).cast("string")
    parent = F.when(F.col("n_nationkey") == 0, key).otherwise((F.col("n_regionkey") + 200).cast("string"))
    name = lambda text, kind: nation.select(_joined(key, "\t|\t", text, "\t|\t\t|\t", kind, "\t|"))
    names = _text(spark, name(F.col("n_name"), "scientific name").unionAll(name(F.lower("n_name"), "synonym")), "names")
    nodes = _text(spark, nation.select(_joined(key, "\t|\t", parent, "\t|\tnation\t|\t\t|")), "nodes")
    found = tables.read_taxonomy(spark, names, nodes)
    return found.select(F.col("taxon_id").cast("int").alias("taxon_id"), "parent_id", "rank", "name")


@query("SELECT 'A' || s_suppkey AS accession, s_nationkey::BIGINT AS taxon_id FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'A' || s_suppkey, 999 FROM supplier WHERE s_suppkey % 3 = 0")
def mapping_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping with other kinds of lines; what it lacks comes from a second file."""
    s = table(spark, sf_dir, "supplier")
    key = _joined("A", F.col("s_suppkey").cast("string"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "GI").otherwise("NCBI_TaxID")
    first = _text(spark, s.select(F.concat_ws("\t", key, kind, F.col("s_nationkey").cast("string"))), "idmapping")
    second = _text(spark, s.select(F.concat_ws("\t", key, F.lit("NCBI_TaxID"), F.lit("999"))), "idmapping")
    return tables.with_fallback(tables.read_idmapping(spark, first), tables.read_idmapping(spark, second))


@query("SELECT unnest(['A' || s_suppkey, 'A' || s_suppkey || '.2']) AS accession, s_nationkey::BIGINT AS taxon_id FROM supplier")
def accession2taxid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported and read: each accession with and without its version."""
    path = storage.scratch(spark, "accession2taxid")
    rows = table(spark, sf_dir, "supplier").select(_joined("A", F.col("s_suppkey").cast("string")).alias("accession"), F.lit(2).alias("version"), F.col("s_nationkey").alias("taxon_id"))
    tables.write_accession2taxid(rows, path)
    return tables.read_accession2taxid(spark, path)


def _m8(spark: SparkSession, sf_dir: str) -> str:
    line = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    bad = F.when(F.col("l_linenumber") == 3, "x").otherwise(s("l_linenumber"))
    fields = [_joined("q", s("l_orderkey")), _joined("s", s("l_partkey")), (F.col("l_quantity") * 2).cast("int").cast("string"), F.lit("100"), bad, F.lit("1"), F.lit("1"), F.lit("100"), F.lit("5"), F.lit("104"), F.lit("1e-5"), s("l_suppkey")]
    extra = spark.createDataFrame([("# comment",), ("",), ("short\tline",)], "value string")
    return _text(spark, line.select(F.concat_ws("\t", *fields).alias("value")).unionAll(extra), "m8")


@query("""SELECT 'q' || l_orderkey AS "query", 's' || l_partkey AS subject, (l_quantity * 2)::INT / 100.0::DOUBLE AS identity, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_linenumber END::BIGINT AS mismatches, l_suppkey::DOUBLE AS bitscore FROM lineitem""")
def m8_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_m8(spark, _m8(spark, sf_dir)).select("query", "subject", "identity", "mismatches", "bitscore")


@query("""SELECT 'q' || l_orderkey AS "query", 's' || l_partkey AS subject FROM lineitem UNION ALL SELECT 'short', 'line'""")
def m8_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_m8_pairs(spark, _m8(spark, sf_dir))


@query("SELECT 'd' || doc_id AS child_id, lang AS reference_id, n_chars AS taxon_id, 'copy' AS kind, doc_id AS start, '' AS inserted FROM documents UNION ALL SELECT 'd' || doc_id, lang, n_chars, 'insert', 7, text FROM documents")
def delta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas whose inserted texts have every kind of character, written as lines and read back."""
    op = lambda kind, start, text: F.struct(F.lit(kind).alias("kind"), start.alias("start"), start.alias("end"), text.alias("text"))
    ops = F.array(op("copy", F.col("doc_id"), F.lit("")), op("insert", F.lit(7).cast("long"), F.col("text")))
    rows = docs(spark, sf_dir).select(_joined("d", F.col("doc_id").cast("string")).alias("child_id"), F.col("lang").alias("reference_id"), F.col("n_chars").alias("taxon_id"), ops.alias("ops"))
    path = storage.scratch(spark, "deltas")
    tables.write_deltas(rows, path)
    back = tables.read_deltas(spark, path).withColumn("o", F.explode("ops"))
    return back.select("child_id", "reference_id", "taxon_id", F.col("o.kind").alias("kind"), F.col("o.start").alias("start"), F.col("o.text").alias("inserted"))


@query("SELECT 'n' || s_nationkey AS reference, 's' || s_suppkey AS child FROM supplier")
def ref2children_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat_ws("\t", _joined("n", F.col("s_nationkey").cast("string")), F.collect_list(_joined("s", F.col("s_suppkey").cast("string")))).alias("value"))
    return tables.read_ref2children(spark, _text(spark, lines.select("value"), "children"))


@query("SELECT c_custkey AS taxon_id FROM customer UNION ALL SELECT c_nationkey FROM customer")
def taxid_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "customer").select(_joined(F.col("c_custkey").cast("string"), ", ", F.col("c_nationkey").cast("string"), "  # 17 ", F.col("c_name")))
    return tables.read_taxids(spark, _text(spark, lines, "taxids"))


@query("SELECT 'customers,' || r_name || ',' || count(c_custkey) AS line FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name UNION ALL SELECT 'section,r_name,n'")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    counts = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    lines = reports.Report("customers").add("customers", counts).render("csv").splitlines()
    return spark.createDataFrame([(line,) for line in lines], "line string")


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, repeat('#', (n * 40 // max(n) OVER ())::INT) AS bar FROM c")
def bar_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bars(docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")), "lang", "n")


@query("SELECT 'b3' AS restored, n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three backups of which the oldest is purged; the newest is restored."""
    folder, nation = storage.scratch(spark, "backups"), table(spark, sf_dir, "nation")
    for k in (1, 2, 3):
        storage.back_up(nation.where(F.col("n_nationkey") < 5 + 5 * k), folder, f"b{k}")
    storage.purge(spark, folder, 2)
    names = storage.backups(spark, folder)
    return storage.restore(spark, folder).select(F.lit(names[-1] if len(names) == 2 else "none").alias("restored"), "*")


@query(f"SELECT min(id) AS id, sequence, sha256(sequence) AS seq_hash FROM (SELECT 'p' || p_partkey AS id, {_BODY} AS sequence FROM part) GROUP BY 2")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in batches, the first of them twice: each body is stored once."""
    source, parts = storage.scratch(spark, "arrivals"), _parts(spark, sf_dir).withColumn("description", F.lit(""))
    for k in range(2):
        fasta.write_sequences(parts.where(F.crc32("id") % 2 <= k).coalesce(1), f"{source}/{k}")
    target, checkpoint = storage.scratch(spark, "target"), storage.scratch(spark, "offsets")
    for _ in range(2):
        stream = ingest.text_stream(spark, f"{source}/*", 1)
        ingest.ingest(stream, target, checkpoint, "seq_hash").awaitTermination()
    stored = spark.read.parquet(target)
    return stored.groupBy("sequence", "seq_hash").agg(F.when(F.count("*") == 1, F.min("id")).alias("id")).join(parts.groupBy("sequence").agg(F.min("id").alias("least")), "sequence").select(F.when(F.col("id").isNotNull(), F.col("least")).alias("id"), "sequence", "seq_hash")
