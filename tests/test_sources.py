import gzip

from pyspark.sql import functions as F

from lociq.sources import fasta, tables
from lociq.streaming import ingest


def test_fasta_repair(spark, tmp_path):
    text = ">sp|P1|ONE first protein OX=9606 GN=A\nmkv la\nGGG\n>two broken TaxID=0\nOS=Some OX=666 PE=1\n3 SV=1MIYQ\nACDE\n>empty nothing\n>three\tno description\nAC\n"
    path = tmp_path / "a.fasta"
    path.write_text(text)
    rows = {r.id: r for r in fasta.read_fasta(spark, str(path)).collect()}
    assert set(rows) == {"sp|P1|ONE", "two", "three"}
    assert (rows["sp|P1|ONE"].sequence, rows["sp|P1|ONE"].taxon_id) == ("MKVLAGGG", 9606)
    assert (rows["two"].sequence, rows["two"].taxon_id) == ("MIYQACDE", 666)
    assert rows["three"].description is None
    assert fasta.read_fasta(spark, str(path), keep_empty=True).count() == 4
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as out:
        out.write(text)
    assert fasta.read_fasta(spark, str(tmp_path / "b.fasta.gz")).count() == 3


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "text", "ACGT" * 50, 7), ("b", None, "ACG", None)], "id string, description string, sequence string, taxon_id long")
    for form in ("fasta", "fastq", "tsv", "json"):
        fasta.write_sequences(rows, str(tmp_path / form), form)
    back = {r.id: (r.sequence, r.taxon_id) for r in fasta.read_fasta(spark, str(tmp_path / "fasta")).collect()}
    assert back == {"a": ("ACGT" * 50, 7), "b": ("ACG", None)}
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "fastq")).collect() if r.value.startswith("@")) == ["@a text", "@b"]


def test_taxonomy_and_mappings(spark, tmp_path):
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tBact\t|\t\t|\tscientific name\t|\n2\t|\teubacteria\t|\t\t|\tsynonym\t|\n")
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n")
    got = {tuple(r) for r in tables.read_taxonomy(spark, str(tmp_path / "names.dmp"), str(tmp_path / "nodes.dmp")).collect()}
    assert got == {(1, None, "no rank", "root"), (2, 1, "superkingdom", "Bact")}
    (tmp_path / "id.tsv").write_text("A1\tNCBI_TaxID\t9606\nA1\tGI\t5\n")
    assert [tuple(r) for r in tables.read_idmapping(spark, str(tmp_path / "id.tsv")).collect()] == [("A1", 9606)]
    (tmp_path / "acc.tsv").write_text("accession\taccession.version\ttaxid\tgi\nX1\tX1.2\t7\t0\n")
    assert {tuple(r) for r in tables.read_accession2taxid(spark, str(tmp_path / "acc.tsv")).collect()} == {("X1", 7), ("X1.2", 7)}


def test_m8_and_children(spark, tmp_path):
    (tmp_path / "x.m8").write_text("# c\nq\ts\t95.0\t10\t1\tx\t1\t10\t1\t10\t1e-5\t50\n\nshort\tline\n")
    row = tables.read_m8(spark, str(tmp_path / "x.m8")).collect()
    assert len(row) == 1 and (row[0].identity, row[0].gaps, row[0].evalue) == (0.95, 0, 1e-5)
    (tmp_path / "r.tsv").write_text("r\ta\tb\n")
    assert {tuple(r) for r in tables.read_ref2children(spark, str(tmp_path / "r.tsv")).collect()} == {("r", "a"), ("r", "b")}


def test_delta_file_round_trip(spark, tmp_path):
    ops = [("copy", 0, 5, ""), ("insert", 5, 5, "a\tb\\n,>\n\r\\x2C")]
    df = spark.createDataFrame([("c", "r", 9, ops), ("d", "r", None, [])], "child_id string, reference_id string, taxon_id long, ops array<struct<kind:string,start:bigint,end:bigint,text:string>>")
    tables.write_deltas(df, str(tmp_path / "d"))
    back = {r.child_id: r for r in tables.read_deltas(spark, str(tmp_path / "d")).collect()}
    assert [tuple(o) for o in back["c"].ops] == ops and back["c"].taxon_id == 9
    assert back["d"].ops == [] and back["d"].taxon_id is None


def test_incremental_ingest(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def run():
        ingest.ingest(ingest.text_stream(spark, str(source)), target, checkpoint, "seq_hash").awaitTermination()
        return sorted(r.sequence for r in spark.read.parquet(target).collect())

    (source / "a.fasta").write_text(">a x\nAC\nGT\n>b\nTTT\n>c\nACGT\n")
    assert run() == ["ACGT", "TTT"]
    (source / "b.fasta").write_text(">d\nTTT\n>e\nGGG\n")
    assert run() == ["ACGT", "GGG", "TTT"]
    assert run() == ["ACGT", "GGG", "TTT"]


def test_batch_retry(spark, tmp_path):
    batch = spark.createDataFrame([("h1",), ("h1",), ("h2",)], "seq_hash string")
    for _ in range(2):
        ingest.add_batch(batch, 0, str(tmp_path / "t"), "seq_hash")
    ingest.add_batch(batch, 1, str(tmp_path / "t"), "seq_hash")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert spark.read.parquet(str(tmp_path / "t")).where(F.col("batch") == 1).count() == 0


def test_retry_and_batch_size():
    import pytest

    tried, waits = [], []

    def work():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("not yet")
        return "done"

    assert ingest.with_retry(work, tries=4, first_wait=1, wait=waits.append) == "done" and waits == [1, 2]
    with pytest.raises(OSError):
        ingest.with_retry(lambda: (_ for _ in ()).throw(OSError("never")), tries=2, wait=waits.append)
    with pytest.raises(KeyError):
        ingest.with_retry(lambda: {}["x"], wait=waits.append)
    assert [ingest.next_batch_size(100, s, 10) for s in (1, 8, 10, 1000)] == [200, 125, 100, 50]
    assert ingest.next_batch_size(100, 1, 10, memory_share=0.9) == 50 and ingest.next_batch_size(1, 100, 1) == 1


def test_first_row_of_a_batch_stays(spark, tmp_path):
    rows = [("k", 5, "b"), ("k", 3, "z"), ("j", 9, "a")]
    for n, data in enumerate((rows, rows[::-1])):
        ingest.add_batch(spark.createDataFrame(data, "key string, n int, t string").repartition(3), 0, str(tmp_path / str(n)), "key")
        assert sorted((r.key, r.n, r.t) for r in spark.read.parquet(str(tmp_path / str(n))).collect()) == [("j", 9, "a"), ("k", 3, "z")]
