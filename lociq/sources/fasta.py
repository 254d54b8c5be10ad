"""FASTA files: a splittable scan with header repair, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import headers as H
from lociq.functions.sequence import wrapped

#: A line of metadata that a broken header went on with: a tag, or a number and a space.
CONTINUED = r"(^|\s)(OX|OS|GN|PE|SV)=|^\d+ "


def read_fasta(spark: SparkSession, path: str, repair: bool = True, keep_empty: bool = False) -> DataFrame:
    """Rows (id, description, sequence, taxon_id) of FASTA files, plain or gz, split at each ``\\n>``.

    The id ends at the first white space, the description follows a space. Bodies lose white space and
    become upper case. With ``repair``, of the first three lines after the header those that carry
    tags or begin with a number are moved to the description; after ``SV=<digits>`` the rest of a line is
    body. Records without a body go unless ``keep_empty``. Files in gz are one task each: repartition after.
    """
    return _records(spark.read.option("lineSep", "\n>").text(path), repair, keep_empty)


def parse_fasta(rows: DataFrame, column: str, repair: bool = True, keep_empty: bool = False) -> DataFrame:
    """The records of FASTA text or bytes held in a column, as read_fasta gives them; a null has none."""
    texts = rows.select(F.explode(F.split(F.col(column).cast("string"), "\n>")).alias("value"))
    return _records(texts, repair, keep_empty)


def _records(raw: DataFrame, repair: bool, keep_empty: bool) -> DataFrame:
    record = F.regexp_replace(F.regexp_replace("value", r"^>", ""), "\r", "")
    lines = F.split(record, "\n")
    head = F.get(lines, F.lit(0))
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    rows = raw.where(F.trim("value") != "").select(head.alias("head"), rest.alias("rest"))
    if repair:
        is_meta = lambda x, i: (i < 3) & x.rlike(CONTINUED)
        meta = F.filter("rest", is_meta)
        cut = lambda x: F.regexp_extract(x, r"^(.*?SV=\d+)", 1)
        told = F.transform(meta, lambda x: F.when(cut(x) != "", cut(x)).otherwise(x))
        left = F.transform(meta, lambda x: F.when(cut(x) != "", F.substring(x, F.length(cut(x)) + 1, F.length(x))).otherwise(F.when(x.rlike(r"^\d+ SV=\d+"), F.regexp_replace(x, r"^\d+ SV=\d+", "")).otherwise("")))
        glued = F.regexp_extract("head", r"SV=\d+([A-Za-z*-]+)$", 1)
        body = F.concat(glued, F.array_join(left, ""), F.array_join(F.filter("rest", lambda x, i: ~is_meta(x, i)), ""))
        head_text = F.concat_ws(" ", F.when(glued != "", F.expr("substring(head, 1, length(head) - length(regexp_extract(head, 'SV=\\\\d+([A-Za-z*-]+)$', 1)))")).otherwise(F.col("head")), F.nullif(F.array_join(told, " "), F.lit("")))
    else:
        body, head_text = F.array_join("rest", ""), F.col("head")
    rows = rows.select(head_text.alias("head"), F.upper(F.regexp_replace(body, r"\s", "")).alias("sequence"))
    identifier = F.regexp_extract("head", r"^(\S*)", 1)
    described = F.nullif(F.trim(F.regexp_extract("head", r"^\S* (.*)$", 1)), F.lit(""))
    out = rows.select(identifier.alias("id"), described.alias("description"), "sequence")
    out = out.withColumn("taxon_id", H.taxon_id(F.coalesce("description", F.lit(""))))
    return out if keep_empty else out.where("sequence <> ''")


def fasta_lines(identifier: Column, description: Column, sequence: Column, taxon: Column, width: int | None = 80) -> Column:
    body = sequence if width is None else wrapped(sequence, width)
    return F.concat(H.header(identifier, description, taxon), F.lit("\n"), body)


def write_sequences(rows: DataFrame, path: str, form: str = "fasta", compression: str | None = None) -> None:
    """``rows`` (id, description, sequence, taxon_id) as fasta, fastq (quality I), tsv or json files."""
    options = {"compression": compression} if compression else {}
    if form == "fasta":
        rows.select(fasta_lines(F.col("id"), F.col("description"), F.col("sequence"), F.col("taxon_id"))).write.options(**options).text(path)
    elif form == "fastq":
        name = F.concat(F.lit("@"), F.concat_ws(" ", "id", "description"))
        rows.select(F.concat_ws("\n", name, "sequence", F.lit("+"), F.repeat(F.lit("I"), F.length("sequence")))).write.options(**options).text(path)
    elif form == "tsv":
        rows.select("id", "description", "sequence", "taxon_id").write.options(**options).csv(path, sep="\t", header=True)
    elif form == "json":
        rows.write.options(**options).json(path)
    else:
        raise ValueError(f"unknown format: {form}")


def write_as_of(rows: DataFrame, path: str, sequence_time: str, taxonomy_time: str, roots: tuple[str, str], form: str = "fasta") -> None:
    """A snapshot's sequences in any of the formats, and beside them, in ``path/preamble``, the lines that tell its
    two times and roots, each after a semicolon."""
    write_sequences(rows, f"{path}/{form}", form)
    told = ("Bi-Temporal Export", f"Sequence Date: {sequence_time}", f"Taxonomy Date: {taxonomy_time}", f"Sequence Root: {roots[0]}", f"Taxonomy Root: {roots[1]}")
    rows.sparkSession.createDataFrame([(f"; {line}",) for line in told], "value string").coalesce(1).write.text(f"{path}/preamble")
