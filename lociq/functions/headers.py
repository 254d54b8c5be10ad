"""Column functions over record headers and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags of a description line.
TAGS = ("OS", "OX", "GN", "PE", "SV")


def _number(text: Column, pattern: str) -> Column:
    """The digits after the first match of ``pattern`` as a long; null without a match."""
    found = F.regexp_extract(text, pattern + r"(\d{1,18})", 1)
    return F.when(found != "", found.cast("long"))


def taxon_id(description: Column) -> Column:
    """The first positive number of TaxID=, OX=, taxon: and tax_id=, in this order; else null."""
    found = [_number(description, p) for p in ("TaxID=", "OX=", "taxon:", "tax_id=")]
    return F.coalesce(*(F.when(x > 0, x) for x in found))


def taxon_id_ox_first(description: Column) -> Column:
    """OX= before TaxID=; zero counts."""
    return F.coalesce(_number(description, "OX="), _number(description, "TaxID="))


def taxon_id_any(description: Column, default: int = 1) -> Column:
    """TaxID and tax_id with = or :, [taxid:N] and OX=; the root where there is none."""
    found = [_number(description, p) for p in ("TaxID[=:]", "tax_id[=:]", r"\[taxid:", "OX=")]
    return F.coalesce(*found, F.lit(default).cast("long"))


def accession(identifier: Column) -> Column:
    """X of sp|X|.. and tr|X|..; ACC of ..|ref|ACC.v|; else the id up to its first dot."""
    parts = F.split(identifier, r"\|")
    ref = F.regexp_extract(identifier, r"\|ref\|([^.|]+)", 1)
    curated = F.get(parts, F.lit(0)).isin("sp", "tr") & (F.size(parts) >= 2)
    return F.when(curated, F.get(parts, F.lit(1))).when(ref != "", ref).otherwise(F.regexp_extract(identifier, r"^([^.]*)", 1))


def accessions(identifier: Column) -> Column:
    """All accessions for an index: accession and entry name of curated ids, the value after each database
    tag, else the first word; each also without its version, distinct and sorted, longer than two."""
    parts = F.split(F.element_at(F.split(identifier, r"\s"), 1), r"\|")
    values = F.filter(parts, lambda p: ~p.isin("sp", "tr", "gi", "ref", "gb", "emb", "dbj", "pdb", "lcl"))
    plain = F.transform(values, lambda p: F.regexp_replace(p, r"\.\d+$", ""))
    return F.array_sort(F.filter(F.array_union(values, plain), lambda p: F.length(p) > 2))


def without_taxon(description: Column) -> Column:
    """``description`` without TaxID= and taxon: numbers, trimmed; OX= stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(description, r"\s*TaxID=\d+", ""), r"\s*taxon:\d+", ""))


def header(identifier: Column, description: Column, taxon: Column) -> Column:
    """``>id description``, with TaxID=n at its end where there is a taxon."""
    described = F.when(taxon.isNotNull(), F.concat_ws(" ", F.nullif(without_taxon(F.coalesce(description, F.lit(""))), F.lit("")), F.concat(F.lit("TaxID="), taxon.cast("string"))))
    body = F.coalesce(described, F.nullif(description, F.lit("")))
    return F.concat(F.lit(">"), F.concat_ws(" ", identifier, body))


def tag(description: Column, name: str) -> Column:
    """A tag's value up to the nearest next tag; null without the tag."""
    others = "|".join(TAGS)
    value = F.regexp_extract(description, rf"(?:^|\s){name}=(.*?)(?=\s(?:{others})=|$)", 1)
    return F.nullif(value, F.lit(""))


def taxonomy_text(identifier: Column, description: Column) -> Column:
    """OS=.. up to GN= or PE=, else Tax=.., else [organism], else the id's part before its first _ or |."""
    found = [F.nullif(F.trim(F.regexp_extract(description, p, 1)), F.lit("")) for p in (r"OS=(.*?)(?= GN=| PE=|$)", r"Tax=(.*?)(?= [A-Za-z]+=|$)", r"\[([^\]]+)\]")]
    return F.coalesce(*found, F.regexp_extract(identifier, r"^([^_|]*)", 1))


def priority_taxon(api: Column, user: Column, mapping: Column, parsed: Column, chunk: Column) -> Column:
    """The taxon of the first source that has one: API, user, mapping, header, chunk."""
    return F.coalesce(api, user, mapping, parsed, chunk)


def resolution(*sources: Column) -> Column:
    """'None' without any value, 'Unanimous' if all that are there agree, else 'Conflicted'."""
    n = F.size(F.array_distinct(F.filter(F.array(*sources), lambda x: x.isNotNull())))
    return F.when(n == 0, "None").when(n == 1, "Unanimous").otherwise("Conflicted")


def confidence(parsed: Column, mapped: Column, inferred: Column) -> Column:
    """0.33, 0.33 and 0.34 for the sources that are there; of several, 1 if all three agree, else half the sum."""
    there = lambda c: c.isNotNull().cast("int")
    total = there(parsed) * 0.33 + there(mapped) * 0.33 + there(inferred) * 0.34
    n = there(parsed) + there(mapped) + there(inferred)
    agree = parsed.eqNullSafe(mapped) & mapped.eqNullSafe(inferred)
    return F.round(F.when(n <= 1, total).when(agree, 1.0).otherwise(total / 2), 4)


def discrepancy(parsed: Column, mapped: Column, inferred: Column) -> Column:
    """How three sources of a taxon disagree; null where those that are there agree."""
    differ = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    none = parsed.isNull() & mapped.isNull() & inferred.isNull()
    return F.when(none, "Missing").when(differ(parsed, mapped), "Conflict").when(differ(mapped, inferred), "Outdated").when(differ(parsed, inferred), "Mismatch")
