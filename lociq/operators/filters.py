"""Boolean expressions over taxa, and filters of rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions import sequence as S

# Names that stand for taxon ids in an expression.
NAMES = {
    "bacteria": 2, "archaea": 2157, "eukaryota": 2759, "viruses": 10239, "escherichia": 561, "escherichia coli": 562, "e. coli": 562, "homo sapiens": 9606, "human": 9606, "mus musculus": 10090, "mouse": 10090,
    "drosophila": 7227, "drosophila melanogaster": 7227, "arabidopsis": 3702, "arabidopsis thaliana": 3702, "saccharomyces cerevisiae": 559292, "yeast": 559292,
}
#: A spelling that needs no quotes in an expression.
NAMES["e.coli"] = NAMES["e. coli"]

_TOKEN = re.compile(r"\s*(\(|\)|\"[^\"]*\"|[^\s()]+)")


class TaxonFilter:
    """An expression of ids, names, AND, OR, NOT and parentheses; NOT binds before AND, AND before OR.

    >>> TaxonFilter.parse("562 OR 2 AND NOT 9606").matches({562})
    True
    """

    def __init__(self, tree: tuple) -> None:
        self.tree = tree

    @classmethod
    def parse(cls, text: str, names: dict[str, object] | None = None) -> TaxonFilter:
        tokens = _TOKEN.findall(text)
        known = NAMES if names is None else names
        at = 0

        def word() -> str | None:
            return tokens[at] if at < len(tokens) else None

        def is_(keyword: str) -> bool:
            return (word() or "").upper() == keyword

        def any_of() -> tuple:
            nonlocal at
            parts = [all_of()]
            while is_("OR"):
                at += 1
                parts.append(all_of())
            return ("or", *parts) if len(parts) > 1 else parts[0]

        def all_of() -> tuple:
            nonlocal at
            parts = [one()]
            while is_("AND"):
                at += 1
                parts.append(one())
            return ("and", *parts) if len(parts) > 1 else parts[0]

        def one() -> tuple:
            nonlocal at
            token = word()
            if token is None or token == ")" or is_("AND") or is_("OR"):
                raise ValueError(f"a taxon is missing at token {at} of {text!r}")
            at += 1
            if token.upper() == "NOT":
                return ("not", one())
            if token == "(":
                inner = any_of()
                if word() != ")":
                    raise ValueError(f"a parenthesis is open in {text!r}")
                at += 1
                return inner
            plain = token.strip('"')
            return ("id", int(plain) if plain.isdigit() else known.get(plain.lower(), plain if names is not None else None))

        tree = any_of()
        if at < len(tokens):
            raise ValueError(f"{tokens[at]!r} is not expected in {text!r}")
        return cls(tree)

    def column(self, taxa: Column) -> Column:
        """Whether an array of taxa fits; an unknown name is in no array."""

        def build(node: tuple) -> Column:
            kind, *parts = node
            if kind == "id":
                return F.lit(False) if parts[0] is None else F.coalesce(F.array_contains(taxa, parts[0]), F.lit(False))
            if kind == "not":
                return ~build(parts[0])
            out = build(parts[0])
            for part in parts[1:]:
                out = out & build(part) if kind == "and" else out | build(part)
            return out

        return build(self.tree)

    def matches(self, taxa: set) -> bool:
        def check(node: tuple) -> bool:
            kind, *parts = node
            if kind == "id":
                return parts[0] in taxa
            if kind == "not":
                return not check(parts[0])
            return all(map(check, parts)) if kind == "and" else any(map(check, parts))

        return check(self.tree)


def by_length(rows: DataFrame, text: str, least: int = 0, most: int | None = None) -> DataFrame:
    n = F.length(text)
    return rows.where((n >= least) & (n <= most) if most is not None else n >= least)


def containing(rows: DataFrame, column: str, part: str, limit: int | None = None) -> DataFrame:
    """Rows whose column has a literal part; with a limit, the first so many by that column."""
    met = rows.where(F.contains(F.col(column), F.lit(part)))
    return met if limit is None else met.orderBy(column).limit(limit)


def complex_enough(rows: DataFrame, text: str, threshold: float = 0.3, least: int = 0) -> DataFrame:
    """Rows of that length at least whose normalised entropy is the threshold or more."""
    return rows.where((F.length(text) >= least) & (S.normalised_entropy(F.col(text)) >= threshold))


def sanitize(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ambiguous letters taken out; those that lose over a tenth, or all, go."""
    return rows.withColumn(text, S.sanitized(F.col(text))).where(F.col(text).isNotNull())


def with_short_children(children: DataFrame, reference: str, length: str, most: int = 10_000) -> DataFrame:
    """Rows (reference, n_children) of children of that length at most; references left with none are gone."""
    return short_children(children, length, most).groupBy(reference).agg(F.count("*").alias("n_children"))


def short_children(children: DataFrame, length: str, most: int = 10_000) -> DataFrame:
    return children.where(F.col(length) <= most)


def in_range_or_unknown(chunks: DataFrame, least: str, most: str, value: int) -> DataFrame:
    """Chunks whose range covers a value, or that have none; Parquet statistics prune the same way."""
    return chunks.where((F.lit(value).between(F.col(least), F.col(most))) | F.col(least).isNull() | F.col(most).isNull())
