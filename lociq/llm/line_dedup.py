"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import stash

#: Trimmed from a line's ends before lines are compared; a line of these alone is blank.
EDGES = " \t\x0b\x0c\r"
#: Boilerplate lines, all hosts together, up to which their table is broadcast: 16 bytes each.
BROADCAST_LINES = 200_000

# Tags that end a line of a page's text, and what is not text at all.
_BLOCKS = "p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|article|section|header|footer|nav|main|aside|title|head|body|html|blockquote|pre|form"
HIDDEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>"
BLOCK = rf"(?i)</?(?:{_BLOCKS})\b[^>]*>"
TAG = r"<[^>]*>"


def page_text(html: Column) -> Column:
    """A page's text: block tags become line ends, other tags, comments, scripts and styles go."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line, F.lit(EDGES))))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(EDGES)) == ""


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int = 1) -> DataFrame:
    """Rows (host, drop) for rows (host, text): the keys of lines of which more than ``max_ratio`` of the host's
    pages have one.

    A host's pages have as many boilerplate lines as an average page has lines over the ratio at most, so
    ``drop`` is short whatever the host's size.
    """
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: ~_blank(x)), _key))
    counts = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("line").alias("drop"))


def drop_boilerplate(df: DataFrame, host: Column, text: Column, max_ratio: float = 0.1, min_pages: int = 1) -> DataFrame:
    """Rows (row, host, text, n_lines, n_dropped): ``row`` is a struct of all columns of ``df``, whatever their
    names, ``text`` the kept lines; n_lines and n_dropped count lines that aren't blank.

    A page is a row. Each of its lines is counted once for its host, trimmed and exact in case; a line
    goes where more than ``max_ratio`` of the host's pages have it, in every place it stands. The ratio alone decides,
    so a host of fewer than 1 / max_ratio pages loses all lines; ``min_pages``, 1 and so off by default, spares the
    lines of fewer pages. Blank lines stay and count for nothing; the order stays. A null host is the
    host ''; a null text has no lines and stays null. Repeated rows are pages of their own. An empty table gives none.

    Lines are shuffled as 16-byte keys after a count within each task. Texts don't move while the
    boilerplate has at most BROADCAST_LINES lines; beyond that Spark joins by host and splits hot ones. A very long
    text is split into lines in one row: it takes a few times its size in memory, and time in proportion.
    """
    pages = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(host, F.lit("")).alias("host"), text.alias("text"))
    drop = stash(boilerplate(pages.select("host", "text"), max_ratio, min_pages), "boilerplate")
    size = drop.agg(F.sum(F.size("drop"))).first()[0] or 0
    joined = pages.join(F.broadcast(drop) if size <= BROADCAST_LINES else drop, "host", "left")
    lines = F.split("text", "\n", -1)
    hit = F.array_intersect(F.transform(lines, _key), F.col("drop"))
    gone = lambda x: ~_blank(x) & F.array_contains(F.col("hit"), _key(x))
    marked = joined.withColumn("hit", F.when(F.col("drop").isNotNull() & F.col("text").isNotNull(), hit))
    any_hit = F.coalesce(F.size("hit") > 0, F.lit(False))
    n_lines = F.size(F.filter(lines, lambda x: ~_blank(x)))
    n_dropped = F.when(any_hit, F.size(F.filter(lines, gone))).otherwise(0)
    kept = F.when(any_hit, F.array_join(F.filter(lines, lambda x: ~gone(x)), "\n")).otherwise(F.col("text"))
    return marked.select("row", "host", kept.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def without_boilerplate(df: DataFrame, host: Column, text_col: str, max_ratio: float = 0.1, min_pages: int = 1, length_col: str | None = None) -> DataFrame:
    """``df`` with the same columns, its text without the boilerplate lines and, if named, its length brought up to date."""
    kept = drop_boilerplate(df, host, F.col(text_col), max_ratio, min_pages)
    new = {text_col: F.col("text")}
    if length_col:
        new[length_col] = F.length("text").cast("long")
    return kept.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns))
