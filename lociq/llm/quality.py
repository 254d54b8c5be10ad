"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit for each rule
that fails; policies are masks with a version, applied to the bits alone, and ablations come from the
counts of the few bit patterns that occur.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import each, long_fields, map_texts, unused

BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + bytes(range(0x61, 0x7B))
DIGITS = bytes(range(0x30, 0x3A))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs", "n_digits")


#: A measurement's column by its name.
Read = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds; its bit is its place in the list of rules."""

    name: str
    fails: Callable[[Read], Column]


def _over(part: str, percent: int, whole: str) -> Callable[[Read], Column]:
    return lambda m: 100 * m(part) > percent * m(whole)


#: The rules in the order of their bits; add new ones at the end, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", _over("n_repeat_words", 50, "n_words")),
    Rule("symbols", _over("n_symbols", 10, "n_words")),
    Rule("repeated_lines", _over("n_dup_lines", 30, "n_lines")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 15 * m("n_words")),
    Rule("upper_case", _over("n_upper", 50, "n_letters")),
    Rule("exclamations", _over("n_bangs", 20, "n_words")),
    Rule("digits", _over("n_digits", 30, "word_chars")),
)
BASE_RULES = ("few_words", "repeated_windows")

#: Policies by version: the rules that reject a document.
POLICIES = {1: BASE_RULES, 2: tuple(rule.name for rule in RULES)}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule.name in rules)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more, the first ones included."""
    if len(words) < 4:
        return 0
    number = {word: k for k, word in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    windows = at[:-2] * len(number) + at[1:-1]
    if len(number) ** 3 >= 1 << 62:
        windows = np.unique(windows, return_inverse=True)[1]
    windows = windows * len(number) + at[2:]
    ordered = np.sort(windows)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.flatnonzero(np.isin(windows, ordered[1:][same]))
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[twice + shift] = True
    return int(inside.sum())


def measure(text: str) -> tuple[int, ...]:
    data = text.encode()
    less = lambda drop: len(data) - len(data.translate(None, drop))
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(BLANK)]
    return (
        len(words),
        len(text) - less(BLANK),
        less(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        less(LETTERS),
        less(UPPER),
        data.count(b"!"),
        less(DIGITS),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, the MEASURES, fail_bits long): one for each row of ``df``.

    A null or empty text has zero words and fails ``few_words``. Repeated rows and null ids stay; other
    columns are not read. One pass, no shuffle; the largest text has to fit a Python worker.
    """
    measured = map_texts(df, id_col, text_col, lambda: each(measure), long_fields(*MEASURES))
    return measured.withColumn("fail_bits", fail_bits(F.col))


def fail_bits(m: Read) -> Column:
    return sum((F.when(rule.fails(m), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES)), F.lit(0).cast("long"))


def kept(policy: int, bits: Column | None = None) -> Column:
    """Whether a row of the ledger passes the policy of that version."""
    bits = F.col("fail_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def passing(df: DataFrame, policy: int = max(POLICIES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass a policy, with their columns unchanged; no shuffle."""
    stem = unused(df, "_m_")
    fields = long_fields(*(stem + name for name in MEASURES))
    measured = map_texts(df, id_col, text_col, lambda: each(measure), fields, carry=True)
    return measured.where(kept(policy, fail_bits(lambda name: F.col(stem + name)))).select(*df.columns)


def ablations(rows: DataFrame, policy: int) -> DataFrame:
    """Rows (rule, n_failed, n_only, n_kept_without) for each rule of a policy.

    n_failed: documents that fail it; n_only: those that fail no other rule of the policy, so they would
    come back without it; n_kept_without: documents kept by the policy less this rule. The ledger is
    first counted by bit pattern, at most 2^rules rows; an empty ledger gives zeros.
    """
    whole = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    names = [(k, rule.name) for k, rule in enumerate(RULES) if whole >> k & 1]
    count = lambda holds: F.coalesce(F.sum(F.when(holds, F.col("n"))), F.lit(0))
    bits = F.col("bits")
    columns = [
        F.struct(
            F.lit(name).alias("rule"),
            count(bits.bitwiseAND(F.lit(1 << k)) != 0).alias("n_failed"),
            count(bits == F.lit(1 << k)).alias("n_only"),
            count(bits.bitwiseAND(F.lit(whole & ~(1 << k))) == 0).alias("n_kept_without"),
        )
        for k, name in names
    ]
    return patterns.agg(F.array(*columns).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def judge(df: DataFrame, policy: int = max(POLICIES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed and kept under a policy, base columns first."""
    rows = ledger(df, id_col, text_col)
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE_RULES))) != 0
    return rows.select(id_col, *MEASURES[:5], failed.alias("base_failed"), (~failed & kept(policy)).alias("kept"), "fail_bits", *MEASURES[5:], F.lit(policy).cast("long").alias("policy"))
