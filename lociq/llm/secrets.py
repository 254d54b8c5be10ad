"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Two first-order models over characters are counted from labelled samples, one from random strings and
one from ordinary identifiers. A candidate token is a secret if its log-likelihood ratio says so. The
scan is made of SQL functions only; the model is one constant array.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, and the least length of what they find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Runs of 20 characters or more from AKIA on, and of 24 or more hex digits: a run is found from its start
#: or not at all, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Labelled strings of each kind that a model is fitted on at most.
SAMPLE = 4000


def symbol_of(letter: Column) -> Column:
    """A character's number in the alphabet, from 1; 0 for any other, as before the first."""
    return F.call_function("instr", F.lit(ALPHABET), letter)


@dataclass(frozen=True)
class MarkovModel:
    """``ratio[left * size + right]``: the log-likelihood ratio of a step from one character to the next.

    A candidate is a secret if its mean step is over ``least_mean`` and the sum over ``least_sum``.
    """

    ratio: tuple[float, ...]
    least_sum: float = 12.0
    least_mean: float = 0.35

    @classmethod
    def fit(cls, samples: DataFrame, smoothing: float = 0.5) -> MarkovModel:
        """From rows (text, is_secret): steps are counted in Spark; a count for each two characters and
        label comes to the driver. Null texts and labels are left out; without samples every ratio is 0."""
        size = len(ALPHABET) + 1
        letters = samples.where("text is not null and is_secret is not null").select("is_secret", F.split("text", "").alias("c"))
        steps = letters.select("is_secret", F.explode(F.arrays_zip(F.concat(F.array(F.lit(" ")), "c").alias("l"), F.col("c").alias("r"))).alias("s")).where("s.r <> ''")
        pair = symbol_of(F.col("s.l")) * size + symbol_of(F.col("s.r"))
        counts = {(row[0], row[1]): row[2] for row in steps.groupBy("is_secret", pair.alias("pair")).count().collect()}
        out = []
        for left in range(size):
            total = [sum(counts.get((kind, left * size + right), 0) for right in range(size)) + smoothing * size for kind in (True, False)]
            for right in range(size):
                secret, plain = (counts.get((kind, left * size + right), 0) + smoothing for kind in (True, False))
                out.append(round(math.log(secret / total[0]) - math.log(plain / total[1]), 6))
        return cls(tuple(out))

    def score(self, text: Column) -> Column:
        """The sum of the steps' ratios."""
        size = len(ALPHABET) + 1
        ratio = F.lit(list(self.ratio))
        state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("left"))

        def step(acc: Column, letter: Column) -> Column:
            right = symbol_of(letter)
            return F.struct((acc["sum"] + F.get(ratio, acc["left"] * size + right)).alias("sum"), right.alias("left"))

        return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), state, step, lambda acc: acc["sum"])

    def is_secret(self, text: Column) -> Column:
        score = self.score(text)
        return (score >= self.least_sum) & (score >= self.least_mean * F.length(text))


# Ordinary words that identifiers are made of, in several languages.
WORDS = (
    "user account name value index count total list item data table column row query result error message handler "
    "request response server client session cache buffer stream reader writer parser token config option default "
    "service manager factory builder the and that with from this have which their would there about other these "
    "tion ment able ness ing over under ation ering ands thing the der die und nicht mit ein werden schaft keit heit "
    "ung lich verein recht straße haus les des une pour dans avec sont nous vous leur eau aient ment tion elle que los "
    "las para como esta pero sobre entre cuando ciones mente ado aje file path folder document version number string "
    "integer boolean object array public private static return import export module package class function method"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLE, seed: int = 11) -> DataFrame:
    """Rows (text, is_secret): ``n`` random strings in hex, base64 and upper-case forms, and ``n`` identifiers
    of two to five words in snake case, camel case, kebab case or run together, some with a number."""
    rows = spark.range(n)
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    forms = F.array(F.substring(digest, 1, 40), base64, F.upper(F.regexp_replace(base64, "[+/]", "7")), F.translate(base64, "+/", "-_"))
    secrets = rows.select(F.get(forms, (F.col("id") % 4).cast("int")).alias("text"), F.lit(True).alias("is_secret"))
    pick = lambda k: F.get(F.lit(list(WORDS)), (F.conv(F.substring(digest, 1 + 6 * k, 6), 16, 10).cast("long") % len(WORDS)).cast("int"))
    words = F.slice(F.array(*(pick(k) for k in range(5))), F.lit(1), (F.col("id") % 4 + 2).cast("int"))
    joined = F.array(
        F.array_join(words, "_"),
        F.array_join(F.transform(words, lambda w: F.initcap(w)), ""),
        F.array_join(words, "-"),
        F.array_join(words, ""),
        F.upper(F.array_join(words, "_")),
        F.concat(F.array_join(words, "_"), F.lit("_"), (F.col("id") % 2030).cast("string")),
        F.array_join(words, "/"),
    )
    plain = rows.select(F.get(joined, (F.conv(F.substring(digest, 40, 4), 16, 10).cast("long") % 7).cast("int")).alias("text"), F.lit(False).alias("is_secret"))
    return secrets.unionByName(plain)


KINDS = ("assign", "access", "hex", "markov")


SPAN = "struct<start:int,kind:int,end:int,text:string>"


def _running(numbers: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Each number combined by ``add`` with all before it, which have to be 0 or more; in n log n steps.

    In round k every place takes in the one 2^k before it, so that it covers twice as many as before.
    """
    n = F.size(numbers)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def double(acc: Column, k: Column) -> Column:
        moved = F.slice(F.concat(F.array_repeat(F.lit(0), F.call_function("shiftleft", F.lit(1), k)), acc), F.lit(1), F.size(acc))
        return F.zip_with(acc, moved, add)

    return F.aggregate(rounds, numbers, double)


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:  # noqa: ANN001
    """The pattern's matches in order as structs (start, kind, end, text) in code points, end exclusive.

    The pieces between the matches give the places: each match ends where the pieces and matches up to
    it end. Patterns never match an empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda hit, gap: F.length(gap) + F.length(hit))
    ends = _running(sizes, lambda a, b: a + b)
    spans = F.zip_with(found, ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), hit.alias("text")))
    return F.when(F.size(found) > 0, F.filter(spans, lambda s: keep(s["text"]))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(spans: Column, base: Column) -> Column:
    """The spans, in order of their ends, that overlap none of ``base``.

    One sorted list has the base spans by their starts and the others by their ends. What reaches farthest of the base
    spans before a span's end must not reach past its start.
    """
    event = lambda at, is_base, reach, span: F.struct(at.alias("at"), F.lit(is_base).alias("is_base"), reach.alias("reach"), span.alias("span"))
    events = F.concat(F.transform(spans, lambda s: event(s["end"], 0, F.lit(0), s)), F.transform(base, lambda b: event(b["start"], 1, b["end"], b)))
    ordered = F.sort_array(events)
    reach = _running(F.transform(ordered, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
    judged = F.zip_with(ordered, reach, lambda e, r: F.struct(e.alias("e"), ((e["is_base"] == 0) & (r <= e["span"]["start"])).alias("apart")))
    out = F.transform(F.filter(judged, lambda j: j["apart"]), lambda j: j["e"]["span"])
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), out).otherwise(spans)


def find_secrets(df: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, assign, access, hex, markov): arrays of structs (start, kind, end, text), one row per row.

    Each base kind is found leftmost and without overlaps, and failing matches are dropped. ``markov``
    has the candidates that the model takes for secrets and that overlap no base span. A null text
    counts as empty; repeated rows and null ids stay; other columns are not read. One pass, no shuffle, no
    Python. A text of n characters and m matches takes n + m log m steps; its matches are in memory at once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST
    always = lambda hit: F.lit(True)
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_t"))
    rows = rows.select("_id", _spans(F.col("_t"), ASSIGN, "assign", value).alias("assign"), _spans(F.col("_t"), ACCESS, "access", always).alias("access"), _spans(F.col("_t"), HEX, "hex", always).alias("hex"), _spans(F.col("_t"), CANDIDATE, "markov", model.is_secret).alias("_markov"))
    return rows.select(F.col("_id").alias(id_col), "assign", "access", "hex", _apart(F.col("_markov"), F.concat("assign", "access", "hex")).alias("markov"))


def written(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, then end, joined by commas."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    kinds = F.lit(list(KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
