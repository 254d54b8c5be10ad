"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is split into d + s blocks for d differing bits at most: these touch d blocks, so
a close pair shares s whole ones. Fingerprints are joined on every choice of s blocks and the distance
is verified in the join. More spare blocks s make keys longer and more of them; they grow with the logarithm
of the number of fingerprints, so that a key has few of these at any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import each, long_fields, map_texts, stash
from lociq.llm.components import components

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (256 * np.arange(8, dtype=np.int64))[None, :]


def fingerprint(text: str, words_each: int) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    runs = [words[k:] for k in range(words_each)] if len(words) > words_each else [[word] for word in words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(run), SEED) for run in zip(*runs)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 50_000):
        part = hashes[k : k + 50_000]
        of_byte = np.bincount((part.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
        counts += (of_byte.reshape(8, 256) @ _BITS).ravel()
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, words_each: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): one per row; ASCII lower case, words between ASCII blanks, shingles with repeats.

    A text with fewer words is one shingle; null, empty and blank texts have fingerprint 0.
    """

    def make() -> Callable[[list[str]], list[tuple]]:
        return each(lambda text: (fingerprint(text, words_each),))

    return map_texts(df, id_col, text_col, make, long_fields("fp"))


#: Fingerprints of one key on average at most, if bits were even: a key compares so many with each other, which
#: costs less than the further keys that each fingerprint needs to have fewer.
KEY_ROWS = 64


def spare_blocks(distance: int, n: int) -> int:
    """The fewest spare blocks, two at least, whose keys have KEY_ROWS of ``n`` fingerprints on average at most."""
    spare = 2
    while spare < 8 and 64 * spare / (distance + spare) < math.log2(max(n, 1) / KEY_ROWS + 1):
        spare += 1
    return spare


def _masks(distance: int, spare: int) -> list[int]:
    """The bits of every choice of ``spare`` blocks, as signed 64-bit integers."""
    n = distance + spare
    edges = [64 * k // n for k in range(n + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    sums = [sum(block[k] for k in chosen) for chosen in combinations(range(n), spare)]
    return [bits - (1 << 64) if bits >> 63 else bits for bits in sums]


def _keys(fp: Column, masks: list[int]) -> Column:
    """The fingerprint by every choice: the choice's number and the bits with all others cleared."""
    return F.array(*(F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")) for k, mask in enumerate(masks)))


def _first_choice(differing: Column, masks: list[int]) -> Column:
    """The first choice none of whose bits differ; a pair is taken there only, not at each key that it shares."""
    out = F.when(differing.bitwiseAND(F.lit(masks[0])) == 0, 0)
    for k, mask in enumerate(masks[1:], 1):
        out = out.when(differing.bitwiseAND(F.lit(mask)) == 0, k)
    return out


def links(classes: DataFrame, distance: int) -> DataFrame:
    """Rows (a, b): each two different ``fp`` of ``classes`` at most ``distance`` bits apart, once."""
    masks = _masks(distance, spare_blocks(distance, classes.count()))
    keyed = classes.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("k")).select("fp", "k.*")
    left, right = keyed.alias("l"), keyed.alias("r")
    differing = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    near = (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(differing) <= distance)
    same = (F.col("l.choice") == F.col("r.choice")) & (F.col("l.bits") == F.col("r.bits"))
    found = left.join(right, same & near & (F.col("l.choice") == _first_choice(differing, masks)))
    return found.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def _labels(fps: DataFrame, distance: int, id_col: str) -> DataFrame:
    """Rows (fp, component_id) for every fingerprint of ``fps``."""
    classes = stash(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    found = stash(components(links(classes, distance)), "components")
    least = found.join(classes, found.node == classes.fp).groupBy("component").agg(F.min("rep").alias("least"))
    grouped = found.join(least, "component").select(F.col("node").alias("fp"), "least", F.lit(True).alias("linked"))
    labelled = classes.join(grouped, "fp", "left")
    return labelled.select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))


def near_duplicates(df: DataFrame, words_each: int = 5, distance: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component_id): component_id is the smallest id reachable by links, the own included.

    Equal fingerprints are one class with its smallest id, so copies never meet in a join; only different
    fingerprints are joined. Rows with equal ids stay. Rows without an id link as any other, so they can connect
    others, but are never the smallest: component_id is null only where no row of the component has an id.
    Empty tables give no rows. ``id_col`` has to be a long. Other columns are not read. A text has to fit a
    Python worker, which holds about 20 bytes for each of its words besides.
    """
    rows = stash(fingerprints(df, words_each, id_col, text_col), "fingerprints")
    return rows.join(_labels(rows, distance, id_col), "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, words_each: int = 5, distance: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicates: the one of the smallest id.

    Rows of equal id are one document, of which the one with the smallest hash of its columns stays; rows without
    an id all stay. Columns can have any names.
    """
    groups = stash(near_duplicates(df, words_each, distance, id_col, text_col), "groups").where(F.col(id_col).isNotNull())
    first = groups.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    n, ids = groups.agg(F.count("*"), F.count_distinct(id_col)).first()
    rows = df
    if n > ids:
        whole = F.struct(*df.columns)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        order = F.struct(F.sha2(text, 256), F.sha2(F.to_json(whole), 256))
        rows = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_")).agg(F.min_by(whole, order).alias("row")).select("row.*")
    return rows.join(first, id_col, "left_semi").unionByName(df.where(F.col(id_col).isNull()))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
