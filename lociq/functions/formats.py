"""Small parsers and formats on the driver: times, versions, database references, sizes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Taxonomic ranks in order, and other names of a rank.
RANKS = ("superkingdom", "kingdom", "phylum", "class", "order", "family", "genus", "species", "subspecies", "strain", "no rank")
RANK_ALIASES = {"domain": "superkingdom", "varietas": "strain", "forma": "strain"}


def parse_time(text: str, now: datetime | None = None) -> datetime:
    """RFC 3339, YYYY-MM-DD at midnight UTC, or now, today or yesterday."""
    now = now or datetime.now(UTC)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    named = {"now": now, "today": midnight, "yesterday": midnight - timedelta(days=1)}
    if (word := text.strip().lower()) in named:
        return named[word]
    found = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def is_version(text: str) -> bool:
    """YYYYMMDD_HHMMSS."""
    return bool(re.fullmatch(r"\d{8}_\d{6}", text))


def version_key(text: str) -> tuple[int, ...]:
    """The numbers of a version, for comparing."""
    return tuple(map(int, re.findall(r"\d+", text)))


@dataclass(frozen=True)
class DatabaseReference:
    """source/dataset@version:profile."""

    source: str
    dataset: str
    version: str = "current"
    profile: str = "auto"

    @classmethod
    def parse(cls, text: str) -> DatabaseReference:
        match = re.fullmatch(r"([^/@:]+)/([^/@:]+)(?:@([^/@:]+))?(?::([^/@:]+))?", text)
        if not match:
            raise ValueError(f"not source/dataset@version:profile: {text}")
        source, dataset, version, profile = match.groups()
        return cls(source, dataset, version or "current", profile or "auto")

    def __str__(self) -> str:
        return f"{self.source}/{self.dataset}@{self.version}:{self.profile}"


def parse_taxids(text: str) -> list[int]:
    """Numbers divided by commas or lines; what follows # is a comment."""
    lines = (line.split("#")[0] for line in text.splitlines())
    return [int(x) for line in lines for x in re.split(r"[,\s]+", line) if x]


def format_bytes(n: Column) -> Column:
    """With two decimals in steps of 1024."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string(f"%.2f {units[-1]}", n / float(1024 ** (len(units) - 1)))
    for k in range(len(units) - 2, -1, -1):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.2f {units[k]}", n / float(1024**k))).otherwise(out)
    return out


def reference_parts(text: Column) -> Column:
    """source/dataset@version:profile as a struct, 'current' and 'auto' where left out; null if it is none."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^([^/@:]+)/([^/@:]+)(?:@([^/@:]+))?(?::([^/@:]+))?$", k), F.lit(""))
    found = F.struct(part(1).alias("source"), part(2).alias("dataset"), F.coalesce(part(3), F.lit("current")).alias("version"), F.coalesce(part(4), F.lit("auto")).alias("profile"))
    return F.when(part(1).isNotNull(), found)


def time_of(text: Column) -> Column:
    """An instant from RFC 3339 or a date at midnight UTC; null for other texts."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def version_time(text: Column) -> Column:
    """The instant of a version YYYYMMDD_HHMMSS; null for other texts."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))


def etag(sequence_version: Column, taxonomy_version: Column) -> Column:
    return F.concat(F.lit('W/"'), F.substring(sequence_version, 1, 8), F.lit("-"), F.substring(taxonomy_version, 1, 8), F.lit('"'))


def rank_depth(rank: Column) -> Column:
    """A rank's place from 0; unknown names count as no rank."""
    name = F.lower(rank)
    for alias, real in RANK_ALIASES.items():
        name = F.when(name == alias, real).otherwise(name)
    depth = F.array_position(F.lit(list(RANKS)), name) - 1
    return F.when(depth < 0, len(RANKS) - 1).otherwise(F.coalesce(depth, F.lit(len(RANKS) - 1))).cast("int")
