"""Fuzzy search for short licence notices.

A notice of which at most k letters may be wrong is cut into k + 1 pieces, one of which must stand
unchanged in any match. Exact finds of the pieces give the words where a match can start; from each of these
a bit vector tells the words where one can end, and the regex library's bounded-error matching verifies the edits of
each such span. So all matches on whole words are known before overlaps go.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lociq.llm.common import each, long_fields, map_texts, string_fields

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices and labels searched with errors, in words as the scan sees them.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2": "apache-2",
    "licensed under the apache license": "apache-2",
    "under the gnu general public license": "gpl",
    "under the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "under a creative commons attribution license": "cc-by",
}
#: Letters of a notice to one allowed edit.
LETTERS_AN_EDIT = 10

_WORD = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_WORDS = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    seeds: tuple[tuple[int, bytes], ...]
    masks: dict[int, int]
    pattern: regex.Pattern

    @classmethod
    def of(cls, text: str, label: str) -> Notice:
        edits = len(text) // LETTERS_AN_EDIT
        cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
        seeds = tuple((lo, text[lo:hi].encode()) for lo, hi in zip(cuts, cuts[1:]))
        return cls(text, label, edits, seeds, {c: sum(1 << k for k, x in enumerate(text.encode()) if x == c) for c in text.encode()}, regex.compile(b"(?b)(?:%s){e<=%d}" % (regex.escape(text.encode()), edits)))

    def verified(self, line: bytes, start: int, stop: int) -> int | None:
        """The fewest edits that make the span from the notice, if they are allowed."""
        match = self.pattern.fullmatch(line, start, stop)
        return sum(match.fuzzy_counts) if match else None

    def ends(self, line: bytes, start: int) -> Iterator[int]:
        """Where a match from a word's start can end at a word's end, by Myers' bit vectors."""
        size = len(self.text)
        full, last = (1 << size) - 1, 1 << (size - 1)
        up, down, edits = full, 0, size
        for stop, c in enumerate(line[start : start + size + self.edits], start + 1):
            same = self.masks.get(c, 0)
            across = (((same & up) + up) ^ up) | same
            more, less = down | ~(across | up) & full, up & across
            edits += bool(more & last) - bool(less & last)
            more, less, same = (more << 1 | 1) & full, less << 1 & full, same | down
            up, down = less | ~(same | more) & full, more & same
            if edits <= self.edits and line[stop : stop + 1] in (b"", b" ") and c != 32:
                yield stop


@dataclass(frozen=True)
class Hit:
    """A notice found at bytes start..stop of the text's words joined by single spaces."""

    label: str
    start: int
    stop: int
    edits: int
    score: float


def normalise(text: str) -> tuple[bytes, int]:
    """The lower-case words of a text joined by single spaces, and their number."""
    words = text.encode().translate(_TO_WORDS).split()
    return b" ".join(words), len(words)


def places(line: bytes, phrase: str) -> Iterator[int]:
    """The first word's number at each place where a phrase's words stand one after another."""
    padded, wanted, at = b" " + line + b" ", b" " + phrase.encode() + b" ", -1
    word = counted = 0
    while (at := padded.find(wanted, at + 1)) >= 0:
        word += padded.count(b" ", counted, at)
        counted = at
        yield word


def find(line: bytes, notices: list[Notice]) -> list[Hit]:
    """For each notice the hits on whole words, in order; of hits that overlap the one of fewest edits stays, then
    the first, then the shortest."""
    hits = []
    for notice in notices:
        slack, starts = notice.edits, set()
        for offset, seed in notice.seeds:
            at = line.find(seed)
            while at >= 0:
                lo, hi = at - offset - slack, at - offset + slack
                if lo <= 0:
                    starts.add(0)
                space = line.find(b" ", max(0, lo - 1), max(0, hi))
                while space >= 0:
                    starts.add(space + 1)
                    space = line.find(b" ", space + 1, hi)
                at = line.find(seed, at + 1)
        kept: list[tuple[int, int, int]] = []
        verified = ((notice.verified(line, start, stop), start, stop) for start in starts for stop in notice.ends(line, start))
        for edits, start, stop in sorted(v for v in verified if v[0] is not None):
            k = bisect(kept, (start,))
            if (k == 0 or kept[k - 1][1] <= start) and (k == len(kept) or stop <= kept[k][0]):
                kept.insert(k, (start, stop, edits))
        hits += [Hit(notice.label, start, stop, edits, 1 - edits / len(notice.text)) for start, stop, edits in kept]
    return hits


def scan(text: str, base: dict[str, str], notices: list[Notice]) -> tuple:
    line, n_words = normalise(text)
    at = [(word, label) for phrase, label in base.items() for word in places(line, phrase)]
    hits = find(line, notices)
    labels = {label for _, label in at}
    spans = sorted({(line.count(b" ", 0, h.start), line.count(b" ", 0, h.stop) + 1, h.label, h.edits) for h in hits})
    score = max([1.0] * bool(at) + [h.score for h in hits], default=0.0)
    return (
        n_words,
        len(at),
        min(at)[0] if at else None,
        max(at)[0] if at else None,
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {h.label for h in hits})),
        score,
        ",".join(f"{label}:{first}:{last}:{edits}" for first, last, label, edits in spans),
    )


def find_licenses(df: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one per row.

    ``labels`` has the base labels and those of the notices found with errors; ``score`` is 1 less the
    share of wrong letters of the best hit, 0 without any. ``spans`` lists label:first word:word after
    the last:edits. Matches are of whole words, so all letters of their first and last word count. A null or
    empty text has no words and empty labels. Repeated rows and null ids stay; other columns are not
    read. One pass, no shuffle; a text, and its words once more, have to fit a Python worker, and time grows with its length.
    """
    base = BASE if base is None else base
    notices = NOTICES if notices is None else notices

    def make() -> Callable[[list[str]], list[tuple]]:
        ready = [Notice.of(text, label) for text, label in notices.items()]
        return each(lambda text: scan(text, base, ready))

    fields = [*long_fields("n_words", "n_base", "first_word", "last_word"), *string_fields("base_labels", "labels"), T.StructField("score", T.DoubleType()), *string_fields("spans")]
    return map_texts(df, id_col, text_col, make, fields)
