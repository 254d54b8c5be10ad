"""Splitting texts into the pieces that byte-level BPE merges separately."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# The split pattern of the public byte-level vocabularies, as their libraries state it.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The code points with Unicode's White_Space property.
_SPACE = r"\t-\r \x85\xa0  -     　"
# The letters and numbers below U+0100 by general category.
_LETTER_256 = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER_256 = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE_256 = r"\t-\r \x85\xa0"

#: A space at an end of the text, or beside other white space.
_CROSSING = re.compile(r"\A | \Z| \s|[^\S ] ").search
#: What lies between spaces, with the space before it, if any of it lies above U+00FF; neighbours together.
_HIGH = re.compile("(?:\\A| )[^ ]*?[^\x00-\xff][^ ]*(?: [^ ]*?[^\x00-\xff][^ ]*)*").finditer


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to the list of its matches of ``pattern``.

    For the byte-level pattern, what is wholly below U+0100 takes an equal pattern of the standard
    library with that range's classes written out; it is about twice as fast. A space between two characters
    that aren't white space always starts a new match, so texts without other spaces are taken apart there.
    """
    if pattern != BYTE_LEVEL_PATTERN:
        return regex.compile(pattern).findall
    anywhere = regex.compile(pattern.replace(r"\S", f"[^{_SPACE}]").replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]")).findall
    low = re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER_256}]+| ?[{_NUMBER_256}]+| ?[^{_SPACE_256}{_LETTER_256}{_NUMBER_256}]+"
        f"|[{_SPACE_256}]+(?![^{_SPACE_256}])|[{_SPACE_256}]+"
    ).findall
    high = re.compile("[^\x00-\xff]").search

    def split(text: str) -> list[str]:
        if not high(text):
            return low(text)
        if _CROSSING(text):
            return anywhere(text)
        found, at = [], 0
        for part in _HIGH(text):
            found += low(text[at : part.start()])
            found += anywhere(part[0])
            at = part.end()
        return found + low(text[at:])

    return split


class Held:
    """Values for keys, remembered in two generations of ``most`` entries each.

    ``fill`` gives the values of a list of keys that are not held. When the young generation is full
    it becomes the old one, and an old entry that is asked for again becomes young. The limits bound
    memory only; what is not held is worked out again.
    """

    def __init__(self, fill: Callable[[list], list], most: int, longest: int = 64) -> None:
        self.fill, self.most, self.longest = fill, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def prepare(self, keys: set) -> dict:
        """The values of all ``keys``: a dict that holds them and maybe more."""
        young, old = self.young, self.old
        new = keys.difference(young)
        if len(young) + len(new) > self.most and young:
            self.old = old = young
            self.young = young = {}
            new = keys
        again = [k for k in new if k in old]
        young.update(zip(again, map(old.__getitem__, again)))
        missing = sorted(new.difference(old))
        found = dict(zip(missing, self.fill(missing))) if missing else {}
        extra = {k: v for k, v in found.items() if len(k) > self.longest}
        for k in extra:
            del found[k]
        young.update(found)
        return {**young, **extra} if extra else young
