"""Column functions over sequence bodies. Lengths are characters; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabets of the sequence type and cleaning rules.
AMBIGUOUS = "BJOUZX"
PROTEIN_ONLY = "EFILPQXZ"
NUCLEOTIDE = "ATGCUN"
# Fixed value: the factor of the checksum.
CHECKSUM_FACTOR = 0x100000001B3


def removed(text: Column, letters: str) -> Column:
    """``text`` without any of ``letters``, in either case."""
    return F.translate(text, letters.upper() + letters.lower(), "")


def count_of(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are one of ``letters``, in either case."""
    return F.length(text) - F.length(removed(text, letters))


def sequence_type(text: Column) -> Column:
    """'Protein' if any letter occurs that only proteins have, else 'Nucleotide'."""
    return F.when(text.rlike(f"(?i)[{PROTEIN_ONLY}]"), "Protein").otherwise("Nucleotide")


def sequence_kind(text: Column) -> Column:
    """'DNA' or 'RNA' where over nine tenths are nucleotide letters, 'Unknown' for empty, else 'Protein'."""
    nucleotide = count_of(text, NUCLEOTIDE) * 10 > F.length(text) * 9
    return F.when(F.length(text) == 0, "Unknown").when(nucleotide, F.when(count_of(text, "U") > 0, "RNA").otherwise("DNA")).otherwise("Protein")


def gc_percent(text: Column) -> Column:
    """100 * GC / (GC + AT + U); 0 without any of these."""
    gc, all_ = count_of(text, "GC"), count_of(text, "GCATU")
    return F.when(all_ == 0, 0.0).otherwise(100.0 * gc / all_)


def sanitized(text: Column) -> Column:
    """``text`` without ambiguous letters; null if over a tenth of it goes or nothing stays."""
    clean = removed(text, AMBIGUOUS)
    gone = F.length(text) - F.length(clean)
    return F.when((F.length(clean) > 0) & (gone * 10 <= F.length(text)), clean)


def has_ambiguous(text: Column) -> Column:
    return text.rlike(f"(?i)[{AMBIGUOUS}]")


def complexity(text: Column) -> Column:
    """Entropy over 4.32 bits, about those of twenty letters; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0.0).otherwise(entropy(text) / 4.32)


def checksum(text: Column) -> Column:
    """64 bits as a decimal string: byte by byte, the sum so far and the byte are multiplied by a fixed factor."""
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("decimal(3,0)"))
    factor, size = F.lit(CHECKSUM_FACTOR).cast("decimal(13,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    step = lambda acc, b: (((acc + b) * factor) % size).cast("decimal(20,0)")
    return F.aggregate(octets, F.lit("0").cast("decimal(20,0)"), step).cast("string")


def export_similarity(a: Column, b: Column) -> Column:
    """3-mer Jaccard; 0 if the lengths differ by over a fifth of the longer; equality for texts under 3 letters."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    close = (longer - shorter) * 5 <= longer
    return F.when(~close, 0.0).when(shorter < 3, (a == b).cast("double")).otherwise(jaccard(kmers(a, 3), kmers(b, 3)))


def upper(text: Column) -> Column:
    """A to Z only, so that no letter becomes two."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def complement(text: Column) -> Column:
    return F.translate(text, "ATGCatgc", "TACGTACG")


def reverse_complement(text: Column) -> Column:
    return F.reverse(complement(text))


def wrapped(text: Column, width: int = 80) -> Column:
    """Lines of ``width`` characters, without a line end after the last."""
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def letters(text: Column) -> Column:
    """The characters as an array; empty for an empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, 0 for an empty text.

    Each distinct character is counted by what its removal takes from the length.
    """
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    shares = F.transform(F.array_distinct(letters(text)), share)
    return F.aggregate(shares, F.lit(0.0), lambda h, p: h - p * F.log2(p))


def normalised_entropy(text: Column) -> Column:
    """Entropy over log2 of the length; 1 for a single character, 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(entropy(text) / F.log2(n.cast("double")))


def kmers(text: Column, k: int) -> Column:
    """The distinct substrings of length ``k``; an empty array for shorter texts.

    One pass of a pattern that looks ahead ``k`` characters and takes one; substrings by place would walk
    the text anew for each.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}})).")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def positional_identity(a: Column, b: Column) -> Column:
    """Equal characters at equal places over the longer length; 0 if the lengths differ by over half."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    equal = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x == y), lambda same: same))
    return F.when((longer == 0) | ((longer - shorter) * 2 > longer), 0.0).otherwise(equal / longer)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
