"""Sequence, quality and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_distance(length: Column, per10: float = 1) -> Column:
    """Edits allowed between molecule identifiers: one for every ten bases begun, times ``per10``, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.ceil(length / 10) * per10)).cast("long")


def max_distance_floor(length: Column, per10: float = 1) -> Column:
    """Edits allowed in probe sequences: one for every ten full bases, times ``per10``, at least 1."""
    return F.greatest(F.lit(1), F.floor(length * per10 / 10)).cast("long")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def phred_probabilities(quality: Column, base: int = 33) -> Column:
    """Error probability of each letter of a quality string."""
    letters = F.filter(F.split(quality, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.pow(F.lit(10.0), -(F.ascii(c) - base) / 10.0))


def two_bit(seq: Column) -> Column:
    """A, C, G, T as two bits a base, the last base lowest; sequences of up to 31 bases, other letters as A."""
    digits = F.translate(seq, "ACGT", "0123")
    return F.conv(F.regexp_replace(digits, "[^0-3]", "0"), 4, 10).cast("long")


def hamming_encoded(a: Column, b: Column) -> Column:
    """Positions at which two ``two_bit`` codes differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))


def substitutions(seq: Column, bases: str = "ACGT") -> Column:
    """All sequences of one substitution, as an array (the sequence itself is not among them)."""
    at = F.sequence(F.lit(1), F.length(seq))
    letters = F.array(*[F.lit(b) for b in bases])
    made = F.flatten(F.transform(at, lambda i: F.transform(letters, lambda b: F.concat(seq.substr(F.lit(1), i - 1), b, seq.substr(i + 1, F.length(seq))))))
    return F.array_distinct(F.filter(made, lambda s: s != seq))


def int_to_hash(n: Column, length: int = 7) -> Column:
    """First hex digits of SHA-1 over a number's big-endian bytes (at least one)."""
    digits = F.hex(n)
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.substring(F.sha1(F.unhex(even)), 1, length)


def strip_suffix(barcode: Column) -> Column:
    """A barcode without its ``-N``."""
    return F.split_part(barcode, F.lit("-"), F.lit(1))


def bin_coordinates(barcode: Column) -> Column:
    """struct(resolution, row, col) of a spatial bin's name ``s_RRRum_YYYYY_XXXXX``; nulls where it is none."""
    pattern = r"s_(\d+)um_(\d+)_(\d+)"
    part = lambda i: F.when(barcode.rlike(pattern), F.regexp_extract(barcode, pattern, i)).cast("int")
    return F.struct(part(1).alias("resolution"), part(2).alias("row"), part(3).alias("col"))


def gene_of(probe: Column) -> Column:
    """A probe's gene: its name up to the first blank or underscore."""
    return F.split_part(F.replace(probe, F.lit(" "), F.lit("_")), F.lit("_"), F.lit(1))
