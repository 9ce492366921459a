"""Classes of sequence symbols, strands and composition, as Column expressions.

Symbols are bytes: A C G T in either case are bases, N in either case is unknown, ten further letters in either case stand
for several bases, line feed and carriage return mean nothing, and everything else, U included, is invalid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of nucleotide codes.
BASES = "ACGT"
UNKNOWN = "N"
AMBIGUOUS = "RYSWKMBDHV"
IGNORED = (10, 13)


def occurrences(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters`` (ASCII): one pass, inside generated code."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def either(letters: str) -> str:
    return letters + letters.lower()


def folded(text: Column) -> Column:
    """ASCII lower case becomes upper case. Not upper(): that changes the length of some texts."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def symbol_class(byte: Column) -> Column:
    """base, unknown, ambiguous, ignored or invalid, by byte value."""
    codes = lambda letters: [ord(c) for c in either(letters)]
    return (
        F.when(byte.isin(codes(BASES)), "base").when(byte.isin(codes(UNKNOWN)), "unknown").when(byte.isin(codes(AMBIGUOUS)), "ambiguous").when(byte.isin(*IGNORED), "ignored").otherwise("invalid")
    )


def byte_name(byte: Column) -> Column:
    """A printable byte by its character, any other as \\xNN."""
    return F.when(byte.between(32, 126), F.chr(byte)).otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(byte), 2, "0"))))


def reverse_complement(pattern: Column) -> Column:
    return F.reverse(F.translate(pattern, "ACGTacgt", "TGCAtgca"))


def overlapping(text: Column, pattern: str) -> Column:
    """Overlapping matches of ``pattern`` in folded ``text``; N in the pattern stands for any base."""
    parts = "".join("[ACGT]" if c == "N" else c for c in pattern)
    return F.regexp_count(text, F.lit(f"(?={parts})")).cast("long")


def row_of(position: Column, width: int = 80) -> Column:
    return F.floor(position / width).cast("long") + 1


def column_of(position: Column, width: int = 80) -> Column:
    return F.pmod(position, F.lit(width)).cast("int") + 1


def rows_of(length: Column, width: int = 80) -> Column:
    return F.ceil(length / width).cast("long")


def difference_class(a: Column, b: Column) -> Column:
    """case_only before with_unknown before real: the first that holds for two different symbols."""
    n = lambda c: F.translate(c, "n", "N") == "N"
    return F.when(folded(a) == folded(b), "case_only").when(n(a) | n(b), "with_unknown").otherwise("real")


def similarity(differences: Column, compared: Column) -> Column:
    """Percent of equal positions; 0 where the count of differences can't be right or nothing was compared."""
    valid = (differences >= 0) & (differences <= compared) & (compared > 0)
    return F.when(valid, F.round(100 * (compared - differences) / compared, 6)).otherwise(F.lit(0.0))


def header_fields(header: Column) -> dict[str, Column]:
    """identifier, description and chromosome of a record's header line (without its mark)."""
    number = F.regexp_extract(header, r"(?i)chromosome (\d{1,2}|[XY]),.*primary assembly", 1)
    chromosome = F.when(number != "", folded(number)).when(F.lower(header).contains("mitochondrion"), "MT")
    return {"identifier": F.split(header, " ", 2)[0], "description": F.coalesce(F.get(F.split(header, " ", 2), F.lit(1)), F.lit("")), "chromosome": chromosome}


def natural_order(key: Column) -> list[Column]:
    """Numbers by value, then X, Y, MT, then all else by name."""
    number = key.try_cast("int")
    place = F.when(number.isNotNull(), 0).when(key == "X", 1).when(key == "Y", 2).when(key == "MT", 3).otherwise(4)
    return [place, F.coalesce(number, F.lit(0)), key]
