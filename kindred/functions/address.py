"""Guesses from addresses: postal code, city and street number. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.text import PUNCTUATION, bound

# Words that a city does not begin with.
UNIT_WORDS = ("unit", "suite", "apt", "apartment", "block")
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(c: Column) -> Column:
    """Without white space at the ends, by Unicode."""
    return F.regexp_replace(c, EDGES, "")


def postal_code(raw: Column) -> Column:
    """The first run of five digits that stands alone (or with four more after a hyphen), else the first of six."""
    five = F.regexp_extract(raw, r"(?U)\b(\d{5})(?:-\d{4})?\b", 1)
    six = F.regexp_extract(raw, r"(?U)\b(\d{6})\b", 1)
    return F.when(five != "", five).otherwise(six)


def street_number(address: Column) -> Column:
    """The digits that the first word begins with."""
    return F.regexp_extract(address, r"^(\d+)", 1)


def city(raw: Column, words: Column, postal: Column) -> Column:
    """The part before the one that holds the postal code, else the last but one; failing that, a word."""
    return bound(F.struct(raw.alias("raw"), words.alias("words"), postal.alias("postal")), lambda s: _city(s["raw"], s["words"], s["postal"]))


def _city(raw: Column, words: Column, postal: Column) -> Column:
    parts = F.filter(F.transform(F.split(raw, ","), stripped), lambda p: p != "")
    many = F.size(parts) >= 2
    with_code = F.array_position(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.contains(p, postal)), True).cast("int")
    place = F.when(many & (postal != ""), with_code).otherwise(0)
    part = F.when(many, F.coalesce(F.try_element_at(parts, F.nullif(place, F.lit(0))), F.try_element_at(parts, F.lit(-2))))
    plain = stripped(F.translate(F.lower(part), PUNCTUATION, ""))
    good = part.isNotNull() & (plain != "") & ~plain.rlike(r"(?U)\d") & ~plain.rlike(rf"^(?:{'|'.join(UNIT_WORDS)}) ")
    at = F.when(postal != "", F.array_position(words, postal).cast("int")).otherwise(0)
    before = F.when(at > 1, F.try_element_at(words, at - 1))
    last = F.try_element_at(F.filter(words, lambda w: ~w.rlike(r"^\d+$") & (F.length(w) > 2)), F.lit(-1))
    return F.when(good, plain).otherwise(F.coalesce(before, last, F.lit("")))
