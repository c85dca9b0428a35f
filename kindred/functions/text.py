"""Column functions that clean names and addresses. All are native expressions that stay in whole-stage codegen,
but for those that return arrays."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that become more than one ASCII letter, or that have no decomposition.
EXPANSIONS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "'n"}
SINGLE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "ĸ": "k", "ŋ": "n", "Ŋ": "N", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": " ", "\xa0": " ", "ª": "a", "º": "o"}
# Legal forms of companies.
LEGAL_FORMS = ("corp", "corporation", "inc", "incorporated", "ltd", "limited", "pvt", "private", "llc", "llp", "sarl", "sas", "co")
# Short forms of street words.
STREET_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "ct": "court", "pkwy": "parkway", "sq": "square", "pl": "place", "hwy": "highway",
}
PUNCTUATION = string.punctuation
WHITE = r"[\s\x1c-\x1f]+"


def latin_letters() -> tuple[str, str]:
    """Accented Latin letters and their bases, from the Unicode decompositions."""
    pairs = dict(SINGLE)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c not in EXPANSIONS and len(base) == 1 and base.isascii():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


LATIN_FROM, LATIN_TO = latin_letters()


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda a column expression is computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def known(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    """Whether a text is null or holds white space only, by Unicode."""
    return F.coalesce(~c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def is_non_ascii(c: Column) -> Column:
    """Whether a text has a code point over 127 (P5)."""
    return F.coalesce(c.rlike(r"[^\x00-\x7F]"), F.lit(False))


def fold(c: Column) -> Column:
    """Latin letters without accents, in ASCII (N1). Other scripts: functions.scripts. A text of as many bytes as letters has none to fold."""
    folded = c
    for letter, text in EXPANSIONS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(text))
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(folded, LATIN_FROM, LATIN_TO))


def spell_ampersand(c: Column) -> Column:
    return F.replace(c, F.lit("&"), F.lit(" and "))


def strip_leading(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^\w]+", "")


def blank_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, " " * len(PUNCTUATION))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE, " "))


def normalized_name(folded: Column) -> Column:
    """N2 to N7 of a text in ASCII."""
    return collapse(blank_punctuation(strip_leading(spell_ampersand(F.lower(folded)))))


def normalized_text(folded: Column) -> Column:
    """N2, N3, N5, N6 of an address in ASCII (A1 to A4)."""
    return collapse(blank_punctuation(spell_ampersand(F.lower(folded))))


def tokens(normal: Column) -> Column:
    """Words in order, repeats kept; none of an empty text."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def without_legal_forms(normal: Column) -> Column:
    """The name without legal forms, wherever they stand."""
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), normal), rf" (?:{'|'.join(LEGAL_FORMS)})(?= |$)", ""))


def char_grams(normal: Column, n: int = 3) -> Column:
    """Runs of n characters of the padded text, in order, repeats kept."""

    def runs(text: Column) -> Column:
        padded = F.concat(F.lit(" "), text, F.lit(" "))
        many = F.length(text) + 3 - n
        every = F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(padded, i, n))
        return F.when(text == "", F.array().cast("array<string>")).when(many < 1, F.array(padded)).otherwise(every)

    return bound(normal, runs)


def expand_street_words(normal: Column) -> Column:
    """Short street words in full, word by word (A5). Spaces are doubled meanwhile, so that each word has its own on either side."""
    wide = F.concat(F.lit(" "), F.replace(normal, F.lit(" "), F.lit("  ")), F.lit(" "))
    for short, full in STREET_WORDS.items():
        wide = F.replace(wide, F.lit(f" {short} "), F.lit(f" {full} "))
    return F.replace(F.regexp_replace(wide, "^ | $", ""), F.lit("  "), F.lit(" "))
