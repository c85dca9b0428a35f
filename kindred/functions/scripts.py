"""Romanisation of scripts other than Latin, for which Spark has no function: an Arrow UDF.

Cyrillic, Greek, Hebrew and Arabic letters have tables (of the common romanisations for English), Hangul syllables are
taken apart by their code points and follow the Revised Romanization, and the letters of Indic scripts and kana are read
from their Unicode names ("DEVANAGARI LETTER KA"), with vowel signs in place of the vowel that a consonant carries.
A letter without any of these, such as a Chinese one, becomes a code of its own (`u6771` and a blank), the same
everywhere, so that no name is emptied and equal names stay equal. Results for such scripts differ from those of other
libraries. Texts in ASCII pass untouched, inside the UDF, because Spark evaluates a UDF for every row even under a
condition.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kindred.functions.text import EXPANSIONS, LATIN_FROM, LATIN_TO

# Letters and their romanisation, script by script; "-" stands for none.
CYRILLIC = "а a б b в v г g д d е e ё e ж zh з z и i й i к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ъ - ы y ь - э e ю iu я ia і i ї i є ie ґ g ў u ј j љ lj њ nj ћ c ђ dj џ dz ѓ g ќ k ѕ dz ә a ғ gh қ q ң ng ө o ұ u ү u һ h"
GREEK = "α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ u φ ph χ kh ψ ps ω o"
HEBREW = "א a ב b ג g ד d ה h ו v ז z ח kh ט t י y כ k ך k ל l מ m ם m נ n ן n ס s ע a פ p ף p צ ts ץ ts ק q ר r ש sh ת t"
ARABIC = "ا a أ a إ i آ a ٱ a ب b ت t ث th ج j ح h خ kh د d ذ dh ر r ز z س s ش sh ص s ض d ط t ظ z ع a غ gh ف f ق q ك k ک k ل l م m ن n ه h ة h و w ؤ w ي y ى a ئ y ی y ء - پ p چ ch ژ zh گ g"
# The parts of Hangul syllables in the order of their code points.
INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h"
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i"
FINALS = "- k k k n n n t l k m l l l p l m p p t t ng t t k t p t"
INDIC = ("DEVANAGARI", "BENGALI", "GUJARATI", "GURMUKHI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA")
# Names of Indic signs that aren't their sound.
SIGNS = {"anusvara": "n", "visarga": "h", "candrabindu": "n"}


def table(text: str) -> dict[str, str]:
    parts = ["" if p == "-" else p for p in text.split()]
    pairs = dict(zip(parts[::2], parts[1::2], strict=True))
    return pairs | {c.upper(): s.capitalize() for c, s in pairs.items() if len(c.upper()) == 1 and c.upper() not in pairs}


LETTERS = table(CYRILLIC) | table(GREEK) | table(HEBREW) | table(ARABIC) | dict(zip(LATIN_FROM, LATIN_TO, strict=True)) | EXPANSIONS
HANGUL = [["" if p == "-" else p for p in part.split()] for part in (INITIALS, VOWELS, FINALS)]


def syllable(c: str) -> str:
    """A Hangul syllable, whose code point counts its parts."""
    initial, rest = divmod(ord(c) - 0xAC00, len(HANGUL[1]) * len(HANGUL[2]))
    vowel, final = divmod(rest, len(HANGUL[2]))
    return HANGUL[0][initial] + HANGUL[1][vowel] + HANGUL[2][final]


def named(c: str, name: str) -> str:
    """The sound in the Unicode name of an Indic letter or sign, or of kana; empty if it has none."""
    word = name.rsplit(" LETTER ", 1)[-1].rsplit(" SIGN ", 1)[-1].split()[-1].lower()
    word = SIGNS.get(word, word).replace("aa", "a").replace("ii", "i").replace("uu", "u")
    return word if word.isascii() and word.isalpha() else ""


@lru_cache(4096)
def romanised(c: str) -> tuple[str, bool, bool]:
    """The romanisation of a character, whether it is a consonant that carries an a, and whether it takes that a away."""
    if c.isascii():
        return c, False, False
    if c in LETTERS:
        return LETTERS[c], False, False
    if "가" <= c <= "힣":
        return syllable(c), False, False
    name, category = unicodedata.name(c, ""), unicodedata.category(c)
    if category == "Nd":
        return str(unicodedata.digit(c)), False, False
    if name.startswith(INDIC):
        if " SIGN VIRAMA" in name:
            return "", False, True
        if " VOWEL SIGN " in name:
            return named(c, name), False, True
        if " LETTER " in name or any(s in name.lower() for s in SIGNS):
            sound = named(c, name)
            return sound, len(sound) > 1 and sound.endswith("a") and " LETTER A" not in name, False
    if name.startswith(("HIRAGANA LETTER", "KATAKANA LETTER")):
        return named(c, name), False, False
    base = unicodedata.normalize("NFKD", c)
    plain = "".join(LETTERS.get(x, x) for x in base if not unicodedata.combining(x))
    ascii_ = plain.encode("ascii", "ignore").decode()
    if ascii_ or category[0] != "L":
        return ascii_ or (" " if category[0] == "Z" else ""), False, False
    return f"u{ord(c):x} ", False, False


def to_ascii(text: str) -> str:
    """The text in ASCII letters; marks and symbols without a romanisation are dropped."""
    if text.isascii():
        return text
    out: list[str] = []
    carries = False
    for c in unicodedata.normalize("NFC", text):
        letters, next_carries, takes = romanised(c)
        if takes and carries and out:
            out[-1] = out[-1][:-1]
        out.append(letters)
        carries = next_carries
    return "".join(out)


@F.pandas_udf(StringType())
def _to_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(to_ascii, na_action="ignore")


def fold_all(c: Column) -> Column:
    """As text.fold, for every script."""
    return _to_ascii(c)
