"""The normalized record: seventeen derived columns beside what the row has (the country in place)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import address as A
from kindred.functions import text as T

FIELDS = (
    "raw_name", "normalized_name", "aggressive_normalized_name", "name_tokens", "name_tokens_no_suffix", "name_phonetic", "name_char_ngrams",
    "raw_address", "normalized_address", "address_tokens", "postal_code_guess", "city_guess", "street_number_guess",
    "name_missing", "address_missing", "postal_missing", "city_missing", "country",
)


def normalize(df: DataFrame, name: str = "business_name", address: str = "business_address", country: str = "country", every_script: bool = True, only: tuple[str, ...] = FIELDS) -> DataFrame:
    """Adds the normalized fields (or only those named). No shuffle.

    every_script romanises all scripts, by an Arrow UDF; without it Latin accents are folded natively and letters of
    other scripts stay as they are (a name loses those that it begins with). The phonetic key is a UDF as well: leave it out of `only` where it isn't needed, and the
    whole projection stays native.
    """
    if every_script:
        from kindred.functions.scripts import fold_all as fold
    else:
        fold = T.fold
    raw_name, raw_address, land = (T.known(df[c]) for c in (name, address, country))
    normal = T.normalized_name(fold(raw_name))
    plain = T.normalized_text(fold(raw_address))
    full = T.expand_street_words(plain)
    staged = df.withColumns({"raw_name": raw_name, "raw_address": raw_address, "normalized_name": normal, "normalized_address": full, "postal_code_guess": A.postal_code(raw_address)})
    aggressive = T.without_legal_forms(F.col("normalized_name"))
    words = T.tokens(F.col("normalized_address"))
    made = {
        "aggressive_normalized_name": aggressive,
        "name_tokens": T.tokens(F.col("normalized_name")),
        "name_tokens_no_suffix": T.tokens(aggressive),
        "name_char_ngrams": T.char_grams(F.col("normalized_name")),
        "address_tokens": words,
        "city_guess": A.city(F.col("raw_address"), words, F.col("postal_code_guess")),
        "street_number_guess": A.street_number(F.col("normalized_address")),
        "name_missing": T.is_blank(raw_name),
        "address_missing": T.is_blank(raw_address),
        "postal_missing": F.col("postal_code_guess") == "",
        "country": A.stripped(land),
    }
    if "name_phonetic" in only:
        from kindred.functions.phonetic import phonetic

        made["name_phonetic"] = phonetic(F.col("normalized_name"))
    wide = staged.withColumns(made).withColumn("city_missing", F.col("city_guess") == "")
    return wide.select(*[c for c in df.columns if c not in FIELDS], *[c for c in FIELDS if c in only])
