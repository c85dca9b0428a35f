"""Features of candidate pairs, including TF-IDF weights of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as T
from kindred.operators.blocking import weight

NATIVE = ("token_jaccard", "gram_jaccard", "edit", "acronym", "address_overlap", "same_postal", "same_city", "same_number", "missing")


def weights(records: DataFrame, words: str = "name_tokens_no_suffix", ident: str = "entity_id") -> DataFrame:
    """id, word, weight: inverse document frequency of each distinct word, ln((n + 1) / (df + 1)) + 1."""
    spread = records.select(F.col(ident).alias("id"), weight(records).alias("size"), F.explode(F.array_distinct(words)).alias("word"))
    total = records.agg(F.sum(weight(records)).alias("n"))
    df = spread.groupBy("word").agg(F.sum("size").alias("df"))
    idf = df.join(F.broadcast(total)).select("word", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("weight"))
    return spread.join(idf, "word").select("id", "word", "weight")


def cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs with `cosine` of their weighted words (F4): words of the pairs' own records only, then sums."""
    norm = lambda w, x: w.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"norm_{x}")).withColumnRenamed("id", x)
    a, b = (w.select(F.col("id").alias(x), "word", F.col("weight").alias(f"w_{x}")) for w, x in ((left, "s1_id"), (right, "match_id")))
    ids = pairs.select("s1_id", "match_id").distinct()
    dot = ids.join(a, "s1_id").join(b, ["match_id", "word"]).groupBy("s1_id", "match_id").agg(F.sum(F.col("w_s1_id") * F.col("w_match_id")).alias("dot"))
    out = pairs.join(dot, ["s1_id", "match_id"], "left").join(norm(left, "s1_id"), "s1_id", "left").join(norm(right, "match_id"), "match_id", "left")
    return out.withColumn("cosine", F.coalesce(F.try_divide("dot", F.col("norm_s1_id") * F.col("norm_match_id")), F.lit(0.0))).drop("dot", "norm_s1_id", "norm_match_id")


#: The normalized fields that each feature reads.
READS = {
    "token_jaccard": ("name_tokens_no_suffix",), "gram_jaccard": ("normalized_name",), "edit": ("normalized_name",), "acronym": ("name_tokens_no_suffix",), "address_overlap": ("address_tokens",),
    "same_postal": ("postal_code_guess",), "same_city": ("city_guess",), "same_number": ("street_number_guess",), "missing": ("name_missing", "address_missing", "postal_missing", "city_missing"), "jaro_winkler": ("normalized_name",),
}


def read_by(names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(f for n in names for f in READS[n]))


def features(pairs: DataFrame, left: DataFrame, right: DataFrame, names: tuple[str, ...] = (*NATIVE, "jaro_winkler"), also: tuple[str, ...] = ()) -> DataFrame:
    """s1_id, match_id and the named features of each pair (F1 to F3, F5 to F7). Only the fields that they read travel, and those of the left record that come out `also`."""
    fields = read_by(names)
    sets = tuple(f for f in fields if f == "address_tokens")  # once a record, not once a pair
    side = lambda df, ident, x, *more: df.select(F.col("entity_id").alias(ident), F.struct(*[F.array_distinct(f).alias(f) if f in sets else f for f in fields]).alias(x), *more)
    both = pairs.select("s1_id", "match_id").join(side(left, "s1_id", "a", *also), "s1_id").join(side(right, "match_id", "b"), "match_id")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    if "gram_jaccard" in names:  # the grams are many times as long as the name that travels
        both = both.withColumns({f"{x}_grams": F.array_distinct(T.char_grams(F.col(f"{x}.normalized_name"))) for x in "ab"})
    if "token_jaccard" in names:
        both = both.withColumns({f"{x}_words": F.array_distinct(f"{x}.name_tokens_no_suffix") for x in "ab"})
    made: dict = {
        "token_jaccard": S.jaccard(F.col("a_words"), F.col("b_words")),
        "gram_jaccard": S.jaccard(F.col("a_grams"), F.col("b_grams")),
        "edit": S.edit_similarity(a("normalized_name"), b("normalized_name")),
        "acronym": S.acronym_match(a("name_tokens_no_suffix"), b("name_tokens_no_suffix")),
        "address_overlap": S.overlap(a("address_tokens"), b("address_tokens")),
        "same_postal": S.same_known(a("postal_code_guess"), b("postal_code_guess")),
        "same_city": S.same_known(a("city_guess"), b("city_guess")),
        "same_number": S.same_known(a("street_number_guess"), b("street_number_guess")),
        "missing": S.missing_pattern(*[x(f"{c}_missing") for x in (a, b) for c in ("name", "address", "postal", "city")]),
    }
    if "jaro_winkler" in names:
        made["jaro_winkler"] = S.jaro_winkler(a("normalized_name"), b("normalized_name"))
    return both.select("s1_id", "match_id", *also, *[made[n].alias(n) for n in names])
