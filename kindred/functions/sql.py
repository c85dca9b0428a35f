"""The engine's functions for Spark SQL: temporary functions of a session, native ones as SQL expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kindred.functions import phonetic, scripts, similarity

NATIVE = {
    "f_beta(truths BIGINT, guesses BIGINT, hits BIGINT, beta DOUBLE) RETURNS DOUBLE": "CASE WHEN truths = 0 AND guesses = 0 THEN 1D WHEN hits = 0 THEN 0D ELSE (1 + beta * beta) * hits / (beta * beta * truths + guesses) END",
    "edit_similarity(a STRING, b STRING) RETURNS DOUBLE": "coalesce(1 - try_divide(levenshtein(a, b), greatest(length(a), length(b))), 1D)",
    "set_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0D)",
    "id_list(cell STRING) RETURNS ARRAY<STRING>": "array_distinct(filter(transform(split(coalesce(cell, ''), ','), x -> trim(x)), x -> x <> ''))",
}


def register(spark: SparkSession) -> list[str]:
    """Makes double_metaphone, to_ascii, jaro_winkler, f_beta, edit_similarity, set_jaccard and id_list callable from SQL. Their names."""
    phonetic.register(spark)
    spark.udf.register("to_ascii", scripts._to_ascii)
    spark.udf.register("jaro_winkler", similarity._jaro_winkler)
    for head, body in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["double_metaphone", "to_ascii", "jaro_winkler", *[h.split("(")[0] for h in NATIVE]]
