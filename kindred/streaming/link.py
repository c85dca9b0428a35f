"""Linking as records arrive: a stateless normalization, and a join of the stream with the known records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kindred.operators.golden import golden_join
from kindred.operators.normalize import FIELDS, normalize

NATIVE = tuple(f for f in FIELDS if f != "name_phonetic")


def record_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New Parquet files of records under a path."""
    return spark.readStream.schema(schema).parquet(path)


def golden_stream(stream: DataFrame, known: DataFrame) -> DataFrame:
    """s1_id, match_id of arriving records against normalized known ones. A stream-static join: it keeps no state."""
    return golden_join(known, normalize(stream, only=NATIVE))
