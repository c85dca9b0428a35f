"""A training corpus out of raw documents: five stages, each over all that the one before has kept.

1. toxicity: documents that the network (trained on the labelled ones) predicts toxic go.
2. exact_dedup: of documents equal after white space is normalised, the smallest id stays.
3. jaccard_join: of near duplicates (five-word shingles, similarity 0.75), the smallest id of a component stays.
4. mixing: sources are drawn to tempered weights; a document drawn in several epochs stands once for each.
5. bpe: texts become ids; the result has their digests.

Each stage is written as Parquet to the shared folder and read again by the next. Nulls, empty texts, repeated rows
and extra columns are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import bpe_codec, exact_dedup, jaccard_join, mixing, toxicity
from kindred.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.round_trip(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: The first stage is a trained network, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
