"""The corpus queries by name, with production parameters, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
from kindred.llm import bpe_codec, chat, exact_dedup, jaccard_join, lm_scoring, max_score, mixing, token_counts, toxicity, warc
from kindred.llm.common import scratch, table


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    return chat.digests(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_warc(spark, sf_dir):
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.digests(warc.read_archives(spark, path))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_max_score(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return max_score.top_k(vectors, vectors.where(f"vec_id % {max_score.EVERY} = 0"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark, sf_dir):
    return bpe_codec.digests(bpe_codec.round_trip(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_counts(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_token_counts, op2_chat_format, op3_warc, op4_mixing, op5_max_score, op6_toxicity, op7_lm_scoring, op8_exact_dedup, op9_bpe_codec, op10_jaccard_join, pipeline)}


def oracle_sql():
    return {"op2_chat_format": chat.ORACLE, "op4_mixing": mixing.ORACLE, "op5_max_score": max_score.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
