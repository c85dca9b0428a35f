"""The pipeline's stages, each against a plain computation on its own input."""

import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline as C
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from test_jaccard_join import brute

from kindred.llm import mixing, toxicity

DATA = "/root/testdata/sf0.001"


def by_id(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r.predicted}
    stages = dict(C.STAGES)
    one = C.written(stages["toxicity"](spark, docs, DATA), "one")
    assert one.columns == docs.columns and set(by_id(one)) == set(by_id(docs)) - toxic
    two = C.written(stages["exact_dedup"](spark, one, DATA), "two")
    first = {}
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert two.columns == docs.columns and by_id(two) == {r.doc_id: r for r in first.values()}
    three = C.written(stages["jaccard_join"](spark, two, DATA), "three")
    want = {i for i, _, c in brute([(r.doc_id, r.text) for r in two.collect()]) if i == c}
    assert three.columns == docs.columns and by_id(three) == {i: r for i, r in by_id(two).items() if i in want}
    four = C.written(stages["mixing"](spark, three, DATA), "four")
    db = duckdb.connect()
    db.register("documents", pa.table({c: [r[c] for r in three.collect()] for c in docs.columns}))
    draws = Counter(r[0] for r in db.execute(f"SELECT doc_id FROM ({mixing.ORACLE})").fetchall())
    assert four.columns == docs.columns and Counter(r.doc_id for r in four.collect()) == draws and set(draws) <= want
    assert all(r == by_id(three)[r.doc_id] for r in four.limit(50).collect())
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(w): int(k) for w, k in (line.split() for line in open(path, "rb"))}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    expected = [(r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())) for r in four.collect() for ids in [library.encode_ordinary(r.text or "")]]
    assert sorted(map(tuple, stages["bpe"](spark, four, DATA).collect())) == sorted(expected)


def test_odd_rows_pass_through(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "a b c", None, "a", 5), (3, "a b c", None, "a", 5), (4, "A  b c", "en", "b", 5), (5, "word " * 30_000, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, n_tokens int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (docs, docs.limit(0)):
        for _, stage in C.STAGES[:-1]:
            some = C.written(stage(spark, some, str(tmp_path)), "odd")
            assert some.columns == docs.columns
        C.STAGES[-1][1](spark, some, str(tmp_path)).collect()


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stage_names_are_unique(name):
    assert sum(n == name for n, _ in C.STAGES) == 1
