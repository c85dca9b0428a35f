"""Token counts and the codec against the libraries whose results they must equal."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from kindred.llm import bpe, bpe_codec, token_counts

ALPHABET = list("'''strevmlld   \n\t\xa0\x85\x1cabcXYZéß12½!?-_中文🙂​　")
ROWS = [(1, None), (2, ""), (3, " "), (4, "a <|endoftext|> b  \n"), (5, "it's 'SS 'll  x"), (5, "it's 'SS 'll  x"), (None, "null id"), (6, "x" * 20_000 + " " * 5_000 + "é🙂" * 3_000)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_pattern():
    random.seed(1)
    pattern = regex.compile(P.PATTERN)
    for size in [20] * 300 + [3000] * 5:
        texts = ["".join(random.choices(ALPHABET, k=random.randint(0, size))) for _ in range(3)]
        found, many = bpe.pieces(texts)
        expected = [pattern.findall(t) for t in texts]
        assert found == [p for e in expected for p in e] and many.tolist() == [len(e) for e in expected]


def test_prefix_scan_composes_as_a_loop_does():
    maps = np.random.default_rng(0).integers(0, 12, (37, 12))
    state, ends = np.arange(12), []
    for m in maps:
        state = m[state]
        ends.append(state)
    assert (bpe.compose(maps) == np.array(ends)).all()


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.token_counts(docs).collect()), key=repr)
    sizes = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS]
    assert got == sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(ROWS, sizes)), key=repr)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_codec_equals_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in ROWS], "doc_id long, text string, ids string, decoded int")
    got = sorted(map(tuple, bpe_codec.digests(bpe_codec.round_trip(docs)).collect()), key=repr)
    assert bpe_codec.digests(bpe_codec.round_trip(docs.limit(0))).collect() == []
    ids = [library.encode_ordinary(t or "") for _, t in ROWS]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(((i, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for (i, t), x in zip(ROWS, ids)), key=repr)


def test_random_texts_encode_alike(library):
    random.seed(2)
    path = P.path("byte_bpe_50k.tiktoken")
    texts = ["".join(random.choices("aaabbcde .,thinger\n中é'", k=random.randint(0, 80))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe_codec.encode(texts, path)] == [library.encode_ordinary(t) for t in texts]


def test_utf8_stream_holds_back_open_characters():
    data = "aé中🙂z".encode() + b"\xff\xe4\xb8 \xf0\x9f"
    for step in range(1, 6):
        stream = bpe_codec.Utf8Stream()
        text = "".join(stream.feed(data[k : k + step]) for k in range(0, len(data), step)) + stream.finish()
        assert text == data.decode("utf-8", "replace")
