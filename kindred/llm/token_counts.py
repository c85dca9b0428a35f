"""Token counts of whole texts by compiled transducers (see bpe.py).

Splitting and merging run as two transducers: chunk maps of the splitting automaton compose by a prefix scan, and
the merge transducer adds up the counts that its transitions carry, once for each distinct piece that a worker
meets. No token is ever built.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; a null id stays null; rows that repeat are
counted each; a special string of the vocabulary inside a text counts as one token and parts the text, which is
the library's default. Work and memory follow the text (a slice of a few MB, or one longer text). Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm import bpe
from kindred.llm.common import in_arrow, lengths, slices

VOCABULARY = "byte_bpe_50k.json"
CONTEXT = 1024
_memo: dict[str, bpe.Memo] = {}


def counter(path: str) -> tuple[bpe.Memo, list[str]]:
    """The worker's counts of pieces by the vocabulary at path, and the vocabulary's special strings."""
    machine, special = bpe.from_json(path)
    if path not in _memo:
        _memo[path] = bpe.Memo(machine.count)
        gc.freeze()
    return _memo[path], sorted(special, key=len, reverse=True)


def count(texts: list[str], path: str) -> np.ndarray:
    memo, special = counter(path)
    extra = np.zeros(len(texts), np.int64)
    whole, owner = texts, None
    if any(s in t for s in special for t in texts):
        whole, owners = [], []
        for k, t in enumerate(texts):
            parts = [t]
            for s in special:
                parts = [p for x in parts for p in x.split(s)]
            extra[k] = len(parts) - 1
            whole += parts
            owners += [k] * len(parts)
        owner = np.array(owners)
    found, many = bpe.pieces(whole)
    sums = np.concatenate([[0], np.cumsum(np.fromiter(map(memo.__getitem__, found), np.int64, len(found)))])
    stops = np.cumsum(many)
    each = sums[stops] - sums[stops - many]
    return extra + (each if owner is None else np.bincount(owner, each, len(texts)).astype(np.int64))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than the context holds), for each row."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text = batch.column("text")
            n = count([t or "" for t in text.to_pylist()], path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths(text)), pa.array(n), pa.array(n > context)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.transform(in_arrow, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
