"""Byte-level BPE encoding and streaming decoding (see bpe.py for the transducer).

Encoding: each piece of the split pattern goes through the lazily determinised transducer, which emits ids after a
bounded lookahead; a worker remembers the ids of pieces it has met. Decoding: ids are turned into bytes a run at a
time, and `Utf8Stream`, an incremental UTF-8 state machine, lets out whole characters and holds back the bytes of
an unfinished one, so that a text can be decoded as its ids arrive.

Defined results: a null text counts as empty, with no ids; a null id stays null; rows that repeat are encoded each.
Special strings are ordinary text. Bytes that are not UTF-8 decode to U+FFFD. Extra columns are not read. An empty
table gives an empty result. Work and memory follow the text: a slice of about a MB of texts, or one longer text whole.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import in_arrow, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Ids that the decoder turns into bytes at a time.
RUN = 4096


class Utf8Stream:
    """An incremental decoder. The state is the number of bytes that the open character still needs."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def needs(lead: int) -> int:
        return 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0

    @staticmethod
    def may_follow(lead: int, second: int) -> bool:
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
        return low <= second <= high

    def open_bytes(self, data: bytes) -> int:
        """How many bytes at the end belong to a character that is not complete yet."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # the last lead byte or ASCII byte
                open_ = self.needs(byte) >= back and (back == 1 or self.may_follow(byte, data[1 - back]))
                return back if open_ else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.open_bytes(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


@lru_cache(1)
def codec(path: str) -> tuple[bpe.Memo, list[bytes]]:
    machine = bpe.from_ranks(path)
    memo = bpe.Memo(lambda piece: np.array(machine.encode(piece), "<u4").tobytes())
    gc.freeze()
    return memo, [t or b"" for t in machine.tokens]


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers."""
    memo, _ = codec(path)
    found, many = bpe.pieces(texts)
    ids = map(memo.__getitem__, found)
    return [b"".join(itertools.islice(ids, n)) for n in many.tolist()]


def decode(ids: bytes, path: str) -> Iterable[str]:
    """The text of packed ids, run by run."""
    _, tokens = codec(path)
    stream, numbers = Utf8Stream(), np.frombuffer(ids, "<u4")
    for k in range(0, len(numbers), RUN):
        yield stream.feed(b"".join([tokens[i] for i in numbers[k : k + RUN].tolist()]))
    yield stream.finish()


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), decoded (the text of those ids), for each row."""
    path = path or public_tokenizers.path(RANKS)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = encode([t or "" for t in batch.column("text").to_pylist()], path)
            texts = ["".join(decode(x, path)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.transform(in_arrow, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """What the query returns of `round_trip`."""
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
