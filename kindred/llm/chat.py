"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, as turns `<|im_start|>role`, a line end, the text, `<|im_end|>`, a line end. It
is encoded once, with the offsets of its tokens; the sorted spans of the assistant's texts meet the sorted token
spans by binary search, and the tokens found are the loss mask. Where a token reaches over a border, the mask in
characters is cut at the border.

Control strings inside texts (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`) are escaped by a backslash after their first
character, and one more where such backslashes stand there already, which `unescaped` takes back exactly.

Rows are dealt by conversation and sorted inside each partition, then rendered as a stream. Defined results: null
text and role count as empty; turns of a conversation go by turn (null first), then role, then text, and repeated
rows are repeated turns; rows without conv_id are conversations of one turn each, so that they need not meet; an
empty table gives an empty result. Extra columns are not read. A conversation is held in memory whole.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import in_arrow, partitions

VOCABULARY = "byte_bpe_50k.json"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"(?=\||/?s>|/?INST\])"
#: Characters that are encoded together.
BATCH_CHARS = 1 << 17


def escaped(text: str) -> str:
    return re.sub(r"([<\[]\\*)" + CONTROL, r"\1\\", text)


def unescaped(text: str) -> str:
    return re.sub(r"([<\[]\\*)\\" + CONTROL, r"\1", text)


def escaped_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped_role(role)}\n", escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        turns.append((unescaped_role(formatted[at + len(OPEN) : line]), unescaped(formatted[line + 1 : end])))
        at = end + len(CLOSE)
    return turns


@lru_cache(1)
def encoder(path: str):
    """The library's encoder, in the task's own thread: its pool would take other tasks' cores and memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The loss mask over tokens, and the character spans under it, cut at the borders of the turns."""
    mask, chars = np.zeros(len(offsets), bool), []
    starts, ends = (offsets[:, 0], offsets[:, 1]) if len(offsets) else (np.zeros(0, int), np.zeros(0, int))
    for start, end in spans:
        low, high = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(starts, end, "left"))
        if low >= high or start == end:
            continue
        mask[low:high] = True
        a, b = np.maximum(starts[low:high], start), np.minimum(ends[low:high], end)
        cuts = np.flatnonzero(a[1:] > np.maximum.accumulate(b)[:-1]) + 1
        chars += [(int(x[0]), int(y.max())) for x, y in zip(np.split(a, cuts), np.split(b, cuts), strict=True)]
    return mask, chars


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Whole conversations out of rows sorted by conversation."""
    key, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
            if turns and (conv is None or conv != key):
                yield key, turns
                turns = []
            key = conv
            turns.append((role or "", text or ""))
    if turns:
        yield key, turns


def format_conversations(rows: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each conversation: conv_id, formatted, tokens, loss_mask (a byte for each token), loss_spans (of characters)."""
    path = path or public_tokenizers.path(VOCABULARY)
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    dealt = rows.select(*[rows[c].alias(c) for c in ("conv_id", "turn", "role", "text")]).repartition(partitions(rows.sparkSession), "conv_id", lone).sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "formatted", "tokens", "loss_mask", "loss_spans"]

    def packed(group: list[tuple]) -> pa.RecordBatch:
        rendered = [render(turns) for _, turns in group]
        ids, masks, chars = [], [], []
        for encoding, (_, spans) in zip(encoder(path).encode_batch([t for t, _ in rendered], add_special_tokens=False), rendered, strict=True):
            mask, covered = masked(np.fromiter(itertools.chain.from_iterable(encoding.offsets), np.int64).reshape(-1, 2), spans)
            ids.append(np.array(encoding.ids, "<u4").tobytes())
            masks.append(mask.astype(np.uint8).tobytes())
            chars.append([x for span in covered for x in span])
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in group], pa.int64()), pa.array([t for t, _ in rendered], pa.string()), pa.array(ids, pa.binary()), pa.array(masks, pa.binary()), pa.array(chars, pa.list_(pa.int64()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for conv, turns in conversations_of(batches):
            group.append((conv, turns))
            size += sum(len(t) for _, t in turns)
            if size >= BATCH_CHARS or len(group) >= 2048:
                yield packed(group)
                group, size = [], 0
        if group:
            yield packed(group)

    return dealt.transform(in_arrow, run, "conv_id long, formatted string, tokens binary, loss_mask binary, loss_spans array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the query returns, read back from the formatted text and the loss spans."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, flat in zip(*[batch.column(c).to_pylist() for c in ("formatted", "loss_spans")], strict=True):
                turns = read_back(text)
                loss = "".join(unescaped(text[a:b]) for a, b in zip(flat[::2], flat[1::2], strict=True))
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(list(c), pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names[1:], columns, strict=True)]], names)

    return formatted.transform(in_arrow, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts hold control strings."""
    spark = conversations.sparkSession
    rows = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(OPEN) + 1 + len(CLOSE)} + length(role) + len(regexp_extract_all(role, '[\\\n<]'))
           + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\])')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
