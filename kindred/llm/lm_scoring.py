"""A smoothed n-gram language model of the whole corpus in sharded Elias-Fano tries, and its scores of whole texts.

Tokens are lower-cased words and one end per text. With c the counts of the training texts, N their sum, V their
number of distinct tokens and p1(w) = (c(w) + 1) / (N + V + 1), the model is a backing-off bigram model:

    p(w | u) = SEEN * c(u, w) / c(u)   if the pair was seen
             = (1 - SEEN) * p1(w)      if u was seen, but not the pair
             = p1(w)                   if u was not seen

whose probabilities sum to at most 1 for every u (c of the beginning is the number of training texts). The trie keeps
log10 of these probabilities and of the back-offs 1 - SEEN in steps of 1 / STEP, rounded down, so that this stays true.

The model grows with the corpus, so it is never gathered, broadcast or cut: it lies in shards, and the texts' n-grams
come to them, counted per slice of text first, so that a frequent word or pair weighs one entry a slice.

1. One pass over the documents cuts them into slices and writes a row for each: what identifies its documents, its
   distinct words (sorted hashes), and its tokens as places among them. Everything later reads these rows, so that
   nothing depends on the order in which an input gives its rows twice.
2. Each slice sends each bucket a partial trie: the words that are at home there (a range of hashes), with their
   counts and their distinct followers. A bucket adds up the partial tries, builds its trie (words with smoothed
   probability and back-off, monotone pointers, followers relative to their context) and looks up what each slice has
   sent: the word by successor search, its followers within the pointers' bounds. The answers go back to the slice.
3. A context with more than half a bucket's load of all tokens is dealt over several buckets by its follower; each
   of them gets the context's count from each slice. These contexts are at most 2 for each bucket.
4. A slice meets its answers, walks its tokens (pair, or back-off and word) and adds up each document.

Words are told apart by 48 bits of hash, the followers of a context by 32. A shard's image lies in an anonymous memory
map: the tries of all shards as files would add more than the input to the disk that this takes. The largest task
holds a bucket's entries, about 1.2 times the input over the number of shuffle partitions: give 100 to a GB.

Defined results: a null text counts as empty (one token, its end); a null id is not held out; rows that repeat count
each; without training texts every probability is p1 with c = N = V = 0; an empty table gives an empty result.
Extra columns are not read. A text is held in memory whole.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import wordhash
from kindred.llm.common import in_arrow, partitions, slices, utf8, written
from kindred.llm.elias_fano import Trie
from kindred.llm.toxicity import held_out

SEEN = 0.7
#: Quantised log10 in steps of 1 / STEP, and its largest code.
STEP, LARGEST = 4096, 65535
SLICE_BYTES, SLICE_ROWS = 2 << 20, 8192
WORD_BITS, FOLLOWER_BITS = 48, 32
U = np.uint64
#: The end of a text as a token, and its beginning as a context: fixed hashes beside those of words.
FINISH, BEGIN = U(0x5EED_0000_0001), U(0xB5EED_0000_002)


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers in `width` bytes, all first bytes first, so that small numbers compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def steps(values: np.ndarray) -> bytes:
    """Sorted word hashes as the differences of neighbours."""
    return planes(np.diff(values, prepend=U(0)), WORD_BITS // 8)


class Reader:
    """Reads packed arrays in the order in which they were joined."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        self.at += 4
        return struct.unpack_from("<I", self.data, self.at - 4)[0]

    def array(self, n: int, width: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = np.frombuffer(self.data, np.uint8, n * width, self.at).reshape(width, n).T
        self.at += n * width
        return out.view("<u8").reshape(-1)

    def words(self, n: int) -> np.ndarray:
        return np.cumsum(self.array(n, WORD_BITS // 8), dtype=U)


class Slice(NamedTuple):
    """Of a slice: its distinct words (BEGIN among them), the place of each token there, tokens and held-out mark of each document."""

    words: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray
    held: np.ndarray


def tokens(part: pa.RecordBatch) -> Slice:
    hashes, counts = wordhash.words(*utf8(part.column("text")))
    ends = np.cumsum(counts + 1) - 1
    every = np.full(len(hashes) + len(counts), FINISH, U)
    inner = np.ones(len(every), bool)
    inner[ends] = False
    every[inner] = hashes >> U(64 - WORD_BITS)
    words, place = np.unique(np.append(every, BEGIN), return_inverse=True)
    return Slice(words, place[:-1], counts + 1, np.asarray(part.column("held_out")))


def packed(s: Slice, ids: pa.Array) -> bytes:
    head = struct.pack("<III", len(s.counts), len(s.words), len(s.tokens))
    known = np.asarray(ids.fill_null(0)).astype(np.int64).view(U)
    return head + planes(known, 8) + planes(np.asarray(ids.is_null()), 1) + planes(s.held, 1) + planes(s.counts, 4) + steps(s.words) + planes(s.tokens, 4)


def unpacked(data: bytes) -> tuple[Slice, np.ndarray, np.ndarray]:
    """The slice, its ids, and which of them are null."""
    r = Reader(data)
    docs, words, many = r.number(), r.number(), r.number()
    ids, nulls, held, counts = r.array(docs, 8).view(np.int64), r.array(docs, 1).astype(bool), r.array(docs, 1).astype(bool), r.array(docs, 4).astype(np.int64)
    return Slice(r.words(words), r.array(many, 4).astype(np.int64), counts, held), ids, nulls


def cut(rows: DataFrame, buckets: int) -> DataFrame:
    """A row for each slice: slice (a number), data, train_tokens, all_tokens, and its heavy contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        for wide in slices(batches, "text", SLICE_BYTES):
            for start in range(0, wide.num_rows, SLICE_ROWS):
                part = wide.slice(start, SLICE_ROWS)
                s = tokens(part)
                often = np.bincount(s.tokens, minlength=len(s.words))
                often[np.searchsorted(s.words, FINISH)], often[np.searchsorted(s.words, BEGIN)] = 0, len(s.counts)
                heavy = np.flatnonzero(often * 4 * buckets >= len(s.tokens))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([first + number], pa.int64()), pa.array([packed(s, part.column("doc_id"))], pa.binary()),
                        pa.array([int(s.counts[~s.held].sum())], pa.int64()), pa.array([len(s.tokens)], pa.int64()),
                        pa.array([s.words[heavy].astype(np.int64)], pa.list_(pa.int64())), pa.array([often[heavy]], pa.list_(pa.int64())),
                    ],
                    ["slice", "data", "train_tokens", "all_tokens", "heavy", "often"],
                )
                number += 1

    return rows.transform(in_arrow, run, "slice long, data binary, train_tokens long, all_tokens long, heavy array<long>, often array<long>")


class Deal(NamedTuple):
    """How many buckets there are, and over how many of them each split context (sorted) is dealt."""

    buckets: int
    split: np.ndarray
    over: np.ndarray

    def home(self, words: np.ndarray) -> np.ndarray:
        """The bucket of each word. It rises with the hash."""
        return (((words >> U(WORD_BITS - 32)) * U(self.buckets)) >> U(32)).astype(np.int64)


def deal(cuts: DataFrame, buckets: int) -> tuple[Deal, int]:
    """The deal, and the number of training tokens. At most 2 * buckets contexts come to the driver."""
    train, total = cuts.agg(F.sum("train_tokens"), F.sum("all_tokens")).first()
    pairs = cuts.select(F.explode(F.arrays_zip("heavy", "often")).alias("x")).groupBy(F.col("x.heavy").alias("word")).agg(F.sum("x.often").alias("often"))
    found = sorted((r.word, min(buckets, -(-2 * buckets * r.often // total))) for r in pairs.where(F.col("often") * (2 * buckets) > F.lit(total or 0)).collect())
    return Deal(buckets, np.array([w for w, _ in found], U), np.array([n for _, n in found], np.int64)), train or 0


class Layout(NamedTuple):
    """The distinct pairs of a slice in the order in which they are sent, and what goes to each bucket.

    context, follower: places among the words; token: which pair each token ends; a bucket has its words [a, b), pairs of
    them [c, d), guests (contexts at home elsewhere) [e, f) and pairs of guests [g, h), with the number of followers of
    each word and guest.
    """

    context: np.ndarray
    follower: np.ndarray
    token: np.ndarray
    of_word: np.ndarray
    guest: np.ndarray
    of_guest: np.ndarray
    bounds: list[tuple[int, int, int, int, int, int, int, int, int]]


def before(s: Slice) -> np.ndarray:
    """The place of the context of each token."""
    out = np.empty_like(s.tokens)
    out[1:] = s.tokens[:-1]
    out[np.cumsum(s.counts) - s.counts] = np.searchsorted(s.words, BEGIN)
    return out


def layout(s: Slice, d: Deal) -> Layout:
    pairs, token = np.unique(before(s) * len(s.words) + s.tokens, return_inverse=True)
    context, follower = pairs // len(s.words), pairs % len(s.words)
    home = d.home(s.words)
    bucket = home[context]
    if len(d.split):
        at = np.minimum(np.searchsorted(d.split, s.words), len(d.split) - 1)
        over = np.where(d.split[at] == s.words, d.over[at], 1)
        wide = np.flatnonzero(over[context] > 1)
        sub = (s.words[follower[wide]] & U((1 << FOLLOWER_BITS) - 1)).astype(np.int64) % over[context[wide]]
        bucket[wide] = (bucket[wide] + sub) % d.buckets
        shared = np.flatnonzero(over > 1)
        guest = np.repeat(shared, over[shared] - 1)
        turn = np.arange(len(guest)) - np.repeat(np.cumsum(over[shared] - 1) - (over[shared] - 1), over[shared] - 1) + 1
        guest_bucket = (home[guest] + turn) % d.buckets
        order = np.lexsort((guest, guest_bucket))
        guest, guest_bucket = guest[order], guest_bucket[order]
    else:
        guest = guest_bucket = np.zeros(0, np.int64)
    away = np.flatnonzero(bucket != home[context])
    away = away[np.lexsort((away, bucket[away]))]
    own = np.flatnonzero(bucket == home[context])
    order = np.concatenate([own, away])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    of_word = np.bincount(context[own], minlength=len(s.words))
    width = len(s.words)
    slots = guest_bucket * width + guest
    of_guest = np.bincount(np.searchsorted(slots, bucket[away] * width + context[away]), minlength=len(guest)) if len(guest) else np.zeros(0, np.int64)
    names = np.unique(np.concatenate([home, guest_bucket]))
    sides = [np.searchsorted(x, names, side) + shift for x, shift in ((home, 0), (home[context[own]], 0), (guest_bucket, 0), (bucket[away], len(own))) for side in ("left", "right")]
    return Layout(context[order], follower[order], rank[token], of_word, guest, of_guest, list(zip(names.tolist(), *[x.tolist() for x in sides], strict=True)))


ROWS = "bucket int, slice long, data binary, n long, v long"


def rows_of(rows: list[tuple[int, int, bytes, int | None, int | None]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["bucket", "slice", "data", "n", "v"])


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def dealt(cuts: DataFrame, d: Deal) -> DataFrame:
    """The partial tries of each slice, for the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("data"), strict=True):
                s = unpacked(data.as_py())[0]
                x = layout(s, d)
                train = np.repeat(~s.held, s.counts)
                words = np.bincount(s.tokens[train], minlength=len(s.words))
                words[np.searchsorted(s.words, BEGIN)] = int((~s.held).sum())
                pairs = np.bincount(x.token[train], minlength=len(x.context))
                short, out = s.words & U((1 << FOLLOWER_BITS) - 1), []
                for name, a, b, c, e, f, g, h, k in x.bounds:
                    blob = [struct.pack("<IIII", b - a, e - c, g - f, k - h), steps(s.words[a:b]), planes(words[a:b], 4), planes(x.of_word[a:b], 4)]
                    blob += [steps(s.words[x.guest[f:g]]), planes(words[x.guest[f:g]], 4), planes(x.of_guest[f:g], 4)]
                    blob += [planes(y, 4) for z in (slice(c, e), slice(h, k)) for y in (short[x.follower[z]], pairs[z])]
                    out.append((name, number, b"".join(blob), None, None))
                yield rows_of(out)

    return cuts.select("slice", "data").transform(in_arrow, run, ROWS)


def coded(over: np.ndarray) -> np.ndarray:
    """The code of probabilities given as 1 / p, rounded so that none grows."""
    return np.minimum(np.ceil(np.log10(over) * STEP - 1e-9), LARGEST).astype(np.uint16)


def shards(rows: DataFrame, d: Deal, train_tokens: int) -> DataFrame:
    """Adds up, builds and asks the trie of each bucket. For each slice: counts and codes of its words, codes of its pairs (0: unseen). For each bucket: its parts of N and V."""
    unknown = int(coded(np.array([train_tokens + 1.0]))[0])
    back = int(coded(np.array([1 / (1 - SEEN)]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, found in groups(batches, "bucket"):
            words, often, many, followers, times, sizes = ([] for _ in range(6))
            for row in found:
                r = Reader(row["data"])
                own, own_pairs, guests, guest_pairs = (r.number() for _ in range(4))
                for n in (own, guests):
                    words.append(r.words(n))
                    often.append(r.array(n, 4).astype(np.int64))
                    many.append(r.array(n, 4).astype(np.int64))
                for n in (own_pairs, guest_pairs):
                    followers.append(r.array(n, 4))
                    times.append(r.array(n, 4).astype(np.int64))
                sizes.append((row["slice"], own, guests, own_pairs + guest_pairs))
                row["data"] = None
            words, often, many, followers, times = (np.concatenate(x) for x in (words, often, many, followers, times))
            distinct, place = np.unique(words, return_inverse=True)
            count = np.bincount(place, often, len(distinct)).astype(np.int64)
            pairs, at = np.unique((np.repeat(place, many).astype(U) << U(FOLLOWER_BITS)) | followers, return_inverse=True)
            seen = np.bincount(at, times, len(pairs)).astype(np.int64)
            token = (count > 0) & (d.home(distinct) == bucket) & (distinct != BEGIN)
            kept, rank = np.flatnonzero(count > 0), np.cumsum(count > 0) - 1
            context = (pairs >> U(FOLLOWER_BITS)).astype(np.int64)
            there = seen > 0
            trie = Trie.mapped(
                Trie.image(
                    distinct[kept], coded((train_tokens + 1) / (count[kept] + 1.0)), np.full(len(kept), back), rank[context[there]],
                    pairs[there] & U((1 << FOLLOWER_BITS) - 1), coded(count[context[there]] / (SEEN * seen[there])), WORD_BITS, FOLLOWER_BITS,
                )
            )
            node = trie.find(distinct)
            one, less = trie.probabilities(node, unknown), trie.back_offs(node)
            two = trie.below(node, context, pairs & U((1 << FOLLOWER_BITS) - 1))[at]
            out, a, c = [(bucket, -1, None, int(count[token].sum()), int(token.sum()))], 0, 0
            for number, own, guests, n in sizes:
                at_words = place[a : a + own]
                out.append((bucket, number, planes(count[at_words], 6) + planes(one[at_words], 2) + planes(less[at_words], 2) + planes(two[c : c + n], 2), None, None))
                a, c = a + own + guests, c + n
            yield rows_of(out)

    p = partitions(rows.sparkSession)
    return rows.repartitionById(p, F.pmod("bucket", F.lit(p))).sortWithinPartitions("bucket").transform(in_arrow, run, ROWS)


def summed(s: Slice, d: Deal, answers: dict[int, bytes], log_rest: float) -> tuple[np.ndarray, ...]:
    """Of each document: known tokens, sum of log10(c + 1), score, unseen pairs."""
    x = layout(s, d)
    count, one, less = (np.zeros(len(s.words), np.int64) for _ in range(3))
    two = np.zeros(len(x.context), np.int64)
    for name, a, b, c, e, f, g, h, k in x.bounds:
        r = Reader(answers[name])
        for y, width in ((count, 6), (one, 2), (less, 2)):
            y[a:b] = r.array(b - a, width)
        two[c:e], two[h:k] = np.split(r.array(e - c + k - h, 2), [e - c])
    new = two == 0
    code = np.where(new, less[x.context] + one[x.follower], two)
    starts = np.cumsum(s.counts) - s.counts
    over = lambda values: np.add.reduceat(values, starts)  # noqa: E731  each document has a token
    unseen = over(new[x.token].astype(np.int64))
    return over((count > 0)[s.tokens].astype(np.int64)), over(np.log10(count + 1.0)[s.tokens]), unseen * log_rest - over(code[x.token]) / STEP, unseen


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, unseen_pairs, for each row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col], parts, part).alias("held_out"), docs[text_col].alias("text"))
    cuts = written(cut(rows, partitions(docs.sparkSession)), "slices", "zstd")
    d, train_tokens = deal(cuts, partitions(docs.sparkSession))
    answers = written(shards(dealt(cuts, d), d, train_tokens), "answers", "zstd")
    n_all, v_all = answers.agg(F.sum("n"), F.sum("v")).first()
    n_all, v_all = n_all or 0, v_all or 0
    log_size, log_rest = math.log10(n_all + v_all + 1), math.log10((train_tokens + 1) / (n_all + v_all + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "unseen_pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups(batches, "slice"):
            s, ids, nulls = unpacked(next(r["data"] for r in group if r["bucket"] < 0))
            known, base, score, unseen = summed(s, d, {r["bucket"]: r["data"] for r in group if r["bucket"] >= 0}, log_rest)
            columns = [pa.array(ids, mask=nulls), pa.array(s.held), pa.array(s.counts), pa.array(known), pa.array(np.full(len(ids), n_all)), pa.array(base - s.counts * log_size), pa.array(score), pa.array(unseen)]
            yield pa.RecordBatch.from_arrays(columns, names)

    back = cuts.select(F.lit(-1).alias("bucket"), "slice", "data").unionByName(answers.where("slice >= 0").select("bucket", "slice", "data"))
    back = back.repartition(partitions(docs.sparkSession), "slice").sortWithinPartitions("slice")
    return back.transform(in_arrow, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, unseen_pairs long")
