"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs. Each word has learnt and counted inputs, of the word and of its characters. Learnt: a vector of the hashed word,
and one each of its beginning and its end (four characters and the edge; the whole of a shorter word), trained with the
network; words and character runs in fewer than KNOWN training documents keep the zero vector. Counted: the evidence
(shrunk log-odds of the label) of the hashed word, and the largest and mean evidence of its hashed runs of 4 and of 5
characters, word edges included; a run counts once for each different word of a document that has it. Evidence comes
from the training documents only; a training document's own fold is left out when its inputs are made.

Network. A window of WINDOW words runs through a gated recurrent layer in both directions; attention pools the
states and a logistic unit scores the window. Training takes from each document the window of largest evidence, so
that clean documents show their hardest place. Scoring goes over all overlapping windows of a whole text (each
starts half a window after the one before); the text's score is that of its worst window.

Training rows are a documented, bounded sample: TRAIN_ROWS labelled documents at most, by a hash of the id, of them as
many as have TRAIN_TEXT bytes together, and of rows that share an id one. The model is a few MB whatever the corpus;
scoring is one pass that depends on nothing but the text.

Defined results: null and blank texts are scored as one empty window; a null id is not held out; rows that repeat
are scored each; of several labels of a document the highest counts, and null labels are ignored; without labelled
rows every score is the prior 0.1; an empty table gives an empty result. A very long text is scored whole, with memory
in proportion to it. Extra columns are not inputs; `clean` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import wordhash
from kindred.llm.common import in_arrow, release, slices, utf8

#: Labelled documents that training reads at most, and bytes of their texts.
TRAIN_ROWS, TRAIN_TEXT = 6000, 32 << 20
THRESHOLD = 0.3
WINDOW, HIDDEN, FOLDS = 32, 8, 4
WORD_BITS, GRAM_BITS, GRAMS = 19, 18, (4, 5)
#: Counted inputs; learnt vectors' width, number, and training documents that a word or run must be in.
COUNTED, WIDTH, VECTOR_BITS, KNOWN = 1 + 2 * len(GRAMS), 4, 15, 3
INPUTS = COUNTED + 3 * WIDTH
PRIOR, EPOCHS, BATCH, RATE, DECAY = 4.0, 12, 128, 0.02, 1e-4
#: Bytes of text that training and scoring read at a time.
TRAIN_BYTES, SCORE_BYTES = 1 << 19, 1 << 20
#: Windows that run through the network together.
TOGETHER = 4096
U = np.uint64


def held_out(ident: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % parts == part, F.lit(False))


class Words(NamedTuple):
    """The words of some texts: buckets of the words, buckets of their character runs with each word's first and last place, the vectors of each word (itself, beginning, end), and words per text."""

    bucket: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    vectors: np.ndarray
    counts: np.ndarray


def read(data: np.ndarray, offsets: np.ndarray) -> Words:
    lens = np.diff(offsets)
    texts = len(lens)
    spaced = np.full(len(data) + texts + 1, 32, np.uint8)  # every word then has an edge on either side
    spaced[np.arange(len(data)) + 1 + np.repeat(np.arange(texts), lens)] = data
    borders = np.concatenate([[0], 1 + np.cumsum(lens + 1)])
    borders[-1] = len(spaced)
    hashes, counts = wordhash.words(spaced, borders)
    inside = wordhash.lowered()[spaced] != 32
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stop = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    grams = []
    for n in GRAMS:
        bucket = (wordhash.grams(spaced, n) >> U(64 - GRAM_BITS)).astype(np.int64)
        grams.append((bucket, start - 1, np.maximum(stop - n + 2, start - 1)))
    runs = wordhash.grams(spaced, 5)
    whole = stop - start < 4
    ends = [np.where(whole, hashes, runs[np.where(whole, 0, at)] if len(runs) else hashes) for at in (start - 1, stop - 4)]
    vectors = np.stack([(h >> U(64 - VECTOR_BITS)).astype(np.int64) for h in (wordhash.seeded(hashes, 3), ends[0], wordhash.seeded(ends[1], 5))], axis=1)
    return Words((hashes >> U(64 - WORD_BITS)).astype(np.int64), grams, vectors, counts)


def pooled(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value and the mean in each range [low, high); 0 for an empty range."""
    top, mean = np.zeros(len(low), np.float32), np.zeros(len(low), np.float32)
    some = np.flatnonzero(high > low)
    if len(some):
        ends = np.empty(2 * len(some), np.int64)
        ends[::2], ends[1::2] = low[some], high[some]
        padded = np.append(values, np.float32(0))
        top[some] = np.maximum.reduceat(padded, ends)[::2]
        mean[some] = np.add.reduceat(padded, ends)[::2] / (high[some] - low[some])
    return top, mean


def inputs(words: Words, tables: list[np.ndarray]) -> np.ndarray:
    columns = [tables[0][words.bucket]]
    for (bucket, low, high), table in zip(words.grams, tables[1:], strict=True):
        columns += pooled(table[bucket], low, high)
    return np.stack(columns, axis=1).astype(np.float32)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (among all), length and text of every window: each begins half a window after the one before, the last reaches the end of the text. A text without words has one empty window."""
    half = WINDOW // 2
    many = np.maximum(1, -(-(counts - WINDOW) // half) + 1)
    text = np.repeat(np.arange(len(counts)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.cumsum(counts) - counts
    return begin[text] + k * half, np.minimum(WINDOW, counts[text] - k * half), text


def gathered(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x (step, window, channel) and mask (step, window) of windows."""
    step = np.arange(WINDOW)[:, None]
    mask = step < size
    if not len(x):
        return np.zeros((WINDOW, len(first), x.shape[1]), x.dtype), mask
    return np.where(mask[..., None], x[np.minimum(first + step, len(x) - 1)], x.dtype.type(0)), mask


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights of both directions, attention and output by name, and the vectors of words, beginnings and ends."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        weight = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": weight(INPUTS, 3 * HIDDEN), f"U{d}": weight(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": weight(2 * HIDDEN, HIDDEN), "v": weight(HIDDEN), "w": weight(2 * HIDDEN), "c": np.float32(-1) * np.ones(1, np.float32)}
        self.vectors = [np.zeros((1 << VECTOR_BITS, WIDTH), np.float32) for _ in range(3)]

    def joined(self, counted: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The whole inputs: counted ones, and the vectors in these places of each table."""
        return np.concatenate([counted, *[table[vectors[..., k]] for k, table in enumerate(self.vectors)]], axis=-1)

    def layer(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (step, window, HIDDEN) of one direction. A step outside the window leaves the state as it is."""
        W, Uh, b = (self.p[k + d] for k in "WUb")
        steps, n, _ = x.shape
        gx = (x.reshape(-1, INPUTS) @ W + b).reshape(steps, n, -1)
        h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            gh = h @ Uh
            zr = sigmoid(gx[t, :, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gx[t, :, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = np.where(m, c + z * (h - c), h)
            if keep is not None:
                keep.append((t, h, z, r, c, gh[:, 2 * HIDDEN :], m))
            out[t] = h = new
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        tapes = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self.layer(d, x, mask, tapes[d]) for d in "fb"], axis=2)
        u = np.tanh(h @ self.p["A"])
        e = np.where(mask, u @ self.p["v"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * mask
        a = a / np.maximum(a.sum(axis=0), 1e-9)
        context = np.einsum("tn,tnh->nh", a, h)
        if keep is not None:
            keep |= {"tapes": tapes, "h": h, "u": u, "a": a, "context": context}
        return context @ self.p["w"] + self.p["c"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, of_x: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of all weights by name; those of the inputs are added to of_x."""
        k: dict = {}
        dl = (sigmoid(self.logits(x, mask, k)) - y) / len(y)
        h, u, a, p = k["h"], k["u"], k["a"], self.p
        g = {"w": k["context"].T @ dl, "c": dl.sum(keepdims=True)}
        dc = dl[:, None] * p["w"]
        dh = a[..., None] * dc
        da = np.einsum("tnh,nh->tn", h, dc)
        de = a * (da - (a * da).sum(axis=0))
        du = de[..., None] * p["v"] * (1 - u * u)
        g["v"] = np.einsum("tn,tnh->h", de, u)
        g["A"] = h.reshape(-1, 2 * HIDDEN).T @ du.reshape(-1, HIDDEN)
        dh = dh + du @ p["A"].T
        for d, part in (("f", dh[..., :HIDDEN]), ("b", dh[..., HIDDEN:])):
            gW, gU, gb = (np.zeros_like(p[n + d]) for n in "WUb")
            back = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, was, z, r, c, ghc, m in reversed(k["tapes"][d]):
                total = back + part[t]
                dm = total * m
                dc_ = dm * (1 - z) * (1 - c * c)
                dz = dm * (was - c) * z * (1 - z)
                dr = dc_ * ghc * r * (1 - r)
                gx = np.concatenate([dz, dr, dc_], axis=1)
                gh = np.concatenate([dz, dr, dc_ * r], axis=1)
                gW += x[t].T @ gx
                if of_x is not None:
                    of_x[t] += gx @ p["W" + d].T
                gU += was.T @ gh
                gb += gx.sum(axis=0)
                back = gh @ p["U" + d].T + dm * z + total * ~m
            g |= {"W" + d: gW, "U" + d: gU, "b" + d: gb}
        return g

    def fit(self, counted: np.ndarray, vectors: np.ndarray, known: list[np.ndarray], mask: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam over shuffled batches, with a falling rate; vectors that are known learn by Adagrad."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        seen = [np.full(1 << VECTOR_BITS, 1e-3, np.float32) for _ in self.vectors]
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                pick, t = order[at : at + BATCH], t + 1
                rate, places, inside = RATE * (1 - epoch / EPOCHS), vectors[:, pick], mask[:, pick]
                x = self.joined(counted[:, pick], places) * inside[..., None]
                of_x = np.zeros_like(x)
                for name, g in self.gradients(x, inside, y[pick], of_x).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                    step = rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-6)
                    self.p[name] = (self.p[name] - step).astype(np.float32)
                for k, table in enumerate(self.vectors):
                    live = inside & known[k][places[..., k]]
                    rows, row = np.unique(places[..., k][live], return_inverse=True)
                    g = of_x[live][:, COUNTED + k * WIDTH : COUNTED + (k + 1) * WIDTH]
                    sums = np.stack([np.bincount(row, g[:, c], len(rows)) for c in range(WIDTH)], axis=1) + DECAY * table[rows]
                    seen[k][rows] += (sums * sums).mean(axis=1)
                    table[rows] -= rate * sums / np.sqrt(seen[k][rows])[:, None]


class Model(NamedTuple):
    tables: list[np.ndarray]
    network: Network | None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text, and the word at which its worst window begins."""
        texts = len(offsets) - 1
        if self.network is None:
            return np.full(texts, 0.1), np.zeros(texts, np.int64)
        words = read(data, offsets)
        x = self.network.joined(inputs(words, self.tables), words.vectors)
        first, size, text = windows(words.counts)
        logits = np.empty(len(first))
        for at in range(0, len(first), TOGETHER):
            part = slice(at, at + TOGETHER)
            logits[part] = self.network.logits(*gathered(x, first[part], size[part]))
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, int)
        worst = np.maximum.reduceat(logits, starts) if len(starts) else np.zeros(0)
        at = np.full(texts, len(first))
        hits = np.flatnonzero(logits == worst[text])
        np.minimum.at(at, text[hits], hits)
        return 1 / (1 + np.exp(-worst)), first[at] - (np.cumsum(words.counts) - words.counts)


def _counts(words: Words, toxic: np.ndarray) -> list[np.ndarray]:
    """By label (column): documents that have each word bucket, and different words of documents that have each character run's bucket."""
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    word = (text.astype(np.int64) << WORD_BITS) | words.bucket
    out = []
    spans = [(np.arange(len(text)), np.arange(len(text)) + 1, np.zeros(len(text), np.int64), 0), *[(low, high, bucket, GRAM_BITS) for bucket, low, high in words.grams]]
    for low, high, bucket, bits in spans:
        sizes = np.maximum(high - low, 0)
        at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        found = np.unique((np.repeat(word, sizes) << bits) | bucket[at])
        label, cell = toxic[found >> (WORD_BITS + bits)], found & ((1 << (bits or WORD_BITS)) - 1)
        bits = bits or WORD_BITS
        out.append(np.stack([np.bincount(cell[label == y], minlength=1 << bits) for y in (0, 1)], axis=1).astype(np.float32))
    return out


def _evidence(counts: list[np.ndarray], share: float) -> list[np.ndarray]:
    """Shrunk log-odds of the label against its share."""
    prior = np.log(share / (1 - share))
    rates = [(c[:, 1] + PRIOR * share) / (c.sum(axis=1) + PRIOR) for c in counts]
    return [(np.log(r / (1 - r)) - prior).astype(np.float32) for r in rates]


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """A model from labelled whole texts."""
    if not len(texts) or toxic.min() == toxic.max():
        return Model([], None)
    data = lambda k: texts[k].encode("utf-8", "surrogatepass")  # noqa: E731  a chunk's at a time, as the driver has little room
    chunks, size = [[] for _ in range(FOLDS)], [TRAIN_BYTES] * FOLDS
    for k in range(len(texts)):  # a few hundred documents of one fold at a time
        if size[k % FOLDS] >= TRAIN_BYTES:
            chunks[k % FOLDS].append([])
            size[k % FOLDS] = 0
        chunks[k % FOLDS][-1].append(k)
        size[k % FOLDS] += len(data(k))

    def words_of(chunk: list[int]) -> Words:
        own = [data(k) for k in chunk]
        return read(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in own])]).astype(np.int64))

    per_fold, in_documents = [], [np.zeros(1 << VECTOR_BITS, np.int64) for _ in range(3)]
    for fold in chunks:
        if fold:
            sums = None
            for chunk in fold:
                words = words_of(chunk)
                counts = _counts(words, toxic[chunk])
                sums = counts if sums is None else [a + b for a, b in zip(sums, counts, strict=True)]
                text = np.repeat(np.arange(len(words.counts)), words.counts)
                for k, total in enumerate(in_documents):
                    total += np.bincount(np.unique((text << VECTOR_BITS) | words.vectors[:, k]) & ((1 << VECTOR_BITS) - 1), minlength=1 << VECTOR_BITS)
                release()
            per_fold.append(sums)
    total = reduce(lambda x, y: [a + b for a, b in zip(x, y, strict=True)], per_fold)
    share = float(toxic.mean())
    counted, vectors, masks, ys = [], [], [], []
    for fold, own in zip([f for f in chunks if f], per_fold, strict=True):
        tables = _evidence([a - b for a, b in zip(total, own, strict=True)], share)
        for chunk in fold:
            words = words_of(chunk)
            x = inputs(words, tables)
            first, size, text = windows(words.counts)
            xw, mask = gathered(x, first, size)
            peak = np.where(mask, xw.max(axis=2), -np.inf).max(axis=0)
            order = np.lexsort((-peak, text))
            pick = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
            counted.append(xw[:, pick])
            vectors.append(gathered(words.vectors, first[pick], size[pick])[0])
            masks.append(mask[:, pick])
            ys.append(toxic[chunk][text[pick]])
            release()
    per_fold.clear()
    network = Network()
    network.fit(*(np.concatenate(p, axis=1) for p in (counted, vectors)), [n >= KNOWN for n in in_documents], np.concatenate(masks, axis=1), np.concatenate(ys).astype(np.float32))
    return Model(_evidence(total, share), network)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_TEXT, parts: int = 4, part: int = 2) -> Model:
    """A model from at most `rows` labelled documents outside the held-out part, chosen by a hash of the id, with at most `text_bytes` together; a document that would go beyond is passed over."""
    named = labels.where(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("id")).agg(F.max("toxic").alias("toxic"))
    chosen = named.where(~held_out(F.col("id"), parts, part)).orderBy(F.xxhash64("id"), "id").limit(rows)
    text = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(docs["doc_id"].alias("id"), text.alias("text"), F.struct(F.octet_length(text).alias("size"), F.xxhash64(text).alias("hash")).alias("of"))
    sizes = texts.drop("text").join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("of").alias("of"), F.xxhash64("id").alias("order")).orderBy("order", "id").collect()
    taken, left = [], text_bytes
    for r in sizes:
        if r.of.size <= left:
            taken.append((r.id, tuple(r.of)))
            left -= r.of.size
    if not taken:
        return Model([], None)
    wanted = docs.sparkSession.createDataFrame(taken, texts.select("id", "of").schema)
    found = texts.join(F.broadcast(wanted), ["id", "of"]).join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", "text", "toxic").toArrow()
    found = found.sort_by([("id", "ascending"), ("text", "ascending")])
    whole, toxic = found.column("text").to_pylist(), np.array(found.column("toxic").to_pylist(), np.int64)
    del found
    model = fit(whole, toxic)
    del whole
    release()  # the driver goes on, and the JVM beside it
    return model


def score(docs: DataFrame, model: Model, parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_word (where the worst window begins), for each row."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), held_out(docs["doc_id"], parts, part).alias("held_out"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SCORE_BYTES):
            p, at = model.score(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(at)], ["doc_id", "held_out", "score", "predicted", "worst_word"])

    return rows.transform(in_arrow, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, worst_word long")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all columns."""
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", SCORE_BYTES):
            p, _ = model.score(*utf8(batch.column(f"c{at}")))
            yield batch.filter(pa.array(p < THRESHOLD))

    return plain.transform(in_arrow, run, plain.schema).toDF(*docs.columns)
