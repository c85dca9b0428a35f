"""An exact n-gram Jaccard join of whole texts: links, their number for each document, and connected components.

1. The distinct shingles of slices of texts are hashed, counted and dealt to buckets in packed blobs. A bucket
   finds those that two or more documents have, and sends them back to the slices with a rank by frequency.
2. A linked pair has 3/4 of the shingles of either side in common, and common shingles are shared ones. A document
   of which fewer than 3/4 are shared has no link and leaves; for most texts this ends the work.
3. Documents with the same set are one class (they are linked anyway); classes go on.
4. Stars: classes that agree in one of a few minimum hashes are compared with one class of their group. That joins
   families of near copies in time proportional to their size.
5. Tiles: classes are cut into bands by size, each of which spans a little more than the 4/3 by which linked sets can
   differ, and a tile is a shingle of the prefixes (the rarest shingles first) and a band: a class stands in the tiles
   of its own band and meets those of the bands beside it. Two linked classes share a tile: the rarest common shingle
   is in both prefixes, and their bands are the same or touch. Of a tile, only pairs whose sizes differ by 4/3 at most,
   with enough shared shingles after that place and not joined yet are compared; none from within a joined family.
6. A pair is compared by bitmaps first: a bit that one side has and the other lacks stands for at least one
   element that is not common, which bounds the overlap from above. The rest meet by exact intersection of sorted
   arrays. Links then give components.
7. Families: for components, a joined family needs no more. For links, all pairs of its classes are compared: the
   family is cut into blocks, and a pair of blocks counts common shingles exactly by a product of 0/1 matrices. A
   cell returns its links, or only how many each class has, so that counting needs no row for each pair.

No candidate is capped or dropped. Shingle hashes have 48 bits: the sets of two documents are compared by them,
so one pair of texts of 1,000 words is misjudged by one shingle with a probability under 1e-8.

Defined results: a null or blank text has 0 shingles and is linked with nothing; a text with fewer words than the
shingle has one, of all its words; rows are documents of their own, also where ids repeat; a null id counts as the
largest, and a component of null ids has a null component_id; an empty table gives an empty result. Extra columns
are not read. A text is held in memory whole.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import wordhash
from kindred.llm.common import in_arrow, partitions, slices, utf8, written
from kindred.llm.components import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
SLICE_BYTES, SLICE_ROWS = 1 << 20, 8192
BLOCK_ROWS, BLOCK_BYTES, COLUMNS = 256, 8 << 20, 4096
BITS, LOW = 48, 40  # of a shingle's hash; of what is sent, as the bucket holds the rest
STARS = 6
U = np.uint64


def least_overlap(n: np.ndarray | int):
    """The smallest overlap that a linked set of size n can have."""
    return -(-NUMERATOR * n // DENOMINATOR)


def pack(values: np.ndarray) -> bytes:
    """48-bit numbers in 6 bytes each."""
    return (values & U(0xFFFFFFFF)).astype("<u4").tobytes() + (values >> U(32)).astype("<u2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(U) | (np.frombuffer(data, "<u2", n, 4 * n).astype(U) << U(32))


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sequence without repeats in a row, and how long each run is."""
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
    return owner[starts], np.diff(np.append(starts, len(owner)))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers in `width` bytes, all first bytes first, so that small numbers compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def _deal(docs: DataFrame, size: int, bucket_bits: int) -> DataFrame:
    """Rows for buckets (bucket, slice, entries): the distinct shingles of a slice of documents, each with the number of its
    documents there. And for each slice a row with its documents: ids, sizes, set ids, and their shingles as places among the
    distinct ones. A shingle of very many documents so weighs as one entry a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first, number = task << 32, 0
        for wide in slices(batches, "text", SLICE_BYTES):
            for start in range(0, wide.num_rows, SLICE_ROWS):
                part = wide.slice(start, SLICE_ROWS)
                found, many = wordhash.shingles(*wordhash.words(*utf8(part.column("text"))), size)
                keys = (np.repeat(np.arange(len(many), dtype=U), many) << U(BITS)) | (found >> U(64 - BITS))
                keys.sort()
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
                value = keys & U((1 << BITS) - 1)
                n = np.bincount((keys >> U(BITS)).astype(np.int64), minlength=len(many))
                lanes, ends = np.zeros((2, len(many)), U), np.cumsum(n)
                for lane in (0, 1):
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(wordhash.seeded(value, lane + 1))])
                    lanes[lane] = sums[ends] - sums[ends - n]
                sets = [lanes[:, k].tobytes() for k in range(len(many))]
                distinct, place, times = np.unique(value, return_inverse=True, return_counts=True)
                names, sizes = _runs(distinct >> U(BITS - bucket_bits))
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                blobs = [struct.pack("<I", b - a) + _planes(distinct[a:b], LOW // 8) + _planes(times[a:b], 4) for a, b in zip(cuts, cuts[1:], strict=False)]
                info = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sets, pa.binary())], ["doc_id", "n", "set_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, info.schema) as writer:
                    writer.write_batch(info)
                head = struct.pack("<III", len(names), len(distinct), len(place)) + names.astype("<u4").tobytes() + cuts[:-1].astype("<u4").tobytes()
                rows, slice_id = len(blobs) + 1, first + number
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(names.astype(np.int32), -1 - (7919 * task + number) % 65_536), pa.int32()), pa.array([slice_id] * rows, pa.int64()),
                        pa.array([*blobs, head + _planes(place, 4)], pa.binary()), pa.array([None] * len(blobs) + [sink.getvalue().to_pybytes()], pa.binary()),
                    ],
                    ["bucket", "slice", "entries", "docs"],
                )
                number += 1

    return docs.transform(in_arrow, run, "bucket int, slice long, entries binary, docs binary")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that follow each other with one key."""
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


def _shared(dealt: DataFrame) -> DataFrame:
    """Of each bucket and slice the shingles that two or more documents have (place in the blob, low bits), with a rank by frequency; a slice's documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches, "bucket"):
            out: list[tuple] = []
            if bucket < 0:
                out = [(bucket, r["slice"], r["entries"], r["docs"]) for r in rows]
            else:
                sizes = [struct.unpack_from("<I", r["entries"])[0] for r in rows]
                low = np.concatenate([_numbers(r["entries"], 4, n, LOW // 8) for r, n in zip(rows, sizes, strict=True)])
                own = np.concatenate([_numbers(r["entries"], 4 + n * LOW // 8, n, 4) for r, n in zip(rows, sizes, strict=True)]).astype(np.int64)
                order = np.argsort(low)
                _, groups = _runs(low[order])
                times = np.empty(len(low), np.int64)
                times[order] = np.repeat(np.add.reduceat(own[order], np.cumsum(groups) - groups), groups)
                rank = np.minimum(np.round(8 * np.log2(times)), 255).astype(np.uint8)
                at = 0
                for r, n in zip(rows, sizes, strict=True):
                    keep = np.flatnonzero(times[at : at + n] > 1)
                    if len(keep):
                        out.append((bucket, r["slice"], struct.pack("<I", len(keep)) + _planes(keep, 4) + _planes(low[at : at + n][keep], LOW // 8) + rank[at : at + n][keep].tobytes(), None))
                    at += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())], ["bucket", "slice", "entries", "docs"])

    p = partitions(dealt.sparkSession)
    return dealt.repartitionById(p, F.pmod("bucket", F.lit(p))).sortWithinPartitions("bucket").transform(in_arrow, run, dealt.schema)


def _documents(shared: DataFrame, bucket_bits: int) -> DataFrame:
    """doc_id, n, set_id, and for documents that can have a link: entries (their shared shingles, sorted) and ranks."""
    names = ["doc_id", "n", "set_id", "entries", "ranks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "slice"):
            (whole,) = [r for r in rows if r["docs"] is not None]
            info = pa.ipc.open_stream(whole["docs"]).read_all().combine_chunks()
            n = np.asarray(info.column("n"))
            buckets, distinct, total = struct.unpack_from("<III", whole["entries"])
            starts = dict(zip(np.frombuffer(whole["entries"], "<u4", buckets, 12).tolist(), np.frombuffer(whole["entries"], "<u4", buckets, 12 + 4 * buckets).tolist(), strict=True))
            place = _numbers(whole["entries"], 12 + 8 * buckets, total, 4).astype(np.int64)
            known, value, rank = np.zeros(distinct, bool), np.zeros(distinct, U), np.zeros(distinct, np.uint8)
            for r in rows:
                if r["docs"] is None:
                    (k,) = struct.unpack_from("<I", r["entries"])
                    at = starts[r["bucket"]] + _numbers(r["entries"], 4, k, 4).astype(np.int64)
                    known[at] = True
                    value[at] = _numbers(r["entries"], 4 + 4 * k, k, LOW // 8) | U((r["bucket"] >> (bucket_bits - (BITS - LOW))) << LOW)
                    rank[at] = np.frombuffer(r["entries"], np.uint8, k, 4 + 4 * k + k * LOW // 8)
            here = known[place]
            many = np.bincount(np.repeat(np.arange(len(n)), n)[here], minlength=len(n))
            value, rank, stop = value[place[here]], rank[place[here]], np.cumsum(many)
            alive = (n > 0) & (many >= least_overlap(n))
            entries = [pack(value[b - m : b]) if a else None for a, b, m in zip(alive, stop, many, strict=True)]
            ranks = [rank[b - m : b].tobytes() if a else None for a, b, m in zip(alive, stop, many, strict=True)]
            column = lambda c: info.column(c).chunk(0) if info.num_rows else pa.array([], info.schema.field(c).type)
            yield pa.RecordBatch.from_arrays([column("doc_id"), column("n"), column("set_id"), pa.array(entries, pa.binary()), pa.array(ranks, pa.binary())], names)

    return shared.repartition(partitions(shared.sparkSession), "slice").sortWithinPartitions("slice").transform(in_arrow, run, "doc_id long, n long, set_id binary, entries binary, ranks binary")


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each residue of the values."""
    out = np.zeros(bits, bool)
    out[(wordhash.seeded(values, 7) % U(bits)).astype(np.int64)] = True
    return np.packbits(out)


def overlap_bound(size_a: int, map_a: np.ndarray, size_b: int, map_b: np.ndarray) -> int:
    """An upper bound of the overlap of two sets, from their bitmaps of equal length."""
    only_a, only_b = int(np.bitwise_count(map_a & ~map_b).sum()), int(np.bitwise_count(map_b & ~map_a).sum())
    return min(size_a - only_a, size_b - only_b)


def band_bits(n: int) -> int:
    """The length of a bitmap of a set of n; those of linked sets differ by a factor of 2 at most, and the longer folds."""
    return 64 << max(0, math.ceil(math.log2(max(n, 1) / 64)))


def _classes(docs: DataFrame) -> DataFrame:
    """A row for each distinct set that can have a link: set_id, n, first (smallest doc_id), members (documents), entries, shared (their number), map, stars (minimum hashes), prefix (shingles under which it meets others)."""
    names = ["set_id", "n", "first", "members", "entries", "shared", "map", "stars", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, stars, prefixes = [], [], []
            for n, entries, ranks in zip(*[batch.column(c).to_pylist() for c in ("n", "entries", "ranks")], strict=True):
                value, rank = unpack(entries), np.frombuffer(ranks, "u1")
                maps.append(bitmap(value, band_bits(n)).tobytes())
                stars.append([int((wordhash.seeded(value, 100 + k) >> U(1)).min()) for k in range(STARS)])
                order = np.argsort((rank.astype(U) << U(BITS)) | value)
                prefixes.append(value[order[: len(value) - int(least_overlap(n)) + 1]].astype(np.int64))
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:5]], pa.array([len(e) // 6 for e in batch.column("entries").to_pylist()], pa.int64()), pa.array(maps, pa.binary()), pa.array(stars, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)], names)

    groups = docs.where("entries is not null").groupBy("set_id").agg(F.first("n").alias("n"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"), F.first("entries").alias("entries"), F.first("ranks").alias("ranks"))
    return groups.transform(in_arrow, run, "set_id binary, n long, first long, members long, entries binary, shared long, map binary, stars array<long>, prefix array<long>")


def _again(key: str):
    """A second join key made of the first: with it, both sides of a join get an exchange, and a hot key can be split."""
    return F.xxhash64(key).alias("again")


def _in_band(x: str, y: str):
    return (DENOMINATOR * F.least(F.col(x), F.col(y)) >= NUMERATOR * F.greatest(F.col(x), F.col(y)))


def _linked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are links: sizes, then bitmaps, then exact overlap."""
    side = lambda x, *more: classes.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in more])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, map_a, m, map_b, size_a, size_b in zip(*[batch.column(c).to_pylist() for c in ("n_a", "map_a", "n_b", "map_b", "shared_a", "shared_b")], strict=True):
                x, y = np.frombuffer(map_a, "u1"), np.frombuffer(map_b, "u1")
                if len(x) != len(y):  # fold the longer one: residues of half the length
                    x, y = (np.bitwise_or.reduce(z.reshape(-1, min(len(x), len(y)))) for z in (x, y))
                common = overlap_bound(size_a, x, size_b, y)
                keep.append(DENOMINATOR * common >= NUMERATOR * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, own = [], None, None
            for n, x, m, y in zip(*[batch.column(c).to_pylist() for c in ("n_a", "entries_a", "n_b", "entries_b")], strict=True):
                if x != last:
                    last, own = x, unpack(x)
                other = unpack(y)
                at = np.searchsorted(own, other)
                at[at == len(own)] = 0
                common = int((own[at] == other).sum()) if len(own) else 0
                keep.append(DENOMINATOR * common >= NUMERATOR * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = pairs.join(side("a", "n", "map", "shared"), "a").join(side("b", "n", "map", "shared"), "b").where(_in_band("n_a", "n_b")).transform(in_arrow, bounded, "a binary, b binary")
    return close.join(side("a", "n", "entries"), "a").join(side("b", "n", "entries"), "b").transform(in_arrow, exact, "a binary, b binary")


def _stars(classes: DataFrame) -> DataFrame:
    """Pairs of each class with one class of its minimum hash: that with the smallest part of unshared shingles, likely what the others were copied from."""
    keyed = classes.select("set_id", (F.col("shared") / F.col("n")).alias("part"), F.explode("stars").alias("key")).withColumn("again", F.xxhash64("key"))
    middle = keyed.groupBy("key").agg(F.max(F.struct("part", "set_id")).alias("most"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", _again("key"), F.col("most.set_id").alias("a"))
    return keyed.join(middle, ["key", "again"]).where("a <> set_id").select(F.least("a", "set_id").alias("a"), F.greatest("a", "set_id").alias("b")).distinct()


#: The ratio of sizes that a band spans: over 4/3, so that linked sets are at most one band apart whatever is rounded.
BAND = 1.34


def size_band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def _tiles(classes: DataFrame, star: DataFrame) -> DataFrame:
    """Pairs of classes that meet in a tile (shingle of their prefixes, size band) and that stars have not joined.

    If a shingle is the first in order that two sets have in common, then no more than what follows it is common.
    A pair is only emitted under shingles that leave enough for a link; its first common shingle always does.
    """
    placed = classes.select("set_id", "n", "shared", F.posexplode("prefix").alias("at", "key")).join(star, "set_id", "left")
    placed = placed.select("set_id", "n", (F.col("shared") - F.col("at")).alias("follow"), F.coalesce("star", "set_id").alias("star"), "key", _again("key"))
    most = placed.groupBy("key", "star").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.count(F.lit(1)).alias("stars"), F.max_by("star", F.struct("size", "star")).alias("main"))
    mixed = written(placed.join(most.where("stars > 1").select("key", _again("key"), "main"), ["key", "again"]).withColumn("band", size_band(F.col("n"))), "tiles")
    x = mixed.where("star <> main").withColumn("tile", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).alias("x")
    y = mixed.withColumnRenamed("band", "tile").alias("y")
    enough = (NUMERATOR + DENOMINATOR) * F.least("x.follow", "y.follow") >= NUMERATOR * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.star") != F.col("y.star")) & ((F.col("y.star") == F.col("y.main")) | (F.col("x.set_id") < F.col("y.set_id"))) & _in_band("x.n", "y.n") & enough)
    return pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of the left with each of the right (arrays without repeats)."""
    both = [*left, *right]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, place, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    keep = times[place] > 1
    owner, place = owner[keep], (np.cumsum(times > 1) - 1)[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [start, start + COLUMNS])
        cells = np.zeros((len(both), COLUMNS), np.float32)
        cells[owner[a:b], place[a:b] - start] = 1
        out += (cells[: len(left)] @ cells[len(left) :].T).astype(np.int64)
    return out


def _families(classes: DataFrame, star: DataFrame, counts: bool) -> DataFrame:
    """All links (a, b) between the classes of each star family; or with `counts`, rows (set_id, links) whose sums are each class's number of linked documents of other classes."""
    rows = classes.select("set_id", "n", "members", "entries").join(star, "set_id").withColumn("again", _again("star"))
    sizes = rows.groupBy("star").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("entries")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = rows.join(sizes.withColumn("again", _again("star")), ["star", "again"]).withColumn("own", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select(F.concat("star", F.encode(F.concat_ws(",", F.least("own", "other"), F.greatest("own", "other")), "UTF-8")).alias("cell"), (F.col("own") > F.col("other")).alias("second"), (F.col("own") == F.col("other")).alias("same"), "set_id", "n", "members", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _grouped(batches, "cell"):
            left, right = [r for r in found if not r["second"]], [r for r in found if r["second"]]
            alone = found[0]["same"]
            right = left if alone else right
            if not left or not right:
                continue
            n, m = (np.array([r["n"] for r in side]) for side in (left, right))
            common = overlaps(*[[unpack(r["entries"]) for r in side] for side in (left, right)])
            hits = DENOMINATOR * common >= NUMERATOR * (n[:, None] + m - common)
            if alone:
                hits &= ~np.eye(len(left), dtype=bool)
            if counts:
                sums = [(r["set_id"], int(k)) for r, k in zip(left, hits @ np.array([r["members"] for r in right]), strict=True)]
                if not alone:
                    sums += [(r["set_id"], int(k)) for r, k in zip(right, hits.T @ np.array([r["members"] for r in left]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sums], pa.binary()), pa.array([x[1] for x in sums], pa.int64())], ["set_id", "links"])
            else:
                for x, y in [(left[k], np.flatnonzero(hits[k])) for k in range(len(left))]:
                    pairs = [sorted((x["set_id"], right[k]["set_id"])) for k in y.tolist() if not alone or x["set_id"] < right[k]["set_id"]]
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    dealt = cells.repartition(partitions(classes.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.transform(in_arrow, run, "set_id binary, links long" if counts else "a binary, b binary")


def _joined(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents, their classes, the links of stars, the star families (set_id, star), and all links between classes of different families."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    bucket_bits = min(24, max(BITS - LOW, math.ceil(math.log2(4 * partitions(docs.sparkSession)))))
    table = written(_documents(_shared(_deal(rows, size, bucket_bits)), bucket_bits), "documents")
    classes = written(_classes(table), "classes")
    near = written(_linked(_stars(classes), classes), "stars")
    star = components(near).toDF("set_id", "star")
    return table, classes, near, star, _linked(_tiles(classes, star), classes)


def _named(classes: DataFrame, links: DataFrame) -> DataFrame:
    """set_id, component_id for each class."""
    found = components(links).toDF("set_id", "label")
    whole = classes.select("set_id", "first").join(found, "set_id", "left").select("set_id", "first", F.coalesce("label", "set_id").alias("label"))
    least = written(whole, "labels").withColumn("again", _again("label"))
    smallest = least.groupBy("label").agg(F.min("first").alias("component_id")).select("label", _again("label"), "component_id")
    return written(least.join(smallest, ["label", "again"]).select("set_id", "component_id"), "named")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to), for each row."""
    table, classes, near, _, across = _joined(docs, id_col, text_col, size)
    named = _named(classes, near.unionByName(across))
    linked = table.where("entries is not null").select("doc_id", "n", "set_id").join(named, "set_id")
    alone = table.where("entries is null")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def jaccard_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, n_links (the rows that it is linked with), component_id, for each row."""
    table, classes, near, star, across = _joined(docs, id_col, text_col, size)
    across = written(across, "across")
    named = _named(classes, near.unionByName(across))
    ends = across.select(F.col("a").alias("set_id"), F.col("b").alias("other")).unionByName(across.select(F.col("b").alias("set_id"), F.col("a").alias("other")))
    beyond = ends.join(classes.select(F.col("set_id").alias("other"), F.col("members").alias("links")), "other").select("set_id", "links")
    links = _families(classes, star, counts=True).unionByName(beyond).groupBy("set_id").agg(F.sum("links").alias("links"))
    totals = classes.select("set_id", "members").join(links, "set_id", "left").join(named, "set_id").select("set_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = table.where("entries is not null").select("doc_id", "n", "set_id").join(written(totals, "totals"), "set_id")
    alone = table.where("entries is null")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "n_links", "component_id").unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id")))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """All links between classes, (a, b) with a < b, and the membership (set_id, doc_id): documents of one class are linked as well."""
    table, classes, _, star, across = _joined(docs, id_col, text_col, size)
    return _families(classes, star, counts=False).unionByName(across), table.where("entries is not null").select("set_id", "doc_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of docs whose id is the smallest of their component (rows without an id stay); all columns."""
    names = jaccard_components(docs, id_col, text_col, size)
    dropped = names.where("doc_id <> component_id").select(F.col("doc_id").alias("id of a near copy"))
    return docs.join(dropped, docs[id_col] == dropped["id of a near copy"], "left_anti")
