"""Exact top-k by integer inner product, by MaxScore over dense postings.

A vector's components are its terms; the posting list of a term holds that component of every vector of a shard.
For a query, each term has a bound on what it can add in the shard, from the largest and smallest value in the
list. Terms whose bounds together cannot lift a vector to the query's k-th score so far are non-essential: only
the essential lists are traversed, and the others are probed, largest bound first, for those vectors that are
still competitive. A shard is an Arrow batch; a task carries its thresholds from shard to shard, and the shards'
results merge by a window of bounded depth. Bounds are compared strictly, so that ties are never lost.

The query set comes in blocks of at most QUERY_BLOCK vectors, each of which is broadcast to one pass over the
vectors. A block's result is added to a table in the shared folder before the next block is read, so that the driver
and the plan hold one block at a time, however many queries there are.

Components become floor(1024 * x), exactly for components of any size; vectors without components have the product 0
with all. Defined results: vectors that are null or hold a null or non-finite component,
and rows without an id, take no part; where lengths differ, missing components count as 0; a query id that
repeats stands for its smallest vector; repeated candidate rows are candidates each; scores beyond a long are cut
to its range; no queries or an empty table give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import in_arrow, scratch, written

SCALE, K, EVERY = 1024, 10, 100
QUERY_BLOCK, SHARD_ROWS, SEED_ROWS = 2048, 8192, 64
#: Terms probed between two looks at what is still competitive.
PROBE_TERMS = 8


def usable(ident: Column, vector: Column) -> Column:
    return ident.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, cut or filled with 0 to the width."""
    flat, sizes = np.asarray(column.flatten(), dtype=np.float64), np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, starts = np.zeros((len(sizes), width)), np.concatenate([[0], np.cumsum(sizes)])
    for k, n in enumerate(sizes):
        out[k, : min(n, width)] = flat[starts[k] : starts[k] + min(n, width)]
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); infinite where that is beyond a double."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * vectors)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids, in order."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(query: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all vectors of a shard that reach the threshold (and perhaps some that don't)."""
    bound = np.maximum(query * low, query * high)
    order = np.argsort(bound - np.minimum(query * low, query * high))[::-1]  # most decisive first
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])  # what the terms from here on add at most
    spread = rest + np.concatenate([[0.0], np.cumsum(np.minimum(query * low, query * high)[order])])
    essential = int(np.argmax(spread < threshold)) if (spread < threshold).any() else len(query)
    essential = max(1, min(essential, len(query)))
    terms = order[:essential]
    scores = query[terms] @ postings[terms]
    at = np.flatnonzero(scores + rest[essential] >= threshold)
    scores = scores[at]
    while essential < len(query) and len(at):
        terms = order[essential : essential + PROBE_TERMS]
        scores = scores + query[terms] @ postings[np.ix_(terms, at)]
        essential += len(terms)
        competitive = scores + rest[essential] >= threshold
        at, scores = at[competitive], scores[competitive]
    return at, scores


def exact_large(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores beyond the exact range of doubles, by whole numbers, cut to longs. query, vectors: not scaled yet."""
    whole = lambda x: int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(SCALE * x)  # noqa: E731  so large a double has no fraction
    q = [whole(x) for x in query.tolist()]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * whole(b) for a, b in zip(q, row, strict=True)))) for row in vectors.tolist()], dtype=object)


def block_pass(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: each task's k best for each query of the block."""
    width, asked = queries.shape[1], scaled(queries)
    largest = float(np.abs(asked).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(start, SHARD_ROWS)
                names, vectors_ = np.asarray(part.column("vec_id")), matrix(part.column("embedding"), width)
                postings = np.ascontiguousarray(scaled(vectors_).T)
                low, high = postings.min(axis=1, initial=np.inf), postings.max(axis=1, initial=-np.inf)
                exact = width * largest * float(np.abs(postings).max(initial=0)) < 2.0**53
                for j, query in enumerate(asked):
                    own, scores = found[j]
                    if not exact:
                        at, new = np.arange(len(names)), exact_large(queries[j], vectors_)
                        scores = scores.astype(object)
                    elif not width:
                        at, new = np.arange(len(names)), np.zeros(len(names))
                    else:
                        threshold = float(scores[-1]) if len(scores) == k else -np.inf
                        if len(scores) < k and len(names) > SEED_ROWS:
                            seeds = np.sort((query @ postings[:, :SEED_ROWS])[names[:SEED_ROWS] != ids[j]])
                            threshold = float(seeds[-k]) if len(seeds) >= k else -np.inf
                        at, new = search(query, postings, low, high, threshold)
                    other = names[at] != ids[j]
                    found[j] = best(np.concatenate([own, names[at][other]]), np.concatenate([scores, new[other]]), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, [len(i) for i, _ in found])), pa.array(np.concatenate([i for i, _ in found]) if len(found) else np.zeros(0, np.int64)), pa.array([int(s) for _, scores in found for s in scores], pa.int64())], ["query_id", "vec_id", "score"]
        )

    return vectors.transform(in_arrow, run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query (vec_id, embedding) its k best other vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    rows = rows.where(usable(F.col("vec_id"), F.col("embedding")))
    asked = queries.select(queries["vec_id"].cast("long").alias("vec_id"), queries["embedding"].cast("array<double>").alias("embedding"))
    asked = written(asked.where(usable(F.col("vec_id"), F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    path, schema, after = scratch(spark, "found"), "query_id long, rank int, vec_id long, score long", None
    spark.createDataFrame([], schema).write.parquet(path)
    while True:  # blocks in the order of the ids
        page = (asked if after is None else asked.where(F.col("vec_id") > after)).orderBy("vec_id").limit(block).toArrow()
        if not page.num_rows:
            break
        page = page.combine_chunks()
        ids = np.asarray(page.column("vec_id").chunk(0)).astype(np.int64)
        column = page.column("embedding").chunk(0)
        after = int(ids[-1])
        found = block_pass(rows, ids, matrix(column, int(np.diff(np.asarray(column.offsets)).max())), k)
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        if page.num_rows < block:
            break
    return spark.read.schema(schema).parquet(path)


ORACLE = rf"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p) WHERE rank <= {K}
"""
