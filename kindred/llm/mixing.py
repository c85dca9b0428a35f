"""Temperature mixing of sources: w_i ~ share_i ** a, with the exponent a found by bisection.

a = 1 keeps the natural shares, a = 0 is uniform. As a falls, both the entropy of the weights and the number of
times that small sources are repeated rise, so "entropy at most the target and no source repeated more than the
limit" holds from some exponent upwards; the bisection finds it on a grid of 2 ** -STEPS. One aggregate over the table
of sources, which is never collected, answers all questions that the next LEVELS steps can ask.

The weights become rows by budgeted block permutations. A source's target is floor(w_i * budget) tokens: whole
epochs while they fit, then a part of one. Documents are hashed to blocks of about `block_tokens` tokens; each
epoch permutes the blocks by a keyed hash, and the documents inside a block. In the last, partial epoch the
documents are taken in that order while their running sum stays within the rest of the budget. The running sum
is taken over ranges of the blocks' order (4096 for a source), then over the blocks of a range, then inside each block,
so that no task orders a whole source, or all its blocks.

DataFrame functions only. Defined results: tokens are runs of non-space characters (a null text has none); a
null source is a source of its own; a source without tokens gets weight 0 and no rows; repeated rows are drawn
as separate documents; rows of equal order go by id, then text; rows without an id are dealt to blocks by their text; an
empty table gives an empty result. A very long text may hold more than a block's tokens: its block is that much larger,
and it is drawn in the last epoch only if all of it fits. Extra columns are not read; `remix` passes them on, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import written

STEPS = 20
#: Steps of the bisection that one aggregate answers.
LEVELS = 4
SEED = "mix-1"
#: Of ln(number of sources).
TARGET_ENTROPY = 0.95
MOST_EPOCHS = 4.0
BLOCK_TOKENS = 65_536
#: Budget in times the tokens of the input.
BUDGET = 1.0


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hashed(*parts: Column | str) -> Column:
    """A keyed hash that other SQL engines share: md5 of the parts, joined."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts], F.lit(SEED)))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit(""))


def exponent(sources: DataFrame, total: int, n: int, budget: float, target_entropy: float, most_epochs: float) -> float:
    """The smallest grid exponent at which the weights' entropy is at most target_entropy * ln(sources) and no source is repeated more than most_epochs times; 1 if none is."""
    share, low, high = F.col("tokens") / F.lit(float(total)), 0, 1 << STEPS
    while low < high:
        open_, asked = [(low, high)], []
        for _ in range(LEVELS):  # the middles that the next steps can come to
            open_ = [(x, y) for x, y in open_ if x < y]
            asked += [(x + y) // 2 for x, y in open_]
            open_ = [half for x, y in open_ for half in ((x, (x + y) // 2), ((x + y) // 2 + 1, y))]
        powers = [F.pow(share, F.lit(m / (1 << STEPS))) for m in asked]
        row = sources.agg(*[f for p in powers for f in (F.sum(p), F.sum(p * F.log(share)), F.max(p / F.col("tokens")))]).first()
        fits = {}
        for k, m in enumerate(asked):
            z, s, least = row[3 * k : 3 * k + 3]
            fits[m] = math.log(z) - m / (1 << STEPS) * s / z <= target_entropy * math.log(n) + 1e-12 and least / z * budget * total <= most_epochs + 1e-12
        while low < high and (middle := (low + high) // 2) in fits:
            low, high = (low, middle) if fits[middle] else (middle + 1, high)
    return low / (1 << STEPS)


def narrow(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    """doc_id, source, key, n_tokens, tie, and spot (what deals a document to a block) of each row."""
    tie = hashed(docs[text_col])
    spot = F.conv(F.substring(hashed(F.coalesce(docs[id_col].cast("string"), tie)), 1, 8), 16, 10).cast("long")
    return [docs[id_col].alias("doc_id"), docs[source_col].alias("source"), source_key(docs[source_col]).alias("key"), words(docs[text_col]).alias("n_tokens"), tie.alias("tie"), spot.alias("spot")]


def planned(rows: DataFrame, budget: float, target_entropy: float, most_epochs: float, block_tokens: int) -> DataFrame:
    """For each source of the narrow rows with tokens: key, tokens, weight, epochs (whole ones), rest (tokens of the partial one), blocks."""
    sources = written(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    total, n = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = total or 0
    a = exponent(sources, total, n, budget, target_entropy, most_epochs) if total else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weighed = sources.select("key", "tokens", (power / F.lit(z)).alias("weight"))
    target = F.floor(F.col("weight") * F.lit(budget * total)).cast("long")
    return weighed.select(
        "key", "tokens", "weight", F.expr(f"cast(floor(weight * {budget * total!r}) as bigint) div tokens").alias("epochs"), (target % F.col("tokens")).alias("rest"), F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long").alias("blocks")
    )


def plan(docs: DataFrame, source_col: str, text_col: str, budget: float, target_entropy: float, most_epochs: float, block_tokens: int) -> DataFrame:
    """The plan of the sources of docs."""
    return planned(docs.select(source_key(docs[source_col]).alias("key"), words(docs[text_col]).alias("n_tokens")), budget, target_entropy, most_epochs, block_tokens)


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = (),
    budget: float = BUDGET, target_entropy: float = TARGET_ENTROPY, most_epochs: float = MOST_EPOCHS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """A row for each draw: doc_id, source, epoch, block, block_order (the block's place in the epoch's permutation, as its hash), n_tokens, and `row`, a struct of the carried columns, if any."""
    columns = narrow(docs, id_col, source_col, text_col)
    rows = written(docs.select(*columns), "narrow")
    sources = planned(rows, budget, target_entropy, most_epochs, block_tokens)
    at = lambda df: df.join(sources, "key").withColumn("block", F.col("spot") % F.col("blocks"))
    sizes = at(rows).groupBy("key", "block", "epochs").agg(F.sum("n_tokens").alias("in_block")).withColumn("order", hashed(F.col("key"), F.col("block"), F.col("epochs"))).withColumn("range", F.substring("order", 1, 3))
    ahead = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = sizes.groupBy("key", "range").agg(F.sum("in_block").alias("in_range")).select("key", "range", (F.sum("in_range").over(ahead) - F.col("in_range")).alias("before_range"))
    inside = Window.partitionBy("key", "range").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.withColumn("in_front", F.sum("in_block").over(inside) - F.col("in_block")).join(ranges, ["key", "range"]).select("key", "block", (F.col("before_range") + F.col("in_front")).alias("before"))
    # with columns to carry, the documents are read once more, so that no second copy of them is written
    whole = docs.select(*columns, F.struct(*[docs[c].alias(c) for c in carry]).alias("row")) if carry else rows
    within = Window.partitionBy("key", "block").orderBy(hashed(F.col("doc_id"), F.col("epochs")), F.col("doc_id"), F.col("tie")).rowsBetween(Window.unboundedPreceding, 0)
    summed = at(whole).withColumn("so_far", F.sum("n_tokens").over(within)).join(starts, ["key", "block"])
    taken = F.col("epochs") + F.when(F.col("before") + F.col("so_far") <= F.col("rest"), 1).otherwise(0)
    drawn = summed.withColumn("taken", taken).where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)))
    return drawn.select("doc_id", "source", "epoch", "block", hashed(F.col("key"), F.col("block"), F.col("epoch")).alias("block_order"), "n_tokens", *(["row"] if carry else []))


def remix(docs: DataFrame, **options) -> DataFrame:
    """docs drawn to the target weights, with all its columns; a document drawn in several epochs stands once for each."""
    return mix(docs, carry=tuple(docs.columns), **options).select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(':' || source, '') AS key, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT key, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY key HAVING sum(n_tokens) > 0),
t AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS n FROM s),
b AS (
  SELECT 0 AS low, {1 << STEPS} AS high
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE high END FROM (
    SELECT low, high, (low + high) // 2 AS mid, (
      SELECT ln(sum(pow(tokens / total, x))) - any_value(x) * sum(pow(tokens / total, x) * ln(tokens / total)) / sum(pow(tokens / total, x)) <= {TARGET_ENTROPY} * ln(any_value(n)) + 1e-12
         AND max(pow(tokens / total, x) / tokens) / sum(pow(tokens / total, x)) * {BUDGET} * any_value(total) <= {MOST_EPOCHS} + 1e-12
      FROM (SELECT tokens, total, n, ((b.low + b.high) // 2) / {1 << STEPS}.0::DOUBLE AS x FROM s, t)) AS ok
    FROM b WHERE low < high)),
a AS (SELECT low / {1 << STEPS}.0::DOUBLE AS x FROM b WHERE low = high LIMIT 1),
z AS (SELECT sum(pow(tokens / total, x)) AS z FROM s, t, a),
p AS (
  SELECT key, tokens, goal // tokens AS epochs, goal % tokens AS rest, ceil(tokens / {BLOCK_TOKENS})::BIGINT AS blocks
  FROM (SELECT key, tokens, floor(pow(tokens / total, x) / z * ({BUDGET} * total))::BIGINT AS goal FROM s, t, a, z)),
placed AS (
  SELECT d.*, p.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '-') || '|{SEED}')) || '|{SEED}'), 1, 8))::BIGINT % blocks AS block
  FROM d JOIN p USING (key)),
starts AS (
  SELECT key, block, sum(n) OVER (PARTITION BY key ORDER BY md5(key || '|' || block || '|' || epochs || '|{SEED}'), block ROWS UNBOUNDED PRECEDING) - n AS before
  FROM (SELECT key, block, epochs, sum(n_tokens) AS n FROM placed GROUP BY ALL)),
summed AS (
  SELECT placed.*, before + sum(n_tokens) OVER (PARTITION BY key, block
    ORDER BY md5(coalesce(doc_id::VARCHAR, '-') || '|' || epochs || '|{SEED}'), doc_id, md5(coalesce(text, '-') || '|{SEED}') ROWS UNBOUNDED PRECEDING) AS so_far
  FROM placed JOIN starts USING (key, block))
SELECT doc_id, source, epoch, block, md5(key || '|' || block || '|' || epoch || '|{SEED}') AS block_order, n_tokens
FROM (SELECT *, unnest(range(epochs + CASE WHEN so_far <= rest THEN 1 ELSE 0 END)) AS epoch FROM summed)
"""
