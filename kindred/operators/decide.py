"""From scored pairs to matches: margin, abstention, threshold, and rows for entities without a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a class up to which each entity gets them by itself.
FEW = 20


def margins(scored: DataFrame, score: str = "score") -> DataFrame:
    """The best candidate of each entity, and how far it is ahead of the next (of 0, if there is none)."""
    order = Window.partitionBy("s1_id").orderBy(F.col(score).desc(), "match_id")
    ranked = scored.withColumns({"place": F.row_number().over(order), "next": F.lead(score).over(order)})
    return ranked.where("place = 1").select("s1_id", "match_id", F.col(score).alias("best"), (F.col(score) - F.coalesce("next", F.lit(0.0))).alias("margin"))


def decide(scored: DataFrame, threshold: float, margin: float = 0.0, score: str = "score") -> DataFrame:
    """s1_id, match_id of the pairs at or above the threshold; an entity whose best is not far enough ahead keeps none."""
    sure = margins(scored, score).where((F.col("best") >= threshold) & (F.col("margin") >= margin)).select("s1_id") if margin > 0 else None
    kept = scored.where(F.col(score) >= threshold).select("s1_id", "match_id")
    return kept if sure is None else kept.join(sure, "s1_id", "left_semi")


def lists(entities: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids", of: DataFrame | None = None) -> DataFrame:
    """A row for each entity (source1_entity_id) with its sorted comma list, empty without a match (V6).

    With `of` (class_id, entity_id), match_id names a class; an entity's list has the ids of its classes. Entities of
    the same classes meet their list, made once, in the last join.
    """
    every = entities.select("s1_id").distinct()
    if of is None:
        cells = pairs.groupBy("s1_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("match_id"))).alias(column))
        return every.join(cells, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))
    ids = of.groupBy("class_id").agg(F.collect_list("entity_id").alias("ids"))
    sizes = of.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    met = pairs.select("s1_id", F.col("match_id").alias("class_id")).distinct().join(sizes, "class_id")
    # the ids of small classes go to their entity; large ones are put together once for each set of them
    own = met.where(F.col("n") <= FEW).join(ids, "class_id").groupBy("s1_id").agg(F.flatten(F.collect_list("ids")).alias("own"))
    sets = met.where(F.col("n") > FEW).groupBy("s1_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("class_id"))).alias("set"))
    each = sets.select("set").distinct().withColumn("class_id", F.explode(F.split("set", ",")))
    shared = each.join(ids, "class_id").groupBy("set").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("shared"))
    none = F.array().cast("array<string>")
    rows = every.join(own, "s1_id", "left").join(sets, "s1_id", "left").join(shared, "set", "left")
    cell = F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(F.coalesce("own", none), F.coalesce("shared", none)))))
    return rows.select(F.col("s1_id").alias("source1_entity_id"), cell.alias(column))


def thresholds(scored: DataFrame, truth: DataFrame, entities: DataFrame, grid: list[float], beta: float = 0.5, score: str = "score", of: DataFrame | None = None) -> DataFrame:
    """threshold, macro_f_beta for each threshold of the grid (V5).

    Each pair counts at every threshold that it reaches: an entity's hits and guesses are per-threshold sums in one
    aggregate, so the scored pairs are read and shuffled once for the whole grid. With `of` (class_id, entity_id),
    match_id names a class in `scored`, and the pair counts for all of its ids.
    """
    t = truth.select("s1_id", "match_id").distinct()
    if of is None:
        weighed = scored.withColumn("n", F.lit(1)).join(t.withColumn("true", F.lit(1)), ["s1_id", "match_id"], "left")
    else:
        sizes = of.groupBy(F.col("class_id").alias("match_id")).agg(F.count(F.lit(1)).alias("n"))
        true = t.withColumnRenamed("match_id", "entity_id").join(of, "entity_id").groupBy("s1_id", F.col("class_id").alias("match_id")).agg(F.count(F.lit(1)).alias("true"))
        weighed = scored.join(sizes, "match_id").join(true, ["s1_id", "match_id"], "left")
    total = lambda x, n: F.coalesce(F.sum(F.when(F.col(score) >= x, F.col(n))), F.lit(0))
    counted = weighed.groupBy("s1_id").agg(F.array(*[total(x, "n") for x in grid]).alias("guesses"), F.array(*[total(x, "true") for x in grid]).alias("hits"))
    truths = t.groupBy("s1_id").agg(F.count(F.lit(1)).alias("truths"))
    zero = F.array(*[F.lit(0).cast("long") for _ in grid])
    rows = entities.select("s1_id").distinct().join(truths, "s1_id", "left").join(counted, "s1_id", "left")
    each = rows.select(F.coalesce("truths", F.lit(0)).alias("t"), F.posexplode(F.arrays_zip(F.coalesce("guesses", zero).alias("g"), F.coalesce("hits", zero).alias("h"))).alias("k", "x"))
    b2 = beta * beta
    f = F.when((F.col("t") == 0) & (F.col("x.g") == 0), 1.0).when(F.col("x.h") == 0, 0.0).otherwise((1 + b2) * F.col("x.h") / (b2 * F.col("t") + F.col("x.g")))
    scores = each.groupBy("k").agg(F.avg(f).alias("macro_f_beta"))
    return scores.select(F.element_at(F.array(*[F.lit(x) for x in grid]), F.col("k") + 1).alias("threshold"), "macro_f_beta")
