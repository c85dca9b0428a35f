"""Classes of records that agree in every field that a step reads.

A step that depends on those fields alone is computed for one record of each class (the least id, with the class's
`size`); what it finds holds for all pairs of members, and these are written out last, without a shuffle of pairs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a class that travel in one row.
CHUNK = 1000


class Classes(NamedTuple):
    """left, right: a record of each class, with its size; of: class_id, entity_id, place (from 1) of the members."""

    left: DataFrame
    right: DataFrame
    of_left: DataFrame
    of_right: DataFrame


def classed(records: DataFrame, fields: tuple[str, ...], ident: str = "entity_id") -> DataFrame:
    """Adds class_id (the least id of those that agree in the fields), place (its rank among them) and size. Ids must not repeat."""
    same = Window.partitionBy(*fields)
    ordered = same.orderBy(ident)
    return records.withColumns({"class_id": F.first(ident).over(ordered), "place": F.row_number().over(ordered), "size": F.count(F.lit(1)).over(same)})


def representatives(rows: DataFrame) -> DataFrame:
    return rows.where("place = 1").drop("class_id", "place")


def members(rows: DataFrame, ident: str = "entity_id") -> DataFrame:
    return rows.select("class_id", F.col(ident).alias("entity_id"), "place")


def for_left(found: DataFrame, of_left: DataFrame) -> DataFrame:
    """found (s1_id, match_id and more, both classes) for each member of the left classes."""
    return found.withColumnRenamed("s1_id", "class_id").join(of_left.select("class_id", F.col("entity_id").alias("s1_id")), "class_id").select(*found.columns)


def with_ids(records: DataFrame, of: DataFrame) -> DataFrame:
    """records (one of each class) with `ids` of their members, in rows of at most CHUNK."""
    lists = of.groupBy(F.col("class_id").alias("entity_id"), F.floor((F.col("place") - 1) / CHUNK).alias("part")).agg(F.collect_list("entity_id").alias("ids"))
    return records.join(lists.drop("part"), "entity_id")


def packed(found: DataFrame, of_right: DataFrame) -> DataFrame:
    """found (match_id, a class; ids, members of the left class; and more) as rows of `lefts` (s1_id and more) that meet all of `others`.

    Where found is dealt by match_id, as after a join on it, no pair is shuffled. A row has at most CHUNK ids a side, so that
    the table has a left id for each pair of a left record and a right class, and no pair of members.
    """
    more = [c for c in found.columns if c not in ("match_id", "ids")]
    one = found.withColumn("s1_id", F.explode("ids")).select("match_id", F.struct("s1_id", *[c for c in more if c != "s1_id"]).alias("left"))
    place = F.row_number().over(Window.partitionBy("match_id").orderBy("match_id"))
    rows = one.withColumn("block", F.floor((place - 1) / CHUNK)).groupBy("match_id", "block").agg(F.collect_list("left").alias("lefts"))
    others = of_right.groupBy(F.col("class_id").alias("match_id"), F.floor((F.col("place") - 1) / CHUNK).alias("part")).agg(F.collect_list("entity_id").alias("others"))
    return rows.join(others, "match_id").select("lefts", "others")


def unpacked(rows: DataFrame) -> DataFrame:
    """s1_id, match_id and more of each pair of members; nothing is shuffled."""
    each = rows.select(F.explode("lefts").alias("left"), "others").select("left.*", F.explode("others").alias("match_id"))
    return each.select("s1_id", "match_id", *[c for c in each.columns if c not in ("s1_id", "match_id")])


def for_members(found: DataFrame, of_left: DataFrame, of_right: DataFrame) -> DataFrame:
    """found for each pair of members. Ids of the classes travel in arrays; the pairs come out of them after the last join and go nowhere."""

    def ids(of: DataFrame, ident: str, name: str) -> DataFrame:
        return of.groupBy(F.col("class_id").alias(ident), F.floor((F.col("place") - 1) / CHUNK).alias("part")).agg(F.collect_list("entity_id").alias(name)).drop("part")

    half = found.join(ids(of_left, "s1_id", "ids"), "s1_id").drop("s1_id")
    whole = half.join(ids(of_right, "match_id", "others"), "match_id").drop("match_id")
    return whole.withColumn("s1_id", F.explode("ids")).withColumn("match_id", F.explode("others")).select(*found.columns)
