"""Rules for result files, as one table of findings (rule, severity, n, examples)."""

from __future__ import annotations

import argparse
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.text import is_blank
from kindred.sources import tsv

# The headers of result files, and where the candidates are if no path is given.
MATCHING, CANDIDATES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids")
USUAL_CANDIDATES = "output/candidate_pairs.tsv"
EXAMPLES = 5
FINDING = "rule string, severity string, n long, examples string"


class Part(NamedTuple):
    """A rule, its severity, and a frame of what breaks it."""

    rule: str
    severity: str
    offenders: DataFrame
    column: str


def findings(parts: list[Part], names: list[str] | None = None) -> DataFrame:
    """A row for each rule (of each name, if the parts have some) that is broken: how many distinct offenders, and the first in order.

    One pass for all rules. The examples are a top-k that each task cuts before the shuffle, never a full list.
    """
    key = ["name", "rule", "severity"]
    every = [p.offenders.select(F.lit(n).alias("name"), F.lit(p.rule).alias("rule"), F.lit(p.severity).alias("severity"), F.col(p.column).cast("string").alias("x")) for p, n in zip(parts, names or [""] * len(parts), strict=True)]
    distinct = reduce(DataFrame.unionByName, every).distinct()
    total = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    first = distinct.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("x"))).where(F.col("place") <= EXAMPLES)
    some = first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
    return total.join(some, key).select("rule", "severity", "n", "examples")


def row_parts(rows: DataFrame) -> list[Part]:
    whole = rows.where("tab")
    repeated = whole.groupBy("s1_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    twice = whole.where(~is_blank(F.col("ids"))).where(F.size(F.split("ids", ",")) != F.size(F.array_distinct(F.split("ids", ","))))
    return [Part("C4", "error", rows.where(~F.col("tab") & ~is_blank(F.col("s1_id"))), "line"), Part("C5", "error", repeated, "s1_id"), Part("C6", "error", twice, "s1_id")]


def row_rules(rows: DataFrame) -> DataFrame:
    """Findings on rows (line, tab, s1_id, ids): C4 rows without a tab, C5 repeated rows, C6 repeated ids."""
    return findings(row_parts(rows))


def listed_ids(rows: DataFrame) -> DataFrame:
    """s1_id, id of each listed id; ids are not trimmed, and a trailing comma gives an empty one."""
    return rows.where("tab").where(~is_blank(F.col("ids"))).select("s1_id", F.explode(F.split("ids", ",")).alias("id"))


def kind(c: Column) -> Column:
    """Which of the rules C7 (an id of source 1), C8 (of no source) an id breaks, if any."""
    return F.when(c.startswith("S1-"), "C7").when(~(c.startswith("S2-") | c.startswith("S3-")), "C8")


def id_parts(rows: DataFrame, valid: DataFrame | None = None) -> list[Part]:
    ids = listed_ids(rows).select("id").distinct().withColumn("rule", kind(F.col("id")))
    parts = [Part(r, "error", ids.where(F.col("rule") == r), "id") for r in ("C7", "C8")]
    if valid is not None:
        parts.append(Part("C9", "error", ids.where("rule is null").join(valid.select(F.col("entity_id").alias("id")), "id", "left_anti"), "id"))
    return parts


def id_rules(rows: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """C7, C8, and with `valid` (entity_id) C9: an id breaks one of them at most."""
    return findings(id_parts(rows, valid))


def entity_parts(rows: DataFrame, required: DataFrame) -> list[Part]:
    seen, need = rows.where("tab").select("s1_id").distinct(), required.select(F.col("entity_id").alias("s1_id")).distinct()
    return [Part("C10", "error", need.join(seen, "s1_id", "left_anti"), "s1_id"), Part("C11", "error", seen.join(need, "s1_id", "left_anti"), "s1_id")]


def entity_rules(rows: DataFrame, required: DataFrame) -> DataFrame:
    """C10 required entities (entity_id) without a row, C11 rows of others."""
    return findings(entity_parts(rows, required))


def last_lists(rows: DataFrame) -> DataFrame:
    """s1_id, id of each entity's last row: a repeated row replaces the one before."""
    last = rows.where("tab").groupBy("s1_id").agg(F.max_by(F.coalesce("ids", F.lit("")), "line").alias("ids")).withColumn("tab", F.lit(True))
    return listed_ids(last).distinct()


def subset_part(matching: DataFrame, candidates: DataFrame) -> Part:
    return Part("C12", "warning", last_lists(matching).join(last_lists(candidates), ["s1_id", "id"], "left_anti"), "s1_id")


def subset_rule(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities with a match that is not among their candidates."""
    return findings([subset_part(matching, candidates)])


def summary(rows: DataFrame) -> DataFrame:
    """One row: rows, empty, filled."""
    empty = is_blank(F.col("ids"))
    return rows.where("tab").agg(F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("empty"), F.count_if(~empty).alias("filled"))


def header_findings(spark: SparkSession, path: str, expected: tuple[str, str]) -> list[tuple[str, str, int, str]]:
    """C1 to C3, on the driver: they need the path and the first line only."""
    if not tsv.exists(spark, path):
        return [("C1", "error", 1, f"not found: {path}")]
    first = spark.read.text(path).head(1)
    if not first:
        return [("C1", "error", 1, f"empty: {path}")]
    line = first[0][0]
    if "\t" not in line and "," in line:
        return [("C2", "error", 1, line)]
    if tuple(c.strip().lower() for c in line.split("\t")) != expected:
        return [("C3", "error", 1, line)]
    return []


def validate(spark: SparkSession, matching: str, candidates: str | None, folder: str, check_ids: bool = False) -> DataFrame:
    """All findings on a matching file and, if it is there, a candidate file, against the test sources in a folder."""
    notes: list[tuple[str, str, int, str]] = []
    parts: list[Part] = []
    names: list[str] = []
    files = tsv.paths(folder, "test")
    valid = None
    if not tsv.exists(spark, files["source1"]):
        return spark.createDataFrame([("C1", "error", 1, f"not found: {files['source1']}")], FINDING)
    required = tsv.read_ids(spark, files["source1"])
    if not check_ids:
        notes.append(("C14", "warning", 1, "ids were not looked up"))
    elif not all(tsv.exists(spark, files[s]) for s in ("source2", "source3")):
        notes.append(("C9", "warning", 1, "sources 2 and 3 are not there"))
    else:
        valid = tsv.read_ids(spark, files["source2"]).unionByName(tsv.read_ids(spark, files["source3"]))
    rows: dict[str, DataFrame] = {}
    for name, path, header in (("matching", matching, MATCHING), ("candidates", candidates, CANDIDATES)):
        if name == "candidates" and not path:
            continue
        if name == "candidates" and not tsv.exists(spark, path):
            notes.append(("C13", "warning", 1, f"not found: {path}"))
            continue
        bad = header_findings(spark, path, header)
        if not bad and not tsv.is_valid_utf8(spark, path):
            bad = [("R6", "error", 1, f"not UTF-8: {path}")]
        if bad:
            notes += bad
            continue
        rows[name] = tsv.result_rows(tsv.lines(spark, path)).persist()
        parts += [*row_parts(rows[name]), *id_parts(rows[name], valid), *entity_parts(rows[name], required)]
        names += [name] * (len(parts) - len(names))
    if len(rows) == 2:
        parts.append(subset_part(rows["matching"], rows["candidates"]))
        names.append("both")
    found = [*notes, *(findings(parts, names).collect() if parts else [])]  # a row for each rule and file at most
    for r in rows.values():
        r.unpersist()
    return spark.createDataFrame(found, FINDING)


def main(arguments: list[str] | None = None) -> int:
    """The command line: 0 if no error was found, 1 otherwise; warnings never fail."""
    parser = argparse.ArgumentParser(description="Checks result files.")
    parser.add_argument("-m", "--matching", required=True)
    parser.add_argument("-c", "--candidates")
    parser.add_argument("-t", "--test-dir", required=True)
    parser.add_argument("--check-ids", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("result checks").getOrCreate()
    failed = False
    for r in validate(spark, given.matching, given.candidates or USUAL_CANDIDATES, given.test_dir, given.check_ids).collect():
        print(f"{r.severity}: {r.rule}: {r.n}: {r.examples}")
        failed |= r.severity == "error"
    print("FAIL" if failed else "PASS")
    return int(failed)


if __name__ == "__main__":
    raise SystemExit(main())
