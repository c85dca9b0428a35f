"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group.

Built from DataFrame functions only. The grouping key is (hash, normalised text): rows meet by hash and the
aggregate then tells texts apart byte by byte, so two texts with one hash stay two groups. Both aggregates
combine inside each map task before the shuffle, so a group that holds a third of all rows arrives as one row
per map task. The join that carries a group's id back to its rows has an exchange on either side, which lets
adaptive execution split a hot hash.

Defined results: a null text counts as empty. A null id counts as the largest. Equal ids are one document: in
`annotate` rows that repeat the kept id are all marked kept, in `deduplicate` one of them stays. An empty
table gives an empty result. A very long text is one value of Spark's, up to its limit of 2 GB. Other columns,
whatever their names, pass `deduplicate` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; each run of it counts as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("body"))
    keyed = texts.select("doc_id", F.md5("body").alias("h"), F.sha2("body", 256).alias("text_sha256"))
    groups = (
        texts.groupBy(F.md5("body").alias("h"), "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return keyed.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows with equal texts, the one with the smallest id; all columns of docs, in one shuffle and without a join."""

    def sortable(kind: T.DataType) -> bool:
        return not isinstance(kind, (T.MapType, T.VariantType)) and all(
            sortable(x) for x in ([f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [])
        )

    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    text, ident = F.col(names[text_col]), F.col(names[id_col])
    kinds = {names[f.name]: f.dataType for f in docs.schema.fields}
    rest = [F.col(c) for c, kind in kinds.items() if c not in (names[id_col], names[text_col]) and sortable(kind)]
    # the text travels once: as the group's key, and in the row only where normalising has changed it
    changed = F.nullif(text, F.col("body"))
    kept = docs.toDF(*names.values()).withColumn("body", normalised(text)).select(
        F.md5("body").alias("h"),
        "body",
        F.struct(ident.isNull(), ident, changed, *rest).alias("rank"),
        F.struct(*[(changed if c == names[text_col] else F.col(c)).alias(c) for c in kinds], text.isNull().alias("void")).alias("row"),
    )
    first = kept.groupBy("h", "body").agg(F.min_by("row", "rank").alias("row"))
    whole = F.when(~F.col("row.void"), F.coalesce(F.col("row")[names[text_col]], F.col("body")))
    return first.select(*[(whole if c == text_col else F.col("row")[names[c]]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
