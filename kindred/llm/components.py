"""Connected components of a link table by minimum labels with pointer jumping, in the executors only.

Each round gives a node the smallest label among itself, its neighbours and its label's label, and is written to
the shared folder, so that lineage stays short and every join of the next round has an exchange on either side
(a hot node can then be split). Labels only fall; the rounds end when none has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that it reaches) for each node of links (a, b)."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = edges.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        jump = labels.join(labels.toDF("label", "far"), "label").select("node", F.col("label").alias("was"), "far")
        moved = written(jump.join(near, "node").select("node", "was", F.least("was", "far", "near").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels
