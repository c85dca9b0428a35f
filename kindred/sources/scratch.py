"""A fresh place for a table in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which goes when its driver ends.

    Only in local mode, where the setting may be unset (tests), a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = f"file://{tempfile.mkdtemp(prefix='kindred-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/kindred-{spark.sparkContext.applicationId}"
    if folder not in _made:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)
        _made.add(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path of the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
