"""Which paths a batch of debounced changes touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affected(flushes: DataFrame) -> DataFrame:
    """(path, present): each path that a batch of flushes touches, by its latest flush; the source of a move is gone."""
    own = flushes.select(F.col("key").alias("path"), "flush_ms", (F.col("kind") != "Delete").alias("present"))
    left = flushes.where("from_key is not null").select(F.col("from_key").alias("path"), "flush_ms", F.lit(False).alias("present"))
    return own.unionByName(left).groupBy("path").agg(F.max_by("present", "flush_ms").alias("present"))


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """What the active rows of some paths change to: their new rows, and `gone` ones of paths that have none any more."""
    now = after.where("disappeared is null").withColumn("gone", F.lit(False))
    left = before.join(now.select("path"), "path", "left_anti").withColumn("gone", F.lit(True))
    return now.unionByName(left)
