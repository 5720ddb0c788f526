"""What a stopped debounce stream still holds, flushed once.

Idle keys are flushed by later notifications' time, so the last ones stay in state when a
stream stops. They are read from the state of its last batch. What was flushed so is
written beside the checkpoint: a stream that goes on from it leaves out a flush that says
the same, and keeps one that has more to say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .debounce import CAP, CLOSED, IDLE

FLUSHES = "key string, kind string, from_key string, first_ms bigint, flush_ms bigint"


def held(spark: SparkSession, checkpoint: str, idle: int = IDLE, cap: int = CAP, closed: int = CLOSED) -> DataFrame:
    """(key, kind, from_key, first_ms, flush_ms): the flushes that debounced_stream()'s state would still give, with nothing after it."""
    state = spark.read.format("statestore").load(checkpoint)
    group = "value.groupState" if "groupState" in state.select("value.*").columns else "value"
    rows = state.select(F.col("key.key").alias("key"), f"{group}.*")
    due = F.least(F.col("last") + F.when(F.col("closed"), closed).otherwise(idle), F.col("first") + cap)
    return rows.where("kind is not null").select("key", "kind", F.col("source").alias("from_key"), F.col("first").alias("first_ms"), due.cast("bigint").alias("flush_ms"))


def _folder(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-drained"


def drained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All that was flushed by drain()."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(checkpoint))
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(FLUSHES).parquet(_folder(checkpoint)) if there else spark.createDataFrame([], FLUSHES)


def undrained(flushes: DataFrame, checkpoint: str) -> DataFrame:
    """flushes without those that drain() has given."""
    return flushes.join(drained(flushes.sparkSession, checkpoint).select("key", "first_ms", "flush_ms"), ["key", "first_ms", "flush_ms"], "left_anti")


def drain(spark: SparkSession, checkpoint: str, **waits: int) -> DataFrame:
    """The flushes of a stopped stream's state that weren't drained before."""
    known = drained(spark, checkpoint)
    before = known.count()
    undrained(held(spark, checkpoint, **waits), checkpoint).write.mode("append").parquet(_folder(checkpoint))
    if not before:
        return drained(spark, checkpoint)
    files = known.select(F.input_file_name().alias("f")).distinct()
    return drained(spark, checkpoint).withColumn("f", F.input_file_name()).join(files, "f", "left_anti").drop("f")
