"""Following a tree: raw notifications from a landing folder, paired, debounced and applied.

A notifier on each host appends JSON lines (path, raw, cookie, ts) to the landing folder;
each file in it is read once. The checkpoint takes the place of a recovery pass.
"""

from __future__ import annotations

from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import debounce, drain

RAW = "path string, raw string, cookie bigint, ts timestamp"
PAIRED = "key string, ms bigint, kind string, from_key string, ts timestamp"


def raw_stream(spark: SparkSession, landing: str, delay: str = "1 second") -> DataFrame:
    """(key, ms, kind, cookie, ts) of the notifications that mean a change."""
    raw = spark.readStream.schema(RAW).json(landing).withColumnRenamed("path", "key")
    return debounce.mapped(raw).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)


def paired_stream(events: DataFrame, within: int = debounce.PAIR) -> DataFrame:
    """debounce.paired() of a stream: the sides of a rename meet in state by their cookie.

    Notifications without a cookie are spread over many keys and pass through. A side
    that waits for another is held until `within` ms of event time have gone by.
    """
    state = "key string, ms bigint"

    def step(group, pdfs, handle):
        out = []
        waiting = tuple(handle.get) if handle.exists else None
        if handle.hasTimedOut and waiting:
            out.append((waiting[0], waiting[1] + within, "Delete", None))
            waiting = None
        for pdf in pdfs:
            for key, ms, kind in sorted(zip(pdf["key"].tolist(), pdf["ms"].tolist(), pdf["kind"].tolist()), key=lambda x: (x[1], x[2])):
                if kind == "MovedFrom":
                    if waiting:
                        out.append((waiting[0], waiting[1] + within, "Delete", None))
                    waiting = (key, ms)
                elif kind == "MovedTo":
                    paired = waiting is not None and ms - waiting[1] <= within
                    if waiting and not paired:
                        out.append((waiting[0], waiting[1] + within, "Delete", None))
                    out.append((key, ms, "Moved" if paired else "Create", waiting[0] if paired else None))
                    waiting = None
                else:
                    out.append((key, ms, kind, None))
        if waiting is None:
            handle.remove()
        else:
            handle.update(waiting)
            handle.setTimeoutTimestamp(max(waiting[1] + within, handle.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["key", "ms", "kind", "from_key"])
        frame["ts"] = pd.to_datetime(frame["ms"].astype("int64"), unit="ms")
        yield frame

    # what has no cookie needs no state, but one operator keeps the order of both
    spread = F.concat(F.lit("k"), F.hash("key").cast("string"))
    by = F.when(F.col("kind").isin("MovedFrom", "MovedTo") & F.col("cookie").isNotNull(), F.concat(F.lit("c"), F.col("cookie").cast("string"))).otherwise(spread)
    return events.withColumn("by", by).groupBy("by").applyInPandasWithState(step, PAIRED, state, "append", "EventTimeTimeout")


def watch(index, landing: str, checkpoint: str, trigger: dict | None = None, every: int | None = None) -> StreamingQuery:
    """Apply the changes that arrive in a landing folder to an index until the query is stopped.

    After each micro-batch a full scan runs if the last is `every` seconds ago, and so do
    the requests that wait. A rename that is split over two micro-batches further apart than the watermark allows
    shows as a Delete and a Create, which leaves the same paths.
    """
    # each notification goes straight to its path's buffer: renames as their two sides
    events = raw_stream(index.spark, landing)
    sides = F.when(F.col("kind") == "MovedFrom", "Delete").when(F.col("kind") == "MovedTo", "Create").otherwise(F.col("kind"))
    plain = events.select("key", "ms", sides.alias("kind"), F.lit(None).cast("string").alias("from_key"), "ts")
    flushes = debounce.debounced_stream(plain)

    def apply(batch: DataFrame, _: int) -> None:
        now = int(datetime.now(UTC).timestamp())
        index.apply(drain.undrained(batch, checkpoint), now)
        if every and index.due(now, every):  # what was missed shows at the latest by then
            index.request("full", None, now)
        index.drain()

    writer = flushes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(**trigger) if trigger else writer).start()


def finish(index, checkpoint: str) -> DataFrame:
    """After a watch has stopped: apply what its state still holds, once; the events of that."""
    return index.apply(drain.drain(index.spark, checkpoint), int(datetime.now(UTC).timestamp()))


def overflows(index, landing: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Ask for a full scan where a notifier says that it has lost notifications (raw "overflow").

    A request is put into the queue, which watch() drains, so that one writer scans.
    """
    lost = index.spark.readStream.schema(RAW).json(landing).where("raw = 'overflow'")

    def ask(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.request("full")

    writer = lost.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(ask)
    return (writer.trigger(**trigger) if trigger else writer).start()
