"""The change feed, history, retention and the scan request queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

MOST = 1000


@dataclass(frozen=True)
class Page:
    cursor_valid: bool
    events: list
    next_cursor: int
    has_more: bool


def after(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """Up to limit + 1 events behind a cursor, by id."""
    return events.where(F.col("id") > cursor).orderBy("id").limit(min(limit, MOST) + 1)


def cursor_state(events: DataFrame, cursor: int) -> DataFrame:
    """One row (cursor_valid, cursor_after): a cursor whose next event was pruned is invalid and starts anew at 0; 0 never is, nor is any where no event is left."""
    valid = F.lit(cursor <= 0) | F.coalesce(F.min("id") <= cursor + 1, F.lit(True))
    return events.agg(valid.alias("cursor_valid")).select("cursor_valid", F.when(F.col("cursor_valid"), cursor).otherwise(0).cast("bigint").alias("cursor_after"))


def page(events: DataFrame, cursor: int, limit: int = 100) -> Page:
    """A page of the feed; none behind a cursor that isn't valid."""
    limit = min(limit, MOST)
    state = cursor_state(events, cursor).first()
    if not state["cursor_valid"]:
        return Page(False, [], state["cursor_after"], False)
    rows = after(events, cursor, limit).collect()  # MOST + 1 rows at most
    more = len(rows) > limit
    rows = rows[:limit]
    return Page(True, rows, rows[-1]["id"] if rows else cursor, more)


def history(events: DataFrame, path: str, since=None, until=None) -> DataFrame:
    """Events of a path in order of time, then id; since and until are values of `timestamp`."""
    rows = events.where(F.col("path") == path)
    rows = rows if since is None else rows.where(F.col("timestamp") >= since)
    rows = rows if until is None else rows.where(F.col("timestamp") <= until)
    return rows.orderBy("timestamp", "id")


def versions(events: DataFrame, active: DataFrame) -> DataFrame:
    """(path, versions): distinct contents among a path's events; 0 where the path isn't active now."""
    counted = events.groupBy("path").agg(F.count_distinct("content_hash").alias("n"))
    now = active.select("path", F.lit(True).alias("now")).distinct()
    return counted.join(now, "path", "left").select("path", F.when(F.col("now"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("versions"))


def retained(rows: DataFrame, cutoff, column: str = "timestamp") -> DataFrame:
    """Rows not older than cutoff, which compares with the column's own type."""
    return rows.where(F.col(column) >= cutoff)


def numbered(new: DataFrame, last_id: int, order: list[str], hold=None) -> DataFrame:
    """new events with ids from last_id + 1 on, in order.

    Rows are sorted by range and counted by part, so no task numbers them all. hold writes
    the sorted rows and reads them again, so that the counting and the numbering see the
    same parts whatever executors are lost.
    """
    held = (hold or (lambda df: written(df, "numbered")))(new.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    within = F.col("at") - F.shiftleft(F.col("part").cast("bigint"), 33)
    return held.join(F.broadcast(starts), "part").withColumn("id", (F.col("start") + within + last_id + 1).cast("bigint")).select("id", *new.columns)


# ---- the queue: a few rows, rewritten by the driver

def enqueue(requests: DataFrame, kind: str, root: list[str] | None, now) -> DataFrame:
    spark = requests.sparkSession
    last = requests.agg(F.max("id")).first()[0] or 0
    row = spark.createDataFrame([(last + 1, now, kind, root, "pending", None, None, None, None)], requests.schema)
    return requests.unionByName(row)


def oldest_pending(requests: DataFrame) -> DataFrame:
    return requests.where("status = 'pending'").orderBy("requested_at", "id").limit(1)


def claim(requests: DataFrame, now) -> tuple[int | None, DataFrame]:
    first = oldest_pending(requests).select("id").first()
    if first is None:
        return None, requests
    mine = F.col("id") == first["id"]
    return first["id"], requests.withColumn("status", F.when(mine, "running").otherwise(F.col("status"))).withColumn(
        "started_at", F.when(mine, F.lit(now)).otherwise(F.col("started_at"))
    )


def finish(requests: DataFrame, request_id: int, now, run_id: int | None = None, error: str | None = None) -> DataFrame:
    mine = F.col("id") == request_id
    return (
        requests.withColumn("status", F.when(mine, F.lit("failed" if error else "complete")).otherwise(F.col("status")))
        .withColumn("completed_at", F.when(mine, F.lit(now)).otherwise(F.col("completed_at")))
        .withColumn("scan_run_id", F.when(mine, F.lit(run_id)).otherwise(F.col("scan_run_id")))
        .withColumn("error", F.when(mine, F.lit(error)).otherwise(F.col("error")))
    )


def recovered(rows: DataFrame, reason: str) -> DataFrame:
    """Runs or requests that were running when their process ended, as failed."""
    return rows.withColumn("error", F.when(F.col("status") == "running", F.lit(reason)).otherwise(F.col("error"))).withColumn(
        "status", F.when(F.col("status") == "running", F.lit("failed")).otherwise(F.col("status"))
    )


def progress(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Each request with its run, if it has one, and how long that took in ms."""
    r = runs.select(F.col("id").alias("scan_run_id"), F.col("started_at").alias("run_start"), F.col("finished_at").alias("run_end"), "files_seen")
    took = F.unix_millis("run_end") - F.unix_millis("run_start")
    return requests.join(r, "scan_run_id", "left").select("id", "status", "scan_run_id", "files_seen", took.alias("duration_ms"), "error")


def alive(beats: DataFrame, now: int, within: int = 30) -> DataFrame:
    """(name, state, age, running): the last beat of each watcher, and whether it is recent and not a stop.

    beats: (name, state, at) with at in epoch seconds.
    """
    last = beats.groupBy("name").agg(F.max("at").alias("at"), F.max_by("state", F.struct("at", "state")).alias("state"))
    age = F.lit(now) - F.col("at")
    return last.select("name", "state", age.alias("age"), ((F.col("state") != "stopped") & (age <= within)).alias("running"))
