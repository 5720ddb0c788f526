"""Debouncing raw file notifications, as a stream and as a replay of a table.

A path's notifications are buffered; the latest kind wins. It is flushed after `idle` ms
without another one (`closed` ms once its file was closed after writing), or `cap` ms
after the first. Flush times follow from the notifications alone, so a replay gives what
the stream gives.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

HOUR = 3_600_000
IDLE, CAP, CLOSED, PAIR = 1000, 5000, 100, 1000
OUT = "key string, kind string, from_key string, first_ms bigint, flush_ms bigint"


@dataclass
class Pending:
    """What is buffered for one key."""

    kind: str
    first: int
    last: int
    closed: bool = False
    source: str | None = None

    def deadline(self, idle: int = IDLE, cap: int = CAP, closed: int = CLOSED) -> int:
        return min(self.last + (closed if self.closed else idle), self.first + cap)

    def take(self, kind: str, ms: int, source: str | None = None) -> None:
        self.last = ms
        if kind == "CloseWrite":
            self.closed = True
        else:
            self.kind, self.source, self.closed = kind, source, False


def pending(kind: str, ms: int, source: str | None = None) -> Pending:
    return Pending("Modify" if kind == "CloseWrite" else kind, ms, ms, kind == "CloseWrite", source)


def mapped(raw: DataFrame) -> DataFrame:
    """Raw notification names as kinds; what is no change is dropped."""
    kind = (
        F.when(F.col("raw").isin("create_file", "create_folder", "create_any"), "Create")
        .when(F.col("raw").isin("modify_data", "modify_metadata", "modify_any"), "Modify")
        .when(F.col("raw").isin("remove_file", "remove_folder", "remove_any"), "Delete")
        .when(F.col("raw") == "close_write", "CloseWrite").when(F.col("raw") == "rename_from", "MovedFrom").when(F.col("raw") == "rename_to", "MovedTo")
    )
    return raw.withColumn("kind", kind).where("kind is not null").drop("raw")


def paired(events: DataFrame, within: int = PAIR) -> DataFrame:
    """(key, ms, kind, from_key): the two sides of renames joined by their cookie.

    A from within `within` ms before its to makes a Moved of the new key; a to alone is a
    Create; a from alone is a Delete, `within` ms later. Other kinds stay. Sides of one
    cookie, time and kind follow each other by id, where events have one, else by key.
    """
    plain = events.where("kind not in ('MovedFrom', 'MovedTo')").select("key", "ms", "kind", F.lit(None).cast("string").alias("from_key"))
    sides = events.where("kind in ('MovedFrom', 'MovedTo')").withColumn("cookie", F.coalesce("cookie", F.hash("key", "ms").cast("bigint")))
    w = Window.partitionBy("cookie").orderBy("ms", "kind", *(c for c in ("id", "key") if c in sides.columns))
    seen = sides.select(
        "*", F.lag("kind").over(w).alias("k0"), F.lag("key").over(w).alias("key0"), F.lag("ms").over(w).alias("ms0"),
        F.lead("kind").over(w).alias("k1"), F.lead("ms").over(w).alias("ms1"),
    )
    moved = (F.col("kind") == "MovedTo") & F.coalesce((F.col("k0") == "MovedFrom") & (F.col("ms") - F.col("ms0") <= within), F.lit(False))
    gone = (F.col("kind") == "MovedFrom") & ~F.coalesce((F.col("k1") == "MovedTo") & (F.col("ms1") - F.col("ms") <= within), F.lit(False))
    return plain.unionByName(
        seen.where(moved | gone | (F.col("kind") == "MovedTo")).select(
            "key", F.when(gone, F.col("ms") + within).otherwise(F.col("ms")).alias("ms"),
            F.when(moved, "Moved").when(gone, "Delete").otherwise("Create").alias("kind"), F.when(moved, F.col("key0")).alias("from_key"),
        )
    )


def replay(events: DataFrame, idle: int = IDLE, cap: int = CAP, closed: int = CLOSED, part_ms: int | None = None) -> DataFrame:
    """The flushes of a table of (key, ms, kind, from_key), everything drained at its end.

    A key's time is cut into parts of part_ms, which are worked on apart. A gap of idle
    (closed, after a close) always begins a buffer, whatever was before; else one begins cap
    after the last began. So a part that holds such a gap ends in a state of its own, and
    hands it to the next; one without any takes its state from the part before, in as many
    rounds as such parts follow each other. A part's moments are an array, of at most
    part_ms numbers. Rows without a key or time are left out; ties are ordered by kind.
    """
    if min(idle, cap, closed) < 1:
        raise ValueError("idle, cap and closed are milliseconds from 1 on")
    width = part_ms or max(HOUR, 16 * cap)
    rows = events.where("key is not null and ms is not null").select(
        "key", "ms", "kind", "from_key", F.hash("kind", "from_key").alias("tie"), F.floor(F.col("ms") / width).alias("part")
    )
    wait = lambda shut: F.when(shut, closed).otherwise(idle)
    moments = rows.groupBy("key", "part", "ms").agg(F.max(F.struct("kind", "tie")).alias("last")).select("key", "part", "ms", (F.col("last.kind") == "CloseWrite").alias("shut"))
    # a row a part: the last moment of the part before
    ends = moments.groupBy("key", "part").agg(F.max(F.struct("ms", "shut")).alias("last"))
    by_key = Window.partitionBy("key").orderBy("part")
    ends = ends.select("key", "part", F.lag("last").over(by_key).alias("before"), F.lag("part").over(by_key).alias("part_before"))
    held = moments.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("ms", "shut"))).alias("at")).join(ends, ["key", "part"])
    follows = lambda m, last: m["ms"] - last["ms"] >= wait(last["shut"])
    fresh = F.transform("at", lambda m, i: F.struct(m["ms"].alias("ms"), F.when(i == 0, F.coalesce(follows(m, F.col("before")), F.lit(True))).otherwise(follows(m, F.get("at", i - 1))).alias("fresh")))
    begins = lambda first, m: m["fresh"] | first.isNull() | (m["ms"] >= first + cap)
    left = lambda first: F.aggregate("at", first.cast("bigint"), lambda f, m: F.when(begins(f, m), m["ms"]).otherwise(f))
    parts = written(
        held.select("key", "part", "part_before", fresh.alias("at")).withColumn("left", F.when(F.exists("at", lambda m: m["fresh"]), left(F.lit(None)))), "parts"
    )
    handed = parts.where("left is not null").select("key", F.col("part").alias("part_before"), F.col("left").alias("entry"))
    through = parts.where("left is null")
    while not through.isEmpty():
        met = through.drop("left").join(handed, ["key", "part_before"])
        now = written(met.select("key", F.col("part").alias("part_before"), left(F.col("entry")).alias("entry")), "handed")
        handed = written(handed.unionByName(now), "handed")
        through = written(through.join(now.select("key", F.col("part_before").alias("part")), ["key", "part"], "left_anti"), "through")
    entered = parts.drop("left").join(handed, ["key", "part_before"], "left")
    begun = F.struct(F.col("entry").cast("bigint").alias("first"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(
        "at", begun, lambda acc, m: F.struct(F.when(begins(acc["first"], m), m["ms"]).otherwise(acc["first"]).alias("first"), F.when(begins(acc["first"], m), F.concat(acc["starts"], F.array(m["ms"]))).otherwise(acc["starts"]).alias("starts"))
    )["starts"]
    marked = rows.join(entered.select("key", F.explode(starts).alias("ms")).withColumn("start", F.col("ms")), ["key", "ms"], "left")
    since = Window.partitionBy("key", "part").orderBy("ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    owned = marked.withColumn("since", F.last("start", ignorenulls=True).over(since)).join(entered.where("entry is not null").select("key", "part", "entry"), ["key", "part"], "left")
    order = F.struct("ms", "kind", "tie")
    real = F.when(F.col("kind") != "CloseWrite", order)
    buffers = owned.groupBy("key", F.coalesce("since", "entry").alias("first_ms")).agg(
        F.max_by("kind", real).alias("kind"), F.max_by("from_key", real).alias("from_key"), F.max(order).alias("last")
    )
    due = F.least(F.col("last.ms") + wait(F.col("last.kind") == "CloseWrite"), F.col("first_ms") + cap)
    return buffers.select("key", F.coalesce("kind", F.lit("Modify")).alias("kind"), "from_key", "first_ms", due.alias("flush_ms"))


def debounced_stream(events: DataFrame, idle: int = IDLE, cap: int = CAP, closed: int = CLOSED) -> DataFrame:
    """The same flushes of a stream (key, ms, kind, from_key, ts), by state with event-time timers.

    The stream needs a watermark on ts, by whose progress idle keys are flushed.
    """
    state = "kind string, first bigint, last bigint, closed boolean, source string"

    def step(group, pdfs, handle):
        (key,) = group
        out = []
        held = Pending(*handle.get) if handle.exists else None
        if handle.hasTimedOut and held is not None:
            out.append((key, held.kind, held.source, held.first, held.deadline(idle, cap, closed)))
            held = None
        for pdf in pdfs:
            for ms, kind, source in sorted(zip(pdf["ms"].tolist(), pdf["kind"].tolist(), pdf["from_key"].tolist()), key=lambda x: (x[0], x[1])):
                if held is not None and ms >= held.deadline(idle, cap, closed):
                    out.append((key, held.kind, held.source, held.first, held.deadline(idle, cap, closed)))
                    held = None
                if held is None:
                    held = pending(kind, ms, source)
                else:
                    held.take(kind, ms, source)
        if held is None:
            handle.remove()
        else:
            handle.update((held.kind, held.first, held.last, held.closed, held.source))
            handle.setTimeoutTimestamp(max(held.deadline(idle, cap, closed), handle.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "kind", "from_key", "first_ms", "flush_ms"])

    return events.groupBy("key").applyInPandasWithState(step, OUT, state, "append", "EventTimeTimeout")
