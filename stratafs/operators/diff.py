"""Change detection: two snapshots in, lifecycle events and the next state out.

Everything is a pure function of (previous state, snapshot). Paths meet in one full outer
join. Which hashes were active before, and whether a path of theirs is gone, is
aggregated by hash first, so popular contents make no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, mime


def needs_hash(walked: DataFrame, prev: DataFrame) -> DataFrame:
    """walked with needs_hash: unless size and mtime are those of the active row of the path."""
    known = prev.select("path", F.col("mtime").alias("_mtime"), F.col("size_bytes").alias("_size"), F.col("content_hash").alias("known_hash"))
    same = F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size_bytes").eqNullSafe(F.col("_size")) & F.col("known_hash").isNotNull()
    return walked.join(known, "path", "left").withColumn("needs_hash", ~same).drop("_mtime", "_size")


def hash_history(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(content_hash, any_gone, gone_path): each hash active before, and whether a path of it is unseen now."""
    seen = cur.select("path", F.lit(True).alias("seen")).distinct()
    return (
        prev.join(seen, "path", "left")
        .groupBy("content_hash")
        .agg(F.bool_or(F.col("seen").isNull()).alias("any_gone"), F.min(F.when(F.col("seen").isNull(), F.col("path"))).alias("gone_path"))
    )


def shared_inodes(cur: DataFrame) -> DataFrame:
    """(dev, inode) that more than one path has."""
    return cur.groupBy("dev", "inode").agg(F.count(F.lit(1)).alias("links")).where("links > 1").select("dev", "inode", F.lit(True).alias("linked"))


def change(prev_hash: Column, cur_hash: Column, old_body: Column, new_body: Column) -> Column:
    """The event of a path by itself, before created ones are looked at again."""
    minor = old_body.isNotNull() & (old_body != prev_hash) & old_body.eqNullSafe(new_body)
    return (
        F.when(prev_hash.isNull(), "created").when(cur_hash.isNull(), "deleted")
        .when(prev_hash == cur_hash, F.lit(None).cast("string")).when(minor, "minor_change").otherwise("updated")
    )


def compare(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Each path of either side with both hashes and its event (null: none).

    prev: (path, content_hash, body_hash) active before, body_hash null unless the
    content had frontmatter. cur: (path, content_hash, body_hash, dev, inode).
    """
    old = prev.select("path", F.col("content_hash").alias("prev_hash"), F.col("body_hash").alias("old_body"))
    new = cur.select("path", F.col("content_hash").alias("cur_hash"), F.col("body_hash").alias("new_body"), "dev", "inode")
    return new.join(old, "path", "full_outer").withColumn("event_type", change(F.col("prev_hash"), F.col("cur_hash"), F.col("old_body"), F.col("new_body")))


def resolve_created(compared: DataFrame, prev: DataFrame, cur: DataFrame) -> DataFrame:
    """compare() with created paths told apart: moved, hardlinked, copied or new."""
    history = hash_history(prev, cur).select(F.col("content_hash").alias("cur_hash"), "any_gone", "gone_path")
    created = F.col("event_type") == "created"
    resolved = (
        F.when(created & F.col("any_gone"), "moved").when(created & F.col("any_gone").isNotNull() & F.col("linked"), "hardlinked")
        .when(created & F.col("any_gone").isNotNull(), "copied").otherwise(F.col("event_type"))
    )
    return (
        compared.join(history, "cur_hash", "left").join(shared_inodes(cur), ["dev", "inode"], "left")
        .withColumn("previous_path", F.when(created & F.col("any_gone"), F.col("gone_path")))
        .withColumn("previous_hash", F.when(F.col("event_type").isin("updated", "minor_change", "deleted"), F.col("prev_hash")))
        .withColumn("event_type", resolved)
    )


def events_of(prev: DataFrame, cur: DataFrame, resolve: bool = True) -> DataFrame:
    """(event_type, path, content_hash, previous_hash, previous_path, file_extension, mime_type).

    A move is an event of the new path; the old one is deleted as well. resolve=False
    leaves every new path created, as incremental updates do.
    """
    rows = compare(prev, cur)
    if resolve:
        rows = resolve_created(rows, prev, cur)
    else:
        rows = rows.withColumn("previous_path", F.lit(None).cast("string")).withColumn("previous_hash", F.col("prev_hash"))
    return rows.where(F.col("event_type").isNotNull()).select(
        "event_type", "path", F.coalesce("cur_hash", "prev_hash").alias("content_hash"), "previous_hash", "previous_path",
        extension(F.col("path")).alias("file_extension"), mime(F.col("path")).alias("mime_type"),
    )


def next_paths(paths: DataFrame, cur: DataFrame, generation: int, now: int, retire_below: list[str] | None = None) -> DataFrame:
    """The versioned path table after a scan.

    Closed rows stay. An active row stays with a new stamp if its path has the same
    content, mtime and size; else it is closed and a new one opened. Rows of unseen
    paths are closed, but only below the roots in retire_below where that is given.
    """
    active, closed = paths.where("disappeared is null"), paths.where("disappeared is not null")
    new = cur.select(
        "path", F.col("content_hash").alias("n_hash"), F.col("mtime").alias("n_mtime"), F.col("size_bytes").alias("n_size"),
        F.col("root").alias("n_root"), F.col("inode").alias("n_inode"), F.col("dev").alias("n_dev"),
    )
    both = active.join(new, "path", "full_outer")
    same = F.col("n_hash").eqNullSafe(F.col("content_hash")) & F.col("n_mtime").eqNullSafe(F.col("mtime")) & F.col("n_size").eqNullSafe(F.col("size_bytes"))
    gone = F.col("n_hash").isNull()
    if retire_below is not None:
        below = F.lit(False)
        for root in retire_below:
            below = below | (F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/")
        out_of_scope = gone & ~below
    else:
        out_of_scope = F.lit(False)
    kept = same & F.col("content_hash").isNotNull()
    old_row = F.struct(
        F.lit(0).alias("k"), "root", "content_hash", "mtime", "size_bytes", "inode", "dev", "is_hardlink", "appeared",
        F.when(kept | out_of_scope, F.lit(None).cast("bigint")).otherwise(F.lit(now).cast("bigint")).alias("disappeared"),
        F.when(kept, F.lit(generation).cast("bigint")).otherwise(F.col("last_seen_scan")).alias("last_seen_scan"),
    )
    new_row = F.struct(
        F.lit(1).alias("k"), F.col("n_root").alias("root"), F.col("n_hash").alias("content_hash"), F.col("n_mtime").alias("mtime"),
        F.col("n_size").alias("size_bytes"), F.col("n_inode").alias("inode"), F.col("n_dev").alias("dev"), F.coalesce("linked", F.lit(False)).alias("is_hardlink"),
        F.lit(now).cast("bigint").alias("appeared"), F.lit(None).cast("bigint").alias("disappeared"), F.lit(generation).cast("bigint").alias("last_seen_scan"),
    )
    linked = shared_inodes(cur).select(F.col("dev").alias("n_dev"), F.col("inode").alias("n_inode"), "linked")
    rows = both.join(linked, ["n_dev", "n_inode"], "left").select(
        "path",
        F.explode(F.filter(F.array(F.when(F.col("content_hash").isNotNull(), old_row), F.when(~gone & ~kept, new_row)), lambda r: r.isNotNull())).alias("r"),
    )
    columns = ["path", "root", "content_hash", "mtime", "size_bytes", "inode", "dev", "is_hardlink", "appeared", "disappeared", "last_seen_scan"]
    return rows.select("path", "r.*").select(*columns).unionByName(closed.select(*columns))


def next_documents(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-if-absent by content_hash; a body_hash that was missing is filled in."""
    columns = documents.columns
    first = new.groupBy("content_hash").agg(F.min(F.struct("path", *(c for c in columns if c != "content_hash"))).alias("n"))
    both = documents.withColumn("known", F.lit(True)).join(first, "content_hash", "full_outer")
    value = lambda c: (
        F.coalesce(F.col(c), F.col("n.body_hash")) if c == "body_hash" else F.when(F.col("known"), F.col(c)).otherwise(F.col(f"n.{c}"))
    )
    return both.select(*(F.col(c) if c == "content_hash" else value(c).alias(c) for c in columns))


def next_catalog(catalog: DataFrame, current: DataFrame) -> DataFrame:
    """Totals of this scan's directories beside those of the last; directories not seen stay as they are."""
    now = current.select("path", F.col("total_bytes").alias("n_bytes"), F.col("file_count").alias("n_files"))
    both = catalog.join(now, "path", "full_outer")
    seen = F.col("n_bytes").isNotNull()
    return both.select(
        "path",
        F.when(seen, F.col("n_bytes")).otherwise(F.col("total_bytes")).alias("total_bytes"),
        F.when(seen, F.col("n_files")).otherwise(F.col("file_count")).alias("file_count"),
        F.when(seen, F.col("total_bytes")).otherwise(F.col("previous_total_bytes")).alias("previous_total_bytes"),
        F.when(seen, F.col("file_count")).otherwise(F.col("previous_file_count")).alias("previous_file_count"),
        F.coalesce("regenerable", F.lit(True)).alias("regenerable"),
    )


def tally(events: DataFrame) -> DataFrame:
    """Counts by event type."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
