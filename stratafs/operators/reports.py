"""Analytical reports: directory roll-ups, duplicates, redundancy across roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

MEDIA_BYTES, MEDIA_FILES, MEDIA_SHARE, MEDIA_EXTS = 1 << 30, 10, 0.90, 3
COLLAPSE = 3


#: Rows of a range of sorted paths on average, ranges at most, and paths for each of them from which bounds are drawn.
RANGE, RANGES, DRAWN = 100_000, 1024, 40


def tree_key(path: Column) -> Column:
    """A string whose order keeps what lies under a directory together: slashes come before all else."""
    apart = F.replace(F.replace(path, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.replace(apart, F.lit("/"), F.lit("\x00"))


def _bounds(paths: DataFrame, rows: int) -> list[str]:
    """Keys that divide so many paths into ranges of about RANGE rows."""
    total = paths.count()
    ranges = min(RANGES, -(-total // rows))
    if ranges < 2:
        return []
    some = paths.where(F.pmod(F.xxhash64("path", F.lit(17)), F.lit(max(1, total // (ranges * DRAWN)))) == 0)
    keys = sorted(r[0] for r in some.where("path is not null").select(tree_key(F.col("path"))).collect())  # about RANGES * DRAWN at most
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def under(paths: DataFrame, dirs: DataFrame, how: str, rows: int | None = None) -> DataFrame:
    """Rows of paths that lie (left_semi) or don't lie (left_anti) under one of dirs (path).

    In the order of tree_key() what lies under a directory is an interval. Paths and
    directories are dealt to ranges of that order once, however deep they are; there a
    path is covered if an interval that began before it ends behind it. The farthest
    end of earlier ranges goes along as one value a range. A null path lies nowhere.
    """
    bounds = _bounds(paths, RANGE if rows is None else rows)
    edges = F.array(*map(F.lit, bounds)).cast("array<string>")
    part = lambda key: F.size(F.filter(edges, lambda b: b <= key))
    keyed = paths.select(F.struct("*").alias("row"), tree_key(F.col("path")).alias("key"), F.lit(None).cast("string").alias("end")).withColumn("part", part(F.col("key")))
    start = F.concat(tree_key(F.col("path")), F.lit("\x00"))
    spans = dirs.where("path is not null").select(F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), start.alias("key"), F.concat(tree_key(F.col("path")), F.lit("\x01")).alias("end")).distinct()
    spans = spans.withColumn("part", part(F.col("key")))
    # a row a range at most
    ends = spans.groupBy("part").agg(F.max("end").alias("far"))
    known = paths.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    carried = known.select("part", F.max("far").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    before = Window.partitionBy("part").orderBy("key", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = keyed.unionByName(spans).withColumn("far", F.max("end").over(before)).join(F.broadcast(carried), "part", "left")
    covered = F.coalesce(F.greatest("far", "carried") > F.col("key"), F.lit(False))
    return met.where(F.col("row").isNotNull() & (covered if how == "left_semi" else ~covered)).select("row.*")


def duplicates(active: DataFrame) -> DataFrame:
    """(content_hash, size_bytes, n_paths, path): each path of a content that has more than one.

    Groups are counted before paths join them, so a popular content is many rows and no long one.
    """
    groups = active.groupBy("content_hash").agg(F.max("byte_size").alias("size_bytes"), F.count(F.lit(1)).alias("n_paths")).where("n_paths > 1")
    return active.select("content_hash", "path").join(groups, "content_hash").select("content_hash", "size_bytes", "n_paths", "path")


def canonical_order(groups: DataFrame, tier: Column | None = None) -> DataFrame:
    """duplicates() with score and each group's best path as canonical, in order of groups and scores; tier: an expression over `path`.

    The sort is by ranges, which cut large groups.
    """
    scored = groups.withColumn("score", P.canonical_score(F.col("path"), F.lit("indexed") if tier is None else tier))
    best = scored.groupBy("content_hash").agg(F.min(_best_first(scored)).alias("b")).select("content_hash", F.col("b.path").alias("canonical"))
    return scored.join(best, "content_hash").select(*scored.columns, "canonical").orderBy("content_hash", F.desc("score"), "path")


def _best_first(groups: DataFrame) -> Column:
    return F.struct((-F.col("score") if "score" in groups.columns else F.lit(0)).alias("s"), "path")


def directory_pairs(groups: DataFrame, least: int = COLLAPSE) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): groups of two paths in different directories, rolled up by (dir_a, dir_b) where there are at least that many."""
    two = (
        groups.where("n_paths = 2").groupBy("content_hash").agg(F.max("size_bytes").alias("size_bytes"), F.min(_best_first(groups)).alias("a"), F.max(_best_first(groups)).alias("b"))
        .select("content_hash", "size_bytes", P.parent(F.col("a.path")).alias("dir_a"), P.parent(F.col("b.path")).alias("dir_b")).where("dir_a <> dir_b")
    )
    pairs = two.groupBy("dir_a", "dir_b").agg(F.sum("size_bytes").alias("total_bytes"), F.count(F.lit(1)).alias("n_groups")).where(F.col("n_groups") >= least)
    collapsed = two.join(pairs, ["dir_a", "dir_b"], "left_semi").select("content_hash")
    return pairs, groups.join(collapsed, "content_hash", "left_anti")


def by_extension(active: DataFrame) -> DataFrame:
    """(dir, ext, bytes, n): each directory's own files by extension; a null size counts 0. One scan, from which all directory figures come."""
    named = active.select(P.parent(F.col("path")).alias("dir"), P.extension(F.col("path")).alias("ext"), F.coalesce("byte_size", F.lit(0)).alias("size"))
    return named.groupBy("dir", "ext").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _totals(by_ext: DataFrame) -> DataFrame:
    return by_ext.groupBy("dir").agg(F.sum("bytes").alias("total_bytes"), F.sum("n").alias("file_count"), F.coalesce(F.sum(F.when(F.col("ext").isNotNull(), F.col("n"))), F.lit(0)).alias("with_ext"))


def directory_stats(active: DataFrame) -> DataFrame:
    """(dir, total_bytes, file_count, with_ext) of each directory's own files; a null size counts 0."""
    return _totals(by_extension(active))


def _shares(by_ext: DataFrame, least_bytes: int = MEDIA_BYTES, least_files: int = MEDIA_FILES, share: float = MEDIA_SHARE) -> DataFrame:
    kinds = [(ext, family) for family, exts in (("audio", P.AUDIO), ("video", P.VIDEO), ("image", P.IMAGE)) for ext in exts]
    families = by_ext.sparkSession.createDataFrame(kinds, "ext string, family string")  # a few rows
    media = by_ext.join(F.broadcast(families), "ext")
    order = Window.partitionBy("dir", "family").orderBy(F.desc("n"), "ext")
    top = (
        media.withColumn("rn", F.row_number().over(order)).groupBy("dir", "family")
        .agg(F.sum("n").alias("of_family"), F.array_sort(F.collect_list(F.when(F.col("rn") <= MEDIA_EXTS, F.struct("rn", "ext")))).alias("best"))
    )
    joined = top.join(_totals(by_ext), "dir").withColumn("share", F.col("of_family") / F.col("with_ext"))
    return joined.where((F.col("share") > share) & (F.col("total_bytes") >= least_bytes) & (F.col("file_count") >= least_files)).select(
        "dir", "family", "total_bytes", "file_count", "share",
        F.array_join(F.transform("best", lambda x: F.concat(F.lit("."), x["ext"])), "/").alias("exts"),
    )


def media_shares(active: DataFrame, least_bytes: int = MEDIA_BYTES, least_files: int = MEDIA_FILES, share: float = MEDIA_SHARE) -> DataFrame:
    """(dir, family, total_bytes, file_count, share, exts): large directories whose files are nearly all of one family."""
    return _shares(by_extension(active), least_bytes, least_files, share)


def _builds(active: DataFrame) -> DataFrame:
    """(beside, build): the first build file, in the order of MANIFESTS, of each directory that has one."""
    order = F.array(*map(F.lit, P.MANIFESTS))
    name = P.basename(F.col("path"))
    first = active.where(name.isin(*P.MANIFESTS)).groupBy(P.parent(F.col("path")).alias("beside")).agg(F.min(F.array_position(order, name)).alias("at"))
    return first.select("beside", F.get(order, (F.col("at") - 1).cast("int")).alias("build"))


def regenerable(active: DataFrame) -> DataFrame:
    """(dir, reason): directories of files that can be made anew, by their name and the build files beside them."""
    name = F.lower(P.basename(F.col("dir")))
    dirs = directory_stats(active).where(name.isin(*P.REGENERABLE)).withColumn("beside", P.parent(F.col("dir")))
    reason = P.regenerable_reason(name, F.col("build"))
    return dirs.join(_builds(active), "beside", "left").select("dir", "total_bytes", "file_count", reason.alias("reason")).where("reason is not null")


def recommendations(active: DataFrame, home: str, **media) -> DataFrame:
    """(path, action, reason, size_bytes, file_count): one at most for a directory, caches before builds before media.

    Figures of directories are aggregated once; what else is known of a directory is
    joined to its one row, so reasons are made behind all aggregates.
    """
    by_ext = by_extension(active)
    shares = _shares(by_ext, **media).select("dir", "share", "exts")
    name = F.lower(P.basename(F.col("dir")))
    rows = _totals(by_ext).withColumn("beside", P.parent(F.col("dir"))).join(_builds(active), "beside", "left").join(shares, "dir", "left")
    rows = rows.withColumn("cache", P.xdg_or_trash(F.col("dir"), home)).withColumn("made", F.when(name.isin(*P.REGENERABLE), P.regenerable_reason(name, F.col("build"))))
    kept = F.format_string("%s (%d files, %.0f%% %s)", P.format_bytes(F.col("total_bytes")), F.col("file_count"), F.col("share") * 100, F.col("exts"))
    reason = F.coalesce("cache", "made", F.when(F.col("share").isNotNull(), kept))
    action = F.when(F.col("cache").isNotNull() | F.col("made").isNotNull(), F.lit("catalog")).otherwise(F.lit("keep"))
    return rows.select(F.col("dir").alias("path"), action.alias("action"), reason.alias("reason"), F.col("total_bytes").alias("size_bytes"), "file_count").where("reason is not null")


def _own(active: DataFrame, target: str) -> DataFrame:
    """Rows of the target root with how often other roots have their content, and the first path there; null if none has it."""
    elsewhere = active.where(F.col("root") != target).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_elsewhere"), F.min("path").alias("also_at"))
    return active.where(F.col("root") == target).join(elsewhere, "content_hash", "left")


def _twice(own: DataFrame) -> DataFrame:
    return own.where("n_elsewhere is not null").select("path", "content_hash", F.coalesce("byte_size", F.lit(0)).alias("size_bytes"), "n_elsewhere", "also_at")


def redundant(active: DataFrame, target: str) -> DataFrame:
    """(path, content_hash, size_bytes, n_elsewhere, also_at): files of the target root whose content other roots have, in how many places, and the first."""
    return _twice(_own(active, target))


def copies(active: DataFrame, target: str) -> DataFrame:
    """(content_hash, path): every place in other roots of a content that the target root has."""
    wanted = active.where(F.col("root") == target).select("content_hash").distinct()
    return active.where(F.col("root") != target).join(wanted, "content_hash", "left_semi").select("content_hash", "path")


def _newer(own: DataFrame, active: DataFrame, target: str) -> DataFrame:
    """own rows of the target root with the newest other version of each (newer_path, other_mtime); null if there is none.

    Another version has the same path relative to the target root as its end, other
    content, and another root. Only suffixes as deep as some relative path are exploded.
    Of each suffix the newest file and the newest of another content are kept, and no task
    sends more than those two, so a name that is everywhere is no hot key.
    """
    rel = F.substring(F.col("path"), len(target.rstrip("/")) + 2, 1 << 30)
    depths = active.where(F.col("root") == target).select(F.size(F.split(rel, "/")).alias("depth")).distinct()
    others = active.where(F.col("root") != target).join(F.broadcast(depths)).where(F.size(F.split("path", "/")) > F.col("depth"))  # a few depths
    newest_first = F.struct((-F.col("mtime")).alias("m"), F.col("path").alias("newer_path"), F.col("mtime").alias("other_mtime"), F.col("content_hash").alias("hash"))
    ends = others.select(P.suffix_of_depth(F.col("path"), F.col("depth")).alias("rel"), newest_first.alias("n"))
    of_hash = ends.groupBy("rel", F.col("n.hash").alias("hash")).agg(F.min("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("rel").orderBy("n"))
    best = of_hash.withColumn("place", place).where("place <= 2").groupBy("rel").agg(F.min("n").alias("one"), F.min(F.when(F.col("place") == 2, F.col("n"))).alias("two"))
    met = own.withColumn("rel", rel).join(best, "rel", "left").withColumn("n", F.when(F.col("one.hash") != F.col("content_hash"), F.col("one")).otherwise(F.col("two")))
    return met.select(*own.columns, "n.newer_path", "n.other_mtime")


def _stale(met: DataFrame) -> DataFrame:
    return met.select("path", F.coalesce("byte_size", F.lit(0)).alias("size_bytes"), "newer_path", F.col("mtime").alias("target_mtime"), "other_mtime")


def stale(active: DataFrame, target: str) -> DataFrame:
    """(path, size_bytes, newer_path, target_mtime, other_mtime): files whose newest other version is newer."""
    return _stale(_newer(active.where(F.col("root") == target), active, target)).where("other_mtime > target_mtime")


def backup_parts(active: DataFrame, target: str) -> DataFrame:
    """Each file of a root with its part, redundant, else stale, else unique, and what tells that (n_elsewhere, also_at, newer_path, other_mtime)."""
    met = _newer(_own(active, target), active, target)
    part = F.when(F.col("n_elsewhere").isNotNull(), "redundant").when(F.col("other_mtime") > F.col("mtime"), "stale").otherwise("unique")
    return met.withColumn("part", part)


def backup_audit(active: DataFrame, target: str) -> dict[str, DataFrame]:
    """The parts of backup_parts() by their names, and the copies of the redundant files."""
    rows = backup_parts(active, target)
    of = lambda part: rows.where(F.col("part") == part)
    single = of("unique").select("path", F.coalesce("byte_size", F.lit(0)).alias("size_bytes"))
    return {"redundant": _twice(of("redundant")), "stale": _stale(of("stale")), "unique": single, "copies": copies(active, target)}


def review_lines(rows: DataFrame, action: Column, path: Column, size: Column, note: Column) -> DataFrame:
    """Tab-separated lines of a review file, so that paths may hold spaces."""
    return rows.select(F.concat_ws("\t", action, path, P.format_bytes(size), note).alias("line"))
