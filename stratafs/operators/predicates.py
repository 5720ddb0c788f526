"""Filters over paths, each defined once."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXAMPLES = 5
#: Directories of generated files.
GENERATED = ("node_modules", "target", "build", ".cache", ".local", "__pycache__", ".dart_tool", ".dart-tool", ".gradle", ".rustup")


def like_ci(column: Column, pattern: str) -> Column:
    r"""LIKE without regard to case; \ escapes % and _."""
    return column.ilike(pattern)


def glob(column: Column, pattern: str) -> Column:
    """Case-sensitive glob in which * also crosses slashes."""
    regex = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return column.rlike(f"(?s)^{regex}$")


def has_suffix(column: Column, ext: str) -> Column:
    return F.lower(column).endswith("." + ext.lstrip(".").lower())


def first_root(column: Column, roots: list[str]) -> Column:
    """The first of roots that a path lies under, by whole names."""
    inside = lambda r: (column == r) | column.startswith(r.rstrip("/") + "/")
    return F.coalesce(*(F.when(inside(r), F.lit(r)) for r in roots))


def violation_kinds(path: Column) -> dict[str, Column]:
    """What should not be indexed, by category."""
    low = F.lower(path)
    any_of = lambda *cs: reduce(lambda a, b: a | b, cs)
    return {
        "browser_cookies": any_of(F.contains(low, F.lit("/cookies")), F.contains(low, F.lit("cookies.sqlite"))),
        "env_files": path.rlike(r"/\.env$|/\.env\.|/\.envrc$"),
        "private_keys": any_of(low.rlike(r"\.(pem|key|pfx|kdbx)$"), F.contains(path, F.lit("/id_rsa"))),
        "secret_dirs": any_of(*(F.contains(low, F.lit(f"/{x}/")) for x in (".ssh", ".aws", ".gnupg"))),
        "escaped_generated_dirs": any_of(*(F.contains(path, F.lit(f"/{x}/")) for x in GENERATED)),
    }


def violations(paths: DataFrame) -> DataFrame:
    """A row for each path and category that it violates, in one pass."""
    marks = F.array(*(F.when(p, F.lit(c)) for c, p in violation_kinds(F.col("path")).items()))
    return paths.select("*", F.explode(F.array_compact(marks)).alias("category"))


def violation_counts(paths: DataFrame) -> DataFrame:
    """(category, n, examples): the first few paths by name; no category's paths are gathered."""
    found = violations(paths.select("path"))
    counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    # a limit on row_number cuts rows in the tasks that find them, so a few a task are shuffled
    place = F.row_number().over(Window.partitionBy("category").orderBy("path"))
    firsts = found.withColumn("place", place).where(F.col("place") <= EXAMPLES)
    examples = firsts.groupBy("category").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return counts.join(F.broadcast(examples), "category")  # a few rows for each of five categories


def largest(rows: DataFrame, most: int) -> DataFrame:
    """The largest rows with how many there are in all."""
    sized = rows.select("path", F.coalesce("byte_size", F.lit(0)).alias("byte_size"), "content_hash", "title")
    total = sized.agg(F.count(F.lit(1)).alias("total_matched"))
    return sized.orderBy(F.desc("byte_size"), "path").limit(most).join(F.broadcast(total))  # one row


def largest_dirs(catalog: DataFrame, most: int = 20, min_bytes: int = 0, sort_by: str = "bytes") -> DataFrame:
    """The cataloged directories of min_bytes at least, the largest first: by bytes, or by their number of files (count)."""
    order = "file_count" if sort_by == "count" else "total_bytes"
    return catalog.where(F.col("total_bytes") >= min_bytes).orderBy(F.desc(order), "path").limit(most)
