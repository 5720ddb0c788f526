"""Path patterns by three-letter postings: what a pattern has to contain is looked up, and the few paths found are compared with it.

Paths are divided into parts by a hash, about PART to a part, and numbered there. A posting
is a row for each gram and part, so one that all paths have ('.md') is divided too.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import like_ci

GRAM, PART = 3, 4096
#: Parts that are named in a filter at most; more are joined.
NAMED = 200


def part_bits(paths: int) -> int:
    """Into how many parts, as a power of 2, so many paths are divided."""
    return max(0, ceil(log2(paths / PART))) if paths > PART else 0


def _grams(path: Column) -> Column:
    low = F.lower(path)
    return F.array_distinct(F.transform(F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(GRAM))))


def numbered_paths(paths: DataFrame, segment: int, bits: int) -> DataFrame:
    """(segment, part, id, path) to store: each path once."""
    part = F.pmod(F.xxhash64("path"), F.lit(1 << bits)).cast("int")
    rows = paths.select("path").where("path is not null").distinct().withColumn("part", part)
    number = F.row_number().over(Window.partitionBy("part").orderBy("path"))  # of about PART rows
    return rows.select(F.lit(segment).cast("bigint").alias("segment"), "part", number.alias("id"), "path")


def gram_rows(names: DataFrame) -> DataFrame:
    """(gram, segment, part, ids) to store, of stored numbered_paths()."""
    each = names.select("segment", "part", "id", F.explode(_grams(F.col("path"))).alias("gram"))
    return each.groupBy("gram", "segment", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def pattern_grams(like: str) -> list[str]:
    r"""The grams that whatever matches a LIKE pattern, \ escaping, has to contain, in lower case."""
    pieces, piece, chars = [], "", iter(like)
    for c in chars:
        if c in "%_":
            pieces.append(piece)
            piece = ""
        else:
            piece += next(chars, "\\") if c == "\\" else c
    low = [p.lower() for p in [*pieces, piece]]
    return sorted({p[i : i + GRAM] for p in low for i in range(len(p) - GRAM + 1)})


def candidates(postings: DataFrame, wanted: list[str]) -> DataFrame:
    """(segment, part, id) of the paths that have all wanted grams: the intersection of their lists in each part."""
    mine = postings.where(F.col("gram").isin(*wanted))
    by_part = mine.groupBy("segment", "part").agg(F.count(F.lit(1)).alias("n"), F.collect_list("ids").alias("lists"))  # a list a gram
    common = F.aggregate(F.slice("lists", 2, len(wanted)), F.element_at("lists", 1), F.array_intersect)
    return by_part.where(F.col("n") == len(wanted)).select("segment", "part", F.explode(common).alias("id"))


def matching_paths(names: DataFrame, postings: DataFrame, like: str) -> DataFrame:
    r"""(path) of the stored paths that match a LIKE pattern without regard to case.

    A pattern without three letters in a row is compared with all.
    """
    wanted = pattern_grams(like)
    if not wanted:
        return names.where(like_ci(F.col("path"), like)).select("path")
    found = candidates(postings, wanted)
    parts = found.select("segment", "part").distinct().limit(NAMED + 1).collect()
    if len(parts) <= NAMED:  # so that the scan leaves out what has other parts
        names = names.where(F.col("segment").isin(*{r["segment"] for r in parts}) & F.col("part").isin(*{r["part"] for r in parts})) if parts else names.limit(0)
    return names.join(found, ["segment", "part", "id"], "left_semi").where(like_ci(F.col("path"), like)).select("path")
