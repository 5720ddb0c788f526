"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Keys that split_join() broadcasts at most.
BROADCAST_KEYS = 400_000


def split_join(rows: DataFrame, looked_up: DataFrame, key: str, n_rows: int, most: int | None = None) -> DataFrame:
    """rows joined with looked_up, which has each key once, and `n`: how many rows have it.

    A key of more than 1,000 rows, or of so many that no more than BROADCAST_KEYS keys
    have them, is joined where its rows are, so that no task gathers them; the others
    meet in a shuffle. most: what no `n` exceeds, where that is known.
    """
    limit = max(1000, n_rows // BROADCAST_KEYS)
    if most is not None and most <= limit:
        return rows.join(looked_up.drop("n"), key)
    hubs = looked_up.where(F.col("n") > limit).drop("n").withColumn("hub", F.lit(True))
    met = rows.join(F.broadcast(hubs), key, "left")
    rest = met.where("hub is null").select(*rows.columns).join(looked_up.where(F.col("n") <= limit).drop("n"), key)
    return met.where("hub").drop("hub").unionByName(rest)


def _least(of: Column) -> list[Column]:
    return [of.alias("m"), F.count(F.lit(1)).alias("n")]


def _large_star(links: DataFrame, n: int, most: int) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours, of which no node has over `most`."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(*_least(F.least(F.min("b"), F.col("a"))))
    return split_join(both.where("b > a"), least, "a", 2 * n, most).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, n: int, most: int) -> DataFrame:
    """Links a node and its smaller neighbours, at most `most`, to the least of them; a is the larger end."""
    least = links.groupBy("a").agg(*_least(F.min("b")))
    moved = split_join(links, least, "a", n, most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple[int, int, int, bool]:
    """(links, most neighbours of a node, most smaller ones, whether no end links to two others or to one that links on)."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    between = (F.col("below") > 1) | (F.col("below") > 0) & (F.col("above") > 0)
    n, near, below, open_ends = each.agg(F.sum("below"), F.max(F.col("below") + F.col("above")), F.max("below"), F.sum(between.cast("int"))).first()
    return n or 0, near or 0, below or 0, not open_ends


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has a link; root is the least node reachable.

    links: (a, b) of one orderable type. Loops and repeated links do no harm; nulls are
    left out; no links give an empty result. Each step is written to the shared folder and
    read again by size, so that few links make few tasks, and the rounds end as soon as all
    links are stars, without one more to find that nothing changes. Every step
    shuffles links alone and gathers no node's neighbours.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n, near, below, stars = _state(links)
    while not stars:
        if not rounds:
            raise RuntimeError("components did not settle in the rounds given")
        rounds -= 1
        links = stored(_large_star(links, n, near), "links")
        # that gave no node more smaller neighbours than it had
        links = stored(_small_star(links, n, below), "links")
        n, near, below, stars = _state(links)
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def least_of_component(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) of each member (node, least): the least of all its component's members, nulls last; roots are those of components()."""
    placed = stored(members.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "placed")
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return split_join(placed.select("root", "node"), of_root, "root", placed.count()).select("node", "component_id")
