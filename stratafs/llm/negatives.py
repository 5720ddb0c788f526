"""Hard-negative mining by slots of scores.

The anchors are a query set: they are taken in blocks of a bounded number, each of which is
broadcast and scored against all rows where these are.

1. Each task keeps an anchor's best rows of its own label; the best of all tasks are its
   positives.
2. A positive of score p takes negatives from low * p to high * p. The upper limits of
   an anchor's positives, from the highest down, cut the scores into disjoint slots: slot k
   holds those up to limit k and above limit k + 1.
3. Each task keeps the best k rows of other labels in each slot; the best k of all tasks
   are the slot's.
4. A positive's window is cut off the union of its slot and all lower ones, so its
   answer is the first k of them, merged in descending order, that reach its lower limit.
   Windows of an anchor overlap, and share their slots.

Scores are exact integers; of equal scores the smaller id comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between LOW / WHOLE and HIGH / WHOLE of its positive's.
LOW, HIGH, WHOLE = 30, 90, 100
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Anchors of a block, and scores that a task holds at once.
BLOCK, CELLS = 16_384, 1 << 22
#: Integers up to which sums of products are exact in floating point.
EXACT = 1 << 53


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """The components as whole numbers; null unless the vector and all its components are there and finite."""
    x = lambda v: v.cast("double")
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda v: F.floor(x(v) * scale)))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """A row for each vector, with zeros after the end of short ones; what lies beyond width is left out."""
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    out[at[place < width], place[place < width]] = flat[place < width]
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two whole-number matrices, exactly; OverflowError where one is beyond 64 bits."""
    top = lambda m: max((abs(int(m.min())), abs(int(m.max())))) if m.size else 0
    bound = a.shape[1] * top(a) * top(b)
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return exact.astype(np.int64)


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of the highest score of each key, of equal ones those of the smaller id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(rows: DataFrame, anchors: pa.Table, choose, k: int) -> DataFrame:
    """(anchor, slot, id, score): of each anchor's slots the k best rows of each task.

    choose(labels, ids, i, scores) gives the slot of each row for anchor i, or -1.
    """
    width = max([0, *anchors["vector"].combine_chunks().value_lengths().to_pylist()])
    sent = rows.sparkSession.sparkContext.broadcast(_matrix(anchors["vector"].combine_chunks(), width))

    def run(batches):
        vectors = sent.value
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False)[order] for i in (0, 1))
            other = _matrix(batch.column(2), width)[order]
            step = max(1, CELLS // max(1, len(ids)))
            for lo in range(0, len(vectors), step):
                for i, scores in enumerate(inner(vectors[lo : lo + step], other), lo):
                    slot = choose(labels, ids, i, scores)
                    of = np.flatnonzero(slot >= 0)
                    of = of[np.lexsort((ids[of], -scores[of], slot[of]))]
                    each, first = np.unique(slot[of], return_index=True)
                    for s, at in zip(each.tolist(), first.tolist()):
                        top = of[at : at + k]
                        top = top[slot[top] == s]
                        known = kept.get((i, s))
                        mine = (ids[top], scores[top])
                        if known is not None:
                            mine = tuple(map(np.concatenate, zip(known, mine)))
                            best = np.lexsort((mine[0], -mine[1]))[:k]
                            mine = (mine[0][best], mine[1][best])
                        kept[i, s] = mine
        for pairs in _pieces(list(kept.items()), 4096):
            n = [len(ids) for _, (ids, _) in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([i for (i, _), _ in pairs], n)), pa.array(np.repeat([s for (_, s), _ in pairs], n)),
                 pa.array(np.concatenate([ids for _, (ids, _) in pairs])), pa.array(np.concatenate([s for _, (_, s) in pairs]))],
                ["anchor", "slot", "id", "score"],
            )

    return rows.select("id", "label", "vector").mapInArrow(run, "anchor long, slot long, id long, score long")


def _pieces(items: list, size: int):
    return (items[at : at + size] for at in range(0, len(items), size))


def _block(rows: DataFrame, anchors: pa.Table, positives: int, negatives: int, low: int, high: int, whole: int) -> DataFrame:
    """The result for the anchors of one block, stored."""
    spark = rows.sparkSession
    anchor_ids, anchor_labels = (anchors[c].to_numpy() for c in ("id", "label"))

    def same(labels, ids, i, scores):
        return np.where((labels == anchor_labels[i]) & (ids != anchor_ids[i]), 0, -1)

    best = _best(_scored(rows, anchors, same, positives), ["anchor"], positives)
    found = stored(best.select("anchor", F.col("id").alias("positive"), F.col("score").alias("p"), F.col("rank").alias("order")), "positives")
    # whole * score between low * p and high * p; a positive below zero has no such scores
    limit = F.expr(f"p * {high} div {whole}")
    least = F.expr(f"-(-p * {low} div {whole})")
    windows = found.where("p >= 0").select("anchor", "positive", "p", "order", limit.alias("limit"), (least + F.when(F.expr(f"p * {low} % {whole} > 0"), 1).otherwise(0)).alias("least"))
    windows = stored(windows.withColumn("slot", (F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("limit"))) - 1).cast("long")), "slots")
    # of the block alone: at most `positives` rows an anchor
    limits: list[list[int]] = [[] for _ in anchor_ids]
    floors = np.zeros(len(anchor_ids), np.int64)
    for r in windows.groupBy("anchor").agg(F.sort_array(F.collect_set("limit")).alias("limits"), F.min("least").alias("least")).collect():
        limits[r["anchor"]], floors[r["anchor"]] = r["limits"], r["least"]
    uppers = [np.array(x, np.int64) for x in limits]

    def apart(labels, ids, i, scores):
        upper = uppers[i]
        above = np.searchsorted(upper, scores)  # upper limits below the score
        fits = (above < len(upper)) & (scores >= floors[i]) & (labels != anchor_labels[i]) & (ids != anchor_ids[i])
        return np.where(fits, len(upper) - 1 - above, -1)

    slots = stored(_best(_scored(rows, anchors, apart, negatives), ["anchor", "slot"], negatives).drop("rank"), "negatives")
    met = windows.join(slots.withColumnRenamed("slot", "of"), "anchor").where("of >= slot")
    merged = met.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "order").orderBy(F.desc("score"), "id")))
    names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(anchor_ids))), "anchor_id": pa.array(anchor_ids)}))
    out = merged.where((F.col("rank") <= negatives) & (F.col("score") >= F.col("least"))).join(F.broadcast(names), "anchor")
    return stored(
        out.select("anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score")), "mined"
    )


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, whole: int = WHOLE, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: a condition on rows. An anchor's positives are its first `positives` other
    rows of its label; for each, the first `negatives` rows of other labels follow whose
    score is at least low / whole and at most high / whole of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    Vectors of unlike lengths are compared as if zeros followed the shorter; empty ones
    score 0. A score beyond 64 bits raises an error. Rows of one id count one by one, but
    none of them is another's positive or negative, and an anchor that is repeated is
    answered for each. Ties go to the smaller id. Other columns are left aside; an
    empty table, or no anchor, gives an empty result.
    """
    sound = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), scaled(F.col(vector_col)).alias("vector"), anchors.alias("anchor"))
    sound = sound.where("id is not null and label is not null and vector is not null")
    queries = sound.where("anchor").select("id", "label", "vector")
    blocks = -(-queries.count() // block)
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            made = _block(sound.select("id", "label", "vector"), own, positives, negatives, low, high, whole)
            out = made if out is None else out.unionByName(made)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH vec AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (
  SELECT a.id AS anchor, a.label = b.label AS same, b.id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vec a JOIN vec b ON a.id % 100 = 0 AND a.id <> b.id),
positive AS (SELECT anchor, id, score FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN score n ON p.anchor = n.anchor AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) <= 10
"""
