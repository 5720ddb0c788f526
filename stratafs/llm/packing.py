"""Packing into training sequences by non-negative least squares.

Shallow combinations of piece lengths that fill a window are enumerated, repeat counts
are solved against the histogram of lengths, rounded, and what is left is packed
greedily. The plan needs the histogram alone: at most `window` counts, whatever the
size of the corpus. Pieces are then dealt to the plan's slots by their rank among the
pieces of their length, which comes from counts by (part, length), so that no task
gathers the pieces of a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import documents, stored
from .token_counts import SPECIAL

#: Tokens of a full sequence.
WINDOW = 2048
#: The id behind each document's tokens.
END_ID = 1
#: For each length, so many second lengths are tried in combinations of three kinds.
BREADTH = 12
#: Steps of the solver.
STEPS = 300


def combinations(counts: np.ndarray, window: int = WINDOW, breadth: int = BREADTH) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((length, times), ...) of at most three kinds of present lengths that fill the window exactly."""
    present = np.flatnonzero(counts)
    common = present[np.argsort(-counts[present], kind="stable")][:breadth].tolist()
    found = set()

    def add(*kinds):
        merged: dict[int, int] = {}
        for length, times in kinds:
            merged[length] = merged.get(length, 0) + times
        found.add(tuple(sorted(merged.items())))

    for a in present.tolist():
        if window % a == 0:
            add((a, window // a))
        for times in range(1, min(window // a, 8) + 1):
            rest = window - times * a
            if rest and counts[rest]:
                add((a, times), (rest, 1))
            if rest and rest % 2 == 0 and counts[rest // 2]:
                add((a, times), (rest // 2, 2))
        for b in common:
            rest = window - a - b
            if rest > 0 and counts[rest]:
                add((a, 1), (b, 1), (rest, 1))
    # lengths that are spread over the range, so that rare ones meet each other too
    spread = present[:: max(1, len(present) // (2 * breadth))].tolist()
    for a in present.tolist():
        for b in spread:
            rest = window - a - b
            if rest > 0 and counts[rest]:
                add((a, 1), (b, 1), (rest, 1))
    return sorted(found)


def solve(counts: np.ndarray, combos: list, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that brings sum(x * combo) near counts, by multiplicative updates."""
    combo = np.array([j for j, c in enumerate(combos) for _ in c], np.int64)
    length = np.array([a for c in combos for a, _ in c], np.int64)
    times = np.array([t for c in combos for _, t in c], float)
    up = lambda x: np.bincount(length, weights=times * x[combo], minlength=len(counts))
    down = lambda y: np.bincount(combo, weights=times * y[length], minlength=len(combos))
    x, target = np.full(len(combos), max(1.0, counts.sum() / max(1, len(combos)))), down(counts.astype(float))
    for _ in range(steps):
        x *= target / (down(up(x)) + 1e-9)
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(combination, sequences)] that uses counts[l] pieces of each length l exactly.

    Rounding never takes more pieces than there are. What remains is packed greedily,
    longest first, each gap taking the longest piece that fits.
    """
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[tuple[tuple[int, int], ...], int]] = []
    combos = combinations(counts, window)
    if combos:
        x = solve(counts, combos)
        for j in np.argsort(-x, kind="stable"):
            n = min([int(x[j] + 0.5), *(int(left[a]) // t for a, t in combos[j])])
            if n > 0:
                chosen.append((combos[j], n))
                for a, t in combos[j]:
                    left[a] -= n * t
    present = np.flatnonzero(left).tolist()
    while present:
        gap, kinds = window, []
        at = len(present)
        while gap and at and (at := min(at, bisect_right(present, gap))):
            length = present[at - 1]
            times = min(gap // length, int(left[length]))
            kinds.append((length, times))
            gap -= length * times
            at -= 1
        n = min(int(left[a]) // t for a, t in kinds)
        chosen.append((tuple(kinds), n))
        for a, t in kinds:
            left[a] -= n * t
        present = [a for a in present if left[a]]
    return chosen


def slots(planned: list) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: first rank, first sequence and offset of each run of slots; ranks follow one another."""
    runs: dict[int, tuple[list[int], list[int], list[int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for combo, n in planned:
        offset = 0
        for length, times in combo:
            starts, firsts, offsets = runs.setdefault(length, ([], [], []))
            for _ in range(times):
                starts.append(given.get(length, 0))
                firsts.append(sequence)
                offsets.append(offset)
                given[length] = given.get(length, 0) + n
                offset += length
        sequence += n
    return runs


def cut(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
        rank_file: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document's ids: full windows and one rest.

    Columns: id, start, length, ids_crc32, doc_tokens, and part and idx: the task that
    cut the piece and its rank there among the pieces of its length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        encoding = bpe.rank_encoding(rank_file, public_tokenizers.PATTERN, SPECIAL)
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([*(encoding.encode_to_numpy(p, allowed_special="all") for p in bpe.safe_parts(text or "")), end])
                ids = ids.astype("<u4", copy=False)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    at.append(i)
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), int(seen[len(piece)])))
                    seen[len(piece)] += 1
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns), pa.array([part] * len(at), pa.int64())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "idx", "part"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, idx long, part long"
    )


def pack(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is one piece of the end id; a null id stays null; equal rows
    are packed one by one; other columns are left aside; an empty table gives an empty
    result. Lengths that many documents share are no special case.
    """
    pieces = stored(cut(docs, window, id_col, text_col, rank_file), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        counts[row["length"]] = row["n"]
    runs = slots(plan(counts, window))
    before = by_part.select(
        "length", "part",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    ranked = pieces.join(before, ["length", "part"]).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("idx")).alias("rank")
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def deal(batches):
        tables = {a: [np.array(x, np.int64) for x in run] for a, run in runs.items()}
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for a in np.unique(length).tolist():
                starts, firsts, offsets = tables[a]
                of = np.flatnonzero(length == a)
                at = np.searchsorted(starts, rank[of], side="right") - 1
                sequence[of] = firsts[at] + rank[of] - starts[at]
                offset[of] = offsets[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    dealt = ranked.mapInArrow(deal, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return dealt.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
