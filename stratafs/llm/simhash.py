"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks. Fingerprints within `distance` bits differ by at most
distance // blocks in one of their blocks: the threshold there. Over a block, the anchors
are the words of a covering code, a Hamming code and some free bits, whose covering
radius is 1. A fingerprint is home at the one anchor that covers it, and is replicated to
every anchor within covering radius plus threshold of its block. The home anchor of one
of two linked fingerprints is then always among the anchors of the other, so comparing
per anchor loses no link.

Only distinct fingerprints are compared. At an anchor, links are reduced to a forest that
connects the same fingerprints, so a large group emits no pairs. No task holds an anchor
of very many fingerprints: those are divided again by the rest of their bits.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored
from .components import components, least_of_component, split_join
from .hashing import mixed

SEED, SHINGLE, DISTANCE, BLOCKS = 42, 3, 3, 2
#: Fingerprints that are walked at once; more are first divided without loss.
DENSE = 20_000
#: Pieces of a fingerprint at the last division of those at one anchor.
PIECES = 16
#: Cells of a comparison matrix.
CELLS = 1 << 22


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 for one without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only; space and U+0009 to U+000D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


@lru_cache(maxsize=8)
def _masks(width: int, weight: int) -> tuple[tuple[int, ...], ...]:
    """For each syndrome, what to XOR to a block with it to reach the anchors within `weight` bits, nearest first."""
    checks = (width + 1).bit_length() - 1
    length = (1 << checks) - 1  # of the Hamming code; the other bits are free
    found: list[list[int]] = [[] for _ in range(1 << checks)]
    for n in range(weight + 1):
        for bits in combinations(range(width), n):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1 if b < length else 0
            found[syndrome].append(sum(1 << b for b in bits))
    return tuple(map(tuple, found))


def near_anchors(block: np.ndarray, width: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, home): every anchor within 1 + threshold bits of each value, once; home marks the one that covers it."""
    checks = (width + 1).bit_length() - 1
    syndrome = np.zeros(len(block), np.int64)
    for j in range(checks):
        check = np.uint64(sum(1 << (p - 1) for p in range(1, 1 << checks) if p >> j & 1))
        syndrome |= (np.bitwise_count(block & check).astype(np.int64) & 1) << j
    index, anchor, home = [], [], []
    for s, masks in enumerate(_masks(width, 1 + threshold)):
        of = np.flatnonzero(syndrome == s)
        index.append(np.repeat(of, len(masks)))
        anchor.append((block[of, None] ^ np.array(masks, np.uint64)[None, :]).ravel())
        home.append(np.tile(np.arange(len(masks)) == 0, len(of)))  # at syndrome 0 the value itself, else one flipped bit
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _covered(distinct: DataFrame, blocks: int, threshold: int) -> DataFrame:
    """(anchor, home, fp): each distinct fingerprint at each of its anchors."""
    width = 64 // blocks

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(blocks):
                block = (fps.view(np.uint64) >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
                index, anchor, home = near_anchors(block, width, threshold)
                key = (anchor | np.uint64(k) << np.uint64(width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(fps[index])], ["anchor", "home", "fp"])

    return distinct.mapInArrow(run, "anchor long, home boolean, fp long")


def _near(one, many: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(many ^ one) <= distance


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links between the rows of fps that connect exactly those which links within distance connect.

    Many fingerprints are first divided: those that share one of distance + 1
    sub-blocks are walked with each other, which finds every link.
    """
    if len(fps) <= DENSE:
        return _walk(fps, distance)
    out, width = [], 64 // (distance + 1)
    for k in range(distance + 1):
        sub = fps >> np.uint64(k * width) & np.uint64((1 << width) - 1)
        order = np.argsort(sub, kind="stable")
        for group in np.split(fps[order], np.flatnonzero(np.diff(sub[order])) + 1):
            if len(group) > 1:
                out += _walk(group, distance)
    return out


def _walk(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    names = fps.view(np.int64)
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        root = int(names[queue[0]])
        while queue and len(left):
            near = _near(fps[queue.pop()], fps[left], distance)
            if near.any():
                reached, left = left[near], left[~near]
                queue += reached.tolist()
                out += [(root, int(x)) for x in names[reached]]
    return out


def at_anchor(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links among the fingerprints at one anchor: those at home there against all."""
    homes, linked = fps[home], np.zeros(len(fps), bool)
    step = max(1, CELLS // len(fps))
    for i in range(0, len(homes), step):
        near = _near(homes[i : i + step, None], fps[None, :], distance)
        linked |= near[near.sum(1) > 1].any(0)  # a fingerprint is near itself
    return forest(fps[linked], distance)


def _per_anchor(distance: int, dense: int):
    """An Arrow function over rows sorted by anchor: the links at each.

    The fingerprints at an anchor with more than `dense` rows are not held: each is told
    as a link to itself. Without `dense` all are compared.
    """

    def made(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def told(fps):
        return made(fps.view(np.int64), fps.view(np.int64))

    def links(held):
        anchor, home, fps = (np.concatenate(x) for x in zip(*held))
        starts = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        sizes = np.diff(np.concatenate((starts, [len(anchor)])))
        homes = np.add.reduceat(home.astype(np.int64), starts)
        out = []
        for i in np.flatnonzero((sizes > 1) & (homes > 0)).tolist():
            of = slice(starts[i], starts[i] + sizes[i])
            if dense and sizes[i] > dense:
                yield told(fps[of])
            else:
                out += at_anchor(fps[of], home[of], distance)
        yield made([a for a, _ in out], [b for _, b in out])

    def run(batches):
        held: list[tuple] = []  # rows of the anchor that may go on in the next batch
        wide = None  # an anchor that has been given up
        for batch in batches:
            anchor, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if wide is not None and len(anchor):
                known = np.searchsorted(anchor, wide, "right") if anchor[0] == wide else 0
                yield told(fps[:known])
                anchor, home, fps = anchor[known:], home[known:], fps[known:]
                wide = None if len(anchor) else wide
            if not len(anchor):
                continue
            if held and held[0][0][0] != anchor[0]:
                yield from links(held)
                held = []
            last = np.searchsorted(anchor, anchor[-1])
            if last:
                yield from links([*held, (anchor[:last], home[:last], fps[:last])])
                held = []
            held.append((anchor[last:], home[last:], fps[last:]))
            if dense and sum(len(x[0]) for x in held) > dense:
                wide = anchor[-1]
                yield told(np.concatenate([x[2] for x in held]))
                held = []
        if held:
            yield from links(held)

    return run


def _divided(fps: DataFrame, pieces: int, distance: int) -> DataFrame:
    """(anchor, home, fp): fingerprints within distance meet, as they are equal in all but `distance` of so many pieces."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in range(pieces) if i not in left) for left in combinations(range(pieces), distance)]

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k, mask in enumerate(masks):
                key = mixed((fp.view(np.uint64) & np.uint64(mask)) + mixed(np.full(1, k, np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.ones(len(fp), bool)), pa.array(fp)], ["anchor", "home", "fp"])

    return fps.mapInArrow(run, "anchor long, home boolean, fp long")


def _linked(at: DataFrame, distance: int, dense: int) -> DataFrame:
    rows = at.repartition("anchor").sortWithinPartitions("anchor")
    return stored(rows.mapInArrow(_per_anchor(distance, dense), "a long, b long"), "links")


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (fp) within distance bits.

    Fingerprints at anchors with more than `dense` of them are divided further, by what
    they have in common beyond the anchor, and again where that leaves as many; no link is
    lost. At the last division, into PIECES, fingerprints that meet are alike but for
    `distance` pieces, for 3 bits at most 4096 different ones. Distances of more than 3
    bits would make too many copies of each and are compared at their anchors.
    """
    levels = [2 * distance, PIECES] if 0 < distance <= 3 else []
    links = _linked(_covered(distinct, blocks, distance // blocks), distance, dense if levels else 0)
    out = links.where("a <> b")
    for pieces in levels:
        wide = links.where("a = b").select(F.col("a").alias("fp")).distinct()
        if wide.isEmpty():
            break
        links = _linked(_divided(wide, pieces, distance), distance, dense if pieces < PIECES else 0)
        out = out.unionByName(links.where("a <> b"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(id, fingerprint, component_id) of each row of docs.

    component_id: the least id reachable over links, which join rows whose fingerprints
    are within distance bits. Texts without words, null ones included, have fingerprint
    zero and are linked like any other; very long ones count whole. Equal rows each give a
    row; null ids are no component's least id unless it has no other; other columns are
    left aside; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    members = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    links = fingerprint_links(members.select("fp"), distance, blocks)
    placed = least_of_component(members.select(F.col("fp").alias("node"), "least"), components(links))
    of_fp = members.select("fp", "n").join(placed.withColumnRenamed("node", "fp"), "fp")
    return split_join(fps, of_fp, "fp", fps.count()).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
