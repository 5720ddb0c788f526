"""Near-duplicates by the similarity of word shingles: SimHash anchors propose, sets of shingles decide.

A text's fingerprint is the SimHash of its distinct shingles. Blocks of its bits are drawn,
and the anchors over a block are the words of a covering code of radius 1, as in simhash.
A fingerprint goes to every anchor that covers it (the threshold is 0), and fingerprints
are compared at each anchor. Two texts of the similarity asked for differ in so many bits
that no block is sure to be equal; there are as many blocks as let them miss each other
at all of them with a probability of at most MISS. Blocks widen with the corpus, so that
the unrelated fingerprints at an anchor stay as many and comparisons don't grow with the
square of the documents.

At an anchor, fingerprints close enough are joined by a minimum spanning tree of their
distances, so a group of n emits n - 1 candidate links, those of its most similar texts.
The shingles of both ends then decide each link exactly. Where that parts a tree and no
other link joins the parts, all texts of the parts are compared by their sets, each with
each of another part, in cells of a bounded number of texts. A cell emits a forest of the
links it finds, so no row is made for a pair, and no pair is left out.

No task holds a large anchor. One with more than GROUP rows is cut, in an order of its own,
into sides of SIDE rows, and each two sides, and each with itself, are a cell whose
fingerprints are joined by a tree of their own. The cells have all pairs of the anchor, and
a link of its minimum spanning tree is in that of the cell that has it, so none is lost.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, word_bounds
from .components import components, least_of_component, split_join
from .hashing import gram_hashes, mixed, word_hashes
from .simhash import near_anchors

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and those of them that travel and are compared; the probability
#: with which a pair of the similarity may miss each other.
BITS, COMPARED, MISS = 512, 256, 0.005
#: Standard deviations of its bits by which a pair of the similarity may differ in more of them.
SLACK = 2.7
#: Fingerprints of an anchor that are compared where they are gathered; those of one side of a cell of a larger one; rows of a comparison matrix.
GROUP, SIDE, MATRIX = 8192, 32768, 512
#: Bits by which blocks are wider than the number of fingerprints asks for.
WIDER = 0
#: Texts, and shingles of them, that one side of a cell of parted texts has on average at most; cells of a comparison there.
CELL, CELL_SHINGLES, TILE = 2048, 1 << 21, 1 << 18
#: Keys of documents with a candidate link that are broadcast at most.
BROADCAST_ENDS = 200_000

_SEEDS = mixed(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of UTF-8 data, A-Z in lower case; fewer words are one shingle."""
    data = data.lower()
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(data, starts, ends), min(size, len(starts))))


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, BITS bits as 64-bit parts."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 1 << 14):
        part = mixed(grams[at : at + (1 << 14), None] ^ _SEEDS[None, :])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)


def node_of(grams: np.ndarray) -> int:
    """The number that stands for a set of shingles."""
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def flips(similarity: float) -> float:
    """The share of bits in which two sets of a similarity and of one size differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def meeting(similarity: float, width: int) -> float:
    """With what probability two sets of a similarity share the home anchor of a block."""
    p = flips(similarity)
    q, code = 1 - p, (1 << ((width + 1).bit_length() - 1)) - 1
    same = q**code + code / (code + 1) * (2 * p * q ** (code - 1) + (code - 1) * p * p * q ** (code - 2))
    return same * q ** (width - code)


def drawn(count: int, similarity: float, miss: float = MISS, wider: int = 0) -> np.ndarray:
    """The bits of each block, (blocks, width), for so many fingerprints.

    The width leaves 64 unrelated fingerprints at an anchor on average, or fewer with wider blocks.
    """
    width = max(16, ceil(log2(max(2, count))) - 2) + wider
    blocks = ceil(log(miss) / log(1 - meeting(similarity, width)))
    rng = np.random.default_rng(width)
    each = BITS // width
    orders = [rng.permutation(BITS)[: each * width].reshape(each, width) for _ in range(-(-blocks // each))]
    return np.concatenate(orders)[:blocks]


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, node, fps) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            nodes, fps = [], []
            for text in batch.column(1):
                grams = shingle_set(text.as_buffer().to_pybytes(), shingle)
                nodes.append(node_of(grams))
                fps.append(fingerprint(grams))
            flat = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BITS // 64), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), lists], ["id", "node", "fps"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, node long, fps array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, grams) of each distinct text."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text.as_buffer().to_pybytes(), shingle) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "grams"]
            )

    return docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).distinct().mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])


def _covered(members: DataFrame, bits: np.ndarray) -> DataFrame:
    """(anchor, node, f0, f1, ...): each fingerprint at each anchor that covers one of its blocks."""
    width = bits.shape[1]
    powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
    names = [f"f{k}" for k in range(BITS // 64)]
    sent = 1 + COMPARED // 64
    columns = ["anchor", "node", *names[: sent - 1]]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                own = [some.column(k).to_numpy(zero_copy_only=False) for k in range(1 + len(names))]
                ones = np.unpackbits(np.stack(own[1:], axis=1).view(np.uint8), axis=1, bitorder="little")
                for k, chosen in enumerate(bits):
                    block = (ones[:, chosen] * powers).sum(1, dtype=np.uint64)
                    index, anchor, _ = near_anchors(block, width, 0)
                    key = mixed(anchor ^ np.uint64(k) << np.uint64(56))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(c[index]) for c in own[:sent])], columns)

    flat = members.select("node", *(F.get("fps", k).alias(n) for k, n in enumerate(names)))
    return flat.mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _order(a: np.uint64, b: np.ndarray) -> np.ndarray:
    """A number of 40 bits for each pair, the same in either order: it decides between equal distances alike at all anchors."""
    return mixed(a ^ b) >> np.uint64(24)


def spanning_forest(nodes: np.ndarray, fps: np.ndarray, distance: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(links, heads): a minimum spanning forest of the fingerprints within distance, and the first member of each tree."""
    n = len(nodes)
    names, best, parent = nodes.view(np.uint64), np.full(n, ~np.uint64(0)), np.full(n, -1)
    left = np.arange(n)
    far = np.uint64(distance + 1) << np.uint64(40)
    links, heads = [], []
    while len(left):
        at = int(best[left].argmin())
        i = int(left[at])
        left = np.delete(left, at)
        if best[i] >= far:
            heads.append(i)
        else:
            links.append((int(nodes[i]), int(nodes[parent[i]])))
        apart = np.bitwise_count(fps[left] ^ fps[i]).sum(1, dtype=np.uint64)
        near = apart <= distance
        if near.any():
            to = left[near]
            weight = apart[near] << np.uint64(40) | _order(names[i], names[to])
            less = weight < best[to]
            best[to[less]], parent[to[less]] = weight[less], i
    return links, heads


def within(nodes: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A minimum spanning forest of some fingerprints within distance."""
    n = len(nodes)
    if n <= MATRIX:
        apart = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(2, dtype=np.uint16)
        close = np.flatnonzero((apart <= distance).sum(1) > 1)
        return spanning_forest(nodes[close], fps[close], distance)[0] if len(close) else []
    return spanning_forest(nodes, fps, distance)[0]


def across(nodes: np.ndarray, fps: np.ndarray, distance: int, roots: np.ndarray) -> list[tuple[int, int, int]]:
    """(a, b, apart): for each fingerprint all those within distance that have another root. near_duplicates() needs no such pairs."""
    out = []
    if (roots == roots[:1]).all():
        return out
    for lo in range(0, len(nodes), MATRIX):
        of = slice(lo, lo + MATRIX)
        apart = np.zeros((len(nodes[of]), len(nodes)), np.uint16)
        for part in range(fps.shape[1]):
            apart += np.bitwise_count(fps[of, part][:, None] ^ fps[None, :, part])
        apart[roots[of, None] == roots[None, :]] = 1 << 15
        i, j = np.nonzero(apart <= distance)
        out += zip(nodes[of][i].tolist(), nodes[j].tolist(), apart[i, j].tolist())
    return out


def _forest(held: list[tuple], distance: int) -> list[tuple[int, int]]:
    """The links of what is held, pairs of nodes and fingerprints."""
    nodes, fps = (np.concatenate(x) for x in zip(*held))
    return within(nodes, fps, distance) if len(nodes) > 1 else []


def _runs(batch, parts: int):
    """(key, nodes, fingerprints) of each run of one key in a batch of (key, node, f0, f1, ...)."""
    keys, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    if not len(keys):
        return
    fp = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(parts)], axis=1).view(np.uint64)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(keys[lo]), node[lo:hi], fp[lo:hi]


def _links_at_anchors(distance: int):
    """An Arrow function over rows sorted by anchor: (a, b, side), the candidate links at each, without a side.

    Of an anchor with more than GROUP rows it tells the rows instead: the node, the anchor,
    and the side of SIDE rows that it belongs to.
    """

    def run(batches):
        key, held, count = None, [], 0

        def links():
            out = _forest(held, distance) if held else []
            a, b = zip(*out) if out else ((), ())
            return made(pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(out), pa.int32()))

        def rows(nodes, first):
            return made(pa.array(nodes), pa.array(np.full(len(nodes), key, np.int64)), pa.array((np.arange(first, first + len(nodes)) // SIDE).astype(np.int32)))

        def made(*columns):
            return pa.RecordBatch.from_arrays(list(columns), ["a", "b", "side"])

        for batch in batches:
            for anchor, nodes, fps in _runs(batch, COMPARED // 64):
                if anchor != key:
                    yield links()
                    key, held, count = anchor, [], 0
                if count + len(nodes) <= GROUP:
                    held.append((nodes, fps))
                else:
                    if held:
                        yield rows(np.concatenate([x for x, _ in held]), 0)
                        held = []
                    yield rows(nodes, count)
                count += len(nodes)
        yield links()

    return run


def _links_in_cells(distance: int):
    """An Arrow function over rows sorted by cell: (a, b), the candidate links in each."""

    def run(batches):
        key, held = None, []

        def links():
            out = _forest(held, distance) if held else []
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for cell, nodes, fps in _runs(batch, COMPARED // 64):
                if cell != key:
                    yield links()
                    key, held = cell, []
                held.append((nodes, fps))
        yield links()

    return run


def _in_cells(rows: DataFrame, members: DataFrame, distance: int) -> DataFrame:
    """(a, b): the candidate links at anchors whose rows (node, anchor, side) are told."""
    of_anchor = stored(rows.groupBy("anchor").agg((F.max("side") + 1).alias("sides"), F.count(F.lit(1)).alias("n")), "sides")
    each = split_join(rows, of_anchor, "anchor", rows.count())
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    sent = each.select("node", "anchor", "side", other).select("node", F.xxhash64("anchor", F.least("side", "other"), F.greatest("side", "other")).alias("cell"))
    fps = [F.get("fps", k).alias(f"f{k}") for k in range(COMPARED // 64)]
    met = sent.join(members.select("node", *fps), "node").select("cell", "node", *(f"f{k}" for k in range(len(fps))))
    return met.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_links_in_cells(distance), "a long, b long")


def candidate_links(members: DataFrame, count: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: links by node between the members (node, fps) that may have the similarity, each once."""
    p = flips(similarity)
    distance = int(p * COMPARED + SLACK * sqrt(COMPARED * p * (1 - p)))
    at = _covered(members, drawn(count, similarity, wider=WIDER)).repartition("anchor")
    # an order of each anchor's own
    met = at.sortWithinPartitions("anchor", F.xxhash64("anchor", "node")).mapInArrow(_links_at_anchors(distance), "a long, b long, side int")
    link = F.col("side").isNull()
    ends = F.when(link, F.least("a", "b")).otherwise(F.col("a")), F.when(link, F.greatest("a", "b")).otherwise(F.col("b"))
    found = stored(met.select(ends[0].alias("a"), ends[1].alias("b"), "side").distinct(), "candidates")
    links, large = found.where(link).select("a", "b"), found.where(~link)
    if large.isEmpty():
        return links
    more = _in_cells(large.select(F.col("a").alias("node"), F.col("b").alias("anchor"), "side"), members, distance)
    return stored(links.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "candidates")


def _decided(docs: DataFrame, members: DataFrame, links: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Those of the links (a, b) whose sets of shingles have the similarity, and the sets of all ends. docs: (id, text)."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    # any row of a set will do, and null ids name none: so the least id, or all rows without one
    ids = stored(members.join(ends, "node", "left_semi").select(F.col("least").alias("end")).distinct(), "ends")
    few = ids.limit(BROADCAST_ENDS + 1).count() <= BROADCAST_ENDS
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("end")), "left_semi")
    sets = stored(_sets(texts, shingle), "shingles")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("grams").alias(f"grams_{k}"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - shared
    return stored(links.join(side("a"), "a").join(side("b"), "b").where(shared >= similarity * union - 1e-9).select("a", "b"), "decided"), sets


def _open(refused: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b): the refused links whose ends are in two components still."""
    side = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    met = refused.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return met.select("a", "b", *(F.coalesce(f"root_{k}", k).alias(f"root_{k}") for k in "ab")).where("root_a <> root_b")


def _nearest(proposed: DataFrame, tested: DataFrame) -> DataFrame:
    """(a, b), a < b: of the pairs that weren't tested the nearest one of each a. near_duplicates() needs no such pairs."""
    pairs = proposed.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))
    new = pairs.join(tested.select(F.col("a").alias("low"), F.col("b").alias("high")), ["low", "high"], "left_anti")
    best = new.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(nodes: np.ndarray, roots: np.ndarray, left: np.ndarray, grams: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest of the links of the similarity that join roots, between the rows marked as left and the others, or among all if all are left."""
    order = np.argsort(roots, kind="stable")
    nodes, roots, left, grams = nodes[order], np.unique(roots[order], return_inverse=True)[1], left[order], [grams[i] for i in order]
    rows = np.flatnonzero(left)
    columns = rows if len(rows) == len(nodes) else np.flatnonzero(~left)
    if roots[-1] == roots[0] or not len(columns):
        return []
    sizes = np.array([len(x) for x in grams], np.int64)
    owner = np.repeat(np.arange(len(grams)), sizes)
    _, code, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    owner, code = owner[n[code] > 1], code[n[code] > 1]
    parent, out = np.arange(int(roots[-1]) + 1), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    step = max(1, TILE // len(columns))
    for at in range(0, len(rows), step):
        i = rows[at : at + step]
        # rows are in the order of their roots, so most tiles have one root; those that have are spared its own texts
        j = columns[roots[columns] != roots[i[0]]] if roots[i[0]] == roots[i[-1]] else columns
        j = j[(sizes[j] >= similarity * sizes[i].min() - 1e-9) & (similarity * sizes[j] <= sizes[i].max() + 1e-9)]
        if not len(j):
            continue
        # of the shingles that the tile shares with others, a bit each
        ours, has = np.zeros(len(grams), bool), np.zeros(len(n), bool)
        ours[i] = True
        has[code[ours[owner]]] = True
        of, bit = owner[has[code]], (np.cumsum(has) - 1)[code[has[code]]]
        bits = np.zeros((int(has.sum()) // 64 + 1, len(grams)), np.uint64)
        np.bitwise_or.at(bits, (bit >> 6, of), np.uint64(1) << (bit & 63).astype(np.uint64))
        common = np.zeros((len(i), len(j)), np.int32)
        for word in bits:
            common += np.bitwise_count(word[i][:, None] & word[j][None, :])
        union = sizes[i][:, None] + sizes[j][None, :] - common
        x, y = np.nonzero((common >= similarity * union - 1e-9) & (roots[i][:, None] != roots[j][None, :]))
        _, first = np.unique(np.stack((roots[i[x]], roots[j[y]])), axis=1, return_index=True)
        for k in first.tolist():
            a, b = root(roots[i[x[k]]]), root(roots[j[y[k]]])
            if a != b:
                parent[a] = b
                out.append((int(nodes[i[x[k]]]), int(nodes[j[y[k]]])))
    return out


def _joined_in_cells(similarity: float):
    """An Arrow function over rows (cell, left, node, root, grams) sorted by cell: (a, b), the links that join roots in each."""

    def run(batches):
        key, held = None, []

        def flush():
            nodes, roots, left, grams = ([x for part in parts for x in part] for parts in zip(*held)) if held else ([], [], [], [])
            held.clear()
            out = joined(np.array(nodes, np.int64), np.array(roots, np.int64), np.array(left, bool), grams, similarity) if len(nodes) > 1 else []
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cell, left, node, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            ends, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)])) if len(cell) else [0]
            for lo, hi in zip(edge[:-1], edge[1:]):
                if key is not None and cell[lo] != key:
                    yield flush()
                key = cell[lo]
                held.append((node[lo:hi], root[lo:hi], left[lo:hi], [flat[ends[r] : ends[r + 1]] for r in range(lo, hi)]))
        yield flush()

    return run


def _across(left: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of the similarity that join all roots which a link of it joins and which refused links in `left` hold together.

    Roots that refused links hold together are a family. A family of many texts is
    divided by size, so that only neighbouring classes can be similar, and a class by hash.
    Each pair of blocks of one class, or of neighbouring ones, is a cell.
    """
    families = components(left.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("family"))
    ends = sets.select("node", F.size("grams").alias("size")).join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"))
    of_root = ends.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(families, "root")
    total = sets.count()
    placed = stored(split_join(ends, of_root, "root", total), "placed")
    by_size = F.floor(F.log(F.greatest("size", F.lit(1))) / -log(similarity * (1 - 1e-6))).cast("int")
    blocks = lambda n, size: F.ceil(F.greatest(n / CELL, size / CELL_SHINGLES)).cast("int")
    counted = placed.groupBy("family", by_size.alias("class")).agg(F.count(F.lit(1)).alias("of"), F.sum("size").alias("shingles"))
    of_family = counted.groupBy("family").agg(
        F.sum("of").alias("n"), (blocks(F.sum("of"), F.sum("shingles")) > 1).alias("divided"), F.map_from_entries(F.collect_list(F.struct("class", blocks(F.col("of"), F.col("shingles"))))).alias("blocks")
    )
    each = split_join(placed, of_family, "family", total).withColumn("class", F.when(F.col("divided"), by_size).otherwise(0))
    there = lambda c: F.when(F.col("divided"), F.coalesce(F.try_element_at("blocks", c), F.lit(0))).otherwise(F.when(c == F.col("class"), 1).otherwise(0))
    one = F.col("class")
    each = each.withColumn("block", F.pmod(F.xxhash64("node"), there(one)).cast("int"))
    # (class, block) of the lower side and of the other
    meets = lambda c, cell: F.transform(F.sequence(F.lit(0), there(c)), lambda k: F.when(k < there(c), cell(k)))
    cell = lambda c, i, d, j, is_left: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), is_left.alias("left"))
    mine = F.col("block")
    cells = F.concat(
        meets(one, lambda k: cell(one, F.least(mine, k), one, F.greatest(mine, k), mine <= k)),
        meets(one + 1, lambda k: cell(one, mine, one + 1, k, F.lit(True))),
        meets(one - 1, lambda k: cell(one - 1, k, one, mine, F.lit(False))),
    )
    sent = each.select("node", "root", "family", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("at"))
    sent = sent.select(F.xxhash64("family", "at.c", "at.i", "at.d", "at.j").alias("cell"), "at.left", "node", "root")
    rows = sent.join(sets, "node").select("cell", "left", "node", "root", "grams").repartition("cell").sortWithinPartitions("cell")
    return stored(rows.mapInArrow(_joined_in_cells(similarity), "a long, b long"), "joined")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) of each row of docs.

    component_id: the least id reachable over links, which join texts whose sets of
    shingles share at least `similarity` of their union. Texts of one set of shingles,
    those without words among them, are one. Every link is decided by the sets; a pair
    may be overlooked as told in the module's docstring, where chance keeps it from all
    common anchors.

    Null texts are empty; very long ones count whole; equal rows each give a row; null ids
    are no component's least id unless it has no other; other columns are left aside; an
    empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    members = stored(rows.groupBy("node").agg(F.first("fps").alias("fps"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "members")
    count = members.count()
    tested = candidate_links(members.select("node", "fps"), count, similarity)
    decided, sets = _decided(texts, members, tested, shingle, similarity)
    roots = stored(components(decided), "roots")
    left = stored(_open(tested.join(decided, ["a", "b"], "left_anti"), roots), "refused")
    if not left.isEmpty():
        more = _across(left, roots, sets, similarity)
        roots = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    placed = least_of_component(members.select("node", "least"), roots)
    of_node = stored(members.select("node", "n").join(placed, "node"), "components")
    return split_join(rows.select("id", "node"), of_node, "node", rows.count()).select(F.col("id").alias(id_col), "component_id")
