"""Benchmark decontamination by a distributed positional inverted index.

1. The index: each task writes postings of the documents it reads, as one row for about
   SEGMENT bytes of text. A segment holds every token of its documents with the sorted
   list of its places, so a token that is everywhere is split over all segments, and no
   posting is shuffled. Documents are never divided between segments.
2. Benchmark texts are cut into windows. They are a query set, and go to the index in
   blocks of a bounded number of tokens: each block is broadcast, and looked up in all
   segments. Texts of equal tokens are looked up once.
3. The postings tell how often each term of a block occurs in the corpus. In a segment,
   the list of a window's rarest term gives its candidate places; the lists of the other
   terms, from rare to frequent and moved by their offset in the window, are intersected
   with them. A window that lacks a term in a segment is left out before.

A phrase match has each term at its place. A proximity match has the rarest term at its
place and each other one at most `slack` words from its own, all in one document.
Tokens are told apart by a hash of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, word_bounds
from .hashing import gram_hashes, word_hashes

#: Words of a window, and how many words a term may be off in a proximity match.
WINDOW, SLACK = 10, 2
#: Bytes of text from which on a segment is written.
SEGMENT = 4 << 20
#: Benchmark tokens of a block, windows of a long text that stay together, and candidates that are intersected at once.
BLOCK, PART, CANDIDATES = 250_000, 4096, 1 << 20

_GAPS = np.ones(256, bool)
_GAPS[0x30:0x3A] = _GAPS[0x61:0x7B] = _GAPS[0x80:] = False


def tokens_of(data: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 data: digits, letters and all beyond ASCII, A-Z in lower case."""
    data = data.lower()  # of bytes: A-Z only
    return word_hashes(data, *word_bounds(data, _GAPS))


def segment(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, starts, places): the sorted distinct tokens of some documents, where the list of each begins, and all lists."""
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    places = np.argsort(flat, kind="stable").astype(np.int32)
    flat = flat[places]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    return flat[starts], starts.astype(np.int32), places


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT) -> DataFrame:
    """(segment, ids, sizes, terms, starts, steps): the stored index, a row for each segment.

    ids and sizes: of its documents, in order, with their numbers of words; a place is a
    word's number in their concatenation. terms: the distinct tokens. starts: where the
    list of each begins. steps: the lists one after the other, as differences of places.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        part, made, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal made, size
            terms, starts, places = segment(held)
            row = [
                pa.array([part << 32 | made], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([[len(x) for x in held]], pa.list_(pa.int32())),
                pa.array([terms.view(np.int64)], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32())), pa.array([np.diff(places, prepend=np.int32(0))], pa.list_(pa.int32())),
            ]
            held.clear()
            ids.clear()
            made, size = made + 1, 0
            return pa.RecordBatch.from_arrays(row, ["segment", "ids", "sizes", "terms", "starts", "steps"])

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                data = text.as_buffer()
                held.append(np.zeros(0, np.uint64) if data is None else tokens_of(data.to_pybytes()))
                ids.append(batch.column(0).slice(i, 1))
                size += 16 + (0 if data is None else data.size)
                if size >= segment_bytes:
                    yield flush()
        if held:
            yield flush()

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"segment long, ids array<{kind}>, sizes array<int>, terms array<long>, starts array<int>, steps array<int>"
    )
    return stored(made, "postings", compression="zstd", wide=True)


def _parts(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, class, part, span, tokens): each text in parts of PART windows of span words; class stands for its tokens."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                tokens = tokens_of(text.as_buffer().to_pybytes())
                span = min(window, len(tokens))
                name = xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)
                for part in range(0, len(tokens) - span + 1 if span else 0, PART):
                    at.append(i)
                    rows.append((name, part, span, tokens[part : part + PART + span - 1].view(np.int64)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))))],
                ["id", "class", "part", "span", "tokens"],
            )

    texts = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, class long, part int, span int, tokens array<long>")


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted terms, at most a block's, occurs in the corpus."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for known, starts, n in zip(*(batch.column(i) for i in range(3))):
                known, starts = (x.values.to_numpy() for x in (known, starts))
                lo, hi = _lists(known.view(np.uint64), starts, n.as_py(), sent.value)
                total += hi - lo
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    each = index.select("terms", "starts", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("words")).mapInArrow(run, "term long, n long")
    counts = np.zeros(len(terms), np.int64)
    for row in each.groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most a block's terms
        counts[row.column(0).to_numpy()] = row.column(1).to_numpy()
    sent.destroy()
    return counts


def _lists(known: np.ndarray, starts: np.ndarray, n: int, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the list of each term begins and ends in a segment of n words; an empty range where it has none."""
    if not len(known):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    ends = np.append(starts[1:], n).astype(np.int64)
    there = known[at] == terms
    return np.where(there, starts[at], 0).astype(np.int64), np.where(there, ends[at], 0)


class Block:
    """The windows of some texts, each once, with the order in which their terms are to be looked up."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], counts_of):
        """parts: (class, span, tokens). counts_of: gives the corpus' counts of sorted terms."""
        self.terms = np.unique(np.concatenate([t for *_, t in parts])) if parts else np.zeros(0, np.uint64)
        self.candidates = CANDIDATES
        counts = counts_of(self.terms)
        self.groups = []
        for span in sorted({s for _, s, _ in parts}):
            of = [(c, np.searchsorted(self.terms, t)) for c, s, t in parts if s == span]
            codes = np.concatenate([np.lib.stride_tricks.sliding_window_view(t, span) for _, t in of]).astype(np.int32)
            classes = np.concatenate([np.full(len(t) - span + 1, c) for c, t in of])
            codes, window = np.unique(codes, axis=0, return_inverse=True)
            pairs = np.unique(np.stack((window.ravel(), classes), axis=1), axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(codes) + 1))
            n = counts[codes]
            self.groups.append((span, codes, np.argsort(n, axis=1, kind="stable").astype(np.int16), (n > 0).all(1), first, pairs[:, 1]))

    def matches(self, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, sizes: np.ndarray, slack: int):
        """(span, window classes, place of the first word, document, exact) of the matches in a segment, by slices."""
        ends = np.cumsum(sizes)
        lo, hi = _lists(terms, starts, len(places), self.terms)
        n = hi - lo
        listed = np.flatnonzero(n)
        keys = np.repeat(listed << 32, n[listed]) | places[_ranges(lo[listed], n[listed])]
        for span, codes, order, occurs, first, classes in self.groups:
            alive = np.flatnonzero(occurs)
            alive = alive[(n[codes[alive]] > 0).all(1)]
            rarest = codes[alive, order[alive, 0]]
            total = np.cumsum(n[rarest])
            edges = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, self.candidates), side="right"))
            for a, b in zip(edges, [*edges[1:], len(alive)]):
                w = np.repeat(alive[a:b], n[rarest[a:b]])
                at = places[_ranges(lo[rarest[a:b]], n[rarest[a:b]])].astype(np.int64)
                document = np.searchsorted(ends, at, side="right")
                s = at - order[w, 0]
                begin, end = ends[document] - sizes[document], ends[document]
                inside = (s >= begin) & (s + span <= end)
                w, s, begin, end, document = (x[inside] for x in (w, s, begin, end, document))
                exact = np.ones(len(w), bool)
                for k in range(1, span):
                    j = order[w, k]
                    term = codes[w, j].astype(np.int64) << 32
                    place = s + j
                    low, high = np.maximum(begin, place - slack), np.minimum(end - 1, place + slack)
                    near = _any(keys, term | low, term | high)
                    if slack:
                        exact[exact] = _any(keys, (term | place)[exact], (term | place)[exact])
                    w, s, begin, end, document, exact = (x[near] for x in (w, s, begin, end, document, exact))
                if len(w):
                    yield span, (first[w], first[w + 1], classes), s, document, exact


def _any(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the sorted keys have one from low to high."""
    at = np.searchsorted(keys, low)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= high) if len(keys) else np.zeros(len(low), bool)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ..., n of them, for each."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _looked_up(index: DataFrame, block: Block, slack: int) -> DataFrame:
    """(segment, ordinal, starts, lengths, exact, near): the runs of hit words of each document with a match, and the classes of its matches."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches:
            for name, sizes, terms, starts, steps in zip(*(batch.column(i) for i in range(5))):
                sizes, terms, starts, steps = (x.values.to_numpy() for x in (sizes, terms, starts, steps))
                sizes, places = sizes.astype(np.int64), np.cumsum(steps, dtype=np.int64)
                marks, found = np.zeros(len(places) + 1, np.int64), []
                for span, (lo, hi, classes), s, document, exact in sent.value.matches(terms.view(np.uint64), starts, places, sizes, slack):
                    np.add.at(marks, s[exact], 1)
                    np.add.at(marks, s[exact] + span, -1)
                    n = hi - lo
                    pairs = np.stack((np.repeat(document, n), np.repeat(exact.astype(np.int64), n), classes[_ranges(lo, n)]), axis=1)
                    found.append(np.unique(pairs, axis=0))
                if not found:
                    continue
                found = np.unique(np.concatenate(found), axis=0)
                covered = np.cumsum(marks)[:-1] > 0
                ends = np.cumsum(sizes)
                out = []
                for d in np.unique(found[:, 0]).tolist():
                    a, b = _runs(covered[ends[d] - sizes[d] : ends[d]])
                    of = found[found[:, 0] == d]
                    out.append((name.as_py(), d, a, b - a, of[of[:, 1] == 1, 2], np.unique(of[:, 2])))
                types = [pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["segment", "ordinal", "starts", "lengths", "exact", "near"])

    return index.select("segment", "sizes", "terms", "starts", "steps").mapInArrow(
        run, "segment long, ordinal int, starts array<int>, lengths array<int>, exact array<long>, near array<long>"
    )


def _merged(hits: DataFrame) -> DataFrame:
    """(segment, ordinal, n_hit, spans, exact, near): what all blocks have found of a document."""

    def run(batches):
        for batch in batches:
            n_hit, spans = [], []
            for starts, lengths in zip(batch.column(2), batch.column(3)):
                starts, lengths = (np.concatenate([np.asarray(x, np.int64) for x in c.as_py()]) for c in (starts, lengths))
                order = np.argsort(starts, kind="stable")
                starts, reach = starts[order], np.maximum.accumulate((starts + lengths)[order])
                new = np.concatenate(([True], starts[1:] > reach[:-1])) if len(starts) else np.zeros(0, bool)
                a, b = starts[new], reach[np.append(new[1:], True)] if len(starts) else reach
                n_hit.append(int((b - a).sum()))
                spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(a, b)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(spans, kind), batch.column(4), batch.column(5)],
                ["segment", "ordinal", "n_hit", "spans", "exact", "near"],
            )

    each = hits.groupBy("segment", "ordinal").agg(
        F.collect_list("starts").alias("starts"), F.collect_list("lengths").alias("lengths"),
        F.array_distinct(F.flatten(F.collect_list("exact"))).alias("exact"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )
    return each.mapInArrow(run, "segment long, ordinal int, n_hit long, spans array<struct<start:long,length:long>>, exact array<long>, near array<long>")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slack: int = SLACK, block: int = BLOCK, segment_bytes: int = SEGMENT,
) -> DataFrame:
    """(id, n_words, n_hit, spans, item_ids, near_ids) of each row of docs.

    n_hit: its words inside an occurrence of a window of any item. spans: those words, as
    maximal runs (start, length). item_ids: the items with a window that occurs, as
    sorted strings; near_ids: those with a window that occurs or has a proximity match
    (within slack words). A text of fewer words than a window is one window.

    Null and empty texts, on either side, have no words and match nothing; very long ones
    count whole. Equal rows each give a row; null document ids stay null. Items of equal
    texts are all listed; a repeated item_id is listed once; an item without an id marks
    words but is not listed. Ties of frequency go to the earlier term of the window. Other
    columns are left aside; an empty table on either side gives no matches.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col, segment_bytes)
    parts = stored(_parts(items, item_col, item_text_col, window), "windows")
    texts = parts.dropDuplicates(["class", "part"])
    total = texts.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = -(-total // block)
    hits = None
    for b in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("class", "part"), F.lit(blocks)) == b).select("class", "span", "tokens").toArrow()
        own = [(c, s, t.values.to_numpy().view(np.uint64)) for c, s, t in zip(rows["class"].to_pylist(), rows["span"].to_pylist(), rows["tokens"])]
        if own:
            found = stored(_looked_up(index, Block(own, lambda terms: frequencies(index, terms)), slack), "matches")
            hits = found if hits is None else hits.unionByName(found)
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("ordinal", "doc")).select("segment", "ordinal", F.col("doc.ids").alias("id"), F.col("doc.sizes").cast("long").alias("n_words"))
    if hits is None:
        none = F.array().cast("array<string>")
        return rows.select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"), none.alias("item_ids"), none.alias("near_ids"))
    merged = stored(_merged(hits), "hits")
    names = parts.where("id is not null").select("class", F.col("id").cast("string").alias("item")).distinct()
    near = merged.select("segment", "ordinal", "exact", F.explode("near").alias("class")).join(names, "class")
    listed = near.groupBy("segment", "ordinal").agg(
        F.array_sort(F.collect_set(F.when(F.array_contains("exact", F.col("class")), F.col("item")))).alias("item_ids"), F.array_sort(F.collect_set("item")).alias("near_ids")
    )
    found = merged.select("segment", "ordinal", "n_hit", "spans").join(listed, ["segment", "ordinal"], "left")
    of = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return rows.join(found, ["segment", "ordinal"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), of("spans", "array<struct<start:long,length:long>>"),
        of("item_ids", "array<string>"), of("near_ids", "array<string>"),
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return made.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near_items"),
    )


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w, unnest(generate_series(1, len(w))) AS p FROM doc WHERE len(w) > 0),
freq AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
win AS (SELECT item_id, w, least(len(w), 10) AS span, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS st FROM item WHERE len(w) > 0),
term AS (SELECT item_id, st, span, unnest(generate_series(0, span - 1)) AS j, unnest(w[st:st + span - 1]) AS w FROM win),
rarest AS (
  SELECT item_id, st, span, j, w FROM (SELECT t.*, coalesce(n, 0) AS n FROM term t LEFT JOIN freq USING (w))
  QUALIFY row_number() OVER (PARTITION BY item_id, st ORDER BY n, j) = 1),
cand AS (
  SELECT d.doc_id, v.item_id, v.st, v.span, d.p - v.j AS s FROM rarest v JOIN dw d ON d.w = v.w JOIN doc USING (doc_id)
  WHERE d.p - v.j >= 1 AND d.p - v.j + v.span - 1 <= len(doc.w)),
met AS (
  SELECT c.doc_id, c.item_id, c.st, c.s, c.span, count(DISTINCT t.j) AS near, count(DISTINCT t.j) FILTER (WHERE d.p = c.s + t.j) AS exact
  FROM cand c JOIN term t ON t.item_id = c.item_id AND t.st = c.st
  JOIN dw d ON d.doc_id = c.doc_id AND d.w = t.w AND d.p BETWEEN c.s + t.j - 2 AND c.s + t.j + 2
  GROUP BY ALL HAVING near = c.span),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + span - 1)) AS p FROM met WHERE exact = span) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) FILTER (WHERE exact = span) AS n, count(DISTINCT item_id) AS near,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) FILTER (WHERE exact = span) AS names
  FROM met GROUP BY doc_id)
SELECT doc_id, len(doc.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(named.near, 0)::BIGINT AS n_near_items
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
