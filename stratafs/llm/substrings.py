"""Substring dedup: suffix automata over shards of reference passages.

A window is `span` consecutive words. All but the first of equal windows are removed.
Suffix automata of the whole corpus could not be broadcast: they grow with it, and each
document would have to meet all of them. Here the reference is cut into shards by
content instead, so that a document's passage meets the one automaton that can match it:

1. Each window has an anchor, the least hash among its `gram`-word grams; equal windows
   have equal anchors. Anchors found once in the corpus need no further look.
2. Runs of windows with one repeated anchor are cut out as segments and sent to their
   anchor's shard. A task sends equal segments once and resolves the others itself.
3. A shard adds segments to a suffix automaton in the order of documents. A segment that
   arrives streams through it first; where its matching statistic reaches `span` words,
   a window ends that has been there before.
4. The windows found come back to their documents, where maximal spans are removed.

Anchors with more than HOT windows, or in MANY rows of a batch, would make large shards; their
windows are segments of their own, sent to the shard of the whole window, where only equal
windows meet. Which way an anchor goes changes no result, and all its rows go the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, word_bounds, words_of
from .hashing import gram_hashes, word_hashes

#: Words of a window, and of the grams among which its anchor is chosen.
SPAN, GRAM = 20, 8
#: Windows of an anchor from which on they are told apart by their whole content.
HOT = 1000
#: Rows of one batch that have an anchor from which on it is hot without being counted.
MANY = 64
#: Segments that a task holds back at most to send equal ones once.
HELD = 200_000
#: Stands for a null id in the order of documents: it comes last.
NO_ID = (1 << 63) - 1


def anchors(words: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each window's anchor: its least gram, the first of equal ones."""
    grams = gram_hashes(words, gram)
    places = sliding_window_view(grams, span - gram + 1).argmin(1) + np.arange(len(words) - span + 1)
    return places, grams[places]


class SuffixAutomaton:
    """Of several word sequences; tells how long a match with any of them ends at each word."""

    def __init__(self):
        self.to, self.link, self.size = [{}], [-1], [0]

    def add(self, words) -> None:
        to, link, size = self.to, self.link, self.size
        last = 0
        for w in words:
            q = to[last].get(w)
            if q is not None:
                if size[q] != size[last] + 1:
                    q = self._split(last, w, q)
                last = q
                continue
            new = len(to)
            to.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in to[p]:
                to[p][w] = new
                p = link[p]
            if p >= 0:
                q = to[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w, q: int) -> int:
        to, link, size = self.to, self.link, self.size
        copy = len(to)
        to.append(dict(to[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and to[p].get(w) == q:
            to[p][w] = copy
            p = link[p]
        return copy

    def matches(self, words) -> list[int]:
        """For each word, the length of the longest match that ends there."""
        to, link, size = self.to, self.link, self.size
        state = length = 0
        out = []
        for w in words:
            while state and w not in to[state]:
                state = link[state]
                length = size[state]
            if w in to[state]:
                state = to[state][w]
                length += 1
            out.append(length)
        return out


def _anchor_rows(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(p, h, r, n): each anchor of a row once, with its places there; p is what its places are to be summed by, h is null where it is p.

    An anchor in MANY rows of a batch is hot and need not be counted. Its rows there have
    a p of their own, and a row without r tells the others, so they gather nowhere.
    """

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            hs, rs, ns = [], [], []
            told_of = set()  # equal rows without an id are one document, and one task may hold any number of them
            for r, text in zip(rows, batch.column(1)):
                data = text.as_buffer()
                if data is None:
                    continue
                starts, ends = word_bounds(data)
                if len(starts) < span or r in told_of:
                    continue
                told_of.add(r)
                places, h = anchors(word_hashes(data, starts, ends), span, gram)
                first = np.concatenate(([True], np.diff(places) > 0))
                h, n = np.unique(h[first], return_counts=True)
                hs.append(h)
                ns.append(n)
                rs.append(np.full(len(h), r))
            if hs:
                h, r, n = np.concatenate(hs).view(np.int64), np.concatenate(rs), np.concatenate(ns)
                each, at, times = np.unique(h, return_inverse=True, return_counts=True)
                many = (times >= MANY)[at]
                told = each[times >= MANY]
                p = np.where(many, h ^ r, h)
                n = np.where(many, HOT + 1, n)
                more = len(told)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((p, told))), pa.array(np.concatenate((h, told)), mask=np.concatenate((~many, np.ones(more, bool)))),
                     pa.array(np.concatenate((r, told)), mask=np.concatenate((np.zeros(len(r), bool), np.ones(more, bool)))),
                     pa.array(np.concatenate((n, np.full(more, HOT + 1))).astype(np.int32))],
                    ["p", "h", "r", "n"],
                )

    return docs.select("r", "text").mapInArrow(run, "p long, h long, r long, n int")


def _segments(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, d, v, start, n, segment): n windows from start on, whose words are the segment.

    A null segment says that an earlier occurrence of the same windows is known already.
    """

    def run(batches):
        held: dict[bytes, tuple] = {}
        rows: list[tuple] = []

        def flush():
            rows.extend((key, *at, n, segment) for segment, (key, at, n) in held.items())
            held.clear()

        def batch_of():
            columns = list(zip(*rows)) or [()] * 6
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["key", "d", "v", "start", "n", "segment"],
            )
            rows.clear()
            return made

        def put(key, at, n, segment):
            known = held.get(segment)
            if known is None:
                held[segment] = (key, at, n)
                if len(held) >= HELD:
                    flush()
            elif known[1] != at:
                if at < known[1]:
                    held[segment], at = (key, at, n), known[1]
                rows.append((at[0] ^ at[2], *at, n, None))

        for batch in batches:
            for d, v, text, cold, hot in zip(*(batch.column(i) for i in range(5))):
                d, v, data = d.as_py(), v.as_py(), text.as_buffer()
                if data is None:
                    continue
                starts, ends = word_bounds(data)
                if len(starts) < span:
                    continue
                words = word_hashes(data, starts, ends)
                places, h = anchors(words, span, gram)
                a = np.frombuffer(data, np.uint8)
                sizes = ends - starts
                to = np.cumsum(sizes + 1)
                begin = to - sizes - 1
                plain = np.full(int(to[-1]), 0x20, np.uint8)  # the words joined by single spaces
                plain[np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))] = a[
                    np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
                ]
                plain = plain.tobytes()
                edge = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1, [len(places)]))
                lo, hi = edge[:-1], edge[1:]
                keys = h[lo].view(np.int64)
                took = np.isin(keys, cold.values.to_numpy(zero_copy_only=False)) if len(cold) else np.zeros(len(keys), bool)
                for i, j, key in zip(lo[took].tolist(), hi[took].tolist(), keys[took].tolist()):
                    put(key, (d, v, i), j - i, plain[begin[i] : to[j + span - 2] - 1])
                if len(hot):
                    windows = gram_hashes(words, span).view(np.int64)
                    for i in np.flatnonzero(np.isin(h.view(np.int64), hot.values.to_numpy(zero_copy_only=False))).tolist():
                        put(int(windows[i]), (d, v, i), 1, plain[begin[i] : to[i + span - 1] - 1])
                if len(rows) >= 20_000:
                    yield batch_of()
        flush()
        while rows:
            some, rows[:] = rows[20_000:], rows[:20_000]
            yield batch_of()
            rows.extend(some)

    return docs.mapInArrow(run, "key long, d long, v long, start int, n int, segment binary")


def _shards(segments: DataFrame, span: int) -> DataFrame:
    """(d, v, start, n): runs of windows that occur earlier too."""

    def run(batches):
        shard = None
        seen: dict[bytes, tuple] = {}
        waiting: list[list[bytes]] = []
        automaton = None
        for batch in batches:
            out = []
            for key, d, v, start, n, segment in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if key != shard:
                    shard, seen, waiting, automaton = key, {}, [], None
                if segment is None:
                    out.append((d, v, start, n))
                    continue
                if segment in seen:
                    if seen[segment] != (d, v, start):  # a repeated row is the same occurrence
                        out.append((d, v, start, n))
                    continue
                words = segment.split(b" ")
                if seen:
                    automaton = automaton or SuffixAutomaton()
                    for other in waiting:
                        automaton.add(other)
                    waiting = []
                    at = None
                    for k, length in enumerate([*automaton.matches(words)[span - 1 :], 0]):
                        if length >= span:
                            at = k if at is None else at
                        elif at is not None:
                            out.append((d, v, start + at, k - at))
                            at = None
                seen[segment] = (d, v, start)
                waiting.append(words)
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["d", "v", "start", "n"]
            )

    at = segments.repartition("key").sortWithinPartitions("key", "d", "v", "start")
    return at.mapInArrow(run, "d long, v long, start int, n int")


def _cut(docs: DataFrame, span: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for d, v, text, found in zip(*(batch.column(i) for i in (0, 1, 2, 4))):
                data = text.as_buffer() or b""
                starts, ends = word_bounds(data)
                gone = np.zeros(len(starts) + 1, np.int64)
                d, v, found = d.as_py(), v.as_py(), found.as_py() or []
                for f in found:
                    if f["d"] == d and f["v"] == v:
                        gone[f["start"]] += 1
                        gone[f["start"] + f["n"] + span - 1] -= 1
                edge = np.diff(np.concatenate(([0], (np.cumsum(gone)[:-1] > 0).view(np.int8), [0])))
                lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                n_words.append(len(starts))
                n_removed.append(int((hi - lo).sum()))
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(lo, hi)])
                raw, pieces, at = bytes(data), [], 0
                for a, b in zip(lo, hi):
                    pieces.append(raw[at : starts[a]])
                    at = int(starts[b]) if b < len(starts) else len(raw)
                kept.append((b"".join(pieces) + raw[at:]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(kept, pa.string()), batch.column(5)],
                ["id", "n_words", "n_removed", "spans", "kept", "row"],
            )

    return docs.mapInArrow(run, f"id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept string, row {kind}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of each row of docs.

    spans: the maximal runs of removed words, as (start, length) in words. kept: the text
    without them; a text that loses nothing stays as it is. keep: columns of docs that
    follow as the struct `row` (null where none are asked for).

    Windows start earlier in a smaller id, or earlier in the same row. Rows of one id, as
    are all without an id, are ordered by a hash of 64 bits of their texts, which tells
    them apart; rows of one id and equal texts are one document and all have its result. Null ids come last and stay null. Null and empty texts, and
    those of fewer words than a window, lose nothing; very long ones are searched whole.
    An empty table gives an empty result.
    """
    held = keyed(docs, id_col, text_col, keep)
    # p is not gathered by hot anchors, save for those that no batch has often
    counted = _anchor_rows(held, span, gram).select("r", F.coalesce("h", "p").alias("h"), F.expr("sum(n) over (partition by p)").alias("times"))
    repeated = (
        counted.where("times > 1 and r is not null")
        .groupBy("r").agg(F.collect_set(F.when(F.col("times") <= HOT, F.col("h"))).alias("cold"), F.collect_set(F.when(F.col("times") > HOT, F.col("h"))).alias("hot"))
    )
    # all columns go along, so that both joins read one exchange of the texts
    routed = held.join(repeated, "r").select("d", "v", "text", "cold", "hot", "id", "row")
    found = _shards(_segments(routed, span, gram), span)
    per_row = found.groupBy(F.xxhash64("d", "v").alias("r")).agg(F.collect_set(F.struct("d", "v", "start", "n")).alias("found"))
    cut = _cut(held.join(per_row, "r", "left").select("d", "v", "text", "id", "found", "row"), span, held.schema["row"].dataType.simpleString())
    return cut.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", "kept", *(["row"] if keep else []))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(r, d, v, text, id, row): r is a number for each row but equal ones, so that rows without an id or of one id are not gathered; v stands for the text."""
    row = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("struct<none:int>")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    held = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("v"), text.alias("text"), F.col(id_col).cast("long").alias("id"), row.alias("row"))
    return held.select(F.xxhash64("d", "v").alias("r"), "*")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(documents(spark, sf_dir))
    return made.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.array_join(words_of(F.col("kept")), " ").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS words
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM split WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM again, (SELECT unnest(generate_series(0, 19)) AS k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split),
kept AS (
  SELECT x.doc_id, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS t
  FROM words x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""
