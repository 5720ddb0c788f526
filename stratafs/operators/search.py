"""Keyword search: postings, phrase matches, BM25."""

from __future__ import annotations

from functools import reduce
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, token, pos) of every token of the given text columns."""
    sides = F.array(*(F.struct(F.lit(c).alias("column"), tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("tokens")) for c in columns))
    each = docs.select(key, F.explode(sides).alias("s"))
    return each.select(key, F.col("s.column").alias("column"), F.posexplode("s.tokens").alias("pos", "token"))


def _occurrences(of: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(of, lambda t: t == phrase[0]))
    hit = lambda at, i: reduce(lambda a, b: a & b, (F.coalesce(F.get(at, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)))
    # the array is bound once, as it would else be made anew for every place in it
    return F.transform(F.array(of), lambda at: F.size(F.filter(F.transform(at, lambda t, i: hit(at, i)), lambda x: x)))[0]


def phrase_counts(docs: DataFrame, key: str, columns: list[str], phrases: list[list[str]]) -> DataFrame:
    """(key, length, f0, f1, ...): tokens of a document, and how often each phrase occurs in one of its columns."""
    tokened = docs.select(key, *(tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"t_{c}") for c in columns))
    total = lambda per: reduce(lambda a, b: a + b, per)
    return tokened.select(
        key, total([F.size(f"t_{c}") for c in columns]).alias("length"),
        *(total([_occurrences(F.col(f"t_{c}"), p) for c in columns]).alias(f"f{i}") for i, p in enumerate(phrases)),
    )


def matching(docs: DataFrame, key: str, columns: list[str], phrases: list[list[str]]) -> DataFrame:
    """Documents in which every phrase occurs; different phrases may be in different columns."""
    counted = phrase_counts(docs, key, columns, phrases)
    return counted.where(reduce(lambda a, b: a & b, (F.col(f"f{i}") > 0 for i in range(len(phrases))))) if phrases else counted.limit(0)


def bm25(docs: DataFrame, key: str, columns: list[str], phrases: list[list[str]]) -> DataFrame:
    """(key, rank): the matching documents; a lower rank is a better match.

    The scan makes one row of counts a document; the corpus' figures are one aggregate row.
    """
    counted = phrase_counts(docs, key, columns, phrases)
    if not phrases:
        return counted.select(key, F.lit(0.0).alias("rank")).limit(0)
    n = len(phrases)
    corpus = counted.agg(
        F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"),
        *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)),
    )
    joined = counted.where(reduce(lambda a, b: a & b, (F.col(f"f{i}") > 0 for i in range(n)))).join(F.broadcast(corpus))  # one row
    return joined.select(key, _rank(n).alias("rank"))


def _rank(n: int) -> Column:
    """The negated BM25 sum over f0, f1, ... of a row with length, docs, mean and n0, n1, ..."""

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"f{i}")
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    return -reduce(lambda a, b: a + b, map(part, range(n)))


# ---- over stored postings

#: Documents of a block on average, and blocks that a search scores first to learn what it may skip.
BLOCK, FIRST = 128, 64
#: Bounds are widened by this, more than their sums round.
_WIDER = 1 + 1e-9


def block_bits(docs: int) -> int:
    """Into how many parts, as a power of 2, so many documents are divided."""
    return max(0, ceil(log2(docs / BLOCK))) if docs > BLOCK else 0


#: The token of the row that names the documents of a part; no word is empty.
HEAD = ""
_BLOCK = "token string, prefix int, n int, most int, shortest int, keys array<string>, lengths array<int>, docs array<int>, counts array<int>, places array<bigint>"


def once_a_task(docs: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key a former row of the same task has, so that copies are dropped before a shuffle."""

    def run(batches):
        seen = set()
        for batch in batches:
            fresh = [k not in seen and not seen.add(k) for k in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(fresh, pa.bool_()))

    rows = docs.select(key, *(c for c in docs.columns if c != key))
    return rows.mapInArrow(run, rows.schema)


def _lists(values, starts: np.ndarray, end: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, end), pa.int32()), values)


def _block(prefix: int, keys: list[str], columns: list[pa.ListArray]) -> pa.RecordBatch:
    """The rows of a part: its head, and one for each token. columns: the tokens of each document, for each text column."""
    n = len(keys)
    sizes = [c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    length = sum(sizes).astype(np.int32)
    words = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    token = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
    place = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + (i << 32) for i, s in enumerate(sizes)])
    pair = token * n + owner
    # within a pair the places stay in order
    order = np.argsort(pair, kind="stable")
    pair, place = pair[order], place[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    count = np.diff(np.append(starts, len(pair))).astype(np.int32)
    doc, of = (pair[starts] % n).astype(np.int32), pair[starts] // n
    first = np.flatnonzero(np.diff(of, prepend=-1))
    made, per = len(first), np.diff(np.append(first, len(of))).astype(np.int32)
    most = np.maximum.reduceat(count, first) if made else count[:0]
    shortest = np.minimum.reduceat(length[doc], first) if made else count[:0]
    alone = lambda x, kind: _lists(x, np.zeros(1, np.int64), n) if kind is None else pa.nulls(1, kind)
    head = [
        pa.array([HEAD]), pa.array([prefix], pa.int32()), pa.array([n], pa.int32()), pa.nulls(1, pa.int32()), pa.array([length.min()], pa.int32()),
        alone(pa.array(keys, pa.string()), None), alone(pa.array(length), None), *(alone(None, pa.list_(k)) for k in (pa.int32(), pa.int32(), pa.int64())),
    ]
    rows = [
        words.dictionary.cast(pa.string()), pa.array(np.full(made, prefix, np.int32)), pa.array(per), pa.array(most), pa.array(shortest),
        pa.nulls(made, pa.list_(pa.string())), pa.nulls(made, pa.list_(pa.int32())),
        _lists(pa.array(doc), first, len(of)), _lists(pa.array(count), first, len(of)), _lists(pa.array(place), starts[first], len(pair)),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([h, r]) for h, r in zip(head, rows)], [f.split()[0] for f in _BLOCK.split(", ")])


def _blocks(batches):
    """An Arrow function over rows (prefix, doc, tokens of each column) sorted by prefix and doc: the rows of each part."""
    key, held = None, []

    def flush():
        keys = [k for some, _ in held for k in some]
        return _block(key, keys, [pa.concat_arrays(parts) for parts in zip(*(columns for _, columns in held))])

    last = None
    for batch in batches:
        prefixes, docs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        fresh = [(k, d) != before for k, d, before in zip(prefixes.tolist(), docs, [last, *zip(prefixes.tolist(), docs)])]
        if docs:
            last = (int(prefixes[-1]), docs[-1])
        if not all(fresh):
            batch = batch.filter(pa.array(fresh))
            prefixes, docs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        edge = [*np.flatnonzero(np.diff(prefixes, prepend=-1)).tolist(), len(docs)]
        for lo, hi in zip(edge[:-1], edge[1:]):
            if held and key != prefixes[lo]:
                yield flush()
                held = []
            key = int(prefixes[lo])
            held.append((docs[lo:hi], [batch.column(2 + i).slice(lo, hi - lo) for i in range(batch.num_columns - 2)]))
    if held:
        yield flush()


def block_rows(docs: DataFrame, key: str, columns: list[str], segment: int, bits: int) -> DataFrame:
    """Postings to store: a row for each token and part of the documents, the same parts for all tokens, and a head for each part.

    (token, segment, prefix, n, most, shortest, keys, lengths, docs, counts, places): n
    documents, by their numbers in the part, sorted; how often the token occurs in each,
    and where, one document behind the other: column << 32 | place. most: the largest
    count; shortest: the least length. The head, of the token HEAD, has keys and lengths of
    all the part's documents in the order of their numbers, that of their keys; no other row
    has them. segment: a number of this call. A token that is in all documents has as many
    rows as there are parts. Of rows with one key one counts. Each text is shuffled once,
    as it is; a part of about BLOCK documents is made of it at once, by one task.
    """
    part = F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int").alias("prefix")
    texts = docs.select(part, F.col(key).cast("string").alias("doc"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"t{i}") for i, c in enumerate(columns)))
    dealt = texts.repartition("prefix").sortWithinPartitions("prefix", "doc")
    made = dealt.select("prefix", "doc", *(tokens(F.col(f"t{i}")).alias(f"t{i}") for i in range(len(columns)))).mapInArrow(_blocks, _BLOCK)
    return made.select("token", F.lit(segment).cast("bigint").alias("segment"), "prefix", "n", "most", "shortest", "keys", "lengths", "docs", "counts", "places")


def indexed(blocks: DataFrame) -> tuple[int, int]:
    """(documents, tokens) of stored postings, as text_lengths() has them of the texts."""
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return tuple(blocks.where(F.col("token") == HEAD).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first())


def _of_words(blocks: DataFrame, key: str, words: list[str], placed: bool) -> DataFrame:
    """(key, length, c0, c1, ...): the documents that have some of the words and how often they have each; placed: where, as w0, w1, ..., too.

    What a part has of the words is put together with its head, so no document is joined.
    """
    held = ["docs", "counts", *["places"] * placed]
    mine = blocks.where(F.col("token").isin(HEAD, *words)).select("token", "segment", "prefix", "keys", "lengths", *held)
    first = lambda c, w: F.first(F.when(F.col("token") == w, F.col(c)), ignorenulls=True)
    parts = mine.groupBy("segment", "prefix").agg(first("keys", HEAD).alias("keys"), first("lengths", HEAD).alias("lengths"), *(first(c, w).alias(f"{c}{i}") for i, w in enumerate(words) for c in held))
    some = F.array_distinct(F.concat(*(F.coalesce(f"docs{i}", F.array().cast("array<int>")) for i in range(len(words)))))
    at = lambda i, doc: (F.array_position(f"docs{i}", doc) - 1).cast("int")
    before = lambda i, k: F.aggregate(F.slice(f"counts{i}", F.lit(1), k), F.lit(0), lambda a, x: a + x)

    def row(doc: Column) -> Column:
        has = lambda i: F.array_contains(f"docs{i}", doc)
        counts = (F.when(has(i), F.get(f"counts{i}", at(i, doc))).alias(f"c{i}") for i in range(len(words)))
        places = (F.when(has(i), F.slice(f"places{i}", before(i, at(i, doc)) + 1, F.get(f"counts{i}", at(i, doc)))).alias(f"w{i}") for i in range(len(words) * placed))
        return F.struct(F.get("keys", doc).alias(key), F.get("lengths", doc).alias("length"), *counts, *places)

    return parts.select(F.explode(F.transform(some, row)).alias("d")).select("d.*")


def text_lengths(docs: DataFrame, columns: list[str]) -> tuple[int, int]:
    """(documents, tokens): what a search has to know of the corpus."""
    total = reduce(lambda a, b: a + b, (F.size(tokens(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns))
    n, length = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n, length


def _weight(f: Column, length: Column, mean: float) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def _idf(docs: int, n: int) -> float:
    return max(log((docs - n + 0.5) / (n + 0.5)), LEAST_IDF)


def ranked(blocks: DataFrame, key: str, phrases: list[list[str]], docs: int, length: int) -> DataFrame:
    """bm25() from stored postings, of which only the query's tokens are read; docs and length: the corpus' documents and tokens."""
    words = sorted({w for p in phrases for w in p})
    if not phrases or not docs:
        return blocks.select(F.lit("").alias(key), F.lit(0.0).alias("rank")).limit(0)
    by_doc = _of_words(blocks, key, words, any(len(p) > 1 for p in phrases))

    def times(phrase: list[str]) -> Column:
        """How often a phrase occurs: the places of its first word that the others follow."""
        if len(phrase) == 1:
            return F.coalesce(f"c{words.index(phrase[0])}", F.lit(0))
        back = lambda w, k: F.transform(F.col(f"w{words.index(w)}"), lambda x: x - k)
        return F.coalesce(F.size(reduce(F.array_intersect, [back(w, k) for k, w in enumerate(phrase)])), F.lit(0))

    counted = by_doc.select(key, "length", *(F.when(reduce(lambda a, b: a & b, (F.col(f"c{words.index(w)}").isNotNull() for w in p)), times(p)).otherwise(0).alias(f"f{i}") for i, p in enumerate(phrases)))
    n = len(phrases)
    having = counted.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)))
    hits = counted.where(reduce(lambda a, b: a & b, (F.col(f"f{i}") > 0 for i in range(n))))
    corpus = hits.join(F.broadcast(having)).withColumn("docs", F.lit(docs)).withColumn("mean", F.lit(length / docs))  # one row
    return corpus.select(key, _rank(n).alias("rank"))


def top(blocks: DataFrame, key: str, phrases: list[list[str]], k: int, docs: int, length: int, first: int = FIRST) -> DataFrame:
    """(key, rank): the k best of ranked(), of equal ones those of the smaller key, from few of the blocks.

    A document's postings are in blocks of one part of one segment. A part that lacks a word has
    no hit; what the others can reach at most follows from their blocks' heads. The most
    promising parts are scored first. Their k-th best is a bound: parts that can't
    reach it are skipped.
    """
    if not docs or any(len(p) != 1 for p in phrases) or not phrases:
        return ranked(blocks, key, phrases, docs, length).orderBy("rank", key).limit(k)
    idfs = _idfs(blocks, phrases, docs)
    if idfs is None:
        return ranked(blocks, key, [], docs, length)
    parts = promising(blocks, phrases, idfs, length / docs)
    best = scored(blocks, key, phrases, idfs, length / docs, parts.orderBy(F.desc("most"), "segment", "prefix").limit(first)).orderBy("rank", key).limit(k).collect()  # k rows
    bound = -best[-1]["rank"] if len(best) == k else 0.0
    return scored(blocks, key, phrases, idfs, length / docs, parts.where(F.col("most") >= bound)).orderBy("rank", key).limit(k)


def _idfs(blocks: DataFrame, phrases: list[list[str]], docs: int) -> list[float] | None:
    """The weight of each word; none if one of them occurs nowhere. A part holds a document once, so its blocks' sizes add up."""
    words = [w for (w,) in phrases]
    known = {r["token"]: r["n"] for r in blocks.where(F.col("token").isin(*words)).groupBy("token").agg(F.sum("n").alias("n")).collect()}  # a row a word
    return [_idf(docs, known[w]) for w in words] if all(w in known for w in words) else None


def promising(blocks: DataFrame, phrases: list[list[str]], idfs: list[float], mean: float) -> DataFrame:
    """(segment, prefix, most): the parts that have all words, and what a document of theirs scores at most."""
    words = [w for (w,) in phrases]
    heads = blocks.where(F.col("token").isin(*words)).select("token", "segment", "prefix", "most", "shortest")
    reach = _weight(F.col("most"), F.col("shortest"), mean)
    each = heads.groupBy("segment", "prefix").agg(*(F.max(F.when(F.col("token") == w, reach)).alias(f"r{i}") for i, w in enumerate(words)))
    total = reduce(lambda a, b: a + b, (idf * F.col(f"r{i}") for i, idf in enumerate(idfs)))
    return each.select("segment", "prefix", (total * _WIDER).alias("most")).where("most is not null")


def scored(blocks: DataFrame, key: str, phrases: list[list[str]], idfs: list[float], mean: float, parts: DataFrame) -> DataFrame:
    """(key, rank) of the hits in some parts."""
    words = [w for (w,) in phrases]
    mine = blocks.where(F.col("token").isin(HEAD, *words)).join(parts.select("segment", "prefix"), ["segment", "prefix"], "left_semi")
    each = _of_words(mine, key, sorted(set(words)), False)
    counted = each.select(key, "length", *(F.col(f"c{sorted(set(words)).index(w)}").alias(f"f{i}") for i, w in enumerate(words)))
    total = reduce(lambda a, b: a + b, (idf * _weight(F.col(f"f{i}"), F.col("length"), mean) for i, idf in enumerate(idfs)))
    return counted.select(key, (-total).alias("rank")).where("rank is not null")


def any_path(hits: DataFrame, paths: DataFrame) -> DataFrame:
    """hits with one active path of each content: the least; or a mark that it has none."""
    at = paths.where("disappeared is null").groupBy("content_hash").agg(F.min("path").alias("path"))
    return hits.join(at, "content_hash", "left").withColumn("path", F.coalesce("path", F.lit("(no current path)")))
