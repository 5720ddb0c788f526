"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols, as many as leave the words of a reduced form few.
If two words are one edit apart, so are their reduced forms, or they are equal. So
the whole one-edit neighbourhood of each reduced word, itself included, is generated and
joined with the reduced words there are; the original strings of those that meet decide.

Cells, the words of one reduced form, may be large all the same. Those of more than CELL words
are not met there: their words, and the words with such a cell in their neighbourhood, go on to
the next alphabet, and at the last of them letters are what they are and each cell has one word.
A pair is taken at the first alphabet at which neither word is in a large cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored
from .components import split_join
from .hashing import mixed

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LENGTH, COUNT, RATIO = 6, 5, 5
#: In one of so many words of a document a letter is left out.
DAMAGE = 199
#: Words of a cell up to which they are compared there.
CELL = 200
#: Alphabets of so many symbols; the first is the least that suits the number of words, the last has each letter apart.
SYMBOLS = (4, 8, 16, 32, 64)
#: Words that a task counts before it sends them on, and hashes of neighbours that it makes at once.
HELD, MADE = 300_000, 1 << 21

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def damaged(word: str, key: int, modulus: int = DAMAGE) -> str:
    """The word without one letter, where the modulus divides the key."""
    at = key % len(word)
    return word if key % modulus else word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """(word, n) of each word of at least `length` letters that occurs `count` times or more.

    damage: leave a letter out of the words of a document whose key, the CRC-32 of
    "<id>:<word>" with a null id as the empty string, it divides.
    """

    def run(batches):
        found: Counter = Counter()

        def flush():
            some = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return some

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer()
                if data is None:
                    continue
                own = Counter(map(re.Match.group, WORD.finditer(data.to_pybytes().lower().decode())))  # of bytes: A-Z only
                if damage:
                    start = zlib.crc32(f"{'' if name is None else name}:".encode())
                    keys = [zlib.crc32(w.encode(), start) for w in own]
                    for word, key in [(w, k) for w, k in zip(own, keys) if k % damage == 0]:
                        n = own.pop(word)
                        found[damaged(word, key, damage)] += n
                found.update(own)
                if len(found) >= HELD:
                    yield flush()
        yield flush()

    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return each.where(F.length("word") >= length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def symbols_of(word: str, symbols: int) -> np.ndarray:
    """The word's letters as symbols 1, 2, ...; 0 symbols leave each letter apart."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points + np.uint64(1) if not symbols else mixed(points) % np.uint64(symbols) + np.uint64(1)


def _alphabet(symbols: int, letters: np.ndarray) -> np.ndarray:
    return np.arange(1, symbols + 1, dtype=np.uint64) if symbols else letters


#: The letters of words, lower-cased, each as its own symbol.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def reduced_hash(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of symbols."""
    return mixed((codes * _powers(codes.shape[1])).sum(1, dtype=np.uint64))


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray):
    """Hashes of the rows' strings of at most one edit, row by row with repeats left out, in pieces: (row, hash).

    codes: rows of one length. A piece holds whole rows, or some positions of one long row.
    """
    rows, length = codes.shape
    powers = _powers(length + 1)
    terms = codes * powers[:length]
    before = np.concatenate((np.zeros((rows, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    whole = before[:, -1:]
    each = 2 * len(alphabet) + 1
    some, width = max(1, MADE // (each * (length + 1))), max(1, MADE // each)
    for at in range(0, rows, some):
        of = slice(at, at + some)
        for lo in range(0, length + 1, width):
            hi = min(length + 1, lo + width)
            last = min(hi, length)
            left, right = before[of, lo:hi], whole[of] - before[of, lo:hi]
            inserted = (left + right * np.uint64(_BASE))[:, :, None] + alphabet * powers[lo:hi, None]
            deleted = before[of, lo:last] + (whole[of] - before[of, lo + 1 : last + 1]) * _INVERSE
            replaced = whole[of][:, :, None] + (alphabet - codes[of, lo:last, None]) * powers[lo:last, None]
            n = inserted.shape[0]
            made = np.sort(mixed(np.concatenate((inserted.reshape(n, -1), deleted, replaced.reshape(n, -1), whole[of]), axis=1)), axis=1)
            new = np.concatenate((np.ones((n, 1), bool), made[:, 1:] != made[:, :-1]), axis=1)
            yield at + np.nonzero(new)[0], made[new]


def _by_length(words: list[str], symbols: int):
    """(indices, rows of symbols) of the words of each length."""
    sizes = np.array([len(w) for w in words], np.int64)
    for length in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == length)
        yield of, symbols_of("".join(words[i] for i in of), symbols).reshape(len(of), length)


def _cells(words: DataFrame, symbols: int) -> DataFrame:
    """(key, id, word, n, large): the reduced form of each word."""

    def run(batches):
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.uint64)
            for of, codes in _by_length(batch.column(1).to_pylist(), symbols):
                keys[of] = reduced_hash(codes)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns], ["key", "id", "word", "n", "large"])

    return words.select("id", "word", "n", "large").mapInArrow(run, "key long, id long, word string, n long, large int")


def _neighbours(words: DataFrame, symbols: int) -> DataFrame:
    """(key, id): every reduced form within one edit of that of each word."""

    def run(batches):
        for batch in batches:
            ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for of, codes in _by_length(words, symbols):
                for row, key in neighbourhood(codes, _alphabet(symbols, LETTERS)):
                    for lo in range(0, len(row), 1 << 18):
                        part = slice(lo, lo + (1 << 18))
                        yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(ids[of[row[part]]])], ["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def near_words(words: DataFrame, cell: int | None = None, symbols: tuple[int, ...] | None = None) -> DataFrame:
    """(id, other, word, n): for each word each of its near words, in both directions.

    words: (id, word, n), stored, each word once. symbols: the alphabets to be taken one after
    the other; by default the first that has as many reduced forms of eight letters as
    16 times the words, and the letters themselves.
    """
    cell = CELL if cell is None else cell
    if symbols is None:
        total = words.count()
        least = next((s for s in SYMBOLS if s**8 >= 16 * total), SYMBOLS[-1])
        symbols = (least, min(64, 4 * least), 0)
    out, at = None, words.withColumn("large", F.lit(0))
    for level, size in enumerate(symbols):
        cells = stored(_cells(at, size), "cells")
        large = None
        if size:
            large = stored(cells.groupBy("key").agg(F.count(F.lit(1)).alias("in_cell")).where(F.col("in_cell") > cell).select("key"), "large")
            large = None if large.isEmpty() else large
        small = cells if large is None else cells.join(large, "key", "left_anti")
        probes = _neighbours(small, size)
        met = probes.join(small.hint("shuffle_hash").select("key", F.col("id").alias("other"), F.col("word").alias("their"), F.col("n").alias("their_n"), F.col("large").alias("their_large")), "key")
        ends = met.where("id <> other").join(small.select("id", "word", "large"), "id")
        # a pair that had both words in small cells before was taken there
        new = F.col("large").bitwiseOR(F.col("their_large")) == (1 << level) - 1
        near = ends.where(new & (F.levenshtein("word", "their", 1) == 1)).select("id", "other", F.col("their").alias("word"), F.col("their_n").alias("n"))
        near = stored(near.dropDuplicates(["id", "other"]), "near")
        out = near if out is None else out.unionByName(near)
        if large is None:
            break
        beside = _neighbours(cells, size).join(large, "key", "left_semi").select("id").distinct()
        inside = cells.join(large, "key", "left_semi").select("id", F.lit(1 << level).alias("mark"))
        at = stored(cells.join(beside, "id", "left_semi").join(inside, "id", "left").select("id", "word", "n", F.col("large").bitwiseOR(F.coalesce("mark", F.lit(0))).alias("large")), "words")
    return out


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): what following forms ends at. Counts grow along forms, so there are no rings."""
    roots = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ends = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        if ends.where("further is not null").isEmpty():
            return roots
        total = roots.count()
        roots = stored(split_join(roots, ends, "root", total).select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(words: DataFrame, ratio: int = RATIO, cell: int | None = None, symbols: tuple[int, ...] | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of the words (word, n).

    n_near: how many of them differ by exactly one inserted, deleted or replaced letter.
    form: the one of the largest n, of equal ones the smallest in code-point order, if its n is at
    least ratio times the word's; else null, as is form_n. root: the last word that
    forms lead to, the word itself if it has none.

    Words have to be letters of count_words(); a null word is left out, a repeated one
    counts once with the sum of its n. Very long words are compared whole. Other columns
    are left aside; an empty table gives an empty result.
    """
    each = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    named = stored(each.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    near = near_words(named, cell, symbols)
    best = near.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("word"))).alias("best"))
    fits = -F.col("best.minus") >= ratio * F.col("n")
    placed = stored(
        named.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")), "forms"
    )
    roots = _roots(placed.where("form is not null"))
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(documents(spark, sf_dir), damage=DAMAGE))


ORACLE = r"""
WITH table_crc AS (
  SELECT list(v ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(generate_series(0, 7), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, b) AS v
    FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS b))),
run AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL),
keyed AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM run),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_transform(generate_series(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
    lambda a, v: xor(a // 256, crc[1 + (xor(a, v) % 256)]), 4294967295)) AS h
  FROM keyed, table_crc),
word AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % len(w))::BIGINT) || substr(w, (h % len(w))::BIGINT + 2) ELSE w END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING len(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, len(word))) AS p FROM word)),
pair AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN word w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN word w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM pair GROUP BY word),
placed AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM word w LEFT JOIN best USING (word)),
followed AS (
  WITH RECURSIVE step AS (
    SELECT word, word AS root, 0 AS depth FROM placed
    UNION ALL SELECT s.word, p.form, depth + 1 FROM step s JOIN placed p ON p.word = s.root WHERE p.form IS NOT NULL)
  SELECT word, arg_max(root, depth) AS root FROM step GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM placed JOIN followed USING (word)
"""
