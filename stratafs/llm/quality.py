"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a row's failures are bits of one number and its
measurements are kept beside them. Versioned policies are masks over the bits, so
applying or comparing policies reads the ledger and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_CHARS, documents, let, words_of

#: Words of a window whose repetition counts.
WINDOW = 8
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Rules by bit: a rule's name, and when it fails, over the columns of measure().
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "10 * word_chars < 15 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version: the bits that reject a row.
POLICIES: dict[str, int] = {
    "2024-base": BASE,
    "2025-text": BASE | BIT["short_words"] | BIT["long_words"] | BIT["symbols"] | BIT["repeated_lines"],
}
CURRENT = "2025-text"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that are found twice or more among the array's windows.

    Windows are compared by a chained 64-bit hash of their words. Only rows with an
    equal pair of hashes are sorted.
    """

    def of(hashes: Column) -> Column:
        def covered(ordered: Column) -> Column:
            again = F.filter(
                ordered,
                lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
            )
            places = F.array_sort(F.transform(again, lambda x: x["i"]))
            return let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window)))),
                    F.lit(0).cast("long"),
                    lambda total, n: total + n,
                ),
            )

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, covered)).otherwise(F.lit(0).cast("long"))

    starts = F.sequence(F.lit(0), F.size(words) - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window))))
    return F.when(F.size(words) >= window, let(hashes, of)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one struct column `measured` that holds what the rules look at.

    A null text is an empty one and measures 0 throughout.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0)
    measured = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.withColumn("measured", F.struct(
        measured.alias("w"), of_lines.alias("l"),
        F.length(F.translate(text, GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, measurements, fail_bits) of each row of docs, and the columns named in keep.

    Null and empty texts have no words and fail few_words; a null id stays null; equal
    rows each give a row; an empty table gives an empty result. Columns of docs that
    aren't named never meet those of the ledger; kept ones follow as the struct `row`.
    """
    kept = [F.struct(*(F.col(c) for c in keep)).alias("row")] if keep else []
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept)
    m = measure(source, "text").select(
        F.col("id").alias(id_col) if id_col != "measured" else F.col("id"),
        "measured.w.n_words", "measured.word_chars", "measured.n_symbols", "measured.l.n_dup_lines", "measured.w.n_repeat_words",
        "measured.l.n_lines", *(["row"] if keep else []),
    )
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return m.withColumn("fail_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with `kept`: no bit of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many rows fail it, and how many are rejected by it alone.

    The ledger is first counted by its bits, of which there are few combinations.
    """
    mask = POLICIES[version]
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask))
    return (
        by_bits.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        )
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(documents(spark, sf_dir)))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "fail_bits",
    )


ORACLE = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS l
  FROM documents),
counted AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n_words, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols
  FROM split),
windows AS (
  SELECT doc_id, s AS start, array_to_string(w[s:s + 7], ' ') AS words
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS s FROM counted WHERE len(w) >= 8)),
repeated AS (SELECT doc_id, start FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, words) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT start + k)::BIGINT AS n FROM repeated, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY doc_id),
measured AS (SELECT c.*, coalesce(v.n, 0)::BIGINT AS n_repeat_words FROM counted c LEFT JOIN covered v USING (doc_id)),
judged AS (
  SELECT *, ((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * word_chars < 15 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 40 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END))::BIGINT AS fail_bits
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM judged
"""
