"""Personal data: patterns, and information-theoretic sanitisation of what reveals them.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Co-occurrence over
the whole corpus then tells how far a term that stands near such an entity reveals it:
P(e|t) is the share of the term's occurrences that are near the entity, taken as low as the
number of distinct texts that show it allows for, and -log2 P(e|t) the bits that stay
hidden from who knows the term. Terms that leave no more bits than a threshold are removed,
or generalised to a class of words, wherever they occur. One text alone flags no term.

All of it is made of SQL expressions, joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, stored

#: Kinds of base spans in their order, and their patterns. Possessive repetition and the
#: look-behinds change no match; they keep long runs from being scanned again and again.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KINDS = tuple(k for k, _ in PATTERNS)
#: Characters without which a kind can't occur, to spare most lines the pattern.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALUE = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

TERM = r"[\p{L}\p{M}\p{N}_]+"
#: Words on each side of an entity that are its context.
NEAR_WORDS = 8
#: Code points on a side of an entity that are searched for them first; where they hold too
#: few words WIDER times as many are searched, and so on, the last time all there are.
NEAR_CHARS, WIDER, TIMES = 160, 32, 3
#: The square of the standard deviations by which a share is taken lower: where all of d texts
#: with a term show the entity, the lower end of Wilson's interval is d / (d + DOUBT).
DOUBT = 4
#: Bits left to hide up to which a term is removed, and up to which it is generalised.
REMOVE_BITS, GENERALISE_BITS = 1.0, 2.0
#: Flagged terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 50_000
#: The order of fields is that in which spans are sorted.
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def before_each(values: Column, merge, kind: str = "int") -> Column:
    """For each number, the merge (a sum or a maximum) of 0 and those before it; in blocks, so that long arrays stay cheap."""
    block, zero = 128, F.lit(0).cast(kind)

    def running(x: Column, first: Column) -> Column:
        return F.aggregate(
            x, F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda got, n: F.struct(merge(got["at"], n).alias("at"), F.array_append(got["out"], got["at"]).alias("out")), lambda got: got["out"],
        )

    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    return let(
        blocks,
        lambda x: let(
            running(F.transform(x, lambda of: F.aggregate(of, zero, merge)), zero),
            lambda base: F.flatten(F.transform(x, lambda of, i: running(of, F.get(base, i)))),
        ),
    )


def prefix_sums(lengths: Column, kind: str = "int") -> Column:
    """For each element, the sum of those before it."""
    return before_each(lengths, lambda a, b: a + b, kind)


def located(text: Column, pattern: str) -> Column:
    """(value, start) of each match of a pattern, leftmost and without overlaps, in code points."""
    def at(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        return let(
            sizes,
            lambda size: let(
                prefix_sums(size),
                lambda before: F.transform(
                    matches,
                    lambda m, i: F.struct(m.alias("value"), (F.get(before, i) + F.get(size, i) - F.length(m)).cast("int").alias("start")),
                ),
            ),
        )

    none = F.array().cast("array<struct<value:string,start:int>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) > 0, at(m)).otherwise(none))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return value.rlike(IP_VALUE) if kind == "ip" else F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans (start, kind, end, value) of a text by start, then kind; kind is its place in KINDS."""

    def of_kind(k: int, kind: str, pattern: str) -> Column:
        valid = F.filter(located(text, pattern), lambda m: _valid(kind, m["value"]))
        spans = F.transform(
            valid,
            lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")),
        )
        return F.when(F.contains(text, F.lit(HINT[kind])), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return F.array_sort(F.concat(*(of_kind(k, kind, pattern) for k, (kind, pattern) in enumerate(PATTERNS))))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def contexts(docs: DataFrame) -> DataFrame:
    """(rid, copy, entity, term, n): how often each term stands near each entity in each row.

    docs: (rid, text). Near are the words on both sides of the entity, across the ends of
    lines; a word near several mentions of one entity counts once. An entity is its kind
    and its value, in lower case or digits alone; copy is one number for equal texts.
    """
    text = F.col("text")
    size = F.length(text)

    # several searches side by side, of which the first that holds enough words is taken
    def left(start: Column) -> Column:
        """The last words before an entity, as (value, start)."""

        def within(first: Column) -> Column:
            # a word that the cut may have split is left out
            whole = F.filter(located(F.substring(text, first + 1, start - first), TERM), lambda m: (first == 0) | (m["start"] > 0))
            last = lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - NEAR_WORDS + 1), F.lit(NEAR_WORDS))
            placed = lambda m: F.struct(m["value"].alias("value"), (first + m["start"]).alias("start"))
            return let(whole, lambda w: F.when((F.size(w) >= NEAR_WORDS) | (first == 0), F.transform(last(w), placed)))

        return F.coalesce(*(within(F.greatest(F.lit(0), start - NEAR_CHARS * WIDER**k)) for k in range(TIMES)), within(F.lit(0)))

    def right(end: Column) -> Column:
        """The first words behind an entity, as (value, start)."""

        def within(n: Column) -> Column:
            whole = F.filter(located(F.substring(text, end + 1, n), TERM), lambda m: (end + n >= size) | (m["start"] + F.length(m["value"]) < n))
            placed = lambda m: F.struct(m["value"].alias("value"), (end + m["start"]).alias("start"))
            return let(whole, lambda w: F.when((F.size(w) >= NEAR_WORDS) | (end + n >= size), F.transform(F.slice(w, 1, NEAR_WORDS), placed)))

        return F.coalesce(*(within(F.lit(NEAR_CHARS * WIDER**k)) for k in range(TIMES)), within(size))

    def near(s: Column) -> Column:
        value = F.when(s["kind"] == 0, F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], "[^0-9.]", ""))
        entity = F.concat_ws(":", s["kind"].cast("string"), value)
        # strings, as Spark tells them apart by hash and structs one by one; no part holds a space
        return F.transform(F.concat(left(s["start"]), right(s["end"])), lambda m: F.concat_ws(" ", entity, F.lower(m["value"]), m["start"].cast("string")))

    rows = docs.where(text.rlike("@|[0-9]")).select("rid", F.xxhash64("text").alias("copy"), "text", base_spans(text).alias("spans")).where(F.size("spans") > 0)
    found = rows.select("rid", "copy", F.explode(F.array_distinct(F.flatten(F.transform("spans", near)))).alias("of"))
    part = F.split("of", " ")
    return found.select("rid", "copy", part[0].alias("entity"), part[1].alias("term")).groupBy("rid", "copy", "entity", "term").agg(F.count(F.lit(1)).alias("n"))


def revealing_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flagged, places): terms with the action to take, and (rid, terms) of the rows that hold any.

    docs: (rid, text). A term's occurrences, near an entity and in all, are counted over
    the whole corpus. With d distinct texts behind it, the share near an entity counts
    d / (d + DOUBT) of what it is: always near it in one text leaves 2.3 bits, in two 1.6,
    in three 1.2, in four 1, and copies of a text add nothing. Words are counted in the tasks that
    read them, so that a word travels once a task and not once an occurrence.
    """
    near = stored(contexts(docs), "near")
    by_entity = near.groupBy("entity", "term", "copy").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    best = by_entity.groupBy("term").agg(F.max(F.col("n") * F.col("texts") / (F.col("texts") + DOUBT)).alias("n"))
    totals = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    bits = F.round(-F.log2(F.col("n") / F.greatest(F.col("n"), F.col("total"))), 9)
    flagged = stored(
        best.join(totals, "term").select("term", bits.alias("bits_left")).where(F.col("bits_left") <= GENERALISE_BITS)
        .withColumn("action", F.when(F.col("bits_left") <= REMOVE_BITS, "remove").otherwise("generalise")),
        "terms",
    )
    few = flagged.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    terms = flagged.select("term", "action")
    rows = docs.select("rid", F.explode(_terms(F.col("text"))).alias("term")).join(F.broadcast(terms) if few else terms, "term").distinct()
    return flagged, rows.groupBy("rid").agg(F.collect_list(F.struct("term", "action")).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, spans, sanitised) of each row of docs, and the columns named in keep as the struct `row`.

    spans: (start, end, kind, value, action) by start, then kind, in code points; a term's
    kind is "term". sanitised: the text with base spans as [EMAIL], [IP], [CARD] and
    [PHONE], terms to generalise as their class, and terms to remove left out;
    where spans overlap, the first one's mark stands for all.

    A term is a run of letters, marks, digits and underscores of any length. Near an
    entity are NEAR_WORDS terms on each side, however far they are. Spans of one start are
    ordered by kind; of entities that a term reveals alike no choice is made, as the bits
    alone decide. Null and empty texts have no spans; very long ones are searched whole; a
    null id stays null; equal rows each give a row and count as occurrences each; other
    columns never meet those made here; an empty table gives an empty result.
    """
    kept = [F.struct(*(F.col(c) for c in keep)).alias("row")] if keep else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.xxhash64(F.col(id_col), text).alias("rid"), F.col(id_col).alias("id"), text.alias("text"), *kept)
    _, places = revealing_terms(held.select("rid", "text"))
    joined = held.join(places, "rid", "left")
    named = F.transform(
        base_spans(F.col("text")),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("order"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"),
                           s["value"].alias("value"), F.lit("generalise").alias("action")),
    )

    def term_spans(terms: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(terms))).cast("int")
        bucket = lambda t: F.pmod(F.hash(t), n)
        table = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(terms, lambda t: bucket(t["term"]) == b))

        def spans(of: Column) -> Column:
            action = lambda v: F.get(F.filter(F.get(of, bucket(v)), lambda t: t["term"] == v), 0)["action"]
            found = F.transform(
                located(F.col("text"), TERM),
                lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("order"), (m["start"] + F.length(m["value"])).cast("int").alias("end"),
                                   F.lit("term").alias("kind"), m["value"].alias("value"), action(F.lower(m["value"])).alias("action")),
            )
            return F.filter(found, lambda s: s["action"].isNotNull())

        return let(table, spans)

    shape = "array<struct<start:int,order:int,end:int,kind:string,value:string,action:string>>"
    terms = F.when(F.col("terms").isNotNull(), term_spans(F.col("terms")).cast(shape)).otherwise(F.array().cast(shape))
    spanned = joined.select("id", "text", F.array_sort(F.concat(named.cast(shape), terms)).alias("spans"), *(["row"] if keep else []))
    return spanned.select(F.col("id").alias(id_col), "spans", redacted(F.col("text"), F.col("spans")).alias("sanitised"), *(["row"] if keep else []))


def word_class(term: Column) -> Column:
    """A coarser class for a term: what sort of word or number it is."""
    return (
        F.when(term.rlike("^(?:19|20)[0-9]{2}$"), F.lit("[YEAR]"))
        .when(term.rlike("^[0-9]+$"), F.concat(F.lit("[NUMBER OF "), F.length(term).cast("string"), F.lit(" DIGITS]")))
        .when(term.rlike("[0-9_]"), F.lit("[CODE]")).when(term.rlike(r"^\p{Lu}[\p{Lu}\p{M}]+$"), F.lit("[ACRONYM]"))
        .when(term.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
    )


def redacted(text: Column, spans: Column) -> Column:
    """text with its sorted spans replaced."""
    mark = lambda s: (
        F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        .when(s["action"] == "remove", F.lit(""))
        .otherwise(word_class(s["value"]))
    )

    def built(covered: Column) -> Column:
        """covered: for each span, up to where the spans before it reach."""
        pieces = F.zip_with(
            spans, covered,
            lambda s, at: F.when(
                s["end"] > at,
                F.concat(F.substring(text, at + 1, F.greatest(F.lit(0), s["start"] - at)), F.when(s["start"] >= at, mark(s)).otherwise(F.lit(""))),
            ).otherwise(F.lit("")),
        )
        end = F.greatest(F.element_at(covered, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    return F.when(F.size(spans) == 0, text).otherwise(let(before_each(ends, lambda a, b: F.greatest(a, b)), built))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sanitise(documents(spark, sf_dir))

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return made.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "term")).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


#: DuckDB SQL for op3_pii, term spans included.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(k, kind, p) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([ -]?[0-9])+'), (3, 'phone', '\+[0-9][ ().0-9-]+[0-9]')),
found AS (SELECT doc_id, t, k, kind, regexp_extract_all(t, p) AS vs, string_split_regex(t, p) AS gaps FROM d, kinds),
placed AS (
  SELECT doc_id, t, k, kind, vs[i] AS v, (list_sum([len(x) for x in gaps[1:i]]) + coalesce(list_sum([len(x) for x in vs[1:i - 1]]), 0))::BIGINT AS s
  FROM (SELECT *, unnest(generate_series(1, len(vs))) AS i FROM found WHERE len(vs) > 0)),
digits AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM placed),
base AS (
  SELECT doc_id, t, k, kind, v, s, s + len(v) AS e FROM digits WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and([ltrim(x, '0') = '' OR (len(ltrim(x, '0')) <= 3 AND ltrim(x, '0')::INT <= 255) for x in string_split(v, '.')])
    WHEN 'phone' THEN len(g) BETWEEN 9 AND 15
    ELSE len(g) BETWEEN 12 AND 19 AND list_sum([
      CASE WHEN j % 2 = 0 THEN substr(g, len(g) - j, 1)::INT WHEN substr(g, len(g) - j, 1)::INT > 4 THEN 2 * substr(g, len(g) - j, 1)::INT - 9
      ELSE 2 * substr(g, len(g) - j, 1)::INT END for j in generate_series(0, len(g) - 1)]) % 10 = 0 END),
sides AS (
  SELECT doc_id, t, concat(k, ':', CASE WHEN k = 0 THEN lower(v) ELSE regexp_replace(v, '[^0-9.]', '', 'g') END) AS entity, s, e, left(t, s) AS a, substr(t, e + 1) AS b FROM base),
words AS (
  SELECT doc_id, t, entity, 0 AS off, regexp_extract_all(a, '[\p{L}\p{M}\p{N}_]+') AS ws, string_split_regex(a, '[\p{L}\p{M}\p{N}_]+') AS gaps, true AS before FROM sides
  UNION ALL SELECT doc_id, t, entity, e, regexp_extract_all(b, '[\p{L}\p{M}\p{N}_]+'), string_split_regex(b, '[\p{L}\p{M}\p{N}_]+'), false FROM sides),
near AS (
  SELECT DISTINCT doc_id, t, entity, lower(ws[i]) AS term, off + list_sum([len(x) for x in gaps[1:i]]) + coalesce(list_sum([len(x) for x in ws[1:i - 1]]), 0) AS p
  FROM (SELECT *, unnest(generate_series(CASE WHEN before THEN greatest(1, len(ws) - 7) ELSE 1 END, CASE WHEN before THEN len(ws) ELSE least(8, len(ws)) END)) AS i
        FROM words WHERE len(ws) > 0)),
pairs AS (SELECT entity, term, count(*) AS n, count(DISTINCT t) AS texts FROM near GROUP BY entity, term),
best AS (SELECT term, max(n * texts / (texts + 4)) AS n FROM pairs GROUP BY term),
totals AS (SELECT term, count(*) AS total FROM (SELECT unnest(regexp_extract_all(lower(t), '[\p{L}\p{M}\p{N}_]+')) AS term FROM d) GROUP BY term),
flagged AS (SELECT term FROM best JOIN totals USING (term) WHERE round(-log2(n / greatest(n, total)), 9) <= 2.0),
every AS (SELECT doc_id, regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]+') AS ws, string_split_regex(t, '[\p{L}\p{M}\p{N}_]+') AS gaps FROM d),
hits AS (
  SELECT doc_id, ws, gaps, i FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM every WHERE len(ws) > 0) WHERE lower(ws[i]) IN (SELECT term FROM flagged)),
spans AS (
  SELECT doc_id, kind, k, s, e FROM base
  UNION ALL SELECT doc_id, 'term', 4, s, s + n FROM (
    SELECT doc_id, (list_sum([len(x) for x in gaps[1:i]]) + coalesce(list_sum([len(x) for x in ws[1:i - 1]]), 0))::BIGINT AS s, len(ws[i]) AS n FROM hits)),
shown AS (
  SELECT doc_id, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) AS spans, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) FILTER (WHERE k < 4) AS base,
    count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN shown USING (doc_id)
"""
