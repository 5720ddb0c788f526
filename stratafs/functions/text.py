"""Column expressions over file contents: frontmatter, headings, titles, summaries, tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_CHARS, SNIFF_BYTES = 200, 8192
_HEADING = r"^(#{1,6})(?: +(.*))?$"
TOKEN = r"[\p{L}\p{N}]+"


def _fence(mark: str) -> str:
    return rf"(?s)\A{mark}\n(.*?)\n{mark}(?:\n|\z)(.*)"


def frontmatter(text: Column) -> Column:
    """What stands between the opening and closing lines of --- or +++, or null."""
    dashes, pluses = _fence("---"), _fence(r"\+\+\+")
    return F.when(text.rlike(dashes), F.regexp_extract(text, dashes, 1)).when(text.rlike(pluses), F.regexp_extract(text, pluses, 1))


def body(text: Column) -> Column:
    dashes, pluses = _fence("---"), _fence(r"\+\+\+")
    return F.when(text.rlike(dashes), F.regexp_extract(text, dashes, 2)).when(text.rlike(pluses), F.regexp_extract(text, pluses, 2)).otherwise(text)


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def is_minor_change(old_hash: Column, new_hash: Column, old_body: Column, new_body: Column) -> Column:
    return (old_hash != new_hash) & (old_body == new_body)


def is_binary(content: Column) -> Column:
    """Whether a zero byte is among the first bytes."""
    return F.contains(F.hex(F.substring(content.cast("binary"), 1, SNIFF_BYTES)), F.lit("00")) & F.exists(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(SNIFF_BYTES), F.octet_length(content.cast("binary"))) - 1)),
        lambda i: F.hex(F.substring(content.cast("binary"), i + 1, F.lit(1))) == "00",
    )


def lines(text: Column) -> Column:
    """Lines without their ends; a last newline begins no line."""
    got = F.split(text, "\r?\n")
    return F.when(F.element_at(got, -1) == "", F.slice(got, F.lit(1), F.size(got) - 1)).otherwise(got)


def headings(text: Column) -> Column:
    """(heading, level, line) of each ATX heading of a body, by line from 1."""
    numbered = F.transform(lines(text), lambda x, i: F.struct(F.rtrim(x).alias("x"), (i + 1).alias("line")))
    return F.transform(
        F.filter(numbered, lambda n: n["x"].rlike(_HEADING)),
        lambda n: F.struct(
            F.regexp_extract(n["x"], _HEADING, 2).alias("heading"), F.length(F.regexp_extract(n["x"], _HEADING, 1)).alias("level"), n["line"].alias("line")
        ),
    )


def topics(text: Column) -> Column:
    return F.array_distinct(F.transform(headings(text), lambda h: F.lower(h["heading"])))


def markdown_title(text: Column) -> Column:
    return F.get(F.filter(headings(text), lambda h: h["level"] == 1), 0)["heading"]


def markdown_summary(text: Column) -> Column:
    """The first paragraph that no heading cuts short, its lines joined by spaces, of 200 characters at most."""
    shape = "struct<open:string,found:string>"
    start = F.struct(F.lit("").alias("open"), F.lit(None).cast("string").alias("found"))

    def step(got: Column, raw: Column) -> Column:
        line = F.rtrim(raw)
        longer = F.when(got["open"] == "", line).otherwise(F.concat(got["open"], F.lit(" "), line))
        closed = F.when(F.trim(got["open"]) != "", got["open"])
        return (
            F.when(got["found"].isNotNull(), got)
            .when(line.rlike(_HEADING), F.struct(F.lit("").alias("open"), F.lit(None).cast("string").alias("found")).cast(shape))
            .when(line == "", F.struct(F.lit("").alias("open"), closed.alias("found")).cast(shape))
            .otherwise(F.struct(longer.alias("open"), F.lit(None).cast("string").alias("found")).cast(shape))
        )

    end = F.aggregate(lines(text), start.cast(shape), step, lambda got: F.coalesce(got["found"], F.when(F.trim(got["open"]) != "", got["open"])))
    return F.substring(F.trim(end), 1, SUMMARY_CHARS)


def text_summary(text: Column) -> Column:
    """The first line that isn't blank, trimmed, of 200 characters at most."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.substring(F.get(F.filter(trimmed, lambda x: x != ""), 0), 1, SUMMARY_CHARS)


def truncated(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes that ends between characters."""
    raw = text.cast("binary")
    lead = lambda n: ~F.substring(F.hex(F.substring(raw, n + 1, F.lit(1))), 1, 1).isin("8", "9", "A", "B")
    cut = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.lit(most) - k), lead), 0)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def _folding() -> tuple[str, str]:
    """Small letters of the Latin blocks that are a base letter and marks, and their base letters."""
    pairs = [(chr(c), d[0]) for c in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].islower() and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASES = _folding()
FOLD = str.maketrans(ACCENTED, BASES)


def folded(text: Column) -> Column:
    """text in lower case and without accents."""
    low = F.lower(text)
    return F.when(low.rlike("[\u00df-\u024f\u1e00-\u1eff]"), F.translate(low, ACCENTED, BASES)).otherwise(low)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))
