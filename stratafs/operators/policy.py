"""Ignore rules: parsing, matching, layers, and the tier of whole trees of paths.

Default and user rules are few and small; they are parsed on the driver and become regular
expressions in Column expressions, so classifying a path needs no Python on the
executors. The ignore files of many directories are rows that paths are joined with.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent, proper_ancestors
from ..sources.scratch import written
from .reports import under

INDEXED, CATALOGED, IGNORED = 0, 1, 2
TIERS = ("indexed", "cataloged", "ignored")

#: What is ignored or cataloged unless rules say otherwise.
DEFAULTS = """
.git/
*.swp
*.tmp
*~
*.pyc
.env
.env.*
.envrc
*.pem
*.key
*.pfx
id_rsa*
*.kdbx
secrets.*
credentials*
.aws/
.gnupg/
.ssh/
**/cookies*
**/Cookies*
**/cookies.sqlite*
**/.config/google-chrome/
**/.config/chromium/
**/.config/BraveSoftware/
**/.config/vivaldi/
**/.zen/*/
**/.mozilla/firefox/*/
[catalog]
**/.rustup/
**/.rustup/**
**/node_modules/
**/target/
**/.flutter/
**/__pycache__/
**/.cache/
**/.local/share/Trash/
**/build/
**/.gradle/
**/.dart_tool/
**/.dart-tool/
**/.dart-tool/**
.yay/
[no-embed]
**/*.lic
**/license-keys/
**/signed-manifests/
"""


#: The two headers that ignore files know.
SECTIONS = {"[catalog]": "cataloged", "[no-embed]": "none"}


@dataclass(frozen=True)
class Rule:
    regex: str  # over the path relative to the rule's directory, without a leading slash
    negated: bool
    dirs_only: bool
    source: str


@dataclass
class Rules:
    """The rules of one ignore file, which hold below base."""

    base: str = "/"
    ignored: list[Rule] = field(default_factory=list)
    cataloged: list[Rule] = field(default_factory=list)


def _segment(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_rule(line: str) -> Rule | None:
    """One line of an ignore file, with the meaning it has in a .gitignore; None for comments and blanks."""
    text = line.strip() + (" " if line.rstrip("\r\n").endswith("\\ ") else "")
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    if text.startswith("~/"):
        text = text[1:]
    text = text[1:] if text.startswith(("\\!", "\\#")) else text
    dirs_only = text.endswith("/")
    text = text.rstrip("/") if dirs_only else text
    anchored = "/" in text
    parts = text.lstrip("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    return Rule(f"^{out}$", negated, dirs_only, line) if text else None


def parse_rules(text: str, base: str = "/") -> Rules:
    """Sections: rules before any are ignored ones, then [catalog]; those of [no-embed] are read and left aside. Other brackets are globs."""
    rules, section = Rules(base.rstrip("/") or "/"), "ignored"
    for line in text.splitlines():
        if line.strip() in SECTIONS:
            section = SECTIONS[line.strip()]
        elif section != "none" and (rule := compile_rule(line)):
            getattr(rules, section).append(rule)
    return rules


def default_rules(base: str = "/") -> Rules:
    return parse_rules(DEFAULTS, base)


# ---- on the driver, for single paths

def _verdict(rules: list[Rule], relative: str, is_dir: bool) -> bool | None:
    """True: matched; False: whitelisted; None: neither. The last rule that matches decides."""
    for rule in reversed(rules):
        if (is_dir or not rule.dirs_only) and re.match(rule.regex, relative, re.S):
            return not rule.negated
    return None


def classify_one(layers: Iterable[Rules], path: str, is_dir: bool) -> int:
    """The tier that layers give a path itself, the deepest of them first."""
    for rules in sorted(layers, key=lambda r: -len(r.base)):
        prefix = rules.base.rstrip("/") + "/"
        if path.startswith(prefix):
            relative = path[len(prefix) :]
            if _verdict(rules.ignored, relative, is_dir):
                return IGNORED
            if _verdict(rules.cataloged, relative, is_dir):
                return CATALOGED
    return INDEXED


def classify_tree(layers: Iterable[Rules], path: str, is_dir: bool) -> int:
    """The tier of a path with all directories above it: the most restrictive of them."""
    layers = list(layers)
    parts = path.split("/")
    above = ["/".join(parts[:n]) for n in range(2, len(parts))]
    return max([classify_one(layers, d, True) for d in above] + [classify_one(layers, path, is_dir)])


# ---- as Column expressions, for tables of paths

def _fires(rules: list[Rule], relative: Column, is_dir: Column) -> Column:
    """True where the last rule that matches isn't a negation."""
    out = F.lit(False)
    for rule in rules:
        hit = relative.rlike("(?s)" + rule.regex)
        out = F.when(hit & is_dir if rule.dirs_only else hit, F.lit(not rule.negated)).otherwise(out)
    return out


def tier(layers: Iterable[Rules], path: Column, is_dir: Column) -> Column:
    """classify_one() of each row."""
    out = F.lit(INDEXED)
    for rules in sorted(layers, key=lambda r: len(r.base)):
        prefix = rules.base.rstrip("/") + "/"
        below = path.startswith(prefix)
        relative = F.substring(path, len(prefix) + 1, 1 << 30)
        out = (
            F.when(below & _fires(rules.ignored, relative, is_dir), F.lit(IGNORED))
            .when(below & _fires(rules.cataloged, relative, is_dir), F.lit(CATALOGED))
            .otherwise(out)
        )
    return out


def tree_tier(layers: Iterable[Rules], path: Column, is_dir: Column | None = None) -> Column:
    """classify_tree() of each row; rows are files unless is_dir says otherwise."""
    layers = list(layers)
    own = tier(layers, path, F.lit(False) if is_dir is None else is_dir)
    above = F.transform(proper_ancestors(path), lambda d: tier(layers, d, F.lit(True)))
    return F.greatest(own, F.coalesce(F.array_max(above), F.lit(INDEXED)))


def combined(*tiers: Column) -> Column:
    """The most restrictive of several verdicts."""
    return reduce(F.greatest, tiers)


def tier_name(t: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), t + 1)


# ---- as rows, for ignore files of many directories

RULE_ROWS = "base string, cataloged boolean, place int, regex string, negated boolean, dirs_only boolean"


def rule_rows(files: DataFrame) -> DataFrame:
    """(base, cataloged, place, regex, negated, dirs_only): the rules of ignore files (base, text), by their place in the section."""

    def run(batches):
        for batch in batches:
            rows = []
            for base, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rules = parse_rules(text or "", base)
                for cataloged, some in ((False, rules.ignored), (True, rules.cataloged)):
                    rows += [(rules.base, cataloged, i, r.regex, r.negated, r.dirs_only) for i, r in enumerate(some)]
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["base", "cataloged", "place", "regex", "negated", "dirs_only"])

    return files.where("base is not null").select("base", "text").mapInArrow(run, RULE_ROWS)


def _own_tiers(entries: DataFrame, rules: DataFrame, defaults: list[Rules]) -> DataFrame:
    """(path, is_dir, tier): what the deepest layer that fires says of each entry itself, the default layers if none of the rows does.

    The directories that have rules above an entry are found for each directory once, and
    meet the entries by their parent.
    """
    parents = entries.select(parent(F.col("path")).alias("dir")).distinct()
    bases = rules.select(F.col("base").alias("above")).distinct()
    above = F.filter(F.concat(proper_ancestors(F.col("dir")), F.array("dir", F.lit("/"))), lambda d: d != "")
    layers = parents.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(bases, "above")
    met = entries.withColumn("dir", parent(F.col("path"))).join(layers, "dir").join(rules, F.col("above") == F.col("base"))
    below = F.substring(F.col("path"), F.when(F.col("base") == "/", 2).otherwise(F.length("base") + 2), F.lit(1 << 30))
    hit = F.call_function("regexp_like", below, F.concat(F.lit("(?s)"), F.col("regex"))) & (F.col("is_dir") | ~F.col("dirs_only"))
    by_section = met.where(hit).groupBy("path", "is_dir", "base", "cataloged").agg(F.max_by(~F.col("negated"), "place").alias("fires"))
    deepest = by_section.where("fires").groupBy("path", "is_dir").agg(F.max(F.struct(F.length("base"), F.when(F.col("cataloged"), CATALOGED).otherwise(IGNORED).alias("tier"))).alias("last"))
    own = tier(defaults, F.col("path"), F.col("is_dir"))
    return entries.join(deepest, ["path", "is_dir"], "left").select("path", "is_dir", F.coalesce("last.tier", own).alias("tier"))


def layered_tier(paths: DataFrame, rules: DataFrame, defaults: list[Rules]) -> DataFrame:
    """(path, tier) of each distinct file path: classify_tree() with the rules of rule_rows() below the default layers.

    Rules are rows, so the plan doesn't grow with ignore files. A verdict on a directory
    holds for all under it. Null paths are left out.
    """
    files = paths.where("path is not null").select("path").distinct()
    dirs = files.select(F.explode(proper_ancestors(F.col("path"))).alias("path")).distinct()
    entries = files.withColumn("is_dir", F.lit(False)).unionByName(dirs.withColumn("is_dir", F.lit(True)))
    verdicts = written(_own_tiers(entries, rules, defaults), "verdicts")
    shut = verdicts.where(F.col("is_dir") & (F.col("tier") > INDEXED))
    own = verdicts.where(~F.col("is_dir")).select("path", "tier")
    for level in (CATALOGED, IGNORED):
        inside = under(own.select("path"), shut.where(F.col("tier") == level), "left_semi").withColumn("inside", F.lit(level))
        own = own.join(inside, "path", "left").select("path", F.greatest("tier", F.coalesce("inside", F.lit(INDEXED))).alias("tier"))
    return own
