"""Command line: python -m stratafs.cli --store DIR --root DIR... COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime, timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import review
from .functions.patterns import duration_seconds
from .index import Index
from .operators import reports
from .sources import gate
from .streaming.watch import finish, overflows, watch


#: Commands whose results go with a line on stderr that tells how fresh they are.
FRESH = ("find", "get", "history", "outline", "manifest", "map", "audit", "triage", "backup-audit")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratafs")
    p.add_argument("--store", required=True)
    p.add_argument("--root", action="append", default=[])
    sub = p.add_subparsers(dest="command", required=True)
    p.add_argument("--roots-file", help="a root a line, ! before those that are off; its enabled ones are roots too")
    for name in ("init", "health", "scan-status", "triage"):
        sub.add_parser(name)
    scan = sub.add_parser("scan")
    scan.add_argument("--paths", nargs="+", help="only these of the roots, or directories below them")
    audit = sub.add_parser("audit")
    audit.add_argument("--min-bytes", type=int, default=0, help="of the largest cataloged directories")
    audit.add_argument("--sort-by", choices=("bytes", "count"), default="bytes")
    audit.add_argument("--full", action="store_true", help="all extensions and cataloged directories")
    audit.add_argument("--ext", help="the files of one extension, the largest first")
    audit.add_argument("--tier2", action="store_true", help="cataloged directories alone")
    roots = sub.add_parser("roots")
    roots.add_argument("change", nargs="?", choices=("add", "remove", "enable", "disable"))
    roots.add_argument("root_path", nargs="?")
    follow = sub.add_parser("watch")
    follow.add_argument("landing")
    follow.add_argument("checkpoint")
    follow.add_argument("--every", type=int, help="seconds between full scans")
    follow.add_argument("--once", action="store_true", help="what has arrived by now, then stop")
    find = sub.add_parser("find")
    find.add_argument("query", nargs="?")
    find.add_argument("--path")
    find.add_argument("--ext")
    find.add_argument("--limit", type=int, default=10)
    history = sub.add_parser("history")
    history.add_argument("path")
    history.add_argument("--since", help="as 2024-01-31 or 2024-01-31T10:00:00, UTC")
    history.add_argument("--until")
    for name, arg in (("get", "hash"), ("outline", "path"), ("backup-audit", "target"), ("backup-apply", "file"), ("read", "path"), ("prune", "older_than")):
        sub.add_parser(name).add_argument(arg)
    sub.add_parser("manifest").add_argument("--json", action="store_true")
    sub.add_parser("map").add_argument("prefix", nargs="?", default="")
    events = sub.add_parser("events-since")
    events.add_argument("cursor", type=int)
    events.add_argument("--limit", type=int, default=100)
    apply = sub.add_parser("triage-apply")
    apply.add_argument("file")
    apply.add_argument("rules")
    return p


def show(df: DataFrame) -> None:
    """All rows as JSON lines, a part at a time."""
    for line in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(line["j"])


def _time(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text) if "+" in text else datetime.fromisoformat(text).replace(tzinfo=UTC)


def _audit(index: Index, a: argparse.Namespace) -> dict[str, DataFrame]:
    if a.ext:
        return {"files": index.find_ext(a.ext, 1000)}
    parts = index.audit(2**31 - 1 if a.full else 20, a.min_bytes, a.sort_by)
    parts["by_extension"] = parts["by_extension"].orderBy(F.desc("bytes"), "ext")
    if not a.full:
        parts["by_extension"] = parts["by_extension"].limit(15)
    return {k: v for k, v in parts.items() if not a.tier2 or k in ("tier2", "largest")}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "backup-apply":
        print("\n".join(review.backup_summary(review.parse(open(a.file, encoding="utf-8").read()))))
        return 0
    if a.command == "triage-apply":
        text, n = review.apply_to_rules(open(a.rules, encoding="utf-8").read(), review.parse(open(a.file, encoding="utf-8").read()))
        with open(a.rules, "w", encoding="utf-8") as f:
            f.write(text)
        print(f"{n} pattern(s) added")
        return 0
    listed = gate.parse_roots(open(a.roots_file, encoding="utf-8").read()) if a.roots_file and os.path.exists(a.roots_file) else []
    if a.command == "roots":
        if a.change:
            if not a.roots_file or not a.root_path:
                parser().error("roots needs --roots-file and a path to change")
            others = [(r, on) for r, on in listed if r != a.root_path]
            listed = others if a.change == "remove" else [*others, (a.root_path, a.change != "disable")]
            with open(a.roots_file, "w", encoding="utf-8") as f:
                f.write(gate.format_roots(listed))
        sys.stdout.write(gate.format_roots([*((r, True) for r in a.root), *listed]))
        return 0
    a.root = [*a.root, *(r for r, on in listed if on)]
    spark = spark or SparkSession.builder.appName("stratafs").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    index = Index(spark, a.store, a.root)
    if a.command == "scan":
        show(index.scan(a.paths).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    elif a.command == "find":
        show(index.find_ext(a.ext) if a.ext else index.find_path(a.path) if a.path else index.find(a.query or "", a.limit))
    elif a.command == "history":
        show(index.history(a.path, _time(a.since), _time(a.until)))
    elif a.command in ("get", "outline"):
        show(getattr(index, a.command)(a.hash if a.command == "get" else a.path))
    elif a.command == "manifest":
        rows = index.manifest().select(F.to_json(F.struct("*")) if a.json else "path").toLocalIterator()
        sys.stdout.writelines(f"{r[0]}\n" for r in rows)
    elif a.command in ("audit", "map", "triage", "backup-audit"):
        parts = {"audit": lambda: _audit(index, a), "map": lambda: index.map(a.prefix), "triage": index.triage, "backup-audit": lambda: index.backup_audit(a.target)}[a.command]()
        if a.command == "triage":
            r = parts["recommendations"]
            parts["recommendations"] = reports.review_lines(r, F.col("action"), F.col("path"), F.col("size_bytes"), F.col("reason"))
        for name, df in parts.items():
            print(f"# {name}")
            show(df)
    elif a.command == "health":
        print(json.dumps(index.health(), default=str))
    elif a.command == "init":
        if not index.store.state()["generation"]:
            index.store.commit()
        print(json.dumps({"store": a.store, "roots": a.root, "generation": index.store.state()["generation"]}))
    elif a.command == "watch":
        now = {"availableNow": True} if a.once else None
        queries = [f(index, a.landing, f"{a.checkpoint}/{name}", now) for name, f in (("overflows", overflows), ("changes", partial(watch, every=a.every)))]
        for q in queries:
            q.awaitTermination()
        finish(index, f"{a.checkpoint}/changes")
        index.drain()
    elif a.command == "scan-status":
        show(index.store.table("scan_runs").orderBy(F.desc("id")).limit(1))
    elif a.command == "read":
        content, row = gate.read(a.path, a.root, "cli")
        index.log_read(row)
        sys.stdout.write(content.decode(errors="replace"))
    elif a.command == "prune":
        print(index.prune(datetime.now(UTC) - timedelta(seconds=duration_seconds(a.older_than))))
    elif a.command == "events-since":
        page = index.events_since(a.cursor, a.limit)
        for row in page.events:
            print(json.dumps(row.asDict(), default=str))
        print(json.dumps({"cursor_valid": page.cursor_valid, "next_cursor": page.next_cursor, "has_more": page.has_more}))
    if a.command in FRESH:
        print(json.dumps(index.freshness(), default=str), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
