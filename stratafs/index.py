"""The index as one object: scan, search, look up, audit, follow."""

from __future__ import annotations

import os
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import extract
from .functions.paths import extension_label
from .functions.patterns import glob_to_like, search_terms
from .operators import diff, feed, grams, policy, predicates, reports, search
from .sources.store import CommitConflict, Store
from .sources.walk import find_files, read_contents, walk_steps
from .streaming.apply import affected, changed_paths

STALE_SECONDS, FULL_SECONDS = 3600, 86_400
#: What a keyword search looks at.
SEARCHED = ["title", "topic_text", "summary", "search_text"]


class Index:
    """Queries return DataFrames; the store is read anew by each, so a scan shows at once."""

    def __init__(self, spark: SparkSession, folder: str, roots: list[str], user_rules: str = "", home: str | None = None,
                 most_bytes: int = 524_288_000, search_bytes: int = extract.SEARCH_BYTES):
        self.spark, self.store, self.roots = spark, Store(spark, folder), roots
        self.user_rules, self.home = user_rules, home or os.environ.get("HOME", "/")
        self.most_bytes, self.search_bytes = most_bytes, search_bytes

    # ---- writing

    def scan(self, roots: list[str] | None = None, now: int | None = None, retire_all: bool = False) -> DataFrame:
        """Bring the index up to date and return the scan's events.

        Contents are read only where size or mtime changed. A scan of some roots retires
        only paths below those, unless retire_all. A scan that fails leaves the last state
        and a failed run; one that another writer overtakes raises CommitConflict.
        """
        roots = roots or self.roots
        now = now if now is not None else int(datetime.now(UTC).timestamp())
        run = self._begin(now)
        try:
            self._scan(self.store.state(), roots, now, run, retire_all)
        except Exception as e:
            self._end(run, now, "failed", None, str(e)[:500])
            raise
        return self.store.table("events").where(F.col("scan_id") == run)

    def _scan(self, base: dict, roots: list[str], now: int, run: int, retire_all: bool) -> None:
        began = time.monotonic()
        table = lambda name: self.store.table(name, base)
        documents, active = table("documents"), table("active")
        # the tree and its contents are read once: all tables of a generation come from what was written then
        walked = walk_steps(self.spark, roots, self.user_rules, self.home, lambda df: self.store.draft("walk", df))
        files = diff.needs_hash(walked.where("catalog_dir is null").drop("catalog_dir"), active)
        read = read_contents(files.where("needs_hash"), self.most_bytes)
        fresh = self.store.draft("fresh", extract.document_rows(read, self.search_bytes))
        bodies = documents.select("content_hash", F.col("body_hash").alias("known_body"))
        cur = (
            files.join(fresh.select("path", F.col("content_hash").alias("new_hash"), "full_body"), "path", "left")
            .withColumn("content_hash", F.when(F.col("needs_hash"), F.col("new_hash")).otherwise(F.col("known_hash"))).where("content_hash is not null")
            .join(bodies, "content_hash", "left")
            .withColumn("body_hash", F.coalesce("full_body", "known_body", "content_hash"))
            .select("path", "root", "content_hash", "body_hash", "mtime", "size_bytes", "inode", "dev")
        )
        cur = self.store.draft("current", cur)
        prev = active.join(bodies, "content_hash", "left").select("path", "content_hash", F.col("known_body").alias("body_hash"))
        scope = None if retire_all else roots
        if scope is not None:
            inside = F.lit(False)
            for root in scope:
                inside = inside | (F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/")
            prev = prev.where(inside)
        found = diff.events_of(prev, cur).withColumn("timestamp", F.timestamp_seconds(F.lit(now))).withColumn("scan_id", F.lit(run).cast("bigint"))
        dirs = walked.where("catalog_dir is not null").groupBy(F.col("catalog_dir").alias("path")).agg(F.sum("size_bytes").alias("total_bytes"), F.count(F.lit(1)).alias("file_count"))
        runs = table("scan_runs")
        ended, seen = F.col("id") == run, cur.count()
        runs = (
            runs.withColumn("status", F.when(ended, F.lit("complete")).otherwise(F.col("status")))
            .withColumn("finished_at", F.when(ended, F.timestamp_seconds(F.lit(now))).otherwise(F.col("finished_at")))
            .withColumn("files_seen", F.when(ended, F.lit(seen).cast("bigint")).otherwise(F.col("files_seen")))
        )
        after = self.store.draft("paths", diff.next_paths(active, cur, run, now, scope))
        events, emitted = self._numbered(found, base)
        new_documents, postings, counts = self._contents(fresh, base, now)
        row = (run, datetime.fromtimestamp(now, UTC), emitted, dirs.count(), emitted, int(1000 * (time.monotonic() - began)), seen)
        self.store.commit(
            base,
            append={"events": events, "closed": after.where("disappeared is not null"), "snapshots": self.spark.createDataFrame([row], schema.SNAPSHOTS), **postings, **self._paths_seen(events, base)},
            change={"documents": new_documents} if new_documents is not None else {},
            count={"events": emitted, **counts},
            active=after.where("disappeared is null"),
            catalog=diff.next_catalog(table("catalog"), dirs),
            scan_runs=runs,
        )

    def _numbered(self, found: DataFrame, base: dict) -> tuple[DataFrame, int]:
        """Events with ids that follow the last, and how many they are."""
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(self.store.draft("events", df))
            return held[0]

        last = base.get("counts", {}).get("events", 0)
        rows = feed.numbered(found, last, ["path", "event_type"], hold).select(*self.store.table("events", base).columns)
        return rows, held[0].count()

    def _contents(self, fresh: DataFrame, base: dict, now: int) -> tuple[DataFrame | None, dict[str, DataFrame], dict[str, int]]:
        """What the contents that were read change: rows of documents, postings to append, and what a search has to know of the corpus."""
        if fresh.isEmpty():
            return None, {}, {}
        hashes = fresh.select("content_hash").distinct()
        known = self.store.draft("known", self.store.table("documents", base, hashes).join(hashes, "content_hash", "left_semi"))
        seen = fresh.withColumn("first_seen", F.timestamp_seconds(F.lit(now))).select("path", *known.columns)
        had = known.select("content_hash", F.lit(True).alias("had"), F.col("body_hash").alias("had_body"))
        rows = diff.next_documents(known, seen).join(had, "content_hash", "left")
        rows = rows.where(F.col("had").isNull() | ~F.col("had_body").eqNullSafe(F.col("body_hash"))).drop("had", "had_body").withColumn("gone", F.lit(False))
        new = fresh.where("not is_binary").join(known.select("content_hash"), "content_hash", "left_anti")
        # title and summary go by the least path, as in documents
        one = new.groupBy("content_hash").agg(F.min(F.struct("path", "title", F.array_join("topics", " ").alias("topic_text"), "summary", "search_text")).alias("d")).select("content_hash", "d.*")
        n, tokens = search.text_lengths(one, SEARCHED)
        placed = search.block_rows(one, "content_hash", SEARCHED, uuid.uuid4().int >> 65, search.block_bits(n))
        return rows, {"postings": placed} if n else {}, {"docs": n, "tokens": tokens}

    def _paths_seen(self, events: DataFrame, base: dict) -> dict[str, DataFrame]:
        """Names and grams to append of the paths that are new to the index."""
        new = events.where(F.col("event_type").isin("created", "moved", "copied", "hardlinked")).select("path").distinct()
        new = self.store.draft("new", new.join(self.store.table("names", base).select("path"), "path", "left_anti"))
        n = new.count()
        if not n:
            return {}
        names = self.store.draft("names", grams.numbered_paths(new, uuid.uuid4().int >> 65, grams.part_bits(n)))
        return {"names": names, "grams": grams.gram_rows(names)}

    # ---- runs and requests

    def _begin(self, now: int) -> int:
        """A new run that is under way; its number."""
        base = self.store.state()
        runs = self.store.table("scan_runs", base)
        run = (runs.agg(F.max("id")).first()[0] or 0) + 1
        self.store.commit(base, append={"scan_runs": self.spark.createDataFrame([(run, datetime.fromtimestamp(now, UTC), None, "running", None, None)], runs.schema)})
        return run

    def _end(self, run: int, now: int, status: str, seen: int | None, error: str | None) -> None:
        base = self.store.state()
        runs = self.store.table("scan_runs", base)
        others = runs.where(F.col("id") != run)
        begun = runs.where(F.col("id") == run).first()
        row = (run, begun["started_at"] if begun else None, datetime.fromtimestamp(now, UTC), status, seen, error)
        self.store.commit(base, scan_runs=others.unionByName(self.spark.createDataFrame([row], runs.schema)))

    def request(self, kind: str = "full", roots: list[str] | None = None, now: int | None = None) -> int:
        """Put a scan into the queue; its request's number."""
        now = now if now is not None else int(datetime.now(UTC).timestamp())
        stamp = datetime.fromtimestamp(now, UTC)

        def ask(queue: DataFrame) -> tuple[int, DataFrame]:
            more = feed.enqueue(queue, kind, roots, stamp)
            return more.agg(F.max("id")).first()[0], more

        return self._queue(ask)

    def _queue(self, change):
        """Replace the queue by what change(queue) -> (result, queue) makes of it; again if another writer was faster."""
        for _ in range(10):
            base = self.store.state()
            result, queue = change(self.store.table("scan_requests", base))
            try:
                self.store.commit(base, scan_requests=queue)
                return result
            except CommitConflict:
                continue
        raise CommitConflict("the queue is too busy")

    def drain(self, now: int | None = None) -> int:
        """Run the requests that wait, oldest first, one at a time; how many ran."""
        n = 0
        while True:
            at = now if now is not None else int(datetime.now(UTC).timestamp())
            stamp = datetime.fromtimestamp(at, UTC)
            if self.store.table("scan_requests").where("status = 'pending'").isEmpty():
                return n
            first = self._queue(lambda queue: feed.claim(queue, stamp))
            if first is None:
                return n
            roots = self.store.table("scan_requests").where(F.col("id") == first).first()["root"]
            error = None
            try:
                self.scan(roots or None, at)
            except Exception as e:  # noqa: BLE001  the request keeps it
                error = str(e)[:500]
            run = self.store.table("scan_runs").agg(F.max("id")).first()[0]
            self._queue(lambda queue: (None, feed.finish(queue, first, stamp, run, error)))  # noqa: B023  called at once
            n += 1

    def recover(self, reason: str = "the process ended") -> None:
        """Mark what a process that ended has left running as failed."""
        base = self.store.state()
        self.store.commit(base, **{name: feed.recovered(self.store.table(name, base), reason) for name in ("scan_runs", "scan_requests")})

    def due(self, now: int, every: int = FULL_SECONDS) -> bool:
        """Whether the last complete scan is so long ago that a periodic one is due."""
        last = self.store.table("scan_runs").where("status = 'complete'").agg(F.unix_seconds(F.max("finished_at"))).first()[0]
        return last is None or now - last >= every

    def apply(self, flushes: DataFrame, now: int) -> DataFrame:
        """Bring the paths of debounced changes (key, kind, from_key, flush_ms) up to date and return their events.

        Ignore files of directories hold as in a scan. A directory that has appeared is
        walked, and what lay below one that has gone is retired. New paths are created:
        only a scan sees enough to call them moved or copied.
        """
        base = self.store.state()
        named = self.store.draft("touched", affected(flushes))
        files = self.store.draft("files", find_files(named.where("present"), self.roots, self.user_rules, self.home))
        touched = named.select("path").unionByName(files.select("path"))
        gone = named.where("not present").select("path")
        if not gone.isEmpty():
            touched = touched.unionByName(reports.under(self.store.table("active", base).select("path"), gone, "left_semi"))
        touched = self.store.draft("paths", touched.distinct())
        fresh = self.store.draft("fresh", extract.document_rows(read_contents(files, self.most_bytes), self.search_bytes))
        cur = files.join(fresh.select("path", "content_hash", F.col("full_body").alias("body_hash")), "path")
        # only slots with such paths, and with contents that those had, are read
        mine = self.store.draft("mine", self.store.table("active", base, touched).join(touched, "path", "left_semi"))
        bodies = self.store.table("documents", base, mine.select("content_hash")).select("content_hash", "body_hash")
        prev = mine.join(bodies, "content_hash", "left").select("path", "content_hash", "body_hash")
        found = diff.events_of(prev, cur, resolve=False).withColumn("timestamp", F.timestamp_seconds(F.lit(now))).withColumn("scan_id", F.lit(None).cast("bigint"))
        run = self.store.table("scan_runs", base).agg(F.max("id")).first()[0] or 0
        after = self.store.draft("after", diff.next_paths(mine, cur, run, now))
        events, emitted = self._numbered(found, base)
        new_documents, postings, counts = self._contents(fresh, base, now)
        self.store.commit(
            base,
            append={"events": events, "closed": after.where("disappeared is not null"), **postings, **self._paths_seen(events, base)},
            change={"active": changed_paths(mine, after), **({"documents": new_documents} if new_documents is not None else {})},
            count={"events": emitted, **counts},
        )
        return self.store.table("events").where(F.col("id") > base.get("counts", {}).get("events", 0))

    def prune(self, before: datetime) -> int:
        """Drop events and logged reads older than a time; how many went."""
        base, n, kept = self.store.state(), 0, {}
        for name in ("events", "read_audit"):
            rows = self.store.table(name, base)
            old = rows.where(F.col("timestamp") < F.lit(before)).count()
            if old:
                n, kept[name] = n + old, feed.retained(rows, F.lit(before))
        if kept:
            self.store.commit(base, **kept)
        return n

    def log_read(self, row: dict) -> None:
        self.store.commit(append={"read_audit": self.spark.createDataFrame([row], self.store.table("read_audit").schema)})

    # ---- reading

    def _active(self) -> DataFrame:
        d = self.store.table("documents")
        p = self.store.table("active").select("path", "root", "content_hash", "mtime", "size_bytes", "inode", "dev")
        return p.join(d, "content_hash")

    def find(self, query: str, k: int = 10) -> DataFrame:
        """Ranked keyword search over titles, topics, summaries and texts of all contents ever seen.

        All words have to occur; a lower rank is better. Reads the postings of the query's
        words, and of those only the parts that can be among the best.
        """
        state = self.store.state()
        documents, placed, active = (self.store.table(name, state) for name in ("documents", "postings", "active"))
        counts = state.get("counts", {})
        best = search.top(placed, "content_hash", search_terms(query), k, counts.get("docs", 0), counts.get("tokens", 0))
        full = best.join(documents.select("content_hash", "title", "summary", "topics"), "content_hash")
        return search.any_path(full, active).orderBy("rank", "content_hash")

    def find_path(self, glob: str, most: int = 200) -> DataFrame:
        """Active paths that match a pattern, the largest first, by the grams that it has to contain."""
        state, like = self.store.state(), glob_to_like(glob, self.home)
        found = grams.matching_paths(self.store.table("names", state), self.store.table("grams", state), like)
        return predicates.largest(self._active().join(found, "path", "left_semi"), most)

    def find_ext(self, ext: str, most: int = 200) -> DataFrame:
        return predicates.largest(self._active().where(predicates.has_suffix(F.col("path"), ext)), most)

    def get(self, content_hash: str) -> DataFrame:
        """A document, once for each of its current paths, with how many they are; once with a null path if there is none."""
        key = F.col("content_hash") == content_hash
        paths = self.store.table("active").where(key).select("content_hash", "path")
        n = paths.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_paths"))
        one = self.store.table("documents").where(key).join(n, "content_hash", "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0).cast("long")))
        return one.join(paths, "content_hash", "left").orderBy("path")

    def history(self, path: str, since=None, until=None) -> DataFrame:
        return feed.history(self.store.table("events"), path, since, until)

    def outline(self, path: str) -> DataFrame:
        return self._active().where(F.col("path") == path).select("path", "content_hash", "title", "summary", "structure", "topics")

    def manifest(self) -> DataFrame:
        return reports.under(self._active(), self.store.table("catalog"), "left_anti").select("path", "content_hash", F.coalesce("byte_size", F.lit(0)).alias("byte_size")).orderBy("path")

    def map(self, prefix: str = "", tier: str | None = None, most: int = 500) -> dict[str, DataFrame]:
        out = {}
        if tier in (None, "indexed"):
            out["indexed"] = self._active().where(F.col("path").startswith(prefix)).orderBy("path").limit(most).select("path", "title", "topics")
        if tier in (None, "cataloged"):
            out["cataloged"] = self.store.table("catalog").where(F.col("path").startswith(prefix)).orderBy("path").limit(most)
        totals = {k: v for k, v in self.health().items() if k.startswith("total_")}
        out["totals"] = self.spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} bigint" for k in totals))
        return out

    def audit(self, most: int = 20, min_bytes: int = 0, sort_by: str = "bytes") -> dict[str, DataFrame]:
        """Totals, extensions, the largest cataloged directories (of min_bytes at least; sort_by: bytes or count), policy violations."""
        active, catalog = self._active(), self.store.table("catalog")
        total = (F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))
        return {
            "tier1": active.agg(*total),
            "by_extension": active.withColumn("ext", extension_label(F.col("path"))).groupBy("ext").agg(*total),
            "tier2": catalog.agg(F.count(F.lit(1)).alias("dirs"), F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("bytes")),
            "largest": predicates.largest_dirs(catalog, most, min_bytes, sort_by),
            "violations": predicates.violation_counts(self.store.table("active")),
        }

    def health(self, now: int | None = None) -> dict:
        """Counts, the last scan, and whether that is too long ago; a store never scanned isn't stale."""
        state = self.store.state()
        count = lambda name: self.store.table(name, state).count()
        active = count("active")
        return {
            "status": "ok", "roots": self.roots, "total_paths_all": active + count("closed"), "total_active_paths": active, "total_indexed": active,
            "total_documents": count("documents"), "total_cataloged": count("catalog"), "total_searchable": state.get("counts", {}).get("docs", 0),
            "last_scan": self._last_scan(state), **self.freshness(now),
        }

    def _last_scan(self, state: dict) -> datetime | None:
        return self.store.table("snapshots", state).agg(F.max("timestamp")).first()[0]

    def freshness(self, now: int | None = None) -> dict:
        """as_of, is_stale and reason of what a query shows: the last snapshot, and whether that is too long ago."""
        now = now if now is not None else int(datetime.now(UTC).timestamp())
        at = self.store.table("snapshots").agg(F.unix_seconds(F.max("timestamp"))).first()[0]
        age = now - (now if at is None else at)
        stale = age > STALE_SECONDS
        return {"as_of": now if at is None else at, "is_stale": stale, "reason": f"the last scan was {age} seconds ago" if stale else None}

    def events_since(self, cursor: int, limit: int = 100) -> feed.Page:
        return feed.page(self.store.table("events"), cursor, limit)

    def triage(self) -> dict[str, DataFrame]:
        active = self._active()
        rules = [policy.default_rules("/"), *([policy.parse_rules(self.user_rules, self.home)] if self.user_rules else [])]
        tier = policy.tier_name(policy.tree_tier(rules, F.col("path")))
        groups = reports.canonical_order(reports.duplicates(active), tier)
        pairs, rest = reports.directory_pairs(groups)
        return {"recommendations": reports.recommendations(active, self.home), "duplicates": groups, "directory_pairs": pairs, "individual": rest}

    def backup_audit(self, target: str) -> dict[str, DataFrame]:
        return reports.backup_audit(self._active(), target)
