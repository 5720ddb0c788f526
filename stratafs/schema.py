"""Schemas of the stored tables, as DDL. Times are epoch seconds in paths.mtime and timestamps elsewhere."""


def _table(**columns: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


SECTION = "struct<heading: string, level: int, line: int>"

DOCUMENTS = _table(
    content_hash="string", body_hash="string", title="string", summary="string", structure=f"array<{SECTION}>",
    topics="array<string>", is_binary="boolean", first_seen="timestamp", byte_size="bigint",
)
PATHS = _table(
    path="string", root="string", content_hash="string", mtime="bigint", size_bytes="bigint", inode="bigint", dev="bigint",
    is_hardlink="boolean", appeared="bigint", disappeared="bigint", last_seen_scan="bigint",
)
EVENTS = _table(
    id="bigint", event_type="string", content_hash="string", path="string", previous_hash="string", previous_path="string",
    timestamp="timestamp", file_extension="string", mime_type="string", scan_id="bigint",
)
CATALOG = _table(
    path="string", total_bytes="bigint", file_count="bigint", previous_total_bytes="bigint", previous_file_count="bigint", regenerable="boolean"
)
SCAN_REQUESTS = _table(
    id="bigint", requested_at="timestamp", kind="string", root="array<string>", status="string", scan_run_id="bigint",
    started_at="timestamp", completed_at="timestamp", error="string",
)
SCAN_RUNS = _table(id="bigint", started_at="timestamp", finished_at="timestamp", status="string", files_seen="bigint", error="string")
READ_AUDIT = _table(path="string", content_hash="string", timestamp="timestamp", caller="string")
SNAPSHOTS = _table(
    scan_id="bigint", timestamp="timestamp", tier1_files_scanned="bigint", tier2_dirs_cataloged="bigint", events_emitted="bigint", duration_ms="bigint", files_scanned="bigint"
)
POSTINGS = _table(
    token="string", segment="bigint", prefix="int", n="int", most="int", shortest="int", keys="array<string>", lengths="array<int>", docs="array<int>",
    counts="array<int>", places="array<bigint>",
)
NAMES = _table(segment="bigint", part="int", id="int", path="string")
GRAMS = _table(gram="string", segment="bigint", part="int", ids="array<int>")
