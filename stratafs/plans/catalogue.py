"""The registered queries over the index, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..functions.patterns import glob_to_like, search_terms
from ..operators import diff, feed, grams, policy, predicates, reports, search
from ..sources.scratch import scratch, written
from ..sources.store import Store
from ..streaming import debounce
from ..streaming.apply import changed_paths
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, head: str = V.SQL):
    """Registers a query, and its SQL behind the common table expressions."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"{head}\n{sql}"
        return f

    return keep


ROOT = "/r0"
EXT = r"CASE WHEN regexp_matches(name, '^.+[.][^.]*$') THEN lower(regexp_extract(name, '^.+[.]([^.]*)$', 1)) END"
NAMED = "(SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM active_v)"
EXTS = f"(SELECT *, {EXT} AS ext FROM {NAMED} named)"
MB = 1 << 20

# ---- scans and sinks


@query("src_table", "SELECT root, count(*) AS n_rows, count(DISTINCT content_hash) AS n_hashes FROM files_v GROUP BY root")
def src_table(spark, d):
    return V.paths(spark, d).groupBy("root").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("content_hash").alias("n_hashes"))


@query("src_prev_paths", "SELECT path, content_hash, mtime, size_bytes FROM files_v WHERE disappeared IS NULL")
def src_prev_paths(spark, d):
    return V.paths(spark, d).where("disappeared is null").select("path", "content_hash", "mtime", "size_bytes")


@query("src_old_body", "SELECT content_hash, body_hash FROM documents_v WHERE body_hash IS NOT NULL")
def src_old_body(spark, d):
    return V.documents(spark, d).where("body_hash is not null").select("content_hash", "body_hash")


@query("src_catalog_subtree", "SELECT path, total_bytes, file_count FROM catalog_v")
def src_catalog_subtree(spark, d):
    return V.catalog(spark, d)


@query("src_read_hash", r"""SELECT id, content_hash, sha256(text) AS body_hash, CAST(false AS BOOLEAN) AS is_binary,
  substring(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], 1, 200) AS summary
  FROM files_v""")
def src_read_hash(spark, d):
    f = V.files(spark, d)
    return f.select("id", "content_hash", X.sha256(X.body(F.col("text"))).alias("body_hash"), X.is_binary(F.col("text")).alias("is_binary"), X.text_summary(F.col("text")).alias("summary"))


_NEW_DOCS = "SELECT content_hash, min(path) AS path FROM cur_v GROUP BY content_hash"


@query("snk_documents", f"""SELECT content_hash, first_seen FROM documents_v
  UNION ALL SELECT content_hash, 1800000000 AS first_seen FROM ({_NEW_DOCS}) n WHERE content_hash NOT IN (SELECT content_hash FROM documents_v)""", V.SNAP_SQL)
def snk_documents(spark, d):
    old = V.documents(spark, d).select("content_hash", F.col("first_seen").cast("bigint"))
    new = V.snapshots(spark, d)[1].select("content_hash", F.lit(1800000000).cast("bigint").alias("first_seen"), "path")
    return diff.next_documents(old, new)


@query("snk_body_backfill", """SELECT x.content_hash, coalesce(x.body_hash, n.body_hash) AS body_hash FROM documents_v x
  LEFT JOIN (SELECT content_hash, min_by(body_hash, path) AS body_hash FROM cur_v GROUP BY content_hash) n USING (content_hash)""", V.SNAP_SQL)
def snk_body_backfill(spark, d):
    old = V.documents(spark, d).select("content_hash", "body_hash")
    new = V.snapshots(spark, d)[1].join(old.select("content_hash"), "content_hash", "left_semi").select("content_hash", "body_hash", "path")
    return diff.next_documents(old, new)


_TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
_DOC_TOKENS = f"(SELECT content_hash, {_TOKENS} AS t FROM (SELECT content_hash, min_by(text, id) AS text FROM files_v GROUP BY content_hash) one_text)"


def _doc_texts(spark, d):
    return V.files(spark, d).groupBy("content_hash").agg(F.min_by("text", "id").alias("text"))


@query("snk_fts", f"SELECT content_hash, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM {_DOC_TOKENS} x WHERE len(t) > 0")
def snk_fts(spark, d):
    p = search.postings(_doc_texts(spark, d), "content_hash", ["text"])
    return p.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("token").alias("n_terms"))


_GEN, _NOW = 9, 1_800_000_000
_NEXT = f"""active_now AS (SELECT path, content_hash, mtime, size_bytes, last_seen_scan, appeared FROM files_v WHERE disappeared IS NULL),
  pairs AS (SELECT coalesce(a.path, c.path) AS path, a.content_hash AS ph, c.content_hash AS ch, a.appeared, a.last_seen_scan,
    c.content_hash IS NOT DISTINCT FROM a.content_hash AND c.mtime IS NOT DISTINCT FROM a.mtime AND c.size_bytes IS NOT DISTINCT FROM a.size_bytes AS same
    FROM active_now a FULL JOIN cur_v c ON a.path = c.path)
  SELECT path, ph AS content_hash, appeared, CASE WHEN NOT same THEN {_NOW} END AS disappeared, CASE WHEN same THEN {_GEN} ELSE last_seen_scan END AS last_seen_scan
  FROM pairs WHERE ph IS NOT NULL
  UNION ALL SELECT path, ch, {_NOW}, NULL, {_GEN} FROM pairs WHERE ch IS NOT NULL AND NOT same
  UNION ALL SELECT path, content_hash, appeared, disappeared, last_seen_scan FROM files_v WHERE disappeared IS NOT NULL"""


def _next_paths(spark, d):
    old = V.paths(spark, d).withColumn("is_hardlink", F.lit(False))
    return diff.next_paths(old, V.snapshots(spark, d)[1], _GEN, _NOW)


@query("snk_paths_scd2", ", " + _NEXT, V.SNAP_SQL)
def snk_paths_scd2(spark, d):
    return _next_paths(spark, d).select("path", "content_hash", "appeared", "disappeared", "last_seen_scan")


@query("snk_paths_deltas", ", " + _NEXT, V.SNAP_SQL)
def snk_paths_deltas(spark, d):
    """The state after a scan, applied to a stored one in three parts as deltas by key, as it is read then."""
    old = V.paths(spark, d).withColumn("is_hardlink", F.lit(False))
    store = Store(spark, scratch(spark, "paths"))
    store.commit(append={"closed": old.where("disappeared is not null")}, active=old.where("disappeared is null"))
    cur = written(V.snapshots(spark, d)[1], "current")
    for part in range(3):
        mine = lambda df: df.where(F.pmod(F.xxhash64("path"), F.lit(3)) == part)  # noqa: B023, E731  used at once
        before = mine(store.table("active"))
        after = written(diff.next_paths(before, mine(cur), _GEN, _NOW), "after")
        store.commit(append={"closed": after.where("disappeared is not null")}, change={"active": changed_paths(before, after)})
    return store.table("paths").select("path", "content_hash", "appeared", "disappeared", "last_seen_scan")


@query("snk_touch", f", {_NEXT.split('SELECT path, ph')[0]} SELECT path, {_GEN} AS last_seen_scan FROM pairs WHERE ph IS NOT NULL AND same", V.SNAP_SQL)
def snk_touch(spark, d):
    rows = _next_paths(spark, d)
    return rows.where((F.col("last_seen_scan") == _GEN) & (F.col("appeared") != _NOW)).select("path", F.col("last_seen_scan").cast("int"))


_DIFF = """hist AS (SELECT p.content_hash, bool_or(s.path IS NULL) AS any_gone, min(CASE WHEN s.path IS NULL THEN p.path END) AS gone_path
    FROM prev_v p LEFT JOIN (SELECT DISTINCT path FROM cur_v) s ON p.path = s.path GROUP BY p.content_hash),
  inodes AS (SELECT dev, inode FROM cur_v GROUP BY dev, inode HAVING count(*) > 1),
  both_v AS (SELECT coalesce(c.path, p.path) AS path, p.content_hash AS ph, c.content_hash AS ch, p.body_hash AS ob, c.body_hash AS nb, h.any_gone, h.gone_path, i.inode IS NOT NULL AS linked
    FROM prev_v p FULL JOIN cur_v c ON p.path = c.path LEFT JOIN hist h ON h.content_hash = c.content_hash LEFT JOIN inodes i ON i.dev = c.dev AND i.inode = c.inode),
  diff_v AS (SELECT *, CASE WHEN ph IS NULL THEN CASE WHEN any_gone IS NULL THEN 'created' WHEN any_gone THEN 'moved' WHEN linked THEN 'hardlinked' ELSE 'copied' END
    WHEN ch IS NULL THEN 'deleted' WHEN ph = ch THEN NULL WHEN ob IS NOT NULL AND ob <> ph AND ob IS NOT DISTINCT FROM nb THEN 'minor_change' ELSE 'updated' END AS event_type FROM both_v)"""


def _events(spark, d, resolve=True):
    prev, cur = V.snapshots(spark, d)
    return diff.events_of(prev, cur, resolve)


_EVENT_COLUMNS = """event_type, path, coalesce(ch, ph) AS content_hash, CASE WHEN event_type IN ('updated', 'minor_change', 'deleted') THEN ph END AS previous_hash,
  CASE WHEN event_type = 'moved' THEN gone_path END AS previous_path"""


@query("dif_core", f", {_DIFF} SELECT {_EVENT_COLUMNS} FROM diff_v WHERE event_type IS NOT NULL", V.SNAP_SQL)
def dif_core(spark, d):
    return _events(spark, d).drop("file_extension", "mime_type")


_MIME_CASE = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.MIME.items()) + f" ELSE '{P.OTHER_MIME}' END"


@query("snk_events", f""", {_DIFF} SELECT event_type, path, ext AS file_extension, {_MIME_CASE} AS mime_type FROM (
  SELECT *, {EXT} AS ext FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM diff_v WHERE event_type IS NOT NULL) n) x""", V.SNAP_SQL)
def snk_events(spark, d):
    return _events(spark, d).select("event_type", "path", "file_extension", "mime_type")


@query("jn_diff", f", {_DIFF} SELECT path, ph AS prev_hash, ch AS cur_hash, CASE WHEN event_type IN ('moved', 'copied', 'hardlinked') THEN 'created' ELSE event_type END AS event_type FROM diff_v", V.SNAP_SQL)
def jn_diff(spark, d):
    return diff.compare(*V.snapshots(spark, d)).select("path", "prev_hash", "cur_hash", "event_type")


@query("jn_move_src", f", {_DIFF} SELECT content_hash, any_gone, gone_path FROM hist", V.SNAP_SQL)
def jn_move_src(spark, d):
    return diff.hash_history(*V.snapshots(spark, d))


@query("jn_inode", f", {_DIFF} SELECT c.path, c.inode FROM cur_v c JOIN inodes i ON i.dev = c.dev AND i.inode = c.inode", V.SNAP_SQL)
def jn_inode(spark, d):
    cur = V.snapshots(spark, d)[1]
    return cur.join(diff.shared_inodes(cur), ["dev", "inode"]).select("path", "inode")


@query("jn_oldbody", "SELECT p.path, p.content_hash, x.body_hash AS old_body FROM prev_v p LEFT JOIN documents_v x USING (content_hash)", V.SNAP_SQL)
def jn_oldbody(spark, d):
    bodies = V.documents(spark, d).select("content_hash", F.col("body_hash").alias("old_body"))
    return V.snapshots(spark, d)[0].select("path", "content_hash").join(bodies, "content_hash", "left")


@query("dif_upgrade", f", {_DIFF} SELECT path, event_type FROM diff_v WHERE ph IS NULL", V.SNAP_SQL)
def dif_upgrade(spark, d):
    return _events(spark, d).where(F.col("event_type").isin("created", "moved", "copied", "hardlinked")).select("path", "event_type")


@query("dif_deleted", "SELECT p.path, p.content_hash FROM prev_v p WHERE p.path NOT IN (SELECT path FROM cur_v)", V.SNAP_SQL)
def dif_deleted(spark, d):
    return _events(spark, d).where("event_type = 'deleted'").select("path", "content_hash")


@query("dif_retire", f"""SELECT f.path, {_NOW} AS disappeared FROM files_v f WHERE f.disappeared IS NULL AND f.path NOT IN (SELECT path FROM cur_v)""", V.SNAP_SQL)
def dif_retire(spark, d):
    rows = _next_paths(spark, d)
    # those that a new version follows are not retired but replaced
    return rows.where(F.col("disappeared") == _NOW).join(rows.where("disappeared is null"), "path", "left_anti").select("path", F.col("disappeared").cast("int"))


@query("dif_summary", f", {_DIFF} SELECT event_type, count(*) AS n FROM diff_v WHERE event_type IS NOT NULL GROUP BY event_type", V.SNAP_SQL)
def dif_summary(spark, d):
    return diff.tally(_events(spark, d))


@query("agg_event_tally", "SELECT event_type, count(*) AS n FROM events_v GROUP BY event_type")
def agg_event_tally(spark, d):
    return diff.tally(V.events(spark, d))


@query("snk_snapshot", f", {_DIFF} SELECT (SELECT count(*) FROM diff_v WHERE event_type IS NOT NULL) AS tier1_files_scanned, (SELECT count(*) FROM cur_v) AS files_scanned", V.SNAP_SQL)
def snk_snapshot(spark, d):
    cur = V.snapshots(spark, d)[1].agg(F.count(F.lit(1)).alias("files_scanned"))
    return _events(spark, d).agg(F.count(F.lit(1)).alias("tier1_files_scanned")).join(F.broadcast(cur))  # one row


_LATER = "SELECT path, total_bytes * 2 AS total_bytes, file_count + 1 AS file_count FROM catalog_v WHERE file_count % 2 = 0"


def _next_catalog(spark, d):
    c = V.catalog(spark, d)
    old = c.select("path", "total_bytes", "file_count", F.lit(None).cast("bigint").alias("previous_total_bytes"), F.lit(None).cast("bigint").alias("previous_file_count"), F.lit(True).alias("regenerable"))
    now = c.where("file_count % 2 = 0").select("path", (F.col("total_bytes") * 2).alias("total_bytes"), (F.col("file_count") + 1).alias("file_count"))
    return diff.next_catalog(old, now)


_CATALOG_NEXT = f"""SELECT c.path, coalesce(n.total_bytes, c.total_bytes) AS total_bytes, coalesce(n.file_count, c.file_count) AS file_count,
  CASE WHEN n.path IS NOT NULL THEN c.total_bytes END AS previous_total_bytes, CASE WHEN n.path IS NOT NULL THEN c.file_count END AS previous_file_count, true AS regenerable
  FROM catalog_v c LEFT JOIN ({_LATER}) n ON n.path = c.path"""
query("snk_catalog", _CATALOG_NEXT)(_next_catalog)
query("dif_catalog", f"SELECT path, total_bytes - previous_total_bytes AS grown FROM ({_CATALOG_NEXT}) x WHERE previous_total_bytes IS NOT NULL")(
    lambda spark, d: _next_catalog(spark, d).where("previous_total_bytes is not null").select("path", (F.col("total_bytes") - F.col("previous_total_bytes")).alias("grown"))
)


@query("snk_audit", "SELECT id, path, ts FROM events_v WHERE ts >= 1705000000")
def snk_audit(spark, d):
    return feed.retained(V.events(spark, d).select("id", "path", "ts"), 1705000000, "ts")


_NOT_UNDER = "NOT EXISTS (SELECT 1 FROM catalog_v c WHERE starts_with(a.path, c.path || '/'))"


def _manifest(spark, d, how="left_anti"):
    return reports.under(V.active(spark, d), V.catalog(spark, d), how)


@query("snk_manifest", f"""SELECT '{{"path":"' || path || '","content_hash":"' || content_hash || '","byte_size":' || coalesce(byte_size, 0) || '}}' AS line FROM active_v a WHERE {_NOT_UNDER}""")
def snk_manifest(spark, d):
    return _manifest(spark, d).select(F.to_json(F.struct("path", "content_hash", F.coalesce("byte_size", F.lit(0)).alias("byte_size"))).alias("line"))


@query("jn_manifest_anti", f"SELECT path, content_hash FROM active_v a WHERE {_NOT_UNDER}")
def jn_manifest_anti(spark, d):
    return _manifest(spark, d).select("path", "content_hash")


@query("jn_manifest_semi", f"SELECT path, content_hash FROM active_v a WHERE NOT ({_NOT_UNDER})")
def jn_manifest_semi(spark, d):
    return _manifest(spark, d, "left_semi").select("path", "content_hash")


@query("srt_manifest", f"SELECT path FROM active_v a WHERE {_NOT_UNDER} ORDER BY path")
def srt_manifest(spark, d):
    return _manifest(spark, d).select("path").orderBy("path")


_SIZE = "CASE WHEN {b} >= 1073741824 THEN printf('%.1f GB', {b} / 1073741824.0) WHEN {b} >= 1048576 THEN printf('%.1f MB', {b} / 1048576.0) WHEN {b} >= 1024 THEN printf('%.1f KB', {b} / 1024.0) ELSE printf('%d B', {b}) END"

# ---- predicates and projections


@query("flt_active", "SELECT path FROM files_v WHERE disappeared IS NULL")
def flt_active(spark, d):
    return V.paths(spark, d).where("disappeared is null").select("path")


@query("flt_like_ci", "SELECT path FROM active_v WHERE path ILIKE '%FILM%'")
def flt_like_ci(spark, d):
    return V.active(spark, d).where(F.col("path").ilike("%FILM%")).select("path")


@query("flt_like_escape", r"SELECT path FROM active_v WHERE path ILIKE '%doc\_1%' ESCAPE '\'")
def flt_like_escape(spark, d):
    return V.active(spark, d).where(predicates.like_ci(F.col("path"), r"%doc\_1%")).select("path")


@query("flt_glob", "SELECT path FROM active_v WHERE regexp_matches(path, '^.*/id_rsa.*$')")
def flt_glob(spark, d):
    return V.active(spark, d).where(predicates.glob(F.col("path"), "*/id_rsa*")).select("path")


@query("flt_prefix_like", "SELECT path FROM active_v WHERE starts_with(path, '/r1/s2')")
def flt_prefix_like(spark, d):
    return V.active(spark, d).where(F.col("path").startswith("/r1/s2")).select("path")


@query("flt_ext_suffix", "SELECT path FROM active_v WHERE lower(path) LIKE '%.mp4'")
def flt_ext_suffix(spark, d):
    return V.active(spark, d).where(predicates.has_suffix(F.col("path"), ".MP4")).select("path")


@query("flt_min_bytes", "SELECT path, total_bytes FROM catalog_v WHERE total_bytes >= 4000")
def flt_min_bytes(spark, d):
    return V.catalog(spark, d).where("total_bytes >= 4000").select("path", "total_bytes")


@query("flt_time_range", "SELECT id FROM events_v WHERE ts >= 1704500000 AND ts <= 1705500000")
def flt_time_range(spark, d):
    return V.events(spark, d).where(F.col("ts").between(1704500000, 1705500000)).select("id")


_POLICY = r"""browser_cookies|lower(path) LIKE '%/cookies%' OR lower(path) LIKE '%cookies.sqlite%'
env_files|regexp_matches(path, '/[.]env$|/[.]env[.]|/[.]envrc$')
private_keys|regexp_matches(lower(path), '[.](pem|key|pfx|kdbx)$') OR contains(path, '/id_rsa')
secret_dirs|lower(path) LIKE '%/.ssh/%' OR lower(path) LIKE '%/.aws/%' OR lower(path) LIKE '%/.gnupg/%'
escaped_generated_dirs|regexp_matches(path, '/(node_modules|target|build|[.]cache|[.]local|__pycache__|[.]dart_tool|[.]dart-tool|[.]gradle|[.]rustup)/')"""
_POLICY_SQL = " UNION ALL ".join(
    f"SELECT path, '{c}' AS category FROM files_v WHERE disappeared IS NULL AND ({w})" for c, w in (x.split("|", 1) for x in _POLICY.split("\n"))
)


@query("flt_policy", _POLICY_SQL)
def flt_policy(spark, d):
    return predicates.violations(V.paths(spark, d).where("disappeared is null")).select("path", "category")


@query("agg_policy_count", f"SELECT category, count(*) AS n, array_to_string(list_sort(list(path))[1:5], ',') AS examples FROM ({_POLICY_SQL}) v GROUP BY category")
def agg_policy_count(spark, d):
    return predicates.violation_counts(V.paths(spark, d).where("disappeared is null")).select("category", "n", F.array_join("examples", ",").alias("examples"))


@query("flt_needs_hash", """SELECT c.path, NOT (p.mtime IS NOT DISTINCT FROM c.mtime AND p.size_bytes IS NOT DISTINCT FROM c.size_bytes AND p.path IS NOT NULL) AS needs_hash
  FROM cur_v c LEFT JOIN (SELECT path, mtime, size_bytes FROM files_v WHERE disappeared IS NULL) p ON p.path = c.path""", V.SNAP_SQL)
def flt_needs_hash(spark, d):
    return diff.needs_hash(V.snapshots(spark, d)[1].drop("content_hash"), V.paths(spark, d).where("disappeared is null")).select("path", "needs_hash")


_IGNORED_RE = r"(^|/)([.]git|[.]aws|[.]gnupg|[.]ssh)/|(^|/)([^/]*[.](swp|tmp|pyc|pem|key|pfx|kdbx)|[^/]*~|[.]env|[.]env[.][^/]*|[.]envrc|id_rsa[^/]*|secrets[.][^/]*|credentials[^/]*|[cC]ookies[^/]*)(/|$)"
_CATALOG_DIRS = r"/([.]rustup|node_modules|target|[.]flutter|__pycache__|[.]cache|build|[.]gradle|[.]dart_tool|[.]dart-tool|[.]yay)/|/[.]local/share/Trash/"
_TIER = f"CASE WHEN regexp_matches(path, '{_IGNORED_RE}') THEN 'ignored' WHEN regexp_matches(path, '{_CATALOG_DIRS}') THEN 'cataloged' ELSE 'indexed' END"
_OWN_TIER = f"CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^([^/]*[.](swp|tmp|pyc|pem|key|pfx|kdbx)|[^/]*~|[.]env|[.]env[.][^/]*|[.]envrc|id_rsa[^/]*|secrets[.][^/]*|credentials[^/]*|[cC]ookies[^/]*)$') THEN 'ignored' ELSE 'indexed' END"
_DEFAULT = policy.default_rules("/")


@query("flt_classify", f"SELECT path, {_TIER} AS tier FROM files_v")
def flt_classify(spark, d):
    return V.paths(spark, d).select("path", policy.tier_name(policy.tree_tier([_DEFAULT], F.col("path"))).alias("tier"))


query("pol_subtree", f"SELECT path, {_TIER} AS tier FROM files_v WHERE {_TIER} <> 'indexed'")(lambda s, d: flt_classify(s, d).where("tier <> 'indexed'"))
query("pol_defaults", f"SELECT {_TIER} AS tier, count(*) AS n FROM files_v GROUP BY 1")(lambda s, d: flt_classify(s, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n")))
query("pol_event_path", f"SELECT DISTINCT path, {_TIER} AS tier FROM events_v")(
    lambda s, d: V.events(s, d).select("path").distinct().select("path", policy.tier_name(policy.tree_tier([_DEFAULT], F.col("path"))).alias("tier"))
)


@query("pol_match", f"SELECT path, {_OWN_TIER} AS tier FROM files_v")
def pol_match(spark, d):
    return V.paths(spark, d).select("path", policy.tier_name(policy.tier([_DEFAULT], F.col("path"), F.lit(False))).alias("tier"))


_LAYER = policy.parse_rules("*.txt\n!doc_*.txt\n[catalog]\n*.md\n", "/r1")


@query("pol_layer", f"""SELECT path, CASE WHEN starts_with(path, '/r1/') AND regexp_matches(path, '[.]txt$') AND NOT regexp_matches(path, '/doc_[^/]*[.]txt$') THEN 'ignored'
  WHEN starts_with(path, '/r1/') AND regexp_matches(path, '[.]md$') THEN 'cataloged' ELSE {_OWN_TIER} END AS tier FROM files_v""")
def pol_layer(spark, d):
    return V.paths(spark, d).select("path", policy.tier_name(policy.tier([_DEFAULT, _LAYER], F.col("path"), F.lit(False))).alias("tier"))


_RULES_OF = {"s": "*.md\n!doc_2*.md\n[catalog]\n*.json\n", "l0": "[catalog]\n*.md\n*.tar.gz\n", "l1": "media/\n", "l2": "[catalog]\n*.md\n*.tar.gz\n"}
_S_DIR, _L_DIR = r"^(/[^/]*/s[^/]*)/", r"^(/[^/]*/s[^/]*/l[^/]*)/"


@query("pol_layer_rows", f"""SELECT path, CASE greatest(CASE own WHEN 'ignored' THEN 2 WHEN 'cataloged' THEN 1 ELSE 0 END, CASE WHEN regexp_matches(dir || '/', '{_IGNORED_RE}') OR regexp_matches(path, '^/[^/]*/s[^/]*/l1/media/') THEN 2
    WHEN regexp_matches(dir || '/', '{_CATALOG_DIRS}') THEN 1 ELSE 0 END) WHEN 2 THEN 'ignored' WHEN 1 THEN 'cataloged' ELSE 'indexed' END AS tier
  FROM (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN regexp_matches(path, '^/[^/]*/s[^/]*/l[02]/.*([.]md|[.]tar[.]gz)$') THEN 'cataloged'
    WHEN regexp_matches(path, '[.]md$') AND NOT regexp_matches(path, '/doc_2[^/]*$') THEN 'ignored' WHEN regexp_matches(path, '[.]json$') THEN 'cataloged' ELSE {_OWN_TIER} END AS own FROM files_v) x""")
def pol_layer_rows(spark, d):
    """An ignore file in each directory of the second and third level, as rows."""
    p = V.paths(spark, d).select("path")
    low = p.select(F.regexp_extract("path", _L_DIR, 1).alias("base")).distinct()
    text = F.element_at(F.create_map(*(F.lit(x) for pair in _RULES_OF.items() for x in pair)), F.regexp_extract("base", "/(l[^/]*)$", 1))
    files = low.select("base", text.alias("text")).where("text is not null")
    files = files.unionByName(p.select(F.regexp_extract("path", _S_DIR, 1).alias("base")).distinct().withColumn("text", F.lit(_RULES_OF["s"])))
    return policy.layered_tier(p, written(policy.rule_rows(files), "rules"), [_DEFAULT]).select("path", policy.tier_name(F.col("tier")).alias("tier"))


_USER = policy.parse_rules("*.json\n", "/")


@query("pol_combine", f"SELECT path, CASE WHEN regexp_matches(path, '[.]json$') THEN 'ignored' ELSE {_TIER} END AS tier FROM files_v")
def pol_combine(spark, d):
    both = policy.combined(policy.tree_tier([_DEFAULT], F.col("path")), policy.tree_tier([_USER], F.col("path")))
    return V.paths(spark, d).select("path", policy.tier_name(both).alias("tier"))


_FILE = policy.parse_rules("[ad]oc_*.txt\n\t*.json\t\n   [catalog]\n  *.md\n[cf]ert_*\n[no-embed]\n*.gz\n", "/r1")


@query("pol_parse", r"""SELECT path, CASE WHEN regexp_matches(path, '^/r1/(.*/)?([ad]oc_[^/]*[.]txt|[^/]*[.]json)$') THEN 'ignored'
  WHEN regexp_matches(path, '^/r1/(.*/)?([^/]*[.]md|[cf]ert_[^/]*)$') THEN 'cataloged' ELSE 'indexed' END AS tier FROM files_v""")
def pol_parse(spark, d):
    return V.paths(spark, d).select("path", policy.tier_name(policy.tier([_FILE], F.col("path"), F.lit(False))).alias("tier"))


@query("prj_topics", "SELECT content_hash, lang || ',' || source AS topics FROM documents_v")
def prj_topics(spark, d):
    as_json = V.documents(spark, d).select("content_hash", F.to_json(F.array("lang", "source")).alias("topics"))
    return as_json.select("content_hash", F.array_join(F.coalesce(F.from_json("topics", "array<string>"), F.array().cast("array<string>")), ",").alias("topics"))


@query("prj_byte_size0", "SELECT path, coalesce(byte_size, 0) AS byte_size FROM active_v")
def prj_byte_size0(spark, d):
    return V.active(spark, d).select("path", F.coalesce("byte_size", F.lit(0)).alias("byte_size"))


@query("prj_ndjson", """SELECT '{"path":"' || path || '","mtime":' || mtime || '}' AS line FROM active_v""")
def prj_ndjson(spark, d):
    return V.active(spark, d).select(F.to_json(F.struct("path", "mtime")).alias("line"))


# ---- joins


@query("jn_paths_docs", "SELECT path, content_hash, title, byte_size FROM active_v")
def jn_paths_docs(spark, d):
    return V.active(spark, d).select("path", "content_hash", "title", "byte_size")


@query("jn_hit_path", """SELECT x.content_hash, coalesce(p.path, '(no current path)') AS path FROM documents_v x
  LEFT JOIN (SELECT content_hash, min(path) AS path FROM files_v WHERE disappeared IS NULL GROUP BY content_hash) p USING (content_hash)""")
def jn_hit_path(spark, d):
    return search.any_path(V.documents(spark, d).select("content_hash"), V.paths(spark, d))


@query("jn_hash_paths", "SELECT x.content_hash, x.doc_id, p.path FROM documents_v x JOIN files_v p ON p.content_hash = x.content_hash WHERE p.disappeared IS NULL")
def jn_hash_paths(spark, d):
    return V.documents(spark, d).select("content_hash", "doc_id").join(V.paths(spark, d).where("disappeared is null").select("content_hash", "path"), "content_hash")


@query("jn_path_hash", "SELECT path, content_hash FROM files_v WHERE disappeared IS NULL AND path = '/r1/s1/l1/doc_2.txt'")
def jn_path_hash(spark, d):
    return V.paths(spark, d).where("disappeared is null and path = '/r1/s1/l1/doc_2.txt'").select("path", "content_hash")


_REDUNDANT = f"""SELECT t.path, t.content_hash, coalesce(t.byte_size, 0) AS size_bytes, count(*) AS n_elsewhere, min(o.path) AS also_at
  FROM active_v t JOIN active_v o ON o.content_hash = t.content_hash AND o.root <> '{ROOT}' WHERE t.root = '{ROOT}' GROUP BY t.path, t.content_hash, t.byte_size"""
_CANDIDATES = f"""SELECT t.path, coalesce(t.byte_size, 0) AS size_bytes, o.path AS newer_path, t.mtime AS target_mtime, o.mtime AS other_mtime,
  row_number() OVER (PARTITION BY t.path ORDER BY o.mtime DESC, o.path) AS rn
  FROM active_v t JOIN active_v o ON o.root <> '{ROOT}' AND o.content_hash <> t.content_hash AND ends_with(o.path, '/' || substring(t.path, {len(ROOT) + 2})) WHERE t.root = '{ROOT}'"""
_STALE = f"SELECT path, size_bytes, newer_path, target_mtime, other_mtime FROM ({_CANDIDATES}) c WHERE rn = 1 AND other_mtime > target_mtime"


@query("jn_redundant", _REDUNDANT)
def jn_redundant(spark, d):
    return reports.redundant(V.active(spark, d), ROOT)


@query("jn_copies", f"SELECT content_hash, path FROM active_v WHERE root <> '{ROOT}' AND content_hash IN (SELECT content_hash FROM active_v WHERE root = '{ROOT}')")
def jn_copies(spark, d):
    return reports.copies(V.active(spark, d), ROOT)


@query("jn_stale", _STALE)
def jn_stale(spark, d):
    return reports.stale(V.active(spark, d), ROOT)


_REQUESTS = """SELECT id, CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'complete' ELSE 'failed' END AS status, CASE WHEN id % 4 = 2 THEN id END AS scan_run_id, ts FROM events_v WHERE event_type = 'created'"""
_RUNS = "SELECT id, ts AS started, ts + id % 1000 AS finished, id % 50 AS files_seen FROM events_v WHERE event_type = 'created' AND id % 3 = 0"


def _requests(spark, d):
    e = V.events(spark, d).where("event_type = 'created'")
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "complete", "failed"))), (F.col("id") % 4 + 1).cast("int"))
    return e.select("id", status.alias("status"), F.when(F.col("id") % 4 == 2, F.col("id")).alias("scan_run_id"), F.timestamp_seconds("ts").alias("requested_at"), F.lit(None).cast("string").alias("error"))


def _runs(spark, d):
    e = V.events(spark, d).where("event_type = 'created' and id % 3 = 0")
    return e.select("id", F.timestamp_seconds("ts").alias("started_at"), F.timestamp_seconds(F.col("ts") + F.col("id") % 1000).alias("finished_at"), (F.col("id") % 50).alias("files_seen"))


_PROGRESS = f"SELECT q.id, q.status, q.scan_run_id, r.files_seen, (r.finished - r.started) * 1000 AS duration_ms FROM ({_REQUESTS}) q LEFT JOIN ({_RUNS}) r ON r.id = q.scan_run_id"
query("jn_scan_req", _PROGRESS)(lambda s, d: feed.progress(_requests(s, d), _runs(s, d)).drop("error"))
query("q_poll", _PROGRESS)(lambda s, d: feed.progress(_requests(s, d), _runs(s, d)).drop("error"))
query("fn_duration", f"SELECT id, (finished - started) * 1000 AS ms FROM ({_RUNS}) r")(
    lambda s, d: _runs(s, d).select("id", (F.unix_millis("finished_at") - F.unix_millis("started_at")).alias("ms"))
)
query("fifo_claim", f"SELECT id FROM ({_REQUESTS}) q WHERE status = 'pending' ORDER BY ts, id LIMIT 1")(lambda s, d: feed.oldest_pending(_requests(s, d)).select("id"))
query("st_recover", f"SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'restarted' END AS error FROM ({_REQUESTS}) q")(
    lambda s, d: feed.recovered(_requests(s, d), "restarted").select("id", "status", "error")
)


@query("jn_rule_root", "SELECT path, CASE WHEN starts_with(path, '/r0/s1/') THEN '/r0/s1' WHEN starts_with(path, '/r0/') THEN '/r0' WHEN starts_with(path, '/r2/') THEN '/r2' END AS rule_root FROM files_v")
def jn_rule_root(spark, d):
    return V.paths(spark, d).select("path", predicates.first_root(F.col("path"), ["/r0/s1", "/r0", "/r2"]).alias("rule_root"))


_RAW = "SELECT path AS key, ts * 1000 AS ms, id, CASE event_type WHEN 'updated' THEN 'Modify' WHEN 'created' THEN 'Create' WHEN 'deleted' THEN 'Delete' WHEN 'moved' THEN 'MovedFrom' ELSE 'MovedTo' END AS kind, id // 8 AS cookie FROM events_v"
_PAIR_MS = 3_600_000
_PAIRED = f"""SELECT key, ms, kind, NULL AS from_key FROM ({_RAW}) x WHERE kind NOT IN ('MovedFrom', 'MovedTo') UNION ALL
  SELECT key, CASE WHEN kind = 'MovedFrom' THEN ms + {_PAIR_MS} ELSE ms END AS ms, CASE WHEN kind = 'MovedFrom' THEN 'Delete' WHEN hit THEN 'Moved' ELSE 'Create' END AS kind, CASE WHEN kind = 'MovedTo' AND hit THEN key0 END AS from_key
  FROM (SELECT *, coalesce(k0 = 'MovedFrom' AND ms - ms0 <= {_PAIR_MS}, false) AS hit, coalesce(k1 = 'MovedTo' AND ms1 - ms <= {_PAIR_MS}, false) AS used FROM (
    SELECT *, lag(kind) OVER w AS k0, lag(key) OVER w AS key0, lag(ms) OVER w AS ms0, lead(kind) OVER w AS k1, lead(ms) OVER w AS ms1
    FROM ({_RAW}) r WHERE kind IN ('MovedFrom', 'MovedTo') WINDOW w AS (PARTITION BY cookie ORDER BY ms, kind)) s) t WHERE kind = 'MovedTo' OR NOT used"""


def _raw_events(spark, d):
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in (("updated", "Modify"), ("created", "Create"), ("deleted", "Delete"), ("moved", "MovedFrom"), ("minor_change", "MovedTo")) for x in pair)), F.col("event_type"))
    return V.events(spark, d).select(F.col("path").alias("key"), (F.col("ts") * 1000).alias("ms"), "id", kind.alias("kind"), F.expr("id div 8").alias("cookie"))


query("jn_cookie", _PAIRED)(lambda s, d: debounce.paired(_raw_events(s, d), _PAIR_MS))
query("st_move_pair", f"SELECT key, ms, from_key FROM ({_PAIRED}) p WHERE kind = 'Moved'")(
    lambda s, d: debounce.paired(_raw_events(s, d), _PAIR_MS).where("kind = 'Moved'").select("key", "ms", "from_key")
)
_IDLE_MS, _CAP_MS = 14_400_000, 43_200_000
_PLAIN = "SELECT path AS key, ts * 1000 AS ms, CASE event_type WHEN 'updated' THEN 'Modify' WHEN 'created' THEN 'Create' ELSE 'Delete' END AS kind FROM events_v WHERE event_type IN ('updated', 'created', 'deleted')"
_FLUSHES = f""", plain_v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, kind) AS rn FROM ({_PLAIN}) p),
  walk_v AS (SELECT key, rn, ms, kind, ms AS first_ms, 1 AS g FROM plain_v WHERE rn = 1 UNION ALL
    SELECT n.key, n.rn, n.ms, n.kind, CASE WHEN n.ms >= least(w.ms + {_IDLE_MS}, w.first_ms + {_CAP_MS}) THEN n.ms ELSE w.first_ms END,
      CASE WHEN n.ms >= least(w.ms + {_IDLE_MS}, w.first_ms + {_CAP_MS}) THEN w.g + 1 ELSE w.g END FROM walk_v w JOIN plain_v n ON n.key = w.key AND n.rn = w.rn + 1)
  SELECT key, max_by(kind, rn) AS kind, min(first_ms) AS first_ms, least(max(ms) + {_IDLE_MS}, min(first_ms) + {_CAP_MS}) AS flush_ms FROM walk_v GROUP BY key, g"""


def _flushes(spark, d):
    e = _raw_events(spark, d).where("kind not in ('MovedFrom', 'MovedTo')").withColumn("from_key", F.lit(None).cast("string"))
    return debounce.replay(e, _IDLE_MS, _CAP_MS).drop("from_key")


query("st_debounce", _FLUSHES)(_flushes)
query("st_deadline", _FLUSHES.replace("SELECT key, max_by(kind, rn) AS kind, min(first_ms) AS first_ms, least", "SELECT key, least"))(lambda s, d: _flushes(s, d).select("key", "flush_ms"))
query("st_drain", _FLUSHES.replace("SELECT key, max_by(kind, rn) AS kind, min(first_ms) AS first_ms, least(max(ms) + {0}, min(first_ms) + {1}) AS flush_ms FROM walk_v GROUP BY key, g".format(_IDLE_MS, _CAP_MS), "SELECT key, max(g) AS n FROM walk_v GROUP BY key"))(
    lambda s, d: _flushes(s, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
)
query("st_map", "SELECT key, ms, kind FROM (SELECT path AS key, ts * 1000 AS ms, CASE event_type WHEN 'updated' THEN 'Modify' WHEN 'created' THEN 'Create' WHEN 'deleted' THEN 'Delete' WHEN 'moved' THEN 'MovedFrom' END AS kind FROM events_v) x WHERE kind IS NOT NULL")(
    lambda s, d: debounce.mapped(
        V.events(s, d).select(
            F.col("path").alias("key"), (F.col("ts") * 1000).alias("ms"),
            F.element_at(F.create_map(*(F.lit(x) for p in (("updated", "modify_data"), ("created", "create_file"), ("deleted", "remove_file"), ("moved", "rename_from"), ("minor_change", "access")) for x in p)), F.col("event_type")).alias("raw"),
        )
    )
)

_CLOSED_MS = 1_800_000
_CLOSING = "SELECT path AS key, ts * 1000 AS ms, CASE event_type WHEN 'updated' THEN 'Modify' WHEN 'created' THEN 'Create' WHEN 'deleted' THEN 'Delete' ELSE 'CloseWrite' END AS kind FROM events_v WHERE event_type <> 'moved'"
_DUE = f"least(w.ms + CASE WHEN w.closed THEN {_CLOSED_MS} ELSE {_IDLE_MS} END, w.first_ms + {_CAP_MS})"
_CLOSED_FLUSHES = f""", plain_v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, kind) AS rn FROM ({_CLOSING}) p),
  walk_v AS (SELECT key, rn, ms, CASE WHEN kind = 'CloseWrite' THEN 'Modify' ELSE kind END AS kind, kind = 'CloseWrite' AS closed, ms AS first_ms, 1 AS g FROM plain_v WHERE rn = 1 UNION ALL
    SELECT n.key, n.rn, n.ms, CASE WHEN n.kind <> 'CloseWrite' THEN n.kind WHEN n.ms >= {_DUE} THEN 'Modify' ELSE w.kind END, n.kind = 'CloseWrite',
      CASE WHEN n.ms >= {_DUE} THEN n.ms ELSE w.first_ms END, CASE WHEN n.ms >= {_DUE} THEN w.g + 1 ELSE w.g END FROM walk_v w JOIN plain_v n ON n.key = w.key AND n.rn = w.rn + 1)
  SELECT key, kind, first_ms, {_DUE} AS flush_ms FROM (SELECT *, row_number() OVER (PARTITION BY key, g ORDER BY rn DESC) AS back FROM walk_v) w WHERE back = 1"""


@query("st_closewrite", _CLOSED_FLUSHES)
def st_closewrite(spark, d):
    kinds = F.create_map(*(F.lit(x) for pair in (("updated", "Modify"), ("created", "Create"), ("deleted", "Delete"), ("minor_change", "CloseWrite")) for x in pair))
    e = V.events(spark, d).where("event_type <> 'moved'").select(
        F.col("path").alias("key"), (F.col("ts") * 1000).alias("ms"), F.element_at(kinds, F.col("event_type")).alias("kind"), F.lit(None).cast("string").alias("from_key")
    )
    return debounce.replay(e, _IDLE_MS, _CAP_MS, _CLOSED_MS).drop("from_key")


_BEATS = "SELECT path AS name, CASE event_type WHEN 'deleted' THEN 'stopped' ELSE 'running' END AS state, ts AS beat FROM events_v"


@query("st_heartbeat", f"""SELECT name, state, 1706659200 - beat AS age, state <> 'stopped' AND 1706659200 - beat <= 86400 AS running
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY beat DESC, state DESC) AS rn FROM ({_BEATS}) b) x WHERE rn = 1""")
def st_heartbeat(spark, d):
    state = F.when(F.col("event_type") == "deleted", "stopped").otherwise("running")
    return feed.alive(V.events(spark, d).select(F.col("path").alias("name"), state.alias("state"), F.col("ts").alias("at")), 1706659200, 86400)


_FIRST_PENDING = f"(SELECT id FROM ({_REQUESTS}) q WHERE status = 'pending' ORDER BY ts, id LIMIT 1)"


@query("q_claim", f"SELECT id, CASE WHEN id = {_FIRST_PENDING} THEN 'running' ELSE status END AS status FROM ({_REQUESTS}) q")
def q_claim(spark, d):
    from datetime import datetime

    rows = _requests(spark, d).withColumn("started_at", F.lit(None).cast("timestamp"))
    return feed.claim(rows, datetime(2024, 2, 1))[1].select("id", "status")


def _finished(spark, d, error=None):
    from datetime import datetime

    rows = _requests(spark, d).where("id % 4 = 1").withColumn("completed_at", F.lit(None).cast("timestamp"))
    first = rows.agg(F.min("id")).first()[0]
    return feed.finish(rows, first, datetime(2024, 2, 1), run_id=7, error=error).select("id", "status", "scan_run_id", "error")


_RUNNING = f"SELECT id, status, scan_run_id FROM ({_REQUESTS}) q WHERE id % 4 = 1"
_FINISHED = "SELECT id, CASE WHEN id = m THEN '{0}' ELSE status END AS status, CASE WHEN id = m THEN 7 ELSE scan_run_id END AS scan_run_id, CASE WHEN id = m THEN {1} END AS error FROM (SELECT *, min(id) OVER () AS m FROM ({2}) r) x"
query("q_complete", _FINISHED.format("complete", "CAST(NULL AS VARCHAR)", _RUNNING))(_finished)
query("q_fail", _FINISHED.format("failed", "'disk full'", _RUNNING))(lambda s, d: _finished(s, d, "disk full"))

# ---- aggregates

_TIER1 = "count(*) AS files, CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS bytes"


def _tier1(rows: DataFrame, *by) -> DataFrame:
    sums = (F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))
    return rows.groupBy(*by).agg(*sums)


query("agg_tier1_total", f"SELECT {_TIER1} FROM active_v")(lambda s, d: _tier1(V.active(s, d)))
query("agg_by_ext", f"SELECT coalesce('.' || ext, '(none)') AS ext, {_TIER1} FROM {EXTS} x GROUP BY 1")(
    lambda s, d: _tier1(V.active(s, d).withColumn("ext", P.extension_label(F.col("path"))), "ext")
)
query("agg_tier2_total", "SELECT count(*) AS dirs, CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS bytes FROM catalog_v")(
    lambda s, d: V.catalog(s, d).agg(F.count(F.lit(1)).alias("dirs"), F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("bytes"))
)
_COUNTS = """SELECT (SELECT count(*) FROM documents_v) AS total_documents, (SELECT count(*) FROM files_v) AS total_paths_all, (SELECT count(*) FROM files_v WHERE disappeared IS NULL) AS total_active_paths,
  (SELECT count(*) FROM documents_v WHERE NOT is_binary) AS total_fts_rows, (SELECT count(*) FROM catalog_v) AS total_cataloged"""


def _counts(spark, d):
    n = F.count(F.lit(1))
    p = V.paths(spark, d).agg(n.alias("total_paths_all"), F.count_if(F.col("disappeared").isNull()).alias("total_active_paths"))
    x = V.documents(spark, d).agg(n.alias("total_documents"), F.count_if(~F.col("is_binary")).alias("total_fts_rows"))
    return p.join(F.broadcast(x)).join(F.broadcast(V.catalog(spark, d).agg(n.alias("total_cataloged"))))  # one row each


query("agg_counts", _COUNTS)(_counts)
query("fts_total", "SELECT count(*) AS total_indexed FROM documents_v")(lambda s, d: V.documents(s, d).agg(F.count(F.lit(1)).alias("total_indexed")))
_VERSIONS = "SELECT e.path, CASE WHEN e.path IN (SELECT path FROM events_v WHERE event_type = 'created') THEN count(DISTINCT content_hash) ELSE 0 END AS versions FROM events_v e GROUP BY e.path"


def _versions(spark, d):
    e = V.events(spark, d)
    return feed.versions(e, e.where("event_type = 'created'"))


query("agg_versions", _VERSIONS)(_versions)
_DUPS = "SELECT content_hash, max(byte_size) AS size_bytes, list_sort(list(path)) AS p FROM active_v GROUP BY content_hash HAVING count(*) > 1"
query("agg_dup_groups", f"SELECT content_hash, size_bytes, len(p) AS n_paths, unnest(p) AS path FROM ({_DUPS}) x")(lambda s, d: reports.duplicates(V.active(s, d)))
_STATS = f"SELECT dir, CAST(sum(coalesce(byte_size, 0)) AS BIGINT) AS total_bytes, count(*) AS file_count, count(ext) AS with_ext FROM {EXTS} x GROUP BY dir"
query("agg_dir_stats", _STATS)(lambda s, d: reports.directory_stats(V.active(s, d)))
_FAMILY = f"CASE WHEN ext IN {P.AUDIO} THEN 'audio' WHEN ext IN {P.VIDEO} THEN 'video' WHEN ext IN {P.IMAGE} THEN 'image' END"
_MEDIA = {"least_bytes": 1000, "least_files": 2, "share": 0.5}
_SHARES = f"""SELECT m.dir, m.family, st.total_bytes, st.file_count, round(m.n / st.with_ext, 9) AS share, m.exts FROM (
    SELECT dir, family, sum(n) AS n, string_agg('.' || ext, '/' ORDER BY rn) FILTER (WHERE rn <= 3) AS exts FROM (
      SELECT *, row_number() OVER (PARTITION BY dir, family ORDER BY n DESC, ext) AS rn FROM (
        SELECT dir, ext, {_FAMILY} AS family, count(*) AS n FROM {EXTS} x WHERE ext IS NOT NULL GROUP BY dir, ext) a WHERE family IS NOT NULL) b GROUP BY dir, family) m
  JOIN ({_STATS}) st ON st.dir = m.dir WHERE m.n / st.with_ext > 0.5 AND st.total_bytes >= 1000 AND st.file_count >= 2"""
query("agg_media_share", _SHARES)(lambda s, d: reports.media_shares(V.active(s, d), **_MEDIA).withColumn("share", F.round("share", 9)))
_PAIRS = f"""SELECT dir_a, dir_b, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS n_groups FROM (
    SELECT regexp_extract(p[1], '^(.*)/[^/]*$', 1) AS dir_a, regexp_extract(p[2], '^(.*)/[^/]*$', 1) AS dir_b, size_bytes FROM ({_DUPS}) x WHERE len(p) = 2) y WHERE dir_a <> dir_b GROUP BY dir_a, dir_b"""
query("agg_dir_pairs", _PAIRS)(lambda s, d: reports.directory_pairs(reports.duplicates(V.active(s, d)), least=1)[0])
query("agg_redundant_bytes", f"SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS redundant_bytes FROM ({_REDUNDANT}) x")(
    lambda s, d: reports.redundant(V.active(s, d), ROOT).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("redundant_bytes"))
)
query("agg_min_id", "SELECT min(id) AS min_id FROM events_v")(lambda s, d: V.events(s, d).agg(F.min("id").alias("min_id")))
query("agg_hash_paths", "SELECT content_hash, count(DISTINCT path) AS n_paths FROM prev_v GROUP BY content_hash", V.SNAP_SQL)(
    lambda s, d: V.snapshots(s, d)[0].groupBy("content_hash").agg(F.count_distinct("path").alias("n_paths"))
)
query("agg_inode_paths", "SELECT dev, inode, count(DISTINCT path) AS n_paths, min(path) AS first_path FROM cur_v GROUP BY dev, inode", V.SNAP_SQL)(
    lambda s, d: V.snapshots(s, d)[1].groupBy("dev", "inode").agg(F.count_distinct("path").alias("n_paths"), F.min("path").alias("first_path"))
)

# ---- order, limits, paging

query("top_size", "SELECT path, byte_size FROM active_v ORDER BY byte_size DESC NULLS LAST, path LIMIT 200")(
    lambda s, d: V.active(s, d).orderBy(F.desc_nulls_last("byte_size"), "path").limit(200).select("path", "byte_size")
)
query("top_catalog", "SELECT path, total_bytes, file_count FROM catalog_v ORDER BY total_bytes DESC, path LIMIT 20")(
    lambda s, d: V.catalog(s, d).orderBy(F.desc("total_bytes"), "path").limit(20)
)
query("top_map", "SELECT path, title FROM active_v WHERE starts_with(path, '/r1') ORDER BY path LIMIT 500")(
    lambda s, d: V.active(s, d).where(F.col("path").startswith("/r1")).orderBy("path").limit(500).select("path", "title")
)
query("srt_history", "SELECT id, ts FROM events_v WHERE path = '/u/7.txt' ORDER BY ts, id")(
    lambda s, d: feed.history(V.events(s, d).withColumn("timestamp", F.col("ts")), "/u/7.txt").select("id", "ts")
)
query("srt_reports", f"SELECT path, size_bytes FROM ({_REDUNDANT}) r ORDER BY size_bytes DESC, path")(
    lambda s, d: reports.redundant(V.active(s, d), ROOT).orderBy(F.desc("size_bytes"), "path").select("path", "size_bytes")
)
_SCORE = f"""100 - CASE {_TIER} WHEN 'cataloged' THEN 50 WHEN 'ignored' THEN 80 ELSE 0 END
  - CASE WHEN near_dir IN {P.REGENERABLE} THEN 40 WHEN near_dir IN {P.PASSING_DIRS} THEN 30 ELSE 0 END
  - CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')), 'backup|copy|old') THEN 20 ELSE 0 END - len(string_split(path, '/'))"""
_SCORED = f"""(SELECT *, list_filter(list_reverse(list_transform(string_split(path, '/')[2:-2], lambda x: lower(x))), lambda x: x IN {P.REGENERABLE + P.PASSING_DIRS})[1] AS near_dir FROM active_v)"""


def _tier_of(path: Column) -> Column:
    return policy.tier_name(policy.tree_tier([_DEFAULT], path))


query("fn_canonical_score", f"SELECT path, CAST({_SCORE} AS INTEGER) AS score FROM {_SCORED} x")(
    lambda s, d: V.active(s, d).select("path", P.canonical_score(F.col("path"), _tier_of(F.col("path"))).alias("score"))
)
_CANONICAL = f"""SELECT content_hash, path, CAST({_SCORE} AS INTEGER) AS score, first_value(path) OVER (PARTITION BY content_hash ORDER BY {_SCORE} DESC, path) AS canonical
  FROM {_SCORED} x QUALIFY count(*) OVER (PARTITION BY content_hash) > 1"""
query("srt_canonical", _CANONICAL)(
    lambda s, d: reports.canonical_order(reports.duplicates(V.active(s, d)), _tier_of(F.col("path"))).select("content_hash", "path", "score", "canonical")
)
query("pag_events", "SELECT id, event_type, path FROM events_v WHERE id > 250 ORDER BY id LIMIT 101")(
    lambda s, d: feed.after(V.events(s, d), 250, 100).select("id", "event_type", "path")
)
_EXPIRY = "SELECT min(id) <= 251 AS cursor_valid, CASE WHEN min(id) <= 251 THEN 250 ELSE 0 END AS cursor_after FROM (SELECT id FROM events_v WHERE ts >= 1704500000) x"
query("pag_expiry", _EXPIRY)(
    lambda s, d: feed.cursor_state(feed.retained(V.events(s, d), 1704500000, "ts"), 250)
)
query("top_latest", "SELECT id, path FROM events_v ORDER BY id DESC LIMIT 1")(lambda s, d: V.events(s, d).agg(F.max("id").alias("id"), F.max_by("path", "id").alias("path")))
@query("q_enqueue", f"SELECT id, status FROM ({_REQUESTS}) q UNION ALL SELECT max(id) + 1, 'pending' FROM ({_REQUESTS}) q")
def q_enqueue(spark, d):
    queue = _requests(spark, d).select(
        "id", "requested_at", F.lit("full").alias("kind"), F.array(F.lit(ROOT)).alias("root"), "status", "scan_run_id",
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), "error",
    )
    return feed.enqueue(queue, "full", [ROOT], None).select("id", "status")


query("q_scan_status", f"SELECT id, files_seen FROM ({_RUNS}) r ORDER BY id DESC LIMIT 1")(lambda s, d: _runs(s, d).agg(F.max("id").alias("id"), F.max_by("files_seen", "id").alias("files_seen")))

# ---- scalar functions

_FRONT = "CASE id % 5 WHEN 0 THEN concat('---', chr(10), 'a: ', id, chr(10), '---', chr(10), text) WHEN 1 THEN concat('+++', chr(10), 'b = ', id, chr(10), '+++', chr(10), text) WHEN 2 THEN concat('---', chr(10), text) ELSE text END"


def _fronted(spark, d):
    return V.files(spark, d).select("id", F.expr(_FRONT.replace("chr(10)", "char(10)")).alias("t"))


query("fn_hash", "SELECT id, sha256(text) AS h FROM files_v")(lambda s, d: V.files(s, d).select("id", X.sha256(F.col("text")).alias("h")))
_FRONTED = f"(SELECT id, text, {_FRONT} AS t FROM files_v)"
query("fn_split_frontmatter", f"SELECT id, CASE id % 5 WHEN 0 THEN concat('a: ', id) WHEN 1 THEN concat('b = ', id) END AS front, sha256(CASE WHEN id % 5 < 2 THEN text ELSE t END) AS body_hash FROM {_FRONTED} x")(
    lambda s, d: _fronted(s, d).select("id", X.frontmatter(F.col("t")).alias("front"), X.sha256(X.body(F.col("t"))).alias("body_hash"))
)
query("fn_body_hash", f"SELECT id, sha256(CASE WHEN id % 5 < 2 THEN text ELSE t END) AS body_hash FROM {_FRONTED} x")(
    lambda s, d: _fronted(s, d).select("id", X.sha256(X.body(F.col("t"))).alias("body_hash"))
)
query("fn_minor_change", "SELECT p.path, (p.content_hash <> c.content_hash) AND (p.body_hash = c.body_hash) AS minor FROM prev_v p JOIN cur_v c ON c.path = p.path", V.SNAP_SQL)(
    lambda s, d: (lambda p, c: p.alias("p").join(c.alias("c"), "path").select("path", X.is_minor_change(F.col("p.content_hash"), F.col("c.content_hash"), F.col("p.body_hash"), F.col("c.body_hash")).alias("minor")))(*V.snapshots(s, d))
)


def _zeroed(spark, d):
    """Whole texts as bytes; a zero byte is put within the first 8192 of each seventh, and right behind them in the other texts that are as long."""
    content = F.encode(F.col("text"), "UTF-8")
    size, within = F.octet_length(content), F.col("id") % 7 == 0
    at = F.when(within, F.least(size, F.lit(X.SNIFF_BYTES - 1))).when(size >= X.SNIFF_BYTES, F.lit(X.SNIFF_BYTES))
    put = F.concat(F.substring(content, F.lit(1), at), F.unhex(F.lit("00")), F.substring(content, at + 1, size))
    return V.files(spark, d).select("id", F.when(at.isNull(), content).otherwise(put).alias("content"), size.alias("size"))


query("fn_is_binary", "SELECT id, id % 7 = 0 AS is_binary FROM files_v")(lambda s, d: _zeroed(s, d).select("id", X.is_binary(F.col("content")).alias("is_binary")))
query("fn_extension", f"SELECT path, ext FROM {EXTS} x")(lambda s, d: V.active(s, d).select("path", P.extension(F.col("path")).alias("ext")))
query("fn_mime", f"SELECT path, {_MIME_CASE} AS mime FROM {EXTS} x")(lambda s, d: V.active(s, d).select("path", P.mime(F.col("path")).alias("mime")))
#: Whole texts as Markdown: a line's length says whether it is a heading, looks like one, or ends a paragraph.
_MARKED = "CASE length(x) % 5 WHEN 0 THEN concat('## ', x) WHEN 1 THEN concat('# ', x) WHEN 2 THEN concat('#', x) WHEN 3 THEN concat(x, chr(10)) ELSE x END"
_MD_SQL = rf"""{V.SQL}, lines_v AS (
  SELECT id, list_transform(string_split_regex(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_MARKED}), chr(10)), '\r?\n'), lambda x: rtrim(x)) AS w FROM files_v),
heads_v AS (
  SELECT id, w, list_transform(list_filter(w, lambda x: regexp_matches(x, '^#{{1,6}}( +.*)?$')),
    lambda x: {{'level': len(regexp_extract(x, '^(#{{1,6}})', 1)), 'heading': regexp_extract(x, '^#{{1,6}} +(.*)$', 1)}}) AS hs FROM lines_v),
blocks_v AS (
  SELECT id, hs, list_transform(string_split_regex(array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^#{{1,6}}( +.*)?$') THEN chr(1) ELSE x END), chr(10)), '\n\n+'),
    lambda x: trim(regexp_replace(x, '(?s)^.*\x01', ''), chr(10))) AS blocks FROM heads_v)"""


def _markdown(spark, d):
    return V.files(spark, d).select("id", F.expr(f"array_join(transform(split(text, '\n'), x -> {_MARKED}), '\n')").alias("t"))


@query("fn_title_summary_md", """SELECT id, list_filter(hs, lambda h: h.level = 1)[1].heading AS title,
  left(trim(replace(list_filter(blocks, lambda x: x <> '')[1], chr(10), ' ')), 200) AS summary FROM blocks_v""", _MD_SQL)
def fn_title_summary_md(spark, d):
    return _markdown(spark, d).select("id", X.markdown_title(F.col("t")).alias("title"), X.markdown_summary(F.col("t")).alias("summary"))


@query("fn_heading", "SELECT id, array_to_string(list_transform(hs, lambda h: concat(h.level, ':', h.heading)), chr(10)) AS headings FROM heads_v", _MD_SQL)
def fn_heading(spark, d):
    return _markdown(spark, d).select("id", F.array_join(F.transform(X.headings(F.col("t")), lambda h: F.concat_ws(":", h["level"].cast("string"), h["heading"])), "\n").alias("headings"))


@query("fn_topics", """SELECT id, array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), chr(10)) AS topics
  FROM (SELECT id, list_transform(hs, lambda h: lower(h.heading)) AS ts FROM heads_v) x""", _MD_SQL)
def fn_topics(spark, d):
    return _markdown(spark, d).select("id", F.array_join(X.topics(F.col("t")), "\n").alias("topics"))


query("fn_title_summary_txt", f"""SELECT id, CASE WHEN regexp_matches(name, '^.+[.][^.]*$') THEN regexp_extract(name, '^(.+)[.][^.]*$', 1) ELSE name END AS title,
  substring(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], 1, 200) AS summary
  FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM files_v) x""")(
    lambda s, d: V.files(s, d).select("id", P.stem(F.col("path")).alias("title"), X.text_summary(F.col("text")).alias("summary"))
)
query("fn_truncate_bytes", """SELECT id, CASE WHEN strlen(text) <= 101 THEN text ELSE list_last(list_filter(list_transform(generate_series(0, 101), lambda n: left(text, n)), lambda x: strlen(x) <= 101)) END AS cut FROM files_v""")(
    lambda s, d: V.files(s, d).select("id", X.truncated(F.col("text"), 101).alias("cut"))
)
query("fn_format_bytes", f"SELECT id, {_SIZE.format(b='(size_bytes * id)')} AS size FROM files_v")(lambda s, d: V.paths(s, d).select("id", P.format_bytes(F.col("size_bytes") * F.col("id")).alias("size")))
query("fn_media_family", f"SELECT path, {_FAMILY} AS family FROM {EXTS} x")(lambda s, d: V.active(s, d).select("path", P.media_family(P.extension(F.col("path"))).alias("family")))
query("fn_format_mtime", "SELECT id, strftime(to_timestamp(greatest(mtime - 1700500000, 0)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM files_v")(
    lambda s, d: V.paths(s, d).select("id", P.format_mtime(F.col("mtime") - 1700500000).alias("day"))
)
query("fn_path_parts", f"SELECT path, dir, name, len(string_split(path, '/')) AS depth, array_to_string(list_transform(generate_series(2, len(string_split(path, '/')) - 1), lambda n: array_to_string(string_split(path, '/')[1:n], '/')), ',') AS ancestors FROM {NAMED} x")(
    lambda s, d: V.active(s, d).select("path", P.parent(F.col("path")).alias("dir"), P.basename(F.col("path")).alias("name"), F.size(F.split("path", "/")).cast("bigint").alias("depth"), F.array_join(P.proper_ancestors(F.col("path")), ",").alias("ancestors"))
)
_BUILD = "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS beside, min(CASE regexp_extract(path, '[^/]*$') " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(P.MANIFESTS)) + " END) AS first FROM active_v GROUP BY 1"
_REASON = f"""SELECT dir, total_bytes, file_count, CASE WHEN name = '__pycache__' THEN 'python bytecode cache' WHEN first IS NULL THEN CASE WHEN name IN ('venv', '.venv') THEN 'python venv' END
    ELSE concat(CASE name WHEN 'target' THEN 'cargo build output' WHEN 'node_modules' THEN 'npm dependency cache' WHEN '.gradle' THEN 'gradle cache' WHEN '.m2' THEN 'maven cache' WHEN 'vendor' THEN 'vendored dependencies'
      WHEN 'venv' THEN 'python venv' WHEN '.venv' THEN 'python venv' ELSE 'build output' END, ' (', list_extract({list(P.MANIFESTS)}, first + 1), ' in parent)') END AS reason
  FROM (SELECT s.dir, s.total_bytes, s.file_count, lower(regexp_extract(s.dir, '[^/]*$')) AS name, b.first FROM ({_STATS}) s LEFT JOIN ({_BUILD}) b ON b.beside = regexp_extract(s.dir, '^(.*)/[^/]*$', 1)) x WHERE name IN {P.REGENERABLE}"""
_REASONS = f"SELECT * FROM ({_REASON}) y WHERE reason IS NOT NULL"
query("fn_regenerable_reason", _REASONS)(lambda s, d: reports.regenerable(V.active(s, d)))
_HOME = "/r1/s3/l0"
_XDG = f"SELECT dir, total_bytes, file_count, CASE WHEN dir = '{_HOME}/.cache' OR starts_with(dir, '{_HOME}/.cache/') THEN 'XDG cache directory' WHEN dir = '{_HOME}/.local/share/Trash' OR starts_with(dir, '{_HOME}/.local/share/Trash/') THEN 'trash directory' END AS reason FROM ({_STATS}) s"
query("fn_xdg_trash", f"SELECT dir, reason FROM ({_XDG}) x WHERE reason IS NOT NULL")(
    lambda s, d: reports.directory_stats(V.active(s, d)).select("dir", P.xdg_or_trash(F.col("dir"), _HOME).alias("reason")).where("reason is not null")
)
query("fn_tilde", "SELECT path, CASE WHEN starts_with(path, '/r1') THEN '~' || substring(path, 4) ELSE path END AS short FROM files_v")(
    lambda s, d: V.paths(s, d).select("path", F.when(F.col("path").startswith("/r1"), F.concat(F.lit("~"), F.substring("path", 4, 1 << 30))).otherwise(F.col("path")).alias("short"))
)
query("fn_now_minus", "SELECT id FROM events_v WHERE ts < (SELECT max(ts) FROM events_v) - 86400 * 20")(
    lambda s, d: (lambda e: e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).where("ts < now - 86400 * 20").select("id"))(V.events(s, d))  # one row
)
query("fn_glob_to_like", r"SELECT path FROM active_v WHERE path ILIKE '%doc\_3_.%' ESCAPE '\'")(
    lambda s, d: V.active(s, d).where(predicates.like_ci(F.col("path"), glob_to_like("*doc_3?.*"))).select("path")
)

# ---- search

_PHRASES = search_terms("die und")
_F = "len(list_filter(t, lambda x: x = '{}'))"
_FTS = f"""(SELECT content_hash, len(t) AS length, {_F.format('die')} AS f0, {_F.format('und')} AS f1 FROM {_DOC_TOKENS} x)"""
_RANK = f"""SELECT content_hash, round(-(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * length / mean))
    + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS rank
  FROM {_FTS} f, (SELECT count(*) AS n, avg(length) AS mean, count_if(f0 > 0) AS n0, count_if(f1 > 0) AS n1 FROM {_FTS} g) c WHERE f0 > 0 AND f1 > 0"""


def _bm25(spark, d):
    return search.bm25(_doc_texts(spark, d), "content_hash", ["text"], _PHRASES).withColumn("rank", F.round("rank", 6))


query("fts_bm25", _RANK)(_bm25)
query("fts_index", f"SELECT token, count(*) AS n, count(DISTINCT content_hash) AS docs FROM (SELECT content_hash, unnest(t) AS token FROM {_DOC_TOKENS} x) y GROUP BY token")(
    lambda s, d: search.postings(_doc_texts(s, d), "content_hash", ["text"]).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("docs"))
)
query("fts_match", f"SELECT content_hash FROM (SELECT content_hash, ' ' || array_to_string(t, ' ') || ' ' AS j FROM {_DOC_TOKENS} x) y WHERE contains(j, ' of the ') AND contains(j, ' and ')")(
    lambda s, d: search.matching(_doc_texts(s, d), "content_hash", ["text"], [["of", "the"], ["and"]]).select("content_hash")
)
query("jn_fts_docs", f"SELECT f.content_hash, x.title FROM {_FTS} f JOIN documents_v x USING (content_hash) WHERE f0 > 0")(
    lambda s, d: search.matching(_doc_texts(s, d), "content_hash", ["text"], [["die"]]).select("content_hash").join(V.documents(s, d).select("content_hash", "title"), "content_hash")
)
_TOP = f"SELECT content_hash, rank FROM ({_RANK}) r ORDER BY rank, content_hash LIMIT 10"
query("top_rank", _TOP)(lambda s, d: _bm25(s, d).orderBy("rank", "content_hash").limit(10))
query("q_find", f"""SELECT t.content_hash, t.rank, x.title, coalesce(p.path, '(no current path)') AS path FROM ({_TOP}) t JOIN documents_v x USING (content_hash)
  LEFT JOIN (SELECT content_hash, min(path) AS path FROM files_v WHERE disappeared IS NULL GROUP BY content_hash) p USING (content_hash)""")(
    lambda s, d: search.any_path(_bm25(s, d).orderBy("rank", "content_hash").limit(10).join(V.documents(s, d).select("content_hash", "title"), "content_hash"), V.paths(s, d))
)



def _stored(spark, d):
    """The texts' postings, stored, and what a search has to know of the corpus."""
    files = V.files(spark, d).select("content_hash", "text")
    parts = search.block_bits(files.select("content_hash").distinct().count())
    store = Store(spark, scratch(spark, "postings"))
    # copies of a text are dropped where they are read, and those that are left as the parts are made
    store.commit(append={"postings": search.block_rows(search.once_a_task(files, "content_hash"), "content_hash", ["text"], 1, parts)})
    n, length = search.indexed(store.table("postings"))
    store.commit(count={"docs": n, "tokens": length})
    return store.table("postings"), n, length


def _top_stored(spark, d):
    blocks, n, length = _stored(spark, d)
    return search.top(blocks, "content_hash", _PHRASES, 10, n, length).withColumn("rank", F.round("rank", 6))


@query("fts_stored", _RANK)
def fts_stored(spark, d):
    blocks, n, length = _stored(spark, d)
    return search.ranked(blocks, "content_hash", _PHRASES, n, length).withColumn("rank", F.round("rank", 6))


query("top_stored", _TOP)(_top_stored)
query("q_find_stored", ORACLE_SQL["q_find"].removeprefix(V.SQL))(
    lambda s, d: search.any_path(_top_stored(s, d).join(V.documents(s, d).select("content_hash", "title"), "content_hash"), V.paths(s, d))
)

# ---- composite queries



def _get(spark, d):
    one = V.documents(spark, d).where("doc_id in (1, 2, 3)").select("content_hash", "title", "byte_size")
    paths = V.active(spark, d).select("content_hash", "path").join(one.select("content_hash"), "content_hash", "left_semi")
    return one.join(paths.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_paths")), "content_hash").join(paths, "content_hash")


query("q_find_path", r"SELECT path, coalesce(byte_size, 0) AS byte_size, content_hash, title, count(*) OVER () AS total_matched FROM active_v WHERE path ILIKE '%doc\_1%' ESCAPE '\' ORDER BY coalesce(byte_size, 0) DESC, path LIMIT 200")(
    lambda s, d: predicates.largest(V.active(s, d).where(predicates.like_ci(F.col("path"), glob_to_like("*doc_1*"))), 200)
)


def _by_grams(spark, d, glob, most):
    """Active files by stored names and grams."""
    active = V.active(spark, d)
    n = active.count()
    store = Store(spark, scratch(spark, "names"))
    names = written(grams.numbered_paths(active, 1, grams.part_bits(n)), "names")
    store.commit(append={"names": names, "grams": grams.gram_rows(names)})
    found = grams.matching_paths(store.table("names"), store.table("grams"), glob_to_like(glob))
    return predicates.largest(active.join(found, "path", "left_semi"), most)


query("q_find_path_grams", ORACLE_SQL["q_find_path"].removeprefix(V.SQL))(lambda s, d: _by_grams(s, d, "*doc_1*", 200))
query("q_find_path_wide", r"SELECT path, coalesce(byte_size, 0) AS byte_size, content_hash, title, count(*) OVER () AS total_matched FROM active_v WHERE path ILIKE '/r%/media/%.MP_' ORDER BY coalesce(byte_size, 0) DESC, path LIMIT 50")(
    lambda s, d: _by_grams(s, d, "/r*/media/*.MP?", 50)
)
query("q_find_ext", "SELECT path, coalesce(byte_size, 0) AS byte_size, content_hash, title, count(*) OVER () AS total_matched FROM active_v WHERE lower(path) LIKE '%.txt' ORDER BY coalesce(byte_size, 0) DESC, path LIMIT 200")(
    lambda s, d: predicates.largest(V.active(s, d).where(predicates.has_suffix(F.col("path"), "txt")), 200)
)
query("q_get", "SELECT x.content_hash, x.title, x.byte_size, count(*) OVER (PARTITION BY x.content_hash) AS n_paths, a.path FROM documents_v x JOIN active_v a USING (content_hash) WHERE x.doc_id IN (1, 2, 3)")(_get)
query("q_history", f"SELECT e.id, e.ts, e.event_type, v.versions FROM events_v e JOIN ({_VERSIONS}) v USING (path) WHERE e.path = '/u/7.txt' AND e.ts >= 1704100000")(
    lambda s, d: feed.history(V.events(s, d).withColumn("timestamp", F.col("ts")), "/u/7.txt", since=1704100000).join(_versions(s, d), "path").select("id", "ts", "event_type", "versions")
)
_AUDIT = f"""SELECT * FROM (SELECT 'largest' AS part, path AS name, file_count AS n, total_bytes AS bytes FROM catalog_v WHERE total_bytes >= 2000 ORDER BY file_count DESC, path LIMIT 20) largest_dirs UNION ALL
  SELECT 'tier1' AS part, '' AS name, count(*) AS n, CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS bytes FROM active_v UNION ALL
  SELECT 'tier2', '', count(*), CAST(coalesce(sum(total_bytes), 0) AS BIGINT) FROM catalog_v UNION ALL
  SELECT 'ext', coalesce('.' || ext, '(none)'), count(*), CAST(coalesce(sum(byte_size), 0) AS BIGINT) FROM {EXTS} x GROUP BY 2 UNION ALL
  SELECT 'violation', category, count(*), NULL FROM ({_POLICY_SQL}) v GROUP BY category"""


def _audit(spark, d):
    a = V.active(spark, d)
    part = lambda name, df, label: df.select(F.lit(name).alias("part"), label.alias("name"), F.col("files").alias("n"), F.col("bytes"))
    total = part("tier1", _tier1(a), F.lit(""))
    ext = part("ext", _tier1(a.withColumn("ext", P.extension_label(F.col("path"))), "ext"), F.col("ext"))
    dirs = part("tier2", V.catalog(spark, d).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("bytes")), F.lit(""))
    bad = predicates.violation_counts(V.paths(spark, d).where("disappeared is null")).select(F.lit("violation").alias("part"), F.col("category").alias("name"), "n", F.lit(None).cast("bigint").alias("bytes"))
    large = predicates.largest_dirs(V.catalog(spark, d), 20, 2000, "count").select(F.lit("largest").alias("part"), F.col("path").alias("name"), F.col("file_count").alias("n"), F.col("total_bytes").alias("bytes"))
    return total.unionByName(ext).unionByName(dirs).unionByName(bad).unionByName(large)


query("q_audit", _AUDIT)(_audit)
query("q_manifest", f"SELECT path, content_hash, coalesce(byte_size, 0) AS byte_size FROM active_v a WHERE {_NOT_UNDER}")(
    lambda s, d: _manifest(s, d).select("path", "content_hash", F.coalesce("byte_size", F.lit(0)).alias("byte_size"))
)
query("q_health", f"SELECT *, (SELECT max(ts) FROM events_v) AS last_scan FROM ({_COUNTS}) c")(
    lambda s, d: _counts(s, d).join(F.broadcast(V.events(s, d).agg(F.max("ts").alias("last_scan"))))  # one row
)
_MAP = """SELECT * FROM (SELECT 'indexed' AS tier, path, title, NULL AS total_bytes FROM active_v WHERE starts_with(path, '/r2/s1') ORDER BY path LIMIT 500) a UNION ALL
  SELECT * FROM (SELECT 'cataloged' AS tier, path, NULL AS title, total_bytes FROM catalog_v WHERE starts_with(path, '/r2/s1') ORDER BY path LIMIT 500) b"""
query("q_map", _MAP)(
    lambda s, d: V.active(s, d).where(F.col("path").startswith("/r2/s1")).orderBy("path").limit(500).select(F.lit("indexed").alias("tier"), "path", "title", F.lit(None).cast("bigint").alias("total_bytes"))
    .unionByName(V.catalog(s, d).where(F.col("path").startswith("/r2/s1")).orderBy("path").limit(500).select(F.lit("cataloged").alias("tier"), "path", F.lit(None).cast("string").alias("title"), "total_bytes"))
)
query("q_outline", "SELECT path, content_hash, title, summary FROM active_v WHERE path = '/r1/s1/l1/doc_2.txt'")(
    lambda s, d: V.active(s, d).where("path = '/r1/s1/l1/doc_2.txt'").select("path", "content_hash", "title", "summary")
)
_RECOMMEND = f"""SELECT dir AS path, min_by(action, k) AS action, min_by(reason, k) AS reason, min_by(total_bytes, k) AS size_bytes, min_by(file_count, k) AS file_count FROM (
  SELECT dir, 0 AS k, 'catalog' AS action, reason, total_bytes, file_count FROM ({_XDG}) x WHERE reason IS NOT NULL UNION ALL
  SELECT dir, 1, 'catalog', reason, total_bytes, file_count FROM ({_REASONS}) r UNION ALL
  SELECT dir, 2, 'keep', printf('%s (%d files, %.0f%% %s)', {_SIZE.format(b='total_bytes')}, file_count, share * 100, exts), total_bytes, file_count FROM ({_SHARES}) m) u GROUP BY dir"""
query("q_triage", _RECOMMEND)(lambda s, d: reports.recommendations(V.active(s, d), _HOME, **_MEDIA))
query("snk_editor_file", f"SELECT concat_ws(chr(9), action, path, {_SIZE.format(b='size_bytes')}, reason) AS line FROM ({_RECOMMEND}) x")(
    lambda s, d: reports.review_lines(reports.recommendations(V.active(s, d), _HOME, **_MEDIA), F.col("action"), F.col("path"), F.col("size_bytes"), F.col("reason"))
)
_BACKUP = f"""SELECT 'redundant' AS part, path, size_bytes FROM ({_REDUNDANT}) r UNION ALL
  SELECT 'stale', path, size_bytes FROM ({_STALE}) s WHERE path NOT IN (SELECT path FROM ({_REDUNDANT}) r) UNION ALL
  SELECT 'unique', path, coalesce(byte_size, 0) FROM active_v WHERE root = '{ROOT}' AND path NOT IN (SELECT path FROM ({_REDUNDANT}) r) AND path NOT IN (SELECT path FROM ({_STALE}) s)"""


def _backup(spark, d):
    return reports.backup_parts(V.active(spark, d), ROOT).select("part", "path", F.coalesce("byte_size", F.lit(0)).alias("size_bytes"))


query("q_backup_audit", _BACKUP)(_backup)
query("q_events_since", "SELECT id, event_type, path, content_hash FROM events_v WHERE id > 40 ORDER BY id LIMIT 1000")(
    lambda s, d: feed.after(V.events(s, d), 40, 999).select("id", "event_type", "path", "content_hash")
)
query("st_feed", "SELECT id FROM events_v WHERE id > 9000 ORDER BY id LIMIT 11")(lambda s, d: feed.after(V.events(s, d), 9000, 10).select("id"))
_PRUNED = "SELECT count(*) AS pruned FROM events_v WHERE ts < 1705000000"


def _pruned(spark, d):
    e = V.events(spark, d)
    kept = feed.retained(e, 1705000000, "ts").agg(F.count(F.lit(1)).alias("kept"))
    return e.agg(F.count(F.lit(1)).alias("all")).join(F.broadcast(kept)).select((F.col("all") - F.col("kept")).alias("pruned"))  # one row


query("q_prune", _PRUNED)(_pruned)
query("st_prune", "SELECT id FROM events_v WHERE ts >= 1705000000")(lambda s, d: feed.retained(V.events(s, d), 1705000000, "ts").select("id"))


@query("st_apply", """, touched AS (SELECT path, max_by(event_type, id) <> 'deleted' AS present FROM events_v GROUP BY path) SELECT path, present FROM touched""")
def st_apply(spark, d):
    e = V.events(spark, d).select(F.col("path").alias("key"), F.col("id").alias("flush_ms"), F.when(F.col("event_type") == "deleted", "Delete").otherwise("Modify").alias("kind"), F.lit(None).cast("string").alias("from_key"))
    from ..streaming.apply import affected

    return affected(e)


@query("event_ids", "SELECT 1000000 + row_number() OVER (ORDER BY path, event_type) AS id, path, event_type FROM (SELECT DISTINCT path, event_type FROM events_v) x")
def event_ids(spark, d):
    return feed.numbered(V.events(spark, d).select("path", "event_type").distinct(), 1_000_000, ["path", "event_type"])


@query("lag_previous_hash", "SELECT id, lag(content_hash) OVER (PARTITION BY path ORDER BY ts, id) AS previous_hash FROM events_v")
def lag_previous_hash(spark, d):
    return V.events(spark, d).select("id", F.lag("content_hash").over(Window.partitionBy("path").orderBy("ts", "id")).alias("previous_hash"))
