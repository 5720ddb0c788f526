"""Index tables derived from the test tables, by the same rules in Spark and in SQL.

Documents become files: a path of three roots, nested directories and names that make
policy, extension and report rules fire. Every query of the catalogue runs on these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names by number: n is a file's number, k that of a pair of files in one directory.
NAMES = (
    "doc_{n}.md", "doc_{n}.txt", "doc_{n}.json", "doc_{n}.tar.gz", "doc{n}", "env_{n}/.env", ".hidden_{n}", "app_{k}/node_modules/pkg_{n}.js",
    ".cache/c_{n}.bin", ".ssh/id_rsa_{n}", "media/song_{n}.mp3", "media/film_{n}.MP4", "media/pic_{n}.jpg", "cert_{n}.pem", "build/out_{n}.o",
    "backup/old_{n}.txt", "proj_{k}/target/lib_{n}.rlib",
)
#: Build files that stand where pairs 7 and 16 have their even file.
BUILD_FILES = {7: "app_{k}/package.json", 16: "proj_{k}/Cargo.toml"}


def _sql_name(pattern: str) -> str:
    parts = pattern.replace("{n}", "\0n\0").replace("{k}", "\0k\0").split("\0")
    return "concat(" + ", ".join({"n": "n", "k": "k"}.get(p, f"'{p}'") for p in parts if p) + ", '')"


_CASES = " ".join(f"WHEN k % 17 = {i} AND n % 2 = 0 THEN {_sql_name(p)}" for i, p in BUILD_FILES.items()) + " " + " ".join(
    f"WHEN k % 17 = {i} THEN {_sql_name(p)}" for i, p in enumerate(NAMES)
)
_PATH = f"concat('/r', d % 3, '/s', k % 5, '/l', k % 4, '/', CASE {_CASES} END)"

#: SQL that both engines read: {DIV} is integer division, {HASH} and {SIZE} of a text, {SECS} of a time.
_FILES = f"""
  SELECT d AS id, text, lang, source, {_PATH} AS path, concat('/r', d % 3) AS root, {{HASH}} AS content_hash,
    1700000000 + (d * 7919) % 1000000 AS mtime, {{SIZE}} AS size_bytes, 1700000000 + d AS appeared,
    CASE WHEN d % 11 = 0 THEN 1700500000 + d END AS disappeared, d % 7 AS last_seen_scan,
    CASE WHEN d % 13 = 1 THEN d - 1 ELSE d END AS inode, CAST(1 AS BIGINT) AS dev
  FROM (SELECT CAST(doc_id AS BIGINT) AS d, CAST({{DIV3}} AS BIGINT) AS n, CAST({{DIV6}} AS BIGINT) AS k, coalesce(text, '') AS text,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) numbered"""
_DOCS = """
  SELECT content_hash, min(id) AS doc_id, min_by(title, id) AS title, min_by(summary, id) AS summary, min_by(lang, id) AS lang,
    min_by(source, id) AS source, min_by(size, id) AS byte_size, min(id) % 29 = 3 AS is_binary, 1700000000 + min(id) AS first_seen,
    CASE WHEN min(id) % 4 = 0 THEN concat('b', content_hash) END AS body_hash
  FROM (SELECT content_hash, id, lang, source, CASE WHEN id % 97 = 5 THEN NULL ELSE size_bytes END AS size, substring(text, 1, 40) AS title,
    substring(text, 1, 200) AS summary FROM files_v) each_file GROUP BY content_hash"""
_EVENTS = """
  SELECT event_id + 1 AS id, concat('/u/', user_id, CASE WHEN user_id % 3 = 0 THEN '.md' ELSE '.txt' END) AS path, {PROPS} AS content_hash, {SECS} AS ts,
    CASE event_type WHEN 'click' THEN 'updated' WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'moved' ELSE 'minor_change' END AS event_type
  FROM events"""

SPARK_FILES = _FILES.format(HASH="sha2(text, 256)", SIZE="CAST(octet_length(text) AS BIGINT)", DIV3="doc_id div 3", DIV6="doc_id div 6")
SPARK_EVENTS = _EVENTS.format(
    PROPS="sha2(coalesce(props, ''), 256)", SECS="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 1000000"
)
#: DuckDB's min_by passes over null values, Spark's takes them.
SPARK_DOCS = _DOCS.replace("min_by(size, id)", "min_by(size, id) FILTER (WHERE size IS NOT NULL)")
DUCK_FILES = _FILES.format(HASH="sha256(text)", SIZE="CAST(strlen(text) AS BIGINT)", DIV3="doc_id // 3", DIV6="doc_id // 6")
DUCK_EVENTS = _EVENTS.format(PROPS="sha256(coalesce(props, ''))", SECS="epoch_us(ts) // 1000000")

_AD = "SELECT p.*, x.title, x.summary, x.lang, x.source, x.byte_size, x.is_binary FROM (SELECT id, path, root, content_hash, mtime, size_bytes, inode, dev FROM files_v WHERE disappeared IS NULL) p JOIN documents_v x USING (content_hash)"
_CATALOG = r"""SELECT dir AS path, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS file_count FROM (
  SELECT {DIR} AS dir, size_bytes FROM files_v) t WHERE dir <> '' GROUP BY dir"""
_CATALOG_RE = r"^(.*/(?:node_modules|build|target|[.]cache))/"

#: Common table expressions that head every SQL text of the catalogue.
SQL = f"""WITH RECURSIVE files_v AS ({DUCK_FILES}),
documents_v AS ({_DOCS}),
events_v AS ({DUCK_EVENTS}),
active_v AS ({_AD}),
catalog_v AS ({_CATALOG.format(DIR=f"regexp_extract(path, '{_CATALOG_RE}', 1)")})"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_FILES.replace("FROM documents)", "FROM {documents})"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versioned path table; no texts."""
    return files(spark, sf_dir).drop("text", "lang", "source")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_DOCS.replace("FROM files_v", "FROM {files_v}"), files_v=files(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_EVENTS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active paths with their documents."""
    p = paths(spark, sf_dir).where("disappeared is null").select("id", "path", "root", "content_hash", "mtime", "size_bytes", "inode", "dev")
    d = documents(spark, sf_dir).select("content_hash", "title", "summary", "lang", "source", "byte_size", "is_binary")
    return p.join(d, "content_hash")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = paths(spark, sf_dir).select(F.regexp_extract("path", _CATALOG_RE, 1).alias("path"), "size_bytes").where("path <> ''")
    return dirs.groupBy("path").agg(F.sum("size_bytes").alias("total_bytes"), F.count(F.lit(1)).alias("file_count"))


#: Snapshots before and after, for change detection. {H} hashes a text.
_SNAP = """
  SELECT path || {SUFFIX} AS path, {H} AS content_hash, {BODY} AS body_hash, inode, dev, mtime, size_bytes, root FROM (
    SELECT *, CASE WHEN id % 10 = 5 THEN concat('---\nv: {V}\n---\n', text) WHEN id % 10 = 6 THEN concat(text, '{TAIL}') ELSE text END AS t FROM files_v) x WHERE {KEEP}"""


def _snapshots(hash_of: str) -> tuple[str, str]:
    h = hash_of.format("t")
    prev = _SNAP.format(SUFFIX="''", H=h, BODY=f"CASE WHEN id % 10 = 5 THEN {hash_of.format('text')} END", V=1, TAIL="", KEEP="id % 10 <> 9")
    full = f"CASE WHEN id % 10 = 5 THEN {hash_of.format('text')} ELSE {h} END"
    cur = _SNAP.format(SUFFIX="CASE WHEN id % 10 = 7 THEN '.moved' ELSE '' END", H=h, BODY=full, V=2, TAIL=" changed", KEEP="id % 10 <> 8")
    extra = _SNAP.format(SUFFIX="CASE WHEN id % 10 = 4 THEN '.copy' ELSE '.link' END", H=h, BODY=full, V=2, TAIL=" changed", KEEP="id % 10 IN (3, 4)")
    extra = extra.replace("inode, dev", "CASE WHEN id % 10 = 4 THEN inode + 1000000000 ELSE inode END AS inode, dev", 1)
    return prev, f"{cur} UNION ALL {extra}"


DUCK_PREV, DUCK_CUR = _snapshots("sha256({})")
SPARK_PREV, SPARK_CUR = _snapshots("sha2({}, 256)")
SNAP_SQL = f"{SQL}, prev_v AS ({DUCK_PREV}), cur_v AS ({DUCK_CUR})"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir)
    return tuple(spark.sql(x.replace("FROM files_v", "FROM {files_v}"), files_v=f) for x in (SPARK_PREV, SPARK_CUR))
