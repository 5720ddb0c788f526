"""Walking file trees as a Spark data source, and reading what has to be hashed."""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import policy
from .scratch import written

WALK = "path string, root string, mtime bigint, size_bytes bigint, inode bigint, dev bigint, catalog_dir string"
IGNORE_FILE = ".indexignore"
#: Directories that the driver opens at most to find the parts of a walk; the tasks walk what is below.
PARTS = 512
#: Bytes in which a zero byte makes a file binary.
SNIFF = 8192


class _Top(InputPartition):
    """A directory to walk, or its own files only; layers: the rules from above it."""

    def __init__(self, root: str, path: str, layers: list, catalog: str | None, deep: bool = True):
        self.root, self.path, self.layers, self.catalog, self.deep = root, path, layers, catalog, deep


def _layer(directory: str, layers: list) -> list:
    try:
        with open(os.path.join(directory, IGNORE_FILE), encoding="utf-8") as f:
            return [*layers, policy.parse_rules(f.read(), directory)]
    except OSError:
        return layers


def _entries(directory: str) -> list[os.DirEntry]:
    try:
        with os.scandir(directory) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _verdict(layers: list, user: list, path: str, is_dir: bool) -> int:
    return max(policy.classify_one(layers, path, is_dir), policy.classify_one(user, path, is_dir) if user else 0)


class WalkReader(DataSourceReader):
    def __init__(self, roots: list[str], user_rules: str, home: str):
        self.roots, self.user = roots, [policy.parse_rules(user_rules, home)] if user_rules else []

    def partitions(self) -> list[InputPartition]:
        """Directories by their depth, opened on the driver until there are PARTS of them, so that a huge one is divided."""
        waiting = deque(_Top(root, root, [policy.default_rules(root)], None) for root in self.roots if os.path.isdir(root))  # a root that isn't there is skipped
        own: list[InputPartition] = []
        while waiting and len(own) + len(waiting) < PARTS:
            top = waiting.popleft()
            own.append(_Top(top.root, top.path, top.layers, top.catalog, deep=False))
            waiting.extend(_Top(top.root, *below) for below in self._below(top.path, self._here(top.path, top.layers, top.catalog), top.catalog))
        return [*own, *waiting] or [_Top("", "", [], None)]

    def read(self, top: _Top) -> Iterator[tuple]:
        if not top.path:
            return
        if top.deep:
            yield from self._tree(top.root, top.path, top.layers, top.catalog)
        else:
            yield from self._files(top.root, top.path, self._here(top.path, top.layers, top.catalog), top.catalog)

    @staticmethod
    def _here(directory: str, layers: list, catalog: str | None) -> list:
        """The rules that hold in a directory; no ignore files are read below a cataloged one."""
        return layers if catalog else _layer(directory, layers)

    def _below(self, directory: str, layers: list, catalog: str | None) -> Iterator[tuple[str, list, str | None]]:
        """(path, layers, catalog) of the directories in one that aren't ignored."""
        for e in _entries(directory):
            if not e.is_symlink() and e.is_dir(follow_symlinks=False):
                inside = catalog
                if not inside:
                    verdict = _verdict(layers, self.user, e.path, True)
                    if verdict == policy.IGNORED:
                        continue
                    inside = e.path if verdict == policy.CATALOGED else None
                yield e.path, layers, inside

    def _files(self, root, directory, layers, catalog):
        for e in _entries(directory):
            try:
                if e.is_symlink() or e.is_dir(follow_symlinks=False):
                    continue
                s = e.stat(follow_symlinks=False)
            except OSError:
                continue
            if stat.S_ISREG(s.st_mode) and (catalog or _verdict(layers, self.user, e.path, False) == policy.INDEXED):
                yield (e.path, root, int(s.st_mtime), s.st_size, s.st_ino, s.st_dev, catalog)

    def _tree(self, root, directory, layers, catalog):
        layers = self._here(directory, layers, catalog)
        yield from self._files(root, directory, layers, catalog)
        for below in self._below(directory, layers, catalog):
            yield from self._tree(root, *below)


class WalkSource(DataSource):
    """Format "filetree". Options: roots (a JSON list), user_rules, home. Partitions are directories (PARTS about).

    Links aren't followed; what isn't a regular file is left out. Files below a cataloged
    directory come with that directory in catalog_dir.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return WALK

    def reader(self, schema) -> WalkReader:
        return WalkReader(json.loads(self.options["roots"]), self.options.get("user_rules", ""), self.options.get("home", "/"))


def walk(spark: SparkSession, roots: list[str], user_rules: str = "", home: str = "/") -> DataFrame:
    spark.dataSource.register(WalkSource)
    return spark.read.format("filetree").option("roots", json.dumps(roots)).option("user_rules", user_rules).option("home", home).load()


READ = "path string, size_bytes bigint, content_hash string, content binary, is_large boolean"


#: Entries that a task of the first step looks at, times GROWS in each further one, at most MOST_ENTRIES.
FIRST_ENTRIES, GROWS, MOST_ENTRIES = 256, 16, 100_000
STEP = "root string, path string, kind string, layers string, catalog_dir string, mtime bigint, size_bytes bigint, inode bigint, dev bigint"
_STEP_KINDS = (*[pa.string()] * 5, *[pa.int64()] * 4)


def _listed(user_rules: str, home: str, most: int):
    """An Arrow function over rows of kind dir and name: their files, and what is left to look at.

    layers: the ignore files above, as a JSON list of (base, text). A directory beyond the
    `most` entries of a task is passed on as it is, and so are the names beyond them in a
    directory, before any rule has been asked.
    """
    user = [policy.parse_rules(user_rules, home)] if user_rules else []

    def run(batches):
        parsed: dict[tuple[str, str], list] = {}
        left, out = most, []

        def rules(root: str, layers: str) -> list:
            if (root, layers) not in parsed:
                parsed[root, layers] = [policy.default_rules(root), *(policy.parse_rules(text, base) for base, text in json.loads(layers))]
            return parsed[root, layers]

        def file(root, path, layers, catalog):
            try:
                s = os.lstat(path)
            except OSError:
                return
            if stat.S_ISREG(s.st_mode) and (catalog or _verdict(rules(root, layers), user, path, False) == policy.INDEXED):
                out.append((root, path, "file", "", catalog, int(s.st_mtime), s.st_size, s.st_ino, s.st_dev))

        def later(kind, root, path, layers, catalog):
            out.append((root, path, kind, layers, catalog, None, None, None, None))

        def made():
            some = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _STEP_KINDS)], [x.split()[0] for x in STEP.split(", ")])
            out.clear()
            return some

        for batch in batches:
            for root, path, kind, layers, catalog in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if kind == "name":
                    file(root, path, layers, catalog)
                waiting = [(path, layers, catalog)] if kind == "dir" else []
                while waiting:
                    here, layers, catalog = waiting.pop()
                    if left <= 0:
                        later("dir", root, here, layers, catalog)
                        continue
                    if not catalog:
                        try:
                            with open(os.path.join(here, IGNORE_FILE), encoding="utf-8") as f:
                                layers = json.dumps([*json.loads(layers), [here, f.read()]])
                        except (OSError, UnicodeDecodeError):
                            pass
                    try:
                        found = os.scandir(here)
                    except OSError:
                        continue
                    with found:
                        for e in found:
                            left -= 1
                            try:
                                below = e.is_dir(follow_symlinks=False)
                                if not below and e.is_symlink():
                                    continue
                            except OSError:
                                continue
                            if not below:
                                if left > 0:
                                    file(root, e.path, layers, catalog)
                                else:
                                    later("name", root, e.path, layers, catalog)
                            else:
                                verdict = policy.CATALOGED if catalog else _verdict(rules(root, layers), user, e.path, True)
                                if verdict != policy.IGNORED:
                                    waiting.append((e.path, layers, catalog or (e.path if verdict == policy.CATALOGED else None)))
                            if len(out) >= 10_000:
                                yield made()
                if len(out) >= 10_000:
                    yield made()
        if out:
            yield made()

    return run


def walk_steps(spark: SparkSession, roots: list[str], user_rules: str = "", home: str = "/", hold=None, first: int = FIRST_ENTRIES, most: int = MOST_ENTRIES) -> DataFrame:
    """What walk() finds, by steps: each lists the directories that the last has left, in tasks of a bounded number of entries.

    The driver opens no directory and holds none of what is found. A directory of very many
    files is listed by one task, but its names are dealt to many for the rules and the
    file system. hold writes a step's rows and reads them again.
    """
    hold = hold or (lambda df: written(df, "walk"))
    tops = [(r.rstrip("/") or "/", r.rstrip("/") or "/", "dir", "[]", None, None, None, None, None) for r in roots]
    at, found, entries, n = spark.createDataFrame(tops, STEP), [], first, len(tops)
    while n:
        tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // entries)))
        step = hold(at.repartition(tasks, "path").mapInArrow(_listed(user_rules, home, entries), STEP))
        found.append(step.where("kind = 'file'"))
        at = step.where("kind <> 'file'")
        n, entries = at.count(), min(most, entries * GROWS)
    files = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], STEP)
    return files.select("path", "root", "mtime", "size_bytes", "inode", "dev", "catalog_dir")


#: Bytes of files that one task reads on average, tasks at most; bytes and files of a record batch.
READ_BYTES, READ_TASKS = 256 << 20, 10_000
BATCH_BYTES, BATCH_FILES = 8 << 20, 2000


def dealt_by_size(walked: DataFrame) -> DataFrame:
    """(path, size_bytes) dealt at random to as many tasks as their bytes and the cores ask for; a join before would leave few."""
    total, n = walked.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(walked.sparkSession.sparkContext.defaultParallelism, total // READ_BYTES)
    return walked.select("path", "size_bytes").repartition(max(1, min(n, tasks, READ_TASKS)), "path")


def read_contents(walked: DataFrame, most_bytes: int = 524_288_000) -> DataFrame:
    """(path, size_bytes, content_hash, content, is_large) of the files that need a hash.

    Only texts have a content: files above most_bytes, and those with a zero byte among
    their first SNIFF, are hashed in a stream. Unreadable ones give no row. Batches are
    cut by bytes, a large file being one of its own.
    """

    def made(rows):
        columns = list(zip(*rows))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "size_bytes", "content_hash", "content", "is_large"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open(path, "rb") as f:
                        head = f.read(SNIFF)
                        f.seek(0)
                        if b"\0" in head or (size is not None and size > most_bytes):
                            digest, content = hashlib.file_digest(f, "sha256").hexdigest(), None
                        else:
                            content = f.read()
                            digest = hashlib.sha256(content).hexdigest()
                except OSError:
                    continue
                more = len(content or b"")
                if rows and (held + more > BATCH_BYTES or len(rows) >= BATCH_FILES):
                    yield made(rows)
                    rows, held = [], 0
                rows.append((path, size, digest, content, content is None))
                held += more
        if rows:
            yield made(rows)

    return dealt_by_size(walked).mapInArrow(run, READ)


def find_files(paths: DataFrame, roots: list[str], user_rules: str = "", home: str = "/") -> DataFrame:
    """(path, root, mtime, size_bytes, inode, dev) of what a walk would find at or below the paths now.

    A path counts if it lies below a root, and neither the rules of the directories above
    it nor its own leave it out; a directory is walked. Links aren't followed.
    """
    reader = WalkReader(roots, user_rules, home)

    def run(batches):
        held: dict[str, list | None] = {}  # the layers that hold in a directory; None: it isn't indexed

        def layers_in(root: str, directory: str) -> list | None:
            if directory not in held:
                if directory == root:
                    held[directory] = _layer(root, [policy.default_rules(root)])
                else:
                    above = layers_in(root, os.path.dirname(directory))
                    inside = above is not None and not os.path.islink(directory) and _verdict(above, reader.user, directory, True) == policy.INDEXED
                    held[directory] = _layer(directory, above) if inside else None
            return held[directory]

        def found(path: str) -> Iterator[tuple]:
            root = next((r for r in (x.rstrip("/") for x in roots) if path.startswith(r + "/")), None)
            if not root:
                return
            try:
                s = os.lstat(path)
            except OSError:
                return
            layers = layers_in(root, os.path.dirname(path))
            if layers is None:
                return
            if stat.S_ISDIR(s.st_mode) and _verdict(layers, reader.user, path, True) == policy.INDEXED:
                yield from (row[:6] for row in reader._tree(root, path, layers, None) if row[6] is None)
            elif stat.S_ISREG(s.st_mode) and _verdict(layers, reader.user, path, False) == policy.INDEXED:
                yield (path, root, int(s.st_mtime), s.st_size, s.st_ino, s.st_dev)

        kinds = (pa.string(), pa.string(), *[pa.int64()] * 4)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = found(path)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], ["path", "root", "mtime", "size_bytes", "inode", "dev"])

    all_found = paths.select("path").mapInArrow(run, "path string, root string, mtime bigint, size_bytes bigint, inode bigint, dev bigint")
    return all_found.dropDuplicates(["path"])
