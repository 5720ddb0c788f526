"""The index on disk: immutable generations of Parquet tables, each with a pointer file."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema

TABLES: dict[str, str] = {
    "documents": schema.DOCUMENTS, "active": schema.PATHS, "closed": schema.PATHS, "events": schema.EVENTS, "catalog": schema.CATALOG,
    "scan_requests": schema.SCAN_REQUESTS, "scan_runs": schema.SCAN_RUNS, "read_audit": schema.READ_AUDIT, "snapshots": schema.SNAPSHOTS, "postings": schema.POSTINGS,
    "names": schema.NAMES, "grams": schema.GRAMS,
}
#: Tables that are read as one.
VIEWS: dict[str, tuple[str, ...]] = {"paths": ("active", "closed")}
#: Tables that are sorted by some columns, hot values of the first divided by the others, so that a query reads few of their pages.
SORTED: dict[str, tuple[str, ...]] = {"postings": ("token", "prefix"), "names": ("segment", "part", "id"), "grams": ("gram", "segment", "part")}
#: Those of them whose rows stay with the task that made them: a word is read in a few pages of each file, and no posting is shuffled.
LOCAL = ("postings",)
#: Tables of one row a key, which is replaced row by row: they lie in slots by a hash of the key.
KEYED: dict[str, str] = {"active": "path", "documents": "content_hash"}
HASH = "sha256"
#: Parts of a table from which on the next append rewrites it as one.
MOST_PARTS = 64
#: Slots of a keyed table at first, bytes of a slot for which their number is chosen when a table is rewritten, and most of them.
SLOTS, SLOT_BYTES, MOST_SLOTS = 16, 32 << 20, 4096
#: Deltas of a slot from which on the next change merges them; with the rest of the slot where they have 1 / REWRITE of its bytes.
MOST_DELTAS, REWRITE = 8, 4
_POINTER = re.compile(r"_gen-(\d{12})\.json")


class CommitConflict(Exception):
    """Another writer has committed since the state was read."""


class Store:
    """Tables under a folder of any file system that Spark reads.

    Data are written first, then a pointer file of the next number that nobody has
    written yet; the newest pointer that is complete counts. So a commit that fails at
    any step leaves readers the last state. Of two writers that began with one state the
    later fails if the first has changed a table that it replaces; else it follows. Tables
    that a commit doesn't name stay where they are; appended rows are parts beside the ones before.

    A keyed table lies in slots. A change of some keys writes deltas of their slots: new
    rows, and tombstones where a key has gone. Readers take the newest row of each key that
    a slot's deltas have, and the others from the slot's base. Slots with many deltas are
    compacted by themselves.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """The numbers of all pointers, complete or not, newest first."""
        folder = self._path(self.folder)
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(m[1]) for m in map(_POINTER.fullmatch, names) if m), reverse=True)

    def _name(self, number: int):
        return self._path(f"{self.folder}/_gen-{number:012d}.json")

    def _read(self, number: int) -> dict | None:
        stream = self._fs.open(self._name(number))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None  # its writer stopped before the end
        finally:
            stream.close()

    def state(self) -> dict:
        """The newest complete state; `next` is the number of the pointer that would follow it."""
        numbers = self._pointers()
        found = next((state for n in numbers if (state := self._read(n))), {"generation": 0, "hash": HASH, "tables": {}})
        return {**found, "next": (numbers[0] if numbers else 0) + 1}

    def table(self, name: str, state: dict | None = None, keys: DataFrame | None = None) -> DataFrame:
        """A table's rows; with keys, of one column, only those of a keyed table that lie in the slots of these."""
        state = state or self.state()
        if state["hash"] != HASH:
            raise ValueError(f"the store holds {state['hash']} hashes")
        if name in VIEWS:
            return reduce(DataFrame.unionByName, (self.table(x, state) for x in VIEWS[name]))
        parts = state["tables"].get(name)
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        if name in KEYED:
            slots = None if keys is None else [str(r[0]) for r in keys.select(self._slot(keys.columns[0], parts["slots"])).distinct().collect()]  # as many as there are slots at most
            return self._merged(name, parts, slots)
        return self._parquet(TABLES[name], parts)

    def _parquet(self, columns: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(columns).parquet(*(f"{self.folder}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], columns)

    @staticmethod
    def _slot(key: str, slots: int):
        return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot")

    def _deltas(self, name: str, entry: dict, slots: list[str]) -> DataFrame:
        """The newest row of each key in the deltas of some slots."""
        rows = self._parquet(f"{TABLES[name]}, gone boolean, seq bigint", [x for s in slots for x, _ in entry["deltas"][s]])
        return rows.groupBy(KEYED[name]).agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")

    def _merged(self, name: str, entry: dict, slots: list[str] | None = None) -> DataFrame:
        slots = sorted({*entry["base"], *entry["deltas"]} if slots is None else slots)
        changed = [s for s in slots if entry["deltas"].get(s)]
        base = lambda some: self._parquet(TABLES[name], [entry["base"][s][0] for s in some if s in entry["base"]])
        if not changed:
            return base(slots)
        newest = self._deltas(name, entry, changed)
        rest = base(changed).join(newest.select(KEYED[name]), KEYED[name], "left_anti")
        merged = rest.unionByName(newest.where("not gone").drop("gone", "seq"))
        return base([s for s in slots if s not in changed]).unionByName(merged) if len(changed) < len(slots) else merged

    def draft(self, name: str, df: DataFrame) -> DataFrame:
        """df written beside the tables and read again, so that all that follows sees the same rows."""
        where = f"{self.folder}/drafts/{name}-{uuid.uuid4().hex}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def _rows(self, name: str, df: DataFrame, extra: str = "") -> DataFrame:
        return df.select(*(df[f.name].cast(f.dataType) for f in T.StructType.fromDDL(TABLES[name] + extra)))

    def _write(self, name: str, df: DataFrame, generation: int) -> str:
        where = f"gen={generation}/{name}-{uuid.uuid4().hex}"
        rows = self._rows(name, df)
        if name in SORTED:
            rows = (rows if name in LOCAL else rows.repartitionByRange(*SORTED[name])).sortWithinPartitions(*SORTED[name])
        rows.write.parquet(f"{self.folder}/{where}")
        return where

    def _write_slots(self, name: str, rows: DataFrame, slots: int, generation: int) -> dict[str, list]:
        """[folder, bytes] of each slot that rows have."""
        where = f"gen={generation}/{name}-{uuid.uuid4().hex}"
        rows.withColumn("slot", self._slot(KEYED[name], slots)).repartition("slot").write.partitionBy("slot").parquet(f"{self.folder}/{where}")
        folders = [x.getPath() for x in self._fs.listStatus(self._path(f"{self.folder}/{where}"))]
        return {x.getName()[5:]: [f"{where}/{x.getName()}", self._fs.getContentSummary(x).getLength()] for x in folders if x.getName().startswith("slot=")}

    def _replaced(self, name: str, df: DataFrame, base: dict, generation: int) -> dict:
        """A keyed table as given, with as many slots as suit what it held before."""
        known = base["tables"].get(name) or {"slots": SLOTS, "base": {}, "deltas": {}}
        held = sum(n for _, n in known["base"].values()) + sum(n for x in known["deltas"].values() for _, n in x)
        slots = known["slots"]
        while slots < MOST_SLOTS and held > slots * SLOT_BYTES:
            slots *= 2
        return {"slots": slots, "seq": 0, "base": self._write_slots(name, self._rows(name, df), slots, generation), "deltas": {}}

    def _changed(self, name: str, df: DataFrame, base: dict, generation: int) -> dict:
        """A keyed table with the rows of df in place of those of their keys; those of them that are `gone` have no row then."""
        entry = base["tables"].get(name)
        if not entry:
            return self._replaced(name, df.where("not gone"), base, generation)
        seq, slots = entry["seq"] + 1, entry["slots"]
        written = self._write_slots(name, self._rows(name, df, ", gone boolean").withColumn("seq", F.lit(seq).cast("bigint")), slots, generation)
        folders, deltas = dict(entry["base"]), {s: list(x) for s, x in entry["deltas"].items()}
        due = [s for s in written if len(deltas.get(s, [])) >= MOST_DELTAS]
        size = lambda s: sum(n for _, n in deltas[s])
        large = [s for s in due if size(s) * REWRITE >= folders.get(s, (None, 0))[1]]
        small = [s for s in due if s not in large]
        if large:
            for s in large:
                folders.pop(s, None)
            folders |= self._write_slots(name, self._merged(name, entry, large), slots, generation)
            deltas = {s: x for s, x in deltas.items() if s not in large}
        if small:
            deltas |= {s: [x] for s, x in self._write_slots(name, self._deltas(name, entry, small), slots, generation).items()}
        for s, x in written.items():
            deltas.setdefault(s, []).append(x)
        return {"slots": slots, "seq": seq, "base": folders, "deltas": deltas}

    def commit(self, base: dict | None = None, append: dict[str, DataFrame] | None = None, change: dict[str, DataFrame] | None = None,
               count: dict[str, int] | None = None, **tables: DataFrame) -> int:
        """Write the named tables, rows to append to others and rows to change in keyed ones, as what follows base (the state now, if none is given).

        change: rows with a column `gone`, each key once. count: numbers to add to the state's.
        """
        base = base or self.state()
        append, generation = append or {}, base["generation"] + 1
        tables = dict(tables)
        for name in [n for n in append if len(base["tables"].get(n, [])) >= MOST_PARTS]:
            tables[name] = self.table(name, base).unionByName(append[name].select(*T.StructType.fromDDL(TABLES[name]).names))
        added = {name: self._write(name, df, generation) for name, df in append.items() if name not in tables}
        made = {name: self._replaced(name, df, base, generation) if name in KEYED else [self._write(name, df, generation)] for name, df in tables.items()}
        made |= {name: self._changed(name, df, base, generation) for name, df in (change or {}).items()}
        over = base
        while True:
            kept, counts = dict(over["tables"]), dict(over.get("counts", {}))
            kept.update({name: [*kept.get(name, []), part] for name, part in added.items()})
            kept.update(made)
            for name, n in (count or {}).items():
                counts[name] = counts.get(name, 0) + n
            if self._point(over["next"], {"generation": over["generation"] + 1, "hash": base["hash"], "tables": kept, "counts": counts}):
                return over["generation"] + 1
            over = self.state()
            if any(over["tables"].get(name) != base["tables"].get(name) for name in made):
                raise CommitConflict(f"another writer has changed {', '.join(sorted(made))} since generation {base['generation']}")

    def _point(self, number: int, state: dict) -> bool:
        """Write a pointer; False if somebody has."""
        try:
            out = self._fs.create(self._name(number), False)
        except Exception:  # of the JVM: the file is there
            if self._fs.exists(self._name(number)):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        return True

    @staticmethod
    def _folders(parts: list | dict) -> list[str]:
        return parts if isinstance(parts, list) else [x for x, _ in parts["base"].values()] + [x for some in parts["deltas"].values() for x, _ in some]

    def vacuum(self, keep: int = 2) -> int:
        """Remove what none of the newest `keep` complete states needs; how many folders and pointers went. No writer may be at work."""
        numbers = self._pointers()
        kept = [n for n in numbers if self._read(n)][:keep]
        needed = {p for n in kept for parts in self._read(n)["tables"].values() for p in self._folders(parts)}
        whole = {"/".join(p.split("/")[:2]) for p in needed}
        gone = [self._name(n) for n in numbers if kept and n < kept[-1]]
        for top in ("gen=*", "drafts"):
            for part in self._fs.globStatus(self._path(f"{self.folder}/{top}/*")) or []:
                name = f"{part.getPath().getParent().getName()}/{part.getPath().getName()}"
                if name not in whole:
                    gone.append(part.getPath())
                elif name not in needed:  # some of its slots
                    gone += [x.getPath() for x in self._fs.listStatus(part.getPath()) if x.getPath().getName().startswith("slot=") and f"{name}/{x.getPath().getName()}" not in needed]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
