"""The event feed as a streaming source: spark.readStream.format("eventfeed").option("store", folder).load().

Offsets are event ids. A batch reads the parts of the newest state whose ids fall in its
range, so compaction and appends change nothing for a reader. A reader whose next event was
pruned fails instead of leaving a gap. Files are read by pyarrow, from any file system that
it knows by the folder's address.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schema import EVENTS

_KINDS = {"bigint": pa.int64(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC")}
_POINTER = re.compile(r"_gen-(\d{12})\.json")


class CursorExpired(Exception):
    """Events behind a reader's cursor have been pruned."""


class EventRange(InputPartition):
    def __init__(self, file: str, after: int, last: int):
        self.file, self.after, self.last = file, after, last


class EventReader(DataSourceStreamReader):
    def __init__(self, folder: str, cursor: int):
        self.folder, self.cursor = folder, cursor

    def _open(self):
        return pa.fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pa.fs.LocalFileSystem(), self.folder)

    def _files(self) -> list[tuple[str, int, int]]:
        """(file, least id, largest id) of the newest state's events."""
        fs, root = self._open()
        names = [x.base_name for x in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))]
        for name in sorted((n for n in names if _POINTER.fullmatch(n)), reverse=True):
            with fs.open_input_stream(f"{root}/{name}") as f:
                try:
                    state = json.loads(f.read())
                except json.JSONDecodeError:
                    continue  # its writer stopped before the end
            break
        else:
            return []
        out = []
        for part in state["tables"].get("events", []):
            for info in fs.get_file_info(pa.fs.FileSelector(f"{root}/{part}")):
                if info.base_name.endswith(".parquet"):
                    meta = pq.read_metadata(info.path, filesystem=fs)
                    at = meta.schema.names.index("id")
                    stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
                    if stats:
                        out.append((info.path, min(s.min for s in stats), max(s.max for s in stats)))
        return out

    def initialOffset(self) -> dict:
        return {"id": self.cursor}

    def latestOffset(self) -> dict:
        return {"id": max([self.cursor, *(last for *_, last in self._files())])}

    def partitions(self, start: dict, end: dict) -> list[EventRange]:
        files = self._files()
        least = min((first for _, first, _ in files), default=None)
        if end["id"] > start["id"] and (least is None or (start["id"] > 0 and least > start["id"] + 1)):
            raise CursorExpired(f"events behind {start['id']} were pruned; the first left is {least}")
        return [EventRange(file, start["id"], end["id"]) for file, first, last in files if first <= end["id"] and last > start["id"]]

    def read(self, partition: EventRange) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open()
        wanted = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in EVENTS.split(", "))])
        table = pq.read_table(partition.file, filesystem=fs, filters=[("id", ">", partition.after), ("id", "<=", partition.last)])
        yield from table.select(wanted.names).cast(wanted).to_batches()

    def commit(self, end: dict) -> None:
        self.cursor = end["id"]


class EventFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eventfeed"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> EventReader:
        return EventReader(self.options["store"], int(self.options.get("cursor", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventFeed)
