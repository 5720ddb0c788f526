"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: The same characters one by one, for translate().
GAP_CHARS = " \t\n\x0b\x0c\r"
#: How wide rows are written: sizes are looked at after each row, not after a hundred, and row groups, which readers hold whole, are small.
WIDE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, 9, 10, 11, 12, 13]] = True


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, which is then computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def word_bounds(data: bytes, gaps: np.ndarray = _GAPS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of UTF-8 data; gaps tells of each byte whether it stands between words."""
    inside = ~gaps[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what spark.checkpoint.dir names. Only where that is unset and all runs in one
    process, as in tests, is a temporary folder taken; a cluster without it is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        where = sc.getCheckpointDir()
        if not where and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = where or tempfile.mkdtemp(prefix="stratafs-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str, compression: str | None = None, wide: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again; wide: its rows have megabytes, so few are written and read at once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**WIDE_ROWS if wide else {}).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
