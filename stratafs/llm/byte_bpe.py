"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import documents


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row; no special tokens, long texts cut at safe places.

    A null text is an empty one and has no ids; a null id stays null; equal rows each
    give a row; other columns are left aside; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoding = bpe.rank_encoding(rank_file, pattern)
        for batch in batches:
            ids = [[t for part in bpe.safe_parts(x or "") for t in encoding.encode_ordinary(part)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return got.select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the raw bytes of each row's ids, which need not be whole characters.

    Null ids are an empty list. An id outside the vocabulary fails the task.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        encoding = bpe.rank_encoding(rank_file, pattern)
        for batch in batches:
            data = [encoding.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    got = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, data binary")
    return got.select(F.col("id").alias(id_col), "data")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass, as digests: (id, n_tokens, ids_sha256, decoded_sha256).

    The ids of a text never leave the worker, so nothing as large as they are is sent
    back to Spark. Nulls, repeated rows and empty tables as in encode().
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoding = bpe.rank_encoding(rank_file, pattern)
        names = [str(i) for i in range(encoding.n_vocab)]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                listed, raw, n = hashlib.sha256(), hashlib.sha256(), 0
                for part in bpe.safe_parts(text or ""):
                    ids = encoding.encode_ordinary(part)
                    if ids:
                        listed.update((" " if n else "").encode() + " ".join([names[i] for i in ids]).encode())
                        raw.update(encoding.decode_bytes(ids))
                        n += len(ids)
                rows.append((n, listed.hexdigest(), raw.hexdigest()))
            n, ids, raw = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return got.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
