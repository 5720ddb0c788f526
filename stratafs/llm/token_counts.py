"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import documents

#: Strings that the vocabulary's file declares as special tokens.
SPECIAL = (("<|endoftext|>", 50256),)
#: Stands between the texts of a batch, as a special token of its own; a text that holds it
#: is encoded by itself.
SEPARATOR = "\ue000\uf8ff|text ends|\uf8ff\ue000"
SEPARATOR_ID = 1 << 20


def _lengths(parts: list[str], vocabulary: str, ranks: str | None) -> list[int]:
    if vocabulary.endswith(".model"):
        return [len(x) for x in bpe.piece_model(vocabulary).encode(parts, num_threads=1)]
    if ranks is None:
        batch = bpe.json_tokenizer(vocabulary).encode_batch_fast(parts, add_special_tokens=False)
        return [len(x) for x in batch]
    if any(SEPARATOR in x for x in parts):
        alone = bpe.rank_encoding(ranks, public_tokenizers.PATTERN, SPECIAL)
        return [alone.encode_to_numpy(x, allowed_special="all").size for x in parts]
    # one call encodes the batch: a special token splits it before the pattern does, so each text's tokens are its own
    encoding = bpe.rank_encoding(ranks, public_tokenizers.PATTERN, (*SPECIAL, (SEPARATOR, SEPARATOR_ID)))
    ids = encoding.encode_to_numpy(SEPARATOR.join(parts), allowed_special="all")
    ends = np.concatenate((np.flatnonzero(ids == SEPARATOR_ID), [len(ids)]))
    return (np.diff(ends, prepend=-1) - 1).tolist()


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, ranks: str | None = None, limit: int = 512,
) -> DataFrame:
    """One row for each row of docs: its id, n_bytes, n_tokens, over_limit.

    vocabulary: a file of tokenizers (.json) or sentencepiece (.model). ranks: the same
    byte-level vocabulary as ranks, by which the same ids come several times faster;
    the tests hold the two against each other. Long texts are cut where no token can
    reach across (byte-level BPE only), and batches are balanced by bytes.

    Nulls and empty texts count 0 tokens; a null id stays null; equal rows each give a
    row; other columns of docs are left aside, whatever their names; an empty table
    gives an empty result.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    cut = ranks is not None or vocabulary.endswith("byte_bpe_50k.json")

    def run(batches):
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            for owners, parts in bpe.byte_batches(texts) if cut else [(range(len(texts)), texts)]:
                for owner, n in zip(owners, _lengths(parts, vocabulary, ranks), strict=True):
                    counts[owner] += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    ).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return count_tokens(documents(spark, sf_dir), vocabulary=path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken"))
