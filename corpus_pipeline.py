"""A corpus pipeline of the operators in stratafs.llm: documents in, packed pieces out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents. n_chars is always that of the text as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafs.llm import packing, pii, quality, similar, substrings
from stratafs.llm.common import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What goes along where a stage makes a new text.
KEPT = ("doc_id", "lang", "source")


def _columns(df: DataFrame, text: str) -> DataFrame:
    """df's struct `row` with another text, as the columns of documents."""
    return df.select("row.doc_id", F.col(text).alias("text"), "row.lang", "row.source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.apply_policy(quality.ledger(docs, keep=COLUMNS)).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one of the least id.

    Rows of one id are told apart by their place in the order of their columns, and only
    the first of the least id stays. Documents without an id are a group's choice only if
    it has no other.
    """
    # rows of one doc_id have to be told apart, so groups are found over a key of the row
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("row"))
    groups = similar.near_duplicates(docs.select(key.alias("key"), "text").distinct(), "key", "text")
    firsts = groups.where(F.col("key") == F.col("component_id")).select("key")
    return docs.withColumn("key", key).join(firsts, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that start earlier elsewhere."""
    return _columns(substrings.remove_repeats(docs, keep=KEPT), "kept")


def pii_sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that reveal it, replaced."""
    return _columns(pii.sanitise(docs, keep=KEPT), "sanitised")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", pii_sanitised),
    ("packing", packed),
]

#: Substring dedup and packing have no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i + 1}")
    return docs
