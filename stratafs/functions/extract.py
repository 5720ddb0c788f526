"""What is kept of a file's content: hashes, title, summary, structure, topics, search text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import paths as P
from . import text as X

SEARCH_BYTES = 102_400


def document_rows(contents: DataFrame, search_bytes: int = SEARCH_BYTES) -> DataFrame:
    """(path, content_hash, body_hash, full_body, title, summary, structure, topics, is_binary, byte_size, search_text).

    contents: (path, content_hash, content, is_large, size_bytes). body_hash is null unless
    the content has frontmatter; full_body is the hash of the body in any case. A large
    file is binary and its body is its content. Markdown that isn't UTF-8 is binary too.
    """
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    base = contents.withColumn("t", decoded).withColumn("ext", P.extension(F.col("path")))
    markdown = F.col("ext").isin("md", "markdown")
    binary = F.col("is_large") | X.is_binary(F.col("content")) | (markdown & F.col("t").isNull())
    base = base.withColumn("is_binary", F.coalesce(binary, F.lit(False))).withColumn("md", F.coalesce(markdown, F.lit(False)) & ~F.col("is_binary"))
    plain = ~F.col("is_binary") & ~F.col("md")
    text = F.coalesce("t", F.lit(""))
    body = F.when(F.col("md"), X.body(text))
    full_body = F.when(F.col("t").isNotNull(), X.sha256(X.body(text))).otherwise(F.col("content_hash"))
    no_sections = F.array().cast("array<struct<heading:string,level:int,line:int>>")
    return base.select(
        "path", "content_hash",
        F.when(full_body != F.col("content_hash"), full_body).alias("body_hash"), full_body.alias("full_body"),
        F.when(F.col("is_binary"), P.basename(F.col("path"))).when(F.col("md"), X.markdown_title(body)).otherwise(P.stem(F.col("path"))).alias("title"),
        F.when(F.col("md"), X.markdown_summary(body)).when(plain, X.text_summary(text)).alias("summary"),
        F.when(F.col("md"), X.headings(body)).otherwise(no_sections).alias("structure"),
        F.when(F.col("md"), X.topics(body)).otherwise(F.array().cast("array<string>")).alias("topics"),
        "is_binary", F.col("size_bytes").alias("byte_size"),
        F.when(~F.col("is_binary"), X.truncated(text, search_bytes)).alias("search_text"),
    )
