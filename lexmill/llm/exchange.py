"""Chunk/block exchange: collection-wide statistics of hashed items without a row per item.

Documents are hashed into *chunks*; all chunks together hold the collection. Each chunk
sends every *block* (a range of the hash space) one compressed row with its distinct
items, a block answers each chunk with one compressed row, and the chunk, regrouped
with its documents, uses the answers. Items of a hot key are merged within each chunk
before they travel, so a block receives at most one entry per chunk and item. There are
as many blocks as chunks, and both follow the bytes of text (``CHUNK_BYTES`` each), so that
neither a chunk nor a block grows with the collection, whatever ``spark.sql.shuffle.partitions``
is. A row is sent only where a chunk has items of a block: there are never more rows than
distinct items of the chunks. The shuffle of the documents is one Exchange node that Spark
reuses. Rows equal in id and text share a chunk, so that a chunk grows with the copies of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_MAX = (1 << 63) - 1


#: Text per chunk; small inputs are cut finer, down to a sixteenth, until every core has a chunk.
CHUNK_BYTES = 16 << 20


def chunk_count(df: DataFrame, text_col: str) -> int:
    """Chunks for the bytes of a text column, which are summed once."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    whole = -(-total // CHUNK_BYTES)
    return max(1, whole, min(df.sparkSession.sparkContext.defaultParallelism, 16 * total // CHUNK_BYTES))


def chunked(df: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """(chunk, doc_id, text); equal ids with different texts may part, a null id is kept as null."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return df.select(F.pmod(F.xxhash64(i, t), F.lit(chunks)).cast("int").alias("chunk"), i.alias("doc_id"), t.alias("text"))


def exchange(sent: DataFrame, reduce, schema: str = "chunk int, kind int, block int, data binary") -> DataFrame:
    """Group what the chunks sent by block and let ``reduce(table) -> table`` answer."""
    return sent.groupBy("block").applyInArrow(reduce, schema)


def back(docs: DataFrame, answers: DataFrame, use, schema: str) -> DataFrame:
    """Bring the answers to the chunks' documents."""
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(use, schema)


def name(c: str) -> Column:
    return F.col(f"`{c}`")
