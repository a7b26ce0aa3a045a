"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is a plain run of little-endian identifiers in which an end-of-document identifier
ends each document; there is no index. Files are cut into fixed blocks; each block is searched
for separators with one vectorised comparison and gives the counts of the documents wholly
inside, the tokens before its first separator (head) and after its last (tail). A prefix scan
over the block summaries of a file stitches documents across blocks, also those that span many.

``write_tokens`` makes such files from texts with a public byte-level vocabulary (its path is a
parameter) and lists which document is where. A task that is run again writes another file, and
only the files of tasks that ended are listed. Defined cases: null and empty texts have 0
tokens; tokens after the last separator are a document without end; an empty file has no
documents; rows that repeat an id are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import name
from .kernels import bounded
from .scratch import scratch, shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def file_format(vocabulary: str, eod: int | None = None) -> tuple[int, str]:
    """(end-of-document identifier, type of an identifier): by default the first one past the vocabulary's; two bytes if all fit, else four."""
    top = encoder(vocabulary).max_token_value
    eod = top + 1 if eod is None else eod
    if eod in encoder(vocabulary)._mergeable_ranks.values():
        raise ValueError(f"identifier {eod} stands for a token of the vocabulary")
    return eod, "<u2" if max(top, eod) < 1 << 16 else "<u4"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, eod: int | None = None) -> DataFrame:
    """Write token files; (file, ordinal, doc_id) of their documents, ``ordinal`` from 0. Lazy: read it once, or write it down first."""
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
    eod, dtype = file_format(vocabulary, eod)

    def kernel(batches):
        encode = encoder(vocabulary).encode_ordinary
        uri, ordinal = f"{folder}/{uuid.uuid4().hex}.tokens", 0
        system, path = _filesystem(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            for part in bounded(batches, 1, rows=256, size=1 << 20):
                ids = [x for t in part.column(1).to_pylist() for x in (*encode(t or ""), eod)]
                out.write(np.array(ids, dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([uri] * part.num_rows), pa.array(range(ordinal, ordinal + part.num_rows), pa.int64()), part.column(0)], schema=schema)
                ordinal += part.num_rows

    return docs.select(name(id_col).cast("long").alias("doc_id"), name(text_col).cast("string").alias("text")).mapInArrow(kernel, "file string, ordinal long, doc_id long")


def count_tokens(files: DataFrame, eod: int, dtype: str = "<u2", block_tokens: int = 1 << 22) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in the files of column ``file``."""
    spark: SparkSession = files.sparkSession
    width = np.dtype(dtype).itemsize

    def sizes(batches):
        for b in batches:
            n = []
            for uri in b.column(0).to_pylist():
                system, path = _filesystem(uri)
                n.append(system.get_file_info(path).size // width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["file", "tokens"])

    blocks = files.select("file").distinct().mapInArrow(sizes, "file string, tokens long").where("tokens > 0")
    blocks = blocks.select("file", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / block_tokens).cast("long"))).alias("block"))
    blocks = blocks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "block")

    def scan(batches):
        for b in batches:
            for uri, tokens, block in zip(*(b.column(k).to_pylist() for k in range(3))):
                first = block * block_tokens
                system, path = _filesystem(uri)
                with system.open_input_file(path) as f:
                    x = np.frombuffer(f.read_at(min(block_tokens, tokens - first) * width, first * width), dtype)
                at = np.flatnonzero(x == eod)
                head = int(at[0]) if len(at) else len(x)
                tail = len(x) - int(at[-1]) - 1 if len(at) else 0
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([at.astype(np.int64)], pa.list_(pa.int64()))], names=["file", "block", "first", "n", "head", "tail", "at"])

    found = scratch(blocks.select("file", "tokens", "block").mapInArrow(scan, "file string, block long, first long, n long, head long, tail long, at array<long>"), "blocks")
    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    # where the open document of a block began: just after the last separator of any block before
    end = F.max(F.when(F.col("n") > 0, F.col("first") + F.get("at", (F.col("n") - 1).cast("int")) + 1)).over(before)
    sums = found.select("file", "block", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), F.coalesce(end, F.lit(0)).alias("opened"), F.lead("block").over(upto).isNull().alias("last"))
    joined = found.drop("n").join(sums, ["file", "block"])
    closed = joined.select("file", "ordinal", "opened", "first", "at", F.posexplode("at").alias("k", "here"))
    start = F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("first") + F.get("at", F.col("k") - 1) + 1)
    ended = closed.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("first") + F.col("here") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    size = F.col("first") + F.col("head") + F.when(F.col("n") > 0, F.get("at", (F.col("n") - 1).cast("int")) - F.get("at", F.lit(0)) + 1 + F.col("tail")).otherwise(0)
    opened = F.when(F.col("n") > 0, F.col("first") + F.get("at", (F.col("n") - 1).cast("int")) + 1).otherwise(F.col("opened"))
    rest = joined.where("last").select("file", (F.col("ordinal") + F.col("n")).alias("ordinal"), opened.alias("start"), (size - opened).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(rest)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, eod: int | None = None, block_tokens: int = 1 << 22) -> DataFrame:
    """Write token files of ``docs`` to the shared folder and count them: doc_id, n_tokens, file, start."""
    eod, dtype = file_format(vocabulary, eod)
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    index = scratch(write_tokens(docs, folder, id_col, text_col, vocabulary, eod), "index")
    return index.join(count_tokens(index, eod, dtype, block_tokens), ["file", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "file", "start")
