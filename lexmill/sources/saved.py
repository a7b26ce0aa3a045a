"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_inner: ContextVar[str] = ContextVar("inner", default="")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, as in tests, a temporary folder of a local session; an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}{_inner.get()}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``saved`` returned and that nothing will read again; others are let be."""
    for t in tables:
        if path := getattr(t, "_saved_at", None):
            _delete(t.sparkSession, path)


@contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end; write or collect the result inside."""
    folder = f"/scope-{uuid.uuid4().hex}"
    token = _inner.set(_inner.get() + folder)
    path = shared_folder(spark) + _inner.get()
    try:
        yield
    finally:
        _inner.reset(token)
        _delete(spark, path)
