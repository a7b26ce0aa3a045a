"""The same counts over streams: kernels are stateless, counts are stateful aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TokenSpec
from ..operators.text import types_of


def stream_lines(spark, path: str) -> DataFrame:
    """(value): lines of the files that arrive in a folder."""
    return spark.readStream.option("lineSep", "\n").text(path)


def stream_census(df: DataFrame, text: str = "text", spec: TokenSpec = TokenSpec(), ts: str | None = None, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(item, weight), or per tumbling window of event time ``ts`` with a watermark that drops rows later than ``late``."""
    if ts is None:
        return df.select(F.explode(types_of(F.col(text), spec)).alias("item")).groupBy("item").agg(F.count("*").cast("double").alias("weight"))
    timed = df.withWatermark(ts, late).select(F.col(ts), F.explode(types_of(F.col(text), spec)).alias("item"))
    return timed.groupBy(F.window(ts, window), "item").agg(F.count("*").cast("double").alias("weight")).select(F.col("window.start").alias("window_start"), "item", "weight")
