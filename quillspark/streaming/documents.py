"""Streams of documents. Kernels keep no state, so they run on streams as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.documents import convert_doc, with_parsed
from quillspark.kernels.core import Options


def parse_stream(stream: DataFrame, fmt: str = "json", content: str = "content", options: Options = Options()) -> DataFrame:
    """The stream with value, json and error."""
    return with_parsed(stream, fmt, content, options)


def convert_stream(stream: DataFrame, source: str, target: str, content: str = "content", options: Options = Options()) -> DataFrame:
    """The stream with ``converted`` and ``error``."""
    return stream.withColumn("_c", convert_doc(F.col(content), source, target, options)).select(*stream.columns, F.col("_c.content").alias("converted"), F.col("_c.error").alias("error"))


def error_counts(parsed: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents and errors by window of arrival; rows later than ``late`` are left out."""
    at = F.window(time, window).alias("window")
    kind = F.coalesce("error.kind", F.lit("ok")).alias("kind")
    return parsed.withWatermark(time, late).groupBy(at, kind).agg(F.count("*").alias("n"))


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, to Parquet, exactly once; returns when done."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
