"""Whole files as documents, and documents as files, on any file system that the engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.documents import refused, size_limit, with_parsed
from quillspark.functions.scalars import detect_format, is_jsonc
from quillspark.kernels.core import Options


def read_documents(spark: SparkSession, path: str | list[str], fmt: str | None = None, glob: str | None = None) -> DataFrame:
    """path, format, content: one row per file. Without ``fmt`` the extension decides."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return _named(files, fmt).drop("length")


def _named(files: DataFrame, fmt: str | None) -> DataFrame:
    own = F.when(is_jsonc(F.col("path")), "jsonc").otherwise(detect_format(F.col("path")))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    length = [c for c in files.columns if c == "length"]
    return files.select("path", (F.lit(fmt) if fmt else own).alias("format"), text.alias("content"), (text.isNull() & (F.length("content") > 0)).alias("invalid_utf8"), *length)


def read_parsed(spark: SparkSession, path: str | list[str], fmt: str | None = None, options: Options = Options(), mode: str = "PERMISSIVE") -> DataFrame:
    """Files with their value, ordered JSON and error. Files of over twice a size limit are refused by their length, unread."""
    files = spark.read.format("binaryFile").load(path)
    own = _named(files, fmt).where(F.col("format").isNotNull())
    limit = size_limit(F.col("format"), options)
    small = with_parsed(own.where((F.col("length") <= 2 * limit) | (limit == 0)).drop("length"), F.col("format"), "content", options, mode)
    if mode != "PERMISSIVE":
        return small
    large = own.where((F.col("length") > 2 * limit) & (limit > 0))
    content = (F.lit(None).cast(t).alias(c) if c in ("content", "value", "json") else refused(limit).alias(c) if c == "error" else F.lit(False).alias(c) if c == "invalid_utf8" else F.col(c) for c, t in small.dtypes)
    return small.unionByName(large.select(*content))


def stream_documents(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A stream of the files that arrive at ``path``, whole, as ``read_documents`` has them."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content"))
    return _named(named, fmt)


def read_csv_table(spark: SparkSession, path: str, delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """Large uniform CSV files through the engine's own, splittable reader."""
    reader = spark.read.options(header=True, sep=delimiter, quote='"', escape='"', multiLine=False)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_xml_rows(spark: SparkSession, path: str, row_tag: str = "row", schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def write_documents(df: DataFrame, path: str, content: str = "content", by: str | None = None) -> None:
    """Documents as text files, a line end after each. With ``by``, a column that identifies a document, each has a file of
    its own in a folder of that value; without it, documents of a task share a file, which suits formats of one line."""
    rows = df.select(*([by] if by else []), F.col(content).alias("value"))
    (rows.write.partitionBy(by) if by else rows.write).text(path)
