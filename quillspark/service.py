"""The request-and-response front end, over DataFrames of requests.

Errors are answers, not failures: a parse gives status ``ok`` or ``err``, a conversion ``ok`` or ``error``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.kernels import convert as kernel
from quillspark.kernels import json_doc
from quillspark.kernels.core import RELAXED, DocError, Options
from quillspark.kernels.csv_doc import check_delimiter

FORMATS = ("json", "jsonc", "csv", "toml", "yaml", "xml")


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok",)], "status string")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f) for i, f in enumerate(FORMATS)], "pos int, format string")


def options_for(fmt: str, delimiter: str | None) -> Options:
    """jsonc is relaxed JSON; a delimiter outside ASCII is ignored, any other must be a valid one."""
    if fmt == "jsonc":
        return RELAXED
    return Options(delimiter=check_delimiter(delimiter)) if fmt == "csv" and delimiter and delimiter.isascii() else Options()


def parse_response(content: str, fmt: str, delimiter: str | None = None) -> dict:
    """status and data (JSON text) or error. JSON goes through a strict reader as well."""
    try:
        text = kernel.convert(content, fmt, "json", options_for(fmt, delimiter))
        return {"status": "ok", "data": json_doc.emit(kernel.parse(text, "json")), "error": None}
    except DocError as e:
        return {"status": "err", "data": None, "error": str(e)}


def convert_response(content: str, source: str, target: str, delimiter: str | None = None) -> dict:
    try:
        return {"status": "ok", "content": kernel.convert(content, source, target, options_for(source, delimiter))}
    except DocError as e:
        return {"status": "error", "content": str(e)}


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def respond_parse(requests: DataFrame) -> DataFrame:
    """``requests`` (content, format, csv_delimiter if there is one) with ``response`` STRUCT<status, data, error>."""

    @F.arrow_udf("STRUCT<status: STRING, data: STRING, error: STRING>")
    def answer(content: pa.Array, fmt: pa.Array, delimiter: pa.Array) -> pa.Array:
        rows = [parse_response(*x) for x in zip(content.to_pylist(), fmt.to_pylist(), delimiter.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([("status", pa.string()), ("data", pa.string()), ("error", pa.string())]))

    return requests.withColumn("response", answer(F.coalesce("content", F.lit("")), F.lower("format"), _optional(requests, "csv_delimiter")))


def respond_convert(requests: DataFrame) -> DataFrame:
    """``requests`` (content, from, to, csv_delimiter if there is one) with ``response`` STRUCT<status, content>."""

    @F.arrow_udf("STRUCT<status: STRING, content: STRING>")
    def answer(content: pa.Array, source: pa.Array, target: pa.Array, delimiter: pa.Array) -> pa.Array:
        rows = [convert_response(*x) for x in zip(content.to_pylist(), source.to_pylist(), target.to_pylist(), delimiter.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([("status", pa.string()), ("content", pa.string())]))

    return requests.withColumn("response", answer(F.coalesce("content", F.lit("")), F.lower(F.col("from")), F.lower(F.col("to")), _optional(requests, "csv_delimiter")))
