"""Documents as typed rows, and rows as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.documents import exploded, parse_doc
from quillspark.kernels.core import Options


def infer_schema(df: DataFrame, value: str = "value") -> str:
    """The DDL type that holds all values of a VARIANT column, from one aggregate over all rows."""
    return df.agg(F.schema_of_variant_agg(F.col(value)).alias("schema")).first()["schema"].replace("OBJECT<", "STRUCT<")


def typed(df: DataFrame, schema: str | T.DataType, value: str = "value", name: str = "row") -> DataFrame:
    """A VARIANT column as a column of ``schema``; what doesn't fit is null."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return df.withColumn(name, F.try_variant_get(F.col(value), "$", ddl))


def records(df: DataFrame, fmt: str | Column, keep: list[str], content: str = "content", options: Options = Options()) -> DataFrame:
    """A row (pos, value) for each element of a document that is an array of objects, one for another document."""
    parsed = df.select(*keep, parse_doc(F.col(content), fmt, options)["json"].alias("json"))
    value = F.try_parse_json("json")
    both = parsed.select(*keep, value.alias("value"))
    elements = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array("value"))
    return both.where("value is not null").select(*keep, F.posexplode(elements).alias("pos", "value"))


def csv_cells(df: DataFrame, keep: list[str], content: str = "content", delimiter: str = ",") -> DataFrame:
    """row, pos, key, kind, num, str, bool of each cell of CSV documents."""
    return exploded(df, "csv_rows", keep, F.col(content), F.lit(delimiter))


def csv_table(cells: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Cells as a table of declared columns (name to ``double``, ``string`` or ``boolean``)."""
    field = {"double": "num", "string": "str", "boolean": "bool"}
    picked = [F.max(F.when(F.col("key") == n, F.col(field[t]))).alias(n) for n, t in columns.items()]
    return cells.groupBy(*keys, "row").agg(*picked)
