"""Flat rows to documents with built-in expressions alone.

For tables whose columns are scalars and whose schema is known, the writers' text is put together in
generated code, in the order of the columns. A document for each group comes from one aggregation; rows
in a group are ordered by ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.scalars import escape_csv, escape_xml, format_common_number, quote_string


def scalar_text(df: DataFrame, name: str) -> Column:
    """A column's text as numbers and booleans print; strings as they are."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return format_common_number(column.cast("double"))
    return column.cast("string")


def _is_text(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def cell(df: DataFrame, name: str, fmt: str) -> Column:
    """A column's value as it stands in a document of the format."""
    text = scalar_text(df, name)
    if fmt == "csv":
        return F.coalesce(escape_csv(text, always=True) if _is_text(df, name) else text, F.lit(""))
    if fmt == "xml":
        return escape_xml(text) if _is_text(df, name) else text
    null = F.lit('""') if fmt == "toml" else F.lit("null")
    return F.coalesce(quote_string(text) if _is_text(df, name) else text, null)


def row_document(df: DataFrame, names: list[str], fmt: str) -> Column:
    """One row as a document: an object in JSON, TOML and YAML, header and line in CSV, a root element in XML."""
    if fmt == "json":
        return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), cell(df, n, fmt)) for n in names)), F.lit("}"))
    if fmt in ("toml", "yaml"):
        glue = " = " if fmt == "toml" else ": "
        return F.concat_ws("\n", *(F.concat(F.lit(n + glue), cell(df, n, fmt)) for n in names))
    if fmt == "csv":
        return F.concat(F.lit(",".join(names) + "\n"), F.concat_ws(",", *(cell(df, n, fmt) for n in names)), F.lit("\n"))
    return F.concat(F.lit("<root>"), row_elements(df, names), F.lit("</root>"))


def row_elements(df: DataFrame, names: list[str]) -> Column:
    def element(n: str) -> Column:
        return F.coalesce(F.when(scalar_text(df, n) != "", F.concat(F.lit(f"<{n}>"), cell(df, n, "xml"), F.lit(f"</{n}>"))), F.lit(f"<{n}/>"))

    return F.concat(*map(element, names))


def group_documents(df: DataFrame, by: list[str], names: list[str], order: list[str], fmt: str, name: str = "content") -> DataFrame:
    """A document of all rows of each group. A group's rows meet in one row: that is the document."""
    if fmt == "json":
        line, before, glue, after = row_document(df, names, fmt), "[", ",", "]"
    elif fmt == "csv":
        line, before, glue, after = F.concat_ws(",", *(cell(df, n, fmt) for n in names)), ",".join(names) + "\n", "\n", "\n"
    elif fmt == "xml":
        line, before, glue, after = F.concat(F.lit("<row>"), row_elements(df, names), F.lit("</row>")), "<root>", "", "</root>"
    elif fmt == "toml":
        inline = F.concat_ws(", ", *(F.concat(F.lit(f"{n} = "), cell(df, n, fmt)) for n in names))
        line, before, glue, after = F.concat(F.lit("{"), inline, F.lit("}")), "rows = [", ", ", "]"
    else:
        first, *rest = names
        lines = [F.concat(F.lit(f"- {first}: "), cell(df, first, fmt)), *(F.concat(F.lit(f"  {n}: "), cell(df, n, fmt)) for n in rest)]
        line, before, glue, after = F.concat_ws("\n", *lines), "", "\n", ""
    rows = df.select(*by, F.struct(*order, line.alias("_line")).alias("_row"))
    lines = F.transform(F.array_sort(F.collect_list("_row")), lambda r: r["_line"])
    return rows.groupBy(*by).agg(F.concat(F.lit(before), F.array_join(lines, glue), F.lit(after)).alias(name))
