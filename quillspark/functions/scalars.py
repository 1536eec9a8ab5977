"""Column expressions for the scalar rules: all of them run inside generated code, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end (``trim`` knows the space alone)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def number_of(text: Column) -> Column:
    """The finite number that the text spells, else null. Guards what a cast would also take (``1d``, ``inf``)."""
    x = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def infer_kind(text: Column) -> Column:
    """null, bool, number or string: what an untyped, already trimmed cell holds."""
    low = F.lower(text)
    return F.when((text == "") | (low == "null"), "null").when(low.isin("true", "false"), "bool").when(number_of(text).isNotNull(), "number").otherwise("string")


def infer_scalar(text: Column) -> Column:
    """STRUCT<kind, num, bool, str> of a trimmed cell; a null cell is of kind null."""
    text = F.coalesce(text, F.lit(""))
    kind = infer_kind(text)
    boolean = F.when(kind == "bool", F.lower(text) == "true")
    return F.struct(kind.alias("kind"), F.when(kind == "number", number_of(text)).alias("num"), boolean.alias("bool"), F.when(kind == "string", text).alias("str"))


def format_number(x: Column) -> Column:
    """Shortest digits without exponent, for 0 and magnitudes from 1e-3 to below 1e15; others by the kernel.

    Numbers that aren't finite print as ``inf``, ``-inf`` and ``NaN``.
    """
    from quillspark.functions.documents import format_number_exact

    whole = F.when(x.cast("string") == "-0.0", F.lit("-0")).otherwise(x.cast("bigint").cast("string"))
    digits = x.cast("string").cast("decimal(38,22)").cast("string")
    fraction = F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))
    common = (F.abs(x) < 1e15) & ((x == F.floor(x)) | (F.abs(x) >= 1e-3))
    return F.when(x.isNull(), None).when(common & (x == F.floor(x)), whole).when(common, fraction).otherwise(format_number_exact(F.when(~common, x)))


def format_common_number(x: Column) -> Column:
    """``format_number`` for callers that know their numbers to be in the common range: no kernel in the plan."""
    fraction = F.rtrim(F.rtrim(x.cast("string").cast("decimal(38,22)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(fraction)


def detect_format(path: Column) -> Column:
    """Format by the path's extension, in any case; null if it has none or another."""
    name = F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    return F.when(extension.isin("json", "jsonc"), "json").when(extension.isin("yaml", "yml"), "yaml").when(extension.isin("csv", "toml", "xml"), extension)


def is_jsonc(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1)) == "jsonc"


#: Control characters without a short escape.
_CONTROLS = [i for i in range(32) if chr(i) not in "\n\r\t"]


def escape_string(text: Column) -> Column:
    """As JSON, TOML and YAML strings have it, without the quotes."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    rare = text
    for i in _CONTROLS:
        rare = F.replace(rare, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.when(text.rlike(r"[\x00-\x1f]"), rare).otherwise(text)


def quote_string(text: Column) -> Column:
    return F.concat(F.lit('"'), escape_string(text), F.lit('"'))


def escape_xml(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def escape_csv(text: Column, always: bool = False) -> Column:
    """A cell, in quotes if asked for or if it holds a comma, a quote or a line end."""
    inside = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return inside if always else F.when(text.rlike('[",\r\n]'), inside).otherwise(text)


def error_text(error: Column) -> Column:
    """An error struct as ``error at offset:line:col: message``, or the message alone without a place."""
    at = error["start"]
    placed = F.format_string("error at %d:%d:%d: %s", at["offset"], at["line"], at["col"], error["message"])
    return F.when(at.isNull(), error["message"]).otherwise(placed)
