"""Document functions: Arrow kernels that take columns of documents and table functions over one document.

A kernel sees whole batches, keeps parsing and writing in one worker, and returns the ordered JSON text
with a typed error; VARIANT values are derived from the text in the JVM (``with_value``). Documents of over
twice the size limit are refused before the kernel, without a place; the kernel tells where others pass it.
Null content gives a null result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.kernels import convert as kernel
from quillspark.kernels import csv_doc, json_doc, xml_doc
from quillspark.kernels.core import DocError, Options, Places, kind_of
from quillspark.kernels.core import format_number as kernel_format_number

PLACE = "STRUCT<offset: BIGINT, line: INT, col: INT>"
ERROR = f"STRUCT<kind: STRING, message: STRING, start: {PLACE}, end: {PLACE}, max: BIGINT, key: STRING, expected: STRING, found: STRING>"
PARSED = f"STRUCT<json: STRING, error: {ERROR}>"
CONVERTED = f"STRUCT<content: STRING, error: {ERROR}>"

_place = pa.struct([("offset", pa.int64()), ("line", pa.int32()), ("col", pa.int32())])
_error = pa.struct([("kind", pa.string()), ("message", pa.string()), ("start", _place), ("end", _place), ("max", pa.int64()), ("key", pa.string()), ("expected", pa.string()), ("found", pa.string())])


#: Bytes of documents that a worker holds as Python values at once, and bytes and rows of a batch that it sends.
PIECE_BYTES, MOST_ROWS = 4 << 20, 10_000


def _pieces(content: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of consecutive slices of about ``PIECE_BYTES`` each, one document at least."""
    start = size = 0
    for i, n in enumerate([] if pa.types.is_null(content.type) else pc.binary_length(content).to_pylist()):
        if i > start and size + (n or 0) > PIECE_BYTES:
            yield start, i - start
            start, size = i, 0
        size += n or 0
    if start < len(content):
        yield start, len(content) - start


def _result(field: str, values: list, errors: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(values, pa.string()), pa.array(errors, _error)], [field, "error"])


def _each(content: pa.Array, formats: list[pa.Array], work, field: str) -> pa.Array:
    """The struct of each document; those of a piece alone are Python values at a time."""
    parts = []
    for start, n in _pieces(content):
        values, errors = [], []
        for text, *names in zip(*(c.slice(start, n).to_pylist() for c in (content, *formats)), strict=True):
            value = error = None
            if text is not None:
                try:
                    value = work(kernel.text_of(text), *names)
                except DocError as e:
                    error = e.record()
            values.append(value)
            errors.append(error)
        parts.append(_result(field, values, errors))
    return pa.concat_arrays(parts) if parts else _result(field, [], [])


@lru_cache(maxsize=256)
def options_of(text: str | None) -> Options:
    """Options from their JSON text; null: the defaults."""
    return Options(**(json.loads(text) if text else {}))


def _format_column(fmt: str | Column) -> Column:
    return F.lit(fmt) if isinstance(fmt, str) else fmt


def size_limit(fmt: Column, options: Options = Options()) -> Column:
    """The size limit of a format in bytes; 0 is none. YAML has none."""
    out = F.when(F.lower(fmt).isin("yaml", "yml"), F.lit(0)).otherwise(F.lit(options.size("csv")))
    for name in ("json", "jsonc", "toml", "xml"):
        out = F.when(F.lower(fmt) == name, F.lit(options.size("json" if name == "jsonc" else name))).otherwise(out)
    return out


def refused(limit: Column) -> Column:
    """The error of a document that isn't read at all."""
    no_place = F.lit(None).cast(PLACE)
    message = F.concat(F.lit("max size exceeded: "), limit)
    none = F.lit(None).cast("string")
    return F.struct(F.lit("MaxSizeExceeded").alias("kind"), message.alias("message"), no_place.alias("start"), no_place.alias("end"), limit.cast("long").alias("max"), none.alias("key"), none.alias("expected"), none.alias("found")).cast(ERROR)


def _within_size(content: Column, fmt: Column, options: Options) -> tuple[Column, Column, Column]:
    """The content if it isn't far too large, whether it is, and the error that this is."""
    limit = size_limit(fmt, options)
    over = (limit > 0) & (F.octet_length(content) > 2 * limit)
    return F.when(~F.coalesce(over, F.lit(False)), content), F.coalesce(over, F.lit(False)), refused(limit)


def parse_doc(content: Column, fmt: str | Column, options: Options = Options()) -> Column:
    """STRUCT<json, error> of each document; ``fmt`` is a name or a column of names."""

    @F.arrow_udf(PARSED)
    def parse(text: pa.Array, name: pa.Array) -> pa.Array:
        return _each(text, [name], lambda t, n: json_doc.emit(kernel.parse(t, n, options)), "json")

    kept, over, error = _within_size(content, _format_column(fmt), options)
    return F.when(over, F.struct(F.lit(None).cast("string").alias("json"), error.alias("error"))).otherwise(parse(kept, _format_column(fmt)))


def convert_doc(content: Column, source: str | Column, target: str | Column, options: Options = Options()) -> Column:
    """STRUCT<content, error> of each document in another format.

    Equal literal formats without relaxed JSON return the column itself: no kernel enters the plan.
    """
    if isinstance(source, str) and isinstance(target, str):
        (name, own), (to, _) = kernel.with_name(source, options), kernel.resolve(target)
        if name == to and not (name == "json" and (own.allow_comments or own.allow_trailing_commas)):
            return F.struct(content.cast("string").alias("content"), F.lit(None).cast(ERROR).alias("error"))

    @F.arrow_udf(CONVERTED)
    def convert(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return _each(text, [a, b], lambda t, x, y: kernel.convert(t, x, y, options), "content")

    kept, over, error = _within_size(content, _format_column(source), options)
    return F.when(over, F.struct(F.lit(None).cast("string").alias("content"), error.alias("error"))).otherwise(convert(kept, _format_column(source), _format_column(target)))


def convert_through(content: Column, formats: list[str], options: Options = Options()) -> Column:
    """STRUCT<content, error> of each document after conversion from each of the formats to the next, all by one worker:
    a kernel for each step would hold its own batch in a worker of its own. The first error ends a document's way."""
    steps = list(zip(formats, formats[1:], strict=False))

    def through(text: str) -> str:
        for source, target in steps:
            text = kernel.convert(text, source, target, options)
        return text

    @F.arrow_udf(CONVERTED)
    def convert(text: pa.Array) -> pa.Array:
        return _each(text, [], through, "content")

    kept, over, error = _within_size(content, F.lit(formats[0]), options)
    return F.when(over, F.struct(F.lit(None).cast("string").alias("content"), error.alias("error"))).otherwise(convert(kept))


def validate_doc(content: Column, fmt: str | Column, options: Options = Options()) -> Column:
    """The error struct of each document, null if it is valid."""

    @F.arrow_udf(ERROR)
    def validate(text: pa.Array, name: pa.Array) -> pa.Array:
        return _each(text, [name], lambda t, n: (kernel.parse(t, n, options), None)[1], "json").field("error")

    kept, over, error = _within_size(content, _format_column(fmt), options)
    return F.when(over, error).otherwise(validate(kept, _format_column(fmt)))


def parse_json_builtin(content: Column) -> Column:
    """VARIANT of strict JSON by the engine's own reader, for documents whose errors needn't be told:
    null for invalid ones and for repeated keys."""
    return F.try_parse_json(content)


def format_number_exact(x: Column) -> Column:
    """``format_number`` of any number, by the kernel."""

    @F.arrow_udf("string")
    def formatted(numbers: pa.Array) -> pa.Array:
        return pa.array([None if v is None else kernel_format_number(v) for v in numbers.to_pylist()], pa.string())

    return formatted(x)


def with_parsed(df: DataFrame, fmt: str | Column, content: str = "content", options: Options = Options(), mode: str = "PERMISSIVE") -> DataFrame:
    """``df`` with ``value`` (VARIANT), ``json`` (ordered text) and ``error``.

    PERMISSIVE keeps all rows, DROPMALFORMED those without an error, FAILFAST stops at the first one.
    """
    names = [c for c in ("parsed", "value", "json", "error") if c in df.columns]
    df = df.drop(*names) if names else df
    out = df.withColumn("parsed", parse_doc(F.col(content), fmt, options))
    out = out.select(*df.columns, F.try_parse_json("parsed.json").alias("value"), F.col("parsed.json").alias("json"), F.col("parsed.error").alias("error"))
    if mode == "DROPMALFORMED":
        return out.where("error is null")
    if mode == "FAILFAST":
        return out.withColumn("json", F.when(F.col("error").isNull(), F.col("json")).otherwise(F.raise_error(F.col("error.message"))))
    if mode != "PERMISSIVE":
        raise ValueError(f"unknown mode {mode}")
    return out


NODES = "node_id INT, parent_id INT, path STRING, depth INT, pos INT, key STRING, kind STRING, num DOUBLE, str STRING, bool BOOLEAN"
EVENTS = "seq INT, event STRING, path ARRAY<STRING>, value STRING"
TOKENS = f"seq INT, kind STRING, value STRING, start {PLACE}, end {PLACE}"
CELLS = "row INT, pos INT, key STRING, kind STRING, num DOUBLE, str STRING, bool BOOLEAN"


Rows = Iterator[tuple]


def node_rows(content: str, fmt: str, wanted: frozenset[str] | None = None) -> Rows:
    try:
        for node in kernel.nodes(kernel.parse(content, fmt)):
            yield tuple(node.values())
    except DocError:
        return


def xml_node_rows(content: str, wanted: frozenset[str] | None = None) -> Rows:
    try:
        root = xml_doc.parse(content)
    except DocError:
        return
    for node in kernel.xml_nodes(root):
        yield tuple(node.values())


def _value_text(value) -> str | None:
    return None if value is None else json_doc.emit(value)


def event_rows(content: str, fmt: str, wanted: frozenset[str] | None = None) -> Rows:
    n, texts = 0, wanted is None or "value" in wanted
    try:
        for name, path, value in kernel.events(content, fmt):
            text = None if not texts else value if name == "Key" else json_doc.emit(value) if name in ("Value", "KeyValue") else None
            yield n, name, path, text
            n += 1
    except DocError as e:
        yield n, "Error", None, str(e.located(content))


def token_rows(content: str, fmt: str, wanted: frozenset[str] | None = None) -> Rows:
    n, texts = 0, wanted is None or "value" in wanted
    place = Places(content).of if wanted is None or not wanted.isdisjoint(("start", "end")) else lambda _: None
    try:
        for t in kernel.tokens(content, fmt):
            text = None if not texts else t.value if isinstance(t.value, str) else _value_text(t.value)
            yield n, t.kind, text, place(t.start), place(t.end)
            n += 1
    except DocError as e:
        e.located(content)
        start, end = e.span or (None, None)
        yield n, "Error", e.message, start and tuple(start), end and tuple(end)


def cell_rows(content: str, delimiter: str, wanted: frozenset[str] | None = None) -> Rows:
    try:
        rows = csv_doc.parse(content, Options(delimiter=delimiter or ","))
    except DocError:
        return
    for i, row in enumerate(rows):
        for j, (key, v) in enumerate(row.items()):
            kind = kind_of(v)
            yield i, j, key, kind, v if kind == "number" else None, v if kind == "string" else None, v if kind == "bool" else None


class DocNodes:
    """``doc_nodes(content, format)``: the node table of one document; none if it is invalid."""

    def eval(self, content: str, fmt: str) -> Rows:
        if content is not None:
            yield from node_rows(content, fmt)


class XmlNodes:
    """``xml_nodes(content)``: elements, attributes and text in document order."""

    def eval(self, content: str) -> Rows:
        if content is not None:
            yield from xml_node_rows(content)


class DocEvents:
    """``doc_events(content, format)``: pull events; an invalid document ends in an ``Error`` event."""

    def eval(self, content: str, fmt: str) -> Rows:
        if content is not None:
            yield from event_rows(content, fmt)


class DocTokens:
    """``doc_tokens(content, format)``: tokens with their places; an invalid document ends in an ``Error`` token."""

    def eval(self, content: str, fmt: str) -> Rows:
        if content is not None:
            yield from token_rows(content, fmt)


class CsvCells:
    """``csv_rows(content, delimiter)``: a row for each cell with its record, place, name and typed content."""

    def eval(self, content: str, delimiter: str) -> Rows:
        if content is not None:
            yield from cell_rows(content, delimiter)


TABLE_FUNCTIONS = {"doc_nodes": (DocNodes, NODES), "xml_nodes": (XmlNodes, NODES), "doc_events": (DocEvents, EVENTS), "doc_tokens": (DocTokens, TOKENS), "csv_rows": (CsvCells, CELLS)}


#: What ``exploded`` calls for each document, the rows' schema and their Arrow types.
_text, _int = pa.string(), pa.int32()
_NODE_TYPES = [_int, _int, _text, _int, _int, _text, _text, pa.float64(), _text, pa.bool_()]
ROWS_OF = {
    "doc_nodes": (node_rows, NODES, _NODE_TYPES),
    "xml_nodes": (xml_node_rows, NODES, _NODE_TYPES),
    "doc_events": (event_rows, EVENTS, [_int, _text, pa.list_(_text), _text]),
    "doc_tokens": (token_rows, TOKENS, [_int, _text, _text, _place, _place]),
    "csv_rows": (cell_rows, CELLS, [_int, _int, _text, _text, pa.float64(), _text, pa.bool_()]),
}


def _row_bytes(columns: list[pa.Array], n: int) -> list[int]:
    """Bytes of each of ``n`` rows; nested columns count by their mean."""
    sizes = [0] * n
    for c in columns:
        plain = pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
        own = pc.fill_null(pc.binary_length(c), 0).to_pylist() if plain else [c.nbytes // max(1, n) + 1] * n
        sizes = [a + b for a, b in zip(sizes, own, strict=True)]
    return sizes


def _exploded_batch(batch: pa.RecordBatch, n_keep: int, function: str, picked: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The function's rows beside the first ``n_keep`` columns, in batches bounded in rows and bytes."""
    rows_of, _, types = ROWS_OF[function]
    kept, given = batch.columns[:n_keep], batch.columns[n_keep:]
    fields = [*(batch.schema.field(i) for i in range(n_keep)), *(pa.field(n, types[j]) for n, j in zip(names, picked, strict=True))]
    schema, wanted, texts = pa.schema(fields), frozenset(names), [j for j in picked if types[j] == _text]
    beside = _row_bytes(kept, batch.num_rows)
    at, rows, size = [], [], 0

    def made() -> pa.RecordBatch:
        cells, places = list(zip(*rows, strict=True)), pa.array(at, _int)
        return pa.RecordBatch.from_arrays([*(c.take(places) for c in kept), *(pa.array(cells[j], types[j]) for j in picked)], schema=schema)

    for start, n in _pieces(given[0]):
        for i, (content, *more) in enumerate(zip(*(g.slice(start, n).to_pylist() for g in given), strict=True), start):
            if content is None:
                continue
            for row in rows_of(content, *more, wanted):
                at.append(i)
                rows.append(row)
                size += beside[i]
                for j in texts:
                    size += len(row[j] or "")
                if len(rows) >= MOST_ROWS or size >= PIECE_BYTES:
                    yield made()
                    at, rows, size = [], [], 0
    if rows:
        yield made()


def exploded(df: DataFrame, function: str, keep: list[str], *arguments: Column, columns: list[str] | None = None) -> DataFrame:
    """Rows of a table function for each row of ``df``, beside the ``keep`` columns, in one Arrow pass.

    A call of the function costs a batch of its own in a lateral join; here many documents share one. ``columns``
    names those of the function's columns that are read; the others aren't made.
    """
    every = T.StructType.fromDDL(ROWS_OF[function][1])
    picked = [every.names.index(c) for c in columns or every.names]
    names, n_keep = [every.names[j] for j in picked], len(keep)
    source = df.select(*keep, *(a.alias(f"_a{i}") for i, a in enumerate(arguments)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _exploded_batch(batch, n_keep, function, picked, names)

    return source.mapInArrow(work, T.StructType(source.schema.fields[:n_keep] + [every.fields[j] for j in picked]))


def nodes(df: DataFrame, fmt: str | Column, keep: list[str], content: str = "content", columns: list[str] | None = None) -> DataFrame:
    return exploded(df, "doc_nodes", keep, F.col(content), _format_column(fmt), columns=columns)


def register(spark: SparkSession) -> None:
    """SQL functions: parse_doc, convert_doc, validate_doc, infer_scalar_kind, detect_format and the table functions.

    ``parse_doc_with``, ``convert_doc_with`` and ``validate_doc_with`` take options as a last argument, an object in
    JSON text with the names of ``Options``: ``'{"max_depth": 0, "allow_comments": true}'``.
    """

    @F.arrow_udf(PARSED)
    def parse(text: pa.Array, name: pa.Array) -> pa.Array:
        return _each(text, [name], lambda t, n: json_doc.emit(kernel.parse(t, n)), "json")

    @F.arrow_udf(CONVERTED)
    def convert(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return _each(text, [a, b], lambda t, x, y: kernel.convert(t, x, y), "content")

    @F.arrow_udf(ERROR)
    def validate(text: pa.Array, name: pa.Array) -> pa.Array:
        return _each(text, [name], lambda t, n: (kernel.parse(t, n), None)[1], "json").field("error")

    @F.arrow_udf(PARSED)
    def parse_with(text: pa.Array, name: pa.Array, options: pa.Array) -> pa.Array:
        return _each(text, [name, options], lambda t, n, o: json_doc.emit(kernel.parse(t, n, options_of(o))), "json")

    @F.arrow_udf(CONVERTED)
    def convert_with(text: pa.Array, a: pa.Array, b: pa.Array, options: pa.Array) -> pa.Array:
        return _each(text, [a, b, options], lambda t, x, y, o: kernel.convert(t, x, y, options_of(o)), "content")

    @F.arrow_udf(ERROR)
    def validate_with(text: pa.Array, name: pa.Array, options: pa.Array) -> pa.Array:
        return _each(text, [name, options], lambda t, n, o: (kernel.parse(t, n, options_of(o)), None)[1], "json").field("error")

    spark.udf.register("parse_doc_with", parse_with)
    spark.udf.register("convert_doc_with", convert_with)
    spark.udf.register("validate_doc_with", validate_with)
    spark.udf.register("parse_doc", parse)
    spark.udf.register("convert_doc", convert)
    spark.udf.register("validate_doc", validate)
    for name, (cls, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema, useArrow=True))
    number = r"^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION infer_scalar_kind(x STRING) RETURNS STRING RETURN
        CASE WHEN x IS NULL OR x = '' OR lower(x) = 'null' THEN 'null' WHEN lower(x) IN ('true', 'false') THEN 'bool'
        WHEN x RLIKE '{number}' AND abs(try_cast(x AS DOUBLE)) < double('Infinity') THEN 'number' ELSE 'string' END""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION detect_format(path STRING) RETURNS STRING RETURN
        CASE lower(regexp_extract(path, '[^/\\\\]\\.([^./\\\\]*)$', 1)) WHEN 'json' THEN 'json' WHEN 'jsonc' THEN 'json' WHEN 'csv' THEN 'csv'
        WHEN 'toml' THEN 'toml' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'xml' THEN 'xml' END""")


__all__ = ["convert_doc", "nodes", "parse_doc", "register", "validate_doc", "with_parsed"]
