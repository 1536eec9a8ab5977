"""The registered queries of the document engine, each with SQL that gives the same rows.

Inputs are whole tables: JSON documents from ``events``, documents of the other formats put together
from the relational tables, and free text as hostile cells.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import service
from quillspark.functions import documents as docs
from quillspark.functions import scalars
from quillspark.kernels.core import RELAXED, Options
from quillspark.operators import rows, values
from quillspark.plans.flat import group_documents, row_document
from quillspark.streaming import documents as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by their key: a table of short rows may be one file of few row groups, read by few tasks."""
    return df.repartition(F.xxhash64(key))


def literal(rows_: list[tuple], names: list[str]) -> str:
    """SQL for a few rows of texts, numbers, booleans and nulls."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return f"CAST({v!r} AS {'DOUBLE' if isinstance(v, float) else 'INTEGER'})"
        parts = [f"'{p}'" for p in v.replace("'", "''").split("\n")]
        return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows_)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("content"))


# JSON.


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = docs.with_parsed(props(spark, sf_dir), "json")
    return parsed.select("event_id", values.as_number(values.get(F.col("value"), "k")).alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_parse_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = docs.parse_json_builtin(F.col("content"))
    return props(spark, sf_dir).select("event_id", F.try_variant_get(value, "$.k", "double").alias("k"))


@query("SELECT event_type, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def json_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = docs.with_parsed(props(spark, sf_dir), "json")
    return parsed.groupBy("event_type", values.kind(values.get(F.col("value"), "k")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS highest FROM events GROUP BY event_type")
def json_agg_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(docs.parse_json_builtin(F.col("content")), "$.k", "bigint")
    return props(spark, sf_dir).select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("highest"))


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"l\":[1,2]}' AS content FROM events")
def jsonc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    commented = F.concat(F.lit("// head\n"), F.regexp_replace("content", r"\}$", ', /* list */ "l": [1, 2,],}'), F.lit(" // tail"))
    return props(spark, sf_dir).select("event_id", docs.convert_doc(commented, "json", "json", RELAXED)["content"].alias("content"))


def _props_to(target: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return props(spark, sf_dir).select("event_id", docs.convert_doc(F.col("content"), "json", target)["content"].alias("content"))

    run.__name__ = f"json_to_{target}"
    return run


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
for _target, _sql in {"toml": f"'k = ' || {_K}", "yaml": f"'k: ' || {_K}", "xml": f"'<root><k>' || {_K} || '</k></root>'", "csv": f"'k' || chr(10) || {_K} || chr(10)", "json": "props"}.items():
    query(f"SELECT event_id, {_sql} AS content FROM events")(_props_to(_target))


# CSV.


def nation_documents(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    return group_documents(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"], fmt)


@query("SELECT n_regionkey, CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name FROM nation")
def csv_parse_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rows.csv_cells(nation_documents(spark, sf_dir, "csv"), ["n_regionkey"])
    return rows.csv_table(cells, ["n_regionkey"], {"n_nationkey": "double", "n_name": "string"}).drop("row")


CELLS = [
    ("", "null", None), ("null", "null", None), ("NULL", "null", None), ("true", "bool", None), ("FALSE", "bool", None), ("42", "number", 42.0), ("2.5", "number", 2.5), ("+5", "number", 5.0),
    (".5", "number", 0.5), ("5.", "number", 5.0), ("1e5", "number", 100000.0), ("001", "number", 1.0), ("-0.25", "number", -0.25), ("1e400", "string", None), ("inf", "string", None), ("nan", "string", None),
    ("Infinity", "string", None), ("1d", "string", None), ("0x1F", "string", None), ("1_000", "string", None), ("abc", "string", None), ("1 2", "string", None), ("--1", "string", None), ("e5", "string", None),
]


@query(literal(CELLS, ["cell", "kind", "num"]))
def csv_infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By expressions; tests hold the kernel to the same table."""
    cells = spark.createDataFrame([(c,) for c, _, _ in CELLS], "cell string")
    return cells.select("cell", scalars.infer_kind(F.col("cell")).alias("kind"), scalars.number_of(F.col("cell")).alias("num"))


def _csv_literal(name: str, documents: list[tuple[str, str]], expected: list[tuple], delimiter: str = ",") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame(documents, "doc string, content string")
        cells = rows.csv_cells(df, ["doc"], delimiter=delimiter)
        return cells.select("doc", "row", "pos", "key", "kind", F.coalesce("str", scalars.format_number(F.col("num")), F.col("bool").cast("string")).alias("text"))

    run.__name__ = name
    query(literal(expected, ["doc", "row", "pos", "key", "kind", "text"]))(run)


_csv_literal("csv_header_normalize", [("dup", "name, name,,name\n1,2,3,4\n"), ("quoted", '" a ","b"\n"x",\' y\'\n')], [
    ("dup", 0, 0, "name", "number", "1"), ("dup", 0, 1, "name_2", "number", "2"), ("dup", 0, 2, "column_3", "number", "3"), ("dup", 0, 3, "name_3", "number", "4"),
    ("quoted", 0, 0, " a ", "string", "x"), ("quoted", 0, 1, "b", "string", "' y'"),
])
_csv_literal("csv_overflow_and_short_rows", [("both", "\n , \na,b\n1\n\n1,2,3\n")], [
    ("both", 0, 0, "a", "number", "1"), ("both", 0, 1, "b", "null", None), ("both", 1, 0, "a", "number", "1"), ("both", 1, 1, "b", "number", "2"), ("both", 1, 2, "column_3", "number", "3"),
])
_csv_literal("csv_quoting", [("q", 'a,b\r\n"say ""hi""","two\nlines"\r"001" ,x"y\n')], [
    ("q", 0, 0, "a", "string", 'say "hi"'), ("q", 0, 1, "b", "string", "two\nlines"), ("q", 1, 0, "a", "string", "001"), ("q", 1, 1, "b", "string", 'x"y'),
])
for _name, _sep in {"semicolon": ";", "tab": "\t", "pipe": "|"}.items():
    _csv_literal(f"csv_delimiter_{_name}", [("d", f'name{_sep}age\nAl,x{_sep}30\n"B{_sep}"{_sep}true\n')], [("d", 0, 0, "name", "string", "Al,x"), ("d", 0, 1, "age", "number", "30"), ("d", 1, 0, "name", "string", f"B{_sep}"), ("d", 1, 1, "age", "bool", "true")], _sep)


def _nations_to(target: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nation_documents(spark, sf_dir, "csv").select("n_regionkey", docs.convert_doc(F.col("content"), "csv", target)["content"].alias("content"))

    run.__name__ = f"csv_to_{target}"
    return run


def _flat(target: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nation_documents(spark, sf_dir, target)

    run.__name__ = f"flat_rows_to_{target}"
    return run


_NATIONS = {
    "json": ("'{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'", "'['", "','", "']'"),
    "toml": ("'{n_nationkey = ' || n_nationkey || ', n_name = \"' || n_name || '\"}'", "'rows = ['", "', '", "']'"),
    "yaml": ("'- n_nationkey: ' || n_nationkey || chr(10) || '  n_name: \"' || n_name || '\"'", "''", "chr(10)", "''"),
    "xml": ("'<row><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name></row>'", "'<root>'", "''", "'</root>'"),
    "csv": ("n_nationkey || ',\"' || n_name || '\"'", "'n_nationkey,n_name' || chr(10)", "chr(10)", "chr(10)"),
}
for _target, (_row, _before, _glue, _after) in _NATIONS.items():
    _sql = f"SELECT n_regionkey, {_before} || string_agg({_row}, {_glue} ORDER BY n_nationkey) || {_after} AS content FROM nation GROUP BY n_regionkey"
    query(_sql)(_nations_to(_target))
    query(_sql)(_flat(_target))


@query("SELECT p_partkey, 'p_partkey = ' || p_partkey || chr(10) || 'p_name = \"' || p_name || '\"' || chr(10) || 'p_retailprice = ' || regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS content FROM part")
def flat_row_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", row_document(part, ["p_partkey", "p_name", "p_retailprice"], "toml").alias("content"))


@query("SELECT l_orderkey, l_linenumber, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS price, regexp_replace(CAST(l_discount AS VARCHAR), '\\.0$', '') AS discount FROM lineitem")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", scalars.format_number(F.col("l_extendedprice")).alias("price"), scalars.format_number(F.col("l_discount")).alias("discount"))


# TOML.


def _parsed(df: DataFrame, fmt: str, content: Column, *keep: str) -> DataFrame:
    return docs.with_parsed(df.select(*keep, content.alias("content")), fmt)


@query("SELECT s_suppkey, s_name AS name, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance, 'a\"b' AS note FROM supplier")
def toml_parse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('# supplier\ntitle = "x"\n[owner]\nname = \'%s\'\nnote = "a\\"b"\n[owner.account]\nnation = %d\nbalance = %s\n', "s_name", "s_nationkey", F.col("s_acctbal").cast("string"))
    parsed = _parsed(table(spark, sf_dir, "supplier"), "toml", text, "s_suppkey")
    get = lambda path, kind: F.try_variant_get("value", path, kind)
    return parsed.select("s_suppkey", get("$.owner.name", "string").alias("name"), get("$.owner.account.nation", "double").alias("nation"), get("$.owner.account.balance", "double").alias("balance"), get("$.owner.note", "string").alias("note"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) AS local, strftime(o_orderdate, '%H:%M:%S') AS time, '-07:00' AS zone, epoch_us(o_orderdate) // 1000000 + 25200 AS instant FROM orders")
def toml_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    text = F.format_string("day = %s\nlocal = %s\nspaced = %s\ntime = %s\ninstant = %s-07:00\n", F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "HH:mm:ss"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    parsed = _parsed(table(spark, sf_dir, "orders"), "toml", text, "o_orderkey")
    part = lambda k: values.datetime_parts(F.try_variant_get("value", f"$.{k}", "string"))
    same = part("local")["local"] == part("spaced")["local"]
    return parsed.select("o_orderkey", part("day")["day"].alias("day"), F.when(same, part("local")["local"]).alias("local"), part("time")["time"].alias("time"), part("instant")["zone"].alias("zone"), F.unix_seconds(part("instant")["instant"]).alias("instant"))


@query("SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_name AS name, CAST(n_nationkey AS DOUBLE) AS nation FROM nation")
def toml_array_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string('[[nation]]\nname = "%s"\nkey.id = %d\n', "n_name", "n_nationkey")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r["line"]), "")
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.alias("content"))
    parsed = docs.with_parsed(grouped, "toml").select("n_regionkey", F.posexplode(values.items(values.get(F.col("value"), "nation"))).alias("pos", "row"))
    return parsed.select("n_regionkey", "pos", F.try_variant_get("row", "$.name", "string").alias("name"), F.try_variant_get("row", "$.key.id", "double").alias("nation"))


# YAML.


@query("SELECT p_partkey, p_name AS name, CAST(p_size AS DOUBLE) AS size, p_brand AS brand, p_type AS second, CAST(2 AS INTEGER) AS n_tags FROM part")
def yaml_parse_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("# part\nname: %s\nspec:\n  size: %d # cm\n  tags:\n  - \"%s\"\n  - kind: '%s'\n    ok: true\n", "p_name", "p_size", "p_brand", "p_type")
    parsed = _parsed(table(spark, sf_dir, "part"), "yaml", text, "p_partkey")
    get = lambda path, kind: F.try_variant_get("value", path, kind)
    tags = values.get(values.get(F.col("value"), "spec"), "tags")
    return parsed.select("p_partkey", get("$.name", "string").alias("name"), get("$.spec.size", "double").alias("size"), get("$.spec.tags[0]", "string").alias("brand"), get("$.spec.tags[1].kind", "string").alias("second"), values.length(tags).alias("n_tags"))


@query("SELECT p_partkey, '{\"point\":{\"x\":' || p_size || ',\"y\":[' || p_partkey || ',null]},\"brand\":\"' || p_brand || '\"}' AS json FROM part")
def yaml_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("point: {x: %d, y: [%d, ~]}\nbrand: %s\n", "p_size", "p_partkey", "p_brand")
    return _parsed(table(spark, sf_dir, "part"), "yaml", text, "p_partkey").select("p_partkey", "json")


SCALARS = [
    ("~", "null", None), ("Null", "null", None), ("", "null", None), ("True", "bool", "true"), ("FALSE", "bool", "false"), ("12", "number", "12"), ("+1.50", "number", "1.5"), ("1e3", "number", "1000"),
    (".inf", "string", ".inf"), ("infinity", "string", "infinity"), ("nan", "string", "nan"), ("hello world", "string", "hello world"), ("http://x", "string", "http://x"), ('"12"', "string", "12"), ("'it''s'", "string", "it's"), ("yes", "string", "yes"),
]


@query(literal(SCALARS, ["scalar", "kind", "text"]))
def yaml_scalar_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(s, f"k: {s}\n") for s, _, _ in SCALARS], "scalar string, content string")
    found = docs.nodes(df, "yaml", ["scalar"]).where("depth = 1")
    return found.select("scalar", "kind", F.coalesce("str", scalars.format_number(F.col("num")), F.col("bool").cast("string")).alias("text"))


# XML.


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def xml_parse_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("<?xml version=\"1.0\"?>\n<c id=\"%d\" seg='%s'><name>%s</name><nation key=\"%d\"/></c>", "c_custkey", "c_mktsegment", "c_name", "c_nationkey")
    parsed = _parsed(table(spark, sf_dir, "customer"), "xml", text, "c_custkey")
    get = lambda path: F.try_variant_get("value", path, "string")
    return parsed.select("c_custkey", get("$.c.name['#text']").alias("name"), get("$.c['@attributes'].seg").alias("segment"), get("$.c.nation['@attributes'].key").alias("nation"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped, text FROM documents")
def xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = scalars.escape_xml(F.col("text"))
    parsed = _parsed(table(spark, sf_dir, "documents").withColumn("escaped", escaped), "xml", F.concat(F.lit("<t>"), escaped, F.lit("</t>")), "doc_id", "escaped")
    return parsed.select("doc_id", "escaped", F.coalesce(F.try_variant_get("value", "$.t['#text']", "string"), F.lit("")).alias("text"))


@query(f"SELECT n_regionkey, {_NATIONS['csv'][1]} || string_agg({_NATIONS['csv'][0]}, chr(10) ORDER BY n_nationkey) || chr(10) AS content FROM nation GROUP BY n_regionkey")
def xml_rows_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_documents(spark, sf_dir, "xml").select("n_regionkey", docs.convert_doc(F.col("content"), "xml", "csv")["content"].alias("content"))


@query("SELECT r_regionkey, '{\"root\":{\"region\":{\"@attributes\":{\"key\":\"' || r_regionkey || '\"},\"#text\":\"' || r_name || '\"}}}' AS content FROM region")
def xml_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('<root><region key="%d">%s</region></root>', "r_regionkey", "r_name")
    return table(spark, sf_dir, "region").select("r_regionkey", docs.convert_doc(text, "xml", "json")["content"].alias("content"))


@query("SELECT c_custkey, CAST(6 AS BIGINT) AS n_nodes, CAST(2 AS BIGINT) AS n_texts, c_name || '!' AS mixed FROM customer")
def xml_node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("<c id=\"%d\">%s<b x='1'/>!</c>", "c_custkey", "c_name")
    source = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", text.alias("content"))
    found = docs.exploded(source, "xml_nodes", ["c_custkey"], F.col("content"), columns=["node_id", "kind", "str"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("node_id", "str")))), lambda r: r["str"]), "")
    return found.groupBy("c_custkey").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "text").alias("n_texts"), texts.alias("mixed"))


@query("SELECT CASE WHEN html LIKE '<!DOCTYPE%' THEN 'page' ELSE 'other' END AS what, count(*) AS n FROM pages GROUP BY 1")
def xml_refuses_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages aren't well-formed: every one with a document type has an error."""
    error = docs.validate_doc(F.col("html"), "xml")["kind"]
    what = F.when(F.col("html").startswith("<!DOCTYPE") & F.col("error").isNotNull(), "page").otherwise("other")
    return table(spark, sf_dir, "pages").select("html", error.alias("error")).groupBy(what.alias("what")).agg(F.count("*").alias("n"))


# Round trips.


def _round_trip(through: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('{"t":'), scalars.quote_string(F.coalesce("text", F.lit(""))), F.lit("}")).alias("content"))
        back = docs.convert_through(F.col("content"), ["json", through, "json"])["content"]
        value = F.try_parse_json("back")
        path = {"csv": "$[0].t", "xml": "$.root.t['#text']"}.get(through, "$.t")
        out = source.withColumn("back", back)
        return out.select("doc_id", F.coalesce(F.try_variant_get(value, path, "string"), F.lit("")).alias("text"))

    run.__name__ = f"roundtrip_json_{through}"
    return run


for _target in ("csv", "toml", "yaml", "xml"):
    query("SELECT doc_id, coalesce(text, '') AS text FROM documents")(_round_trip(_target))


# Trees, events, tokens.


@query("SELECT event_type, CAST(2 * count(*) AS BIGINT) AS n_nodes, CAST(1 AS INTEGER) AS max_depth, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def nodes_depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs.nodes(spread(props(spark, sf_dir), "event_id"), "json", ["event_type"], columns=["depth", "num"])
    return found.groupBy("event_type").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.sum("num").cast("bigint").alias("total"))


@query("SELECT event, n FROM (SELECT count(*) AS n FROM events), (VALUES ('ObjectStart'), ('Key'), ('Value'), ('ObjectEnd')) t(event)")
def event_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs.exploded(spread(props(spark, sf_dir), "event_id"), "doc_events", [], F.col("content"), F.lit("json"), columns=["event"])
    return found.groupBy("event").agg(F.count("*").alias("n"))


@query("SELECT kind, n FROM (SELECT count(*) AS n FROM events), (VALUES ('LeftBrace'), ('String'), ('Colon'), ('Number'), ('RightBrace'), ('Eof')) t(kind)")
def json_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs.exploded(spread(props(spark, sf_dir), "event_id"), "doc_tokens", [], F.col("content"), F.lit("json"), columns=["kind"])
    return found.groupBy("kind").agg(F.count("*").alias("n"))


TOML_EVENTS = [(0, "KeyValue", "a", "1"), (1, "TableStart", "t.u", None), (2, "KeyValue", "b.c", "[true,\"x\"]"), (3, "ArrayTableStart", "p", None), (4, "KeyValue", "n", "2.5")]


@query(literal(TOML_EVENTS, ["seq", "event", "path", "value"]))
def toml_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([('a = 1\n[t.u]\nb.c = [true, "x"]\n[[p]]\nn = 2.5\n',)], "content string")
    return docs.exploded(df, "doc_events", [], F.col("content"), F.lit("toml")).select("seq", "event", F.array_join("path", ".").alias("path"), "value")


YAML_TOKENS = [(0, "Scalar", "a"), (1, "Colon", None), (2, "Newline", None), (3, "Indent", None), (4, "Dash", None), (5, "QuotedScalar", "x"), (6, "Newline", None), (7, "Dash", None), (8, "LeftBracket", None), (9, "Scalar", "1"), (10, "Comma", None), (11, "RightBracket", None), (12, "Newline", None), (13, "Dedent", None), (14, "Eof", None)]


@query(literal(YAML_TOKENS, ["seq", "kind", "value"]))
def yaml_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([('a:\n  - "x"\n  - [1,]\n',)], "content string")
    return docs.exploded(df, "doc_tokens", [], F.col("content"), F.lit("yaml")).select("seq", "kind", "value")


# Formats, errors, limits.

PATHS = [("a.json", "json"), ("dir.toml/b.JSONC", "json"), ("c.Csv", "csv"), ("d.toml", "toml"), ("e.yaml", "yaml"), ("f.YML", "yaml"), ("g.xml", "xml"), ("h.txt", None), ("none", None), (".json", None), ("x/.yaml", None), ("a.b.xml", "xml"), ("trailing.", None)]


@query(literal(PATHS, ["path", "format"]))
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p, _ in PATHS], "path string").select("path", scalars.detect_format(F.col("path")).alias("format"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '\\.html?$') THEN 'html' END AS other, CAST(NULL AS VARCHAR) AS format FROM pages")
def detect_format_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.when(F.col("url").rlike(r"\.html?$"), "html").alias("other"), scalars.detect_format(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)).alias("format"))


BAD = [
    ("json", '{"a": {"b": 1', "Expected"), ("json", "[1, 2, 3", "Expected"), ("json", "[1, 2, 3,]", "Expected"), ("json", '{"a": "x', "UnterminatedString"), ("json", '{"a": "\\q"}', "InvalidEscapeSequence"), ("json", "", "InvalidToken"),
    ("json", '"\\u12"', "InvalidUnicodeEscape"), ("json", "01", "InvalidNumber"), ("json", "[1 2]", "Expected"), ("json", "{} x", "InvalidToken"), ("json", "{} 1", "Expected"),
    ("toml", "a = [1, 2", "InvalidArray"), ("toml", "[a\n]", "InvalidKey"), ("toml", "p = { x = 1,\n y = 2 }", "InvalidKey"), ("toml", 'a "x"', "Expected"), ("toml", 'a = "x', "UnterminatedString"), ("toml", "a = 1\na = 2", "DuplicateKey"),
    ("toml", "a = 1\n[a]", "InvalidKey"), ("toml", "a = []\n[a.b]", "InvalidArray"), ("toml", "d = 2020-13-01", "InvalidDatetime"), ("toml", "a = 1 b = 2", "Expected"),
    ("yaml", "a:\n    b: 1\n  c: 2", "InvalidToken"), ("yaml", "a: 1\na: 2", "DuplicateKey"), ("yaml", "{a: 1, b}", "InvalidToken"), ("yaml", "[1, 2", "InvalidToken"), ("yaml", 'a: "x', "UnterminatedString"), ("yaml", "a: &x 1", "InvalidToken"),
    ("xml", "<a><b></a></b>", "InvalidToken"), ("xml", "<a><b>", "InvalidToken"), ("xml", "<a x='1' x='2'/>", "InvalidToken"), ("xml", "<a>&nope;</a>", "InvalidToken"), ("xml", "<a/><b/>", "InvalidToken"),
    ("csv", 'a\n"x', "UnterminatedString"), ("csv", 'a\n"x"y', "InvalidToken"), ("json", "[1]", None), ("toml", "a = 1", None), ("yaml", "a: 1", None), ("xml", "<a/>", None), ("csv", "a\n1", None),
]


@query(literal(BAD, ["format", "content", "kind"]))
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(f, c) for f, c, _ in BAD], "format string, content string")
    return df.select("format", "content", docs.validate_doc(F.col("content"), F.col("format"))["kind"].alias("kind"))


PLACES = [("[1,\n 2 3]", "error at 7:2:4: expected ',' or ']', found number"), ('{"é": }', "error at 7:1:8: expected value, found '}'"), ("[[[1]]]", None)]


@query(literal(PLACES, ["content", "error"]))
def error_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(c,) for c, _ in PLACES], "content string")
    return df.select("content", docs.validate_doc(F.col("content"), "json").alias("e")).select("content", scalars.error_text(F.col("e")).alias("error"))


@query("SELECT CAST(n AS INTEGER) AS n, n > 128 AS too_deep, n > 300 AS too_long FROM (SELECT unnest(range(1, 400, 7)) AS n)")
def limits_depth_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    df = spark.range(1, 400, 7).select(F.col("id").cast("int").alias("n"))
    nested = F.concat(F.repeat(F.lit("["), n), F.repeat(F.lit("]"), n))
    deep = docs.validate_doc(nested, "json")["kind"].alias("deep")
    sized = docs.validate_doc(F.concat(F.lit('"'), F.repeat(F.lit("x"), n - 2), F.lit('"')), "json", Options(max_size=300))["kind"].alias("sized")
    return df.select("n", deep, sized).select("n", F.coalesce(F.col("deep") == "MaxDepthExceeded", F.lit(False)).alias("too_deep"), F.coalesce(F.col("sized") == "MaxSizeExceeded", F.lit(False)).alias("too_long"))


# Navigation and updates.


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS VARCHAR) AS as_text, true AS has_k, CAST(1 AS INTEGER) AS n, 'object' AS kind, 'k' AS first_key FROM events")
def variant_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = docs.with_parsed(props(spark, sf_dir), "json")
    k = values.get(F.col("value"), "k")
    return parsed.select("event_id", values.as_number(k).alias("k"), values.as_string(k).alias("as_text"), values.contains_key(F.col("json"), "k").alias("has_k"), values.length(F.col("value")).alias("n"), values.kind(F.col("value")).alias("kind"), F.get(values.keys(F.col("json")), F.lit(0)).alias("first_key"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) || ',x' AS pushed, 'y,' || string_agg(n_name, ',' ORDER BY n_nationkey) AS inserted, CAST(count(*) - 1 AS INTEGER) AS n_popped, arg_max(n_name, n_nationkey) AS popped FROM nation GROUP BY n_regionkey")
def array_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: r["n_name"])
    df = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names"))
    popped = values.pop(F.col("names"))
    return df.select("n_regionkey", F.array_join(values.push(F.col("names"), F.lit("x")), ",").alias("pushed"), F.array_join(values.insert_at(F.col("names"), 0, F.lit("y")), ",").alias("inserted"), F.size(popped["items"]).alias("n_popped"), popped["popped"].alias("popped"))


@query("SELECT r_regionkey, 'name=Z,key=' || r_regionkey AS put, 'name=' || r_name || ',key=' || r_regionkey || ',new=1' AS added, 'key=' || r_regionkey AS dropped FROM region")
def object_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.create_map(F.lit("name"), F.col("r_name"), F.lit("key"), F.col("r_regionkey").cast("string"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "region").select("r_regionkey", shown(values.put(members, F.lit("name"), F.lit("Z"))).alias("put"), shown(values.put(members, F.lit("new"), F.lit("1"))).alias("added"), shown(values.drop(members, F.lit("name"))).alias("dropped"))


@query("SELECT 'STRUCT<k: BIGINT>' AS schema")
def schema_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = docs.parse_json_builtin(F.col("content"))
    return props(spark, sf_dir).agg(F.replace(F.schema_of_variant_agg(value), F.lit("OBJECT<"), F.lit("STRUCT<")).alias("schema"))


@query("SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_name, n_nationkey FROM nation")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.records(nation_documents(spark, sf_dir, "json"), "json", ["n_regionkey"])
    return rows.typed(found, "STRUCT<n_nationkey: INT, n_name: STRING>").select("n_regionkey", "pos", "row.n_name", "row.n_nationkey")


# The cells of the conversion matrix that no query above covers, over all customers.


def customers(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """A document for each customer: a name, a number, an inner object."""
    texts = {
        "toml": F.format_string('name = "%s"\nkey = %d\nregion.id = %d\n', "c_name", "c_custkey", "c_nationkey"),
        "yaml": F.format_string("name: %s\nkey: %d\nregion:\n  id: %d\n", "c_name", "c_custkey", "c_nationkey"),
        "xml": F.format_string('<customer id="%d"><name>%s</name><region>%d</region></customer>', "c_custkey", "c_name", "c_nationkey"),
    }
    return table(spark, sf_dir, "customer").select("c_custkey", texts[fmt].alias("content"))


_LINE = "' || chr(10) || '"
_CELL_CSV = f"'name,key,region{_LINE}\"' || c_name || '\",' || c_custkey || ',\"{{\"\"id\"\":' || c_nationkey || '}}\"' || chr(10)"
_CELL_XML = "'<root><name>' || c_name || '</name><key>' || c_custkey || '</key><region><id>' || c_nationkey || '</id></region></root>'"
MATRIX = {
    ("toml", "csv"): _CELL_CSV, ("yaml", "csv"): _CELL_CSV, ("toml", "xml"): _CELL_XML, ("yaml", "xml"): _CELL_XML,
    ("toml", "toml"): f"'name = \"' || c_name || '\"{_LINE}key = ' || c_custkey || '{_LINE}region.id = ' || c_nationkey || chr(10)",
    ("toml", "yaml"): f"'name: \"' || c_name || '\"{_LINE}key: ' || c_custkey || '{_LINE}region:{_LINE}  id: ' || c_nationkey",
    ("yaml", "yaml"): f"'name: ' || c_name || '{_LINE}key: ' || c_custkey || '{_LINE}region:{_LINE}  id: ' || c_nationkey || chr(10)",
    ("xml", "xml"): "'<customer id=\"' || c_custkey || '\"><name>' || c_name || '</name><region>' || c_nationkey || '</region></customer>'",
    ("xml", "toml"): "'customer = {\"@attributes\" = {id = \"' || c_custkey || '\"}, name = {\"#text\" = \"' || c_name || '\"}, region = {\"#text\" = \"' || c_nationkey || '\"}}'",
    ("xml", "yaml"): f"'customer:{_LINE}  \"@attributes\":{_LINE}    id: \"' || c_custkey || '\"{_LINE}  name:{_LINE}    \"#text\": \"' || c_name || '\"{_LINE}  region:{_LINE}    \"#text\": \"' || c_nationkey || '\"'",
}


def _cell(source: str, target: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return customers(spark, sf_dir, source).select("c_custkey", docs.convert_doc(F.col("content"), source, target)["content"].alias("content"))

    run.__name__ = f"cell_{source}_to_{target}"
    return run


for (_source, _target), _sql in MATRIX.items():
    query(f"SELECT c_custkey, {_sql} AS content FROM customer")(_cell(_source, _target))


def _counted(spark: SparkSession, sf_dir: str, function: str, fmt: str, column: str) -> DataFrame:
    found = docs.exploded(spread(customers(spark, sf_dir, fmt), "c_custkey"), function, ["c_custkey"], F.col("content"), F.lit(fmt), columns=[column])
    return found.groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("documents"))


def _per_customer(counts: dict[str, int]) -> str:
    rows_ = " UNION ALL ".join(f"SELECT '{k}' AS kind, {n} * count(*) AS n, count(*) AS documents FROM customer" for k, n in counts.items())
    return f"SELECT kind, CAST(n AS BIGINT) AS n, CAST(documents AS BIGINT) AS documents FROM ({rows_})"


@query(_per_customer({"BareKey": 4, "Equals": 3, "String": 1, "Integer": 2, "Dot": 1, "Newline": 3, "Eof": 1}))
def toml_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "doc_tokens", "toml", "kind")


@query(_per_customer({"KeyValue": 3}))
def toml_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "doc_events", "toml", "event")


@query(_per_customer({"MappingStart": 2, "MappingEnd": 2, "Key": 4, "Value": 3}))
def yaml_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "doc_events", "yaml", "event")


DEPTHS = [(fmt, depth, depth > 128 and fmt != "xml") for fmt in ("json", "toml", "yaml", "xml") for depth in (127, 128, 129, 3000)]


@query(literal([(f, d, "MaxDepthExceeded" if deep else None, None) for f, d, deep in DEPTHS], ["format", "depth", "limited", "unlimited"]))
def limits_of_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nesting around the default limit, and without one."""
    nested = lambda left, right: F.concat(F.repeat(F.lit(left), F.col("inner")), F.repeat(F.lit(right), F.col("inner")))
    df = spark.createDataFrame([(f, d, d - (f == "yaml")) for f, d, _ in DEPTHS], "format string, depth int, inner int")
    text = F.when(F.col("format") == "json", nested("[", "]")).when(F.col("format") == "toml", F.concat(F.lit("a = "), nested("[", "]"))).when(F.col("format") == "yaml", F.concat(F.lit("a: "), nested("[", "]"))).otherwise(nested("<a>", "</a>"))
    kind_ = lambda o: docs.validate_doc(text, F.col("format"), o)["kind"]
    return df.select("format", "depth", kind_(Options()).alias("limited"), kind_(Options(max_depth=0)).alias("unlimited"))


SIZES = [(fmt, size, fmt != "yaml" and size > 100) for fmt in ("json", "toml", "yaml", "xml", "csv") for size in (60, 150, 100_000)]


@query(literal([(f, n, "MaxSizeExceeded" if over else None) for f, n, over in SIZES], ["format", "size", "kind"]))
def limits_of_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 100 bytes; documents of over twice that don't reach the kernel. YAML has no limit of size."""
    df = spark.createDataFrame([(f, n) for f, n, _ in SIZES], "format string, size int")
    x = F.repeat(F.lit("x"), F.col("size"))
    text = F.when(F.col("format") == "json", F.concat(F.lit('"'), x, F.lit('"'))).when(F.col("format") == "toml", F.concat(F.lit('a = "'), x, F.lit('"'))).when(F.col("format") == "yaml", F.concat(F.lit("a: "), x)).when(F.col("format") == "xml", F.concat(F.lit("<a>"), x, F.lit("</a>"))).otherwise(F.concat(F.lit("a\n"), x))
    return df.select("format", "size", docs.validate_doc(text, F.col("format"), Options(max_size=100))["kind"].alias("kind"))


@query("SELECT n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",true,null]' AS made_array, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS made_object, CAST(true AS BOOLEAN) AS as_bool, CAST(NULL AS BOOLEAN) AS not_bool, CAST(4 AS INTEGER) AS array_size, CAST(2 AS INTEGER) AS object_size, n_nationkey || ',true' AS removed, CAST(0 AS INTEGER) AS cleared FROM nation")
def value_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name = F.col("n_nationkey").cast("int"), F.col("n_name")
    array, made = values.array_of(n, name, F.lit(True), F.lit(None).cast("string")), values.object_of(key=n, name=name)
    text = F.array(n.cast("string"), name, F.lit("true"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.to_json(array).alias("made_array"), F.to_json(made).alias("made_object"), values.as_bool(array[2]).alias("as_bool"), values.as_bool(array[0]).alias("not_bool"),
        F.size(array).alias("array_size"), values.length(made).alias("object_size"), F.array_join(values.remove_at(text, 1), ",").alias("removed"), F.size(values.clear(text)).alias("cleared"),
    )


@query("SELECT fmt AS format, n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS json FROM nation, (VALUES ('toml'), ('yaml'), ('json')) AS f(fmt)")
def files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation in three formats, written to the shared storage and read again."""
    from quillspark.sources.documents import read_parsed, write_documents
    from quillspark.sources.scratch import scratch_folder

    texts = {"toml": 'key = %d\nname = "%s"\n', "yaml": "key: %d\nname: %s\n", "json": '{"key": %d, "name": "%s"}'}
    found = []
    for fmt, text in texts.items():
        folder = scratch_folder(spark, fmt)
        write_documents(table(spark, sf_dir, "nation").select("n_nationkey", F.format_string(text, "n_nationkey", "n_name").alias("content")), folder, by="n_nationkey")
        found.append(read_parsed(spark, folder, fmt))
    rows_ = found[0].unionByName(found[1]).unionByName(found[2])
    return rows_.select("format", F.try_variant_get("value", "$.key", "int").alias("n_nationkey"), "json")


@query("SELECT fmt AS format, n_nationkey, '{\"key\":' || n_nationkey || '}' AS json FROM nation, (VALUES ('toml'), ('yaml'), ('jsonc')) AS f(fmt)")
def data_sources_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the data sources for each format, by a path of the session's storage."""
    from quillspark.sources.datasource import register
    from quillspark.sources.documents import write_documents
    from quillspark.sources.scratch import scratch_folder

    register(spark)
    out = None
    for fmt, text in {"toml": "key = %d\n", "yaml": "key: %d\n", "jsonc": '{"key": %d, /* more */}'}.items():
        folder = scratch_folder(spark, fmt)
        write_documents(table(spark, sf_dir, "nation").select("n_nationkey", F.format_string(text, "n_nationkey").alias("content")), folder, by="n_nationkey")
        read = spark.read.format(fmt).option("extension", "txt").load(folder).select(F.lit(fmt).alias("format"), F.get_json_object("json", "$.key").cast("int").alias("n_nationkey"), "json")
        out = read if out is None else out.unionByName(read)
    return out


# Front ends and streams.

REQUESTS = [
    ("a: 1", "yaml", None, "ok", '{"a":1}', None), ("a;b\n1;2", "csv", ";", "ok", '[{"a":1,"b":2}]', None), ("[1,/*c*/2,]", "jsonc", None, "ok", "[1,2]", None),
    ("{", "json", None, "err", None, "error at 1:1:2: expected string or '}', found EOF"), ("x", "ini", None, "err", None, "Unknown format: ini"),
]


@query(literal(REQUESTS, ["content", "format", "csv_delimiter", "status", "data", "error"]))
def service_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([r[:3] for r in REQUESTS], "content string, format string, csv_delimiter string")
    return service.respond_parse(df).select("content", "format", "csv_delimiter", "response.*")


CONVERSIONS = [("a: 1", "yaml", "toml", "ok", "a = 1"), ("{oops", "json", "json", "ok", "{oops"), ("[1]", "json", "toml", "error", "TOML needs an object at its root"), ("a,b\n1,x", "csv", "xml", "ok", "<root><row><a>1</a><b>x</b></row></root>")]


@query(literal(CONVERSIONS, ["content", "source", "target", "status", "answer"]))
def service_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([r[:3] for r in CONVERSIONS], "content string, `from` string, `to` string")
    return service.respond_convert(df).select("content", F.col("from").alias("source"), F.col("to").alias("target"), F.col("response.status").alias("status"), F.col("response.content").alias("answer"))


@query(literal([(i, f) for i, f in enumerate(service.FORMATS)], ["pos", "format"]))
def service_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.formats(spark)


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, parsed once each and written; then summed."""
    from quillspark.sources.scratch import scratch_folder

    out = scratch_folder(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "event_type", F.col("props").alias("content"))
    parsed = streams.parse_stream(stream)
    streams.write_once(parsed.select("event_type", F.try_variant_get("value", "$.k", "bigint").alias("k")), f"{out}/rows", f"{out}/state")
    return spark.read.schema("event_type string, k bigint").parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def sql_text() -> str:
    """All oracle SQL, for reading."""
    return json.dumps(ORACLES, indent=1)
