"""Spark functions, sources, streams and front ends."""

from __future__ import annotations

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillspark import cli, service
from quillspark.functions import documents as docs
from quillspark.functions import scalars
from quillspark.kernels.core import Options
from quillspark.operators import rows, values
from quillspark.sources import datasource
from quillspark.sources import documents as sources
from quillspark.streaming import documents as streams


@pytest.fixture
def mixed(spark):
    data = [(1, '{"b":1,"a":[1,2]}', "json"), (2, "a: 1", "yml"), (3, "{", "json"), (4, None, "json"), (5, "x = 1979-05-27", "toml"), (6, "<r/>", "xml"), (7, "a\n1", "CSV")]
    return spark.createDataFrame(data, "id int, content string, format string")


def test_parse_keeps_order_and_errors(mixed):
    found = {r.id: r for r in docs.with_parsed(mixed, F.col("format")).collect()}
    assert found[1].json == '{"b":1,"a":[1,2]}' and found[2].json == '{"a":1}' and found[7].json == '[{"a":1}]'
    assert found[3].error.kind == "Expected" and found[3].error.start.offset == 1 and found[3].json is None
    assert found[4].json is None and found[4].error is None


def test_modes(mixed):
    assert docs.with_parsed(mixed, F.col("format"), mode="DROPMALFORMED").count() == 6
    with pytest.raises(Exception, match="expected"):
        docs.with_parsed(mixed, F.col("format"), mode="FAILFAST").select("json").collect()
    with pytest.raises(ValueError, match="mode"):
        docs.with_parsed(mixed, "json", mode="X")


def test_identity_needs_no_kernel(mixed):
    plan = mixed.select(docs.convert_doc(F.col("content"), "json", "json")["content"])._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan


def test_registered_sql(spark):
    docs.register(spark)
    row = spark.sql("SELECT parse_doc('[1]', 'json').json AS j, convert_doc('a: 1', 'yaml', 'toml').content AS t, validate_doc('[', 'json').kind AS e, infer_scalar_kind('1e5') AS k, detect_format('/x/B.YML') AS f, detect_format('.json') AS n").first()
    assert tuple(row) == ("[1]", "a = 1", "Expected", "number", "yaml", None)
    assert spark.sql("SELECT event FROM VALUES ('[1') t(x), LATERAL doc_events(t.x, 'json') e").collect()[-1].event == "Error"
    assert spark.sql("SELECT n.path FROM VALUES ('{\"a\":[true]}') t(x), LATERAL doc_nodes(t.x, 'json') n").count() == 3


def test_scalar_expressions_match_the_kernel(spark):
    from quillspark.kernels.core import format_number, infer_scalar, quoted

    numbers = [0.0, -0.0, 1.0, 30.0, 0.001, 0.1, 123456.789, 1e14, 1e15, 1e21, 1e-7, -2.5, 1e300]
    found = spark.createDataFrame([(x,) for x in numbers], "x double").select(scalars.format_number(F.col("x")).alias("s")).collect()
    assert [r.s for r in found] == [format_number(x) for x in numbers]
    texts = ['a"b', "\\", "\n\r\t", "\x01\x1f", "é", "", "plain"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.quote_string(F.col("t"))).collect()] == [quoted(t) for t in texts]
    cells = ["", "null", "TRUE", "+5", "1e400", "inf", "x"]
    found = spark.createDataFrame([(c,) for c in cells], "c string").select(scalars.infer_scalar(F.col("c")).alias("v")).select("v.*").collect()
    for cell, r in zip(cells, found, strict=True):
        v = infer_scalar(cell)
        assert {"null": v is None, "bool": v == r.bool, "number": v == r.num, "string": v == r.str}[r.kind]
    assert spark.createDataFrame([("\u00a0 x\x1f\n",)], "t string").select(scalars.trimmed(F.col("t"))).first()[0] == "x\x1f"


def test_values(spark):
    df = spark.createDataFrame([('{"n":null,"b":true,"x":1.5,"s":"1","a":[1,"z"],"o":{"k":1},"d":"2020-01-02","we ird":2}',)], "j string").withColumn("v", F.parse_json("j"))
    v = F.col("v")
    kinds = df.select(*(values.kind(values.get(v, k)).alias(k) for k in ["n", "b", "x", "s", "a", "o", "missing"])).first()
    assert tuple(kinds) == ("null", "bool", "number", "string", "array", "object", None)
    r = df.select(values.as_number(values.get(v, "s")).alias("no"), values.as_bool(values.get(v, "b")).alias("b"), values.length(values.get(v, "a")).alias("n"), values.as_string(values.at(values.get(v, "a"), 1)).alias("z"), values.as_datetime(values.get(v, "d")).alias("d"), values.is_null(values.get(v, "n")).alias("null"), values.as_number(values.get(v, "we ird")).alias("w"), values.contains_key(F.col("j"), "x").alias("has"), F.size(values.items(values.get(v, "s"))).alias("none")).first()
    assert tuple(r) == (None, True, 2, "z", "2020-01-02", True, 2.0, True, 0)
    built = df.select(F.to_json(values.object_of(a=F.lit(1), b=F.lit("x"))).alias("o"), F.to_json(values.array_of(F.lit(1), F.lit("x")).cast("variant")).alias("a")).first()
    assert json.loads(built.o) == {"a": 1, "b": "x"} and json.loads(built.a) == [1, "x"]
    arrays = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"))
    r = arrays.select(values.push(F.col("a"), F.lit(3)), values.insert_at(F.col("a"), 1, F.lit(9)), values.remove_at(F.col("a"), 0), values.pop(F.col("a"))["popped"]).first()
    assert tuple(r) == ([1, 2, 3], [1, 9, 2], [2], 2)


def test_schema_and_rows(spark):
    df = spark.createDataFrame([('[{"a":1,"b":"x"},{"a":2.5}]',)], "content string")
    found = rows.records(df, "json", [])
    assert rows.infer_schema(found.where("pos = 1")).startswith("STRUCT<a: DECIMAL")
    assert [tuple(r.row) for r in rows.typed(found, "STRUCT<a: DOUBLE, b: STRING>").orderBy("pos").collect()] == [(1.0, "x"), (2.5, None)]


@pytest.fixture
def files(tmp_path):
    contents = {"a.json": b'{"x": 1}', "b.jsonc": b"[1,] // c", "c.toml": b"x = 1", "d.yml": b"x: [1", "e.csv": b"a;b\n1;2", "f.xml": b"<r>t</r>", "g.json": b"\xff\xfe", "h.txt": b"no"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_files(spark, files):
    found = {r.path.rpartition("/")[2]: r for r in sources.read_documents(spark, files).collect()}
    assert {n: r.format for n, r in found.items()} == {"a.json": "json", "b.jsonc": "jsonc", "c.toml": "toml", "d.yml": "yaml", "e.csv": "csv", "f.xml": "xml", "g.json": "json", "h.txt": None}
    assert found["g.json"].invalid_utf8 and found["g.json"].content is None
    parsed = {r.path.rpartition("/")[2]: r for r in sources.read_parsed(spark, files).collect()}
    assert parsed["b.jsonc"].json == "[1]" and parsed["d.yml"].error.kind == "InvalidToken" and parsed["f.xml"].json == '{"r":{"#text":"t"}}'


def test_data_sources(spark, files):
    datasource.register(spark)
    assert [r.json for r in spark.read.format("toml").load(files).collect()] == ['{"x":1}']
    found = {r.path.rpartition("/")[2]: r for r in spark.read.format("jsonc").load(files).collect()}
    assert found["b.jsonc"].json == "[1]" and found["g.json"].error_kind == "InvalidToken"
    assert spark.read.format("csvdoc").option("delimiter", ";").load(files).first().json == '[{"a":1,"b":2}]'
    assert spark.read.format("yaml").load(files).first().error_kind == "InvalidToken"
    assert spark.read.format("xmldoc").load(f"{files}/*.xml").first().json == '{"r":{"#text":"t"}}'


def test_streams(spark, files, tmp_path):
    stream = sources.stream_documents(spark, f"{files}/*.toml")
    streams.write_once(streams.convert_stream(stream, "toml", "json").select("converted"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert [r.converted for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ['{"x":1}']
    parsed = streams.parse_stream(stream.withColumn("at", F.current_timestamp()), "toml")
    assert streams.error_counts(parsed, "at").isStreaming


def test_builtin_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x ""y"""\n')
    (tmp_path / "t.xml").write_text("<root><row><a>1</a></row><row><a>2</a></row></root>")
    assert sources.read_csv_table(spark, f"{tmp_path}/t.csv").first().b == 'x "y"'
    assert sources.read_xml_rows(spark, f"{tmp_path}/t.xml", schema="a INT").count() == 2
    sources.write_documents(spark.createDataFrame([("{}",)], "content string"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first().value == "{}"


def test_sizes_are_refused(spark):
    df = spark.createDataFrame([("x" * 50,)], "content string")
    assert df.select(docs.validate_doc(F.col("content"), "csv", Options(max_size=10))["max"]).first()[0] == 10


def test_service(spark):
    assert service.health(spark).first().status == "ok" and service.formats(spark).count() == 6
    requests = spark.createDataFrame([("a,b\n1,2", "csv", "json", "é"), ("a|b\n1|2", "csv", "json", "|"), ("a", "csv", "json", '"')], "content string, `from` string, `to` string, csv_delimiter string")
    found = [r.response for r in service.respond_convert(requests).collect()]
    assert found[0].content == found[1].content == '[{"a":1,"b":2}]' and found[2].status == "error"


def run_cli(*args, stdin=""):
    from conftest import ROOT

    done = subprocess.run([sys.executable, "-m", "quillspark", *args], input=stdin, capture_output=True, text=True, cwd=ROOT, check=False)
    return done.returncode, done.stdout, done.stderr


def test_command_line(tmp_path):
    path = tmp_path / "a.jsonc"
    path.write_text("[1,2,] // c")
    assert run_cli("parse", str(path)) == (0, "ok\n", "")
    assert run_cli("convert", str(path), "--to", "yaml", "--print-output")[1] == "- 1\n- 2"
    out = tmp_path / "out.toml"
    assert run_cli("--convert", "-", "--from", "yaml", "--to", "toml", "-o", str(out), stdin="a: 1")[:2] == (0, "ok\n") and out.read_text() == "a = 1"
    assert run_cli("parse", "--from", "json", stdin="[1,]")[0] == 1 and run_cli("parse", "--from", "json", "--json-trailing-commas", stdin="[1,]")[0] == 0
    assert "empty" in run_cli("parse", "--from", "json", stdin=" ")[2] and "--from" in run_cli("parse", stdin="1")[2]
    assert run_cli("parse", "--from", "csv", "--csv-delimiter", "é", stdin="a")[0] == 1
    assert cli.resolve_format(None, "x/Y.YML") == "yaml"


def test_sql_functions_take_options(spark):
    docs.register(spark)
    deep = "[" * 200 + "]" * 200
    row = spark.sql(f"""SELECT validate_doc('{deep}', 'json').kind AS limited, validate_doc_with('{deep}', 'json', '{{"max_depth": 0}}').kind AS free,
        parse_doc_with('[1, /* c */ 2,]', 'json', '{{"allow_comments": true, "allow_trailing_commas": true}}').json AS relaxed,
        convert_doc_with('a;b\n1;2', 'csv', 'json', '{{"delimiter": ";"}}').content AS cells, parse_doc_with('[1]', 'json', NULL).json AS plain""").first()
    assert tuple(row) == ("MaxDepthExceeded", None, "[1,2]", '[{"a":1,"b":2}]', "[1]")


def test_large_documents_are_refused_unread(spark, tmp_path):
    from quillspark.kernels.core import Options

    for name, n in (("small", 20), ("near", 150), ("large", 5000)):
        (tmp_path / f"{name}.json").write_text('"' + "x" * n + '"')
    found = {r.path.rpartition("/")[2]: r for r in sources.read_parsed(spark, str(tmp_path), options=Options(max_size=100)).collect()}
    assert found["small.json"].error is None and found["near.json"].error.start.offset == 0
    assert found["large.json"].content is None and found["large.json"].error.kind == "MaxSizeExceeded" and found["large.json"].error.start is None
    assert len(found) == 3


def test_data_sources_list_patterns_and_folders(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "sub").mkdir()
    for name, text in (("a.toml", "k = 1"), ("sub/b.toml", "k = 2"), ("c.txt", "k = 3"), ("bad.toml", "k = ")):
        (tmp_path / name).write_text(text)
    read = lambda path, **o: sorted(r.path.rpartition("/")[2] for r in spark.read.format("toml").options(**o).load(str(path)).collect())
    assert read(tmp_path) == ["a.toml", "b.toml", "bad.toml"] and read(tmp_path, mode="DROPMALFORMED") == ["a.toml", "b.toml"]
    assert read(f"{tmp_path}/*.toml") == ["a.toml", "bad.toml"] and read(f"file://{tmp_path}/c.txt") == ["c.txt"]
    jsonc = tmp_path / "x.jsonc"
    jsonc.write_text("[1,]")
    assert [r.json for r in spark.read.format("jsonc").load(str(jsonc)).collect()] == ["[1]"]


ODD = ['{"a":[1,{"é":"ü\\n"}],"b":null}', "[1", "", None, "é", '"x"', '[[],"\\u00e9",2.5,true]\n', '{"k": 76}']


@pytest.mark.parametrize("function", ["doc_nodes", "doc_events", "doc_tokens"])
@pytest.mark.parametrize("fmt", ["json", "toml", "yaml"])
def test_table_functions_share_batches(spark, function, fmt, monkeypatch):
    """Many documents share a batch, large ones are cut into several, and the rows are those of the functions in SQL."""
    docs.register(spark)
    texts = [*ODD, 'a = 1\n[b]\n"é" = "ü" # c\nd = [1, 2]\n', "a: é\nb:\n  - 'x'\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    found = docs.exploded(df, function, ["id"], F.col("content"), F.lit(fmt))
    plan = found._jdf.queryExecution().toString()
    assert "EvalPythonUDTF" not in plan and "MapInArrow" in plan
    df.createOrReplaceTempView("odd_documents")
    want = spark.sql(f"SELECT t.id, n.* FROM odd_documents AS t, LATERAL {function}(t.content, '{fmt}') AS n")
    assert found.schema == want.schema and sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    first = {"doc_nodes": ["kind", "depth"], "doc_events": ["event", "seq"], "doc_tokens": ["end", "kind"]}[function]
    some = docs.exploded(df, function, ["id"], F.col("content"), F.lit(fmt), columns=first)
    assert some.columns == ["id", *first] and sorted(map(repr, some.collect())) == sorted(map(repr, want.select("id", *first).collect()))


def test_exploded_batches_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(docs, "MOST_ROWS", 5)
    batch = pa.RecordBatch.from_pydict({"k": ["x" * 9, "y", None], "_a0": ["[1,2,3,4,5,6,7]", None, "[8]"], "_a1": ["json"] * 3})
    made = list(docs._exploded_batch(batch, 1, "doc_nodes", [0, 7], ["node_id", "num"]))
    assert [b.num_rows for b in made] == [5, 5]
    assert pa.Table.from_batches(made).column("num").to_pylist() == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, None, 8.0]
    monkeypatch.setattr(docs, "PIECE_BYTES", 20)
    made = list(docs._exploded_batch(batch, 1, "doc_nodes", [0, 6], ["node_id", "kind"]))
    assert sum(b.num_rows for b in made) == 10 and max(b.num_rows for b in made) <= 3


@pytest.mark.parametrize("name", ["toml_token_counts", "toml_event_counts", "yaml_event_counts", "xml_node_table", "json_token_counts", "nodes_depth_stats", "event_stream_counts"])
def test_documents_of_short_rows_are_dealt_out(spark, sf_dir, name):
    """A file of one row group doesn't put all documents into one task, and a document isn't a batch."""
    from quillspark.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "EvalPythonUDTF" not in plan
    assert "RepartitionByExpression [xxhash64" in plan


def test_conversions_in_a_row_share_a_worker(spark):
    """One kernel for all steps, with the results of a kernel each; a step's error ends the way."""
    df = spark.createDataFrame([('{"t":"é<&\\n"}',), ("[1]",), ("{",), (None,), ('{"a b":1}',)], "content string")
    for through in ("csv", "toml", "yaml", "xml", "json"):
        found = df.select("content", docs.convert_through(F.col("content"), ["json", through, "json"])["content"].alias("back"))
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        there = docs.convert_doc(F.col("content"), "json", through)["content"]
        want = df.withColumn("there", there).select("content", docs.convert_doc(F.col("there"), through, "json")["content"].alias("back"))
        if through != "json":
            assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    errors = df.select(docs.convert_through(F.col("content"), ["json", "toml", "json"])["error"]["kind"]).collect()
    assert [r[0] for r in errors] == [None, "InvalidToken", "Expected", None, None]


def test_documents_become_values_piece_by_piece(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(docs, "PIECE_BYTES", 8)
    texts, held = ["[1]", None, "[22222222222]", "[", "[4]", "[5]"], []
    real = docs._result
    monkeypatch.setattr(docs, "_result", lambda field, values, errors: held.append(len(values)) or real(field, values, errors))
    found = docs._each(pa.array(texts), [pa.array(["json"] * 6)], lambda t, n: docs.kernel.convert(t, n, "yaml"), "content").to_pylist()
    assert [r["content"] for r in found] == ["- 1", None, "- 22222222222", None, "- 4", "- 5"] and found[3]["error"]["kind"] == "Expected"
    assert len(held) > 1 and sum(held) == 6 and max(held) < 6
    assert docs._each(pa.nulls(2), [], str, "content").to_pylist() == [{"content": None, "error": None}] * 2
