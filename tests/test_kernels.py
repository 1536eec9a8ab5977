"""Kernels: accepted and refused documents, typing, limits, places, round trips."""

from __future__ import annotations

import json
import math
import tomllib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.kernels import convert as kernel
from quillspark.kernels import csv_doc, json_doc, toml_doc, xml_doc, yaml_doc
from quillspark.kernels.core import RELAXED, UNLIMITED, Datetime, DocError, Options, format_number, infer_scalar
from quillspark.queries import BAD, CELLS

VALID = [
    ("json", '{"name": "test", "value": 42}', {"name": "test", "value": 42.0}),
    ("json", '[1, 2.5, -3e2, "x", true, false, null, {"a": "b"}]', [1.0, 2.5, -300.0, "x", True, False, None, {"a": "b"}]),
    ("json", '{"a": 1, "b": 2, "a": 3}', {"a": 3.0, "b": 2.0}),
    ("json", '"\\u00e9\\ud83d\\ude00 \\n"', "é\U0001f600 \n"),
    ("json", " null ", None),
    ("toml", 'title = "x"\ncount = 3\nenabled = true\n', {"title": "x", "count": 3.0, "enabled": True}),
    ("toml", "[owner]\ndob = 1979-05-27T07:32:00-08:00\n[db]\nports = [8000, 8001]\n", {"owner": {"dob": Datetime("offset", "1979-05-27T07:32:00-08:00")}, "db": {"ports": [8000.0, 8001.0]}}),
    ("toml", '[[p]]\nname = "a"\n\n[[p]]\nname = "b"\n[[p.q]]\nz = 1\n', {"p": [{"name": "a"}, {"name": "b", "q": [{"z": 1.0}]}]}),
    ("toml", "point = { x = 1, y = 2.0 }\nt = [\n 'a', # one\n 'b',\n]\n", {"point": {"x": 1.0, "y": 2.0}, "t": ["a", "b"]}),
    ("toml", 's = """\none\n  two \\\n   three"""\nl = \'\'\'\na\\b\'\'\'\n', {"s": "one\n  two three", "l": "a\\b"}),
    ("toml", "h = 0xFF\no = 0o17\nb = 0b101\nu = 1_000\ni = -inf\n1a = 1\n\"k k\".x = 1", {"h": 255.0, "o": 15.0, "b": 5.0, "u": 1000.0, "i": -math.inf, "1a": 1.0, "k k": {"x": 1.0}}),
    ("toml", "[[a]]\n[a.b]\nc = 1\n[t]\nx = 1\n[u]\n[t]\ny = 2\n", {"a": [{"b": {"c": 1.0}}], "t": {"x": 1.0, "y": 2.0}, "u": {}}),
    ("toml", "d = 1979-05-27\nt = 07:32:00.50\nl = 1979-05-27 07:32:00\n", {"d": Datetime("date", "1979-05-27"), "t": Datetime("time", "07:32:00.5"), "l": Datetime("local", "1979-05-27T07:32:00")}),
    ("yaml", "name: test\nage: 42\nactive: true\n", {"name": "test", "age": 42.0, "active": True}),
    ("yaml", "- a\n- b\n- c\n", ["a", "b", "c"]),
    ("yaml", "person:\n  name: x\n  skills:\n    - a\n    - b\n", {"person": {"name": "x", "skills": ["a", "b"]}}),
    ("yaml", "point: {x: 1, y: 2}\nnums: [1, 2, 3]\n", {"point": {"x": 1.0, "y": 2.0}, "nums": [1.0, 2.0, 3.0]}),
    ("yaml", "---\nservices:\n- id: api\n  port: 8080\n- id: db\n  port: 5432\n", {"services": [{"id": "api", "port": 8080.0}, {"id": "db", "port": 5432.0}]}),
    ("yaml", "{a: 1, b: [x, 'y']}", {"a": 1.0, "b": ["x", "y"]}),
    ("yaml", "n: -5\nk:\nq: \"#no\" # c\nu: http://x#y\n", {"n": -5.0, "k": None, "q": "#no", "u": "http://x#y"}),
    ("yaml", "", None),
    ("xml", "<root><child>text</child></root>", {"root": {"child": {"#text": "text"}}}),
    ("xml", "<root id=\"1\" name='n'><item value=\"v\"/></root>", {"root": {"@attributes": {"id": "1", "name": "n"}, "item": {"@attributes": {"value": "v"}}}}),
    ("xml", "<?xml version=\"1.0\"?>\n<!DOCTYPE r [<!ENTITY x 'y'>]>\n<!-- c -->\n<r>&lt;&#65;&#x42;<![CDATA[<&]]></r>\n<!-- end -->", {"r": {"#text": "<AB<&"}}),
    ("xml", "<r> <a> x </a> <a/> </r>", {"r": {"a": [{"#text": " x "}, {}]}}),
    ("csv", "a,b\n1,x\n", [{"a": 1.0, "b": "x"}]),
    ("csv", "a,b\n", []),
    ("csv", "", []),
]


@pytest.mark.parametrize(("fmt", "text", "value"), VALID)
def test_valid(fmt, text, value):
    assert kernel.parse(text, fmt) == value


@pytest.mark.parametrize(("fmt", "text", "kind"), BAD)
def test_kinds_of_errors(fmt, text, kind):
    if kind is None:
        kernel.parse(text, fmt)
        return
    with pytest.raises(DocError) as e:
        kernel.parse(text, fmt)
    assert e.value.kind == kind and e.value.span is not None


@pytest.mark.parametrize(("cell", "kind", "number"), CELLS)
def test_scalars(cell, kind, number):
    value = infer_scalar(cell)
    assert {"null": value is None, "bool": isinstance(value, bool), "number": value == number, "string": value == cell}[kind]


@pytest.mark.parametrize(("x", "text"), [(30.0, "30"), (-0.0, "-0"), (0.0, "0"), (1e21, "1" + "0" * 21), (1e-7, "0.0000001"), (1.5, "1.5"), (1e300, "1" + "0" * 300), (math.nan, "NaN"), (-math.inf, "-inf"), (5e-324, "0." + "0" * 323 + "5")])
def test_numbers(x, text):
    assert format_number(x) == text


def test_json_limits():
    with pytest.raises(DocError) as e:
        kernel.parse('{"a":{"b":{"c":1}}}', "json", Options(max_depth=2))
    assert (e.value.kind, e.value.details["max"], e.value.span[0].offset) == ("MaxDepthExceeded", 2, 10)
    with pytest.raises(DocError) as e:
        kernel.parse("1234567890", "json", Options(max_size=5))
    assert e.value.kind == "MaxSizeExceeded" and e.value.details["max"] == 5
    with pytest.raises(DocError):
        kernel.parse("/* long comment */ 1", "json", Options(max_size=10, allow_comments=True))
    assert kernel.parse("1          ", "json", Options(max_size=5)) == 1
    deep = "[" * 5000 + "]" * 5000
    assert len(list(json_doc.events(deep, UNLIMITED))) == 10_000
    assert json_doc.emit(kernel.parse(deep, "json", UNLIMITED)) == deep


def test_other_limits():
    for fmt, text in (("toml", "a = [[[1]]]"), ("yaml", "a:\n  b:\n    c: 1")):
        with pytest.raises(DocError) as e:
            kernel.parse(text, fmt, Options(max_depth=2))
        assert e.value.kind == "MaxDepthExceeded"
    for fmt, text in (("toml", "# comment comment\na = 1"), ("xml", "<aaaaaaaaaaaaaaa/>"), ("csv", "a,b,c,d,e,f,g,h")):
        with pytest.raises(DocError) as e:
            kernel.parse(text, fmt, Options(max_size=10))
        assert e.value.kind == "MaxSizeExceeded"


def test_relaxed_json():
    text = '// head\n{"a": [1, 2,], /* x */ "b": "// no",}'
    assert kernel.parse(text, "jsonc") == {"a": [1.0, 2.0], "b": "// no"}
    assert kernel.convert(text, "json", "json", RELAXED) == '{"a":[1,2],"b":"// no"}'
    for bad in ("[1,,]", "[,]", "{,}", "/* open", "[1,2,]"):
        with pytest.raises(DocError):
            kernel.parse(bad, "json", RELAXED if bad != "[1,2,]" else Options())


def test_conversion_matrix():
    documents = {"json": '[{"a":1,"b":"x"}]', "csv": "a,b\n1,x\n", "toml": "a = 1\nb = \"x\"", "yaml": "- a: 1\n  b: x\n", "xml": "<root><row><a>1</a><b>x</b></row></root>"}
    for source, text in documents.items():
        assert kernel.convert(text, source, source) == text
        for target in documents:
            try:
                again = kernel.convert(text, source, target)
            except DocError as e:
                assert target == "toml" and source in ("json", "yaml") and "object at its root" in str(e)
                continue
            kernel.parse(again, target)
    assert kernel.convert(documents["csv"], "csv", "toml") == 'rows = [{a = 1, b = "x"}]'
    assert kernel.convert(documents["xml"], "xml", "csv") == 'a,b\n1,"x"\n'
    assert kernel.convert("invalid {", "json", "json") == "invalid {"
    with pytest.raises(DocError):
        kernel.convert("1", "json", "ini")


def test_csv_details():
    assert kernel.convert('[{"a":"001"},{"b":null,"a":"true"}]', "json", "csv") == 'a,b\n"001",\n"true",\n'
    back = kernel.parse(kernel.convert('[{"a":"001","b":"null","c":""}]', "json", "csv"), "csv")
    assert back == [{"a": "001", "b": "null", "c": ""}]
    assert csv_doc.parse("a;b\n1;2", Options(delimiter=";")) == [{"a": 1.0, "b": 2.0}]
    for bad in ("", "ab", "\n", '"', "é"):
        with pytest.raises(DocError):
            csv_doc.check_delimiter(bad)
    assert csv_doc.emit([{"x": {"k": [1, True]}, "y": math.inf, "z": Datetime("date", "2020-01-01")}]) == 'x,y,z\n"{""k"":[1,true]}",,2020-01-01\n'


def test_xml_names_are_checked():
    with pytest.raises(DocError) as e:
        kernel.convert('{"a b": 1}', "json", "xml")
    assert e.value.kind == "InvalidKey"
    assert kernel.convert('{"r":{"@attributes":{"id":"1"},"#text":"t","c":[1,null]}}', "json", "xml") == '<root><r id="1">t<c>1</c><c/></r></root>'


TEXTS = st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=20)
NUMBERS = st.floats(allow_nan=False, allow_infinity=False)
VALUES = st.recursive(st.none() | st.booleans() | NUMBERS | TEXTS, lambda v: st.lists(v, max_size=4) | st.dictionaries(TEXTS, v, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_json_round_trip(value):
    text = json_doc.emit(value)
    assert json.loads(text, parse_int=float) == value == kernel.parse(text, "json") == json_doc.build(json_doc.events(text, UNLIMITED))


#: Line ends other than \n inside keys and texts are escaped by the writers only where a format has an escape for them.
LINES = st.text(st.characters(codec="utf-8", exclude_categories=["Cs"], exclude_characters="\x7f\x85\u2028\u2029"), max_size=20)
DOCUMENTS = st.dictionaries(LINES, st.recursive(st.booleans() | NUMBERS | LINES, lambda v: st.lists(v, max_size=4) | st.dictionaries(LINES, v, max_size=4), max_leaves=15), max_size=4)


@settings(max_examples=200, deadline=None)
@given(DOCUMENTS)
def test_toml_round_trip(value):
    text = toml_doc.emit(value)
    assert toml_doc.parse(text) == value
    tomllib.loads(text)


@settings(max_examples=200, deadline=None)
@given(DOCUMENTS)
def test_yaml_round_trip(value):
    assert yaml_doc.parse(yaml_doc.emit(value), UNLIMITED) == value


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b", "c d"]), LINES | NUMBERS | st.booleans(), min_size=3, max_size=3), min_size=1, max_size=4))
def test_csv_round_trip(rows):
    assert csv_doc.parse(csv_doc.emit(rows)) == rows


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"], exclude_characters="\x00"), min_size=1).filter(lambda s: s.strip()))
def test_xml_round_trip(text):
    root = xml_doc.Element("r", {"k": text}, [text, xml_doc.Element("e")])
    assert xml_doc.parse(xml_doc.emit(root)) == root


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["json", "csv", "toml", "yaml", "xml"]), st.text(st.sampled_from("[]{}<>/=:,-#\"'\\ \n\tab1.&;!?")))
def test_any_text_gives_a_value_or_a_typed_error(fmt, text):
    try:
        kernel.parse(text, fmt)
    except DocError as e:
        assert e.kind and str(e)


def test_command_line_keeps_line_ends(tmp_path):
    from quillspark.cli import main

    (tmp_path / "a.csv").write_bytes(b'a,b\r\n"one\r\ntwo",1\r\n')
    assert main(["convert", f"{tmp_path}/a.csv", "--to", "json", "--output", f"{tmp_path}/a.json"]) == 0
    assert (tmp_path / "a.json").read_bytes() == b'[{"a":"one\\r\\ntwo","b":1}]'


def test_quick_readers_agree_with_the_full_ones():
    """Documents put together from pieces: the same values, and the same errors in the same places."""
    import random

    from quillspark.kernels import json_doc, toml_doc
    from quillspark.kernels.core import RELAXED, DocError, Options

    def outcome(read):
        try:
            return repr(read())
        except DocError as e:
            return e.kind, e.start

    r = random.Random(1)
    signs = ["{", "}", "[", "]", ",", ":", '"a"', '"b,]"', "1", "true", " ", "//x\n", "/*y*/", '"\\u0041"', "null", "-", "\n", '"']
    for _ in range(4000):
        text, options = "".join(r.choice(signs) for _ in range(r.randint(0, 9))), r.choice([Options(), RELAXED, Options(max_depth=2)])
        assert outcome(lambda: json_doc.parse(text, options)) == outcome(lambda: json_doc.build(json_doc.events(text, options))), text  # noqa: B023
    lines = ["a = 1", 'b = "x"', "b.c = 2", "k = 'lit'", "# c", "[t]", "[t.u]", "[[r]]", 'x = """m"""', "d = 1979-05-27 07:32:00", "k = true # c", 'k=""', 'k = ""x', "e = [1,2]", "bad", "a = 1.", "[ t ]", "k = 1 2"]
    for _ in range(3000):
        text = r.choice(["\n", "\r\n"]).join(r.choice(lines) for _ in range(r.randint(0, 6))) + r.choice(["", "\n", "\r"])
        assert outcome(lambda: toml_doc.parse(text)) == outcome(lambda: toml_doc.read(text).root), text  # noqa: B023


@pytest.mark.parametrize("depth", [400, 4000])
def test_depth_without_a_limit(depth):
    from quillspark.kernels import toml_doc, yaml_doc
    from quillspark.kernels.core import UNLIMITED

    value, n = toml_doc.parse("a = " + "[" * depth + "]" * depth, UNLIMITED)["a"], 1
    while value:
        value, n = value[0], n + 1
    assert n == depth
    yaml_doc.parse("a: " + "[" * depth + "]" * depth, UNLIMITED)
    value = yaml_doc.parse("\n".join(" " * i + f"k{i}:" for i in range(depth)), UNLIMITED)
    for i in range(depth):
        value = value[f"k{i}"]
    assert value is None


@pytest.mark.parametrize("text", ["", "ab\n\ncd\r\n", "é\nüx\n\U0001f600y", "no end"])
def test_places_from_left_to_right(text):
    from quillspark.kernels.core import Places, place

    asked = [*range(len(text) + 1), *range(0, len(text) + 1, 3), len(text), 0]
    found = Places(text)
    assert [found.of(a) for a in asked] == [place(text, a) for a in asked]
