"""Parse by format, and the conversion matrix."""

from __future__ import annotations

from collections.abc import Iterator

from quillspark.kernels import csv_doc, json_doc, toml_doc, xml_doc, yaml_doc
from quillspark.kernels.core import FORMATS, Datetime, DocError, Options, kind_of
from quillspark.kernels.json_doc import Event, Token

EMITTERS = {"json": json_doc.emit, "csv": csv_doc.emit, "toml": toml_doc.emit, "yaml": yaml_doc.emit}


def resolve(fmt: str) -> tuple[str, bool]:
    """A format's canonical name, and whether its name asks for comments and trailing commas."""
    name = (fmt or "").lower()
    canonical = {"jsonc": "json", "yml": "yaml"}.get(name, name)
    if canonical not in FORMATS:
        raise DocError("UnknownFormat", message=f"Unknown format: {fmt}")
    return canonical, name == "jsonc"


def with_name(fmt: str, options: Options) -> tuple[str, Options]:
    name, relaxed = resolve(fmt)
    if relaxed and not (options.allow_comments and options.allow_trailing_commas):
        options = Options(options.max_depth, options.max_size, True, True, options.allow_trailing_content, options.delimiter)
    return name, options


def text_of(content: str | bytes) -> str:
    if isinstance(content, str):
        return content
    try:
        return bytes(content).decode("utf-8")
    except UnicodeDecodeError as e:
        raise DocError("InvalidToken", message=f"invalid UTF-8 at byte {e.start}") from None


def parse(text: str, fmt: str, options: Options = Options()):
    """The value of a document; an XML document is its ``{name: {...}}`` form."""
    name, options = with_name(fmt, options)
    try:
        if name == "xml":
            return xml_doc.to_value(xml_doc.parse(text, options))
        return {"json": json_doc.parse, "csv": csv_doc.parse, "toml": toml_doc.parse, "yaml": yaml_doc.parse}[name](text, options)
    except DocError as e:
        raise e.located(text) from None


def convert(text: str, source: str, target: str, options: Options = Options()) -> str:
    """The document in another format. Between equal formats it is returned as it is, but JSON that may
    have comments or trailing commas is written anew."""
    (name, options), (to, _) = with_name(source, options), resolve(target)
    if name == to and not (name == "json" and (options.allow_comments or options.allow_trailing_commas)):
        return text
    try:
        # Only JSON and CSV take options here.
        own = options if name in ("json", "csv") else Options()
        if name == "xml":
            root = xml_doc.parse(text, own)
            return csv_doc.emit(xml_doc.to_rows(root)) if to == "csv" else EMITTERS[to](xml_doc.to_value(root))
        value = parse(text, name, own)
        if to == "xml":
            return xml_doc.emit(xml_doc.from_rows(value) if name == "csv" else xml_doc.from_value(value))
        if name == "csv" and to == "toml":
            value = {"rows": value}
        return EMITTERS[to](value)
    except DocError as e:
        raise e.located(text) from None


def tokens(text: str, fmt: str, options: Options = Options()) -> Iterator[Token]:
    name, options = with_name(fmt, options)
    if name == "json":
        return json_doc.tokens(text, options)
    if name == "toml":
        return iter(toml_doc.read(text, options).tokens)
    if name == "yaml":
        return yaml_doc.tokens(text)
    raise DocError("UnknownFormat", message=f"no tokens for {name}")


def events(text: str, fmt: str, options: Options = Options()) -> Iterator[tuple[str, list[str] | None, object]]:
    """(event, path of a TOML event, value) of the pull interface of JSON, TOML and YAML."""
    name, options = with_name(fmt, options)
    if name == "json":
        for e in json_doc.events(text, options):
            yield e.name, None, e.value
    elif name == "yaml":
        for e in yaml_doc.tree_events(yaml_doc.parse(text, options)):
            yield e.name, None, e.value
    elif name == "toml":
        for e in toml_doc.read(text, options).events:
            if isinstance(e, toml_doc.TableStart):
                yield "ArrayTableStart" if e.is_array else "TableStart", e.path, None
            else:
                yield "KeyValue", e.path, e.value
    else:
        raise DocError("UnknownFormat", message=f"no events for {name}")


def nodes(value) -> Iterator[dict]:
    """A row for each value of the tree, parents first: ids, path, depth, place, key, kind, content."""
    stack = [(value, None, "$", 0, 0, None)]
    n = 0
    while stack:
        v, parent, path, depth, pos, key = stack.pop()
        kind = kind_of(v)
        text = v if kind == "string" else v.text if isinstance(v, Datetime) else None
        yield {"node_id": n, "parent_id": parent, "path": path, "depth": depth, "pos": pos, "key": key, "kind": kind, "num": float(v) if kind == "number" else None, "str": text, "bool": v if kind == "bool" else None}
        if kind == "object":
            children = [(c, n, f"{path}.{k}", depth + 1, i, k) for i, (k, c) in enumerate(v.items())]
        else:
            children = [(c, n, f"{path}[{i}]", depth + 1, i, None) for i, c in enumerate(v)] if kind == "array" else []
        stack += reversed(children)
        n += 1


def xml_nodes(root: xml_doc.Element) -> Iterator[dict]:
    """As ``nodes``, for elements, attributes and text in document order."""
    stack: list = [(root, None, f"/{root.name}", 0, 0, "element")]
    n = 0
    while stack:
        item, parent, path, depth, pos, kind = stack.pop()
        name, text = (item.name, None) if kind == "element" else (item[0], item[1]) if kind == "attribute" else (None, item)
        yield {"node_id": n, "parent_id": parent, "path": path, "depth": depth, "pos": pos, "key": name, "kind": kind, "num": None, "str": text, "bool": None}
        if kind == "element":
            inner = [((k, v), n, f"{path}/@{k}", depth + 1, i, "attribute") for i, (k, v) in enumerate(item.attributes.items())]
            inner += [(c, n, f"{path}/text()" if isinstance(c, str) else f"{path}/{c.name}", depth + 1, i, "text" if isinstance(c, str) else "element") for i, c in enumerate(item.children)]
            stack += reversed(inner)
        n += 1


__all__ = ["Event", "convert", "events", "nodes", "parse", "resolve", "text_of", "tokens", "xml_nodes"]
