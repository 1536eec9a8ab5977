"""XML: elements, values, rows, text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quillspark.kernels.core import Datetime, DocError, Options, byte_size, format_number, infer_scalar
from quillspark.kernels.json_doc import emit as emit_json


@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # of Element and str


NAME = re.compile(r"[A-Za-z_:][A-Za-z0-9_:.-]*")
SPACE = re.compile(r"[ \t\r\n]*")
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
REFERENCE = re.compile(r"&([^;&<]*);?")


def decoded(text: str, at: int) -> str:
    """The text, which starts at ``at``, without references."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        body = m[1]
        if m[0].endswith(";"):
            if body in ENTITIES:
                return ENTITIES[body]
            if number := re.fullmatch(r"#(?:x([0-9A-Fa-f]+)|([0-9]+))", body):
                code = int(number[1], 16) if number[1] else int(number[2])
                if code < 0x110000 and not 0xD800 <= code < 0xE000:
                    return chr(code)
        raise DocError("InvalidToken", at + m.start(), at + m.end(), "invalid entity")

    return REFERENCE.sub(one, text)


def _skip_until(text: str, at: int, opening: str, closing: str) -> int:
    end = text.find(closing, at + len(opening))
    if end < 0:
        raise DocError("InvalidToken", at, len(text), f"{opening} without {closing}")
    return end + len(closing)


def _prolog(text: str, at: int) -> int:
    """After white space, declarations, comments and processing instructions outside the root."""
    while True:
        at = SPACE.match(text, at).end()
        if text.startswith("<?", at):
            at = _skip_until(text, at, "<?", "?>")
        elif text.startswith("<!--", at):
            at = _skip_until(text, at, "<!--", "-->")
        elif text.startswith("<!", at) and not text.startswith("<![", at):
            at = _doctype(text, at)
        else:
            return at


def _doctype(text: str, at: int) -> int:
    """After a declaration, whose brackets may hold further ones."""
    inside = re.compile(r"[\[\]>]|\"[^\"]*\"|'[^']*'")
    depth, start = 0, at
    while m := inside.search(text, at):
        at = m.end()
        depth += (m[0] == "[") - (m[0] == "]")
        if m[0] == ">" and depth <= 0:
            return at
    raise DocError("InvalidToken", start, len(text), "unterminated declaration")


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    out: dict[str, str] = {}
    while True:
        spaced = SPACE.match(text, at).end()
        m = NAME.match(text, spaced)
        if not m:
            return out, spaced
        if spaced == at:
            raise DocError("InvalidToken", at, at + 1, "white space expected before an attribute")
        at = SPACE.match(text, m.end()).end()
        if text[at : at + 1] != "=":
            raise DocError("InvalidToken", at, at + 1, "'=' expected after an attribute's name")
        at = SPACE.match(text, at + 1).end()
        quote = text[at : at + 1]
        end = text.find(quote, at + 1) if quote and quote in "\"'" else -1
        if end < 0 or "<" in text[at:end]:
            raise DocError("InvalidToken", at, at + 1, "attribute value expected")
        if m[0] in out:
            raise DocError("InvalidToken", m.start(), m.end(), f"duplicate attribute: {m[0]}")
        out[m[0]] = decoded(text[at + 1 : end], at + 1)
        at = end + 1


def parse(text: str, options: Options = Options()) -> Element:
    """The root element. Mixed content keeps its order; text of white space alone is dropped."""
    limit = options.size("xml")
    if limit and len(text) * 4 > limit and byte_size(text) > limit:
        raise DocError("MaxSizeExceeded", 0, 0, max=limit)
    depth_limit = options.max_depth or 0
    at = _prolog(text, 0)
    stack: list[Element] = []
    root = None
    while True:
        if text.startswith("</", at):
            m = NAME.match(text, at + 2)
            end = SPACE.match(text, m.end()).end() if m else at
            if not m or not stack or m[0] != stack[-1].name or text[end : end + 1] != ">":
                raise DocError("InvalidToken", at, end + 1, "mismatched closing tag")
            stack.pop()
            at = end + 1
        elif text.startswith("<!--", at):
            at = _skip_until(text, at, "<!--", "-->")
        elif text.startswith("<![CDATA[", at) and stack:
            end = _skip_until(text, at, "<![CDATA[", "]]>")
            _add_text(stack[-1], text[at + 9 : end - 3])
            at = end
        elif text.startswith("<?", at):
            at = _skip_until(text, at, "<?", "?>")
        elif text.startswith("<", at):
            m = NAME.match(text, at + 1)
            if not m:
                raise DocError("InvalidToken", at, at + 2, "element name expected")
            if depth_limit and len(stack) >= depth_limit:
                raise DocError("MaxDepthExceeded", at, at + 1, max=depth_limit)
            attributes, end = _attributes(text, m.end())
            element = Element(m[0], attributes)
            if stack:
                stack[-1].children.append(element)
            else:
                root = element
            if text.startswith("/>", end):
                at = end + 2
            elif text.startswith(">", end):
                stack.append(element)
                at = end + 1
            else:
                raise DocError("InvalidToken", end, end + 1, "'>' expected")
        else:
            end = text.find("<", at)
            if not stack or end < 0:
                raise DocError("InvalidToken", at, len(text), "root element expected" if not stack else "unterminated element")
            if text[at:end].strip(" \t\r\n"):
                _add_text(stack[-1], decoded(text[at:end], at))
            at = end
        if root is not None and not stack:
            break
    at = _prolog(text, at)
    if at < len(text):
        raise DocError("InvalidToken", at, len(text), "content after the root element")
    return root


def _add_text(element: Element, text: str) -> None:
    if element.children and isinstance(element.children[-1], str):
        element.children[-1] += text
    elif text:
        element.children.append(text)


def to_value(root: Element) -> dict:
    """``{name: {...}}``: attributes under ``@attributes``, text under ``#text``, repeated children in arrays."""
    top: dict = {}
    work = [(root, top, root.name)]
    done: list[tuple[Element, dict]] = []
    made: dict[int, dict] = {}
    while work:
        element, _, _ = work.pop()
        out: dict = {}
        if element.attributes:
            out["@attributes"] = dict(element.attributes)
        text = "".join(c for c in element.children if isinstance(c, str))
        if text.strip():
            out["#text"] = text
        made[id(element)] = out
        done.append((element, out))
        work += [(c, out, c.name) for c in element.children if isinstance(c, Element)]
    for element, out in done:
        for c in element.children:
            if isinstance(c, str):
                continue
            value = made[id(c)]
            if c.name not in out:
                out[c.name] = value
            elif isinstance(out[c.name], list):
                out[c.name].append(value)
            else:
                out[c.name] = [out[c.name], value]
    top[root.name] = made[id(root)]
    return top


def to_rows(root: Element) -> list[dict]:
    """The ``row`` children of the root as objects of typed leaves."""
    out = []
    for row in root.children:
        if isinstance(row, Element) and row.name == "row":
            out.append({f.name: _leaf(f) for f in row.children if isinstance(f, Element)})
    return out


def _leaf(element: Element):
    if not element.children:
        return None
    if len(element.children) == 1 and isinstance(element.children[0], str):
        text = element.children[0]
        value = infer_scalar(text.strip())
        return text if isinstance(value, str) else value
    raise DocError("InvalidToken", message="a row's fields hold text alone")


def scalar_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return format_number(value)
    return value.text if isinstance(value, Datetime) else value


def _content(value) -> list:
    if value is None:
        return []
    if isinstance(value, list):
        return [c for v in value for c in _content(v)]
    if isinstance(value, dict):
        return [e for k, v in value.items() for e in _elements(k, v)]
    return [scalar_text(value)]


def _elements(name: str, value) -> list[Element]:
    if isinstance(value, list):
        return [e for v in value for e in _elements(name, v)]
    if not NAME.fullmatch(name):
        raise DocError("InvalidKey", message=f"not an XML name: {name}")
    if not isinstance(value, dict):
        return [Element(name, {}, _content(value))]
    attributes, children = {}, []
    if isinstance(value.get("@attributes"), dict):
        attributes = {k: v if isinstance(v, str) else emit_json(v) for k, v in value["@attributes"].items()}
        if bad := next((k for k in attributes if not NAME.fullmatch(k)), None):
            raise DocError("InvalidKey", message=f"not an XML name: {bad}")
    if isinstance(value.get("#text"), str):
        children.append(value["#text"])
    for k, v in value.items():
        if k not in ("@attributes", "#text"):
            children += _elements(k, v)
    return [Element(name, attributes, children)]


def from_value(value) -> Element:
    return Element("root", {}, _content(value))


def from_rows(rows) -> Element:
    """``<root><row>...</row></root>`` of an array of flat objects."""
    if not isinstance(rows, list):
        raise DocError("InvalidToken", message="rows for XML are an array of objects")
    out = Element("root")
    for row in rows:
        if not isinstance(row, dict):
            raise DocError("InvalidToken", message="a row for XML is an object")
        if bad := next((k for k in row if not NAME.fullmatch(k)), None):
            raise DocError("InvalidKey", message=f"not an XML name: {bad}")
        out.children.append(Element("row", {}, [Element(k, {}, _content(v)) for k, v in row.items()]))
    return out


_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def escaped(text: str) -> str:
    for plain, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = text.replace(plain, f"&{name};")
    return _FORBIDDEN.sub(lambda m: f"&#{ord(m[0])};", text)


def emit(root: Element) -> str:
    out: list[str] = []
    stack: list = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, tuple):  # a closing tag
            out.append(item[0])
        elif isinstance(item, str):
            out.append(escaped(item))
        else:
            head = item.name + "".join(f' {k}="{escaped(v)}"' for k, v in item.attributes.items())
            if not item.children:
                out.append(f"<{head}/>")
                continue
            out.append(f"<{head}>")
            stack.append((f"</{item.name}>",))
            stack += reversed(item.children)
    return "".join(out)
