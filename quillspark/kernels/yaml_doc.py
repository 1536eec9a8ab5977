"""YAML, a subset: block and flow collections, quoted and plain scalars of one line, comments.

Anchors, aliases, tags, block scalars, merge keys and further documents are refused, not misread.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

from quillspark.kernels.core import Datetime, DocError, Options, format_number, quoted, recursive, to_number, too_deep
from quillspark.kernels.json_doc import Event, Token


class Line(NamedTuple):
    indent: int
    text: str  # without indentation, comment and trailing blanks
    at: int


NULLS = frozenset(["", "null", "Null", "NULL", "~"])
TRUES, FALSES = frozenset(["true", "True", "TRUE"]), frozenset(["false", "False", "FALSE"])
#: Outside quotes: what ends a comment-free part.
PARTS = re.compile(r'"(?:[^"\\]|\\.)*+"|\'(?:[^\']|\'\')*+\'|(?:^|(?<=\s))#.*|.')
#: A quoted scalar without escapes; characters that are the same in both kinds of quotes.
SIMPLE = re.compile(r'"([^"\\\n]*+)"|\'([^\'\n]*+)\'(?!\')')
UNESCAPED = re.compile(r"[^\"'\\\n]+")
COLON = re.compile(r":(?=[ \t]|$)")
GAP = re.compile(r"[ \t\r\n]*")
FLOW_PLAIN = re.compile(r"(?:[^,\[\]{}\n:#]|:(?![ \t\r\n,\[\]{}]|$)|(?<![ \t])#)+")
FLOW_KEY = re.compile(r"(?:[^,\[\]{}\n:#]|:(?![ \t\r\n,\[\]{}\"']|$))+")
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', "/": "/", "0": "\0"}
INDICATORS = "&*!|>%@`"


def quote_starts(text: str, at: int) -> bool:
    """Whether a quote there opens a quoted scalar: at the start or after an indicator or white space."""
    before = text[:at].rstrip(" ")
    return not before or before[-1] in "[{,:-?" and (before[-1] in "[{," or len(before) < at or before in "-")


def without_comment(text: str) -> str:
    if "#" not in text:
        return text
    at = 0
    while at < len(text):
        c = text[at]
        if c in "\"'" and quote_starts(text, at):
            m = PARTS.match(text, at)
            at = m.end() if len(m[0]) > 1 else at + 1
        elif c == "#" and (not at or text[at - 1] in " \t"):
            return text[:at]
        else:
            at += 1
    return text


def split_lines(text: str) -> list[Line]:
    out: list[Line] = []
    at = 0
    for raw in text.split("\n"):
        body = raw.rstrip("\r")
        indent = len(body) - len(body.lstrip(" "))
        content = without_comment(body[indent:]).rstrip(" \t")
        if content[:1] == "\t":
            if content.strip():
                raise DocError("InvalidToken", at + indent, at + indent + 1, "tab in indentation")
            content = ""
        if content:
            out.append(Line(indent, content, at + indent))
        at += len(raw) + 1
    if out and out[0].text == "---" and not out[0].indent:
        out.pop(0)
    return out


def read_quoted(text: str, at: int) -> tuple[str, int]:
    """The quoted scalar at ``at`` and the place after it; quoted scalars stay on a line."""
    m = SIMPLE.match(text, at)
    if m:
        return m[m.lastindex], m.end()
    quote, start, parts = text[at], at, []
    at += 1
    while True:
        if m := UNESCAPED.match(text, at):
            parts.append(m[0])
            at = m.end()
        c = text[at : at + 1]
        if not c or c == "\n":
            raise DocError("UnterminatedString", start, at)
        if c == quote:
            if quote == "'" and text.startswith("''", at):
                parts.append("'")
                at += 2
                continue
            return "".join(parts), at + 1
        if c == "\\" and quote == '"':
            e = text[at + 1 : at + 2]
            width = {"u": 4, "U": 8, "x": 2}.get(e)
            if e in ESCAPES and e:
                parts.append(ESCAPES[e])
                at += 2
            elif width and re.fullmatch(f"[0-9A-Fa-f]{{{width}}}", digits := text[at + 2 : at + 2 + width]) and (code := int(digits, 16)) < 0x110000 and not 0xD800 <= code < 0xE000:
                parts.append(chr(code))
                at += 2 + width
            else:
                raise DocError("InvalidUnicodeEscape" if width else "InvalidEscapeSequence", at, at + 2)
            continue
        parts.append(c)  # the other kind of quote, or a backslash between single ones
        at += 1


def plain(text: str):
    """The value of a plain scalar."""
    if text in NULLS:
        return None
    if text in TRUES or text in FALSES:
        return text in TRUES
    x = to_number(text)
    return text if x is None else x


def key_end(text: str) -> int:
    """Place of the colon that ends a key, or -1."""
    if text[:1] in "\"'":
        try:
            _, at = read_quoted(text, 0)
        except DocError:
            return -1
        at += len(text[at:]) - len(text[at:].lstrip(" "))
        return at if text[at : at + 1] == ":" and text[at + 1 : at + 2] in ("", " ", "\t") else -1
    if text[:1] in "[{":
        return -1
    m = COLON.search(text)
    return m.start() if m else -1


class Reader:
    def __init__(self, text: str, options: Options = Options()) -> None:
        self.text, self.max_depth = text, options.depth("yaml")
        self.lines = split_lines(text)
        self.starts = [line.at for line in self.lines]
        self.i = 0
        self.depth = 0

    def document(self):
        if not self.lines:
            return None
        value = self.block(self.lines[0].indent)
        if self.i < len(self.lines):
            line = self.lines[self.i]
            raise DocError("InvalidToken", line.at, line.at + 1, "unexpected content after the document")
        return value

    def deeper(self, at: int) -> None:
        self.depth += 1
        if self.max_depth and self.depth > self.max_depth:
            raise too_deep(self.max_depth, at)

    def block(self, indent: int):
        line = self.lines[self.i]
        if line.text == "-" or line.text.startswith(("- ", "-\t")):
            return self.sequence(indent)
        if key_end(line.text) >= 0:
            return self.mapping(indent)
        value = self.inline(line.text, line.at)
        if self.i < len(self.lines) and self.lines[self.i].indent > indent:
            raise self.refused(self.lines[self.i].at)
        return value

    def refused(self, at: int) -> DocError:
        return DocError("InvalidToken", at, at + 1)

    def here(self, indent: int) -> Line | None:
        """The current line if it belongs to a collection at ``indent``."""
        if self.i >= len(self.lines) or self.lines[self.i].indent < indent:
            return None
        line = self.lines[self.i]
        if line.indent > indent:
            raise self.refused(line.at)
        return line

    def sequence(self, indent: int) -> list:
        out: list = []
        self.deeper(self.lines[self.i].at)
        while (line := self.here(indent)) and (line.text == "-" or line.text.startswith(("- ", "-\t"))):
            rest = line.text[1:].lstrip(" \t")
            if rest:
                shift = len(line.text) - len(rest)
                self.lines[self.i] = Line(indent + shift, rest, line.at + shift)
                out.append(self.block(indent + shift))
            else:
                self.i += 1
                out.append(self.below(indent))
        self.depth -= 1
        return out

    def below(self, indent: int):
        """The block on the next, deeper lines, or null."""
        if self.i < len(self.lines) and self.lines[self.i].indent > indent:
            return self.block(self.lines[self.i].indent)
        return None

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        self.deeper(self.lines[self.i].at)
        while line := self.here(indent):
            colon = key_end(line.text)
            if colon < 0 or line.text == "-" or line.text.startswith(("- ", "-\t")):
                raise self.refused(line.at)
            key = self.key(line.text[:colon].rstrip(" \t"), line.at)
            if key in out:
                raise DocError("DuplicateKey", line.at, line.at + colon, key=key)
            rest = line.text[colon + 1 :].lstrip(" \t")
            if rest:
                at = line.at + len(line.text) - len(rest)
                if key_end(rest) >= 0:
                    raise self.refused(at + key_end(rest))
                out[key] = self.inline(rest, at)
                continue
            self.i += 1
            following = self.lines[self.i] if self.i < len(self.lines) else None
            if following and following.indent == indent and (following.text == "-" or following.text.startswith("- ")):
                out[key] = self.sequence(indent)
            else:
                out[key] = self.below(indent)
        self.depth -= 1
        return out

    def key(self, text: str, at: int) -> str:
        if text[:1] in ('"', "'") and text:
            return read_quoted(text, 0)[0]
        if not text or text[0] in INDICATORS or text == "<<":
            raise DocError("InvalidKey" if not text else "InvalidToken", at, at + max(1, len(text)))
        return text

    def inline(self, text: str, at: int):
        """A scalar or a flow collection; the rest of its last line has to be empty."""
        if text[0] in "[{":
            value, end = self.flow(at)
            line_end = self.text.find("\n", end)
            rest = self.text[end : len(self.text) if line_end < 0 else line_end]
            if without_comment(" " + rest).strip():
                raise self.refused(end)
            self.i = bisect_left(self.starts, end, lo=self.i + 1)
            return value
        self.i += 1
        if text[0] in "\"'":
            try:
                value, end = read_quoted(text, 0)
            except DocError as e:
                raise DocError(e.kind, at + e.start, at + e.end) from None
            if text[end:].strip():
                raise self.refused(at + end)
            return value
        return self.scalar(text, at)

    def scalar(self, text: str, at: int):
        if text[0] in INDICATORS or text in ("---", "...") or text.startswith("? "):
            raise DocError("InvalidToken", at, at + 1, "not supported")
        return plain(text)

    def gap(self, at: int) -> int:
        """After white space, line ends and comments inside a flow collection."""
        while True:
            m = GAP.match(self.text, at)
            if self.text[m.end() : m.end() + 1] != "#" or (m.end() and self.text[m.end() - 1] not in " \t\r\n"):
                return m.end()
            end = self.text.find("\n", m.end())
            at = len(self.text) if end < 0 else end

    def flow(self, at: int):
        c = self.text[at : at + 1]
        if c == "[" or c == "{":
            self.deeper(at)
            value, at = self.flow_sequence(at) if c == "[" else self.flow_mapping(at)
            self.depth -= 1
            return value, at
        if c in ('"', "'") and c:
            return read_quoted(self.text, at)
        m = FLOW_PLAIN.match(self.text, at)
        if not m or not m[0].strip():
            raise DocError("InvalidToken", at, at + 1)
        return self.scalar(m[0].strip(), at), at + len(m[0].rstrip())

    def flow_sequence(self, at: int):
        out: list = []
        at = self.gap(at + 1)
        while self.text[at : at + 1] != "]":
            value, at = self.flow(at)
            out.append(value)
            at = self.separator(at, "]")
        return out, at + 1

    def separator(self, at: int, close: str) -> int:
        at = self.gap(at)
        c = self.text[at : at + 1]
        if c == ",":
            return self.gap(at + 1)
        if c != close:
            raise DocError("InvalidToken", at, at + 1)
        return at

    def flow_mapping(self, at: int):
        out: dict = {}
        at = self.gap(at + 1)
        while self.text[at : at + 1] != "}":
            start = at
            if self.text[at : at + 1] in ('"', "'"):
                key, at = read_quoted(self.text, at)
            else:
                m = FLOW_KEY.match(self.text, at)
                if not m or not m[0].strip():
                    raise DocError("InvalidToken", at, at + 1)
                key, at = self.key(m[0].strip(), at), m.end()
            at = self.gap(at)
            if self.text[at : at + 1] != ":":
                raise DocError("InvalidToken", at, at + 1)
            at = self.gap(at + 1)
            if self.text[at : at + 1] in (",", "}"):
                value = None
            else:
                value, at = self.flow(at)
            if key in out:
                raise DocError("DuplicateKey", start, at, key=key)
            out[key] = value
            at = self.separator(at, "}")
        return out, at + 1


def parse(text: str, options: Options = Options()):
    # A level takes a bracket, or a line of its own, or a dash.
    return recursive(lambda: Reader(text, options).document(), text.count("[") + text.count("{") + text.count("\n") + text.count("-") + 1)


def tree_events(value) -> Iterator[Event]:
    """MappingStart, Key, Value, SequenceStart...: a replay of the finished value."""
    stack: list = [("value", value)]
    while stack:
        what, item = stack.pop()
        if what == "event":
            yield item
        elif isinstance(item, dict):
            yield Event("MappingStart", None, 0)
            stack.append(("event", Event("MappingEnd", None, 0)))
            for k, v in reversed(item.items()):
                stack += [("value", v), ("event", Event("Key", k, 0))]
        elif isinstance(item, list):
            yield Event("SequenceStart", None, 0)
            stack.append(("event", Event("SequenceEnd", None, 0)))
            stack += [("value", v) for v in reversed(item)]
        else:
            yield Event("Value", item, 0)


FLOW_SIGNS = {"[": "LeftBracket", "]": "RightBracket", "{": "LeftBrace", "}": "RightBrace", ",": "Comma"}


def tokens(text: str) -> Iterator[Token]:
    """Line by line: indentation changes, dashes, scalars, colons, flow signs, line ends."""
    levels = [0]
    for line in split_lines(text):
        if line.indent > levels[-1]:
            levels.append(line.indent)
            yield Token("Indent", None, line.at, line.at)
        while line.indent < levels[-1]:
            levels.pop()
            yield Token("Dedent", None, line.at, line.at)
        if line.indent != levels[-1]:
            raise DocError("InvalidToken", line.at, line.at + 1, "inconsistent indentation")
        body, at = line.text, 0
        while body[at:] == "-" or body.startswith("- ", at):
            yield Token("Dash", None, line.at + at, line.at + at + 1)
            at += 1 + len(body[at + 1 :]) - len(body[at + 1 :].lstrip(" "))
        depth = 0
        while at < len(body):
            c = body[at]
            if c in " \t":
                at += 1
            elif c in FLOW_SIGNS and (depth or c in "[{"):
                depth += (c in "[{") - (c in "]}")
                yield Token(FLOW_SIGNS[c], None, line.at + at, line.at + at + 1)
                at += 1
            elif c == ":" and body[at + 1 : at + 2] in ("", " ", "\t"):
                yield Token("Colon", None, line.at + at, line.at + at + 1)
                at += 1
            elif c in "\"'":
                value, end = read_quoted(body, at)
                yield Token("QuotedScalar", value, line.at + at, line.at + end)
                at = end
            else:
                stop = re.compile(r"(?:[^,\[\]{}:]|:(?![ \t]|$))+" if depth else r"(?:[^:]|:(?![ \t]|$))+").match(body, at)
                word = (stop[0] if stop else c).rstrip()
                yield Token("Scalar", word, line.at + at, line.at + at + len(word))
                at += max(1, len(stop[0]) if stop else 1)
        yield Token("Newline", None, line.at + len(body), line.at + len(body))
    for _ in levels[1:]:
        yield Token("Dedent", None, len(text), len(text))
    yield Token("Eof", None, len(text), len(text))


SAFE_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")


def emit_key(key: str) -> str:
    return key if SAFE_KEY.fullmatch(key) else quoted(key)


def scalar_text(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return format_number(value) if value - value == 0 else ".nan" if value != value else ".inf" if value > 0 else "-.inf"
    if isinstance(value, Datetime):
        return value.text
    return quoted(value) if isinstance(value, str) else "[]" if isinstance(value, list) else "{}"


def emit_lines(value, indent: int = 0) -> list[str]:
    pad = " " * indent
    if not isinstance(value, (list, dict)) or not value:
        return [pad + scalar_text(value)]
    out: list[str] = []
    if isinstance(value, list):
        for v in value:
            first, *rest = emit_lines(v, indent + 2)
            out += [f"{pad}- {first.lstrip(' ')}", *rest]
        return out
    for k, v in value.items():
        if isinstance(v, (list, dict)) and v:
            out += [f"{pad}{emit_key(k)}:", *emit_lines(v, indent + 2)]
        else:
            out.append(f"{pad}{emit_key(k)}: {scalar_text(v)}")
    return out


def emit(value) -> str:
    return "\n".join(emit_lines(value))
