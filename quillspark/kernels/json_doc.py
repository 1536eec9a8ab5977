"""JSON and JSON with comments: tokens, events, values, text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from quillspark.kernels.core import Datetime, DocError, Options, byte_size, format_number, quoted, too_deep


class Token(NamedTuple):
    kind: str
    value: object
    start: int
    end: int


SIGNS = {"{": "LeftBrace", "}": "RightBrace", "[": "LeftBracket", "]": "RightBracket", ":": "Colon", ",": "Comma"}
NAMES = {v: f"'{k}'" for k, v in SIGNS.items()} | {"Null": "null", "True": "true", "False": "false", "String": "string", "Number": "number", "Eof": "EOF"}
LITERALS = {"null": ("Null", None), "true": ("True", True), "false": ("False", False)}
VALUE_KINDS = frozenset(["Null", "True", "False", "String", "Number", "LeftBrace", "LeftBracket"])
SPACE = re.compile(r"[ \t\r\n]*")
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
NUMBER_LIKE = re.compile(r"[-+.0-9A-Za-z]+")
PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
HEX4 = re.compile(r"[0-9a-fA-F]{4}")


def skip(text: str, at: int, comments: bool) -> int:
    while True:
        at = SPACE.match(text, at).end()
        if not comments or text[at : at + 1] != "/":
            return at
        if text.startswith("//", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            if end < 0:
                raise DocError("InvalidToken", at, len(text), "unterminated block comment")
            at = end + 2
        else:
            return at


def read_string(text: str, at: int) -> tuple[str, int]:
    """The string whose opening quote is at ``at``, and the place after its closing one."""
    start, parts = at, []
    at += 1
    while True:
        m = PLAIN.match(text, at)
        parts.append(m[0])
        at = m.end()
        c = text[at : at + 1]
        if c == '"':
            return "".join(parts), at + 1
        if not c:
            raise DocError("UnterminatedString", start, at)
        if c != "\\":
            raise DocError("InvalidToken", at, at + 1, "control character in string")
        e = text[at + 1 : at + 2]
        if e in ESCAPES and e:
            parts.append(ESCAPES[e])
            at += 2
        elif e == "u":
            code, at = _unicode(text, at)
            parts.append(chr(code))
        elif not e:
            raise DocError("UnterminatedString", start, len(text))
        else:
            raise DocError("InvalidEscapeSequence", at, at + 2)


def _unicode(text: str, at: int) -> tuple[int, int]:
    m = HEX4.match(text, at + 2)
    if not m:
        raise DocError("InvalidUnicodeEscape", at, min(len(text), at + 6))
    code, end = int(m[0], 16), at + 6
    if 0xD800 <= code < 0xDC00 and text.startswith("\\u", end) and (low := HEX4.match(text, end + 2)) and 0xDC00 <= (second := int(low[0], 16)) < 0xE000:
        return 0x10000 + ((code - 0xD800) << 10) + second - 0xDC00, end + 6
    if 0xD800 <= code < 0xE000:
        raise DocError("InvalidUnicodeEscape", at, end)
    return code, end


def tokens(text: str, options: Options = Options()) -> Iterator[Token]:
    """All tokens, Eof last."""
    at = 0
    while True:
        at = skip(text, at, options.allow_comments)
        c = text[at : at + 1]
        if not c:
            yield Token("Eof", None, at, at)
            return
        if c in SIGNS:
            yield Token(SIGNS[c], None, at, at + 1)
            at += 1
        elif c == '"':
            value, end = read_string(text, at)
            yield Token("String", value, at, end)
            at = end
        elif c == "-" or "0" <= c <= "9":
            m = NUMBER.match(text, at)
            like = NUMBER_LIKE.match(text, at)
            if not m or m.end() < like.end():
                raise DocError("InvalidNumber", at, like.end())
            yield Token("Number", float(m[0]), at, m.end())
            at = m.end()
        else:
            for word, (kind, value) in LITERALS.items():
                if text.startswith(word, at):
                    yield Token(kind, value, at, at + len(word))
                    at += len(word)
                    break
            else:
                raise DocError("InvalidToken", at, at + 1)


class Event(NamedTuple):
    name: str
    value: object
    start: int


def expected(what: str, found: Token) -> DocError:
    return DocError("Expected", found.start, found.end, expected=what, found=NAMES[found.kind])


def events(text: str, options: Options = Options()) -> Iterator[Event]:
    """ObjectStart, Key, Value, ArrayStart, ...: what a reader that keeps no tree sees."""
    depth_limit, size_limit = options.depth("json"), options.size("json")
    stack: list[str] = []
    stream = tokens(text, options)

    def take() -> Token:
        t = next(stream)
        if size_limit and t.kind != "Eof" and t.end * 4 > size_limit and byte_size(text[: t.end]) > size_limit:
            raise DocError("MaxSizeExceeded", t.start, t.end, max=size_limit)
        return t

    def value(t: Token, what: str = "value") -> Event:
        if t.kind in ("LeftBrace", "LeftBracket"):
            if depth_limit and len(stack) >= depth_limit:
                raise too_deep(depth_limit, t.start)
            stack.append(t.kind)
            return Event("ObjectStart" if t.kind == "LeftBrace" else "ArrayStart", None, t.start)
        if t.kind not in VALUE_KINDS:
            raise expected(what, t)
        return Event("Value", t.value, t.start)

    t = take()
    if t.kind == "Eof":
        raise DocError("InvalidToken", t.start, t.end, "empty input")
    yield value(t)
    fresh = True  # nothing yet in the innermost container
    while stack:
        t = take()
        in_object = stack[-1] == "LeftBrace"
        close, end = ("RightBrace", "ObjectEnd") if in_object else ("RightBracket", "ArrayEnd")
        if not fresh and t.kind != close:
            if t.kind != "Comma":
                raise expected(f"',' or {NAMES[close]}", t)
            t = take()
            if t.kind == close and not options.allow_trailing_commas:
                raise expected("string" if in_object else "value", t)
        if t.kind == close:
            stack.pop()
            yield Event(end, None, t.start)
            fresh = False
            continue
        if in_object:
            if t.kind != "String":
                raise expected("string or '}'" if fresh else "string", t)
            yield Event("Key", t.value, t.start)
            t = take()
            if t.kind != "Colon":
                raise expected("':'", t)
            t = take()
        before = len(stack)
        yield value(t)
        fresh = len(stack) > before
    if not options.allow_trailing_content:
        t = take()
        if t.kind != "Eof":
            raise expected("EOF", t)


def build(stream: Iterator[Event]):
    """The value that the events spell; a repeated key keeps its place and takes the last value."""
    stack: list = []
    key_stack: list = []
    key = None
    for name, value, _ in stream:
        if name == "Key":
            key = value
            continue
        if name in ("ObjectEnd", "ArrayEnd"):
            value = stack.pop()
            key = key_stack.pop()
        elif name in ("ObjectStart", "ArrayStart"):
            stack.append({} if name == "ObjectStart" else [])
            key_stack.append(key)
            continue
        if not stack:
            result = value
        elif isinstance(stack[-1], dict):
            stack[-1][key] = value
        else:
            stack[-1].append(value)
    return result


def _refuse(name: str):
    raise ValueError(name)


#: Strings and whatever else isn't a bracket: what is left without them tells the depth.
NO_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*+"|[^\[\]{}"]++', re.DOTALL)
COMMENTS = re.compile(r'("(?:[^"\\]|\\.)*+")|//[^\n]*|/\*.*?\*/', re.DOTALL)
LAST_COMMAS = re.compile(r'("(?:[^"\\]|\\.)*+"(?:\s*,(?=\s*[\]}]))?)|(?<=[0-9a-z\]}])\s*,(?=\s*[\]}])', re.DOTALL)
#: Nesting that the quick reader takes at most.
QUICK_DEPTH = 500


def _nesting(text: str) -> int:
    deepest = depth = 0
    for c in NO_BRACKETS.sub("", text):
        depth += 1 if c in "[{" else -1
        deepest = max(deepest, depth)
    return deepest


def _strict(text: str, options: Options) -> str:
    """The text without comments and last commas, where these are allowed."""
    if options.allow_comments and "/" in text:
        text = COMMENTS.sub(lambda m: m[1] or " ", text)
    if options.allow_trailing_commas and "," in text:
        text = LAST_COMMAS.sub(lambda m: m[1].rstrip(", \t\r\n") if m[1] else "", text)
    return text


def parse(text: str, options: Options = Options()):
    """The document's value. Documents within the limits take the quick reader; those that it refuses, and all others, the events."""
    depth, size = options.depth("json"), options.size("json")
    most = min(depth or QUICK_DEPTH, QUICK_DEPTH)
    if not options.allow_trailing_content and (not size or len(text) * 4 <= size or byte_size(text) <= size) and "\\ud" not in text and "\\uD" not in text:
        plain = _strict(text, options)
        if plain.count("[") + plain.count("{") <= most or _nesting(plain) <= most:
            try:
                return json.loads(plain, parse_int=float, parse_constant=_refuse)
            except (ValueError, RecursionError):
                pass
    return build(events(text, options))


def emit(value) -> str:
    """Compact text in the value's order; numbers that aren't finite become null, dates text."""
    out: list[str] = []
    stack: list[tuple[Iterator, str]] = []

    def scalar(v) -> str | None:
        if v is None or v is True or v is False:
            return "null" if v is None else "true" if v else "false"
        if isinstance(v, str):
            return quoted(v)
        if isinstance(v, Datetime):
            return quoted(v.text)
        if isinstance(v, (int, float)):
            return format_number(v) if v - v == 0 else "null"
        return None

    def open_(v) -> None:
        out.append("{" if isinstance(v, dict) else "[")
        stack.append((iter(v.items() if isinstance(v, dict) else v), "}" if isinstance(v, dict) else "]"))

    s = scalar(value)
    if s is not None:
        return s
    open_(value)
    first = True
    while stack:
        items, close = stack[-1]
        try:
            item = next(items)
        except StopIteration:
            out.append(close)
            stack.pop()
            first = False
            continue
        if not first:
            out.append(",")
        if close == "}":
            out.append(quoted(item[0]) + ":")
            item = item[1]
        s = scalar(item)
        if s is None:
            open_(item)
            first = True
        else:
            out.append(s)
            first = False
    return "".join(out)
