"""TOML: tokens, events, values, text. The reader notes tokens and events as it goes."""

from __future__ import annotations

import re
from datetime import date, time
from typing import NamedTuple

from quillspark.kernels.core import Datetime, DocError, Options, byte_size, check_size, format_number, quoted, recursive, too_deep
from quillspark.kernels.json_doc import Token


class TableStart(NamedTuple):
    path: list[str]
    is_array: bool


class KeyValue(NamedTuple):
    path: list[str]
    value: object


BARE = re.compile(r"[A-Za-z0-9_-]+")
BLANK = re.compile(r"[ \t]*")
COMMENT = re.compile(r"#[^\n]*")
INTEGER = re.compile(r"[+-]?(?:0|[1-9](?:_?[0-9])*)")
BASED = re.compile(r"0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*")
FLOAT = re.compile(r"[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?")
SPECIAL = {"inf": float("inf"), "+inf": float("inf"), "-inf": float("-inf"), "nan": float("nan"), "+nan": float("nan"), "-nan": float("nan")}
SCALAR = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[^\s,\]}#]*|[^\s,\]}#=\"'\[{]+")
DATE, TIME = r"(?P<date>\d{4}-\d{2}-\d{2})", r"(?P<time>\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
DATETIMES = (
    ("offset", re.compile(rf"{DATE}[Tt ]{TIME}(?P<zone>[Zz]|[+-]\d{{2}}:\d{{2}})", re.ASCII)),
    ("local", re.compile(rf"{DATE}[Tt ]{TIME}", re.ASCII)),
    ("date", re.compile(DATE, re.ASCII)),
    ("time", re.compile(TIME, re.ASCII)),
)
DATETIME_LIKE = re.compile(r"\d{4}-|\d{2}:", re.ASCII)
BASIC_PLAIN = re.compile(r'[^"\\\n\x00-\x08\x0b-\x1f\x7f]*')
LITERAL_PLAIN = re.compile(r"[^'\n\x00-\x08\x0b-\x1f\x7f]*")
#: A whole line: a pair with a bare key and a scalar on the line, a header of bare keys, or neither.
_END = r"[ \t]*(?:#[^\n]*)?(?:\r?\n|\Z)"
_PATH = r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*"
LINE = re.compile(
    rf"[ \t]*(?:(?P<key>{BARE.pattern})[ \t]*=[ \t]*(?:\"(?P<basic>{BASIC_PLAIN.pattern})\"(?!\")|'(?P<literal>{LITERAL_PLAIN.pattern})'(?!')|(?P<word>{SCALAR.pattern}))"
    rf"|\[(?P<table>{_PATH})\]|\[\[(?P<row>{_PATH})\]\]|){_END}"
)
ESCAPES = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\"}


def read_datetime(text: str) -> Datetime | None:
    """One of the four kinds, in RFC 3339 form, if the text spells a real date or time."""
    for kind, pattern in DATETIMES:
        m = pattern.fullmatch(text)
        if not m:
            continue
        parts = m.groupdict()
        try:
            if parts.get("date"):
                date.fromisoformat(parts["date"])
            if parts.get("time"):
                time.fromisoformat(parts["time"][:8])
        except ValueError:
            return None
        zone = parts.get("zone", "").upper()
        if zone[1:] and not ("00:00" <= zone[1:] <= "23:59" and zone[4:] < "60"):
            return None
        fraction = (parts.get("time") or "").rstrip("0").rstrip(".") if "." in (parts.get("time") or "") else parts.get("time")
        return Datetime(kind, "T".join(x for x in (parts.get("date"), fraction) if x) + zone)
    return None


class Tables(dict):
    """An object that a header or a dotted key made, and so may be extended."""


class TableList(list):
    """An array that ``[[name]]`` headers make."""


class Reader:
    def __init__(self, text: str, options: Options = Options()) -> None:
        self.text, self.at = text, 0
        self.max_depth, self.max_size = options.depth("toml"), options.size("toml")
        self.depth = 0
        self.tokens: list[Token] = []
        self.events: list = []
        self.root: dict = Tables()

    def note(self, kind: str, value, start: int, end: int) -> None:
        if self.max_size and end * 4 > self.max_size and byte_size(self.text[:end]) > self.max_size:
            raise DocError("MaxSizeExceeded", start, end, max=self.max_size)
        self.tokens.append(Token(kind, value, start, end))
        self.at = end

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def blanks(self) -> None:
        self.at = BLANK.match(self.text, self.at).end()

    def lines(self) -> None:
        """White space, comments and line ends."""
        while True:
            self.blanks()
            if self.peek() == "#":
                self.at = COMMENT.match(self.text, self.at).end()
            elif self.text.startswith("\r\n", self.at):
                self.note("Newline", None, self.at, self.at + 2)
            elif self.peek() == "\n":
                self.note("Newline", None, self.at, self.at + 1)
            else:
                return

    def fail(self, kind: str, **details) -> DocError:
        return DocError(kind, self.at, min(len(self.text), self.at + 1), **details)

    def found(self) -> str:
        c = self.peek()
        return "EOF" if not c else "newline" if c in "\r\n" else "string" if c in "\"'" else f"'{c}'"

    def document(self) -> dict:
        table = self.root
        while True:
            self.lines()
            if self.at >= len(self.text):
                break
            if self.peek() == "[":
                table = self.header()
            else:
                self.pair(table, self.events.append)
            self.line_end()
        self.note("Eof", None, self.at, self.at)
        return self.root

    def plain_document(self) -> dict | None:
        """The same for a document of plain lines, without tokens and events; nothing if a line isn't plain or is wrong."""
        text, table, at = self.text, self.root, 0
        if self.max_size and byte_size(text) > self.max_size:
            return None
        try:
            while at < len(text):
                m = LINE.match(text, at)
                if not m:
                    return None
                at, key = m.end(), m["key"]
                if key:
                    if key in table:
                        return None
                    word = m["word"]
                    table[key] = self.scalar(word.rstrip(" "), at)[1] if word is not None else m["basic"] if m["basic"] is not None else m["literal"]
                elif m["table"]:
                    table = self.opened(m["table"].split("."), False)
                elif m["row"]:
                    table = self.opened(m["row"].split("."), True)
        except DocError:
            return None
        return self.root

    def line_end(self) -> None:
        self.blanks()
        if self.peek() == "#":
            self.at = COMMENT.match(self.text, self.at).end()
        if self.peek() and not self.text.startswith(("\n", "\r\n"), self.at):
            raise self.fail("Expected", expected="newline", found=self.found())

    def header(self) -> dict:
        double = self.text.startswith("[[", self.at)
        n = 1 + double
        self.note("DoubleLeftBracket" if double else "LeftBracket", None, self.at, self.at + n)
        self.blanks()
        path = self.key_path()
        self.blanks()
        if not self.text.startswith("]" * n, self.at):
            raise self.fail("InvalidKey")
        self.note("DoubleRightBracket" if double else "RightBracket", None, self.at, self.at + n)
        self.events.append(TableStart(path, double))
        return self.opened(path, double)

    def opened(self, path: list[str], double: bool) -> dict:
        """The table that a header names; a new one of its list if the header is double."""
        table = self.root
        for key in path[: -1 if double else None]:
            table = self.step(table, key)
        if not double:
            return table
        rows = table.setdefault(path[-1], TableList())
        if not isinstance(rows, TableList):
            raise self.fail("InvalidArray" if isinstance(rows, list) else "InvalidKey")
        rows.append(Tables())
        return rows[-1]

    def step(self, table: dict, key: str) -> dict:
        """The table below a key, made if it isn't there."""
        found = table.setdefault(key, Tables())
        if isinstance(found, TableList) and found:
            return found[-1]
        if isinstance(found, list):
            raise self.fail("InvalidArray")
        if not isinstance(found, dict):
            raise self.fail("InvalidKey")
        return found

    def key_path(self) -> list[str]:
        path = [self.key()]
        while True:
            self.blanks()
            if self.peek() != ".":
                return path
            self.note("Dot", None, self.at, self.at + 1)
            self.blanks()
            path.append(self.key())

    def key(self) -> str:
        start = self.at
        if self.peek() in ('"', "'") and self.peek():
            if self.text.startswith(('"""', "'''"), start):
                raise self.fail("InvalidKey")
            value, end = self.string()
            self.note("String", value, start, end)
            return value
        m = BARE.match(self.text, start)
        if not m:
            raise self.fail("InvalidKey")
        self.note("BareKey", m[0], start, m.end())
        return m[0]

    def pair(self, table: dict, say=None) -> None:
        path = self.key_path()
        if self.peek() != "=":
            raise self.fail("Expected", expected="'='", found=self.found())
        self.note("Equals", None, self.at, self.at + 1)
        self.blanks()
        value = self.value()
        for key in path[:-1]:
            table = self.step(table, key)
        if path[-1] in table:
            raise self.fail("DuplicateKey", key=path[-1])
        table[path[-1]] = value
        if say:
            say(KeyValue(path, value))

    def value(self):
        c, start = self.peek(), self.at
        if c in ('"', "'") and c:
            value, end = self.string()
            self.note("String", value, start, end)
            return value
        if c == "[":
            return self.nested(self.array)
        if c == "{":
            return self.nested(self.inline_table)
        m = SCALAR.match(self.text, start)
        if not m:
            raise self.fail("Expected", expected="value", found=self.found())
        kind, value = self.scalar(m[0].rstrip(), start)
        self.note(kind, value.text if kind == "Datetime" else value, start, start + len(m[0].rstrip()))
        return value

    def nested(self, read):
        if self.max_depth and self.depth >= self.max_depth:
            raise too_deep(self.max_depth, self.at)
        self.depth += 1
        value = read()
        self.depth -= 1
        return value

    def scalar(self, word: str, start: int) -> tuple[str, object]:
        if word in ("true", "false"):
            return "Bool", word == "true"
        if word in SPECIAL:
            return "Float", SPECIAL[word]
        if DATETIME_LIKE.match(word):
            value = read_datetime(word)
            if value is None:
                raise DocError("InvalidDatetime", start, start + len(word))
            return "Datetime", value
        digits = word.replace("_", "")
        if INTEGER.fullmatch(word):
            return "Integer", float(digits)
        if FLOAT.fullmatch(word):
            return "Float", float(digits)
        if BASED.fullmatch(word):
            return "Integer", float(int(digits, 0))
        raise DocError("InvalidNumber" if re.match(r"[+-]?[0-9.]", word) else "InvalidToken", start, start + len(word))

    def array(self) -> list:
        self.note("LeftBracket", None, self.at, self.at + 1)
        out: list = []
        while True:
            self.lines()
            if self.peek() == "]":
                break
            if not self.peek():
                raise self.fail("InvalidArray")
            out.append(self.value())
            self.lines()
            if self.peek() == "]":
                break
            if self.peek() != ",":
                raise self.fail("InvalidArray")
            self.note("Comma", None, self.at, self.at + 1)
        self.note("RightBracket", None, self.at, self.at + 1)
        return out

    def inline_table(self) -> dict:
        self.note("LeftBrace", None, self.at, self.at + 1)
        out: dict = {}
        while True:
            self.blanks()
            if self.peek() == "}":
                break
            if not self.peek():
                raise self.fail("InvalidInlineTable")
            self.pair(out)
            self.blanks()
            if self.peek() == "}":
                break
            if self.peek() != ",":
                raise self.fail("InvalidInlineTable")
            self.note("Comma", None, self.at, self.at + 1)
        self.note("RightBrace", None, self.at, self.at + 1)
        return out

    def string(self) -> tuple[str, int]:
        text, start = self.text, self.at
        quote = text[start]
        many = text.startswith(quote * 3, start)
        at = start + (3 if many else 1)
        if many and text.startswith(("\n", "\r\n"), at):
            at = text.index("\n", at) + 1
        plain = BASIC_PLAIN if quote == '"' else LITERAL_PLAIN
        parts: list[str] = []
        while True:
            m = plain.match(text, at)
            parts.append(m[0])
            at = m.end()
            c = text[at : at + 1]
            if not c or (c == "\n" and not many):
                raise DocError("UnterminatedString", start, at)
            if c == quote:
                if not many:
                    return "".join(parts), at + 1
                run = len(text[at : at + 5]) - len(text[at : at + 5].lstrip(quote))
                if run >= 3:  # up to two quotes may stand before the closing three
                    return "".join(parts) + quote * (run - 3), at + run
                parts.append(quote * run)
                at += run
            elif c == "\\":
                piece, at = self.escape(at, many)
                parts.append(piece)
            elif c == "\n" or text.startswith("\r\n", at):
                if not many:
                    raise DocError("UnterminatedString", start, at)
                parts.append("\n")
                at = text.index("\n", at) + 1
            else:
                raise DocError("InvalidToken", at, at + 1, "control character in string")

    def escape(self, at: int, many: bool) -> tuple[str, int]:
        e = self.text[at + 1 : at + 2]
        if e in ESCAPES and e:
            return ESCAPES[e], at + 2
        if e in ("u", "U") and e:
            n = 4 if e == "u" else 8
            digits = self.text[at + 2 : at + 2 + n]
            code = int(digits, 16) if re.fullmatch(f"[0-9A-Fa-f]{{{n}}}", digits) else -1
            if not 0 <= code < 0x110000 or 0xD800 <= code < 0xE000:
                raise DocError("InvalidUnicodeEscape", at, at + 2 + n)
            return chr(code), at + 2 + n
        if many and (m := re.compile(r"\\[ \t]*\r?\n\s*").match(self.text, at)):
            return "", m.end()
        if not e:
            raise DocError("UnterminatedString", at, at + 1)
        raise DocError("InvalidEscapeSequence", at, at + 2)


def read(text: str, options: Options = Options()) -> Reader:
    """A reader that has read the document: its value, tokens and events."""

    def run() -> Reader:
        reader = Reader(text, options)
        reader.document()
        return reader

    return recursive(run, text.count("[") + text.count("{") + 1)


def parse(text: str, options: Options = Options()) -> dict:
    found = Reader(text, options).plain_document()
    return read(text, options).root if found is None else found


def bare_or_quoted(key: str) -> str:
    return key if BARE.fullmatch(key) else quoted(key)


def emit_value(value) -> str:
    if value is None:
        return '""'
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return format_number(value) if value - value == 0 else "nan"
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, Datetime):
        return value.text
    if isinstance(value, list):
        return f"[{', '.join(map(emit_value, value))}]"
    return "{" + ", ".join(f"{bare_or_quoted(k)} = {emit_value(v)}" for k, v in value.items()) + "}"


def emit(value) -> str:
    """A line for each key of the root, everything below it inline."""
    if not isinstance(value, dict):
        raise DocError("InvalidToken", message="TOML needs an object at its root")
    return "\n".join(f"{bare_or_quoted(k)} = {emit_value(v)}" for k, v in value.items())


__all__ = ["KeyValue", "Reader", "TableStart", "check_size", "emit", "parse", "read_datetime"]
