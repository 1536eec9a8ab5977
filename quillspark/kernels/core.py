"""What all kernels share: errors with places, limits, scalar rules, escapes. No Spark here."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import NamedTuple

#: Error kinds, as fixed names that callers may match on.
ERROR_KINDS = (
    "InvalidEscapeSequence", "InvalidUnicodeEscape", "UnterminatedString", "InvalidNumber", "InvalidToken", "Expected", "TrailingComma", "MissingComma",
    "DuplicateKey", "InvalidKey", "InvalidDatetime", "InvalidInlineTable", "InvalidArray", "MaxDepthExceeded", "MaxSizeExceeded",
)
FORMATS = ("json", "csv", "toml", "yaml", "xml")
DEFAULT_DEPTH, DEFAULT_SIZE = 128, 10 << 20
#: Calls that a level of nesting takes at most.
FRAMES = 6


class Place(NamedTuple):
    """Bytes from the start; line and column count from one, columns in bytes."""

    offset: int
    line: int
    col: int


def place(text: str, at: int) -> Place:
    before = text[:at]
    line_start = before.rfind("\n") + 1
    size = lambda s: len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))
    return Place(size(before), before.count("\n") + 1, size(before[line_start:]) + 1)


class Places:
    """Places of one text that are asked for mostly from left to right: each reads on from the last one."""

    def __init__(self, text: str) -> None:
        self.text, self.ascii = text, text.isascii()
        self.at, self.last = 0, Place(0, 1, 1)

    def of(self, at: int) -> Place:
        if at < self.at:
            self.at, self.last = 0, Place(0, 1, 1)
        if at == self.at:
            return self.last
        offset, line, col = self.last
        breaks, line_start = self.text.count("\n", self.at, at), self.text.rfind("\n", self.at, at) + 1
        size = (lambda a: at - a) if self.ascii else lambda a: len(self.text[a:at].encode("utf-8", "surrogatepass"))
        n = size(self.at)
        self.last = Place(offset + n, line + breaks, size(line_start) + 1 if breaks else col + n)
        self.at = at
        return self.last


class DocError(Exception):
    """A typed error; ``start`` and ``end`` are places in characters until ``located`` turns them into places."""

    def __init__(self, kind: str, start: int | None = None, end: int | None = None, message: str = "", **details) -> None:
        self.kind, self.details = kind, details
        self.start, self.end = start, start if end is None else end
        self.message = message or describe(kind, details)
        self.span: tuple[Place, Place] | None = None
        super().__init__(self.message)

    def located(self, text: str) -> DocError:
        if self.start is not None and self.span is None:
            self.span = place(text, self.start), place(text, self.end)
        return self

    def __str__(self) -> str:
        if self.span is None:
            return self.message
        return f"error at {self.span[0].offset}:{self.span[0].line}:{self.span[0].col}: {self.message}"

    def record(self) -> dict:
        at = [p._asdict() for p in self.span] if self.span else [None, None]
        return {"kind": self.kind, "message": self.message, "start": at[0], "end": at[1]} | {k: self.details.get(k) for k in ("max", "key", "expected", "found")}


def describe(kind: str, details: dict) -> str:
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", kind).lower()
    if kind == "Expected":
        return f"expected {details['expected']}, found {details['found']}"
    if kind == "DuplicateKey":
        return f"duplicate key: {details['key']}"
    return f"{words}: {details['max']}" if "max" in details else words


@dataclass(frozen=True)
class Options:
    """Options of all formats; a limit of 0 is none. Depth and size defaults depend on the format."""

    max_depth: int | None = None
    max_size: int | None = None
    allow_comments: bool = False
    allow_trailing_commas: bool = False
    allow_trailing_content: bool = False
    delimiter: str = ","
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def depth(self, fmt: str) -> int:
        return self.max_depth if self.max_depth is not None else DEFAULT_DEPTH if fmt in ("json", "toml", "yaml") else 0

    def size(self, fmt: str) -> int:
        return self.max_size if self.max_size is not None else DEFAULT_SIZE if fmt in ("json", "toml", "xml") else 0


UNLIMITED = Options(max_depth=0, max_size=0)
RELAXED = Options(allow_comments=True, allow_trailing_commas=True)


class Datetime(NamedTuple):
    """A TOML date or time: its kind (offset, local, date, time) and its text in RFC 3339 form."""

    kind: str
    text: str


def byte_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def check_size(text: str, most: int) -> None:
    if most and len(text) * 4 > most and byte_size(text) > most:
        raise DocError("MaxSizeExceeded", 0, 0, max=most)


def too_deep(most: int, at: int) -> DocError:
    return DocError("MaxDepthExceeded", at, at + 1, max=most)


def recursive(read: Callable, levels: int):
    """What ``read`` returns; a document nested deeper than usual is read again with room for ``levels`` levels."""
    try:
        return read()
    except RecursionError:
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(usual + FRAMES * levels)
        try:
            return read()
        finally:
            sys.setrecursionlimit(usual)


NUMBER_TEXT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.ASCII)


def to_number(text: str) -> float | None:
    """The finite number that the text spells, else None."""
    if not NUMBER_TEXT.fullmatch(text):
        return None
    x = float(text)
    return x if x - x == 0 else None


def infer_scalar(text: str):
    """Null, bool, number, or the text itself."""
    low = text.lower() if len(text) < 6 else ""
    if not text or low == "null":
        return None
    if low in ("true", "false"):
        return low == "true"
    x = to_number(text)
    return text if x is None else x


def format_number(x: float) -> str:
    """Shortest digits that read back as x, never with an exponent or a trailing ``.0``; ``inf`` and ``NaN`` as such."""
    if x - x != 0:
        return "NaN" if x != x else "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1e15:
        return "-0" if x == 0 and str(x)[0] == "-" else str(int(x))
    s = format(Decimal(repr(x)), "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


_ESCAPED = re.compile(r'[\x00-\x1f"\\]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(text: str) -> str:
    """The text in double quotes, escaped as JSON, TOML and YAML read it."""
    if _ESCAPED.search(text):
        text = _ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", text)
    return f'"{text}"'


def kind_of(value) -> str:
    if value is None:
        return "null"
    for types, name in ((bool, "bool"), ((int, float), "number"), (str, "string"), (Datetime, "datetime"), (list, "array")):
        if isinstance(value, types):
            return name
    return "object"
