"""CSV: records of named, typed cells, and text from rows."""

from __future__ import annotations

import re

from quillspark.kernels.core import Datetime, DocError, Options, check_size, format_number, infer_scalar
from quillspark.kernels.json_doc import emit as emit_json


def check_delimiter(delimiter: str) -> str:
    """One ASCII character that is neither a line end nor the quote."""
    if len(delimiter) != 1:
        raise DocError("InvalidToken", message="a CSV delimiter is one character")
    if not delimiter.isascii():
        raise DocError("InvalidToken", message="a CSV delimiter is an ASCII character")
    if delimiter in '\n\r"':
        raise DocError("InvalidToken", message=f"{delimiter!r} has another meaning in CSV and can't be the delimiter")
    return delimiter


Cell = tuple[str, bool]  # text and whether it was quoted
QUOTED = re.compile(r'"((?:[^"]|"")*+)"')
PADDING = re.compile(r"[ \t\f]*")


def records(text: str, delimiter: str = ",") -> list[list[Cell]]:
    """All records; those of white space alone, without a quoted cell, are left out."""
    delimiter = check_delimiter(delimiter)
    plain = re.compile(f"[^{re.escape(delimiter)}\r\n]*")
    out: list[list[Cell]] = []
    record: list[Cell] = []
    at, n = 0, len(text)
    while at < n:
        if text[at] == '"':
            m = QUOTED.match(text, at)
            if not m:
                raise DocError("UnterminatedString", at, n)
            record.append((m[1].replace('""', '"'), True))
            end = m.end()
            if delimiter in " \t\f":
                while end < n and text[end] in " \t\f" and text[end] != delimiter:
                    end += 1
            else:
                end = PADDING.match(text, end).end()
            if end < n and text[end] not in (delimiter, "\r", "\n"):
                raise DocError("InvalidToken", end, end + 1, "unexpected character after a closing quote")
        else:
            m = plain.match(text, at)
            record.append((m[0], False))
            end = m.end()
        if end < n and text[end] == delimiter:
            at = end + 1
            if at == n:
                record.append(("", False))
            continue
        if any(quoted or cell.strip() for cell, quoted in record):
            out.append(record)
        record = []
        at = end + (2 if text.startswith("\r\n", end) else 1)
    if any(quoted or cell.strip() for cell, quoted in record):
        out.append(record)
    return out


def header_names(cells: list[Cell]) -> list[str]:
    """Trimmed unless quoted, numbered where empty, made unique by ``_2``, ``_3``..."""
    out: list[str] = []
    taken: set[str] = set()
    for i, (cell, is_quoted) in enumerate(cells):
        base = (cell if is_quoted else cell.strip()) or f"column_{i + 1}"
        name, k = base, 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        out.append(name)
    return out


def typed(cell: Cell):
    return cell[0] if cell[1] else infer_scalar(cell[0].strip())


def parse(text: str, options: Options = Options()) -> list[dict]:
    check_size(text, options.size("csv"))
    rows = records(text, options.delimiter)
    if not rows:
        return []
    names = header_names(rows[0])
    out = []
    for cells in rows[1:]:
        row = dict.fromkeys(names)
        for i, cell in enumerate(cells):
            row[names[i] if i < len(names) else f"column_{i + 1}"] = typed(cell)
        out.append(row)
    return out


def _rows_of(value) -> list[dict]:
    if isinstance(value, dict):
        value = value["rows"] if isinstance(value.get("rows"), list) else [value]
    if not isinstance(value, list):
        raise DocError("InvalidToken", message="CSV needs an object or an array of objects")
    if not all(isinstance(row, dict) for row in value):
        raise DocError("InvalidToken", message="CSV needs objects as rows")
    return value


def guarded(text: str, always: bool, delimiter: str = ",") -> str:
    """The cell, in quotes if asked for or needed."""
    return '"' + text.replace('"', '""') + '"' if always or re.search(f'["\r\n{re.escape(delimiter)}]', text) else text


def cell_text(value, delimiter: str = ",") -> str:
    if value is None or (isinstance(value, float) and value - value != 0):
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return format_number(value)
    if isinstance(value, str):
        return guarded(value, True, delimiter)
    return guarded(value.text if isinstance(value, Datetime) else emit_json(value), False, delimiter)


def emit(value, delimiter: str = ",") -> str:
    """A header of all keys in the order in which they first occur, then a line for each row."""
    rows = _rows_of(value)
    names = list(dict.fromkeys(k for row in rows for k in row))
    if not names:
        return ""
    lines = [delimiter.join(guarded(n, False, delimiter) for n in names)]
    lines += [delimiter.join(cell_text(row.get(n), delimiter) for n in names) for row in rows]
    return "\n".join(lines) + "\n"
