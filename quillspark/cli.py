"""Command line: ``python -m quillspark parse|convert`` for one document, without a cluster."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from quillspark.kernels import convert as kernel
from quillspark.kernels.core import DocError, Options
from quillspark.kernels.csv_doc import check_delimiter

INPUTS = ["json", "jsonc", "csv", "toml", "yaml", "yml", "xml"]
OUTPUTS = ["json", "csv", "toml", "yaml", "yml", "xml"]
EXTENSIONS = {"json": "json", "jsonc": "jsonc", "csv": "csv", "toml": "toml", "yaml": "yaml", "yml": "yaml", "xml": "xml"}


class UsageError(Exception):
    pass


def resolve_format(given: str | None, path: str | None) -> str:
    """The format asked for, else the one of the file's extension."""
    found = given or EXTENSIONS.get(Path(path).suffix.lower().removeprefix(".") if path else "")
    if not found:
        raise UsageError("no input format: give --from or a file with a known extension")
    return found


def read_input(path: str | None) -> str:
    if path is not None:
        return Path(path).read_bytes().decode("utf-8")  # line ends as they are
    text = sys.stdin.buffer.read().decode("utf-8")
    if not text.strip():
        raise UsageError("standard input is empty")
    return text


def write_output(path: str | None, text: str) -> None:
    if path is None:
        sys.stdout.write(text)
    else:
        Path(path).write_bytes(text.encode("utf-8"))


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("input", nargs="?", help="file; standard input if missing or -")
    shared.add_argument("--from", dest="source", choices=INPUTS)
    shared.add_argument("--output", "-o")
    shared.add_argument("--print-output", action="store_true")
    shared.add_argument("--json-comments", action="store_true")
    shared.add_argument("--json-trailing-commas", action="store_true")
    shared.add_argument("--csv-delimiter")
    out = argparse.ArgumentParser("quillspark", parents=[shared], description="Parse and convert documents.")
    out.add_argument("--parse", action="store_true")
    out.add_argument("--convert", action="store_true")
    out.add_argument("--to", choices=OUTPUTS)
    return out


def options_of(args: argparse.Namespace, fmt: str) -> Options:
    relaxed = fmt == "jsonc"
    delimiter = "," if args.csv_delimiter is None else check_delimiter(args.csv_delimiter)
    return Options(allow_comments=args.json_comments or relaxed, allow_trailing_commas=args.json_trailing_commas or relaxed, delimiter=delimiter)


def run(args: argparse.Namespace) -> None:
    path = None if args.input in (None, "-") else args.input
    text = read_input(path)
    source = resolve_format(args.source, path)
    options = options_of(args, source)
    if args.parse:
        kernel.parse(text, source, options)
        write_output(args.output, text if args.print_output else "ok\n")
        return
    if not args.to:
        raise UsageError("--to is required for a conversion")
    result = kernel.convert(text, source, args.to, options)
    if args.print_output:
        write_output(args.output, result)
        return
    if args.output:
        write_output(args.output, result)
    sys.stdout.write("ok\n")


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] in (["parse"], ["convert"]):
        argv[0] = f"--{argv[0]}"
    args = parser().parse_args(argv)
    if args.parse == args.convert:
        sys.stderr.write("Error: one of parse and convert is needed\n")
        return 2
    try:
        run(args)
    except (DocError, UsageError, OSError, UnicodeDecodeError) as e:
        sys.stderr.write(f"Error: {e}\n")
        return 1
    return 0
