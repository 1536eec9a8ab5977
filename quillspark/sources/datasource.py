"""``spark.read.format("toml")`` and the like: one row per document with its value's text and error.

Files are listed and opened through Arrow's file systems (local and mounted paths, s3, gs, hdfs and others that
it knows); small files share a partition. ``sources.documents`` reads any other store with Spark's own readers.

Options: ``maxDepth``, ``maxSize``, ``delimiter``, ``allowComments``, ``allowTrailingCommas``, ``extension``
(another one than the format's), ``mode`` (PERMISSIVE, DROPMALFORMED, FAILFAST).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.kernels import convert as kernel
from quillspark.kernels import json_doc
from quillspark.kernels.core import DocError, Options

EXTENSIONS = {"toml": ("toml",), "yaml": ("yaml", "yml"), "jsonc": ("jsonc", "json"), "csvdoc": ("csv",), "xmldoc": ("xml",)}
SCHEMA = "path STRING, content STRING, json STRING, error_kind STRING, error STRING"


#: Bytes of files that share a partition, and what opening one counts as.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 1 << 20


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def opened(path: str) -> tuple:
    """The file system of a path, and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


def listed(path: str, extensions: tuple[str, ...]) -> list[tuple[str, int]]:
    """Path and size of a file, of the files that a pattern matches, or of those with an extension below a folder."""
    from pyarrow import fs

    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    pattern = re.search(r"[*?\[]", inner)
    folder = inner[: pattern.start()].rpartition("/")[0] or "/" if pattern else inner
    out = []
    for f in system.get_file_info(fs.FileSelector(folder, recursive=True)):
        if f.type == fs.FileType.File and f.base_name[0] not in "._" and (PurePosixPath(f.path).full_match(inner) if pattern else f.extension.lower() in extensions):
            out.append((path.replace(inner, "", 1) + f.path if "://" in path else f.path, f.size))
    return sorted(out)


def read_bytes(path: str) -> bytes:
    system, inner = opened(path)
    with system.open_input_stream(inner, compression=None) as f:
        return f.read()


class DocumentReader(DataSourceReader):
    def __init__(self, fmt: str, options: dict) -> None:
        self.fmt, self.options = fmt, options

    def partitions(self) -> list[FilePartition]:
        extensions = (self.options["extension"].lower(),) if "extension" in self.options else EXTENSIONS[self.fmt]
        out: list[FilePartition] = []
        room = 0
        for path, size in listed(self.options["path"], extensions):
            if room < size + OPEN_BYTES:
                out.append(FilePartition([]))
                room = PARTITION_BYTES
            out[-1].paths.append(path)
            room -= size + OPEN_BYTES
        return out

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        o = self.options
        limit = lambda k: int(o[k]) if k in o else None
        yes = lambda k: o.get(k, "").lower() == "true"
        mode = o.get("mode", "PERMISSIVE").upper()
        options = Options(limit("maxdepth"), limit("maxsize"), yes("allowcomments"), yes("allowtrailingcommas"), delimiter=o.get("delimiter", ","))
        for path in partition.paths if partition else []:
            text = json = kind = error = None
            try:
                text = kernel.text_of(read_bytes(path))
                json = json_doc.emit(kernel.parse(text, self.fmt.removesuffix("doc"), options))
            except DocError as e:
                if mode == "FAILFAST":
                    raise
                kind, error = e.kind, str(e)
            if kind is None or mode != "DROPMALFORMED":
                yield path, text, json, kind, error


def _source(fmt: str) -> type[DataSource]:
    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return fmt

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DocumentReader:
            return DocumentReader(fmt, {k.lower(): v for k, v in self.options.items()})

    return Documents


def register(spark: SparkSession) -> None:
    for fmt in EXTENSIONS:
        spark.dataSource.register(_source(fmt))
