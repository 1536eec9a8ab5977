"""Token ids as Parquet list columns.

Texts are dealt out by ranges of doc_id and text hash, sorted, encoded and written: one row per document
with its ids as a list. Ids are dictionary-encoded, doc_id and n_tokens delta-encoded; row groups and pages
are small and carry column and offset indexes, so a reader can fetch the metadata columns alone or the
pages of a few documents. The files stay where they are written.

Null text: empty (only the end id). Null doc_id: sorts first. Repeated rows: each is written. Equal
doc_ids: ordered by the text's hash, then the text, so that they may spread over files. Very long texts: a
text is encoded in one piece of memory of a few times its size. Empty table: no rows. Other columns:
ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import doc_text, pieces, shared_dir

END_ID = 2
#: A space between characters other than white space always begins a new pre-token: the text may be cut before it.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Stands before a text's first unit, which is encoded without a space before it.
HEAD = "\0"
#: What a worker keeps at most: units, bytes of their strings, and their ids.
CACHED_UNITS, CACHED_BYTES, CACHED_IDS = 800_000, 12_000_000, 4_000_000
#: Bytes of text encoded together.
ENCODED_BYTES = 6_000_000
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's definition; ``path`` defaults to the installed byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text()


class UnitEncoder:
    """Encodes texts with the tokenizers library, each distinct stretch between cuts once.

    Texts are cut before single spaces and single line ends, which pre-tokens never cross, so a text's
    ids are its units' ids in a row. Cutting, numbering and looking up are column operations; only new
    units become Python strings. Many of them are learnt in one call, a line end between them: its id
    parts them again. Texts with other white space are cut by the pattern, those that hold an added
    token's string are encoded whole. A full cache keeps the units that were used most.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.whole = [HEAD, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.units = pa.array([], pa.string())
        self.flat, self.edge = np.zeros(0, np.int32), np.zeros(1, np.int64)  # unit k has flat[edge[k] : edge[k + 1]]
        self.blank, self.uses = np.zeros(0, bool), np.zeros(0, np.int32)

    def trim(self) -> None:
        """Halves a full cache; the units used least go."""
        if len(self.units) <= CACHED_UNITS and self.units.nbytes <= CACHED_BYTES and len(self.flat) <= CACHED_IDS:
            return
        order = np.argsort(-self.uses, kind="stable")
        size = np.diff(self.edge)
        strings = np.diff(np.frombuffer(self.units.buffers()[1], np.int32)[: len(self.units) + 1])
        fits = (np.cumsum(size[order]) <= CACHED_IDS // 2) & (np.cumsum(strings[order]) <= CACHED_BYTES // 2)
        kept = np.sort(order[fits][: CACHED_UNITS // 2])
        self.units = self.units.take(pa.array(kept))
        self.flat = self.flat[spread(self.edge[kept], size[kept])]
        self.edge = np.concatenate([[0], np.cumsum(size[kept])])
        self.blank, self.uses = self.blank[kept], self.uses[kept] // 2

    def learn(self, units: list[str]) -> None:
        """Adds these units, which must be new, in their order."""
        head = np.fromiter((u[:1] == HEAD for u in units), bool, len(units))
        line = np.fromiter((u[:1] == "\n" for u in units), bool, len(units))
        inner = [u[1:] if h or n else u for u, h, n in zip(units, head.tolist(), line.tolist(), strict=True)]
        blank = np.fromiter((not u or len(u.strip()) != len(u) for u in inner), bool, len(units))
        alone = head | blank | np.fromiter(("\n" in u for u in inner), bool, len(units))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, int(alone.sum()), 4096):
            some = np.flatnonzero(alone)[at : at + 4096]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([inner[i] if head[i] else units[i] if line[i] else " " + units[i] for i in some.tolist()], add_special_tokens=False)]
            found.append((some, np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int32)))
        for which, before, glue in ((~line & ~alone, " ", "\n "), (line & ~alone, "", "")):
            own, some = np.flatnonzero(which), list(compress(units, which))
            for at in range(0, len(some), 4096):
                (x,) = self.tokenizer.encode_batch_fast([before + glue.join(some[at : at + 4096])], add_special_tokens=False)
                ids = np.array(x.ids, np.int32)
                mark = ids == self.line_end
                if glue:  # the line end parts two units and belongs to none
                    parts = np.flatnonzero(np.concatenate([mark, [True]]))
                    found.append((own[at : at + 4096], np.diff(parts, prepend=-1) - 1, ids[~mark]))
                else:
                    found.append((own[at : at + 4096], np.diff(np.flatnonzero(np.concatenate([mark, [True]]))), ids))
        place, size, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        start = np.zeros(len(units), np.int64)
        start[place] = np.cumsum(size) - size
        sizes = np.zeros(len(units), np.int64)
        sizes[place] = size
        self.flat = np.concatenate([self.flat, ids[spread(start, sizes)]])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes)])
        self.units = pa.concat_arrays([self.units, pa.array(units, pa.string())])
        self.blank, self.uses = np.concatenate([self.blank, blank]), np.concatenate([self.uses, np.zeros(len(units), np.int32)])

    def numbered(self, units: pa.Array) -> np.ndarray:
        """The number of each unit; new ones are learnt."""
        coded = units.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.units)
        fresh = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        number = at.fill_null(0).to_numpy().astype(np.int64)
        if len(fresh):
            number[fresh] = len(self.units) + np.arange(len(fresh))
            self.learn(coded.dictionary.take(pa.array(fresh)).to_pylist())
        codes = coded.indices.to_numpy()
        self.uses[number] += np.bincount(codes, minlength=len(number)).astype(np.int32)
        return number[codes]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with its end id, and how many each has."""
        self.trim()
        n = len(texts)
        special = np.zeros(n, bool)
        for word in self.whole:
            special |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(HEAD, plain, ""), "\n", " \n"), " ")
        edge = cut.offsets.to_numpy()
        number = self.numbered(cut.values.slice(edge[0], edge[-1] - edge[0]))
        edge = edge.astype(np.int64) - edge[0]
        odd = (np.add.reduceat(self.blank[number], edge[:-1]) > 0) & ~special if n else np.zeros(0, bool)
        start, size = edge[:-1].copy(), np.diff(edge)
        if odd.any():
            # The pattern's units keep their space; the later ones are numbered without it.
            rows = [[HEAD + u if i == 0 else u[u[:1] == " " :] for i, u in enumerate(CUT.split(t))] for t in compress(texts.to_pylist(), odd)]
            size[odd] = [len(r) for r in rows]
            start[odd] = len(number) + np.cumsum(size[odd]) - size[odd]
            number = np.concatenate([number, self.numbered(pa.array([u for r in rows for u in r], pa.string()))])
        units = number[spread(start, size)]
        width = np.diff(self.edge)[units]
        ids = self.flat[spread(self.edge[units], width)]
        length = np.diff(np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])])
        if special.any():
            own = {i: np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32) for i in np.flatnonzero(special).tolist()}
            edges = np.concatenate([[0], np.cumsum(length)])
            ids = np.concatenate([own.get(i, ids[edges[i] : edges[i + 1]]) for i in range(n)])
            length[list(own)] = [len(x) for x in own.values()]
        out = np.full(len(ids) + n, END_ID, np.int32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(length + 1) - 1] = False
        out[inside] = ids
        return out, length + 1


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start[k], start[k] + 1, ... (size[k] of them) for all k in a row."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


#: The worker's encoder, some 50 MB at most; units learnt in one task serve the next.
_encoder: list = []


def encoder_for(definition: str) -> UnitEncoder:
    if not _encoder or _encoder[0] != definition:
        _encoder[:] = [definition, UnitEncoder(definition)]
    return _encoder[1]


def encode_batches(definition):
    """An Arrow function from (doc_id, text) to (doc_id, ids, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(definition.value)
        for batch in batches:
            for part in pieces(batch, limit=ENCODED_BYTES):
                ids, size = encoder.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(size.astype(np.int32))], ["doc_id", "ids", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the files at ``path`` in ascending doc_id order."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))
    keyed = doc_text(docs).withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    ids = ordered.mapInArrow(encode_batches(definition), "doc_id long, ids array<int>, n_tokens int")
    ids.write.options(**LAYOUT).parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        keep = [batch.column(c) for c in ("doc_id", "file", "row")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, one row per document: doc_id, ids, n_tokens, file, row (place in the file)."""
    return spark.read.parquet(path).select("doc_id", "ids", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def file_number(name: Column) -> Column:
    """The number in a part file's name: its place among the ranges, however many digits it has."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files' ids.

    ``start`` is a running sum inside each file plus the totals of the files before it; files are
    numbered in doc_id order, and only one row per file meets in a single place.
    """
    rows = read_tokens(spark, path).select("doc_id", "ids", "file", "row").mapInArrow(_digest, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)))
    totals = spark.read.parquet(path).select("n_tokens", F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    before = F.sum("total").over(Window.orderBy(file_number(F.col("file")), "file").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    start = (F.col("before") + F.coalesce("upto", F.lit(0))).alias("start")
    return rows.join(totals, "file").select("doc_id", start, "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes ``docs`` at ``path`` (default: a new folder below the shared one, which stays) and returns the index read from the files."""
    path = path or f"{shared_dir(docs.sparkSession)}/quillspark-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return token_index(docs.sparkSession, path)
