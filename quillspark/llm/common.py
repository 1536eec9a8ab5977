"""Helpers that the operators share: durable intermediate tables, token rules, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, nothing else: what every text contract here calls lower-casing.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Documents handled together inside a Python worker; bounds its memory whatever the Arrow batch holds.
CHUNK_BYTES = 4_000_000

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` or the context's; a temporary one only where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = _roots.setdefault("", tempfile.mkdtemp(prefix="quillspark-"))
    return base.rstrip("/")


def durable_dir(spark: SparkSession) -> str:
    """This process's folder below the shared one, removed when the process ends."""
    base = shared_dir(spark)
    if base not in _roots:
        _roots[base] = f"{base}/quillspark-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _roots[base])
    return _roots[base]


def _forget(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the text operators read, under fixed names; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_bucket(col: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text: str) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: what bytes.split() splits on is exactly that class."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of text each, one row at least."""
    lens = pc.binary_length(batch.column(column)).to_pylist()
    start = size = 0
    for i, n in enumerate(lens):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(lens):
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    edge = split.offsets.to_numpy()
    words = split.values.slice(edge[0], edge[-1] - edge[0])
    empty = pc.equal(pc.binary_length(words), 0)
    n = np.diff(edge).astype(np.int64)
    if pc.any(empty).as_py():  # the only word of a text without words
        words = words.filter(pc.invert(empty))
        n[pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)] = 0
    return words, n


class StringTable:
    """Numbers of strings, looked up by column operations; a full table keeps the strings used most."""

    def __init__(self, most: int, most_bytes: int) -> None:
        self.most, self.most_bytes = most, most_bytes
        self.strings, self.uses = pa.array([], pa.string()), np.zeros(0, np.int32)

    def look_up(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The number of each distinct string, the place of each string among these, and the new ones in the order of their numbers."""
        coded = strings.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.strings)
        fresh = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        number, new = at.fill_null(0).to_numpy().astype(np.int64), coded.dictionary.take(pa.array(fresh, pa.int64()))
        number[fresh] = len(self.strings) + np.arange(len(fresh))
        self.strings = pa.concat_arrays([self.strings, new])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int32)])
        codes = coded.indices.to_numpy()
        self.uses[number] += np.bincount(codes, minlength=len(number)).astype(np.int32)
        return number, codes, new.to_pylist()

    def shrink(self) -> np.ndarray | None:
        """Halves a full table; returns the old numbers of the strings that stay, in their new order, or nothing if all do."""
        if len(self.strings) <= self.most and self.strings.nbytes <= self.most_bytes:
            return None
        order = np.argsort(-self.uses, kind="stable")
        fits = np.cumsum(pc.binary_length(self.strings).to_numpy()[order], dtype=np.int64) <= self.most_bytes // 2
        kept = np.sort(order[fits][: self.most // 2])
        self.strings, self.uses = self.strings.take(pa.array(kept, pa.int64())), self.uses[kept] // 2
        return kept
