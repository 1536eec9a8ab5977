"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns to
the shared folder and reads it back as the next one's docs. doc_id identifies a document: a decision
about it holds for all its rows. A row with a null doc_id is identified by its text, so equal texts
without an id are one document. Near-duplicates are texts whose five-word shingles have a similarity of
about 0.8 or more. Null texts count as empty, extra columns pass through whatever their names, an empty
table gives an empty result. The token files stay in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, mixing, quality, simhash, token_output
from quillspark.llm.common import written

#: Rows of decisions that are broadcast at most; more are joined by a shuffle.
SMALL = 500_000


def identity(docs: DataFrame) -> Column:
    """doc_id; where it is null, a number above 2^62 from the text's hash."""
    own = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(docs["text"], F.lit(""))), F.lit((1 << 62) - 1))
    return F.coalesce(docs["doc_id"].cast("long"), own)


def identified(docs: DataFrame) -> DataFrame:
    """What the operators read of the documents, with an identity for each."""
    return docs.select(identity(docs).alias("doc_id"), *(docs[c] for c in docs.columns if c in ("text", "source")))


def sized(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those with an identity in ``ids`` (doc_id)."""
    ids = sized(written(ids.select(F.col("doc_id").alias("dropped")).distinct(), "dropped"))
    return docs.join(ids, identity(docs) == ids["dropped"], "left_anti")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(docs, quality.resample(identified(docs), labels).where(~F.col("keep")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    classes = written(simhash.similar_documents(identified(docs)).select("doc_id", "component_id"), "classes")
    # Rows that share an identity may have texts of several classes; the least class counts.
    classes = classes.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    kept = without(docs, classes.where(F.col("doc_id") != F.col("component_id")))
    again = written(classes.where("rows > 1").select(F.col("doc_id").alias("again_id")), "again")
    if again.isEmpty():
        return kept
    # Such rows are one document: one row with its least text stays.
    again = sized(again)
    once = kept.join(again, identity(kept) == again["again_id"], "left_anti")
    some = kept.join(again, identity(kept) == again["again_id"], "left_semi")
    row = F.struct(*(some[c] for c in some.columns)).alias("row")
    some = some.groupBy(identity(some).alias("id")).agg(F.min_by(row, F.coalesce(some["text"], F.lit(""))).alias("row")).select("row.*")
    return once.unionByName(some)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontam.decontaminate(identified(docs), items).where("contaminated"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(identified(docs)).where("size > 0").groupBy("doc_id").agg(F.max(F.expr("taken div size")).alias("times"))
    taken = written(taken.where("times > 0").select(F.col("doc_id").alias("mixed_id"), F.col("times").cast("int")), "taken")
    taken = sized(taken)
    rows = docs.join(taken, identity(docs) == taken["mixed_id"])
    copy = "_" + "_".join(docs.columns)  # no column has this name
    return rows.select(*(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(0), taken["times"])).alias(copy)).drop(copy)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; returns their index: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("token_output", token_files),
]

#: SQL can't express hashing with a seed or a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
