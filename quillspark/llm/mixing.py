"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources in code-point order (null last) take the weights in turn. They share ``share`` times all
words; a target stops at ``epochs`` times its source's size and the excess goes to the others by
weight until none is above. The fixed point has a closed form: with sources ordered by size / weight,
the first ones are full and the rest get one level times their weight.

Each document is taken floor(target / size of source) times; the fraction left is given to documents in
the order of md5(seed:doc_id), a document while its middle lies below the wanted words. The order is
cut into buckets by the first hex digits, so a source's running sums need one row per bucket, and
single documents are ordered only inside the bucket in which the cut falls: no source, however large,
is sorted in one task. Running sums go over groups of buckets and over the buckets of a group.

Null text or one without words: size 0, never taken. Null source: a source of its own, last. Null
doc_id: hashes as the empty text. Equal doc_ids: ordered by size, then text digest; repeated rows are
interchangeable. Very long texts: only their number of words matters. Empty table: no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 13
#: Hex digits of the order hash that name a bucket.
BUCKET_DIGITS = 4


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: one row per source; windows here run over the sources alone."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
    s = s.withColumn("cap", epochs * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("wanted", share * F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap"))
    s = s.withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
    s = s.withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("weight_left"))
    full = F.col("level") * F.col("weight") >= F.col("cap")
    # Levels fall once a source is not full, so the first such source has the highest.
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    target = F.when(full, F.col("cap")).otherwise(level * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the digest of each document's text (text_md5)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), digest.alias("text_md5")), "sized")
    sized = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    targets = source_targets(sized, weights, share, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("extra", F.col("target") - F.floor(ratio) * F.col("source_size"))
    # Running sums in two steps: over the first digits' groups of a source, and over the buckets of each group.
    by_bucket = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    by_bucket = by_bucket.withColumn("group", F.substring("bucket", 1, BUCKET_DIGITS // 2))
    before = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = by_bucket.groupBy("source", "group").agg(F.sum("bucket_size").alias("group_size"))
    groups = groups.withColumn("group_start", F.coalesce(F.sum("group_size").over(before("group", "source")), F.lit(0)))
    by_bucket = by_bucket.withColumn("inner_start", F.coalesce(F.sum("bucket_size").over(before("bucket", "source", "group")), F.lit(0)))
    by_bucket = by_bucket.alias("b").join(groups.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")) & (F.col("b.group") == F.col("g.group")))
    by_bucket = by_bucket.select("b.source", "bucket", "bucket_size", (F.col("group_start") + F.col("inner_start")).alias("bucket_start"))
    cuts = by_bucket.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("t.*", "bucket", "bucket_start", (F.col("bucket_start") + F.col("bucket_size")).alias("bucket_end"))
    joined = sized.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.bucket") == F.col("c.bucket")))
    rows = joined.select("d.*", "source_size", "target", "whole", "extra", "bucket_start", "bucket_end")
    split = (F.col("bucket_start") < F.col("extra")) & (F.col("bucket_end") > F.col("extra"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "text_md5").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("bucket_start") + F.sum("size").over(inside) - F.col("size")
    cut = rows.where(split).withColumn("more", (upto + F.col("size") / 2 < F.col("extra")).cast("long"))
    sure = rows.where(~split).withColumn("more", (F.col("bucket_end") <= F.col("extra")).cast("long"))
    taken = ((F.col("whole") + F.col("more")) * F.col("size")).cast("long")
    return cut.unionByName(sure).select("doc_id", "source", "text_md5", "size", "source_size", "target", taken.alias("taken"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, md5(coalesce(text, '')) AS text_md5 FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS DOUBLE) AS cap FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER upto - cap))
            / (sum(weight) OVER () - sum(weight) OVER upto + weight) AS level FROM w
  WINDOW upto AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap
         ELSE weight * max(CASE WHEN level * weight < cap THEN level END) OVER () END AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.text_md5 ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN upto + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
