"""Connected components of links that don't fit one machine, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (larger ones, or the others and itself) are tied to its smallest neighbour.

    The smallest neighbour comes from an aggregate and a join, not from a list of neighbours, so a hub
    with any number of links is spread over tasks.
    """
    pairs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = pairs.join(least, "a")
    if large:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for all nodes of ``links`` (a, b: long, a != b).

    Each round is written to the shared folder. Ends when a round changes nothing, which a sum of
    hashes tells.
    """
    bigger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now, seen = written(links.select(bigger, smaller).distinct(), "links"), None
    for _ in range(MAX_ROUNDS):
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == seen or not digest[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = digest
        now = written(_star(_star(now, large=True), large=False), "links")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
