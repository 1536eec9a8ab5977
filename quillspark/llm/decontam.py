"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Texts become words; every run of ``GRAM`` words has a hash; every window of ``span`` words keeps the
smallest hash inside it. Two texts that share a window share its smallest hash, so joining the kept
hashes of documents and items misses no shared window. The documents are read again: of those with common
hashes, the windows whose kept hash is common are spelled out, joined with the items' windows on the words
themselves, and their union gives the hit words. Items shorter than a window are looked for as a whole,
by the hash of all their words, in the same two passes.

Phrases that occur in the same items are a class; a document's hits are joined with classes, and the items
of each set of classes are put together once, so a phrase of every item doesn't multiply with the documents.
Kept hashes of the items are broadcast while there are at most ``BROADCAST_ROWS`` of them; so are the
documents' common hashes; above that both are shuffled. Copies of a text share one row of common hashes.

Null text: no words. Null item_id: the item is left out. Null doc_id: a row of its own. Repeated
documents: each gets its row. Repeated items: one item by its id. Ties between hashes: the windows are
compared by their words. Very long texts: time in proportion to the text, but for a logarithm of the hashes
that it shares with items. Empty tables: no rows, or no hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, written

SPAN, GRAM = 10, 4
BROADCAST_ROWS = 200_000
#: Common hashes of a document up to which they are looked through in order; more are searched by halves.
FEW = 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _keys(length: int, span: int, gram: int) -> str:
    """SQL for the key of each window of ``length`` words, given h (a hash per word) and g (one per gram)."""
    if length == span:
        return f"transform(sequence(1, size(h) - {span - 1}), i -> array_min(slice(g, i, {span - gram + 1})))"
    return f"transform(sequence(1, size(h) - {length - 1}), i -> xxhash64({length}, slice(h, i, {length})))"


def _hashed(df: DataFrame, span: int, gram: int) -> DataFrame:
    """Adds w (words), h and g; arrays are empty where there are too few words."""
    terms = ", ".join(f"h[i + {j}]" for j in range(gram))
    df = df.withColumn("w", words(F.col("text"))).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    return df.withColumn("g", F.expr(f"if(size(h) < {span}, array(), transform(sequence(0, size(h) - {gram}), i -> xxhash64({terms})))"))


def _some(length: int, sql: str, kind: str) -> Column:
    return F.expr(f"if(size(h) < {length}, CAST(array() AS {kind}), {sql})")


def item_windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """item_id, length, key, phrase (its words) of every window of every item."""
    items = _hashed(items.where("item_id is not null").select("item_id", "text"), span, gram).where("size(w) > 0")
    whole = f"case size(w) {' '.join(f'when {n} then array(struct(1 as i, xxhash64({n}, h) as key))' for n in range(1, span))} end" if span > 1 else "null"
    long = f"transform({_keys(span, span, gram)}, (k, i) -> struct(i + 1 as i, k as key))"
    at = F.explode(F.expr(f"if(size(w) < {span}, {whole}, {long})"))
    rows = items.withColumn("length", F.least(F.size("w"), F.lit(span))).select("item_id", "length", "w", at.alias("at"))
    return rows.select("item_id", "length", F.col("at.key").alias("key"), F.expr("array_join(slice(w, at.i, length), ' ')").alias("phrase"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _is_common(key: str) -> str:
    """SQL for whether the hash ``key`` is in the sorted array ``common``."""
    middle = "CAST((a.lo + a.hi) div 2 AS INT)"
    halves = f"if(a.lo >= a.hi, a, if(common[{middle}] < {key}, struct({middle} + 1 as lo, a.hi as hi), struct(a.lo as lo, {middle} as hi)))"
    place = f"aggregate(sequence(0, CAST(log2(size(common)) AS INT) + 1), struct(0 as lo, size(common) - 1 as hi), (a, step) -> {halves}, a -> a.lo)"
    return f"if(size(common) <= {FEW}, array_contains(common, {key}), common[{place}] = {key})"


def _found(lengths: list[int], span: int, gram: int) -> Column:
    """The windows with a common hash: place, length, words."""
    none = F.expr("CAST(array() AS array<struct<i: int, n: int, phrase: string>>)")
    spelled = []
    for n in lengths:
        sql = f"filter(transform({_keys(n, span, gram)}, (k, i) -> if({_is_common('k')}, struct(i as i, {n} as n, array_join(slice(w, i + 1, {n}), ' ') as phrase), null)), x -> x is not null)"
        spelled.append(F.coalesce(F.expr(f"if(common is null or size(h) < {n}, null, {sql})"), none))
    return F.concat(*spelled) if spelled else none


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document."""
    windows = written(item_windows(items, span, gram), "windows")
    keys = windows.select("key").distinct()
    n_windows = windows.count()
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``span`` values
    texts = _hashed(docs.select("doc_id", "text").withColumn("th", F.xxhash64("text")), span, gram)
    arrays = [_some(n, _keys(n, span, gram), "array<bigint>") for n in lengths] or [F.expr("CAST(array() AS array<bigint>)")]
    kept = texts.select("th", F.explode(F.array_distinct(arrays[0] if len(arrays) == 1 else F.concat(*arrays))).alias("key"))
    common = written(kept.join(_sized(keys, n_windows), "key").groupBy("th").agg(F.array_sort(F.collect_set("key")).alias("common")), "common")
    # Words and hashes are made below the join: above it they would be made anew for each window.
    again = texts.join(_sized(common, common.agg(F.coalesce(F.sum(F.size("common")), F.lit(0))).first()[0]), "th", "left")
    rows = written(again.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), _found(lengths, span, gram).alias("found")), "rows")
    spans = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    phrases = windows.groupBy("phrase").agg(names.alias("items")).withColumn("class", F.sha2(F.to_json("items").cast("binary"), 256))
    phrases = written(phrases, "phrases")
    hits = spans.join(_sized(phrases.select("phrase", "class"), n_windows), "phrase").groupBy("row").agg(F.array_sort(F.collect_set("class")).alias("classes"), F.array_sort(F.collect_set(F.struct("i", "n"))).alias("at"))
    covered = F.expr("aggregate(at, struct(0L as n, 0L as upto), (a, x) -> struct(a.n + greatest(0L, x.i + x.n - greatest(a.upto, CAST(x.i AS BIGINT))) as n, greatest(a.upto, CAST(x.i + x.n AS BIGINT)) as upto), a -> a.n)")
    hits = written(hits.select("row", "classes", covered.alias("n_hit")), "hits")
    members = phrases.groupBy("class").agg(F.first("items").alias("items"))
    sets = hits.select("classes").distinct()
    named = sets.select("classes", F.explode("classes").alias("class")).join(members, "class").select("classes", F.explode("items").alias("item"))
    named = named.groupBy("classes").agg(F.array_sort(F.collect_set("item")).alias("names"))
    named = named.select("classes", F.size("names").cast("long").alias("n_items"), F.array_join("names", ",").alias("names"))
    hits = hits.join(named, "classes").select("row", "n_hit", "n_items", F.sha2(F.col("names").cast("binary"), 256).alias("items_sha256"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = rows.select("row", "doc_id", "n_words").join(hits, "row", "left")
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win
), dg AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, win.n, item_id FROM dg JOIN win ON dg.phrase = win.phrase AND dg.n = win.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN names ON dw.doc_id = names.doc_id
"""
