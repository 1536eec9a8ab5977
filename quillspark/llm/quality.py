"""Quality classifier by importance resampling over hashed n-grams.

Two generative models of hashed features, one of target texts (documents labelled good) and one of all
documents, give each document the log of how much likelier it is under the first. Features are words,
word pairs and word shapes, a word that repeats the one before having a shape of its own. The sum over
a text is tempered to that of at most ``TEMPER`` features, so long and short texts compare. Documents
are then drawn by Gumbel top-k: a seeded Gumbel variate from doc_id is added and the k highest stay.
k is the number of documents whose weight reaches the level that best parts the labelled ones, a good
one lost counting ``LOSS`` times a bad one kept.

Labelled rows are a sample of at most ``LABELLED`` good and as many bad ones of the training folds, those
with the least hash of doc_id; all other counts cover all documents. Labels of the documents whose
crc32(doc_id as text) is divisible by ``FOLDS`` are never looked at, so they can measure the classifier.
The k-th highest draw is found by histograms, each inside one bar of the one before, until a bar is
taken whole or holds one value; rows with that very draw are told apart by row in the same way. Nothing is
ordered in one place, however many documents share a bar.

Null text: empty, weight 0. Null doc_id: a row of its own with one Gumbel variate; never a labelled one.
Repeated rows: same weight and variate; ties are broken by row. Repeated doc_id: in the sample, its least
weight counts once. No labels: every weight is 0 and all stay. Very long texts: memory is a few times a
text's size. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import StringTable, crc_bucket, doc_text, pieces, split_words, written

WORDS, PAIRS, SHAPES = 1 << 14, 1 << 14, 1 << 10
TEMPER, LABELLED, LOSS, SEED = 64.0, 20_000, 4.0, 7
#: Pseudo-counts of the target model, spread as the model of all documents.
PRIOR = float(WORDS)
FOLDS = 5
#: Bars of a histogram.
BARS = 1 << 12
#: Tokens that a task remembers, and bytes of their strings.
CACHED, CACHED_BYTES = 600_000, 12_000_000
SIZES = (WORDS, PAIRS, SHAPES)
STARTS = (0, WORDS, WORDS + PAIRS)
TOTAL = sum(SIZES)


def shape(word: str) -> str:
    """The word with A, a and 0 for its letters and digits, runs of one sign taken together."""
    if word.isalpha():  # the same as below, without patterns
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word[:64])))


class Features(NamedTuple):
    """Feature numbers of several texts in a row; a pair belongs to the text of both its words."""

    row: np.ndarray
    word: np.ndarray
    form: np.ndarray
    pair_row: np.ndarray
    pair: np.ndarray


class Hasher:
    """Feature numbers of texts; each distinct word is hashed once."""

    def __init__(self) -> None:
        self.tokens = StringTable(CACHED, CACHED_BYTES)
        self.hash = self.form = np.zeros(0, np.int64)

    def features(self, texts: pa.Array) -> Features:
        kept = self.tokens.shrink()
        if kept is not None:
            self.hash, self.form = self.hash[kept], self.form[kept]
        tokens, n = split_words(texts)
        number, codes, fresh = self.tokens.look_up(tokens)
        crc = lambda words: np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(fresh))
        self.hash = np.concatenate([self.hash, crc(map(str.lower, fresh))])
        self.form = np.concatenate([self.form, crc(map(shape, fresh)) % (SHAPES - 1) + 1])
        row = np.repeat(np.arange(len(texts)), n)
        word, form = self.hash[number][codes], self.form[number][codes]
        inside = row[1:] == row[:-1]
        form[1:][(codes[1:] == codes[:-1]) & inside] = 0
        pair = (((word[:-1] * 1_000_003 + word[1:]) >> 7) % PAIRS)[inside]
        return Features(row, word % WORDS, STARTS[2] + form, row[1:][inside], STARTS[1] + pair)


def _count(target_ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wanted = Hasher(), target_ids.value
        everything, target = np.zeros(TOTAL, np.int64), np.zeros(TOTAL, np.int64)
        for batch in batches:
            for part in pieces(batch):
                f = hasher.features(part.column("text"))
                good = np.fromiter((i in wanted for i in part.column("doc_id").to_pylist()), bool, part.num_rows)
                for row, found in ((f.row, f.word), (f.row, f.form), (f.pair_row, f.pair)):
                    everything += np.bincount(found, minlength=TOTAL)
                    if good.any():
                        target += np.bincount(found[good[row]], minlength=TOTAL)
        seen = np.flatnonzero(everything)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(everything[seen]), pa.array(target[seen])], ["feature", "n", "t"])

    return run


def log_ratios(everything: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the target model's probability over that of all documents, for each feature of each kind."""
    out = np.zeros(TOTAL)
    for start, size in zip(STARTS, SIZES, strict=True):
        n, t = everything[start : start + size] + 1.0, target[start : start + size]
        p = n / n.sum()
        out[start : start + size] = np.log((t + PRIOR * p) / (t.sum() + PRIOR) / p)
    return out


def _weigh(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ratio = Hasher(), ratios.value
        for batch in batches:
            for part in pieces(batch):
                f, n = hasher.features(part.column("text")), part.num_rows
                total, count = np.zeros(n), np.zeros(n)
                for row, found in ((f.row, f.word), (f.pair_row, f.pair), (f.row, f.form)):
                    total += np.bincount(row, ratio[found], n)
                    count += np.bincount(row, minlength=n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total * TEMPER / (TEMPER + count))], ["doc_id", "log_weight"])

    return run


def best_level(good: np.ndarray, bad: np.ndarray) -> float:
    """The level with the least loss; midway between the weights that it parts."""
    if not len(good) or not len(bad):
        return -np.inf
    weights = np.concatenate([good, bad])
    order = np.argsort(weights, kind="stable")
    step = np.concatenate([np.full(len(good), LOSS), np.full(len(bad), -1.0)])[order]
    loss = np.concatenate([[0.0], np.cumsum(step)])  # of rejecting the i lowest
    i = int(np.argmin(loss))
    edges = np.concatenate([[-np.inf], weights[order], [np.inf]])
    return float((edges[i] + edges[i + 1]) / 2) if 0 < i < len(weights) else float(edges[i + 1])


def labelled_ids(labels: DataFrame, quality: int, folds: int = FOLDS) -> list[int]:
    rows = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != 0))
    rows = rows.select(F.col("doc_id").cast("long")).distinct()
    return [r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()]


def draws(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` (doc_id, log_weight) with row and draw: the weight plus the Gumbel variate of doc_id."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draw = F.col("log_weight") - F.log(-F.log(uniform))
    return weighed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "log_weight", draw.alias("draw"))


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, folds: int = FOLDS) -> DataFrame:
    """doc_id, log_weight, draw (weight plus Gumbel variate), keep: one row per document."""
    sc = docs.sparkSession.sparkContext
    good, bad = labelled_ids(labels, 1, folds), labelled_ids(labels, 0, folds)
    texts = doc_text(docs)
    counted = texts.mapInArrow(_count(sc.broadcast(frozenset(good))), "feature long, n long, t long").groupBy("feature").agg(F.sum("n"), F.sum("t")).toArrow()
    everything, target = np.zeros(TOTAL), np.zeros(TOTAL)
    at = counted.column(0).to_numpy()
    everything[at], target[at] = counted.column(1).to_numpy(), counted.column(2).to_numpy()
    ratios = log_ratios(everything, target) if good else np.zeros(TOTAL)
    rows = written(draws(texts.mapInArrow(_weigh(sc.broadcast(ratios)), "doc_id long, log_weight double"), seed), "weighed")
    known = docs.sparkSession.createDataFrame([(i, q) for q, ids in ((1, good), (0, bad)) for i in ids], "doc_id long, quality int")
    seen = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("log_weight").alias("log_weight")).toArrow()  # at most twice LABELLED rows
    quality, weight = seen.column("quality").to_numpy(), seen.column("log_weight").to_numpy()
    level = best_level(weight[quality == 1], weight[quality == 0])
    k = rows.where(F.col("log_weight") >= level).count()
    return top_k(rows, k).select("doc_id", "log_weight", "draw", "keep")


def bar_of(column: str, kind: str, low: float, high: float, bars: int) -> Column:
    """The bar of a value between low and high; never a lower one for a higher value."""
    if kind == "bigint":
        return F.expr(f"CAST(({column} - {low}L) div {(high - low) // bars + 1}L AS INT)")
    # Halves, so that the width of the widest range of doubles is finite.
    share = (F.col(column) / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.floor(share * bars), F.lit(bars - 1)).cast("int")


def nth_highest(rows: DataFrame, column: str, n: int, bars: int = BARS) -> tuple:
    """The n-th highest value of a column, and how many rows with exactly this value are among the n highest."""
    kind = dict(rows.dtypes)[column]
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        inside = rows.where(F.col(column).between(low, high)).groupBy(bar_of(column, kind, low, high, bars).alias("bar"))
        for r in sorted(inside.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), reverse=True):  # at most ``bars`` rows
            if r.n >= n:
                low, high = r.low, r.high
                break
            n -= r.n
        if r.n == n:
            return low, n if low == high else rows.where(F.col(column) == low).count()
    return low, n


def top_k(rows: DataFrame, k: int, bars: int = BARS) -> DataFrame:
    """``rows`` (row, draw, ...) with ``keep``: true for the k highest draws, ties by row."""
    total = rows.count()
    if k <= 0 or k >= total:
        return rows.withColumn("keep", F.lit(k > 0))
    level, ties = nth_highest(rows, "draw", k, bars)
    same = rows.where(F.col("draw") == level)
    keep = F.col("draw") > level
    if ties == same.count():
        return rows.withColumn("keep", keep | (F.col("draw") == level))
    last, _ = nth_highest(same.select((-F.col("row")).alias("back")), "back", ties, bars)
    return rows.withColumn("keep", keep | ((F.col("draw") == level) & (F.col("row") <= -last)))
