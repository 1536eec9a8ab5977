"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint's bits are majority votes over the hashes of a text's word shingles; a lane is 64 of them.
Distinct fingerprints that agree on chosen bits meet in a cell. In a cell, fingerprints lie vertically:
word p of a block of 64 holds their p-th bits. A query updates the distances of a whole block at once with
carry-save counters, bit plane after bit plane, and a block is abandoned once all its distances exceed the
radius, or left out if all of it is linked with the query already. Cells with too many fingerprints are cut
into chunks and every pair of chunks is a group of its own. Only a spanning forest of a group's links leaves
it, so copies never become pairs.

``near_duplicates`` links one lane within a few bits: such fingerprints share two of ``radius + 2`` bit
ranges at least, so a cell for each two ranges misses nothing. ``similar_documents`` links texts with a
Jaccard similarity of about ``similarity`` or more by four lanes: its radius is a standard deviation above
the distance expected there, and its cells are as many seeded choices of bits as find such a pair with
a probability of RECALL; a cell's bits grow with the number of fingerprints, so cells stay small.

Null or empty text, or one without words: fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence. Null doc_id: a document of its own, never the representative of others.
Repeated rows: one class. Ties in a vote: the bit is 0. Very long texts: memory is a few times a text's
size. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import doc_text, pieces, word_list, written
from quillspark.llm.components import components

BITS, SEED, RADIUS, SHINGLE = 64, 42, 3, 3
#: Lanes of ``similar_documents``; the share of pairs of just this similarity that its cells find.
LANES, RECALL = 4, 0.99
#: Fingerprints in a chunk of a cell; (query, block) pairs compared in one go, at first and at most; planes between abandonments.
CHUNK, FEW_PAIRS, PAIRS, STEP = 2048, 1 << 11, 1 << 15, 8
#: Bits of a cell's number that say which choice of bits it belongs to.
CHOICE_SHIFT = 48
#: Rows up to which large cells are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Parts into which rows of one fingerprint are dealt when they get their class.
SALTS = 8
#: Fingerprints whose bit planes are held together.
AT_ONCE = 1 << 16
HASHES_AT_ONCE = 1 << 15
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED, lanes: int = 1) -> bytes:
    """SimHash of a word list, lowest bit first; lanes after the first have hashes mixed from the first's."""
    from xxhash import xxh64_intdigest

    if not words:
        return bytes(8 * lanes)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = list(zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True))
    votes = np.zeros((lanes, BITS), np.int64)
    for k in range(0, n, HASHES_AT_ONCE // lanes):
        some = spans[k : k + HASHES_AT_ONCE // lanes]
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in some), "<u8", len(some))
        for lane in range(lanes):
            own = mixed(hashes, lane) if lane else hashes
            votes[lane] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32 if lanes > 1 else np.int64)
    return np.packbits(votes.reshape(-1) * 2 > n, bitorder="little").tobytes()


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits from each hash (the finaliser of SplitMix64)."""
    z = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _fingerprints(shingle: int, seed: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [text_fingerprint(word_list(t), shingle, seed, lanes) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, lanes: int = 1) -> DataFrame:
    """doc_id, fp (binary, lowest byte first) of every text."""
    return doc_text(docs).mapInArrow(_fingerprints(shingle, seed, lanes), "doc_id long, fp binary")


def _within(planes: np.ndarray, wanted: np.ndarray, queries: np.ndarray, q: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of all fingerprints within ``radius``; query q[i] is compared with the wanted[i] ones of block b[i]."""
    counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(q), np.uint64)
    near, step = wanted, STEP * queries.shape[1]
    for p in range(len(planes)):
        bit = ((queries[q, p // BITS] >> np.uint64(p % BITS)) & np.uint64(1)) * ONES
        carry = planes[p][b] ^ bit
        for i in range(min(len(counters), (p + 1).bit_length())):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        if p + 1 >= 1 << len(counters):
            over |= carry
        if p % step == step - 1:
            near = ~(over | _exceeds(counters, radius)) & wanted
            alive = near != 0
            if not alive.all():
                q, b, over, near, wanted = q[alive], b[alive], over[alive], near[alive], wanted[alive]
                counters = [c[alive] for c in counters]
            if not len(q):
                break
    if not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, lane = np.nonzero(lanes)
    return q[i], b[i] * 64 + lane


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``, by comparing bits from the highest."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ONES)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above |= equal & counters[i]
            equal = equal & ~counters[i]
    return above


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the classes of a[i] and b[i]; label[x] is the smallest member of x's class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def cell_links(groups: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group of distinct fingerprints (a row of lanes each), as two arrays.

    All groups lie in a row; a block may hold the end of one and several others, of which a query wants its own.
    """
    size = np.fromiter(map(len, groups), np.int64, len(groups))
    end = np.cumsum(size)
    first, total, lanes = end - size, int(end[-1]), groups[0].shape[1]
    flat = np.zeros((-(-total // 64) * 64, lanes), np.uint64)
    flat[:total] = np.concatenate(groups)
    bits = np.unpackbits(flat.view(np.uint8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64).reshape(BITS * lanes, -1)
    del bits
    label = np.arange(len(flat))

    def link(query: np.ndarray, block: np.ndarray, group: np.ndarray) -> None:
        nonlocal label
        lo, hi = np.maximum(first[group] - block * 64, 0), np.minimum(end[group] - block * 64, 64)
        wanted = (ONES >> (64 - (hi - lo)).astype(np.uint64)) << lo.astype(np.uint64)
        at, many = 0, FEW_PAIRS
        while at < len(query):
            q, b, w = query[at : at + many], block[at : at + many], wanted[at : at + many]
            # A block that is linked with the query already has nothing to tell.
            own = label.reshape(-1, 64)
            one = (own == own[:, :1]).all(axis=1)
            open_ = ~(one[b] & (own[b, 0] == label[q]))
            label = merge(label, *_within(planes, w[open_], flat, q[open_], b[open_], radius))
            at, many = at + many, min(PAIRS, many * 2)

    def pairs(who: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query with the blocks of its group from its own on: each unordered pair of blocks once."""
        n = (end[group] - 1) // 64 - who // 64 + 1
        return np.repeat(who, n), np.repeat(who // 64 - np.cumsum(n) + n, n) + np.arange(int(n.sum())), np.repeat(group, n)

    member = np.repeat(np.arange(len(groups)), size)
    small = np.flatnonzero(size[member] <= 64)
    for at in range(0, len(small), PAIRS):
        link(*pairs(small[at : at + PAIRS], member[small[at : at + PAIRS]]))
    for g in np.flatnonzero(size > 64):
        step = max(1, PAIRS * 64 // int(size[g]))
        for at in range(int(first[g]), int(end[g]), step):
            who = np.arange(at, min(at + step, int(end[g])))
            link(*pairs(who, np.full(len(who), g)))
    tied = np.flatnonzero(label[:total] != np.arange(total))
    return flat[tied], flat[label[tied]]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            cut = lists.offsets.to_numpy()
            flat = lanes_of(lists.values)
            first = 0
            while first < batch.num_rows:  # cells together, up to so many fingerprints
                last = max(first + 1, int(np.searchsorted(cut, cut[first] + AT_ONCE, side="right")) - 1)
                found = cell_links([flat[x:y] for x, y in zip(cut[first:last], cut[first + 1 : last + 1], strict=True)], radius)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in side], pa.binary()) for side in found], ["a", "b"])
                first = last

    return run


def lanes_of(fps: pa.Array) -> np.ndarray:
    """Fingerprints, all of one length, as rows of lanes."""
    if not len(fps):
        return np.zeros((0, 1), np.uint64)
    _, offsets, data = fps.buffers()
    at = np.frombuffer(offsets, np.int32)[fps.offset : fps.offset + len(fps) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view("<u8").reshape(len(fps), -1)


def two_ranges(radius: int = RADIUS) -> list[np.ndarray]:
    """The bits of every two of ``radius + 2`` ranges of a lane."""
    edge = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    ranges = [np.arange(a, b) for a, b in zip(edge, edge[1:], strict=False)]
    return [np.concatenate(p) for p in combinations(ranges, 2)]


def seeded_choices(n_bits: int, per_cell: int, how_many: int, seed: int = SEED) -> list[np.ndarray]:
    """``how_many`` choices of bits, cut from seeded orders of all bits."""
    r, out = np.random.default_rng(seed), []
    while len(out) < how_many:
        order = r.permutation(n_bits)
        out += [order[k : k + per_cell] for k in range(0, n_bits - per_cell + 1, per_cell)]
    return out[:how_many]


def _placed(choices: list[np.ndarray]):
    weights = [np.int64(1) << np.arange(len(c), dtype=np.int64) for c in choices]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp")
            bits = np.unpackbits(lanes_of(fps).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            for k, (c, w) in enumerate(zip(choices, weights, strict=True)):
                if len(fps):
                    yield pa.RecordBatch.from_arrays([pa.array((k << CHOICE_SHIFT) + bits[:, c] @ w), fps], ["cell", "fp"])

    return run


def cells(fps: DataFrame, choices: list[np.ndarray] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Arrays ``fps`` of fingerprints to compare with one another, for distinct fingerprints ``fp``; ``choices``: the bits that a cell agrees on."""
    placed = fps.select("fp").mapInArrow(_placed(choices or two_ranges()), "cell long, fp binary")
    large = written(placed.groupBy("cell").count().where(F.col("count") > chunk), "large")
    n = large.count()
    group = lambda df, *by: df.groupBy(*by).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    if not n:
        return group(placed, "cell")
    large = F.broadcast(large) if n <= BROADCAST_ROWS else large
    few = placed.join(large, "cell", "left_anti")
    many = placed.join(large, "cell").withColumn("chunks", F.ceil(F.col("count") / chunk))
    many = many.withColumn("own", F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.col("chunks"))).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    many = many.select("cell", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"), "fp")
    # Pairs of chunks are dealt out by all three columns; by the cell alone they would share a task.
    return group(few, "cell").unionByName(group(many.repartition("cell", "lo", "hi"), "cell", "lo", "hi"))


def classes(found: DataFrame, radius: int, choices_for: Callable[[int], list[np.ndarray]]) -> DataFrame:
    """doc_id, fp, component_id of every row of ``found`` (doc_id, fp); ``choices_for``: cells for so many fingerprints."""
    known = written(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    links = written(cells(known.select("fp"), choices_for(known.count())).mapInArrow(_links(radius), "a binary, b binary").distinct(), "near")
    named = links.join(known.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(known.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    # Classes of fingerprints are named by their smallest document.
    tied = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    label = known.join(tied, known["rep"] == tied["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # A third of all rows may share a fingerprint: they meet its class in several tasks.
    label = label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(label, ["fp", "salt"], "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document; links are fingerprints within ``radius`` bits."""
    found = written(fingerprints(docs, shingle, seed), "fingerprints")
    joined = classes(found, radius, lambda _: two_ranges(radius))
    return joined.select("doc_id", F.lower(F.hex(reversed_bytes(F.col("fp")))).alias("fingerprint"), "component_id")


def reversed_bytes(fp: Column) -> Column:
    """The eight bytes of a lane, highest first."""
    return F.concat(*(F.substring(fp, i, 1) for i in range(8, 0, -1)))


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = SEED, lanes: int = LANES) -> DataFrame:
    """doc_id, fp, component_id of every document; links are texts whose shingles' similarity is about ``similarity`` or more."""
    bits = BITS * lanes
    # Texts with this Jaccard similarity and like lengths have vectors with this cosine, whose angle gives the share of differing bits.
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.floor(bits * share + math.sqrt(bits * share * (1 - share)))

    def choices(n: int) -> list[np.ndarray]:
        per_cell = min(max(math.ceil(math.log2(n + 1)) - 2, 8), CHOICE_SHIFT - 8)
        return seeded_choices(bits, per_cell, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - share) ** per_cell)), seed)

    return classes(written(fingerprints(docs, shingle, seed, lanes), "fingerprints"), radius, choices)
