"""Language-model scores from a probabilistic suffix tree over words.

Near the root, symbols are the words with at least ``1 / SYMBOLS`` of all training tokens, a class for all
other words, a start and an end. A context of up to ``depth`` symbols is a candidate if it has at least
``1 / CONTEXTS`` of the tokens, and becomes a state if the divergence between its next-symbol counts
and its suffix's distribution outweighs the cost of its parameters. Distributions are smoothed by
absolute discounting towards the suffix; at the root, by adding one. A word of the class of other words
has the class's probability times its share of it at the root. Scoring follows the longest suffix that
is a state.

Beyond that, contexts of DEEP whole words are states by absolute counts: all those that recur in the training
texts and whose divergence from the near-root distribution outweighs its cost; none is left out by its hash. They and their next words are a table that grows with the corpus.
It is never in one place. Documents are stored once more, in numbered parts. Every part first sends a short key of each
distinct context, the hash's upper bits, to the key's shard, and learns which keys training texts hold twice; a context
whose key they don't can't be a state. Keys are just long enough that few contexts share one by chance; such contexts
are only sent in vain. Then every part sends its distinct recurring contexts with next words, counted, to the shard of
the context's whole hash; a shard puts the counts of all parts together, tests the contexts, and gives each document the
gain of its pairs. Pairs with a count of one have no share of their own. What a deep
state adds to a rare word's share is its probability near the root with a count of zero.

What is broadcast is bounded by shares of all tokens alone, however large the corpus: at most SYMBOLS symbols,
CONTEXTS states a level, EXPLICIT pairs a level and EXPLICIT frequent words. All other words' counts
stay in a table that is joined with the words of the documents.

Null text: empty (one token, the end). Null doc_id: hashes as the empty text. Repeated rows: each is
trained on and scored. Ties: words of equal counts are numbered in byte order. Very long texts: memory is a few
dozen times a text's size. No training documents: every token is unknown. Empty table: no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import StringTable, crc_bucket, doc_text, durable_dir, pieces, split_words, written

FOLDS, HELD_OUT, DEPTH = 7, 2, 3
SYMBOLS, CONTEXTS, EXPLICIT = 1 << 14, 1 << 16, 1 << 20
DISCOUNT = 0.75
#: Words of a deep context, and what its hash is divisible by: by one, so every context is counted.
DEEP, ELIGIBLE = 6, 1
#: Deep pairs in a shard, about; steps of a near-root probability's logarithm, as it is sent along.
SHARD, STEPS = 1 << 21, 1024
#: Bits of a context's key beyond those that number all training tokens: one context in 32, at most, shares its key by chance.
SPARE = 5
#: Bits of a symbol in a packed context.
SHIFT = 15
#: Distinct words or pairs that a task holds before it passes its partial counts on.
HELD = 1 << 19
PART_BYTES = 4_000_000
#: The same where all deep contexts of a part are in memory.
DEEP_BYTES = 2_000_000


class Level(NamedTuple):
    """States of one context length: sorted contexts with their back-off weights, sorted pairs with their own shares."""

    contexts: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    shares: np.ndarray


class Model(NamedTuple):
    words: pa.Array  # frequent words, most frequent first
    counts: np.ndarray
    n_symbols: int  # so many of the words are symbols
    n_docs: int
    total: int
    distinct: int
    root: np.ndarray  # probability of each symbol, the class of others, the end
    levels: list[Level]

    @property
    def other(self) -> int:
        return self.n_symbols

    @property
    def end(self) -> int:
        return self.n_symbols + 1

    @property
    def start(self) -> int:
        return self.n_symbols + 2


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    never = 1 << 62
    held = StringTable(never, never)
    for batch in batches:
        for part in pieces(batch, limit=PART_BYTES):
            held.look_up(split_words(pc.ascii_lower(part.column("text")))[0])
            if len(held.strings) > HELD:
                yield pa.RecordBatch.from_arrays([held.strings, pa.array(held.uses.astype(np.int64))], ["word", "c"])
                held = StringTable(never, never)
    yield pa.RecordBatch.from_arrays([held.strings, pa.array(held.uses.astype(np.int64))], ["word", "c"])


class Sequences(NamedTuple):
    """Texts in a row, each as start, words, end."""

    symbols: np.ndarray
    place: np.ndarray  # in its text; 0 is the start
    doc: np.ndarray
    size: np.ndarray  # tokens of each text: its words and the end
    words: pa.Array  # distinct
    at: np.ndarray  # of each distinct word: its number among the frequent ones, or -1
    code: np.ndarray  # of each word in the row: its place in ``words``


def sequences(texts: pa.Array, model: Model) -> Sequences:
    found, n = split_words(pc.ascii_lower(texts))
    coded = found.dictionary_encode()
    at = pc.index_in(coded.dictionary, value_set=model.words).fill_null(-1).to_numpy().astype(np.int64)
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n + 2)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n + 2) - n - 2, n + 2)
    symbols = np.full(len(doc), model.start)
    inner = (place > 0) & (place <= n[doc])
    symbols[inner] = np.where((at < 0) | (at >= model.n_symbols), model.other, at)[code]
    symbols[place > n[doc]] = model.end
    return Sequences(symbols, place, doc, n + 1, coded.dictionary, at, code)


def packed(sequence: np.ndarray, length: int) -> np.ndarray:
    """Every run of ``length`` symbols as one number, the latest symbol lowest."""
    out = np.zeros(max(0, len(sequence) - length + 1), np.int64)
    for k in range(length):
        out = (out << SHIFT) | sequence[k : k + len(out)]
    return out


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h >>= np.uint64(65 - size.bit_length())
    return h.astype(np.int64)


def hashed(wanted: np.ndarray) -> np.ndarray:
    """Places of distinct keys in an open hash table, at most half full; -1: nothing."""
    table = np.full(2 << len(wanted).bit_length(), -1, np.int32)
    left = np.arange(len(wanted), dtype=np.int32)
    slot = _slot(wanted, len(table))
    while len(left):
        free = table[slot] < 0
        table[slot[free]] = left[free]
        lost = table[slot] != left
        left, slot = left[lost], (slot[lost] + 1) & (len(table) - 1)
    return table


#: Tables of a worker's last arrays, by the arrays' identity; the arrays are held, so no other has it.
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _member(keys: np.ndarray, wanted: np.ndarray, again: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the array ``wanted``, of distinct ones, and its place there; ``again``: it will be asked for more."""
    if not len(wanted):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    if id(wanted) in _tables:
        table = _tables[id(wanted)][1]
    else:
        table = hashed(wanted)
        if again:
            if len(_tables) >= 8:
                _tables.clear()
            _tables[id(wanted)] = wanted, table
    slot = _slot(keys, len(table))
    at = table[slot]
    found = (wanted[at] == keys) & (at >= 0)
    open_ = np.flatnonzero((at >= 0) & ~found)
    while len(open_):
        slot[open_] = (slot[open_] + 1) & (len(table) - 1)
        at[open_] = table[slot[open_]]
        hit = (wanted[at[open_]] == keys[open_]) & (at[open_] >= 0)
        found[open_] = hit
        open_ = open_[~hit & (at[open_] >= 0)]
    return found, np.where(found, at, 0).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts (nothing: one each)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys))) if counts is None else np.add.reduceat(counts, head) if len(head) else counts


def _pair_counts(shared, candidates, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for part in pieces(batch, limit=PART_BYTES):
                s = sequences(part.column("text"), shared.value)
                new = packed(s.symbols, depth + 1)[s.place[depth:] >= depth]
                if depth > 1:
                    new = new[_member(new >> SHIFT, candidates.value)[0]]
                got, n = _summed(new, None)
                keys.append(got)
                counts.append(n)
                if sum(map(len, keys)) > 4 * HELD:
                    got, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [got], [n]
                    if len(got) > 2 * HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n)], ["key", "c"])
                        keys, counts = [], []
        if keys:
            got, n = _summed(np.concatenate(keys), np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n)], ["key", "c"])

    return run


def probabilities(model: Model, context: np.ndarray, nexts: np.ndarray, depth: int) -> np.ndarray:
    """P(next | last ``depth`` symbols of the packed context), by recursion from the root."""
    p = model.root[nexts]
    for d, level in enumerate(model.levels[:depth], 1):
        own = context & ((1 << (SHIFT * d)) - 1)
        known, at = _member(own, level.contexts)
        p = _refined(level, p, known.nonzero()[0], at[known], (own[known] << SHIFT) | nexts[known])
    return p


def _refined(level: Level, p: np.ndarray, rows: np.ndarray, at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    found, place = _member(pairs, level.pairs)
    p = p.copy()
    p[rows] = level.backoff[at] * p[rows] + np.where(found, level.shares[place] if len(level.shares) else 0.0, 0.0)
    return p


def grow(model: Model, pairs: np.ndarray, counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray) -> Level:
    """The states among the candidate ``contexts`` (sorted, with ``totals``), from their frequent pairs.

    Gain: log-likelihood of the counts under the context's own distribution over that under its
    suffix's; all pairs that aren't explicit count as one event. Cost: half a log of the context's
    count for each parameter.
    """
    depth = len(model.levels) + 1
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order].astype(float)
    known, at = _member(pairs >> SHIFT, contexts, again=False)
    pairs, counts, at = pairs[known], counts[known], at[known]
    parent = probabilities(model, pairs >> SHIFT, pairs & ((1 << SHIFT) - 1), depth - 1)
    n = len(contexts)
    add = lambda x: np.bincount(at, weights=x, minlength=n).astype(float)  # of nothing: integers
    rest, rest_parent = np.maximum(totals - add(counts), 0), np.maximum(1 - add(parent), 1e-12)
    gain = add(counts * np.log(counts / totals[at] / parent))
    gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-12) / totals / rest_parent), 0)
    kept = (gain > 0.5 * np.log(totals) * add(np.ones(len(at)))) & (add(counts) > 0)
    shares = np.maximum(counts - DISCOUNT, 0) / totals[at]
    backoff = 1 - np.bincount(at, weights=shares, minlength=n)
    own = kept[at]
    return Level(contexts[kept], backoff[kept], pairs[own], shares[own])


def train(docs: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, Model]:
    """The counts of all words of ``docs`` (doc_id, text) as a table (word, c), and the model."""
    texts = docs.select("text")
    vocabulary = written(texts.mapInArrow(_word_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n_docs = docs.count()
    distinct, n_words = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    total = n_words + n_docs
    frequent = vocabulary.where(F.col("c") * EXPLICIT >= total).toArrow()  # at most EXPLICIT rows
    words, counts = frequent.column("word").combine_chunks(), frequent.column("c").to_numpy()
    by_word = {w: i for i, w in enumerate(sorted(words.to_pylist(), key=lambda w: w.encode()))}
    order = np.lexsort((np.array([by_word[w] for w in words.to_pylist()], np.int64), -counts))
    words, counts = words.take(pa.array(order)), counts[order]
    n = int((counts * SYMBOLS >= total).sum()) if total else 0
    scale = total + distinct + bool(n_docs) + 1
    others = (n_words - counts[:n].sum()) + (distinct - n) + 1
    root = np.concatenate([counts[:n] + 1.0, [others, n_docs + 1.0]]) / scale
    model = Model(words, counts, n, n_docs, total, distinct + bool(n_docs), root, [])
    contexts = np.arange(n + 3)
    totals = np.concatenate([counts[:n], [n_words - counts[:n].sum(), 0, n_docs]]).astype(float)
    contexts, totals = contexts[totals > 0], totals[totals > 0]
    sc = docs.sparkSession.sparkContext
    for d in range(1, depth + 1):
        if not len(contexts):
            break
        shared, wanted = sc.broadcast(model), sc.broadcast(contexts)
        counted = texts.mapInArrow(_pair_counts(shared, wanted, d), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
        explicit = counted.where((F.col("c") > 1) & (F.col("c") * EXPLICIT >= total)).toArrow()  # at most EXPLICIT rows
        pairs, c = explicit.column("key").to_numpy(), explicit.column("c").to_numpy()
        model.levels.append(grow(model, pairs, c, contexts, totals))
        next_ones = (c * CONTEXTS >= total) & ((pairs & ((1 << SHIFT) - 1)) != model.end)
        order = np.argsort(pairs[next_ones])
        contexts, totals = pairs[next_ones][order], c[next_ones][order].astype(float)
        shared.unpersist()
    return vocabulary, model


def mixed(z: np.ndarray) -> np.ndarray:
    """Each number's bits well mixed (the finaliser of SplitMix64)."""
    z = z ^ (z >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits for each string: its length, then its UTF-8 bytes by eights, the last ones filled with zeros."""
    words = words.cast(pa.large_string())
    _, edges, data = words.buffers()
    edge = np.frombuffer(edges, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = np.zeros(int(edge[-1] - edge[0]) + 8, np.uint8)
    raw[:-8] = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if len(raw) > 8 else 0
    eights = np.ndarray(len(raw) - 7, "<u8", raw.tobytes(), strides=(1,))
    at, left = edge[:-1] - edge[0], np.diff(edge)
    out = mixed(left.astype(np.uint64) + ODD)
    rows = np.flatnonzero(left > 0)
    while len(rows):
        lane = eights[at[rows]] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.minimum(left[rows], 8).astype(np.uint64)))
        out[rows] = mixed(out[rows] * ODD + lane)
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] > 0]
    return out


def deep_contexts(s: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that have a deep context, the contexts' hashes, and the hash of the word at each place of all."""
    inner = (s.place > 0) & (s.place < s.size[s.doc])
    hashes = np.ones(len(s.place), np.uint64)  # a start's or an end's; no word's hash is looked for under it
    hashes[inner] = word_hashes(s.words)[s.code]
    n = max(0, len(hashes) - DEEP)
    context = np.zeros(n, np.uint64)
    for k in range(DEEP):
        context *= ODD
        context += hashes[k : k + n]
    at = np.flatnonzero(s.place[DEEP:] > DEEP)
    return at + DEEP, mixed(context[at]), hashes


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: all lowest bytes, then all second ones; what is mostly zero takes little. The raw size comes first."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.Codec("zstd", 1).decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in a row as one row: the number of the first, and all of them as a compressed stream."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in pieces(batch, limit=DEEP_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                stream.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "docs"])
            first += part.num_rows


def _docs(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _trained(part: pa.RecordBatch) -> np.ndarray:
    return ~part.column("held_out").to_numpy(zero_copy_only=False)


def _keys(bits: int, shards: int):
    """A part's distinct keys for a shard, and how often training texts of the part have each: never, once, more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Model(pa.array([], pa.string()), np.zeros(0), 0, 0, 0, 0, np.zeros(0), [])
        for batch in batches:
            for number, data in zip(batch.column("part").to_pylist(), batch.column("docs"), strict=True):
                part = _docs(data.as_buffer())
                s = sequences(part.column("text"), nothing)
                place, context, _ = deep_contexts(s)
                if not len(place):
                    continue
                marked = np.sort((context >> np.uint64(64 - bits) << np.uint64(1)) | _trained(part)[s.doc[place]].astype(np.uint64))
                key = marked >> np.uint64(1)
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                count = np.minimum(np.add.reduceat(marked & np.uint64(1), head), 2).astype(np.uint8)
                key = key[head]
                shard = (key >> np.uint64(bits - (shards.bit_length() - 1))).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
                spans = list(zip(edge[:-1], edge[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(spans)), pa.array(shard[edge[:-1]], pa.int32()),
                    pa.array([planes(np.diff(key[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()), pa.array([planes(count[a:b]) for a, b in spans], pa.binary()),
                ], ["part", "shard", "key", "count"])

    return run


def _recurring(table: pa.Table) -> pa.Table:
    """For each part, whether training texts of all parts have each of its keys twice."""
    keys = [np.cumsum(unplaned(x, "<u8"), dtype=np.uint64) for x in table.column("key").to_pylist()]
    every, count = np.concatenate(keys), np.concatenate([unplaned(x, "u1") for x in table.column("count").to_pylist()])
    order = np.argsort(every)
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    twice = np.empty(len(every), bool)
    twice[order] = (np.add.reduceat(count[order].astype(np.int64), np.flatnonzero(new)) >= 2)[np.cumsum(new) - 1]
    edge = np.cumsum([0, *map(len, keys)])
    return pa.table({"part": table.column("part"), "shard": table.column("shard"), "twice": pa.array([planes(np.packbits(twice[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), "n": pa.array([len(k) for k in keys], pa.int32())})


def recurs(context: np.ndarray, bits: int, twice: np.ndarray) -> np.ndarray:
    """Whether each context's key is one of those, among the sorted distinct keys of all, that ``twice`` marks."""
    key = context >> np.uint64(64 - bits)
    every = np.sort(key)
    every = every[np.concatenate([[True], every[1:] != every[:-1]])]
    return _member(key, every[twice], again=False)[0]


def _scores(shared, bits: int, shards: int):
    """Rows of two kinds: a document's near-root score, and a part's recurring deep pairs for a shard."""

    def run(stored: pa.Table, answers: pa.Table) -> pa.Table:
        given = answers.sort_by("shard")
        twice = [np.unpackbits(unplaned(x, "u1"), count=n).astype(bool) for x, n in zip(given.column("twice").to_pylist(), given.column("n").to_pylist(), strict=True)]
        part = _docs(stored.column("docs")[0].as_buffer())
        return pa.Table.from_batches(_score_part(part, shared.value, stored.column("part")[0].as_py(), bits, np.concatenate([np.zeros(0, bool), *twice]), shards))

    return run


#: The columns of both kinds of rows.
NEAR = ("row long", "doc_id long", "held_out boolean", "n_tokens long", "n_known long", "base double", "tree double", "rare array<struct<word: string, n: long>>")
SENT = ("part long", "shard int", "context binary", "next binary", "count binary", "level binary", "owners binary", "rows binary", "rare_at binary", "tails array<string>")
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
    "array<struct<word: string, n: long>>": pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])),
}


def _record(columns: dict) -> pa.RecordBatch:
    """Rows of one kind; the other's columns are null."""
    fields = [c.split(" ", 1) for c in NEAR + SENT]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, ARROW[kind])) for name, kind in fields], [name for name, _ in fields])


def _score_part(part: pa.RecordBatch, model: Model, first: int, bits: int, twice: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    s, n = sequences(part.column("text"), model), part.num_rows
    base = np.log10((np.append(model.counts, model.n_docs) + 1.0) / (model.total + model.distinct + 1))
    word_doc = np.repeat(np.arange(n), s.size - 1)
    at = s.at[s.code]
    frequent, other = at >= 0, at >= model.n_symbols
    summed = lambda which: np.bincount(word_doc[which], base[at[which]], n)
    entries, times = np.unique((word_doc * len(s.words) + s.code)[~frequent], return_counts=True)
    tails = s.words.take(pa.array(entries % max(1, len(s.words))))
    edge = np.concatenate([[0], np.cumsum(np.bincount(entries // max(1, len(s.words)), minlength=n))]).astype(np.int32)
    rare = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([tails, pa.array(times, pa.int64())], ["word", "n"]))
    p, context = model.root[np.minimum(s.symbols, model.end)], np.zeros(len(s.symbols), np.int64)
    for d, level in enumerate(model.levels, 1):
        inside = s.place >= d
        before = np.concatenate([np.zeros(d, np.int64), s.symbols[:-d]]) if len(s.symbols) >= d else np.zeros(len(s.symbols), np.int64)
        context = np.where(inside, context | (before << (SHIFT * (d - 1))), -1)
        known, place = _member(context, level.contexts)
        rows = np.flatnonzero(known & inside)
        p = _refined(level, p, rows, place[rows], (context[rows] << SHIFT) | s.symbols[rows])
    # A word of the class of others has a share of the class; a rare one's count isn't known here, so its share is left open.
    logs = np.log10(p) - np.where(s.symbols == model.other, np.log10(model.root[model.other]), 0)
    logs[s.place == 0] = 0  # the starts are given
    yield _record({
        "row": pa.array(first + np.arange(n)), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(s.size), "rare": rare,
        "n_known": pa.array(np.bincount(word_doc[frequent], minlength=n) + (model.n_docs > 0)), "base": pa.array(summed(frequent) + base[-1]), "tree": pa.array(np.bincount(s.doc, logs, n) + summed(other)),
    })
    yield from _sent(part, s, model, p, first, bits, twice, shards)


def _sent(part: pa.RecordBatch, s: Sequences, model: Model, p: np.ndarray, first: int, bits: int, twice: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """The part's distinct recurring deep pairs by shard: counts in training texts, near-root probabilities, and the rows they stand in."""
    if not twice.any():
        return
    place, context, hashes = deep_contexts(s)
    often = recurs(context, bits, twice)
    place, context = place[often], context[often]
    follows = (mixed(context + hashes[place]) >> np.uint64(32)).astype(np.uint32)
    # The near-root probability of the word itself; of a rare one, as of a word that never occurs.
    word = np.full(len(s.place), -1)
    word[(s.place > 0) & (s.place < s.size[s.doc])] = s.at[s.code]
    share = np.ones(len(place))
    other = s.symbols[place] == model.other
    count = np.where(word[place] >= 0, model.counts[np.maximum(word[place], 0)] if len(model.counts) else 0, 0)
    share[other] = ((count + 1.0) / (model.total + model.distinct + 1) / model.root[model.other])[other]
    level = np.minimum(np.round(-np.log(p[place] * share) * STEPS), 65535).astype(np.uint16)
    order = np.lexsort((follows, context))
    context, follows, level = context[order], follows[order], level[order]
    doc = s.doc[place[order]]
    trained = _trained(part)[doc]
    head = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (follows[1:] != follows[:-1])]))
    counts = np.add.reduceat(trained.astype(np.int64), head).astype(np.uint32)
    owners = np.diff(np.append(head, len(context))).astype(np.uint32)
    upper = shards.bit_length() - 1
    shard = (context[head] >> np.uint64(64 - upper)).astype(np.int64) if upper else np.zeros(len(head), np.int64)
    edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    rows_edge = np.append(head, len(context))
    columns = {k: [] for k in ("part", "shard", "context", "next", "count", "level", "owners", "rows", "rare_at", "tails")}
    code = np.zeros(len(s.place), np.int64)
    code[(s.place > 0) & (s.place < s.size[s.doc])] = s.code
    place = place[order][head]
    tail = (s.symbols[place] == model.other) & (word[place] < 0)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = head[a:b]
        values = (first, int(shard[a]), planes(np.diff(context[own], prepend=np.uint64(0))), planes(follows[own]), planes(counts[a:b]), planes(level[own]), planes(owners[a:b]), planes(doc[rows_edge[a] : rows_edge[b]].astype(np.uint32)), planes(np.flatnonzero(tail[a:b]).astype(np.uint32)), s.words.take(pa.array(code[place[a:b][tail[a:b]]])).to_pylist())
        for k, v in zip(columns, values, strict=True):
            columns[k].append(v)
    kinds = dict(c.split(" ", 1) for c in SENT)
    yield _record({k: pa.array(v, ARROW[kinds[k]]) for k, v in columns.items()})


def deep_gains(context: np.ndarray, follows: np.ndarray, count: np.ndarray, level: np.ndarray) -> np.ndarray:
    """What log10 of the probability gains by the deep states, for each (context, next) with a part's training count.

    The same pair may come from several parts; its counts are added.
    """
    order = np.lexsort((follows, context))
    c, f = context[order], follows[order]
    new_context = np.concatenate([[True], c[1:] != c[:-1]])
    new_pair = new_context | np.concatenate([[True], f[1:] != f[:-1]])
    pair = np.cumsum(new_pair) - 1
    of = (np.cumsum(new_context) - 1)[new_pair]  # each pair's context
    n = np.bincount(pair, count[order])
    near = np.exp(level[order][new_pair] / -STEPS)
    total = np.bincount(of, n)
    own = n >= 2
    add = lambda x: np.bincount(of, np.where(own, x, 0), len(total))
    share = np.where(own, (n - DISCOUNT) / np.maximum(total[of], 1), 0)
    backoff = 1 - add(share)
    rest, rest_near = np.maximum(total - add(n), 0), np.maximum(1 - add(near), 1e-12)
    safe = np.maximum(total, 1)
    gain = add(n * np.log(np.maximum(n, 1) / safe[of] / near)) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-12) / safe / rest_near), 0)
    kept = (add(np.ones(len(n))) > 0) & (gain > 0.5 * np.log(safe) * add(np.ones(len(n))))
    value = np.where(kept[of], np.log10(share / near + backoff[of]), 0.0)
    out = np.empty(len(context), np.float32)
    out[order] = value[pair]
    return out


def _shard(table: pa.Table) -> pa.Table:
    """Each row's gain from the shard; and rare words that a deep state knows, for which counts have to be taken back."""
    read = {k: [unplaned(x, kind) for x in table.column(k).to_pylist()] for k, kind in (("context", "<u8"), ("next", "<u4"), ("count", "<u4"), ("level", "<u2"))}
    edge = np.cumsum([0, *map(len, read["next"])])
    gains = deep_gains(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in read["context"]]), *(np.concatenate(read[k]) for k in ("next", "count", "level")))
    rows, sums, tail_rows, tails = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], []
    for a, b, part, owners, own, at, words in zip(edge[:-1], edge[1:], *(table.column(k).to_pylist() for k in ("part", "owners", "rows", "rare_at", "tails")), strict=True):
        gain, many, doc, rare = gains[a:b], unplaned(owners, "<u4"), unplaned(own, "<u4"), unplaned(at, "<u4")
        total = np.bincount(doc, np.repeat(gain, many))
        some = np.flatnonzero(total)
        rows.append(part + some)
        sums.append(total[some])
        ends = np.cumsum(many)
        for k in np.flatnonzero(gain[rare] > 0).tolist():
            i = rare[k]
            tail_rows.append(part + doc[ends[i] - many[i] : ends[i]].astype(np.int64))
            tails += [words[k]] * int(many[i])
    rows, tail_rows = np.concatenate(rows), np.concatenate(tail_rows)
    return pa.table({"row": np.concatenate([rows, tail_rows]), "deep": np.concatenate([*sums, np.zeros(len(tail_rows))]), "word": pa.array([None] * len(rows) + tails, pa.string())})


def _scored(texts: DataFrame, model: Model) -> DataFrame:
    """The rows of ``_scores``. Parts are stored in buckets, so that the answers go to the parts, not both to each other."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    shards = 1 << max(0, math.ceil(math.log2(max(1, model.total / SHARD))))
    bits = model.total.bit_length() + SPARE
    name = f"quillspark_parts_{uuid.uuid4().hex}"
    path = f"{durable_dir(spark)}/{name}"
    table = f"spark_catalog.default.{name}"
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * shards))
    stored = texts.mapInArrow(_parts, "part long, docs binary")
    try:
        stored.write.bucketBy(buckets, "part").option("path", path).option("compression", "none").saveAsTable(table)
        parts = spark.table(table)
        keys = parts.mapInArrow(_keys(bits, shards), "part long, shard int, key binary, count binary")
        answers = keys.groupBy("shard").applyInArrow(_recurring, "part long, shard int, twice binary, n int")
        scored = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_scores(shared, bits, shards), ", ".join(NEAR + SENT))
        return written(scored, "scored")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, near_score of every document.

    The model learns from documents whose crc32(doc_id as text) mod ``folds`` isn't ``held_out``;
    ``near_score`` is the score without deep contexts.
    """
    texts = doc_text(docs).withColumn("held_out", crc_bucket(F.col("doc_id"), folds) == held_out)
    vocabulary, model = train(texts.where(~F.col("held_out")), depth)
    every = _scored(texts, model)
    rows = every.where("row is not null").select(*(c.split()[0] for c in NEAR))
    sent = every.where("part is not null").select(*(c.split()[0] for c in SENT))
    given = written(sent.groupBy("shard").applyInArrow(_shard, "row long, deep double, word string"), "given")
    back = given.where("word is not null").groupBy("row", "word").count().join(vocabulary, "word").select("row", (-F.col("count") * F.log10(F.col("c") + 1.0)).alias("deep"))
    deep = given.where("word is null").select("row", "deep").unionByName(back).groupBy("row").agg(F.sum("deep").alias("deep"))
    # A partition of distinct words is small, so it is hashed; the documents' words, many more, aren't sorted.
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(vocabulary.hint("shuffle_hash"), "word", "left")
    one = F.log10((F.coalesce("c", F.lit(0)) + 1.0) / float(model.total + model.distinct + 1))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * one).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("known"))
    out = rows.drop("rare").join(rare, "row", "left").join(deep, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    near = F.col("tree") + more
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (near + F.coalesce("deep", F.lit(0.0))).alias("score"), near.alias("near_score"),
    )
