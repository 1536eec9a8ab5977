"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks, trained on labelled sentences.

The kernel of two strings sums over their common subsequences of ``ORDER`` letters, each weighted by
DECAY to the letters it spans, normalised; so ``i.d.i.o.t`` and ``idioot`` stay close to ``idiot``. A
sentence is a bag of distinct words; signs inside a word are left out, long words are cut into overlapping
windows, words spelled letter by letter are joined and are a sentence of their own. The kernel of two
sentences sums the kernels of their words, over the roots of the numbers of words. Sentences end at a full
stop, a question or an exclamation mark, or after ``SPAN`` words.

Labels are those of documents, so the SVM learns from several instances: a document stands for its sentence
with the highest margin, toxic if the document is labelled so; the choice and the fit alternate ``ROUNDS``
times. A second SVM with the same landmarks learns from all sentences of a document together, as one bag of
words, where cues that are weak in each sentence add up. A logistic curve turns a document's two margins, of
its worst sentence and of all its words, into a probability.

Training takes at most TOXIC toxic and CLEAN clean labelled documents of the training folds (those with
the least hash of doc_id). Their words are counted by distinct neighbourhoods, so copies of a text count
once. All words found in toxic texts far more than in clean ones are the witnesses; the landmarks are all
witnesses and as many clean words close to them.

Only the text enters a score. Null text: empty; a text without words has the bias for its margin. No labelled
documents of either kind: the share of toxic ones, or 0. Null doc_id hashes as the empty text. Repeated
rows: each is scored; a repeated doc_id trains once, by its least text. Ties: of sentences with equal margins
the first stands for its document. Very long texts: memory is a few times a text's size. Empty table: no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import StringTable, crc_bucket, doc_text, pieces, split_words, written

FOLDS = 5
TOXIC, CLEAN = 4000, 8000
ORDER, DECAY, WIDTH = 3, 0.6, 24
SPAN, ROUNDS = 32, 3
OTHERS = 3000
OCCURRENCES = 1 << 18
#: Numbers in a table of rows by subsequences, whatever the rows; additions to it at once.
PROFILE, ADDED = 1 << 22, 1 << 20
#: Tokens that a task remembers, and bytes of their strings.
CACHED, CACHED_BYTES = 600_000, 12_000_000
#: Letters of the landmarks up to which a weighted sum of landmarks is a table of all triples of letters.
TABLED = 128
SPELLED = re.compile(r"(?<!\S)(?:\w[\W_]? ){2,}\w(?!\w)")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
LETTER = re.compile(r"\w[\W_]?")


#: What is stripped from a word's ends.
EDGES = ".,;:!?\"'()[]{}<>|&%$#*-_=/\\"


def clean_piece(word: str) -> str:
    return word.strip(EDGES).lower()


def windows(piece: str) -> list[str]:
    """The piece, or its overlapping windows if it is too long for one comparison."""
    if len(piece) <= WIDTH:
        return [piece]
    return [piece[i : i + WIDTH] for i in range(0, len(piece) - WIDTH // 2, WIDTH // 2)]


def forms(piece: str) -> list[str]:
    """What of a word is compared: the windows of its letters and digits."""
    bare = piece if piece.isalnum() else "".join(filter(str.isalnum, piece))
    return windows(bare) if len(bare) >= ORDER else []


def spelled(text: str) -> list[str]:
    """Words written letter by letter, joined."""
    return [m[0].replace(" ", "") for m in SPELLED.finditer(text)]


def codes(strings: list[str]) -> np.ndarray:
    """Code points in columns; zero beyond a string's end matches nothing."""
    joined = "".join([s[:WIDTH].ljust(WIDTH, "\0") for s in strings])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32).reshape(-1, WIDTH)


class Subsequences:
    """The landmarks' subsequences as a tree, and how much of each one every landmark has.

    A kernel is a sum over the subsequences that two strings share, so a string's walk through this tree
    gives its kernel with all landmarks at once, or with any weighted sum of them. ``leaf``, ``mark`` and
    ``value`` list what the landmarks have, landmark by landmark.
    """

    def __init__(self, landmarks: np.ndarray) -> None:
        self.letters = np.unique(landmarks[landmarks != 0])
        rows: list[dict[int, int]] = [{}, {}]  # node 0: no such subsequence; 1: the root
        leaves: dict[tuple[int, int], float] = {}
        n_leaves = 0
        for t, mark in enumerate(landmarks):
            ids = (np.searchsorted(self.letters, mark[mark != 0]) + 1).tolist()
            for places in combinations(range(len(ids)), ORDER):
                node = 1
                for i in places[:-1]:
                    after = rows[node].get(ids[i])
                    if after is None:
                        after = rows[node][ids[i]] = len(rows)
                        rows.append({})
                    node = after
                leaf = rows[node].get(ids[places[-1]])
                if leaf is None:
                    n_leaves += 1
                    leaf = rows[node][ids[places[-1]]] = n_leaves
                leaves[leaf, t] = leaves.get((leaf, t), 0.0) + DECAY ** (places[-1] - places[0] + 1)
        self.size = len(self.letters) + 1
        self.table = np.zeros(len(rows) * self.size, np.int32)
        for node, row in enumerate(rows):
            for letter, after in row.items():
                self.table[node * self.size + letter] = after
        self.leaves, self.marks = n_leaves + 1, len(landmarks)
        self.leaf, self.mark = np.array(list(leaves), np.int64).reshape(-1, 2).T
        self.value = np.array(list(leaves.values()), float)
        self.norms = np.sqrt(np.maximum(np.bincount(self.mark, self.value**2, self.marks), 1e-12))

    def found(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, subsequence and weight of every occurrence in the rows of one of the subsequences."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(self.letters):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        ids = np.minimum(np.searchsorted(self.letters, strings.T), len(self.letters) - 1)
        ids = np.where(self.letters[ids] == strings.T, ids + 1, 0)

        def walk(rows: np.ndarray, base: np.ndarray | int, at: int, first: int, depth: int) -> None:
            for j in range(at, len(ids)):
                after = self.table.take(ids[j].take(rows) + base)
                hit = np.flatnonzero(after)
                if not len(hit):
                    continue
                start = first if depth else j
                if depth + 1 == ORDER:
                    out.append((rows[hit], after[hit], np.full(len(hit), DECAY ** (j - start + 1))))
                else:
                    walk(rows[hit], after[hit].astype(np.int64) * self.size, j + 1, start, depth + 1)

        walk(np.arange(len(strings)), self.size, 0, 0, 0)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        rows, leaf, weight = (np.concatenate(x) for x in zip(*out, strict=True))
        return rows, leaf, weight

    def summed(self, strings: list[str], entry: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Sums of normalised kernels with the landmarks, for ``n`` rows; entries say which string is in which row.

        Subsequences are summed by row before the landmarks come in, so no string has a row of kernels of its own;
        memory is that of PROFILE numbers and the sums.
        """
        out = np.zeros((n, self.marks), np.float32)
        order = np.argsort(row, kind="stable")
        entry, row = entry[order], row[order]
        edge = np.searchsorted(self.mark, np.arange(self.marks + 1))
        step = max(1, PROFILE // self.leaves)
        for start in range(0, n, step):
            a, b = np.searchsorted(row, [start, start + step])
            if a == b:
                continue
            used, own = np.unique(entry[a:b], return_inverse=True)
            profile = self.profile([strings[i] for i in used.tolist()], own, row[a:b] - start, min(step, n - start))
            for t in range(self.marks):
                mine = slice(edge[t], edge[t + 1])
                out[start : start + step, t] = (self.value[mine] / self.norms[t]) @ profile[self.leaf[mine]]
        return out

    def profile(self, strings: list[str], entry: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """How much of each subsequence, by normalised strings, each of ``n`` rows has; subsequences by rows."""
        total = np.zeros(self.leaves * n)
        holders = row[np.argsort(entry, kind="stable")]
        many = np.bincount(entry, minlength=len(strings))
        first = np.cumsum(many) - many
        for places, rows in chunks(strings):
            at, leaf, weight = self.found(rows)
            if not len(at):
                continue
            near = np.unique(at)
            own = np.ones(len(rows))
            own[near] = own_norm(rows[near])
            weight, place = weight / own[at], places[at]
            ends = np.cumsum(many[place])
            # Every occurrence goes to all rows that hold its string.
            cuts = np.searchsorted(ends, np.arange(0, ends[-1], ADDED), side="left").tolist()
            for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
                times = many[place[a:b]]
                which = np.repeat(np.arange(a, b), times)
                holder = holders[np.arange(len(which)) + np.repeat(first[place[a:b]] - np.cumsum(times) + times, times)]
                np.add.at(total, leaf[which].astype(np.int64) * n + holder, weight[which])
        return total.reshape(self.leaves, n)


def raw_kernel(strings: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of every row with one landmark, all rows at once."""
    tree = Subsequences(landmark[None])
    rows, leaf, weight = tree.found(strings)
    value = np.zeros(tree.leaves)
    value[tree.leaf] = tree.value
    return np.bincount(rows, weight * value[leaf], len(strings))


def self_kernel(strings: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself."""
    letters = strings.T.copy()
    width, n = letters.shape
    square, decay = np.float32(DECAY * DECAY), np.float32(DECAY)
    same = np.where((letters[:, None] == letters[None]) & (letters != 0)[:, None], square, np.float32(0))
    prime = np.ones((width + 1, width + 1, n), np.float32)
    hit, run = np.empty(n, np.float32), np.empty(n, np.float32)
    for _ in range(ORDER - 1):
        new = np.zeros_like(prime)
        for a in range(width):
            run[:] = 0
            for b in range(width):
                np.multiply(same[a, b], prime[a, b], out=hit)
                run *= decay
                run += hit
                np.multiply(new[a, b + 1], decay, out=new[a + 1, b + 1])
                new[a + 1, b + 1] += run
        prime = new
    return np.einsum("abn,abn->n", same, prime[:-1, :-1])


def chunks(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of strings of like length, short ones first, about OCCURRENCES subsequences in a chunk."""
    lens = np.minimum(np.fromiter(map(len, strings), np.int64, len(strings)), WIDTH)
    order = np.argsort(lens, kind="stable")
    ends = np.searchsorted(lens[order], np.arange(WIDTH + 1), side="right").tolist()
    at = ends[ORDER - 1]  # shorter strings have no subsequence
    for width in range(ORDER, WIDTH + 1):
        step = max(64, OCCURRENCES // comb(width, ORDER))
        for a in range(at, ends[width], step):
            places = order[a : min(a + step, ends[width])]
            yield places, codes([strings[i] for i in places.tolist()])[:, :width]
        at = ends[width]


def own_norm(rows: np.ndarray) -> np.ndarray:
    step = max(64, 400_000 // rows.shape[1] ** 2)
    own = np.concatenate([self_kernel(rows[a : a + step]) for a in range(0, len(rows), step)])
    return np.sqrt(np.maximum(own, 1e-12))


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel, rows by landmarks."""
    every = np.arange(len(strings))
    return Subsequences(codes(landmarks)).summed(strings, every, every, len(strings))


class Projection:
    """The normalised kernel times a weight a landmark; its cost doesn't grow with the landmarks.

    Weights are complex numbers: the real parts are one weighting, the imaginary parts another.
    """

    def __init__(self, landmarks: list[str], weights: np.ndarray) -> None:
        self.tree = Subsequences(codes(landmarks))
        tree, shares = self.tree, (weights / self.tree.norms).astype(complex)[self.tree.mark] * self.tree.value
        self.leaf = np.bincount(tree.leaf, shares.real, tree.leaves) + 1j * np.bincount(tree.leaf, shares.imag, tree.leaves)
        size, self.table = self.tree.size, None
        if size <= TABLED:
            # The tree's two upper levels unfolded: the leaf of every triple of letters.
            step = self.tree.table.reshape(-1, size)
            leaves = step[step[step[1]].reshape(-1)].reshape(-1)
            self.table = self.leaf[leaves] * (leaves > 0)

    def __call__(self, strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), complex)
        for places, rows in chunks(strings):
            if self.table is not None:
                summed = self.tabled(rows)
            else:
                row, leaf, weight = self.tree.found(rows)
                part = weight * self.leaf[leaf]
                summed = np.bincount(row, part.real, len(rows)) + 1j * np.bincount(row, part.imag, len(rows))
            near = np.flatnonzero(summed)
            if len(near):
                out[places[near]] = summed[near] / own_norm(rows[near])
        return out

    def tabled(self, rows: np.ndarray) -> np.ndarray:
        """Weighted sum over all triples of places; a letter that no landmark has leads nowhere."""
        letters, size = self.tree.letters, self.tree.size
        if not len(letters):
            return np.zeros(len(rows), complex)
        at = np.minimum(np.searchsorted(letters, rows.T), len(letters) - 1)
        ids = np.where(letters[at] == rows.T, at + 1, 0).astype(np.int32)
        first, out = ids * np.int32(size * size), np.zeros(len(rows), complex)
        place, value = np.empty(len(rows), np.int32), np.empty(len(rows), complex)
        for j in range(1, len(ids) - 1):
            for k in range(j + 1, len(ids)):
                end = ids[j] * np.int32(size) + ids[k]
                for i in range(j):
                    np.add(first[i], end, out=place)
                    np.take(self.table, place, out=value, mode="clip")
                    value *= DECAY ** (k - i + 1)
                    out += value
        return out


class Model(NamedTuple):
    landmarks: list[str]  # witnesses first
    witnesses: int
    alpha: np.ndarray  # margin = kernel with the landmarks @ alpha + bias; real parts: of sentences, imaginary: of whole texts
    bias: complex
    slopes: tuple[float, float]  # of the worst sentence's margin and of all words' margin
    shift: float


def svm(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 800, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Linear SVM, squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    y, c = np.where(labels > 0, 1.0, -1.0), weights / weights.sum()
    rate = 1 / (2 * np.linalg.norm(x * np.sqrt(c)[:, None], 2) ** 2 + penalty)
    w = ahead = np.zeros(x.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = -2 * x.T @ (c * y * slack) + penalty * np.append(ahead[:-1], 0)
        new = ahead - rate * grad
        ahead, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def landmarks(witnesses: list[str], others: list[str]) -> list[str]:
    """The witnesses, then as many clean words closest to them."""
    seen = set(witnesses)
    clean = [o for o in dict.fromkeys(others) if o not in seen]
    close = kernel(clean, witnesses).max(axis=1)
    return witnesses + [clean[i] for i in np.argsort(-close, kind="stable")[: len(witnesses)]]


def separate(marks: list[str], x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the landmarks and bias, for texts given by their kernel with the landmarks."""
    inner = kernel(marks, marks).astype(float)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    x = x @ root
    scale = np.sqrt(np.maximum((x**2).sum(axis=1).mean(), 1e-12))
    w, bias = svm(x / scale, labels, weights)
    return root @ w / scale, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of P(toxic | margins), by Newton's method with a little shrinkage."""
    x = np.hstack([margins, np.ones((len(margins), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - labels) + 1e-2 * w)
    return tuple(map(float, w[:-1])), float(w[-1])


class Bags(NamedTuple):
    """Words of texts by sentence; an entry is a distinct word of a sentence."""

    row: np.ndarray  # of each sentence; ascending
    words: np.ndarray  # how many each sentence has
    sentence: np.ndarray  # of each entry; ascending
    token: np.ndarray  # a token of each entry's word
    whole_row: np.ndarray  # the same for whole texts: the row of each distinct word
    whole_token: np.ndarray


class Reader:
    """Texts as bags of words. A token is cleaned, and valued by ``value_of``, when it is first seen."""

    def __init__(self, value_of: Callable[[list[str]], np.ndarray]) -> None:
        self.value_of = value_of
        self.tokens = StringTable(CACHED, CACHED_BYTES)
        self.word, self.value = np.zeros(0, np.int64), np.zeros(0, complex)
        self.counts, self.stops, self.letter = (np.zeros(0, bool) for _ in range(3))

    def trim(self) -> None:
        kept = self.tokens.shrink()
        if kept is not None:
            self.word, self.value, self.counts, self.stops, self.letter = (x[kept] for x in (self.word, self.value, self.counts, self.stops, self.letter))

    def learn(self, fresh: list[str]) -> None:
        words = [clean_piece(t) for t in fresh]
        cut = list(map(forms, words))
        parts = list(set().union(*cut))
        value = dict(zip(parts, self.value_of(parts).tolist(), strict=True))
        n, flag = len(fresh), lambda xs: np.fromiter(xs, bool, len(fresh))
        self.word = np.concatenate([self.word, np.fromiter(map(hash, words), np.int64, n)])  # equality within this process
        self.value = np.concatenate([self.value, np.fromiter((sum(map(value.__getitem__, ps)) for ps in cut), complex, n)])
        self.counts = np.concatenate([self.counts, flag(map(bool, cut))])
        self.stops = np.concatenate([self.stops, flag(t.rstrip("\"')]}")[-1:] in tuple(".!?") for t in fresh)])
        self.letter = np.concatenate([self.letter, flag(len(t) < 3 and LETTER.fullmatch(t) is not None for t in fresh)])

    def numbered(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number, codes, fresh = self.tokens.look_up(strings)
        if fresh:
            self.learn(fresh)
        return number, codes

    def bags(self, texts: pa.Array) -> Bags:
        self.trim()
        tokens, n = split_words(texts)
        number, codes = self.numbered(tokens)
        row = np.repeat(np.arange(len(texts)), n)
        at, letter, stops = np.arange(len(codes)), self.letter[number][codes], self.stops[number][codes]
        head = np.ones(len(codes), bool)
        head[1:] = (row[1:] != row[:-1]) | stops[:-1]
        since = at - np.maximum.accumulate(np.where(head, at, 0))
        sentence = np.cumsum(head | (since % SPAN == 0)) - 1
        rows = row[head | (since % SPAN == 0)]
        # Two single letters in a row may begin a word that is spelled out.
        maybe = np.unique(row[1:][letter[1:] & letter[:-1] & (row[1:] == row[:-1])])
        joined = [(i, w) for i in maybe.tolist() for w in spelled(texts[i].as_py())]
        if joined:
            more, own = self.numbered(pa.array([w for _, w in joined], pa.string()))
            codes = np.concatenate([codes, own + len(number)])
            number = np.concatenate([number, more])
            sentence = np.concatenate([sentence, len(rows) + np.arange(len(joined))])
            rows = np.concatenate([rows, [i for i, _ in joined]])
            order = np.argsort(rows, kind="stable")
            rows, place = rows[order], np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows))
            sentence = place[sentence]
        _, first, word = np.unique(self.word[number], return_index=True, return_inverse=True)
        entries = (sentence * len(first) + word[codes])[self.counts[number][codes]]
        entries = np.unique(entries)
        size = max(1, len(first))
        sentence, word, token = entries // size, entries % size, number[first]
        whole = np.unique(rows[sentence] * size + word)
        used, sentence, words = np.unique(sentence, return_inverse=True, return_counts=True)
        return Bags(rows[used], words, sentence, token[word], whole // size, token[whole % size])

    def margins(self, texts: pa.Array, bias: complex) -> tuple[Bags, np.ndarray, np.ndarray]:
        """Every sentence's margin and every text's, if ``value_of`` gives the words' part in them."""
        bags, n = self.bags(texts), len(texts)
        sentences = bias.real + np.bincount(bags.sentence, self.value.real[bags.token], len(bags.row)) / np.sqrt(bags.words)
        words = np.bincount(bags.whole_row, minlength=n)
        return bags, sentences, bias.imag + np.bincount(bags.whole_row, self.value.imag[bags.whole_token], n) / np.sqrt(np.maximum(words, 1))


def worst(bags: Bags, margins: np.ndarray, n: int, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` texts: the place of its sentence with the highest margin, -1 without any; that margin, or the bias."""
    order = np.lexsort((np.arange(len(margins)), -margins, bags.row))
    rows, first = np.unique(bags.row[order], return_index=True)
    place, margin = np.full(n, -1), np.full(n, bias)
    place[rows] = order[first]
    margin[rows] = margins[order[first]]
    return place, margin


def _chosen(marks, alpha: np.ndarray, bias: complex, kinds: int):
    """Each text's margins and its kernels with the landmarks of ``kinds`` bags: of its worst sentence, then of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Projection(marks.value, alpha))
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text")
                bags, margins, whole = reader.margins(texts, bias)
                place, margin = worst(bags, margins, len(texts), bias.real)
                x = np.zeros((0, len(marks.value)), np.float32)
                if kinds:
                    new = np.full(len(bags.row) + 1, -1)
                    new[place] = np.arange(len(texts))
                    kept = new[:-1][bags.sentence] >= 0
                    # A row has ``kinds`` instances: its sentence, then all its words.
                    token, instance = bags.token[kept], kinds * new[bags.sentence[kept]]
                    if kinds > 1:
                        token, instance = np.concatenate([token, bags.whole_token]), np.concatenate([instance, kinds * bags.whole_row + 1])
                    words, word = np.unique(token, return_inverse=True)
                    cut = [forms(clean_piece(t)) for t in reader.tokens.strings.take(pa.array(words)).to_pylist()]
                    many = np.fromiter(map(len, cut), np.int64, len(cut))
                    times = many[word]
                    entry = np.arange(times.sum()) + np.repeat((np.cumsum(many) - many)[word] - np.cumsum(times) + times, times)
                    x = reader.value_of.tree.summed([p for ps in cut for p in ps], entry, np.repeat(instance, times), kinds * len(texts))
                    x /= np.sqrt(np.maximum(np.bincount(instance, minlength=len(x)), 1))[:, None].astype(np.float32)
                edge = np.arange(len(texts) + 1, dtype=np.int32) * (kinds * x.shape[1])
                flat = pa.ListArray.from_arrays(pa.array(edge), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(margin), pa.array(whole), flat], ["doc_id", "margin", "whole", "x"])

    return run


def _witness_counts(toxic_ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = toxic_ids.value
        for batch in batches:
            for part in pieces(batch):
                found: set[tuple[str, int, int]] = set()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    label = wanted[doc_id]
                    for sentence in SENTENCE.split(text):
                        bag = [clean_piece(w) for w in sentence.split()]
                        around = ["", *bag, ""]
                        found.update((p, hash_of(around[i], around[i + 2]), label) for i, w in enumerate(bag) for p in forms(w))
                        found.update((p, 0, label) for w in spelled(sentence.lower()) for p in forms(w))
                counted = Counter(found)
                keys = list(counted)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32())], ["piece", "around", "toxic"])

    return run


def hash_of(a: str, b: str) -> int:
    import zlib

    return zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass"))


def _margins(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        reader = Reader(Projection(m.landmarks, m.alpha))
        for batch in batches:
            for part in pieces(batch):
                bags, margins, whole = reader.margins(part.column("text"), m.bias)
                _, margin = worst(bags, margins, part.num_rows, m.bias.real)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(margin), pa.array(whole)], ["doc_id", "held_out", "margin", "whole"])

    return run


def sample(labels: DataFrame, folds: int = FOLDS) -> dict[int, int]:
    """doc_id and label of the training sample; a doc_id with both labels is toxic."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    out: dict[int, int] = {}
    for value, most in ((1, TOXIC), (0, CLEAN)):
        found = rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        out |= {r[0]: value for r in found}
    return out


def train(texts: DataFrame, labels: DataFrame) -> Model:
    sc, chosen = texts.sparkSession.sparkContext, sample(labels)
    n_toxic = sum(chosen.values())
    if not n_toxic or n_toxic == len(chosen):
        share = 0.0 if not chosen else n_toxic / len(chosen)
        return Model([], 0, np.zeros(0), 0j, (0.0, 0.0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    ids = texts.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")  # at most TOXIC + CLEAN rows
    texts = written(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "labelled")
    one = lambda v: F.sum(F.when(F.col("toxic") == v, 1).otherwise(0))
    counts = texts.mapInArrow(_witness_counts(sc.broadcast(chosen)), "piece string, around long, toxic int").distinct().groupBy("piece").agg(one(1).alias("t"), one(0).alias("c"))
    counts = written(counts, "pieces")
    clean = len(chosen) - n_toxic
    ratio = ((F.col("t") + 0.5) / n_toxic) / ((F.col("c") + 0.5) / clean)
    # So many neighbourhoods, all toxic, that chance gives it to one piece in a hundred samples at most.
    tested = counts.where("t + c >= 3").count()
    chance = int(np.ceil(np.log(0.01 / max(1, tested)) / np.log(n_toxic / len(chosen))))
    for enough in (chance, 3):  # the latter for samples too small to tell
        found = [r[0] for r in counts.where((F.col("t") >= enough) & (ratio >= 20)).orderBy(F.desc("t"), "piece").collect()]
        if found:
            break
    usual = counts.where((F.col("c") > 0) & (F.length("piece") >= ORDER))
    others = [r[0] for r in usual.orderBy(F.desc("c"), "piece").limit(OTHERS // 3).collect()]
    others += [r[0] for r in usual.orderBy(F.xxhash64("piece"), "piece").limit(OTHERS).collect()]
    if not found or not others:
        return Model([], 0, np.zeros(0), 0j, (0.0, 0.0), float(np.log(n_toxic / clean)))
    marks = landmarks(found, others)
    shared = sc.broadcast(marks)
    alpha, bias = np.where(np.arange(len(marks)) < len(found), 1.0, -1.0).astype(complex), 0j  # chooses the first sentences
    for step in range(ROUNDS + 1):
        kinds = 2 if not step else int(step < ROUNDS)  # the last round takes margins alone
        seen = texts.mapInArrow(_chosen(shared, alpha, bias, kinds), "doc_id long, margin double, whole double, x array<float>").toArrow()  # a row for each document of the sample
        if not kinds:
            break
        y = np.array([chosen[i] for i in seen.column("doc_id").to_pylist()], float)
        x = seen.column("x").combine_chunks().flatten().to_numpy().reshape(seen.num_rows, kinds, len(marks))
        if not step:
            whole, whole_bias = separate(marks, x[:, 1].astype(float), y, np.ones(len(y)))
        sentence, sentence_bias = separate(marks, x[:, 0].astype(float), y, np.ones(len(y)))
        alpha, bias = sentence + 1j * whole, sentence_bias + 1j * whole_bias
    y = np.array([chosen[i] for i in seen.column("doc_id").to_pylist()], float)
    margins = np.stack([seen.column(c).to_numpy() for c in ("margin", "whole")], axis=1)
    return Model(marks, len(found), alpha, bias, *logistic(margins, y))


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts = doc_text(docs).withColumn("held_out", crc_bucket(F.col("doc_id"), folds) == 0)
    model = train(texts, labels)
    if model.landmarks:
        rows = texts.mapInArrow(_margins(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, margin double, whole double")
    else:
        rows = texts.select("doc_id", "held_out", F.lit(0.0).alias("margin"), F.lit(0.0).alias("whole"))
    line = F.col("margin") * model.slopes[0] + F.col("whole") * model.slopes[1] + model.shift
    line = F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))
    rows = rows.select("doc_id", "held_out", (1 / (1 + F.exp(-line))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
