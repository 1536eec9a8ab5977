"""Nothing is left out: what a review of the operators found missing."""

from __future__ import annotations

import zlib


def test_toxicity_recall_by_language(spark):
    """Every language's cues are learnt, however many there are and however rare each one is."""
    import random

    from quillspark.llm.toxicity import score

    r = random.Random(7)
    letters = {"en": "bcdfgaeo", "de": "klmnpäiu", "fr": "qrstvéùa", "es": "hjwxzñóí"}
    word = lambda lang, n: "".join(r.choice(letters[lang]) for _ in range(n))
    usual = {lang: [word(lang, r.randint(3, 8)) for _ in range(60)] for lang in letters}
    cues = {lang: [word(lang, 9) for _ in range(9)] for lang in letters}
    rows = []
    for i in range(2400):
        lang, toxic = list(letters)[i % 4], int(i % 12 < 4)
        text = [r.choice(usual[lang]) for _ in range(12)]
        if toxic:
            text[r.randrange(12)] = cues[lang][i // 12 % 9]
        rows.append((i, " ".join(text), lang, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    found = {x.doc_id: x.predicted for x in score(docs, docs.select("doc_id", "toxic")).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    for lang in letters:
        caught = [found[i] for i, _, own, toxic in held if own == lang and toxic]
        assert sum(caught) / len(caught) > 0.8, lang
    clean = [found[i] for i, _, _, toxic in held if not toxic]
    assert sum(clean) / len(clean) < 0.05


def test_witnesses_come_from_whole_words():
    """A long unspaced run is counted to its end, not by its first letters alone."""
    from types import SimpleNamespace

    import pyarrow as pa

    from quillspark.llm.toxicity import WIDTH, _witness_counts

    late = "zyxwvutsrqponmlkjihgfedc"
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["ab" * (WIDTH // 2) + late]})
    counted = list(_witness_counts(SimpleNamespace(value={1: 1}))(iter([batch])))
    assert late in {p for b in counted for p in b.column("piece").to_pylist()}


def test_toxicity_training_holds_no_row_of_kernels_for_each_word():
    """Texts of sixty thousand different words, compared with two hundred landmarks."""
    import random
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quillspark.llm import toxicity

    rng = random.Random(4)
    marks = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(60_000)]

    class Shared:
        value = marks

    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": [" ".join(words[:30_000]), " ".join(words[30_000:])]})
    tracemalloc.start()
    found = list(toxicity._chosen(Shared, np.ones(200, complex), 0j, 2)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # rows of kernels for the words took 341 MB
    whole = sorted(set(words[:30_000]))
    x = np.array(found[0].column("x")[0].as_py()).reshape(2, 200)[1]
    assert np.allclose(x, toxicity.kernel(whole, marks).sum(axis=0, dtype=float) / len(whole) ** 0.5, rtol=1e-4)


def test_toxicity_kernel_sums_by_blocks(monkeypatch):
    """Sums of kernels don't depend on how many rows or additions are handled at once."""
    import numpy as np

    from quillspark.llm import toxicity

    strings, marks = ["idiot", "idioot", "edition", "table", "stupid", "stud"], ["idiot", "stupid"]
    entry, row = np.array([0, 1, 1, 2, 5, 4, 3, 0]), np.array([0, 0, 4, 2, 2, 2, 1, 4])
    each = np.stack([toxicity.raw_kernel(toxicity.codes(strings), m) for m in toxicity.codes(marks)], axis=1)
    each /= np.sqrt(toxicity.self_kernel(toxicity.codes(strings)))[:, None] * np.sqrt(toxicity.self_kernel(toxicity.codes(marks)))
    wanted = np.zeros((5, 2))
    np.add.at(wanted, row, each[entry])
    for profile, added in ((1 << 22, 1 << 20), (1, 1), (200, 3)):
        monkeypatch.setattr(toxicity, "PROFILE", profile)
        monkeypatch.setattr(toxicity, "ADDED", added)
        assert np.allclose(toxicity.Subsequences(toxicity.codes(marks)).summed(strings, entry, row, 5), wanted, rtol=1e-4)


def test_lm_deep_contexts_are_all_counted(spark):
    """Every run of six words that recurs in training texts raises the next word's probability, not a share of them."""
    import random

    from quillspark.llm import lm_score

    r = random.Random(8)
    phrases = [" ".join(r.choices("abcdef", k=7)) for _ in range(200)]
    trained = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2][:600]
    docs = spark.createDataFrame([(d, phrases[k % 200]) for k, d in enumerate(trained)], "doc_id long, text string")
    found = lm_score.score(docs).collect()
    assert len(found) == 600 and sum(x.score > x.near_score + 1e-6 for x in found) > 590


def test_lm_level_without_recurring_pairs(spark):
    """Contexts that occur twice, each time before another word, make no state and don't stop the query."""
    from quillspark.llm import lm_score

    trained = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    docs = spark.createDataFrame([(i, f"a b {w}1 {w}2") for i, w in zip(trained, "xy", strict=True)], "doc_id long, text string")
    assert lm_score.score(docs).count() == 2


def test_lm_sends_only_contexts_that_recur(spark, monkeypatch):
    """Runs of six words that training texts hold once take no room between the parts; those that recur are all sent."""
    import random

    from quillspark.llm import lm_score

    r, tables = random.Random(5), {}
    written = lm_score.written
    monkeypatch.setattr(lm_score, "written", lambda df, name, **options: tables.setdefault(name, written(df, name, **options)))
    rows = [(i, " ".join(str(r.randrange(5000)) for _ in range(300))) for i in range(200)]
    assert lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).count() == 200
    sent = sum(len(lm_score.unplaned(x.next, "<u4")) for x in tables.pop("scored").where("part is not null").select("next").collect())
    assert sent < 200 * 294 / 32  # chance alone
    copies = rows + [(1000 + i, t) for i, t in rows]
    tables.clear()
    lm_score.score(spark.createDataFrame(copies, "doc_id long, text string")).count()
    trained = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    owners = sum(int(lm_score.unplaned(x.owners, "<u4").sum()) for x in tables["scored"].where("part is not null").select("owners").collect())
    assert owners >= sum(2 * 295 for i, _ in rows if trained(i) and trained(1000 + i))


def test_lm_keys_shared_by_chance(spark, monkeypatch):
    """Scores don't depend on the keys' length: contexts that share a key are told apart by their whole hashes."""
    import random

    from quillspark.llm import lm_score

    r = random.Random(6)
    phrases = [" ".join(r.choices("abcdefghij", k=9)) for _ in range(60)]
    rows = [(i, " ".join(r.choices(phrases, k=3))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x.score for x in lm_score.score(docs).collect()}
    monkeypatch.setattr(lm_score, "SHARD", 1 << 10)
    for spare in (20, -8):
        monkeypatch.setattr(lm_score, "SPARE", spare)
        for x in lm_score.score(docs).collect():
            assert abs(x.score - found[x.doc_id]) < 1e-9, spare
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillspark_parts")]


def test_lm_lookups_and_hashes_match_brute_force():
    """Hash tables find exactly the keys that are there; words get their hash from all their bytes and their length; counts are summed by key."""
    import numpy as np
    import pyarrow as pa

    from quillspark.llm import lm_score

    r = np.random.default_rng(2)
    for n in (0, 1, 7, 50_000):
        wanted = np.unique(r.integers(0, 1 << 45, n))
        keys = np.concatenate([r.permutation(wanted), r.integers(-9, 1 << 45, 5000)])
        for again in (True, False):
            found, at = lm_score._member(keys, wanted, again)
            assert (found == np.isin(keys, wanted)).all() and (not n or (wanted[at[found]] == keys[found]).all())
    words = ["", "\0", "a", "a\0", "ab", "ba", "é", "abcdefgh", "abcdefgh\0", "abcdefghi", "iabcdefgh", "x" * 999, "x" * 1000, *map(str, range(100_000))]
    hashes = lm_score.word_hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(words)
    assert (lm_score.word_hashes(pa.array(["y", *words, "z"]).slice(1, len(words))) == hashes).all() and (lm_score.word_hashes(pa.array([""])) == hashes[:1]).all()
    keys, counts = r.integers(0, 90, 4000), r.integers(1, 9, 4000)
    every = np.unique(keys)
    for given, weights in ((None, np.ones(4000, int)), (counts, counts)):
        got, n = lm_score._summed(keys, given)
        assert (got == every).all() and (n == [weights[keys == k].sum() for k in every]).all()
