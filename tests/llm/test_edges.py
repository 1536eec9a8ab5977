"""Every operator and pipeline stage on rows that go wrong: nulls, empty and very long texts, ties, repeats, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "key", "c", "word", "fp", "w", "h", "g", "th", "size", "bucket", "found", "doc", "keep", "draw", "component_id", "ids", "start", "target", "taken", "n_words", "held_out", "score", "dropped", "times", "bar"]
LONG = "lorem ipsum dolor " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again, idiot!", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id here but some words", "en", "b", 3),
    (None, None, None, None, None),
    (4, " \t\n ", "en", "b", 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, "x" * 60_000, "en", None, 7),
    (7, "dup text here with several words in it", "en", "a", 1),
    (7, "dup text here with several words in it", "en", "a", 1),
    (8, "dup text here with several words in it", "en", "c", 1),
    (9, "é日本 \U0001f600 mail a.b@c.de call +1 (555) 555-1234, host 1.2.3.4, card 4111 1111 1111 1111", "fr", "c", 9),
    (10, "ein zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "a", 1),
]


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1, 1), (5, 1, 0), (6, 0, 0), (7, 1, 0), (8, None, None), (None, 1, 1), (10, 0, 0), (1, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def items(spark, empty=False):
    rows = [] if empty else [(1, "eins zwei drei"), (2, "zwei drei"), (3, None), (4, "..."), (None, "zwei"), (5, "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"), (5, "lorem ipsum")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("key", F.lit(1))


def words(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lm_score(spark):
    from quillspark.llm.lm_score import score

    found = score(docs(spark)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    train = [words(t) for i, t, *_ in ROWS if not held(i)]
    counts = {}
    for ws in train:
        for w in [*ws, "<end>"]:
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), "<end>"]), round(sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in [*words(t), "<end>"]), 6)) for i, t, *_ in ROWS), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found), key=str) == want
    assert all(r.train_tokens == total and r.score <= 0 for r in found)
    assert score(docs(spark, [])).count() == 0
    (alone,) = score(docs(spark, [(i, "a b", None, None, None) for i in range(60) if held(i)][:1])).collect()
    assert alone.train_tokens == 0 and alone.n_known == 0


def test_lm_probabilities_sum_to_one(spark):
    from quillspark.llm import lm_score

    rows = [(i, "a b c a b d a b c " * 20 + "z", None, None, None) for i in range(20)]
    _, model = lm_score.train(docs(spark, rows))
    assert model.levels and len(model.levels[0].contexts)
    every = np.arange(model.n_symbols + 2)
    for depth, level in enumerate(model.levels, 1):
        for context in level.contexts:
            p = lm_score.probabilities(model, np.full(len(every), context), every, depth)
            assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_simhash(spark):
    from quillspark.llm.simhash import near_duplicates

    found = as_rows(near_duplicates(docs(spark)).select("doc_id", "fingerprint", "component_id"))
    assert len(found) == len(ROWS)
    by_id = {r[0]: r for r in found}
    assert by_id[2][1] == by_id[3][1] == by_id[4][1] == "0" * 16 and by_id[3][2] == by_id[4][2] == by_id[2][2] == 2
    assert by_id[7][2] == by_id[8][2] == 7 and by_id[None][2] is None
    assert near_duplicates(docs(spark, [])).count() == 0


def test_simhash_cells_match_brute_force():
    from quillspark.llm import simhash

    rng = np.random.default_rng(5)
    for n in (2, 3, 63, 64, 65, 300):
        centre = rng.integers(-(2**63), 2**63 - 1, size=max(1, n // 7))
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(n)], dtype=np.uint64)
        fps = np.unique(rng.choice(centre, n).view(np.uint64) ^ flips).view(np.int64)
        a, b = (x.view(np.int64)[:, 0] for x in simhash.cell_links([fps.view(np.uint64)[:, None], np.array([[1], [2]], np.uint64)]))
        parent = {int(x): int(x) for x in [*fps, 1, 2]}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def classes(pairs):
            for k in parent:
                parent[k] = k
            for x, y in pairs:
                parent[root(int(x))] = root(int(y))
            return {frozenset(k for k in parent if root(k) == r) for r in map(root, parent)}

        near = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") <= 3]
        assert classes(zip(a, b, strict=True)) == classes([*near, (1, 2)])


def test_wide_cells_match_brute_force():
    """Four lanes, a wide radius, blocks that are linked already: the same classes as from all pairs."""
    from quillspark.llm import simhash

    rng, radius = np.random.default_rng(8), 44
    for n in (3, 64, 65, 400):
        bits = rng.integers(0, 2, (max(1, n // 40), 256), np.uint8)[rng.integers(0, max(1, n // 40), n)]
        for row in bits:
            row[rng.choice(256, rng.integers(0, 40), replace=False)] ^= 1
        bits = np.unique(bits, axis=0)
        fps = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        a, b = simhash.cell_links([fps], radius)
        label = np.arange(len(fps))
        place = {x.tobytes(): i for i, x in enumerate(fps)}
        near = np.argwhere((bits[:, None] != bits[None]).sum(axis=2) <= radius)
        want = simhash.merge(label.copy(), near[:, 0], near[:, 1])
        i, j = (np.array([place[x.tobytes()] for x in side], int) for side in (a, b))
        assert (simhash.merge(label.copy(), i, j) == want).all()


def test_simhash_splits_large_cells(spark, monkeypatch):
    from quillspark.llm import simhash

    rng = np.random.default_rng(2)
    fps = spark.createDataFrame([(bytearray(int(x).to_bytes(8, "little")),) for x in np.unique(rng.integers(0, 2**12, 400))], "fp binary")
    pairs = lambda chunk: {tuple(sorted(map(bytes, p))) for r in simhash.cells(fps, chunk=chunk).collect() for i, x in enumerate(r.fps) for y in r.fps[:i] for p in [(x, y)]}
    want = pairs(10_000)
    assert pairs(50) == want
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    assert pairs(50) == want


def test_similar_documents(spark, sf_dir):
    """Against all pairs: classes join what has a similarity well above 0.8 and nothing well below it."""
    from quillspark.llm import simhash
    from quillspark.llm.common import word_list

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rng = np.random.default_rng(4)
    base = max(rows)
    for i in list(rows)[:60]:  # copies with some words changed
        words = (rows[i] or "").split()
        for k in rng.choice(len(words), len(words) // 100, replace=False) if words else ():
            words[k] = f"changed{k}"
        rows[base + 1 + i] = " ".join(words)
    docs = spark.createDataFrame([*rows.items(), (None, "only here"), (None, None)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert found[None] is None and len(found) == len(rows) + 1
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows.items() for w in [word_list(t or "")]}
    pairs = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in rows for j in rows if j < i}
    high = [found[i] == found[j] for (i, j), s in pairs.items() if s >= 0.85]
    assert len(high) > 50 and sum(high) / len(high) > 0.97
    for i in rows:  # a class's documents are tied by a chain of similar ones
        if found[i] != i:
            assert max(s for (x, y), s in pairs.items() if i in (x, y) and found[x] == found[y]) > 0.6


def test_components(spark):
    from quillspark.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (500, 400)]
    found = dict(as_rows(components(spark.createDataFrame(chain, "a long, b long"))))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pii(spark):
    from quillspark.llm.pii import personal_data

    found = {r.doc_id: r for r in personal_data(docs(spark)).collect() if r.doc_id}
    r = found[9]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    text = dict((x[0], x[1]) for x in ROWS)[9]
    spans = [s.split(":") for s in r.spans.split(",")]
    assert {"email": "a.b@c.de", "ip": "1.2.3.4", "phone": "+1 (555) 555-1234"}.items() <= {k: text[int(a) : int(b)] for k, a, b in spans}.items()
    for i in (2, 3, 5, 6, 7):
        assert found[i].spans == "" and found[i].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert personal_data(docs(spark)).count() == len(ROWS) and personal_data(docs(spark, [])).count() == 0


def test_token_output(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillspark.llm.token_output import encode_documents

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in sorted(((r[0], r[1] or "") for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert as_rows(encode_documents(docs(spark))) == sorted(want, key=str)
    assert encode_documents(docs(spark, [])).count() == 0


def test_webp(spark):
    from quillspark.llm.webp import media

    found = media(docs(spark)).collect()
    assert len(found) == len(ROWS)
    for r in found:
        text = [t for i, t, *_ in ROWS if i == r.doc_id]
        data = {(t or "").encode() for t in text}
        padded = {d + b"\0" * (-len(d) % 64 or (0 if d else 64)) for d in data}
        assert r.n_bytes in map(len, data) and r.payload_sha256 in {hashlib.sha256(p).hexdigest() for p in padded}
        assert r.tail_crc32 in {zlib.crc32(p[-64:]) for p in padded} and r.payload_bytes % 64 == 0 and len(r.feature) == 16
    assert len({(r.media_sha256, r.feature) for r in found if r.doc_id in (7, 8)}) == 1
    assert media(docs(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [200_000, -1])
def test_decontamination_of_long_copies(spark, monkeypatch, rows):
    """Documents with many common hashes, and a phrase of every item in every document, with tables broadcast and shuffled."""
    import random

    from quillspark.llm import decontam

    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    r = random.Random(4)
    common = "this very phrase of ten words stands in every item here"
    item = {i: common + " " + " ".join(f"w{r.randrange(200)}" for _ in range(400)) for i in range(30)}
    text = {i: f"{common} " + " ".join(item[r.randrange(30)].split()[20 : 20 + r.randrange(380)] + [f"x{k}" for k in range(9)]) for i in range(40)}
    text[40] = " ".join(f"y{k}" for k in range(50))
    found = {x.doc_id: x for x in decontam.decontaminate(spark.createDataFrame([*text.items()], "doc_id long, text string"), spark.createDataFrame([*item.items()], "item_id long, text string")).collect()}
    windows: dict = {}
    for i, t in item.items():
        w = t.split()
        for k in range(len(w) - 9):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for i, t in text.items():
        w = t.split()
        hits = [k for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows]
        names = sorted(set().union(*(windows[tuple(w[k : k + 10])] for k in hits)))
        want = (len(w), len({p for k in hits for p in range(k, k + 10)}), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hits))
        x = found[i]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == want


def test_decontamination(spark):
    from quillspark.llm.decontam import decontaminate

    found = {r.doc_id: r for r in decontaminate(docs(spark), items(spark)).collect() if r.doc_id}
    assert (found[10].n_words, found[10].n_hit, found[10].n_items) == (11, 11, 2)
    assert found[10].items_sha256 == hashlib.sha256(b"2,5").hexdigest()
    assert (found[5].n_words, found[5].n_hit, found[5].n_items) == (12_000, 8_000, 1)
    assert found[2].n_words == 0 and not found[2].contaminated and found[6].n_words == 1
    assert decontaminate(docs(spark), items(spark)).count() == len(ROWS)
    assert decontaminate(docs(spark), items(spark, empty=True)).where("contaminated").count() == 0
    assert decontaminate(docs(spark, []), items(spark)).count() == 0


def test_url_filter(spark):
    from quillspark.llm.url_filter import judge

    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?q#f", "http://a.example.com/en/2", "http://x.net/es/", "http://x.net?es/", "a://b.net/fr/1://c", "http://com", "http://y.org/" + "a/" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4]), (None, urls[5])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    found = {(r.page_id, r.host): r for r in judge(pages).collect()}
    assert len(judge(pages).collect()) == len(urls) + 2
    assert found[4, "www.example.com"].rule == "www.example.com/en/" and found[4, "www.example.com"].verdict == "allow"
    assert found[5, "a.example.com"].rule == "example.com/en/" and found[6, "x.net"].verdict == "block"
    assert found[7, "x.net"].path == "" and found[7, "x.net"].rule is None and found[8, "b.net"].rule == "net/fr/"
    assert found[0, ""].path == "" and found[9, "com"].rule is None and all(r.verdict in ("allow", "block") for r in found.values())
    assert judge(pages.limit(0)).count() == 0


def test_mixing(spark):
    from quillspark.llm.mixing import mix

    found = mix(docs(spark)).collect()
    assert len(found) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in found)
    assert {r.taken for r in found if not r.size} == {0}
    assert as_rows(mix(docs(spark))) == as_rows(mix(docs(spark).repartition(7)))
    assert mix(docs(spark, [])).count() == 0
    assert {r.target for r in mix(docs(spark, [(1, "", None, None, None)])).collect()} == {0.0}


@pytest.mark.parametrize("n_sources", [1, 2, 3, 5, 9])
def test_water_filling(spark, n_sources):
    from quillspark.llm.mixing import source_targets

    sizes = {f"s{i}": (i * 7919) % 97 + 1 for i in range(n_sources)}
    found = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
        free -= over
        left -= sum(want[s] for s in over)
    want |= {s: level * weight[s] for s in free}
    assert found.keys() == want.keys() and all(math.isclose(found[s], want[s]) for s in want)


def test_quality(spark):
    from quillspark.llm.quality import resample

    assert resample(docs(spark), labels(spark)).count() == len(ROWS)
    everything = resample(docs(spark), labels(spark, empty=True)).collect()
    assert len(everything) == len(ROWS) and all(r.keep for r in everything)
    assert resample(docs(spark, []), labels(spark)).count() == 0


def test_top_k_is_exact(spark):
    from quillspark.llm.quality import top_k

    rows = spark.createDataFrame([(i, float(i * 7 % 50) / 1000, i) for i in range(200)], "row long, draw double, x long")
    for k in (0, 1, 77, 199, 200):
        want = sorted(((i * 7 % 50) / 1000, -i) for i in range(200))[::-1][:k]
        assert {-i for _, i in want} == {r.x for r in top_k(rows, k).where("keep").collect()}


def test_toxicity(spark):
    from quillspark.llm.toxicity import score

    found = score(docs(spark), labels(spark)).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.score < 0.5 for r in score(docs(spark), labels(spark, empty=True)).collect())
    assert score(docs(spark, []), labels(spark)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        df = docs(spark, rows)
        df.write.parquet(f"{tmp_path}/documents{len(rows)}.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            source = spark.read.parquet(f"{tmp_path}/documents{len(rows)}.parquet")
            out = stage(spark, source, str(tmp_path))
            assert out.columns == source.columns, name
            n = out.count()
            assert n <= 2 * len(rows) and (n > 0 or not rows), name
    source = spark.read.parquet(f"{tmp_path}/documents{len(ROWS)}.parquet")
    kept = [r.doc_id for r in corpus_pipeline.distinct_documents(spark, source, str(tmp_path)).collect() if r.doc_id]
    assert kept.count(7) == 1 and 8 not in kept and 2 in kept and 3 not in kept
