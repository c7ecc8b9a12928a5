"""The pipeline's stages on a small corpus with planted cases, each against a plain computation."""

import random
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import pii

SOURCES = ["a", "b", "c", None]


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 8))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, group, junk = [], {}, set()

    def add(text, key):
        group[len(rows)] = key
        rows.append((len(rows), text, "en", SOURCES[len(rows) % 4], len(text)))

    for i in range(60):
        base = prose(rng.randrange(120, 400))
        if i % 7 == 0:
            base += f" write to user{i}@mail.example.com or +1 (200) 555-{1000 + i}"
        add(base, i)
        if i % 5 == 0:
            add(base, i)
        if i % 6 == 0:
            words = base.split(" ")
            words[3] = "changed"
            add(" ".join(words), i)
    for text in (prose(10), prose(100).upper(), " ".join(w + "$$$" for w in prose(100).split()), "same line of words\n" * 40, None, ""):
        junk.add(len(rows))
        group[len(rows)] = f"junk{len(rows)}"
        rows.append((len(rows), text, "en", "a", len(text or "")))
    return rows, group, junk


def test_stages(spark, tmp_path, tokenizer):
    rows, group, junk = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, folder)
        if name != "pack_sequences":
            assert docs.columns == columns
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
    texts = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in kept["quality_rules"]} == set(group) - junk
    assert Counter(group[r.doc_id] for r in kept["near_dedup"]) == Counter(range(60))
    assert all(r.text == texts[r.doc_id] for r in kept["near_dedup"])
    for r in kept["personal_data"]:
        spans, text = pii.base_spans(texts[r.doc_id]), texts[r.doc_id]
        for rank, a, b in reversed(spans):
            text = text[:a] + f"<{pii.KINDS[rank].upper()}>" + text[b:]
        assert r.text == text and r.n_chars == len(text)
    words = lambda r: len(r.text.split())
    sizes, mixed = defaultdict(int), defaultdict(int)
    for r in kept["personal_data"]:
        sizes[r.source] += words(r)
    for r in kept["mix_sources"]:
        mixed[r.source] += words(r)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e9
    for _ in range(200):  # the level at which the sources send the budget
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weight[s] * level, 2 * sizes[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, level)
    for s in names:
        assert abs(mixed[s] - min(weight[s] * low, 2 * sizes[s])) <= max(words(r) for r in kept["personal_data"] if r.source == s)
    assert max(Counter(r.doc_id for r in kept["mix_sources"]).values()) <= 2
    exact = Tokenizer.from_file(tokenizer)
    expected = sum(len(exact.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept["mix_sources"])
    assert sum(p.length for p in kept["pack_sequences"]) == expected
    sequence = defaultdict(int)
    for p in kept["pack_sequences"]:
        sequence[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequence.values())
    assert corpus_pipeline.run(spark, folder).groupBy().sum("length").first()[0] == expected


def test_empty_corpus(spark, odd_docs, tmp_path):
    odd_docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_corpus(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
