import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import langid, token_store
from quern.llm.tokens import TOGETHER, Encoder


def test_checksums_join():
    rng = np.random.default_rng(0)
    texts = [[rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in sizes] for sizes in ((0, 1, 5, 4096, 77), (9,), (100_003, 0, 3))]
    parts = [p for t in texts for p in t]
    crc, size = np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts])
    assert token_store.joined_crc(crc, size, np.array([0, 5, 6])).tolist() == [zlib.crc32(b"".join(t)) for t in texts]


def test_cuts_depend_on_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60_000, dtype=np.uint32)
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    moved = {e - 1000 for e in token_store.cuts(np.concatenate([rng.integers(0, 50_000, 1000, dtype=np.uint32), ids]))}
    assert len(moved & set(ends)) > 0.9 * len(ends)
    assert token_store.cuts(np.zeros(10_000, np.uint32))[-1] == 10_000 and token_store.cuts(np.zeros(0, np.uint32)) == []


ATOMS = [
    "a", "Word", "é", "÷", "×", "ß", "Ā", "я", "слово", "日本", "\U0001f600", "\u0301", "ª", "µ", "1", "23", "²", "Ⅷ", "٣", "'", "'s", "'LL", " 's", ",", ".", "—", "’", '"',
    " ", " ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x00", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u200b", "<|endoftext|>", "  <|endoftext|> ", "<|endof", "text|>",
]


def test_texts_encoded_together_equal_the_tokenizer(tokenizer):
    rng = np.random.default_rng(4)
    exact, mine = Tokenizer.from_file(tokenizer), Encoder(tokenizer, entries=300)
    for kind in (pa.string(), pa.large_string()):
        for size in (0, 1, 2, 400, 400):
            texts = ["".join(rng.choice(ATOMS, int(n))) for n in rng.integers(0, 14, size + 2)]
            ids, ends = mine.encode_all(pa.array(texts, kind).slice(1, size))
            assert len(ends) == size and len(ids) == (ends[-1] if size else 0)
            for text, (start, end) in zip(texts[1:], pairwise([0, *ends.tolist()])):
                assert ids[start:end].tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)
            assert mine.held() <= 300


def test_new_words_are_tokenized_together_and_once(tokenizer):
    mine, calls = Encoder(tokenizer), []

    class Counted:
        def tokenize(self, text, model=mine.model):
            calls.append(text)
            return model.tokenize(text)

    mine.model = Counted()
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice([*"abcdefgé"], 9)) for _ in range(2000)}
    text = "x " + " ".join([*words, *words])
    first, _ = mine.encode_all(pa.array([text, "", text]))
    assert len(calls) <= 2 + len(words) / TOGETHER
    ids = Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids
    assert first.tolist() == ids + ids
    calls.clear()
    assert mine.encode_all(pa.array([text]))[0].tolist() == ids and not calls


def test_slices_bring_every_row_once(monkeypatch):
    monkeypatch.setattr(token_store, "SLICE", 10)
    texts = ["", "é" * 30, "", "a" * 4, "b" * 4, "c" * 4, "", "d" * 11, ""]
    found = list(token_store._slices(pa.array(range(len(texts))), pa.array(texts)))
    assert [t for _, part in found for t in part.to_pylist()] == texts and [i for ids, _ in found for i in ids.to_pylist()] == list(range(len(texts)))
    assert all(len(part) == 1 or sum(len(t.encode()) for t in part.to_pylist()) <= 10 for _, part in found) and len(found) < len(texts)
    assert list(token_store._slices(pa.array([], pa.int64()), pa.array([], pa.string()))) == []


def test_round_trip_and_single_storage(spark, tokenizer, tmp_path):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta,", "Gamma", "naïve", "delta\n"]
    texts = [" ".join(rng.choice(words, size=int(n))) for n in (0, 1, 40, 3000, 3000, 9000)]
    rows = [(50 - 7 * i, t) for i, t in enumerate([*texts, texts[5], None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, tokenizer)
    exact = Tokenizer.from_file(tokenizer)
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    found, start = {r.doc_id: r for r in token_store.read_digests(spark, path).collect()}, 0
    for i in sorted(ids):
        r = found[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    assert {r.doc_id: r.ids for r in token_store.read_ids(spark, path).collect()} == ids
    chunks = token_store.chunks(spark, path)
    assert chunks.count() == chunks.select("address").distinct().count()
    manifest = spark.read.parquet(f"{path}/manifest")
    assert manifest.agg(F.sum("n_tokens")).first()[0] == start and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)


def test_a_changed_chunk_is_noticed(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id bigint, text string")
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, tokenizer)
    staged = spark.read.schema(token_store.STAGED).parquet(f"{path}/staged")
    kept = [tuple(r) for r in staged.collect()]
    spoiled = [(k, key, d, n, w, bytes([ids[0] ^ 1]) + ids[1:] if ids else None, r, a) for k, key, d, n, w, ids, r, a in [(r[-1], *r[:-1]) if isinstance(r[-1], int) and not isinstance(r[0], int) else r for r in kept]]
    spark.createDataFrame(spoiled, token_store.STAGED).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/staged2")
    import os
    import shutil

    shutil.rmtree(f"{path}/staged")
    os.rename(f"{path}/staged2", f"{path}/staged")
    with pytest.raises(Exception, match="does not match"):
        token_store.read_digests(spark, path).collect()


def rewritten(spark, path, change):
    """The store's recipes as ``change`` leaves them, one file a shard."""
    rows = change(spark.read.schema(token_store.RECIPES).parquet(f"{path}/recipes"))
    rows.cache().count()
    held = spark.createDataFrame(rows.collect(), rows.schema)
    held.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/recipes")


@pytest.mark.parametrize("spoil", ["lost", "doubled", "swapped", "renamed", "empty shard"])
def test_changed_recipes_are_noticed(spark, tokenizer, tmp_path, spoil):
    docs = spark.createDataFrame([(i, f"alpha beta gamma {i}") for i in range(20)], "doc_id bigint, text string")
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, tokenizer)
    assert token_store.read_digests(spark, path).count() == 20
    one = F.col("kind").eqNullSafe(0) & (F.col("doc_id") == 7)
    changes = {
        "lost": lambda r: r.where(~F.coalesce(one, F.lit(False))),
        "doubled": lambda r: r.unionByName(r.where(one)),
        "swapped": lambda r: r.withColumn("position", F.when(F.col("kind") == 0, -F.col("position")).otherwise(F.col("position"))),
        "renamed": lambda r: r.withColumn("doc_id", F.when(one, 70).otherwise(F.col("doc_id"))),
        "empty shard": lambda r: r.where("kind = 1 OR shard <> 0"),
    }
    rewritten(spark, path, changes[spoil])
    with pytest.raises(Exception, match="do not match the manifest"):
        token_store.read_digests(spark, path).collect()
    with pytest.raises(Exception, match="do not match the manifest"):
        token_store.read_ids(spark, path).collect()


def test_store_odd_rows(spark, odd_docs, tokenizer, tmp_path):
    for name, docs in (("full", odd_docs), ("empty", odd_docs.where("false"))):
        path = str(tmp_path / name)
        token_store.write_store(docs, path, tokenizer)
        assert token_store.read_digests(spark, path).count() == docs.count()


TRAIN = [("en", "the cat and the dog went to the house of the king"), ("fr", "le chat et le chien sont dans la maison du roi"), ("de", "die katze und der hund sind in dem haus des königs"), ("ru", "кошка и собака пошли в дом короля")]


def model_of(spark):
    rows = [(4 * k + i, text, lang) for k in range(6) for i, (lang, text) in enumerate(TRAIN)]
    return langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_spans_of_mixed_text(spark):
    text = "the dog of the king went to the house кошка и собака le chien est dans la maison du roi et le chat"
    docs = spark.createDataFrame([(1, text), (2, "123 !!"), (3, None), (4, ""), (5, "собака 12")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in langid.label(docs, model_of(spark)).collect()}
    assert [s.lang for s in found[1].spans] == ["en", "ru", "fr"] and found[1].spans[1].first_word == 9
    assert [(found[i].lang, found[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3 and found[5].lang == "ru"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(40, 3)).astype(np.float32) * 3
    texts = [rng.integers(0, 40, n) for n in (5, 0, 7, 1)]
    from itertools import product

    for words, labels in zip(texts, langid.viterbi(texts, scores, 2.0)):
        total = lambda path, words=words: sum(scores[w, p] for w, p in zip(words, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = max((total(p) for p in product(range(3), repeat=len(words))), default=0)
        assert len(labels) == len(words) and abs(total(labels.tolist()) - best) < 1e-4


def test_langid_odd_rows(spark, odd_docs):
    held = langid.fit(odd_docs.where("lang IS NOT NULL AND text IS NOT NULL"))
    assert langid.label(odd_docs, held).count() == odd_docs.count()
    none = langid.fit(odd_docs.where("false").where("lang IS NOT NULL"))
    assert {r.lang for r in langid.label(odd_docs, none).collect()} == {"und"}
    assert langid.label(odd_docs.where("false"), held).count() == 0


def test_held_out_accuracy(spark):
    from quern.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    found = QUERIES["op9_language_spans"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
