import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from quern.llm import packing
from quern.llm.tokens import Encoder, KEPT_ENTRIES

TEXTS = ["", " ", "  a", "it's  don't\n\n x \n y", "a<|endoftext|> b <|endoftext|>", "x" * 3000, "日本語 テキスト 1234 +1 (5)", "a \nb", "a\n b", "foo' bar'", "a\x1cb c", " lead", "trail ", "\n", "a\n", "b \n", "we'll we'LL 'tis", "Größe, Maß. ñandú; (x)", "a\u00a0b \u00a0c", "one.\nTwo three,\nfour"]


def test_cached_encoding_equals_the_tokenizer(tokenizer):
    exact, mine = Tokenizer.from_file(tokenizer), Encoder(tokenizer, entries=4)
    for text in TEXTS + [" ".join(TEXTS)]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_caches_hold_no_more_than_their_bound_together(tokenizer):
    mine = Encoder(tokenizer, entries=100)
    for i in range(500):
        mine.encode(f"a word{i}x, letters{i}? {chr(97 + i % 26) * (1 + i // 26)}, b")
        assert len(mine.spaced) + len(mine.plain) <= 100


def test_workers_keep_few_words_after_packing(spark, tokenizer):
    docs = spark.range(0, 1600, 1, 8).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 1000), i -> concat('w', id, 'x', i))) AS text")
    assert packing.pack(docs, tokenizer).count() >= 1600

    def words(batches):
        import pyarrow as pa

        from quern.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.spaced) + len(e.plain) for e in tokens._ENCODERS.values())])], names=["n"])

    assert max(r.n for r in spark.range(0, 64, 1, 8).mapInArrow(words, "n bigint").collect()) <= 2 * KEPT_ENTRIES


def check(pieces, limits):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        total = sum(p.length for p in parts)
        assert total <= limits.tokens and len(parts) <= limits.segments and sum(p.loss_tokens for p in parts) <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0
    return by_doc


def test_pieces_hold_each_id_once(spark, tokenizer):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta"], size=int(rng.integers(0, 900))))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    exact = Tokenizer.from_file(tokenizer)
    for limits in (packing.Limits(), packing.Limits(256, 3, 256)):
        by_doc = check(packing.pack(docs, tokenizer, limits).collect(), limits)
        for i, text in rows:
            ids, at = [*exact.encode(text, add_special_tokens=False).ids, 1], 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)


def test_loss_limit(spark, tokenizer):
    rows = [(i, "a b c d e f g h", [True] * 4 + [False] * 4) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, loss array<boolean>").coalesce(1)
    limits = packing.Limits(64, 50, 20)
    by_doc = check(packing.pack(docs, tokenizer, limits).collect(), limits)
    assert all(sum(p.length for p in parts) == 9 and sum(p.loss_tokens for p in parts) == 4 for parts in by_doc.values())


def test_a_million_short_examples():
    """One class, however many examples: the time a pick takes does not grow with the pool."""
    import time

    ids, began = np.zeros(1, np.uint32), time.time()
    sizes = [len(s) for s in packing.pack_examples((packing.Example(i, ids, None) for i in range(1_000_000)), packing.Limits())]
    assert sum(sizes) == 1_000_000 and set(sizes[:-7]) == {128} and time.time() - began < 60


def test_random_demands_under_tight_limits():
    rng = np.random.default_rng(8)
    for limits in (packing.Limits(64, 5, 20), packing.Limits(128, 3, 128), packing.Limits(32, 100, 1)):
        examples = []
        for i in range(400):
            ids = np.arange(int(rng.integers(1, 200)), dtype=np.uint32)
            flags = rng.random(len(ids)) < rng.random()
            examples.append(packing.Example(i, ids, None if i % 3 == 0 else np.concatenate([[0], flags.cumsum()])))
        held = {i: [] for i in range(400)}
        for sequence in packing.pack_examples(iter(examples), limits):
            total = sum(b - a for _, a, b in sequence)
            assert 0 < total <= limits.tokens and len(sequence) <= limits.segments and sum(e.loss_of(a, b) for e, a, b in sequence) <= limits.loss
            assert total == limits.tokens or total & (total - 1) == 0
            for e, a, b in sequence:
                held[e.doc_id].append((a, b))
        for e in examples:
            parts = sorted(held[e.doc_id])
            assert parts[0][0] == 0 and parts[-1][1] == len(e.ids) and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))


def test_odd_rows(spark, odd_docs, tokenizer):
    pieces = packing.pack(odd_docs, tokenizer).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 5, 6, None}
    assert sum(p.length for p in pieces if p.doc_id == 5) == 2 * sum(p.length for p in pieces if p.doc_id == 4)
    assert packing.pack(odd_docs.where("false"), tokenizer).count() == 0
