import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import golay, imatch, simhash
from quern.llm.components import stars


def test_golay_code_is_perfect():
    words = np.arange(0, 1 << 23, 997, dtype=np.uint32)
    index = golay.decode(words)
    message = index << np.uint32(11)
    codewords = message | golay._remainder(message)
    assert np.bitwise_count(codewords ^ words).max() <= 3


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000, dtype=np.uint32)
    keys, valid = golay.keys(x)
    assert set(valid.sum(1).tolist()) == {1, 6}
    for i in range(23):
        for j in range(i, 23):
            other, also = golay.keys(x[:200] ^ np.uint32(1 << i) ^ np.uint32((1 << j) * (i != j)))
            assert ((keys[:200, :, None] == other[:, None, :]) & valid[:200, :, None] & also[:, None, :]).any((1, 2)).all()


def simhash_64(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes, ids, most):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    group = {}
    for i in range(len(codes)):
        group.setdefault(find(i), []).append(ids[i])
    return [min(group[find(i)]) for i in range(len(codes))]


def near_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(300)] = word()
            texts.append(" ".join(copy).title())
    return texts + ["", "", None, "one", "one two", "ONE two"]


def test_links_equal_all_pairs(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: r for r in simhash.link_64(docs).collect()}
    codes, ids = [simhash_64(t or "") for t in texts], [100 - i for i in range(len(texts))]
    assert [found[i].fp & (2**64 - 1) for i in ids] == codes
    assert [found[i].component_id for i in ids] == components(codes, ids, 3)


def test_large_runs_link_like_short_ones():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    codes = np.concatenate([base ^ (np.uint64(1) << np.uint64(rng.integers(0, 60))) for _ in range(9)])[:, None]
    a, b = simhash._edges(np.zeros(len(codes), np.int64), np.arange(len(codes)), codes, 3)
    linked = components([int(c) for c in codes[:, 0]], list(range(len(codes))), 3)
    root = list(range(len(codes)))
    for x, y in zip(a.tolist(), b.tolist()):
        old, new = max(root[x], root[y]), min(root[x], root[y])
        root = [new if r == old else r for r in root]
    assert root == linked and len(a) < len(codes)


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(((F.col("id") * 37) % 61).alias("a"), (((F.col("id") + 1) * 37) % 61).alias("b"))
    found = stars(edges).collect()
    assert len(found) == 60 and {r.root for r in found} == {0}


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    rows, group = [], {}
    for g in range(40):
        base = [word() for _ in range(400)]
        for c in range(1 + g % 5):
            copy = list(base)
            for _ in range(3 * (c > 0)):
                copy[rng.randrange(400)] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "en"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    kept = simhash.keep_one(docs).collect()
    assert sorted(group[r.doc_id] for r in kept) == list(range(40))
    assert all(r.doc_id == min(i for i, g in group.items() if g == group[r.doc_id]) for r in kept)


def jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def edited_pair(rng, kind, share):
    """A text of 400 words and an edit of it at a shingle similarity next to ``share`` (exactly 0.8 is reached)."""
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    base = [word() for _ in range(404)]
    n = round(400 * (1 - share) if kind == "cut" else 400 * (1 / share - 1) if kind == "append" else 400 * (1 - share) / (1 + share))
    if kind == "cut":
        copy = base[: 404 - n]
    elif kind == "append":
        copy = base + [word() for _ in range(n)]
    elif kind == "block":
        copy = base[:100] + [word() for _ in range(n - 4)] + base[100 + n - 4 :]
    else:
        copy = list(base)
        for i in range(n // 5):
            copy[10 + 8 * i] = word()
    return " ".join(base), " ".join(copy)


def kept_pairs(spark, pairs):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "doc_id bigint, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    return [2 * i + 1 in kept for i in range(len(pairs))]


def test_near_dedup_finds_every_kind_of_edit_at_the_threshold(spark):
    rng = random.Random(11)
    pairs = [edited_pair(rng, kind, share) for kind in ("cut", "append", "block", "scattered") for share in (0.8, 0.85, 0.9) for _ in range(15)]
    alike = [jaccard(*p) for p in pairs]
    assert min(alike) >= 0.8 and alike.count(0.8) >= 30
    assert not any(kept_pairs(spark, pairs))


def test_near_dedup_keeps_what_is_below_the_threshold(spark):
    rng = random.Random(12)
    pairs = [edited_pair(rng, kind, share) for kind in ("cut", "append", "block", "scattered") for share in (0.7, 0.75, 0.78) for _ in range(15)]
    assert max(jaccard(*p) for p in pairs) < 0.8
    assert all(kept_pairs(spark, pairs))


def test_near_dedup_groups_equal_all_pairs(spark):
    """Revisions of few texts: every group has texts alike only through others, and is too long for all pairs at once."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    texts = []
    for _ in range(3):
        family = [[word() for _ in range(150)]]
        for _ in range(40):
            copy = list(rng.choice(family))
            for _ in range(rng.randrange(1, 7)):
                copy[rng.randrange(150)] = word()
            family.append(copy)
        texts += [" ".join(f) for f in family]
    rng.shuffle(texts)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and jaccard(texts[i], texts[j]) >= 0.8:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert 3 < len(set(group)) < len(texts)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(group))


def test_near_dedup_links_by_golay_keys(spark, monkeypatch):
    """Without the exact search that follows, Golay keys of the SimHash alone link copies of few edits."""
    empty = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(simhash, "_meet", lambda *a: empty)
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    pairs = []
    for _ in range(40):
        base = [word() for _ in range(400)]
        pairs.append((" ".join(base), " ".join(base[:200] + [word()] + base[201:])))
    assert kept_pairs(spark, pairs).count(False) >= 30  # similarity 0.975; the rest is left to the exact search


def test_near_dedup_compares_across_labels_only():
    """A run of 300 rows: of 290 linked ones and 10 others, only pairs with one of the 10 are left to verify."""
    n = 300
    label = np.array([0] * 290 + list(range(1, 11)))
    rows = {"key": np.zeros(n, np.int64), "node": np.arange(n), "size": np.full(n, 50), "pos": np.zeros(n, np.int64), "code": np.zeros(n, np.uint64), "label": label}
    found = {(int(x), int(y)) for a, b in simhash._pairs(rows, 0.8, 24) for x, y in zip(a, b)}
    assert found == {(i, j) for j in range(290, n) for i in range(j)}


def test_simhash_odd_rows(spark, odd_docs):
    assert simhash.link_64(odd_docs).count() == odd_docs.count()
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == [(False, 1), (False, 2), (False, 4), (False, 6), (True, None)]
    assert simhash.link_64(odd_docs.where("false")).count() == 0 and simhash.keep_one(odd_docs.where("false")).count() == 0


def test_imatch_texts_are_packed_whole():
    import pyarrow as pa

    texts = ["", "a", "\u65e5\u672c\u8a9e \U0001f600 \u00fcber\x00\n", " ".join(f"word{i % 50}" for i in range(5000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts), pa.array([7] * 4, pa.int64())], names=["doc_id", "text", "tie"])
    (out,) = imatch.pack(iter([batch]))
    assert [imatch.unpacked(p.as_buffer(), n.as_py()) for p, n in zip(out.column(3), out.column(2))] == texts
    assert len(out.column(3)[3].as_py()) < len(texts[3]) / 4


def test_imatch_order_and_edits(spark):
    texts = near_texts(3)
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: r for r in imatch.compare(docs).collect()}
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        r, following = found[3 * i], plain[(i + 1) % len(plain)]
        n = len(text) // 4
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.fingerprint == next(found[3 * j].fingerprint for j, t in enumerate(plain) if t == text)
    long = [r for r in found.values() if r.n_chars > 1000]
    assert sum(r.near_edited for r in long) / len(long) > 0.4


def test_lexicon_counts_documents(spark):
    docs = spark.createDataFrame([("a a b",), ("a c",), (None,)], "text string")
    terms = imatch.Terms()
    counts = {r["class"]: r.df for r in imatch.document_frequencies(docs).collect()}
    assert {w: counts[int(imatch._class(terms.of(w))[0])] for w in "abc"} == {"a": 2, "b": 1, "c": 1}
    bits = imatch.lexicon(docs, (0.0, 0.5))
    held = imatch.in_lexicon(terms.of("a b"), bits)
    assert held.tolist() == terms.of("a").tolist()


def test_lexicon_holds_terms_by_their_own_frequency(spark):
    """600,000 terms of one document each: by 2**20 classes very many would share one with another and count as two."""
    rows = [(" ".join(f"t{i}x{k}" for k in range(600)) + f" pair{i // 2} all",) for i in range(1000)]
    docs = spark.createDataFrame(rows, "text string").repartition(4)
    terms = imatch.Terms()
    held = imatch.lexicon(docs)
    pairs = terms.of(" ".join(f"pair{i}" for i in range(500)))
    assert imatch.in_lexicon(terms.of("t5x7 t999x599 all pair3"), held).tolist() == terms.of("pair3").tolist()
    assert np.array_equal(held, pairs)


def test_imatch_odd_rows(spark, odd_docs):
    found = imatch.compare(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {r.fingerprint for r in found if r.doc_id in (2, 3)} == {"-"}
    assert len({r.fingerprint for r in found if r.doc_id in (4, 5)}) == 1
    assert imatch.compare(odd_docs.where("false")).count() == 0
    assert imatch.compare(odd_docs.where("doc_id = 1")).first().near_next == 1.0


def imatch_reads(texts, lexicon):
    printer, last, found = imatch.Printer(lexicon), None, []
    for part in imatch.together(iter(texts)):
        for read in printer.read([None] * len(part), part, last):
            found.append((last, read, printer.row(last, read) if last else None))
            last = read
    return found


def test_imatch_hashes_are_xxh64():
    words = ["".join(w) for k in range(1, 70) for w in ("a" * k, "\u00e9" * k, "x" + "\u65e5" * k, chr(0x1F600) * k)]
    assert imatch.hashed(words).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    assert imatch.hashed(words * 300)[-len(words) :].tolist() == imatch.hashed(words).tolist() and not len(imatch.hashed([]))


def test_imatch_edited_texts_equal_plain_reading():
    """Fingerprints put together from two texts' hashes and draws, against reading each edited text as a whole."""
    rng = random.Random(5)
    letters, spaces = list("ab\u0391\u03a3\u03c3\u0130\u00df'.-\u65e5\U0001f600") + ["x" * 40], [" ", "\n", "\u00a0", "\u2003", "\x1c", "  "]
    piece = lambda: rng.choice(spaces) if rng.random() < 0.3 else rng.choice(letters) if rng.random() < 0.8 else f"w{rng.randrange(300)}"
    texts = ["".join(piece() for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 8, 20, 100, 2000]))) for _ in range(400)]
    terms = imatch.Terms()
    some = np.sort(np.concatenate([terms.of(f"w{k}") for k in range(0, 300, 7)]))
    for lexicon in (np.zeros(0, np.uint64), some, terms.of(" ".join(texts))):
        mark = lambda text: imatch.signatures(imatch.in_lexicon(terms.of(text), lexicon))
        for last, read, row in imatch_reads(texts, lexicon):
            assert imatch.shown(read.signature) == imatch.shown(mark(read.text))
            if row:
                changed = imatch.edited(last.text, read.text)
                own, other, next_ = mark(last.text), mark(changed), mark(read.text)
                assert row[1:] == (len(last.text), hashlib.sha256(changed.encode()).hexdigest(), imatch.shown(own), imatch.shown(other), imatch.likeness(own, other), imatch.likeness(own, next_))


def test_imatch_draws_from_each_word_once(monkeypatch):
    """The edited text costs no draws of its own but for the words at its cuts."""
    texts, mixed, mix = [" ".join(f"d{i}w{k}" for k in range(300)) for i in range(100)], [], imatch._mix
    every = imatch.Terms().of(" ".join(texts))
    monkeypatch.setattr(imatch, "_mix", lambda h: mixed.append(h.size) or mix(h))
    for lexicon in (every, np.zeros(0, np.uint64)):
        mixed.clear()
        assert len(imatch_reads(texts, lexicon)) == 100
        assert sum(mixed) < 1.1 * 100 * 300 * imatch.SUBSETS
    mixed.clear()
    assert len(imatch_reads(["same " * 100_000] * 3, every)) == 3
    assert sum(mixed) < 100 * imatch.SUBSETS
