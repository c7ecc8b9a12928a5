import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def filled(sizes, weights, share, cap):
    """Water-filling by repeated redistribution."""
    names = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, active, target = share * sum(sizes.values()), set(names), {}
    while active:
        level = left / sum(w[s] for s in active)
        over = [s for s in active if w[s] * level > cap * sizes[s]]
        if not over:
            target |= {s: w[s] * level for s in active}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            active.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 40, "d": 7}, {"a": 1000, "b": 1, "c": 1}, {"a": 30}, {"a": 100, "b": 100, "c": 100}])
def test_targets_and_taken_words(spark, sizes):
    rows = [(i, " ".join(["w"] * (i % 5)), s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.schedule(docs, ["doc_id", "source"]).select("doc.source", "size", "source_size", "target", F.aggregate("packets", F.lit(0).cast("bigint"), lambda s, p: s + p["take"]).alias("taken")).collect()
    words = {s: sum(r.size for r in found if r.source == s) for s in sizes}
    for s, target in filled(words, (3, 1, 2), 1.5, 2).items():
        mine = [r for r in found if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == words[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 1 + words[s] // mixing.PIECES
        assert all(0 <= r.taken <= 2 * r.size for r in mine)


def test_the_budget_cuts_the_order_of_finish_times(spark):
    """Against a plain queue over pieces, with documents far longer than a piece, ties, and a null source."""
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(9000, "a"), (10, "a"), (700, "b"), (0, "b"), (5000, None), (9000, "c"), (3, "c"), (3, "c")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.schedule(docs, ["doc_id", "source"]).select("doc.*", "size", "spread", F.aggregate("packets", F.lit(0).cast("bigint"), lambda s, p: s + p["take"]).alias("taken")).collect()
    pieces = []
    for rank, source in enumerate(("a", "b", "c", None)):
        queue = sorted((r for r in found if r.source == source), key=lambda r: r.spread)
        total, sent = sum(r.size for r in queue), 0
        step = max(1, total // mixing.PIECES)
        for r in [*queue, *queue]:
            for k in range(0, r.size, step):
                words = min(step, r.size - k)
                sent += words
                pieces.append((sent / (3, 1, 2, 3)[rank], rank, r.doc_id, words))
    left, taken = int(0.75 * sum(p[3] for p in pieces)), {i: 0 for i, _, _ in rows}
    for _, _, i, words in sorted(pieces):
        taken[i] += min(words, left)
        left -= min(words, left)
    assert {r.doc_id: r.taken for r in found} == taken


def test_order_follows_weights(spark):
    docs = spark.createDataFrame([(i, "w w w w", s) for s in "ab" for i in range(400)], "doc_id bigint, text string, source string")
    mixed = [r.source for r in mixing.mix(docs, weights=(3, 1), share=1.0).collect()]
    head = mixed[: len(mixed) // 2]
    assert 2.8 < head.count("a") / head.count("b") < 3.2


def test_odd_rows(spark, odd_docs):
    assert mixing.schedule(odd_docs, ["doc_id"]).count() == odd_docs.count()
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert mixing.mix(odd_docs.where("false")).count() == 0
    cut = mixing.mix(odd_docs, whole=False).count()
    assert cut >= mixing.mix(odd_docs).count()
