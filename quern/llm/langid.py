"""Language identification of mixed text by script ranges and a Viterbi search over words.

A word's script, by ranges of code points, narrows its candidates to the languages seen in that script. Its score in
a language is the naive-Bayes log likelihood of its character n-grams, normalised over the candidates. The Viterbi
search finds the labelling of a text's words with the best sum of scores less a penalty for each switch of language;
runs of one label are the spans. The text's language is the one with most letters in its spans.

The model is fitted on a bounded sample of labelled texts: about ``per_language`` whole texts of each language,
chosen by a hash of the doc_id. It is arrays of 2**16 n-gram classes a language, which is what is broadcast.
Null texts and texts without letters are ``und`` with score 0; without any training text all are. Empty tables give
empty results, repeated rows a row each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-gram classes, sizes of n-grams, and the least share of a language's letters that makes a script its own.
CLASSES, SIZES, OWN_SCRIPT = 1 << 16, (1, 2, 3, 4), 0.01
CACHE_ENTRIES = 500_000
#: Words of texts that are searched together, a bound on memory.
GROUP_WORDS = 2_000_000
#: First code point of each range and its script; ranges end where the next begins.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
)
_STARTS = [a for a, _ in SCRIPTS]
SCRIPT_NAMES = tuple(dict.fromkeys(s for _, s in SCRIPTS))
_SCRIPT_ID = [SCRIPT_NAMES.index(s) for _, s in SCRIPTS]
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(token: str) -> str:
    return "".join(_LETTERS.findall(token.lower()))


def script_of(word: str) -> int:
    """Index of the script of a word's first letter."""
    return _SCRIPT_ID[max(0, bisect_right(_STARTS, ord(word[0])) - 1)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, class) of the n-grams of all words with their borders, all sizes at once.

    A gram's class mixes its code points and size; grams of one size come from shifted copies of the joined words.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    number = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # code points from here to the word's end
    rows, classes = [], []
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(points), np.uint64)
        for size in range(1, max(SIZES) + 1):
            following = np.zeros(len(points), np.uint64)
            following[: len(points) - size + 1] = points[size - 1 :]
            mixed = (mixed ^ following) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            if size in SIZES:
                whole = left >= size
                rows.append(number[whole])
                classes.append(((mixed[whole] + np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48))
    return np.concatenate(rows), np.concatenate(classes).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # log likelihood, (CLASSES, languages)
    scripts: np.ndarray  # bool, (scripts, languages)


COUNTS = "lang string, kind int, class int, n bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram classes (kind 0) and letters by script (kind 1) of each language in a task's texts."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts, scripts = found.setdefault(lang, (np.zeros(CLASSES, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
            uses = Counter(t.as_py().split())
            words = [(word, n) for token, n in uses.items() if (word := letters(token))]
            if words:
                times = np.array([n for _, n in words])
                row, classes = grams([w for w, _ in words])
                counts += np.bincount(classes, weights=times[row], minlength=CLASSES).astype(np.int64)
                for word, n in words:
                    scripts[script_of(word)] += n * len(word)
    for lang, parts in found.items():
        for kind, values in enumerate(parts):
            used = np.flatnonzero(values)
            n = len(used)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, kind, np.int32)), pa.array(used.astype(np.int32)), pa.array(values[used])], names=["lang", "kind", "class", "n"])


def fit(labelled: DataFrame, per_language: int = 400) -> Model:
    """Fits on a sample of ``labelled`` (doc_id, text, lang) without nulls in text and lang.

    Rows are sampled by hash at the rate that leaves about ``per_language`` of each language. The driver gets the
    number of rows of each language and at most CLASSES counts a language.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((CLASSES, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000))
    rate = F.lit(0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1_000_000, -(-1_000_000 * per_language // n)))).otherwise(rate)
    sampled = labelled.where(draw < rate).select("lang", "text")
    counts = sampled.mapInArrow(_count, COUNTS).groupBy("lang", "kind", "class").agg(F.sum("n").alias("n")).toArrow()
    weights = np.full((CLASSES, len(languages)), 0.5)
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    column = np.array([languages.index(x) for x in counts.column("lang").to_pylist()], dtype=np.int64)
    kind, at, n = (counts.column(c).to_numpy() for c in ("kind", "class", "n"))
    weights[at[kind == 0], column[kind == 0]] += n[kind == 0]
    scripts[at[kind == 1], column[kind == 1]] = n[kind == 1]
    own = scripts >= np.maximum(1, OWN_SCRIPT * scripts.sum(axis=0))
    return Model(languages, np.log(weights / weights.sum(axis=0)).astype(np.float32), own)


class Scorer:
    """Scores and letter counts of tokens, remembered up to a bound; new ones are scored many at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def add(self, tokens: list[str]) -> None:
        """Scores ``tokens``, none of which is known. Tokens with one word of letters share its score."""
        base = len(self.known)
        self.known.update(zip(tokens, range(base, base + len(tokens))))
        words = [token if token.isalpha() and token.islower() else letters(token) for token in tokens]
        number: dict[str, int] = {}
        at = np.array([number.setdefault(w, len(number)) if w else -1 for w in words], dtype=np.int64)
        scores = np.zeros((len(tokens), len(self.model.languages)), np.float32)
        distinct = list(number)
        for k in range(0, len(distinct), 20_000):
            part = distinct[k : k + 20_000]
            held = (at >= k) & (at < k + len(part))
            scores[held] = self._score(part)[at[held] - k]
        self.scores = np.concatenate([self.scores, scores])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, words), dtype=np.int64, count=len(words))])

    def _score(self, words: list[str]) -> np.ndarray:
        row, classes = grams(words)
        raw = np.stack([np.bincount(row, weights=self.model.weights[classes, j], minlength=len(words)) for j in range(len(self.model.languages))], axis=1)
        able = self.model.scripts[np.fromiter(map(script_of, words), dtype=np.int64, count=len(words))]
        raw = np.where(able, raw, -1e30)
        top = raw.max(axis=1, keepdims=True)
        score = np.maximum(raw - top - np.log(np.exp(raw - top).sum(axis=1, keepdims=True)), -12.0)
        return np.where(able.any(axis=1, keepdims=True), score, 0.0).astype(np.float32)

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The positions of each text's tokens in ``scores``."""
        fresh = dict.fromkeys(token for tokens in texts for token in tokens if token not in self.known)
        if fresh:
            self.add(list(fresh))
        get = self.known.__getitem__
        return [np.fromiter(map(get, tokens), dtype=np.int64, count=len(tokens)) for tokens in texts]


def viterbi(texts: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best label of each word of each text; all texts advance together, the longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    length = np.array([len(texts[i]) for i in order])
    if not len(length) or length[0] == 0:
        return [np.zeros(0, np.int8) for _ in texts]
    start = np.concatenate([[0], np.cumsum(length)])
    flat = np.concatenate([texts[i] for i in order])
    n_lang = scores.shape[1]
    came = np.empty((len(flat), n_lang), dtype=np.int16)
    state = np.zeros((len(order), n_lang), dtype=np.float32)
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # texts longer than t
    for t in range(int(length[0])):
        a = int(active[t])
        at = start[:a] + t
        now = state[:a]
        if t:
            best = now.argmax(axis=1)
            jump = now[np.arange(a), best] - penalty
            stay = now >= jump[:, None]
            came[at] = np.where(stay, np.arange(n_lang, dtype=np.int16)[None, :], best[:, None])
            now = np.where(stay, now, jump[:, None])
        state[:a] = now + scores[flat[at]]
    labels = np.empty(len(flat), dtype=np.int16)
    last = state.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        a = int(active[t])
        ending = length[:a] == t + 1
        at = start[:a] + t
        labels[at] = np.where(ending, last[:a], came[np.minimum(at + 1, len(flat) - 1), labels[np.minimum(at + 1, len(flat) - 1)] % n_lang])
    out = [np.zeros(0, np.int16)] * len(texts)
    for k, i in enumerate(order):
        out[i] = labels[start[k] : start[k] + length[k]]
    return out


LABELLED = "lang string, score double, spans array<struct<lang:string,first_word:int,n_words:int>>"


def _label(group: list[str | None], scorer: Scorer, penalty: float, with_spans: bool) -> list[tuple]:
    model = scorer.model
    if len(scorer.known) > CACHE_ENTRIES:
        scorer.forget()
    texts = scorer.of([t.split() if t and model.languages else [] for t in group])
    scores, sizes = scorer.scores, scorer.sizes
    out = []
    for words, labels in zip(texts, viterbi(texts, scores, penalty)):
        weight = sizes[words] if len(words) else np.zeros(0)
        if not weight.sum():
            out.append(("und", 0.0, []))
            continue
        share = np.bincount(labels, weights=weight, minlength=len(model.languages))
        top = int(share.argmax())
        sure = float((np.exp(scores[words, top].astype(np.float64)) * weight)[labels == top].sum() / weight.sum())
        spans = []
        if with_spans:
            first = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
            spans = [{"lang": model.languages[int(labels[f])], "first_word": int(f), "n_words": int(n)} for f, n in zip(first, np.diff([*first, len(labels)]))]
        out.append((model.languages[top], min(1.0, max(0.0, sure)), spans))
    return out


def label(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), penalty: float = 6.0, with_spans: bool = True) -> DataFrame:
    """keep..., lang, score and the language spans of every whole text. Only ``text`` is read for it.

    score is the mean, over the text's letters, of the probability of its language given the word, counted 0 in the
    spans of other languages. Kept columns named as results are left out.
    """
    keep = tuple(k for k in keep if k not in ("lang", "score", "spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = docs.select(*[docs[k] for k in keep], docs["text"].cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1]), LABELLED])
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows, group, size = [], [], 0
            for t in batch.column(len(keep)):
                text = t.as_py()
                group.append(text)
                size += len(text or "") // 5
                if size > GROUP_WORDS:
                    rows += _label(group, scorer, penalty, with_spans)
                    group, size = [], 0
            rows += _label(group, scorer, penalty, with_spans)
            if rows:
                lang, score, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span_type)], names=[*keep, "lang", "score", "spans"])

    return wanted.mapInArrow(run, schema)
