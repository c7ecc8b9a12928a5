"""I-Match fingerprints over randomised lexicons.

The lexicon is the terms whose document frequency lies in a band of inverse document frequency. Terms are lower-cased
words, told apart by 64-bit hashes; frequencies are counted exactly for each. The lexicon is the sorted hashes of the
terms in the band, 8 bytes a term, and is broadcast.

A text's lexicon terms, distinct and sorted, are hashed once for each of several random sub-lexicons. A sub-lexicon
of level L holds one term in 2**L; a text uses the level at which it has about one term in each, and the next, so
texts of somewhat different sizes still have a level in common. The likeness of two fingerprints is the Dice
coefficient of their non-empty sub-lexicon hashes at that level.

An edited text's words are those of its two texts, but for the words at its cuts, so each text is hashed and drawn from
once; what both leave open is drawn again.

Null and empty texts have the fingerprint ``-``; texts without lexicon terms use all their terms. Equal texts have
equal fingerprints, repeated rows each their own row; the next document of the last is the first. Ties of doc_id
stand in the order of a hash of their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize, shared_dir, text_or_empty

#: Sub-lexicons, and the band of idf in parts of the largest, log(documents).
SUBSETS, BAND = 40, (0.1, 0.97)
#: Terms a task gathers before it counts them.
GATHERED = 2_000_000
#: Documents and characters whose words are hashed at once (one document at least), and words in a vector.
TEXTS, CHARS, WORDS = 64, 1 << 20, 1 << 16
_U = np.uint64


_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << _U(by)) | (h >> _U(64 - by))


def _hashed(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    padded = raw + bytes(8)
    data = np.frombuffer(padded, np.uint8)
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    ends = np.append(np.flatnonzero(data[: len(raw)] == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    h = size.astype(np.uint64) + _P5
    for k in range(0, 24, 8):
        at = np.flatnonzero(size >= k + 8)
        h[at] = _rotated(h[at] ^ (_rotated(eights[starts[at] + k] * _P2, 31) * _P1), 27) * _P1 + _P4
    rest, at = starts + (size & ~7), np.flatnonzero(size & 4)
    h[at] = _rotated(h[at] ^ ((eights[rest[at]] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    rest[at] += 4
    for k in range(3):
        at = np.flatnonzero(size & 3 > k)
        h[at] = _rotated(h[at] ^ (data[rest[at] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    h ^= h >> _U(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        import xxhash

        h[long] = [xxhash.xxh64_intdigest(raw[starts[i] : ends[i]]) for i in long.tolist()]
    return h


def hashed(words: list[str]) -> np.ndarray:
    """XXH64 of each word, none empty or with a space in it, by vectors; words of 32 bytes or more one by one."""
    return np.concatenate([_hashed(words[k : k + WORDS]) for k in range(0, len(words), WORDS)] or [np.zeros(0, np.uint64)])


def distinct(hashes: np.ndarray) -> np.ndarray:
    found = np.sort(hashes)
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


class Terms:
    """64-bit hashes of terms."""

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of a text's lower-cased words."""
        return distinct(hashed(text.lower().split()))


def together(texts: Iterator[str]) -> Iterator[list[str]]:
    """Lists of texts to be hashed at once."""
    held, size = [], 0
    for text in texts:
        if held and (len(held) == TEXTS or size + len(text) > CHARS):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _class(terms: np.ndarray) -> np.ndarray:
    return terms.view(np.int64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(class, df): of every term, by its hash, over all documents; tasks send counts of some millions of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0

        def counted():
            found, counts = np.unique(np.concatenate(gathered), return_counts=True)
            for k in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(_class(found[k : k + 50_000])), pa.array(counts[k : k + 50_000].astype(np.int64))], names=["class", "df"])

        for batch in batches:
            for texts in together(t.as_py() for t in batch.column(0)):
                words = [t.lower().split() for t in texts]
                found = np.split(hashed([w for ws in words for w in ws]), np.cumsum([len(ws) for ws in words])[:-1])
                gathered += map(distinct, found)
                n += sum(map(len, gathered[-len(texts) :]))
                if n >= GATHERED:
                    yield from counted()
                    gathered, n = [], 0
        if n:
            yield from counted()

    return docs.select(text_or_empty(docs).alias("text")).mapInArrow(run, "class bigint, df bigint").groupBy("class").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted hashes of the terms in the band, from exact counts over all documents.

    They reach the driver packed, 8 bytes a term.
    """
    n = docs.count()
    share = F.log(F.lit(float(max(n, 1))) / F.col("df")) / F.log(F.lit(float(max(n, 3))))
    kept = document_frequencies(docs).where(share.between(*band)).select("class")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], names=["hashes"])

    found = b"".join(bytes(row[0]) for row in kept.mapInArrow(packed, "hashes binary").toLocalIterator())
    return np.sort(np.frombuffer(found, dtype=np.uint64))


def held_by(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Which terms the lexicon holds."""
    if not len(lexicon):
        return np.zeros(len(terms), bool)
    order = np.argsort(terms)  # neighbours are found near each other
    ranked = terms[order]
    found = np.empty(len(terms), bool)
    found[order] = lexicon[np.minimum(np.searchsorted(lexicon, ranked), len(lexicon) - 1)] == ranked
    return found


def in_lexicon(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    held = terms[held_by(terms, lexicon)]
    return held if len(held) else terms


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_SALTS = _mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def level_of(n: int) -> int:
    """The level at which n terms are about one in each sub-lexicon."""
    return max(0, math.floor(math.log2(n / 0.7))) if n else 0


#: Draws below the level's bound are in a sub-lexicon of that level.
_BELOW = np.array([min(2**64 - 1, 2 ** (64 - level)) for level in range(65)], dtype=np.uint64)


class Draws(NamedTuple):
    """What sub-lexicons draw from some terms: place of the term, sub-lexicon, draw, and the term's own hash."""

    place: np.ndarray
    subset: np.ndarray
    draw: np.ndarray
    own: np.ndarray

    def part(self, where) -> Draws:
        return Draws(self.place[where], self.subset[where], self.draw[where], self.own[where])


def draws(terms: np.ndarray, level: np.ndarray) -> Draws:
    """What sub-lexicons draw from each term at its level and those above, by places of the terms."""
    found, below = [], _BELOW[level]
    for k in range(0, len(terms), 256):  # bounds the matrix; 80 KB stay in the cache
        part = terms[k : k + 256]
        drawn = _mix(part[:, None] ^ _SALTS[None, :])
        at = np.flatnonzero(drawn < below[k : k + 256, None])
        row, subset = np.divmod(at, SUBSETS)
        found.append((row + k, subset, drawn.ravel()[at], _mix(part * _U(0x9E3779B97F4A7C15))[row]))
    return Draws(*map(np.concatenate, zip(*found))) if found else Draws(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)))


def summed(level: int, drawn: Draws) -> dict[int, np.ndarray]:
    """Level -> one 16-bit hash a sub-lexicon, 0 where it holds none of the terms; each term is drawn from once."""
    total, held = np.zeros((2, SUBSETS), np.uint64), np.zeros((2, SUBSETS), bool)
    for k in range(2):
        at = np.flatnonzero(drawn.draw < _BELOW[level + k])
        subset = drawn.subset[at]
        np.add.at(total[k], subset, drawn.own[at])
        held[k, subset] = True
    values = np.where(held, (_mix(total) & _U(0xFFFE)) + _U(1), _U(0)).astype(np.uint16)
    return {level: values[0], level + 1: values[1]}


def signatures(terms: np.ndarray) -> dict[int, np.ndarray]:
    """The fingerprint of distinct terms: level -> one 16-bit hash a sub-lexicon."""
    level = level_of(len(terms))
    return summed(level, draws(terms, np.full(len(terms), level))) if len(terms) else {}


def shown(signature: dict[int, np.ndarray]) -> str:
    return "/".join(f"{at}:{values.astype('>u2').tobytes().hex()}" for at, values in sorted(signature.items())) or "-"


def likeness(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> float:
    """Dice coefficient of the non-empty hashes at the best level both have; texts without any term are alike."""
    if not a and not b:
        return 1.0
    best = 0.0
    for at in a.keys() & b.keys():
        x, y = a[at], b[at]
        n = np.count_nonzero(x) + np.count_nonzero(y)
        if n:
            best = max(best, 2.0 * np.count_nonzero((x == y) & (x != 0)) / n)
        elif np.array_equal(x, y):
            best = max(best, 1.0)
    return best


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next document."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: edge: null for a finished row; else 0 for a shard's first document, 1 for its last, which lacks its next.
STREAMED = f"{RESULT}, shard int, edge int, text string"


class Seam(NamedTuple):
    """An edited text in words: the first ``kept`` of the text, some of the next, and those at the cuts."""

    kept: int
    begin: int
    end: int
    loose: list[str]


def seam(text: str, n_words: int, following: str) -> Seam:
    """Words are cut and lower-cased one by one alike: no white space is a letter or lets case look past it."""
    cut = len(text) // 4
    if not cut:
        return Seam(n_words, 0, 0, [])
    head, tail, put = text[:-cut], text[-cut:], following[:cut]
    kept, words, piece = n_words - len(tail.split()), put.split(), ""
    if not head[-1].isspace():
        kept, piece = kept - tail[0].isspace(), head.rsplit(None, 1)[-1]
    begin = int(bool(words) and not put[0].isspace())
    first = piece + words[0] if begin else piece
    loose = [w.lower() for w in (first, *words[begin:][-1:]) if w]
    return Seam(kept, begin, max(begin, len(words) - 1), loose)


class Read(NamedTuple):
    """A text as read: its terms in order, repeated ones too, then those at the cuts of the edited text before it.

    Draws are from the terms the lexicon holds, or from all where it holds none of the text's (``plain``), at ``level``
    and above, and from a repeated term where it first stands; the first word may be cut off, so its next place counts too.
    """

    doc_id: int
    text: str
    seam: Seam | None
    n_words: int
    terms: np.ndarray
    held: np.ndarray
    plain: bool
    level: int
    drawn: Draws
    signature: dict[int, np.ndarray]


class Printer:
    """Fingerprints of texts in their order; an edited text takes its words' hashes and draws from its two texts."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon

    def read(self, ids: list, texts: list[str], last: Read | None) -> Iterator[Read]:
        words, seams, text, n = [], [], last and last.text, last and last.n_words
        for t in texts:
            own = t.lower().split()
            seams.append((None if text is None else seam(text, n, t), len(own)))
            words.append(own + seams[-1][0].loose if seams[-1][0] else own)
            text, n = t, len(own)
        terms = hashed([w for ws in words for w in ws])
        cuts = np.append(0, np.cumsum([len(ws) for ws in words]))
        held = held_by(terms, self.lexicon)
        used, once, least, firsts, plain = held.copy(), np.zeros(len(terms), bool), np.zeros(len(terms), np.int64), [], []
        for k, (_, n) in enumerate(seams):
            here, own = slice(cuts[k], cuts[k + 1]), terms[cuts[k] : cuts[k] + n]
            plain.append(not held[here][:n].any())
            used[here] |= plain[-1]
            at = np.flatnonzero(used[here][:n])
            firsts.append(at[np.unique(own[at], return_index=True)[1]])
            once[here][firsts[-1]] = once[here][n:] = True
            once[here][np.flatnonzero(own[1:] == own[:1])[:1] + 1] = True
            # Two levels more than its own fingerprint needs: for edited texts with fewer terms.
            least[here] = max(0, level_of(len(firsts[-1])) - 2)
        place = np.flatnonzero(used & once)
        drawn = draws(terms[place], least[place])
        drawn = drawn._replace(place=place[drawn.place])
        ranges = np.searchsorted(drawn.place, cuts)
        for k, (doc_id, t, (join, n)) in enumerate(zip(ids, texts, seams)):
            here = slice(cuts[k], cuts[k + 1])
            mine = drawn.part(slice(ranges[k], ranges[k + 1]))
            mine = mine._replace(place=mine.place - cuts[k])
            first = np.zeros(here.stop - here.start, bool)
            first[firsts[k]] = True
            mark = summed(level_of(len(firsts[k])), mine.part(first[mine.place])) if n else {}
            yield Read(doc_id, t, join, n, terms[here], held[here], plain[k], int(least[cuts[k]]) if n else 0, mine, mark)

    def edited_signature(self, a: Read, b: Read) -> dict[int, np.ndarray]:
        """The fingerprint of a's text with b's in its last quarter."""
        kept, begin, end, _ = b.seam
        parts = ((a, 0, kept), (b, begin, end), (b, b.n_words, len(b.terms)))
        terms = np.concatenate([r.terms[i:j] for r, i, j in parts])
        held = np.concatenate([r.held[i:j] for r, i, j in parts])
        any_held = held.any()
        used = np.flatnonzero(held) if any_held else np.arange(len(terms))
        found, first = np.unique(terms[used], return_index=True)
        level = level_of(len(found))
        if not len(found) or max(a.level, b.level) > level or not (any_held or (a.plain and b.plain)):
            return signatures(found)
        once = np.zeros(len(terms), bool)
        once[used[first]] = True
        drawn, at = [], 0
        for r, i, j in parts:
            low, high = r.drawn.place.searchsorted((i, j))
            part = r.drawn.part(slice(low, high))
            drawn.append(part._replace(place=part.place + (at - i)))
            at += j - i
        every = Draws(*map(np.concatenate, zip(*drawn)))
        return summed(level, every.part(once[every.place] & (every.draw < _BELOW[level])))

    def row(self, a: Read, b: Read) -> tuple:
        """a's result, b being the next document."""
        changed, mark = edited(a.text, b.text), self.edited_signature(a, b)
        return a.doc_id, len(a.text), hashlib.sha256(changed.encode()).hexdigest(), shown(a.signature), shown(mark), likeness(a.signature, mark), likeness(a.signature, b.signature)


def _result(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, tie) -> (doc_id, tie, size, packed): each text's bytes compressed, for the exchange."""
    codec = pa.Codec("zstd", compression_level=1)
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            texts = [t.as_buffer() for t in batch.column(1)]
            packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([t.size for t in texts], pa.int64()), packed], names=["doc_id", "tie", "size", "packed"])


def unpacked(packed: pa.Buffer, size: int) -> str:
    return pa.Codec("zstd").decompress(packed, decompressed_size=size, asbytes=True).decode() if size else ""


def compare(docs: DataFrame) -> DataFrame:
    """RESULT for every document in ascending doc_id order: its fingerprint, that of its edited text, and both likenesses.

    The texts are exchanged once, compressed, by ranges of doc_id, and streamed in order; a task's last document meets the first
    one of the next non-empty range in a small second step, with one or two rows a range.
    """
    spark = docs.sparkSession
    wanted = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    held = spark.sparkContext.broadcast(lexicon(wanted))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tied = wanted.withColumn("tie", F.xxhash64("text")).mapInArrow(pack, "doc_id bigint, tie bigint, size bigint, packed binary")
    ordered = tied.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "packed").select("doc_id", "size", "packed")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, printer, out, last = TaskContext.get().partitionId(), Printer(held.value), [], None
        blank = (None,) * 6
        for batch in batches:
            ids, sizes = iter(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for texts in together(unpacked(t.as_buffer(), size) for size, t in zip(sizes, batch.column(2))):
                for read in printer.read(list(islice(ids, len(texts))), texts, last):
                    if last is None:
                        out.append((read.doc_id, *blank, shard, 0, read.text))
                    else:
                        out.append((*printer.row(last, read), shard, None, None))
                    last = read
                if len(out) >= 2000:
                    yield _result(out, STREAMED)
                    out = []
        if last is not None:
            out.append((last.doc_id, *blank, shard, 1, last.text))
        if out:
            yield _result(out, STREAMED)

    written = materialize(ordered.mapInArrow(stream, STREAMED), f"{shared_dir(spark)}/streamed")
    done = written.where("edge IS NULL").select(*RESULT.replace(",", "").split()[::2])
    edges = written.where("edge IS NOT NULL").select("doc_id", "text", "shard", "edge")
    # Two rows a range: its last document and the first one of the next range, or of the first range at the end.
    order = Window.orderBy("shard", "edge")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = edges.select("doc_id", "text", "edge", F.coalesce(F.lead("text").over(order), F.first("text").over(every)).alias("following")).where("edge = 1")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(held.value)
        for batch in batches:
            rows = []
            for doc_id, text, following in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "following"))):
                rows.append(printer.row(*printer.read([doc_id, None], [text, following], None)))
            if rows:
                yield _result(rows, RESULT)

    return done.unionByName(tails.mapInArrow(close, RESULT))
