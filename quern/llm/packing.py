"""Packing token sequences by vector bin packing.

An example asks for tokens, one segment and loss-bearing tokens; a sequence has a limit on each. Bins are filled by
the dot-product heuristic: of the examples that still fit, take the one whose demand, in parts of the limits, has
the largest product with what the bin has left. Examples beyond the limits are cut first, and once nothing whole
fits, the bin is topped up with the start of another example, whose rest stays in the pool. A bin that ends short
of the limit is cut back to a power of two, a length that needs no padding.

Packing runs in the partitions of the input, over a pool of bounded size: no shuffle, and no task holds more than
its pool. The pool is kept by demand: examples that ask for the same tokens and loss-bearing tokens are one class, and
a pick weighs classes, not examples. Of m tokens in a pool there are at most some m**(2/3) classes, so many short
examples cost no more a pick than a few long ones.

Null and empty texts are an example of the end id alone; very long ones are cut into whole sequences at once; repeated
rows are separate examples; equally good classes are taken in the order they came in; empty input gives empty output.
Columns but doc_id, text and loss are ignored, whatever their names. A sequence's id holds its partition and its number
there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import Encoder, lent

#: Tokens a pool holds before bins are closed, and how far it is drained while more input comes.
POOL_HIGH, POOL_LOW = 1_000_000, 250_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Example:
    """A document's ids from ``start`` on; ``loss`` counts loss-bearing ids before each position."""

    __slots__ = ("doc_id", "ids", "start", "loss")

    def __init__(self, doc_id, ids: np.ndarray, loss: np.ndarray | None):
        self.doc_id, self.ids, self.start, self.loss = doc_id, ids, 0, loss

    def loss_of(self, start: int, end: int) -> int:
        return end - start if self.loss is None else int(self.loss[end] - self.loss[start])

    def reach(self, start: int, tokens: int, loss: int) -> int:
        """The end of the longest piece from ``start`` within both limits."""
        end = min(len(self.ids), start + tokens)
        if self.loss is None:
            return min(end, start + loss)
        return min(end, int(np.searchsorted(self.loss, self.loss[start] + loss, side="right")) - 1)


class Packer:
    """Holds the pool of one partition and yields its sequences as lists of (example, start, end)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.tokens = 0
        self.place: dict[tuple[int, int], int] = {}
        self.members: list[list[Example]] = []
        self.size = np.zeros((2, 64), dtype=np.int64)  # tokens and loss-bearing tokens of each class
        self.count = np.zeros(64, dtype=np.int64)

    def _put(self, e: Example) -> None:
        """What is left of an example joins its class."""
        key = len(e.ids) - e.start, e.loss_of(e.start, len(e.ids))
        if not key[0]:
            return
        at = self.place.get(key)
        if at is None:
            at = self.place[key] = len(self.members)
            self.members.append([])
            if at == len(self.count):
                self.size = np.concatenate([self.size, np.zeros_like(self.size)], axis=1)
                self.count = np.concatenate([self.count, np.zeros_like(self.count)])
            self.size[:, at] = key
        self.members[at].append(e)
        self.count[at] += 1

    def _take(self, at: int) -> Example:
        self.count[at] -= 1
        return self.members[at].pop()

    def _forget(self) -> None:
        """Drops the classes without members."""
        held = np.flatnonzero(self.count[: len(self.members)])
        self.members = [self.members[i] for i in held.tolist()]
        self.size = np.concatenate([self.size[:, held], np.zeros((2, 64), np.int64)], axis=1)
        self.count = np.concatenate([self.count[held], np.zeros(64, np.int64)])
        self.place = {(int(t), int(x)): i for i, (t, x) in enumerate(self.size[:, : len(held)].T)}

    def add(self, example: Example) -> Iterator[list]:
        """Takes an example; what it has in whole sequences leaves at once."""
        while len(example.ids) - example.start >= self.limits.tokens and example.reach(example.start, self.limits.tokens, self.limits.loss) - example.start == self.limits.tokens:
            end = example.start + self.limits.tokens
            yield [(example, example.start, end)]
            example.start = end
        self.tokens += len(example.ids) - example.start
        self._put(example)

    def drain(self, down_to: int) -> Iterator[list]:
        """Closes bins until the pool has ``down_to`` tokens at most."""
        if self.tokens > down_to:
            self._forget()
        while self.tokens > down_to:
            yield self._bin()

    def _bin(self) -> list:
        lim = self.limits
        room, segments, loss, pieces = lim.tokens, lim.segments, lim.loss, []
        while room and segments:
            n = len(self.members)
            tokens, bearing = self.size[0, :n], self.size[1, :n]
            fits = np.flatnonzero((self.count[:n] > 0) & (tokens <= room) & (bearing <= loss))
            if not len(fits):
                break
            # Both vectors in parts of the limits; a segment counts the same for all.
            score = tokens[fits] * (room / lim.tokens**2) + bearing[fits] * (loss / max(1, lim.loss) ** 2)
            e = self._take(int(fits[score.argmax()]))
            pieces.append((e, e.start, len(e.ids)))
            room, segments, loss = room - (len(e.ids) - e.start), segments - 1, loss - e.loss_of(e.start, len(e.ids))
        if room and segments and self.count.any():
            # None of the rest fits as a whole: the longest one gives its start, the rest stays.
            e = self._take(int(np.where(self.count > 0, self.size[0], -1).argmax()))
            end = e.reach(e.start, room, loss)
            if end > e.start:
                pieces.append((e, e.start, end))
                room -= end - e.start
                e.start = end
            self._put(e)
        used = lim.tokens - room
        if room:
            self._cut_back(pieces, used - (1 << (used.bit_length() - 1)))
        self.tokens -= sum(b - a for _, a, b in pieces)
        return pieces

    def _cut_back(self, pieces: list, excess: int) -> None:
        """Gives the last ``excess`` tokens back to the pool."""
        while excess:
            e, a, b = pieces.pop()
            less = min(excess, b - a)
            excess -= less
            if b - less > a:
                pieces.append((e, a, b - less))
            if b < len(e.ids):  # its rest is in the pool already and grows at its front
                self._drop(e)
            e.start = b - less
            self._put(e)

    def _drop(self, e: Example) -> None:
        at = self.place[len(e.ids) - e.start, e.loss_of(e.start, len(e.ids))]
        if self.members[at][-1] is e:
            self.members[at].pop()
        else:
            self.members[at].remove(e)
        self.count[at] -= 1


def pack_examples(examples: Iterator[Example], limits: Limits) -> Iterator[list]:
    """All sequences of a stream of examples."""
    packer = Packer(limits)
    for example in examples:
        yield from packer.add(example)
        if packer.tokens > POOL_HIGH:
            yield from packer.drain(POOL_LOW)
    yield from packer.drain(0)


def pack(rows: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1) -> DataFrame:
    """Pieces of ``rows`` (doc_id, text and, if there is one, loss), see PIECES.

    ``loss`` is an array of booleans, one for each id before the end id; null: all ids bear loss.
    ``tokenizer`` is a path that every executor can read.
    """
    has_loss = "loss" in rows.columns
    wanted = rows.select(rows["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(rows["text"].cast("string"), F.lit("")).alias("text"), *([rows["loss"]] if has_loss else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(tokenizer) as found:
            yield from packed(batches, found)

    def packed(batches: Iterator[pa.RecordBatch], found: Encoder) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4")

        def examples() -> Iterator[Example]:
            for batch in batches:
                losses = batch.column(2) if has_loss else None
                for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                    ids = np.concatenate([np.frombuffer(found.encode(text.as_py()), dtype="<u4"), end])
                    mask = losses[k].as_py() if losses is not None else None
                    if mask is None:
                        loss = None
                    else:
                        flags = np.zeros(len(ids), dtype=np.int64)
                        flags[: len(mask)] = np.array(mask[: len(ids)], dtype=bool)
                        loss = np.concatenate([[0], flags.cumsum()])
                    yield Example(doc_id, ids, loss)

        out, number = [], 0
        for sequence in pack_examples(examples(), limits):
            offset = 0
            for e, a, b in sequence:
                out.append((e.doc_id, a, b - a, zlib.crc32(e.ids[a:b].tobytes()), len(e.ids), base + number, offset, e.loss_of(a, b)))
                offset += b - a
            number += 1
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return wanted.mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=names)
