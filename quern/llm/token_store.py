"""A content-addressed store of token ids.

A rolling hash over the last ids cuts a document's id stream into chunks, so equal passages give equal chunks
wherever they stand. A chunk is stored once under its content address; a document is a recipe, the list of its
chunks' addresses. Recipes are written in ascending doc_id order in shards. A recipe's Merkle root covers its
addresses, a shard's root the recipes (doc_id, length and root) in their order, and the manifest holds every shard's
root, documents, ids and first id.

Layout below the store's path, all Parquet (so any Spark file system serves):
  staged/kind=0   a chunk: key (its address), width, ids (little-endian, width bytes an id)
  staged/kind=1   a recipe before it is put in order
  recipes/kind=0  shard, position, doc_id, start_in_shard, n_tokens, root, addresses: sorted by position in a shard
  recipes/kind=1  the totals and the root of a shard, as its writer found them
  manifest        shard, n_docs, n_tokens, root, first_token

Reading checks each chunk against its address, each recipe against its root and each shard against the manifest, and
fails on any difference, so a lost, doubled, reordered or altered recipe or chunk does not pass.
Checksums of documents come from those of their chunks as read (CRC-32 of a concatenation follows from the parts),
so ids need not move for them; ``read_ids`` brings the ids themselves, under the same checks.

Null and empty texts hold the end id alone, very long ones are cut into as many chunks as it takes. Repeated rows are
separate documents, ties of doc_id stand in the order of their recipes' roots. Null doc_ids come first. An empty table
gives an empty store. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tokens import encoder

#: Chunk sizes in ids: least, most, and a mask that a rolling hash meets once in 512 ids.
LEAST, MOST, MASK = 128, 4096, 511
#: Ids a rolling hash spans, as a power of two.
SPAN_LOG2 = 4
#: Bytes of text that are encoded at once.
SLICE = 1 << 22
_MIX, _FACTOR = 0x9E3779B1, 0x2545F491

STAGED = "kind int, key binary, doc_id bigint, n_tokens bigint, width int, ids binary, root binary, addresses array<binary>"


def address(width: int, ids: bytes) -> bytes:
    return hashlib.blake2b(bytes([width]) + ids, digest_size=20).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is. No leaves: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + leaf).digest() for leaf in leaves]
    while len(level) > 1:
        paired = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(paired) * 2 :]
    return level[0] if level else hashlib.sha256(b"").digest()


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last 16 ids meets the mask, within LEAST and MOST ids."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(_MIX)
    h ^= h >> np.uint32(15)
    factor = _FACTOR
    for k in range(SPAN_LOG2):  # each round doubles the span: h[i] += h[i - 2**k] * factor**(2**k)
        step = 1 << k
        if len(h) > step:
            h[step:] += h[:-step] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
    hits = np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1
    ends, start = [], 0
    for at in hits.tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            ends.append(at)
            start = at
    while len(ids) - start > MOST:
        start += MOST
        ends.append(start)
    if start < len(ids):
        ends.append(len(ids))
    return ends


def _slices(doc_ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Successive rows of some SLICE bytes of text each, one row at least."""
    through = pc.binary_length(texts).to_numpy().astype(np.int64).cumsum()
    at = 0
    while at < len(through):
        till = max(at + 1, int(np.searchsorted(through, (through[at - 1] if at else 0) + SLICE, side="right")))
        yield doc_ids.slice(at, till - at), texts.slice(at, till - at)
        at = till


def _stage(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of both kinds from one pass over the texts: 0, a chunk under its address; 1, a recipe.

    A chunk met again in the same task is left out there (a bounded memory of addresses).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode_all
        task = TaskContext.get().partitionId().to_bytes(4, "little")
        rows, size, sent, number = [], 0, set(), 0
        for batch in batches:
            for doc_ids, texts in _slices(batch.column(0), batch.column(1)):
                ids, ends = encode(texts)
                ids = np.insert(ids, ends, end_id)
                narrow = ids.astype("<u2") if int(ids.max()) < 65_536 else None
                first = 0
                for doc_id, last in zip(doc_ids.to_pylist(), (ends + np.arange(1, len(ends) + 1)).tolist()):
                    addresses, start = [], first
                    for stop in cuts(ids[first:last]):
                        stop += first
                        width = 2 if narrow is not None or int(ids[start:stop].max()) < 65_536 else 4
                        raw = narrow[start:stop].tobytes() if narrow is not None else ids[start:stop].astype(f"<u{width}").tobytes()
                        key = address(width, raw)
                        addresses.append(key)
                        if key not in sent:
                            if len(sent) >= 500_000:
                                sent.clear()
                            sent.add(key)
                            rows.append((0, key, None, None, width, raw, None, None))
                            size += len(raw)
                        start = stop
                    root = merkle(addresses)
                    # Copies share a root; the task and a running number tell their recipes apart and spread them.
                    rows.append((1, root + task + number.to_bytes(8, "little"), doc_id, last - first, None, None, root, addresses))
                    number, first = number + 1, last
                    if size > 4_000_000 or len(rows) > 20_000:
                        yield _staged(rows)
                        rows, size = [], 0
        if rows:
            yield _staged(rows)

    wanted = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return wanted.mapInArrow(run, STAGED)


def _staged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
    names = [part.split()[0] for part in STAGED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)


RECIPES = "kind int, shard int, position bigint, doc_id bigint, start_in_shard bigint, n_tokens bigint, root binary, addresses array<binary>"
SEALED = "shard int, n_docs bigint, n_tokens bigint, root binary"


class Seal:
    """The totals of a shard and the root over its recipes in their order, folded with a stack of one node a height."""

    def __init__(self):
        self.docs, self.tokens, self.stack = 0, 0, []

    def add(self, doc_id: int | None, n_tokens: int, root: bytes) -> None:
        self.docs, self.tokens = self.docs + 1, self.tokens + n_tokens
        named = b"-" if doc_id is None else doc_id.to_bytes(8, "little", signed=True)
        height, node = 0, hashlib.sha256(b"\0" + root + n_tokens.to_bytes(8, "little") + named).digest()
        while self.stack and self.stack[-1][0] == height:
            height, node = height + 1, hashlib.sha256(b"\1" + self.stack.pop()[1] + node).digest()
        self.stack.append((height, node))

    def root(self) -> bytes:
        root = b""
        for _, node in reversed(self.stack):
            root = node if not root else hashlib.sha256(b"\1" + node + root).digest()
        return root


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a shard's recipes, which come in order, gives the first id of each within the shard, and seals the shard."""
    from pyspark import TaskContext

    names = [part.split()[0] for part in RECIPES.split(", ")]
    shard, seal = TaskContext.get().partitionId(), Seal()
    for batch in batches:
        n, position, start = batch.num_rows, seal.docs, seal.tokens
        counts = batch.column("n_tokens").to_numpy()
        starts = start + np.concatenate([[0], counts.cumsum()[:-1]]) if n else counts
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root"))):
            seal.add(*row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(position, position + n)), batch.column("doc_id"),
             pa.array(starts.astype(np.int64)), batch.column("n_tokens"), batch.column("root"), batch.column("addresses")],
            names=names,
        )
    if seal.docs:
        last = [1, shard, seal.docs, None, None, seal.tokens, seal.root(), None]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(last, kinds)], names=names)


def _seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEALED of recipes (shard, doc_id, n_tokens, root) that come sorted by shard and position, some shards a task."""
    shard, seal = None, Seal()

    def closed():
        values = ([shard], [seal.docs], [seal.tokens], [seal.root()])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=[p.split()[0] for p in SEALED.split(", ")])

    for batch in batches:
        for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if s != shard:
                if shard is not None:
                    yield closed()
                shard, seal = s, Seal()
            seal.add(*row)
    if shard is not None:
        yield closed()


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every text, append ``end_id``, and write the store.

    Texts are encoded once. One exchange by content address brings equal chunks together, of which a sorted
    aggregation keeps the first; the few columns of the recipes are then sorted by doc_id over a range partitioning.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = _stage(docs, tokenizer, end_id).repartition(shards, "key").sortWithinPartitions("kind", "key").dropDuplicates(["kind", "key"])
    unique.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", "false").partitionBy("kind").parquet(f"{path}/staged")
    recipes = spark.read.schema(STAGED).parquet(f"{path}/staged").where("kind = 1").select("doc_id", "n_tokens", "root", "addresses")
    ordered = recipes.repartitionByRange(shards, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    numbered = ordered.mapInArrow(_number, RECIPES).sortWithinPartitions("kind", "shard", "position")
    numbered.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{path}/recipes")
    sealed = spark.read.schema(RECIPES).parquet(f"{path}/recipes").where("kind = 1").select("shard", F.col("position").alias("n_docs"), "n_tokens", "root")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shards
    sealed.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).write.mode("overwrite").parquet(f"{path}/manifest")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """address, width, ids of every stored chunk."""
    return spark.read.schema(STAGED).parquet(f"{path}/staged").where("kind = 0").select(F.col("key").alias("address"), "width", "ids")


CHECKED = "address binary, n_ids bigint, crc bigint"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks chunks against their addresses; the CRC-32 and number of their ids as 32-bit integers."""
    for batch in batches:
        counts, sums = [], []
        for key, width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if address(width, raw) != key:
                raise ValueError(f"chunk {key.hex()} does not match its address")
            ids = np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4").astype("<u4")
            counts.append(len(ids))
            sums.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["address", "n_ids", "crc"])


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    product, bit = 0, 1 << 31
    while a:
        if a & bit:
            product ^= b
            a ^= bit
        bit >>= 1
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
    return product


@lru_cache(maxsize=64)
def _doubling(j: int) -> tuple[int, np.ndarray]:
    """x to the power of 8 * 2**j modulo the polynomial, and tables of its product with each byte of a checksum."""
    power = 1 << 23 if j == 0 else _times(_doubling(j - 1)[0], _doubling(j - 1)[0])
    table = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        at = np.arange(256) >> (bit % 8) & 1 == 1
        table[bit // 8, at] ^= np.uint32(_times(power, 1 << bit))
    return power, table


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each checksum's share in that of a text which goes on for ``n_bytes`` more."""
    crc, j = crc.astype(np.uint32), 0
    while (n_bytes >> j).any():
        table = _doubling(j)[1]
        moved = table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]
        crc = np.where(n_bytes >> j & 1 == 1, moved, crc)
        j += 1
    return crc


def joined_crc(crc: np.ndarray, n_bytes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations from those of their parts; ``first`` holds the index of each one's first part."""
    through = n_bytes.cumsum()
    ends = np.append(through[first[1:] - 1], through[-1])
    after = np.repeat(ends, np.diff(np.append(first, len(crc)))) - through
    return np.bitwise_xor.reduceat(shifted(crc, after), first)


def _manifest(spark: SparkSession, path: str, recipes: DataFrame) -> DataFrame:
    """(shard, first_token) of every shard; reading it fails where the recipes do not have the manifest's root and totals."""
    manifest = spark.read.parquet(f"{path}/manifest")
    order = recipes.select("shard", "doc_id", "n_tokens", "root", "position").repartition("shard").sortWithinPartitions("shard", "position")
    found = order.select("shard", "doc_id", "n_tokens", "root").mapInArrow(_seal, SEALED)
    names = [part.split()[0] for part in SEALED.split(", ")]
    found = found.select(*[F.col(n).alias(f"found_{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"found_{n}"))
    either = F.coalesce("shard", "found_shard")
    fail = F.raise_error(F.concat(F.lit("recipes do not match the manifest in shard "), either.cast("string")))
    return manifest.join(found, manifest["shard"] == found["found_shard"], "full").select(either.alias("shard"), F.when(same, F.col("first_token")).otherwise(fail).alias("first_token"))


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes").where("kind = 0").drop("kind")


def _rebuild(doc_id: int | None, n_tokens: int, root: bytes, addresses: list[bytes], sizes: list[int | None]) -> None:
    if None in sizes or sum(sizes) != n_tokens or merkle(addresses) != root:
        raise ValueError(f"document {doc_id} can not be rebuilt from its recipe")


DIGEST = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files, all of them verified.

    The chunk side has one row an address, so an address that very many recipes name is a skewed join that adaptive
    execution splits; what meets there are some 100 bytes a reference.
    """
    recipes = _recipes(spark, path)
    checked = chunks(spark, path).mapInArrow(_check, CHECKED)
    refs = recipes.select("shard", "position", "doc_id", "start_in_shard", "n_tokens", "root", F.posexplode("addresses").alias("k", "address"))
    parts = refs.join(checked, "address", "left").groupBy("shard", "position").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "start_in_shard", "n_tokens")], F.max("root").alias("root"),
        F.sort_array(F.collect_list(F.struct("k", "address", "n_ids", "crc"))).alias("parts"),
    )
    found = parts.join(F.broadcast(_manifest(spark, path, recipes)), "shard").select(  # as many rows as shards
        "doc_id", (F.col("first_token") + F.col("start_in_shard")).alias("start"), "n_tokens", "root",
        F.col("parts.address").alias("a"), F.col("parts.n_ids").alias("n"), F.col("parts.crc").alias("c"),
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("n").to_pylist()
            for row in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_tokens", "root", "a")), sizes):
                _rebuild(*row)
            first = np.concatenate([[0], np.cumsum([len(x) for x in sizes])[:-1]])
            n, crc = batch.column("n").flatten().to_numpy(), batch.column("c").flatten().to_numpy()
            sums = joined_crc(crc, 4 * n, first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(fold, DIGEST)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document, rebuilt from its chunks and verified."""
    recipes = _recipes(spark, path)
    refs = recipes.select("shard", "position", "doc_id", "n_tokens", "root", F.posexplode("addresses").alias("k", "address"))
    stored = chunks(spark, path).withColumnRenamed("address", "key")
    held = refs.join(stored, refs["address"] == stored["key"], "left").groupBy("shard", "position").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("root").alias("root"),
        F.sort_array(F.collect_list(F.struct("k", "address", "width", "ids"))).alias("parts"),
    )
    every = held.join(F.broadcast(_manifest(spark, path, recipes)), "shard").where("first_token IS NOT NULL")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n_tokens, root, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root", "parts"))):
                if any(p["ids"] is None or address(p["width"], p["ids"]) != p["address"] for p in parts):
                    raise ValueError(f"document {doc_id} has a chunk that is missing or does not match its address")
                ids = [np.frombuffer(p["ids"], dtype="<u2" if p["width"] == 2 else "<u4").astype(np.int32) for p in parts]
                _rebuild(doc_id, n_tokens, root, [p["address"] for p in parts], [len(x) for x in ids])
                out.append(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return every.select("doc_id", "n_tokens", "root", "parts").mapInArrow(build, "doc_id bigint, ids array<int>")
