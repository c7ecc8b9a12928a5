"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

Two searches share one scheme. Fingerprint segments are decoded to nearby Golay codewords, which gives each a few
fuzzy keys; rows meet under equal keys; what meets is verified on the fingerprints; verified links become connected
components.

``link_64``: all pairs of 64-bit fingerprints within 3 bits, none missed. Of four 16-bit blocks one is free of
errors, and of the two 24-bit halves of the other 48 bits one has at most one error, so 23 bits of it share a Golay
key. Each fingerprint thus has 8 tables of 1 to 6 keys of 28 bits.

``near_duplicates``: all pairs of texts whose sets of word shingles (five words) have a Jaccard similarity of 0.8 or
more, none missed and none added. The 64-bit SimHash of each set is decoded to the same Golay keys; texts that meet
under one and differ in few bits are verified on the exact shingle sets, and what that links gets a common label.
Golay keys of 64 bits are sure to 3 bits only, and sets at 0.8 differ in about 10, so an exact search follows for the
rest: of sets that similar, each one's first fifth (and one) in a common order has a shingle of the other's. Texts of
different labels that share one, and pass bounds of size, position and the SimHash with five deviations of slack, are
verified as well. The order puts shingles found often in a sample last; it decides how many texts meet in vain, not
which are linked.

Equal texts are collapsed before anything is joined. Groups that share a Golay key are scanned for links in sorted
streams and leave a spanning star each, never all their pairs; the exact search compares across labels only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import golay
from quern.llm.common import checkpointed, fresh, materialize, shared_dir, small_batches, text_or_empty
from quern.llm.components import stars

#: Fixed value: seed of the shingle hash.
SEED = 42
#: Runs up to this length are compared by shifted arrays, longer ones by a search that drops what it has linked.
SHORT_RUN = 8
_U = np.uint64


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by spaces; of the whole sequence if it is shorter."""
    import xxhash

    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))) + np.arange(len(words))
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[k : k + 4096])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of each hash (a multiply-xorshift round)."""
    with np.errstate(over="ignore"):
        h = (hashes + _U(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(31)
        h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(29))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every text as a signed long. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(words_of(t.as_py()), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def keys_64(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of each table for codes of shape (n, 1)."""
    fp = codes[:, 0]
    table = 0
    for block in range(4):
        exact = (fp >> _U(16 * block)) & _U(0xFFFF)
        low = fp & _U((1 << 16 * block) - 1)
        high = (fp >> _U(16 * (block + 1))) << _U(16 * block) if block < 3 else np.zeros_like(fp)
        rest = low | high
        for half in range(2):
            found, valid = golay.keys(((rest >> _U(24 * half)) & _U(0x7FFFFF)).astype(np.uint32))
            row, column = np.nonzero(valid)
            yield row, _U(table << 28) | exact[row] << _U(12) | found[row, column].astype(np.uint64)
            table += 1


def _star_edges(codes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning stars (root, member) of the groups that links within ``most`` bits make."""
    left, edges = np.arange(len(codes)), []
    while len(left):
        root, left = int(left[0]), left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count(codes[left] ^ codes[todo.pop()]).sum(axis=1) <= most
            linked = left[near].tolist()
            left = left[~near]
            todo += linked
            edges += [(root, x) for x in linked]
    return edges


def _edges(key: np.ndarray, node: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among complete runs of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    short = np.repeat(size <= SHORT_RUN, size)
    a, b = [], []
    for shift in range(1, int(min(SHORT_RUN, size.max()))):
        at = np.flatnonzero((key[shift:] == key[:-shift]) & short[shift:])
        at = at[np.bitwise_count(codes[at] ^ codes[at + shift]).sum(axis=1) <= most]
        a.append(node[at])
        b.append(node[at + shift])
    for start, n in zip(first[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist()):
        part = slice(start, start + n)
        star = np.array(_star_edges(codes[part], most), dtype=np.int64).reshape(-1, 2)
        a.append(node[part][star[:, 0]])
        b.append(node[part][star[:, 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def link(nodes: DataFrame, keys_of, checked: slice, most: int) -> DataFrame:
    """Edges (a, b) between nodes with a common key whose checked codes differ in at most ``most`` bits.

    ``nodes`` has node (long) and code (array<long>). Rows of one key come in a run of a sorted stream; only
    nodes and codes travel. A key's run is held as arrays of some 50 bytes a node.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                node = batch.column(0).to_numpy()
                codes = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
                for row, key in keys_of(codes):
                    sent = codes[row][:, checked].view(np.int64)
                    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * sent.shape[1]), len(row), [None, pa.py_buffer(np.ascontiguousarray(sent).tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[row]), flat.cast(pa.binary())], names=["key", "node", "code"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u8").reshape(len(key), -1)
            if held is not None:
                key, node, codes = (np.concatenate(p) for p in zip(held, (key, node, codes)))
            whole = int(np.searchsorted(key, key[-1], side="left"))
            held = key[whole:], node[whole:], codes[whole:]
            if whole:
                a, b = _edges(key[:whole], node[:whole], codes[:whole], most)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held is not None:
            a, b = _edges(*held, most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = nodes.select("node", "code").mapInArrow(spread, "key bigint, node bigint, code binary")
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint")


def classes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, least) for each node: the least id among all ``members`` (node, id) of the node's component.

    ``members`` has one row a node.
    """
    roots = stars(edges)
    rooted = members.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    rooted = checkpointed(rooted)
    least = checkpointed(rooted.groupBy("root").agg(F.min("id").alias("least")))
    return rooted.join(least, "root").select("node", "least")


def link_64(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of all documents; fingerprints within ``most`` (up to 3) bits are linked."""
    if not 0 <= most <= 3:
        raise ValueError("the tables find pairs within 3 bits")
    found = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumnRenamed("fp", "node"))
    edges = link(nodes.select("node", F.array("node").alias("code")), keys_64, slice(0, 1), most)
    least = classes(nodes, edges)
    return found.join(least, found["fp"] == least["node"]).select("doc_id", "fp", F.col("least").alias("component_id"))


def most_bits(similarity: float, bits: int = 256, slack: float = 1.0) -> int:
    """Bits in which SimHashes of two sets of that Jaccard similarity differ, plus ``slack`` standard deviations."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(min(1.0, cosine)) / math.pi
    return int(bits * share + slack * math.sqrt(bits * share * (1 - share)))


#: One text in SAMPLE is counted for common shingles; the most frequent COMMON of those in OFTEN of them stand last.
SAMPLE, OFTEN, COMMON = 16, 8, 1 << 18


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(words_of(text), size)).astype(np.uint64)


def prefix(found: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first hashes of a set, those of the sorted ``common`` last: two sets that similar share one. Empty sets have key 0."""
    if not len(found):
        return np.zeros(1, dtype=np.uint64)
    last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(len(found), bool)
    return np.concatenate([found[~last], found[last]])[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that many texts of a sample have; only the cost of the search depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], names=["hash"])

    texts = docs.select(text_or_empty(docs).alias("text"), _node(docs).alias("node")).where(F.expr(f"pmod(node, {SAMPLE}) = 0")).dropDuplicates(["node"])
    counts = texts.select("text").mapInArrow(run, "hash bigint").groupBy("hash").count().where(F.col("count") >= OFTEN)
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("count"), "hash").limit(COMMON).collect()], dtype=np.int64).view(np.uint64))


def sketches(docs: DataFrame, similarity: float, shingle: int = 5) -> DataFrame:
    """(same, id, node, size, code, keys): ``same`` names a (doc_id, text), node a text; size and code are the number
    and the 64-bit SimHash of its distinct shingles, keys their prefix."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            codes = np.array([majority(_remix(s, 0)) for s in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([prefix(s, similarity, common.value).view(np.int64) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), sizes, pa.array(codes), keys], names=["same", "id", "node", "size", "code", "keys"])

    wanted = docs.select(_same(docs).alias("same"), text_or_empty(docs).alias("text"), docs["doc_id"].cast("bigint").alias("id"), _node(docs).alias("node"))
    return wanted.mapInArrow(run, "same string, id bigint, node bigint, size bigint, code bigint, keys array<bigint>")


def _may_match(rows: dict, x, y, similarity: float, most: int) -> np.ndarray:
    """Whether rows x and y of one key can be that similar if the key is the first one they share."""
    size, left, code = rows["size"], rows["size"] - rows["pos"], rows["code"]
    shared = np.minimum(left[x], left[y])  # at most
    near = shared + 1e-9 >= similarity * (size[x] + size[y] - shared)
    near |= (size[x] == 0) & (size[y] == 0)
    return near & (np.bitwise_count(code[x] ^ code[y]) <= most) & (rows["label"][x] != rows["label"][y])


def _pairs(rows: dict, similarity: float, most: int) -> list:
    """Pairs (a, b) of nodes to verify among complete runs of equal keys: those of different labels that may match."""
    key, node = rows["key"], rows["node"]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    short = np.repeat(size <= SHORT_RUN, size)
    pairs = []

    def keep(x, y):
        good = _may_match(rows, x, y, similarity, most)
        x, y = np.broadcast_arrays(x, y)
        pairs.append((np.minimum(node[x[good]], node[y[good]]), np.maximum(node[x[good]], node[y[good]])))

    for shift in range(1, int(min(SHORT_RUN, size.max()))):
        at = np.flatnonzero((key[shift:] == key[:-shift]) & short[shift:])
        keep(at, at + shift)
    for start, n in zip(first[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist()):
        names, which = np.unique(rows["label"][start : start + n], return_inverse=True)
        if len(names) > 1:  # any pair of two labels has a row outside the most frequent one
            often = which == np.bincount(which).argmax()
            held, others = start + np.flatnonzero(often), start + np.flatnonzero(~often)
            for i, row in enumerate(others):
                keep(others[i : i + 1], np.concatenate([held, others[i + 1 :]]))
    return pairs


KEYED = "key bigint, node bigint, size bigint, pos bigint, code bigint, label bigint"


def _meet(keyed: DataFrame, similarity: float, most: int) -> DataFrame:
    """KEYED -> (a, b) pairs to verify."""
    names = [part.split()[0] for part in KEYED.split(", ")]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows):
            pairs = _pairs(rows, similarity, most)
            pairs = np.unique(np.stack([np.concatenate(p) for p in zip(*pairs)], axis=1), axis=0) if pairs else np.zeros((0, 2), np.int64)
            for k in range(0, len(pairs), 50_000):
                a, b = np.ascontiguousarray(pairs[k : k + 50_000].T)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(n).to_numpy() for n in names}
            rows["code"] = rows["code"].view(np.uint64)
            if held is not None:
                rows = {n: np.concatenate([held[n], rows[n]]) for n in names}
            whole = int(np.searchsorted(rows["key"], rows["key"][-1], side="left"))
            held = {n: rows[n][whole:] for n in names}
            if whole:
                yield from found({n: rows[n][:whole] for n in names})
        if held is not None:
            yield from found(held)

    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return keyed.select(*names).repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(meet, "a bigint, b bigint")


def golay_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) pairs of nodes to verify: those that meet under a Golay key of their SimHash and differ in few bits of it."""
    met = link(nodes.select("node", F.array("code").alias("code")), keys_64, slice(0, 1), most_bits(similarity, 64))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose exact shingle sets are that similar."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared + 1e-9 >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    folder = shared_dir(docs.sparkSession)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id"), "node").select(F.col("id.same").alias("same"))
    wanted = materialize(wanted, f"{folder}/wanted")  # few as a rule: its size decides whether the texts have to move
    chosen = docs.select(_same(docs).alias("same"), _node(docs).alias("node"), text_or_empty(docs).alias("text")).join(wanted, "same", "left_semi")
    with small_batches(docs.sparkSession):
        found = checkpointed(chosen.select("node", "text").mapInArrow(sets, "node bigint, hashes binary").dropDuplicates(["node"]))
        left = found.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
        right = found.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        return checkpointed(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"))


def _node(docs: DataFrame):
    return F.xxhash64(text_or_empty(docs))


def _same(docs: DataFrame):
    return F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.md5(text_or_empty(docs))))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(same, keep): for each distinct (doc_id, text), whether its group of near copies keeps it.

    A group keeps its least doc_id (nulls last), of rows with that id the one with the least ``same``.
    """
    folder = shared_dir(docs.sparkSession)
    with small_batches(docs.sparkSession):
        nodes = materialize(sketches(docs, similarity, shingle).groupBy("node").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("id"), *[F.first(c).alias(c) for c in ("size", "code", "keys")]), f"{folder}/nodes")
    edges = verified(docs, nodes, materialize(golay_pairs(nodes, similarity), f"{folder}/golay"), similarity, shingle)
    labelled = nodes.select("node", "size", "code", "keys").join(stars(edges), "node", "left")
    keyed = labelled.select("node", "size", "code", F.coalesce("root", "node").alias("label"), F.posexplode("keys").alias("pos", "key"))
    rest = _meet(keyed.withColumn("pos", F.col("pos").cast("bigint")), similarity, most_bits(similarity, 64, 5.0)).distinct()
    more = verified(docs, nodes, materialize(rest, f"{folder}/rest"), similarity, shingle)
    kept = classes(nodes.select("node", "id"), edges.unionByName(more)).select(F.col("least.same").alias("same")).distinct()
    return kept


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` with one of each group of near copies, with their own columns.

    Rows that repeat a kept row in doc_id and text go as well.
    """
    (name,) = fresh(docs, "same")
    kept = near_duplicates(docs, similarity, shingle).withColumnRenamed("same", name)
    marked = docs.withColumn(name, _same(docs))
    return marked.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
