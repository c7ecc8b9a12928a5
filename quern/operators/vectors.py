"""Vector similarity: normalisation, exact top-k, matching and cluster quality.

Similarities between a stated, bounded query set and all rows run as one matrix product a batch, with the query
matrix broadcast after its size is checked; beyond the bound the queries are taken in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import scratch

#: Bytes of query vectors that one broadcast may hold.
BLOCK_BYTES = 64 << 20
#: Rows and columns of the similarities that a task holds at once, whatever the block.
TILE_ROWS, TILE_COLUMNS = 512, 4096
#: Pairs near the threshold that are recomputed at once.
CLOSE_PAIRS = 16_384


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null where a norm is below 1e-12."""
    size = norm(a) * norm(b)
    return F.when(size >= 1e-12, dot(a, b) / size)


def normalised(a: str) -> Column:
    """The vector scaled to length 1; the zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def matrix_of(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The vectors of a column as rows of float64, without a Python object a number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if not len(column) or column.null_count or flat.null_count or len(flat) % len(column) or (np.diff(column.offsets.to_numpy()) != len(flat) // len(column)).any():
        found = np.array(column.to_pylist(), dtype=np.float64)
        return found if width is None else found.reshape(len(column), width)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if width is None and len(flat) else width or 0)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


class Best:
    """The k most similar rows of each query among those offered, ties by row id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.row, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(queries, -np.inf)

    def offer(self, asked: np.ndarray, q: np.ndarray, names: np.ndarray, v: np.ndarray) -> None:
        """Rows ``names`` with unit vectors ``v`` to the queries numbered ``asked`` with unit vectors ``q``, tile by tile."""
        for j in range(0, len(asked), TILE_COLUMNS):
            part, near = asked[j : j + TILE_COLUMNS], q[j : j + TILE_COLUMNS].T
            for i in range(0, len(names), TILE_ROWS):
                sim = v[i : i + TILE_ROWS] @ near
                least = self.least[part]
                if len(sim) > self.k and (least == -np.inf).any():
                    least = np.maximum(least, np.partition(sim, len(sim) - self.k, axis=0)[len(sim) - self.k])
                x, y = np.nonzero(~(sim < least - 1e-6))  # a row this close may tie after rounding
                if len(x):
                    self._merge(part[y], names[i : i + TILE_ROWS][x], np.round(sim[x, y], 6))

    def _merge(self, query: np.ndarray, row: np.ndarray, sim: np.ndarray) -> None:
        query, row, sim = (np.concatenate(p) for p in ((self.query, query), (self.row, row), (self.sim, sim)))
        order = np.lexsort((row, -sim, query))
        query, row, sim = query[order], row[order], sim[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        held = place < self.k
        full = place == self.k - 1
        self.least[query[full]] = sim[full]
        self.query, self.row, self.sim = query[held], row[held], sim[held]


def _blocks(rows: DataFrame, row_id: str, vector: str, others: list[str], block_bytes: int) -> Iterator[tuple]:
    """(ids, unit vectors, other columns) of blocks of rows that fit ``block_bytes`` each, one at a time."""
    total = rows.count()
    width = rows.select(F.max(F.size(vector))).first()[0] or 1
    blocks = -(-total // max(1, block_bytes // (8 * width))) or 1
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(row_id), F.lit(blocks)) == block)
        held = part.select(F.col(row_id).cast("bigint"), vector, *others).toArrow()
        yield held.column(0).to_numpy(), unit_rows(matrix_of(held.column(1), width)), [held.column(k + 2).to_numpy() for k in range(len(others))]


def _units(vectors: list, width: int) -> np.ndarray:
    matrix = np.array(vectors, dtype=np.float64).reshape(len(vectors), width)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "q_id", row_id: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, row_id, sim, rank): the k most cosine-similar rows of each query, ties by row id. Exact.

    Each task keeps its own k best a query, and a ranked window joins those: what is shuffled is k rows a query
    and task. ``queries`` is a stated set; it is taken in blocks that fit ``block_bytes``, so none is ever too
    large to broadcast.
    """
    spark = rows.sparkSession
    schema = f"{query_id} bigint, {row_id} bigint, sim double"
    found = None
    for ids, matrix, _ in _blocks(queries, query_id, vector, [], block_bytes):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            kept, every = Best(len(q_ids), k), np.arange(len(q_ids))
            for batch in batches:
                if batch.num_rows and len(q_ids):
                    kept.offer(every, q, batch.column(0).to_numpy(), unit_rows(matrix_of(batch.column(1), q.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[kept.query]), pa.array(kept.row), pa.array(kept.sim)], names=[query_id, row_id, "sim"])

        near = rows.select(F.col(row_id).cast("bigint").alias(row_id), vector).mapInArrow(best, schema)
        found = near if found is None else found.unionByName(near)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("sim"), row_id))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def first_ranks(queries: DataFrame, rows: DataFrame, label: str, query_label: str, query_id: str = "q_id", row_id: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank): of each query with another row of its label, the rank of the most similar one among all other rows.

    Two passes over the rows, each with one row a query and task: the best relevant row, then how many come before it.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(row_id).cast("bigint").alias(row_id), vector, F.col(label).cast("bigint").alias(label))
    found = None
    for ids, matrix, (own,) in _blocks(queries, query_id, vector, [query_label], block_bytes):
        shared = spark.sparkContext.broadcast((ids, matrix, own))

        def scored(batch: pa.RecordBatch, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = batch.column(0).to_numpy()
            sim = np.round(q @ _units(batch.column(1).to_pylist(), q.shape[1]).T, 6)
            return np.where(row[None, :] == q_ids[:, None], -np.inf, sim), row

        def relevant(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, q_label = shared.value
            top, which = np.full(len(q_ids), -np.inf), np.zeros(len(q_ids), np.int64)
            for batch in batches:
                if batch.num_rows and len(q_ids):
                    sim, row = scored(batch, q_ids, q)
                    sim = np.where(batch.column(2).to_numpy()[None, :] == q_label[:, None], sim, -np.inf)
                    order = np.lexsort((np.tile(row, (len(q_ids), 1)), -sim), axis=1)[:, 0]
                    s, r = sim[np.arange(len(q_ids)), order], row[order]
                    better = (s > top) | ((s == top) & (r < which))
                    top, which = np.where(better, s, top), np.where(better, r, which)
            some = top > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), pa.array(top[some]), pa.array(which[some])], names=[query_id, "sim", "row"])

        best = held.mapInArrow(relevant, f"{query_id} bigint, sim double, row bigint").groupBy(query_id).agg(F.min(F.struct((-F.col("sim")).alias("sim"), "row")).alias("b"))
        known = best.select(query_id, (-F.col("b.sim")).alias("sim"), "b.row").toArrow()  # as many rows as queries in the block
        best_of = spark.sparkContext.broadcast((known.column(0).to_numpy(), known.column(1).to_numpy(), known.column(2).to_numpy()))

        def before(batches: Iterator[pa.RecordBatch], shared=shared, best_of=best_of) -> Iterator[pa.RecordBatch]:
            q_ids, q, _ = shared.value
            names, sims, firsts = best_of.value
            at = np.argsort(q_ids)[np.searchsorted(np.sort(q_ids), names)] if len(names) else np.zeros(0, int)
            count = np.zeros(len(names), np.int64)
            for batch in batches:
                if batch.num_rows and len(names):
                    sim, row = scored(batch, q_ids[at], q[at])
                    count += ((sim > sims[:, None]) | ((sim == sims[:, None]) & (row[None, :] < firsts[:, None]))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(count)], names=[query_id, "n"])

        ranks = held.mapInArrow(before, f"{query_id} bigint, n bigint").groupBy(query_id).agg((F.sum("n") + 1).alias("rank"))
        found = ranks if found is None else found.unionByName(ranks)
    return found


def link_counts(rows: DataFrame, least: float, row_id: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_id, class_id, n_links) of every row: the least id with an equal vector, and how many other rows are at least ``least`` alike.

    Exact, over all pairs of distinct vectors, block by block and in a task tile by tile; equal rows are compared once
    and counted as often as they occur. A task sends one number a row and block; pairs are never formed. Similarities
    are computed in single precision, and again in double where they are within its error of ``least``. As in the SQL, a
    zero vector's similarity is NaN, which is above any number; rows without a vector have neither class nor links.
    """
    spark = rows.sparkSession
    numbered = rows.select(F.col(row_id).cast("bigint").alias(row_id), F.col(vector).alias(vector))
    grouped = numbered.where(F.col(vector).isNotNull()).groupBy(vector).agg(F.min(row_id).alias("class_id"), F.count("*").alias("copies"))
    path = scratch(spark)
    grouped.write.parquet(path)
    classes = spark.read.schema(grouped.schema).parquet(path)
    total, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    blocks = max(1, -(-total // max(1, block_bytes // (8 * max(width, 1)))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = classes.select("class_id", vector).repartition(parts, "class_id")
    found = None
    for block in range(blocks):
        held = (classes if blocks == 1 else classes.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == block)).select("class_id", vector, "copies").toArrow()
        shared = spark.sparkContext.broadcast((held.column(0).to_numpy(), _signed_units(matrix_of(held.column(1), width)), held.column(2).to_numpy()))
        part = dealt.mapInArrow(_link_counter(shared, least), "class_id bigint, n bigint")
        found = part if found is None else found.unionByName(part)
    links = found.groupBy("class_id").agg(F.sum("n").alias("n_links"))
    own = numbered.join(classes.select(F.col(vector).alias("_v"), "class_id"), F.col(vector) == F.col("_v"), "left").select(row_id, "class_id")
    return own.join(links, "class_id", "left").select(row_id, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _signed_units(matrix: np.ndarray) -> np.ndarray:
    """Unit vectors; NaN where the vector is zero."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _link_counter(shared, least: float):
    """Per row of (class_id, vector): how many rows of the broadcast block are at least ``least`` alike, but the row itself."""

    def close(v: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        good = np.zeros(len(x), bool)
        for k in range(0, len(x), CLOSE_PAIRS):
            at = slice(k, k + CLOSE_PAIRS)
            good[at] = ~(np.round(np.einsum("ij,ij->i", v[x[at]], q[y[at]]), 6) < least)
        return good

    def tile(v, v_near, q, q_near, times) -> np.ndarray:
        margin = 1e-6 + 1.2e-7 * q.shape[1]
        sim = v_near @ q_near.T
        sure = sim >= least + margin
        links = sure.sum(axis=1) if (times == 1).all() else (sure.astype(np.float64) @ times.astype(np.float64)).astype(np.int64)
        x, y = np.nonzero(~(sim < least - margin) & ~sure)
        good = close(v, q, x, y)
        return links + np.bincount(x[good], times[y[good]], len(v)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, times = shared.value
        q_near = q.astype(np.float32)
        for batch in batches:
            own, v = batch.column(0).to_numpy(), _signed_units(matrix_of(batch.column(1), q.shape[1]))
            v_near = v.astype(np.float32)
            links = np.zeros(len(own), np.int64)
            for i in range(0, len(own), TILE_ROWS):
                rows = slice(i, i + TILE_ROWS)
                for j in range(0, len(names), TILE_COLUMNS):
                    part = slice(j, j + TILE_COLUMNS)
                    links[rows] += tile(v[rows], v_near[rows], q[part], q_near[part], times[part])
            itself = np.isin(own, names) & ~(np.round(np.einsum("ij,ij->i", v, v), 6) < least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(links - itself)], names=["class_id", "n"])

    return count


def centroids(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, centroid): the mean vector of each group, by position; partial sums before the shuffle."""
    cells = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("centroid"))


def mutual_best(pairs: DataFrame, sample: str, left: str, right: str, sim: str) -> DataFrame:
    """Pairs that are each other's best within a sample; ties go to the lower position."""
    to_right = F.row_number().over(Window.partitionBy(sample, left).orderBy(F.desc(sim), right))
    to_left = F.row_number().over(Window.partitionBy(sample, right).orderBy(F.desc(sim), left))
    return pairs.withColumn("_r", to_right).withColumn("_l", to_left).where("_r = 1 AND _l = 1").drop("_r", "_l")


def cohesion(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, size, intra): mean cosine over all pairs of a group, 1 for singletons.

    From the sum of unit vectors: |sum|^2 = n + 2 * (sum over pairs of cosines), so no pair is ever formed.
    """
    units = rows.select(by, normalised(vector).alias("u"))
    sums = units.select(by, F.posexplode("u").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("s"))
    squared = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    sizes = rows.groupBy(by).agg(F.count("*").alias("size"))
    n = F.col("size")
    return squared.join(sizes, by).select(by, "size", F.when(n > 1, (F.col("sq") - n) / (n * (n - 1))).otherwise(F.lit(1.0)).alias("intra"))
