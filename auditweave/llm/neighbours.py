"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and assigned to the
nearest signed axis; ``depth`` such assignments make a bucket, and there are TABLES independent tables. A query looks into
the PROBES buckets of each table whose axes are next to its own; all vectors there are compared with it exactly, in
double precision on the original vectors.

Largest inner products become nearest directions by one more coordinate: with the greatest norm M, x goes to
(x / M, sqrt(1 - |x|^2 / M^2)) and a query to (q / |q|, 0). It is left out where all norms agree within one percent.

Depth grows with the number of vectors, so buckets keep a bounded mean size. Buckets are cut into blocks of at most about
BLOCK vectors and a query visits all blocks of its buckets, so no task holds a large bucket. Of equal vectors the k + 1
with the smallest ids are indexed: no query can have others among its k nearest. Queries that find fewer than k vectors
are compared with all, in blocks.

Defined results: null, zero, non-finite or null-holding vectors, null vec_ids, and vectors whose length is not the
table's most frequent one (of equally frequent ones, the longest) take no part; rows with the query's vec_id are its own;
an empty table gives no rows.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import cut, query, table

K = 20
TABLES = 10
#: Probed buckets per table, by depth; deeper tables have smaller buckets.
PROBES = {0: 1, 1: 10, 2: 128, 3: 768}
#: Vectors per bucket that depth aims at, and vectors compared as one block.
BUCKET, BLOCK = 64, 8192
_SEED = 52711


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hash:
    """The rotations of one index, from its size alone."""

    def __init__(self, width: int, depth: int, norm: float, extra: bool, tables: int = TABLES, probes: int | None = None):
        self.width, self.depth, self.norm, self.extra, self.tables = width, depth, norm, extra, tables
        self.size = 1 << max(0, width + extra - 1).bit_length()
        self.probes = min(probes or PROBES.get(depth, PROBES[3]), (2 * self.size) ** depth)
        self.signs = np.random.default_rng(_SEED).choice([-1.0, 1.0], size=(tables, depth, 3, self.size))

    def _place(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        out = np.zeros((len(x), self.size))
        if is_query or not self.extra:
            out[:, : self.width] = x / norms
        else:
            out[:, : self.width] = x / self.norm
            out[:, self.width] = np.sqrt(np.maximum(0, 1 - (norms[:, 0] / self.norm) ** 2))
        return out

    def _turned(self, x: np.ndarray, t: int, k: int) -> np.ndarray:
        for signs in self.signs[t, k]:
            x = hadamard(x * signs)
        return np.concatenate([x, -x], axis=1)  # closeness to each signed axis

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table, (n, tables)."""
        x = self._place(x, False)
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for k in range(self.depth):
                out[:, t] = out[:, t] * (2 * self.size) + self._turned(x, t, k).argmax(axis=1)
            out[:, t] = out[:, t] * self.tables + t
        return out

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Buckets to look into, (n, tables * probes): those that lose the least closeness, in squares over the axes."""
        x = self._place(x, True)
        out = []
        near = min(2 * self.size, max(2, self.probes if self.depth < 2 else 4 * math.ceil(self.probes ** (1 / max(1, self.depth)))))
        for t in range(self.tables):
            code, loss = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
            for k in range(self.depth):
                close = self._turned(x, t, k)
                axes = np.argsort(-close, axis=1, kind="stable")[:, :near]
                lost = (close.max(axis=1, keepdims=True) - np.take_along_axis(close, axes, axis=1)) ** 2
                code = (code[:, :, None] * (2 * self.size) + axes[:, None, :]).reshape(len(x), -1)
                loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
                best = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
                code, loss = np.take_along_axis(code, best, axis=1), np.take_along_axis(loss, best, axis=1)
            out.append(code * self.tables + t)
        return np.concatenate(out, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vector as array<double>) of the rows that take part, but for their length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("vector") > 0) & fine & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest(q_ids, q, ids, x, k: int):
    """(query, id, score) of the k nearest to each query in one block, ties to smaller ids."""
    out = []
    for s in range(0, len(q), 256):
        own = q[s:s + 256]
        score = own @ x.T
        score[q_ids[s:s + 256, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            bound = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            bound = np.full(len(own), -np.inf)
        # The product's rounding depends on its shape; candidates near the bound are scored again, each alone.
        slack = 1e-9 * (np.abs(bound, where=np.isfinite(bound), out=np.zeros_like(bound)) + 1)
        i, j = np.nonzero((score >= (bound - slack)[:, None]) & np.isfinite(score))
        exact = (own[i] * x[j]).sum(axis=1)
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(own)))
        kept = np.arange(len(i)) - first[i] < k
        out.append((q_ids[s:s + 256][i[kept]], ids[j[kept]], exact[kept]))
    return [np.concatenate(v) for v in zip(*out)]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _compare(width: int, k: int):
    """Over rows sorted by bucket and block, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_ids, held, ids, x = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block, asks, names = (batch[c].to_numpy(zero_copy_only=False) for c in ("bucket", "block", "asks", "id"))
            vectors = _matrix(batch["vector"], width)
            change = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(bucket)]):
                if at != (bucket[a], block[a]):
                    at, held_ids, held, ids = (bucket[a], block[a]), [], [], None
                if not asks[a]:
                    held_ids.append(names[a:b])
                    held.append(vectors[a:b])
                elif held:
                    if ids is None:
                        ids, x = np.concatenate(held_ids), np.concatenate(held)
                    found = _nearest(names[a:b], vectors[a:b], ids, x, k)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], schema=_FOUND)

    return run


def _search(index: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """Nearest in each block: index (bucket, id, vector) against queries (bucket, id, vector)."""
    crowded = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(
        "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = index.join(crowded, "bucket", "left").select(
        "bucket", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "vector")
    asking = queries.join(crowded, "bucket", "left").select(
        "bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("asks"), "id", "vector")
    rows = dealt.unionByName(asking).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks")
    return rows.mapInArrow(_compare(width, k), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best per query. A pair found in several tables has one score, so equal ranks are the same pair."""
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).distinct()


def depth_for(n: int, size: int) -> int:
    return max(0, min(3, math.floor(math.log(max(1, n / BUCKET)) / math.log(2 * size)))) if n > 32 * BUCKET else 0


def nearest(vectors: DataFrame, asked, k: int = K, tables: int = TABLES, probes: int | None = None, depth: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for the rows that ``asked`` (a condition on id) picks."""
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("vector").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), *[f(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))])
    shape = lengths.orderBy(F.col("n").desc(), F.col("width").desc()).first()
    if shape is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = shape["width"], shape["n"]
    rows = rows.where(F.size("vector") == width)
    extra = shape["low"] < 0.99 * shape["high"]
    size = 1 << max(0, width + extra - 1).bit_length()
    hashes = Hash(width, depth_for(n, size) if depth is None else depth, shape["high"], extra, tables if depth != 0 else 1, probes)
    if hashes.depth == 0:
        hashes = Hash(width, 0, shape["high"], extra, 1)

    def hashed(ask: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch["vector"], width)
                    found = hashes.probed(x) if ask else hashes.buckets(x)
                    per = found.shape[1]
                    take = pa.array(np.repeat(np.arange(len(x)), per))
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), batch["id"].take(take), batch["vector"].take(take)], names=["bucket", "id", "vector"])

        return run

    same = Window.partitionBy("vector").orderBy("id")
    index = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("id", "vector")
    queries = rows.where(asked)
    ddl = "bucket long, id long, vector array<double>"
    found = cut(_best(_search(index.mapInArrow(hashed(False), ddl), queries.mapInArrow(hashed(True), ddl), width, k), k), "found")
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    short = queries.join(enough, "id", "left_anti")
    if not short.isEmpty():
        everything = _search(index.withColumn("bucket", F.lit(0).cast("long")), short.withColumn("bucket", F.lit(0).cast("long")), width, k)
        found = _best(found.select("query_id", "vec_id", "score").unionByName(everything), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op1_cross_polytope")
def op1_cross_polytope(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
