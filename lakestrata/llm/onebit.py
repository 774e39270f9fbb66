"""Operator 9: nearest neighbours by randomly rotated one-bit codes. Each vector, less a
centre and scaled to length one, is rotated and kept as signs (one bit a dimension) with
two scalars: its length and the inner product f of the unit vector with its code. For a
query q the product with the code, over f, estimates the product with the vector; its
error stays below EPSILON * sqrt((1 - f^2) / f^2 / (D - 1)) but with vanishing
probability. Vectors whose least possible distance beats the K-th known one are reranked
by exact distances in double precision.

The index covers every row, in blocks. Only its centre is fitted, on a sample of SAMPLE
vectors: it affects speed, not which rows are searched. The stated query set is searched
against all rows, block by block: tasks are the cells of a grid of groups of vector blocks by
groups of query blocks. A task holds its queries (HELD bytes) and sees each vector block once.

Defined results. Vectors that are null, zero or hold null or non-finite components take no
part. Vectors of another dimension meet only those of their own. Rows with the query's
vec_id are not its candidates; repeated vec_ids are separate candidates; the rows of a
repeated query merge by vec_id: equal ones are searched once, and a candidate row counts
once, by its least distance to any of them. Null vec_ids take no part. Ties: smaller
vec_id. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialise, partitions, small_batches, table

NEAREST = 10
EPSILON = 4.5
SAMPLE = 4096
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 256
#: Bytes of query vectors that a task holds, about.
HELD = 16 << 20
SEED = 20


def usable(vec: Column) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & ok & F.exists(vec, lambda x: x != 0)


def rotation(d: int) -> np.ndarray:
    """A random orthogonal d x d matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths and f of vectors (rows)."""
    rest = vectors.astype(np.float64) - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    turned = rest @ turn / np.maximum(length, 1e-300)[:, None]
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


BLOCKS = "d int, place long, ids binary, rows binary, vectors binary, codes binary, lengths binary, f binary"


def kind_of(vectors: DataFrame) -> type:
    """The numpy type in which blocks hold vectors exactly."""
    return np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64


def build_blocks(vectors: DataFrame, centres: dict[int, list[float]], size: int) -> DataFrame:
    """vectors (vec_id, embedding) as blocks of up to size rows; see BLOCKS. rows numbers
    the rows of all blocks: the task and a count. place is the task and a count of its blocks."""
    kind = kind_of(vectors)

    def block(place: int, ids: list[int], numbers: list[int], rows: list[np.ndarray], d: int, centre: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
        codes, length, f = encode(np.stack(rows), centre, turn)
        parts = [np.array(ids, np.int64), np.array(numbers, np.int64), np.stack(rows), codes, length, f]
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([place], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["d", "place", "ids", "rows", "vectors", "codes", "lengths", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        turns: dict[int, tuple] = {}
        place = TaskContext.get().partitionId()
        number = place << 40
        for batch in batches:
            for vec_id, vec in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                row = vec.values.to_numpy(zero_copy_only=False).astype(kind)
                d = len(row)
                if d not in turns:
                    turns[d] = (np.array(centres.get(d, np.zeros(d))), rotation(d))
                ids, numbers, rows = held.setdefault(d, ([], [], []))
                ids.append(vec_id)
                numbers.append(number)
                number += 1
                rows.append(row)
                if len(ids) == size:
                    yield block(place, ids, numbers, rows, d, *turns[d])
                    place += 1
                    held.pop(d)
        for d, (ids, numbers, rows) in held.items():
            yield block(place, ids, numbers, rows, d, *turns[d])
            place += 1

    return vectors.mapInArrow(run, BLOCKS)


class Searcher:
    """The nearest vectors of one query block, over the vector blocks seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries.astype(np.float64), k
        rest = self.queries - centre
        self.length = np.sqrt((rest * rest).sum(axis=1))
        self.turned = (rest @ turn / np.maximum(self.length, 1e-300)[:, None]).astype(np.float32)
        self.found = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.known = np.full(len(ids), np.inf)  # squares of the k-th distances

    def search(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray, signs: np.ndarray, length: np.ndarray, f: np.ndarray) -> int:
        """Takes in a block; returns how many vectors were reranked."""
        d = vectors.shape[1]
        product = (self.turned @ signs.T) / np.sqrt(d) / np.maximum(f, 1e-12)
        error = EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / np.maximum(f * f, 1e-24) / max(d - 1, 1)) + 1e-5
        base = self.length[:, None] ** 2 + length**2
        scale = 2 * self.length[:, None] * length
        low, high = base - scale * (product + error), base - scale * (product - error)
        reranked = 0
        for q in np.flatnonzero((~(low > self.known[:, None] * (1 + 1e-9) + 1e-12)).any(axis=1)):
            scores, known, rows = self.found[q]
            others = ids != self.ids[q]
            bounds = high[q] if others.all() else high[q][others]
            limit = np.partition(bounds, self.k - 1)[self.k - 1] if len(bounds) >= self.k else np.inf
            limit = min(limit, self.known[q])
            chosen = np.flatnonzero(~(low[q] > limit * (1 + 1e-9) + 1e-12) & others)
            reranked += len(chosen)
            if not len(chosen):
                continue
            apart = vectors[chosen] - self.queries[q]
            scores = np.concatenate([scores, np.sqrt((apart * apart).sum(axis=1))])
            known = np.concatenate([known, ids[chosen]])
            rows = np.concatenate([rows, numbers[chosen]])
            order = np.lexsort((rows, known, scores))[: self.k]
            self.found[q] = (scores[order], known[order], rows[order])
            if len(order) == self.k:
                self.known[q] = scores[order[-1]] ** 2
        return reranked

    def rows(self) -> pa.RecordBatch:
        scores, known, rows = (pa.array(np.concatenate(c)) for c in zip(*self.found, strict=True))
        query = pa.array(np.repeat(self.ids, [len(s) for s, _, _ in self.found]))
        return pa.RecordBatch.from_arrays([query, known, rows, scores], ["query_id", "vec_id", "row", "score"])


def grid(tasks: int, vectors: int, queries: int, held: int) -> tuple[int, int]:
    """Groups of vectors and of queries, by their bytes: about one cell a task, no more than
    held bytes of queries a group, and else as few copies as can be."""
    by = max(1, math.ceil(queries / held), round(math.sqrt(tasks * queries / max(vectors, 1))))
    return max(1, tasks // by), by


def nearest(index: DataFrame, queries: DataFrame, centres: dict[int, list[float]], k: int = NEAREST, kind: type = np.float64, held: int = HELD) -> DataFrame:
    """query_id, rank, vec_id, score from stored blocks of vectors and of queries, whose vectors
    are of the numpy type kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers: list[Searcher] = []
        of, centre, turn = 0, np.empty(0), np.empty(0)
        for batch in batches:
            for i, d in enumerate(batch.column("d").to_pylist()):
                part = lambda name, as_kind, i=i, batch=batch: np.frombuffer(batch.column(name)[i].as_buffer(), as_kind)
                if d != of:
                    yield from (x.rows() for x in searchers)
                    searchers, of, centre, turn = [], d, np.array(centres.get(d, np.zeros(d))), rotation(d)
                ids, vectors = part("ids", np.int64), part("vectors", kind).reshape(-1, d)
                if batch.column("asked")[i].as_py():
                    searchers.append(Searcher(ids.copy(), vectors, centre, turn, k))
                elif searchers:
                    signs = np.unpackbits(part("codes", np.uint8).reshape(-1, (d + 7) // 8), axis=1, count=d).astype(np.float32) * 2 - 1
                    for x in searchers:
                        x.search(ids, part("rows", np.int64), vectors, signs, part("lengths", np.float64), part("f", np.float64))
        yield from (x.rows() for x in searchers)

    spark = index.sparkSession
    small_batches(spark)
    size = lambda blocks: blocks.agg(F.sum(F.length("ids") * F.col("d"))).first()[0] or 0
    groups, by = grid(partitions(spark), size(index), size(queries), held)
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = index.withColumns({"asked": F.lit(False), "group": F.pmod("place", F.lit(groups)).cast("int")}).withColumn("by", copies(by))
    asked = queries.select("d", "place", "ids", "vectors", F.lit(True).alias("asked"), F.pmod("place", F.lit(by)).cast("int").alias("by"))
    both = both.unionByName(asked.withColumn("group", copies(groups)), allowMissingColumns=True)
    cells = both.repartitionById(groups * by, F.col("group") * by + F.col("by")).sortWithinPartitions("d", F.desc("asked"))
    found = cells.mapInArrow(run, "query_id long, vec_id long, row long, score double")
    found = found.groupBy("query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit_centres(vectors: DataFrame) -> dict[int, list[float]]:
    """The mean vector of each length, over SAMPLE rows. Rows are thinned by the hash of their
    id before they meet in a task; only the means go to the driver."""
    hashed = vectors.withColumn("h", F.xxhash64("vec_id"))
    thin = hashed.filter(F.pmod("h", F.lit(vectors.count() // (2 * SAMPLE) + 1)) == 0)
    sample = thin.orderBy("h", "vec_id").limit(SAMPLE)
    means = sample.select(F.size("embedding").alias("d"), F.posexplode("embedding").alias("at", "x")).groupBy("d", "at").agg(F.avg("x").alias("x"))
    centres: dict[int, list[float]] = {}
    for d, _, x in means.orderBy("d", "at").collect():
        centres.setdefault(d, []).append(x if math.isfinite(x) else 0.0)
    return centres


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, held: int = HELD) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) for each row where is_query holds."""
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    centres = fit_centres(own)
    index = materialise(build_blocks(own.repartition(partitions(spark)), centres, VECTORS_PER_BLOCK), "vector-blocks")
    asked = own.filter(is_query).dropDuplicates(["vec_id", "embedding"]).repartition(max(1, partitions(spark) // 8))
    queries = materialise(build_blocks(asked, centres, QUERIES_PER_BLOCK), "query-blocks")
    return nearest(index, queries, centres, k, kind_of(own), held)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
