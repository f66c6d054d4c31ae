"""Approximate nearest neighbours (operator 13): the best cosines of a stated query set against all rows.

A block matrix join. Vectors are normalised and quantised to int8 with one step a vector. Query rows are dealt into blocks of
QUERY_ROWS (fewer of many dimensions), all rows into stripes of STRIPE_ROWS (longer ones beyond STRIPES stripes, so that partial answers stay few); each
pair of a block and a stripe is one unit of work, which gets the block first and then reads its stripe batch by batch. A tile
of int8 codes is multiplied (in float32, which holds these whole numbers exactly), which gives each cosine up to a known
error: the codes' product times both steps differs from the cosine by no more than the norm of one coded vector times the
other's rounding error, plus the first one's rounding error. Pairs whose upper bound doesn't reach the k-th best score so far, or
the k-th best lower bound of the tile, drop out; the others are recomputed in double precision on the original vectors
and go to a heap for each query. Heaps of the units of a query are merged at the end. So the answer is exact.

Equal vectors: of those that are the same number by number only the k + 1 of least id can be among anybody's k best, so the
others aren't compared (a partial ranking before the shuffle, so a vector that a third of all rows hold is no hot key).

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id, take no part. Vectors of
different dimensions aren't compared. Rows that share id and vector are one; rows that share an id only are vectors of one id,
whose score is the best of theirs, as query and as candidate. Ties go to the smaller id. Fewer than k candidates give fewer
rows; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pieces_of, settle

QUERY_ROWS, STRIPE_ROWS, STRIPES = 32_768, 8192, 4096
#: Bytes of a block of queries, with their codes; of many dimensions a block has fewer rows.
QUERY_BYTES = 256 << 20
#: Rows of a tile: queries by candidates.
TILE = 1024, 4096
#: So many dimensions of products of int8 numbers are whole in float32 (127 * 127 * 1024 < 2^24).
EXACT_DIM = 1024


def usable(x: Column) -> Column:
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as float32, step, rounding error's norm) of rows of length one."""
    step = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / step[:, None])
    return codes.astype(np.float32), step, np.linalg.norm(u - codes * step[:, None], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of int8 codes."""
    if a.shape[1] <= EXACT_DIM:
        return a @ b.T
    return sum((a[:, k : k + EXACT_DIM] @ b[:, k : k + EXACT_DIM].T).astype(np.float64) for k in range(0, a.shape[1], EXACT_DIM))


class Block:
    """The queries of a unit, with a heap of the k best (score, -id) of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.u = unit(x)
        self.codes, self.step, self.error = quantised(self.u)
        self.norm = np.linalg.norm(self.codes, axis=1) * self.step
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # the k-th best score so far

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Compares the queries with a batch of candidates."""
        for at in range(0, len(ids), TILE[1]):
            some, u = ids[at : at + TILE[1]], unit(x[at : at + TILE[1]])
            codes, step, error = quantised(u)
            for low in range(0, len(self.ids), TILE[0]):
                q = slice(low, low + TILE[0])
                near = products(self.codes[q], codes) * self.step[q, None] * step
                slack = self.norm[q, None] * error + self.error[q, None] + 1e-6  # and what rounding in float32 and double adds
                upper = near + slack
                other = self.ids[q, None] != some
                floor = self.least[q]
                if len(some) > self.k:  # one more than k, for an own row; ids that occur twice may fill places, so they count once
                    lower = np.where(other, near - slack, -np.inf)
                    if len(np.unique(some)) == len(some):
                        floor = np.maximum(floor, np.partition(lower, -self.k, axis=1)[:, -self.k])
                i, j = np.nonzero(other & (upper >= floor[:, None]))
                for a in range(0, len(i), 1 << 17):
                    self._push(i[a : a + (1 << 17)] + low, j[a : a + (1 << 17)], u, some)

    def _push(self, i: np.ndarray, j: np.ndarray, u: np.ndarray, ids: np.ndarray) -> None:
        """Scores in double precision; the best few of each query go to its heap."""
        score = np.einsum("nd,nd->n", self.u[i], u[j])
        good = score >= self.least[i]
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        if not len(i):
            return
        fresh = np.ones(len(i), bool)
        fresh[1:] = (i[1:] != i[:-1]) | (ids[j][1:] != ids[j][:-1]) | (score[1:] != score[:-1])
        for a, s, c in zip(i[fresh].tolist(), score[fresh].tolist(), ids[j[fresh]].tolist()):
            heap = self.best[a]
            if len(heap) == self.k and (s, -c) <= heap[0]:
                continue
            twin = next((h for h in heap if h[1] == -c), None)
            if twin is not None:
                if s > twin[0]:
                    heap[heap.index(twin)] = (s, -c)
                    heapq.heapify(heap)
            elif len(heap) < self.k:
                heapq.heappush(heap, (s, -c))
            else:
                heapq.heapreplace(heap, (s, -c))
            if len(heap) == self.k:
                self.least[a] = heap[0][0]

    def rows(self) -> tuple[list[int], list[float], list[int]]:
        found = [(q, s, -c) for q, heap in zip(self.ids.tolist(), self.best) for s, c in heap]
        return tuple(map(list, zip(*found))) if found else ([], [], [])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, score, vec_id) of sorted rows (dim, block, stripe, candidate, id, x): the best of each unit. Queries of a
    unit come first and stay; its candidates pass by batch."""
    key, held, block = None, [], None

    def done() -> Iterator[pa.RecordBatch]:
        if block is not None:
            q, s, c = block.rows()
            if q:
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.float64()), pa.array(c, pa.int64())], ["query_id", "score", "vec_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            now, candidate = tuple(keys[a, :3].tolist()), bool(keys[a, 3])
            if now != key:
                yield from done()
                key, held, block = now, [], None
            part = batch.slice(a, b - a)
            if not candidate:
                held.append((part.column(4).to_numpy(), _matrix(part.column(5))))
            elif held or block is not None:
                if block is None:
                    block, held = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k), []
                for piece in pieces_of(part):
                    block.meet(piece.column(4).to_numpy(), _matrix(piece.column(5)))
    yield from done()


def nearest(vectors: DataFrame, queries: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest cosine of each row that the condition queries (on the id column)
    holds for, among all rows of another id."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), queries.alias("asks"))
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = own.filter(usable(F.col("x")) & F.col("id").isNotNull()).withColumn("x", F.transform("x", lambda v: v + F.lit(0).cast(kind)))  # -0.0 is 0.0
    key = F.sha2(F.array_join(F.transform("x", lambda v: F.hex(F.xxhash64(v.cast("double")))), ""), 256)
    once = settle(rows.withColumn("key", key).groupBy("key", "id").agg(F.any_value("x").alias("x"), F.coalesce(F.max("asks"), F.lit(False)).alias("asks")).withColumn("dim", F.size("x")), "op13-rows")
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    candidates = settle(once.withColumn("place", place).filter(F.col("place") <= k + 1).select("dim", "id", "x"), "op13-candidates")
    asked = once.filter("asks").select("dim", "id", "x")

    def counts(of: DataFrame, each: Column, most: int | None, name: str) -> DataFrame:
        n = F.ceil(F.count(F.lit(1)) / each)
        return of.groupBy("dim").agg((n if most is None else F.least(n, F.lit(most))).cast("int").alias(name))

    in_block = F.least(F.lit(query_rows), F.greatest(F.lit(1), F.floor(QUERY_BYTES / (20 * F.col("dim")))))
    shape = counts(asked, in_block, None, "blocks").join(counts(candidates, F.lit(stripe_rows), STRIPES, "stripes"), "dim")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    left = asked.join(shape, "dim").select("dim", deal("blocks", 1).alias("block"), every("stripes").alias("stripe"), F.lit(0).alias("side"), "id", "x")
    right = candidates.join(shape, "dim").select("dim", every("blocks").alias("block"), deal("stripes", 2).alias("stripe"), F.lit(1).alias("side"), "id", "x")
    units = left.unionByName(right).repartition("dim", "block", "stripe").sortWithinPartitions("dim", "block", "stripe", "side")
    partial = units.mapInArrow(lambda batches: _met(batches, k), "query_id long, score double, vec_id long")
    best = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = 200) -> float:
    """Share of the k best of some queries of found (those of least hash) that it holds, by brute force in one pass over all rows. Ids are
    taken to occur once."""
    asked = found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(queries)
    taken = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("x")).join(asked, "query_id").collect()
    ids, dim = np.array([r.query_id for r in taken]), len(taken[0].x)
    u = unit(np.array([r.x for r in taken]))

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(ids, u, k)
        for batch in batches:
            x, c = _matrix(batch.column(1)), batch.column(0).to_numpy()
            if len(c):
                score = u @ unit(x).T
                i, j = np.nonzero(ids[:, None] != c)
                keep = score[i, j] >= np.partition(np.where(ids[:, None] != c, score, -2), -min(k, len(c)), axis=1)[:, -min(k, len(c))][i]
                for q, s, v in zip(i[keep].tolist(), score[i, j][keep].tolist(), c[j[keep]].tolist()):
                    block.best[q].append((s, -v))
        q, s, c = block.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.float64()), pa.array(c, pa.int64())], ["query_id", "score", "vec_id"])

    x = F.col(vector_col).cast("array<double>")
    truth = vectors.filter(usable(x) & (F.size(x) == dim)).select(F.col(id_col).cast("long").alias("id"), x.alias("x")).mapInArrow(against, "query_id long, score double, vec_id long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id"))
    best = truth.withColumn("place", place).filter(F.col("place") <= k)
    r = best.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("hit").alias("a"), F.count(F.lit(1)).alias("b")).first()
    return 1.0 if not r.b else r.a / r.b
