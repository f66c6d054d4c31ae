"""Embedding near-dedup (operator 4).

Vectors are normalised and turned onto their principal axes (all rows' second moments; a d x d table is
all that leaves the tasks), so that leading dimensions carry most of an inner product. Pairs are compared
in tiles: the product over the leading dimensions is accumulated block by block, what is left of it is
bounded by the product of both vectors' suffix norms, and pairs that can't reach the threshold drop out
before the next block; a tile with none left stops. What is left is decided on the given components, so a close call doesn't depend on how the
axes were rounded.

Tiles: rows meet in cells around centres, which are fitted on a bounded sample of SAMPLE rows, one for every CELL_ROWS
rows, up to half of the sample. A row is at home in its nearest cell. If the home c of one row of a pair and the home h of
the other differ, the other lies no farther behind the plane between c and h than the pair's distance, which the
threshold bounds: q . (h - c) <= |q - p| |h - c|. So every row also visits each lower cell for which that holds, and no pair at the threshold is
left out, however many cells there are. A cell's own rows are compared with each other and with its visitors, so
a pair is counted once: in the lower of both homes. Own rows and visitors are cut into slices and each pair of slices is a unit of work, so no
cell is capped. Rows in groups apart from each other visit few cells; rows without groups visit most of them, and then the work is that of all pairs.

Exactly equal vectors are one class, combined before anything is compared, so a vector that a third of
all rows hold is compared once. Of a unit's links only counts by row and a spanning forest leave it.

Null or zero vectors, and those with null or non-finite components, link with nothing; they are their
own component. Vectors of another dimension than most rows are compared with those of theirs only. Rows
without an id get no component. Rows that share an id and a vector are one vector, which doesn't link with itself; rows that
share an id but not a vector are vectors of their own, each linked with the others it is close to. An empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .minhash import _Sets, _units
from .neighbours import usable
from .shared import settle

SAMPLE, CELL_ROWS, SLICE, BLOCK = 65_536, 8192, 8192, 16
#: Bytes of the sample, and of its centres, at most: of more than 512 dimensions fewer rows are taken.
SAMPLE_BYTES = 256 << 20


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes as columns, the one of the largest second moment first, from all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0), dim))
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(dim), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})

    parts = vectors.select("x").mapInArrow(moments, "k int, row array<double>")
    sums = parts.groupBy("k").agg(F.array(*(F.sum(F.col("row")[i]) for i in range(dim))).alias("row")).collect()
    moment = np.array([r["row"] for r in sorted(sums)])
    values, axes = np.linalg.eigh(moment)
    return axes[:, ::-1]


class Cells:
    """Centres, directions of unit length: rows of a sample, each moved to the mean of the rows nearest to it, a few
    times. As many as CELL_ROWS rows each ask for, half of the sample at most."""

    def __init__(self, sample: np.ndarray, rows: int, rounds: int = 3) -> None:
        count = max(1, min(-(-rows // CELL_ROWS), len(sample) // 2))
        self.centres = sample[:count].astype(np.float32)
        for _ in range(rounds if count > 1 else 0):
            best = self.nearest(sample)
            order = np.argsort(best, kind="stable")
            cuts = np.flatnonzero(np.diff(best[order], prepend=-1))
            sums = np.add.reduceat(sample[order], cuts)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            moved = best[order][cuts][norms[:, 0] > 1e-9]
            self.centres[moved] = (sums / np.maximum(norms, 1e-9))[norms[:, 0] > 1e-9]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """For each row its nearest cell."""
        return np.concatenate([(x[at : at + 512].astype(np.float32) @ self.centres.T).argmax(axis=1) for at in range(0, len(x), 512)])

    def visits(self, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home of each row, row and cell of each visit to a lower cell): rows of unit length at the threshold meet at the lower of their homes."""
        chord, slack = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6, 5e-7 * (x.shape[1] + 8)  # centres and products are rounded
        squares, homes, rows, to = (self.centres**2).sum(axis=1), [], [], []
        for at in range(0, len(x), 512):
            near = x[at : at + 512].astype(np.float32) @ self.centres.T
            home = near.argmax(axis=1)
            used, which = np.unique(home, return_inverse=True)
            apart = np.sqrt(np.maximum(squares[used][:, None] + squares - 2 * self.centres[used] @ self.centres.T, 0) + 2 * slack)
            behind = near[np.arange(len(near)), home][:, None] - near
            row, cell = np.nonzero((behind <= chord * apart[which] + slack) & (np.arange(near.shape[1]) < home[:, None]))
            homes.append(home)
            rows.append(row + at)
            to.append(cell)
        return np.concatenate(homes), np.concatenate(rows), np.concatenate(to)


def close_pairs(one: np.ndarray, two: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with one[i] . two[j] >= least, or below it by rounding only, for rows of unit length on principal axes: leading
    dimensions first, and only pairs whose bound can still reach least go on."""
    dim = one.shape[1]
    tail_one = np.sqrt(np.maximum(np.cumsum(one[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    tail_two = np.sqrt(np.maximum(np.cumsum(two[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    so_far = one[:, :BLOCK] @ two[:, :BLOCK].T
    slack = 1e-9
    if dim <= BLOCK:
        i, j = np.nonzero(so_far >= least - slack)
    else:
        i, j = np.nonzero(so_far >= least - slack - np.outer(tail_one[:, BLOCK], tail_two[:, BLOCK]))
        value = so_far[i, j]
        for at in range(BLOCK, dim, BLOCK):
            if not len(i):
                break
            end = min(dim, at + BLOCK)
            value = value + np.einsum("nd,nd->n", one[i, at:end], two[j, at:end])
            bound = tail_one[i, end] * tail_two[j, end] if end < dim else 0.0
            stay = value + bound >= least - slack
            i, j, value = i[stay], j[stay], value[stay]
    if not len(i):
        return i, j
    near = np.einsum("nd,nd->n", one[i], two[j]) >= least - slack
    return i[near], j[near]


def _forest(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs make a spanning forest."""
    sets = _Sets(count)
    return np.array([k for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())) if sets.join(a, b)], int)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row a vector: (id, n_links, component_id, kept)."""
    finite = usable(F.col("x"))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    # -0.0 and 0.0 are the same number.
    good = own.filter(finite & F.col("id").isNotNull()).withColumn("x", F.transform("x", lambda v: v + 0.0))
    key = F.sha2(F.array_join(F.transform("x", lambda v: F.hex(F.xxhash64(v))), ""), 256)
    keyed = settle(good.select("id", key.alias("key"), "x"), "op4-keyed")
    classes = settle(keyed.groupBy("key", "id").agg(F.any_value("x").alias("x")).groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("x").alias("x")), "op4-classes")
    found, forest = [], []
    for dim, rows in sorted((r["dim"], r["n"]) for r in classes.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()):
        units = settle(_compared(classes.filter(F.size("x") == dim), dim, rows, cosine), f"op4-units-{dim}")
        found.append(units.filter("other is null").select("id", "links"))
        forest.append(units.filter("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    if not found:
        return own.select(F.col("id").cast(dict(vectors.dtypes)[id_col]).alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links, edges = found[0], forest[0]
    for a, b in zip(found[1:], forest[1:]):
        links, edges = links.unionByName(a), edges.unionByName(b)
    by_class = classes.select("key", "id", "copies").join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(components(edges, "op4-components").withColumnRenamed("node", "id"), "id", "left")
    ends = by_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    placed = keyed.select("id", "key").join(ends, "key").select("id", "n_links", "component_id").unionByName(own.filter(~F.coalesce(finite, F.lit(False)) | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return placed.select(F.col("id").cast(dict(vectors.dtypes)[id_col]).alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _compared(classes: DataFrame, dim: int, rows: int, cosine: float) -> DataFrame:
    """(id, links, other): links of a class, weighted by copies (other null), and forest edges."""
    axes = principal_axes(classes, dim)
    taken = classes.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(2, SAMPLE_BYTES // (8 * dim)))).collect() if rows > CELL_ROWS else classes.select("x").limit(1).collect()
    cells = Cells(_unit(np.array([r["x"] for r in taken])) @ axes, rows)

    def places(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _unit(_matrix(batch.column(2), dim))
            home, row, cell = cells.visits(u @ axes, cosine)
            row, cell, own = np.concatenate([np.arange(len(u)), row]), np.concatenate([home, cell]), np.arange(len(home) + len(row)) < len(home)
            for at in range(0, len(row) if whole else 0, 8192):
                k = row[at : at + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[at : at + 8192], pa.int64()), pa.array(own[at : at + 8192]), batch.column(0).take(pa.array(k)), batch.column(1).take(pa.array(k)), pa.array([r.tobytes() for r in u[k]], pa.binary())],
                    ["cell", "own", "id", "copies", "u"],
                )
            if not whole:
                kinds, n = np.unique(cell * 2 + own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds // 2, pa.int64()), pa.array(np.where(kinds % 2, n, 0), pa.int64()), pa.array(np.where(kinds % 2, 0, n), pa.int64())], ["cell", "own", "visits"])

    told = classes.select("id", "copies", "x")
    sizes = told.mapInArrow(lambda batches: places(batches, False), "cell long, own long, visits long").groupBy("cell").agg(F.ceil(F.sum("own") / SLICE).cast("int").alias("at_home"), F.ceil(F.sum("visits") / SLICE).cast("int").alias("away"))
    placed = told.mapInArrow(lambda batches: places(batches, True), "cell long, own boolean, id long, copies long, u binary").join(F.broadcast(settle(sizes, f"op4-sizes-{dim}").filter("at_home > 0")), "cell")  # a row a cell
    part = F.xxhash64("id")
    spread = placed.withColumn("slice", F.when(F.col("own"), F.pmod(part, F.col("at_home"))).otherwise(F.col("at_home") + F.pmod(part, F.col("away"))).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("at_home") + F.col("away")).otherwise(F.col("at_home")) - 1)))
    dealt = spread.select(F.col("cell").alias("bucket"), F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "id", "copies", "u").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            ids, copies = unit["id"].to_numpy(), unit["copies"].to_numpy()
            u = np.frombuffer(b"".join(unit["u"].to_pylist()), np.float64).reshape(-1, dim)
            y = u @ axes
            apart = unit["i"][0].as_py() != unit["j"][0].as_py()
            side = unit["slice"].to_numpy() == unit["i"][0].as_py() if apart else np.ones(len(ids), bool)
            left, right = np.flatnonzero(side), np.flatnonzero(~side) if apart else np.arange(len(ids))
            links, a_all, b_all = np.zeros(len(ids), np.int64), [], []
            for at in range(0, len(left), 512):
                a, b = close_pairs(y[left[at : at + 512]], y[right], cosine)
                a, b = left[at : at + 512][a], right[b]
                sure = np.einsum("nd,nd->n", u[a], u[b]) >= cosine  # on the given components, whatever the axes
                a, b = a[sure], b[sure]
                if not apart:
                    a, b = a[a < b], b[a < b]
                a_all.append(a)
                b_all.append(b)
            if not a_all:
                continue
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            some = np.flatnonzero(links)
            tree = _forest(len(ids), a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], ids[a[tree]]]), pa.int64()), pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)]), pa.int64()), pa.array([None] * len(some) + ids[b[tree]].tolist(), pa.int64())],
                ["id", "links", "other"],
            )

    return dealt.mapInArrow(compare, "id long, links long, other long")


def recall(vectors: DataFrame, found: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, queries: int = 2000) -> float:
    """Share of the links of some vectors (those of least hash of the id, each with an id and vector of its own) that found, a
    result of near_duplicates(), counts: brute force of `queries` rows against all of their dimension, one pass. Vectors that link with nothing don't
    count."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter(usable(F.col("x")) & F.col("id").isNotNull())
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    taken = [r for r in taken if len(r["x"]) == len(taken[0]["x"])]
    if not taken:
        return 1.0
    own, ids = _unit(np.array([r["x"] for r in taken], float)), np.array([r["id"] for r in taken])

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                close = own @ _unit(_matrix(batch.column(1), own.shape[1])).T >= cosine
                links += (close & (ids[:, None] != batch.column(0).to_numpy())).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["id", "links"])

    truth = rows.filter(F.size("x") == own.shape[1]).mapInArrow(against, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    r = truth.join(found.select(F.col(id_col).cast("long").alias("id"), "n_links"), "id").agg(F.sum(F.least("links", "n_links")).alias("a"), F.sum("links").alias("b")).first()
    return 1.0 if not r.b else r.a / r.b
