"""Convex hulls in any number of dimensions.

A hull is grown point by point: the point farthest outside takes away every facet that it sees or that lies in a plane
with it, and is joined to the rim of what it took (the ridges that only one taken facet has). Taking coplanar facets along
makes every new facet a proper one, and a point that a later one makes superfluous loses all its facets, so what is left are
the vertices. Points that don't span the space are handled in their affine span.

Of a table, hulls are found per partition, batch by batch, and merged in a tree of FAN_IN tables each, so no task sees more than
FAN_IN hulls, one batch of points and their vertices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16


def monotone_chain(p: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """Numbers of the vertices of distinct points in the plane, counter-clockwise; turns of eps or less are none."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    if len(p) < 3:
        return order

    def half(order: list[int]) -> list[int]:
        kept: list[int] = []
        for k in order:
            while len(kept) > 1 and (p[kept[-1], 0] - p[kept[-2], 0]) * (p[k, 1] - p[kept[-2], 1]) - (p[kept[-1], 1] - p[kept[-2], 1]) * (p[k, 0] - p[kept[-2], 0]) <= eps:
                kept.pop()
            kept.append(k)
        return kept[:-1]

    return np.array(half(order.tolist()) + half(order[::-1].tolist()))


def span(points: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """Orthonormal directions (rows) of the affine span, the widest first."""
    off = points - points.mean(axis=0)
    size = np.abs(off).max(initial=0.0)
    if size == 0:
        return np.zeros((0, points.shape[1]))
    _, values, axes = np.linalg.svd(off / size, full_matrices=False)
    return axes[values > eps * np.sqrt(len(points))]


def _simplex(points: np.ndarray) -> list[int]:
    """Numbers of dim + 1 points in general position, each as far as can be from the flat of those before it."""
    chosen = [int(points[:, 0].argmin())]
    off = points - points[chosen[0]]
    for _ in range(points.shape[1]):
        far = np.linalg.norm(off, axis=1)
        k = int(far.argmax())
        chosen.append(k)
        along = off[k] / far[k]
        off = off - np.outer(off @ along, along)
    return chosen


def _planes(corners: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """[unit normal, offset] of facets (n x dim x dim corners), positive on the side away from inside."""
    _, _, axes = np.linalg.svd(corners[:, 1:] - corners[:, :1])
    normal = axes[:, -1]
    offset = -np.einsum("nd,nd->n", normal, corners[:, 0])
    sign = np.where(normal @ inside + offset > 0, -1.0, 1.0)
    return np.column_stack([normal, offset]) * sign[:, None]


def grow(points: np.ndarray, eps: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(facets: numbers of dim points each, planes) of the hull of points that span all dim >= 2 dimensions."""
    size = np.abs(points - points.mean(axis=0)).max()
    p = (points - points.mean(axis=0)) / size
    first = _simplex(p)
    inside = p[first].mean(axis=0)
    facets = np.array([first[:k] + first[k + 1 :] for k in range(len(first))])
    planes = _planes(p[facets], inside)
    left = np.setdiff1d(np.arange(len(p)), first)
    while len(left):
        far = np.full(len(left), -np.inf)
        for at in range(0, len(planes), 1024):  # so that memory follows the points
            far = np.maximum(far, (p[left] @ planes[at : at + 1024, :-1].T + planes[at : at + 1024, -1]).max(axis=1))
        left, far = left[far > eps], far[far > eps]
        if not len(left):
            break
        k = int(left[far.argmax()])
        taken = planes[:, :-1] @ p[k] + planes[:, -1] > -eps
        ridges = np.sort(np.concatenate([np.delete(facets[taken], c, axis=1) for c in range(facets.shape[1])]), axis=1)
        rim, times = np.unique(ridges, axis=0, return_counts=True)
        new = np.column_stack([rim[times == 1], np.full((times == 1).sum(), k)])
        facets, planes = np.concatenate([facets[~taken], new]), np.concatenate([planes[~taken], _planes(p[new], inside)])
        left = left[left != k]
    planes[:, -1] = planes[:, -1] * size - planes[:, :-1] @ points.mean(axis=0)
    return facets, planes


def facets(points: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray, list[frozenset[int]]]:
    """(vertices, equations [outward unit normal, offset], vertex numbers on each facet) of a hull in two or more
    dimensions. Too few points, or ones that don't span all dimensions, raise ValueError."""
    points = np.unique(np.atleast_2d(np.asarray(points, float)), axis=0)
    dim = points.shape[1]
    if dim < 2:
        raise ValueError("one dimension has no facets; take the least and the greatest")
    if tol <= 0:
        raise ValueError("tol must be positive")
    if len(points) < dim + 1 or len(span(points)) < dim:
        raise ValueError("a hull needs points that span all dimensions")
    if dim == 2:
        v = points[monotone_chain(points)]
        after = np.roll(v, -1, axis=0)
        normal = np.stack([after[:, 1] - v[:, 1], v[:, 0] - after[:, 0]], axis=1)
        normal /= np.linalg.norm(normal, axis=1, keepdims=True)
        return v, np.column_stack([normal, -(normal * v).sum(axis=1)]), [frozenset((k, (k + 1) % len(v))) for k in range(len(v))]
    simplices, planes = grow(points)
    corners, numbers = np.unique(simplices, return_inverse=True)
    scale = max(1.0, np.abs(points).max())
    faces: dict[tuple, tuple[np.ndarray, set[int]]] = {}
    for e, s in zip(planes, numbers.reshape(simplices.shape)):  # facets in one plane are one
        faces.setdefault(tuple(np.round(np.append(e[:-1], e[-1] / scale), 8) + 0.0), (e, set()))[1].update(s.tolist())
    used = points[corners]
    sets = [frozenset(s | set(np.flatnonzero(np.abs(used @ e[:-1] + e[-1]) <= 1e-10 * scale).tolist())) for e, s in faces.values()]
    return used, np.array([e for e, _ in faces.values()]), sets


def vertices(points: np.ndarray) -> np.ndarray:
    """The vertices of any points: of one point itself, of points on a line the two ends, of points in a plane those of the
    hull there, and so on."""
    points = np.unique(np.atleast_2d(np.asarray(points, float)), axis=0)
    if len(points) < 2:
        return points
    axes = span(points)
    flat = (points - points.mean(axis=0)) @ axes.T
    if len(axes) == 0:
        return points[:1]
    if len(axes) == 1:
        return points[[int(flat[:, 0].argmin()), int(flat[:, 0].argmax())]]
    if points.shape[1] == 2:
        return points[monotone_chain(points)]
    if len(axes) == 2:
        return points[monotone_chain(flat / np.abs(flat).max(), 1e-11)]
    return points[np.unique(grow(flat)[0])]


def hull_vertices(positives: DataFrame, dim: int, fan_in: int = FAN_IN) -> DataFrame:
    """(x) the vertices of many points (x: dim numbers; rows without x don't count)."""
    rows = positives.filter("x is not null")
    if dim == 1:
        return rows.agg(F.min(F.col("x")[0]).alias("a"), F.max(F.col("x")[0]).alias("b")).filter("a is not null").select(F.explode(F.array_distinct(F.array(F.array("a"), F.array("b")))).alias("x"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, dim))
        for batch in batches:
            if batch.num_rows:
                held = vertices(np.concatenate([held, batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)]))
        yield pa.RecordBatch.from_arrays([pa.array(held.tolist(), pa.list_(pa.float64()))], ["x"])

    out, parts = rows.select("x").mapInArrow(local, "x array<double>"), fan_in * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // fan_in)
        out = out.repartition(parts).mapInArrow(local, "x array<double>")  # only vertices get here
    return out
