"""Hulls in any number of dimensions against half-spaces and separating planes."""

import itertools

import numpy as np
import pytest

from gleaner.operators import hulls, polytope as P


def exact_vertices(points):
    """Numbers of points that are not on the inner side of the hull of the others, by trying the planes through all dim points."""
    n, dim = points.shape
    out = set()
    for face in itertools.combinations(range(n), dim):
        base = points[list(face)]
        normal = np.linalg.svd(base[1:] - base[0])[2][-1] if dim > 1 else np.ones(1)
        if np.linalg.matrix_rank(base[1:] - base[0], tol=1e-9) < dim - 1:
            continue
        side = (points - base[0]) @ normal
        if (side <= 1e-9).all() or (side >= -1e-9).all():
            out |= set(face)
    return out


@pytest.mark.parametrize("dim,n", [(3, 14), (4, 13), (5, 12)])
def test_vertices_and_planes_by_brute_force(dim, n):
    rng = np.random.default_rng(dim)
    for _ in range(6):
        points = rng.normal(size=(n, dim))
        points = np.vstack([points, points[: dim + 1].mean(axis=0), points.mean(axis=0)])
        corners, planes, sets = hulls.facets(points)
        assert {tuple(c) for c in corners} == {tuple(points[k]) for k in exact_vertices(points)}
        assert (points @ planes[:, :-1].T + planes[:, -1] <= 1e-9).all()
        for e, s in zip(planes, sets):
            assert len(s) >= dim and np.abs(corners[sorted(s)] @ e[:-1] + e[-1]).max() < 1e-9
        assert np.allclose(np.linalg.norm(planes[:, :-1], axis=1), 1)


@pytest.mark.parametrize("dim", [3, 4, 5])
def test_cubes_have_their_corners_and_faces_whatever_lies_on_them(dim):
    corners = np.array(list(itertools.product([0.0, 2.0], repeat=dim)))
    grid = np.array(list(itertools.product([0.0, 1.0, 2.0], repeat=dim)))
    rng = np.random.default_rng(0)
    for _ in range(3):
        v, planes, sets = hulls.facets(rng.permutation(grid))
        assert {tuple(c) for c in v} == {tuple(c) for c in corners}
        assert len(planes) == 2 * dim and all(len(s) == 2 ** (dim - 1) for s in sets)


def test_flat_points_have_the_vertices_of_their_span():
    rng = np.random.default_rng(1)
    plane = rng.uniform(-1, 1, size=(500, 2)) @ np.array([[1.0, 0, 2], [0, 1.0, -1]]) + [3, 4, 5]
    square = np.array([[-2.0, -2], [-2, 2], [2, -2], [2, 2]]) @ np.array([[1.0, 0, 2], [0, 1.0, -1]]) + [3, 4, 5]
    assert {tuple(np.round(v, 9)) for v in hulls.vertices(np.vstack([plane, square]))} == {tuple(np.round(v, 9)) for v in square}
    line = np.array([[k, 2.0 * k] for k in range(9)])
    assert {tuple(v) for v in hulls.vertices(line)} == {(0.0, 0.0), (8.0, 16.0)}
    assert {tuple(v) for v in hulls.vertices(np.array([[k, 2.0 * k, 7 - k, 1.0] for k in range(9)]))} == {(0.0, 0.0, 7.0, 1.0), (8.0, 16.0, -1.0, 1.0)}
    assert hulls.vertices(np.ones((5, 3))).tolist() == [[1.0, 1.0, 1.0]]
    cube = np.array(list(itertools.product([0.0, 1.0, 2.0], repeat=3))) @ rng.normal(size=(3, 5))
    assert len(hulls.vertices(cube)) == 8
    with pytest.raises(ValueError):
        hulls.facets(plane)


@pytest.mark.parametrize("dim", [4, 5])
def test_polytope_says_what_half_spaces_and_cones_say(dim):
    rng = np.random.default_rng(dim)
    positive, negative = rng.normal(size=(12, dim)), rng.normal(size=(3, dim)) * 0.1 + 6
    model = P.polytope("positive", 1e-9).fit(np.vstack([positive, negative]), np.array([1] * 12 + [0] * 3))
    rows = np.vstack([rng.normal(size=(300, dim)), rng.normal(size=(300, dim)) * 4 + 5, negative, positive])
    planes = hulls.facets(positive)[1]
    inside = (rows @ planes[:, :-1].T + planes[:, -1] <= 1e-9).all(axis=1)
    got = model.predict(rows)
    assert ((got == 1) == inside).all() and (got[-15:-12] == 0).all()
    # Behind a negative point: the way from the row to it, gone on, meets the hull, so a mix of row and positives gives the point.
    for row, label in zip(rows[:600], got[:600]):
        ways = [negative[i] + t * (negative[i] - row) for i in range(3) for t in np.linspace(0.02, 30, 400)]
        meets = any((np.array(ways) @ planes[:, :-1].T + planes[:, -1] <= -1e-6).all(axis=1))
        assert not meets or label == 0
    assert {0.0, 0.5, 1.0} <= set(got)


def test_a_negative_point_inside_makes_the_model_invalid():
    model = P.polytope("positive").fit(np.vstack([np.eye(4) * 4, -np.eye(4) * 4, np.zeros((1, 4))]), np.array([1] * 8 + [0]))
    assert not model.valid and (model.predict(np.zeros((1, 4))) == 0.5).all()


@pytest.mark.parametrize("parts,fan_in", [(1, 16), (7, 2), (16, 3)])
def test_hull_of_a_table_by_a_tree_of_merges(spark, parts, fan_in):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(3000, 4)), 6)
    df = spark.createDataFrame([(v.tolist(),) for v in points] + [(None,)], "x array<double>").repartition(parts)
    got = {tuple(r.x) for r in P.hull_vertices(df, 4, fan_in).collect()}
    assert got == {tuple(v) for v in hulls.vertices(points)}
    flat = df.selectExpr("array(x[0], x[1], x[0] + x[1]) AS x").filter("x[0] is not null")
    assert {tuple(r.x) for r in P.hull_vertices(flat, 3).collect()} == {tuple([a, b, a + b]) for a, b in hulls.vertices(points[:, :2])}
    assert P.hull_vertices(df.limit(0), 4).count() == 0
