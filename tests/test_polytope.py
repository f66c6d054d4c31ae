"""Hand-made geometry: hulls, cones, three-valued labels."""

import numpy as np
import pytest

from gleaner.operators import polytope as P

#: Points of hand-made cases, here and below.
DIAMOND = np.array([[0, 1], [-1, 0], [0, -1], [1, 0], [0, 0], [0.5, 0], [-0.5, 0], [0, 0.5], [0, -0.5]], float)


def corners(points):
    return {tuple(v) for v in P.facets(np.array(points, float))[0]}


def test_vertices_without_interior_points():
    assert corners(DIAMOND) == {(0, 1), (-1, 0), (0, -1), (1, 0)}


def test_growing_hull():
    base = [(-1, 0), (1, 0), (0, 1)]
    assert corners([*base, (0, 2)]) == {(-1, 0), (1, 0), (0, 2)}
    assert corners([*base, (0, 0.5)]) == set(base)


def test_facets_of_a_square():
    v, e, sets = P.facets(np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float))
    at = {tuple(v[k]): {tuple(np.round(e[i], 9) + 0.0) for i, s in enumerate(sets) if k in s} for k in range(4)}
    assert at[0, 0] == {(-1, 0, 0), (0, -1, 0)}
    assert at[1, 1] == {(1, 0, -1), (0, 1, -1)}


def test_cube_has_six_sides():
    cube = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)] + [[0.5, 0.5, 0.5]], float)
    v, e, _ = P.facets(cube)
    assert len(v) == 8 and len(e) == 6


@pytest.mark.parametrize("points", [[[0, 0], [1, 1]], [[0, 0], [1, 1], [2, 2]]])
def test_too_few_or_flat_points(points):
    with pytest.raises(ValueError):
        P.facets(np.array(points, float))


def test_bad_tolerance():
    with pytest.raises(ValueError):
        P.Polytope(0)


def test_labels_are_kept():
    x, y = np.array([[-1, 0], [1, 0], [0, -1], [0, 1]], float), np.array([1, 1, 1, 0])
    assert P.Polytope().fit(x, y).predict(x).tolist() == y.tolist()


def test_cone_behind_a_negative_point():
    model = P.Polytope().fit(np.array([[-1, 0], [1, 0], [0, 1]], float), np.array([1, 1, 0]))
    assert model.predict(np.array([[0, 2], [1, 2], [-1, 2], [0, 1]])).tolist() == [0, 0, 0, 0]
    assert model.predict(np.array([[0, 0], [1, 0], [-1, 0], [10, 10], [-10, 10]])).tolist() == [0.5] * 5


def test_growing_cone():
    behind = lambda e, p: (e[:, :-1] @ np.array(p) + e[:, -1]).min() >= -1e-12
    v, hull = np.array([0.0, 1.0]), np.array([[0, 0], [1, 0]], float)
    assert not behind(P.cone(v, hull), (0.5, 2))
    assert behind(P.cone(v, np.vstack([hull, [[-1, 0]]])), (0.5, 2))
    with pytest.raises(P.ConvexError):
        P.cone(np.array([0.1, 0.1]), np.array([[-1, -1], [1, -1], [0, 2]], float))


def test_conflict_makes_invalid():
    x, y = np.array([[-1, 0], [1, 0], [0, 1], [0, 0.5]], float), np.array([1, 1, 1, 0])
    model = P.Polytope().fit(x, y)
    assert not model.valid and model.predict(x).tolist() == [0.5] * 4
    with pytest.raises(RuntimeError):
        model.update(x, y)
    assert P.Polytope().fit(np.array([[-1, 0], [1, 0], [0, 1], [0, 2]], float), y).valid


def test_positive_after_negative_conflict():
    assert not P.Polytope().fit(np.array([[-1, 0], [1, 0], [0, 1], [0, 2]], float), np.array([1, 1, 0, 1])).valid


def test_not_built_until_enough_points():
    model = P.Polytope().fit(np.array([[0, 0], [1, 0]], float), np.array([1, 1]))
    assert not model.is_built and model.predict(np.array([[0.5, 0]])).tolist() == [0.5]
    assert model.update(np.array([[0, 1]]), np.array([1])).is_built


def test_one_dimension():
    model = P.Polytope().fit(np.array([[-1], [1], [-2], [3], [5], [-4], [7]], float), np.array([1, 1, 1, 1, 1, 1, 0]))
    assert model.predict(np.array([[-4], [5], [5.5], [7], [9], [-5]], float)).tolist() == [1, 1, 0.5, 0, 0, 0.5]
    assert not P.Polytope().fit(np.array([[-1], [1], [0]], float), np.array([1, 1, 0])).valid


def test_flipped_and_persist():
    x, y = np.array([[-1, 0], [1, 0], [0, -1], [0, 1]], float), np.array([0, 0, 0, 1])
    assert P.FlippedPolytope().fit(x, y).predict(x).tolist() == y.tolist()
    persist = P.PersistPolytope().fit(np.vstack([x, [[0, -0.5]]]), np.array([1, 1, 1, 0, 0]))
    assert not persist.models[0].valid and persist.valid
    with pytest.raises(ValueError):
        P.polytope("sideways")


def test_columns_equal_predictions(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (200, 2))
    y = (np.abs(x).max(axis=1) < 1).astype(float)
    model = P.Polytope(1e-9).fit(x[:40], y[:40])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = [r.p for r in df.select("id", model.column("x").alias("p")).orderBy("id").collect()]
    assert got == model.predict(x).tolist()
    assert all(p in (0.5, t) for p, t in zip(got, y))


def test_hull_of_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(7)
    got = {tuple(np.round(r.x, 12)) for r in P.hull_vertices(df, 2).collect()}
    assert got == {tuple(np.round(v, 12)) for v in P.facets(x)[0]}


@pytest.mark.parametrize("seed", range(6))
def test_hulls_against_half_spaces(seed):
    """Every facet has all points on its inner side and its corners on it; a point is a vertex if no mixture of others."""
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(400, 3)) if seed % 2 else rng.integers(0, 5, (300, 3)).astype(float)
    corners, equations, sets = P.facets(points)
    inside = points @ equations[:, :3].T + equations[:, 3]
    assert (inside <= 1e-8).all() and all(abs(corners[k] @ e[:3] + e[3]) < 1e-8 for e, s in zip(equations, sets) for k in s)
    assert all(len(s) >= 3 for s in sets) and {tuple(c) for c in corners} <= {tuple(p) for p in points}
    for direction in rng.normal(size=(200, 3)):  # the farthest point in any direction is a corner
        assert abs((points @ direction).max() - (corners @ direction).max()) < 1e-9


def test_a_large_hull_in_space(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 3))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(4)
    got = np.array([r.x for r in P.hull_vertices(df, 3).collect()])
    for direction in rng.normal(size=(300, 3)):
        assert abs((x @ direction).max() - (got @ direction).max()) < 1e-9
    assert len(got) < 400


def test_saved_polytopes_and_blocks(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2))
    y = ((x**2).sum(axis=1) < 1).astype(int)
    model = P.Polytope(1e-9).fit(x, y)
    model.save(spark, f"{tmp_path}/hull")
    again = P.load_polytope(spark, f"{tmp_path}/hull")
    probe = rng.normal(size=(500, 2)) * 2
    assert (again.predict(probe) == model.predict(probe)).all() and again.tol == model.tol
    more = np.array([[0.0, 1.5], [0.1, 0.2]])
    assert (again.update(more, np.array([0, 1])).predict(probe) == model.update(more, np.array([0, 1])).predict(probe)).all()
    from gleaner.operators import blocks

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(probe)], "id int, x array<double>")
    assert [r.pred for r in blocks.score(df, model).orderBy("id").collect()] == model.predict(probe).tolist()
