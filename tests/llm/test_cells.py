"""Cells of several slices, close calls and recall with odd rows, against all pairs."""

import numpy as np
import pytest

from gleaner.llm import embeddings


def brute(x, cosine):
    u = embeddings._unit(x)
    links = np.einsum("id,jd->ij", u, u) >= cosine
    np.fill_diagonal(links, False)
    component = np.arange(len(x))
    while True:
        new = np.minimum(component, np.where(links, component, len(x)).min(axis=1))
        if (new == component).all():
            return links.sum(axis=1), component
        component = new


@pytest.mark.parametrize("most", [16, 50, 8192])
def test_units_of_two_slices(spark, monkeypatch, most):
    monkeypatch.setattr(embeddings, "SLICE", most)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 24)), rng.normal(size=24) + rng.normal(size=(150, 24)) * 0.15, rng.normal(size=24) + rng.normal(size=(150, 24)) * 0.25])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    links, component = brute(x, 0.95)
    assert got == {k: (links[k], component[k]) for k in range(500)} and links.max() > 100


def test_close_calls_are_decided_on_the_given_components(spark):
    rng = np.random.default_rng(1)
    base = embeddings._unit(rng.normal(size=(40, 16)))
    side = rng.normal(size=(40, 16))
    side = embeddings._unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    x = np.concatenate([base, 0.95 * base + np.sqrt(1 - 0.95**2) * side])  # pairs at 0.95 but for rounding
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, _ = brute(x, 0.95)
    for parts in (1, 5):
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df.repartition(parts)).collect()}
        assert got == dict(enumerate(links.tolist()))


def test_recall_leaves_odd_rows_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert embeddings.recall(df, embeddings.near_duplicates(df)) == 1.0
    assert embeddings.recall(df.limit(0), embeddings.near_duplicates(df.limit(0))) == 1.0


@pytest.mark.parametrize("dim", [2, 24])
def test_no_pair_of_a_dense_group_is_left_out(spark, monkeypatch, dim):
    """Far more cells lie within the threshold's reach than a few nearest ones."""
    monkeypatch.setattr(embeddings, "CELL_ROWS", 8)
    monkeypatch.setattr(embeddings, "SLICE", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, dim)) if dim == 2 else np.ones(dim) + rng.normal(size=(600, dim)) * 0.23
    x = np.concatenate([x, rng.normal(size=(200, dim))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = embeddings.near_duplicates(df)
    links, component = brute(x, 0.95)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == {k: (links[k], component[k]) for k in range(len(x))}
    assert links.max() > 100
