"""Item sets against enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import blocks, itemsets, polytope as P


def enumerated(row, n, positive, negative, pending):
    good = held = 0
    for bits in itertools.product([0, 1], repeat=n):
        s = {i for i, b in enumerate(bits) if b}
        if positive <= s and not negative & s and not any(p <= s for p in pending):
            good += 1
            held += set(row) <= s
    return held / good


def test_shares_by_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = 8
        kinds = rng.integers(0, 5, n)
        positive, negative = {i for i in range(n) if kinds[i] == 0}, {i for i in range(n) if kinds[i] == 1}
        rest = [i for i in range(n) if kinds[i] > 1]
        pending = {frozenset(rng.choice(rest, min(len(rest), rng.integers(2, 4)), replace=False).tolist()) for _ in range(3)} if len(rest) > 1 else set()
        pending = [p for p in pending if len(p) > 1]
        held = rng.random((20, n)) < 0.4
        flags = [np.isin(np.arange(n), list(s)) for s in (positive, negative)]
        got = itemsets.share(held, *flags, pending)
        assert np.allclose(got, [enumerated(np.flatnonzero(r).tolist(), n, positive, negative, pending) for r in held])


def test_sixty_pending_pairs_and_large_groups_by_a_chain():
    chain = [frozenset((i, i + 1)) for i in range(60)]  # one group of 61 items
    apart = [frozenset((2 * i, 2 * i + 1)) for i in range(60)]
    drawn = itemsets.consistent(61, [sorted(p) for p in chain], samples=4000, seed=1)
    assert not (drawn[:, :-1] & drawn[:, 1:]).any()
    fibonacci = [1, 1]
    while len(fibonacci) < 70:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    # Of n items in a row fibonacci[n + 1] sets hold no neighbours; those with item 30 leave 29 items on either side.
    exact = fibonacci[30] ** 2 / fibonacci[62]
    assert abs(drawn[:, 30].mean() - exact) < 0.03
    held = np.zeros((2, 120), bool)
    held[0, 0] = held[1, [0, 2, 4]] = True
    none = np.zeros(120, bool)
    assert np.allclose(itemsets.share(held, none, none, apart), [1 / 3, 1 / 27])
    held = np.zeros((1, 61), bool)
    held[0, 7] = True
    assert 0 < itemsets.share(held, none[:61], none[:61], chain, samples=500)[0] < 0.6


def test_learner_of_item_sets():
    x = np.array([[1, 1, 0, 0, 0], [0, 0, 1, 1, 0], [0, 0, 0, 0, 1]], float)
    model = blocks.ItemSets.fit(x, np.array([1, 0, 0]))
    rows = np.array([[1, 1, 0, 0, 0], [1, 0, 1, 0, 0], [0, 0, 1, 1, 0], [0, 0, 0, 0, 1]], float)
    assert np.allclose(model.score_block(rows)[1], [1, 1 / 3, 0, 0])
    with pytest.raises(itemsets.ConflictError):
        blocks.ItemSets.fit(np.vstack([x, x[:1]]), np.array([1, 0, 0, 0]))
    mixed = blocks.fit_subspaces(np.hstack([x, [[0.1], [0.2], [0.9]]]), np.array([[1, 1], [0, 1], [0, 0]]), [[0, 1, 2, 3, 4], [5]], [blocks.ItemSets.fit, lambda a, b: blocks.fit_svm(a, b, blocks.Kernel("linear"), 10.0)])
    assert len(mixed.score_block(np.hstack([rows, np.ones((4, 1))]))[1]) == 4


def test_column_and_blocks_say_the_same(spark):
    rng = np.random.default_rng(2)
    sets = [sorted(set(rng.integers(0, 9, rng.integers(1, 4)).tolist())) for _ in range(60)]
    labels = spark.createDataFrame([([0, 1], 1.0), ([2, 3], 0.0), ([3, 4, 0], 0.0), ([5], 0.0), ([6, 7], 0.0)], "items array<int>, label double")
    model = P.MultiSet.fit(labels)
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "id long, items array<int>")
    got = {r.id: r.p for r in df.select("id", model.proba("items", 9).alias("p")).collect()}
    held = np.array([[i in s for i in range(9)] for s in sets])
    flags = [np.isin(np.arange(9), list(s)) for s in (model.positive, model.negative)]
    want = itemsets.share(held, *flags, model.pending)
    assert np.allclose([got[k] for k in range(60)], want)
    assert np.allclose(want, [enumerated(s, 9, model.positive, model.negative, model.pending) for s in sets])
    bad = P.MultiSet.fit(labels.union(spark.createDataFrame([([0], 0.0)], labels.schema)))
    with pytest.raises(itemsets.ConflictError):
        df.select(bad.proba("items", 9))
    many = P.MultiSet({0}, set(), [frozenset((2 * i, 2 * i + 1)) for i in range(1, 61)], True)
    assert np.allclose([r.p for r in df.filter("array_contains(items, 4)").limit(1).select(many.proba(F.array(F.lit(4), F.lit(0)), 130).alias("p")).collect()], 1 / 3)
