"""State moves, samples, inference and logs on small tables."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import inference, metrics, sampling, state
from gleaner.sources import pool as source


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, [float(i), i / 10], float(i % 5 == 0), [float(i % 5 == 0), 1.0]) for i in range(100)], "id long, x array<double>, label double, partial array<double>")


def test_moves(spark, rows):
    s = spark.createDataFrame([(1, "labeled"), (2, "inferred")], "id long, state string")
    lab = rows.filter("id = 1").select("id", "label", "partial").withColumn("iter", F.lit(0))
    batch = rows.filter("id in (3, 4)").select("id", "label", "partial")
    s2, l2 = state.move_to_labeled(s, lab, batch, 1)
    assert l2.count() == 3 and {r.id for r in state.view(rows, s2, "labeled").collect()} == {1, 3, 4}
    with pytest.raises(ValueError):
        state.move_to_labeled(s2, l2, batch, 2)
    with pytest.raises(ValueError):
        state.move_to_inferred(s2, spark.createDataFrame([(2,)], "id long"))
    assert {r.id for r in state.training_set(rows, l2, last=True).collect()} == {3, 4}
    back = state.move_to_inferred(s2, spark.createDataFrame([(3,)], "id long"))
    assert state.view(rows, back, "inferred").count() == 2
    assert state.remove_inferred(back).count() == 2
    assert state.view(rows, back, "unlabeled").count() == 98
    with pytest.raises(ValueError):
        state.view(rows, s, "other")


def test_lookup_keeps_order_and_refuses_unknown(spark, rows):
    wanted = spark.createDataFrame([(7, 0), (3, 1), (50, 2)], "id long, pos int")
    assert [r.id for r in state.lookup(rows, wanted).collect()] == [7, 3, 50]
    with pytest.raises(ValueError):
        state.lookup(rows, spark.createDataFrame([(700, 0)], "id long, pos int"))


def test_samples(rows):
    a = {r.id for r in sampling.sample(rows, 10, 1).collect()}
    assert len(a) == 10 and a == {r.id for r in sampling.sample(rows.repartition(9), 10, 1).collect()}
    assert a == {r.id for r in sampling.large_sample(rows, 10, 100, 1).collect()}
    assert sampling.sample(rows, None, 1).count() == 100
    got = sampling.stratified(rows, 3, 4, 0).groupBy("label").count().collect()
    assert {r[0]: r[1] for r in got} == {1.0: 3, 0.0: 4}
    with pytest.raises(ValueError):
        sampling.stratified(rows, 30, 4, 0)


def test_noise_keeps_labels_and_partials_consistent(rows):
    out = sampling.flip_labels(rows.withColumn("pos", F.col("id")), 0.5, 3, skip_initial=10).collect()
    assert all(r.label == float(r.id % 5 == 0) for r in out if r.pos < 10)
    assert any(r.label != float(r.id % 5 == 0) for r in out)
    assert all(min(r.partial) == r.label for r in out)


def test_conjunctive_inference(spark):
    table = [("m", "b", "4", 1.0), ("l", "r", "4", 1.0), ("s", "y", "2", 0.0), ("s", "r", "4", 0.0), ("m", "y", "2", 0.0), ("m", "y", "4", 1.0)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(table)], "id long, a string, b string, c string, label double")
    known = {(r.k, r.v): r.known for r in inference.infer_values(rows, ["a", "b", "c"]).collect()}
    assert known == {(0, "m"): 1, (0, "l"): 1, (1, "b"): 1, (1, "r"): 1, (1, "y"): 1, (2, "4"): 1, (0, "s"): 0, (2, "2"): 0}
    pred = {r.id: r.pred for r in inference.predict(rows, inference.infer_values(rows, ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    assert pred == {i: t[3] for i, t in enumerate(table)}
    with pytest.raises(ValueError):
        inference.infer_values(rows.union(spark.createDataFrame([(9, "m", "b", "4", 0.0)], rows.schema)), ["a", "b", "c"])


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "label double, pred double, proba double")
    r = metrics.classification_metrics(empty).first()
    assert r.true_positive == 0 and r.fscore == 0
    assert metrics.three_set_metric(empty).first().tsm is None
    with pytest.raises(ValueError):
        metrics.classification_metrics(empty, ("other",))


def test_pool_checks(spark):
    bad = spark.createDataFrame([(1, [1.0, None]), (1, [1.0, 2.0])], "id long, x array<double>")
    with pytest.raises(ValueError):
        source.check_pool(bad)
    with pytest.raises(ValueError):
        source.load_pool(bad, ["id"])
    with pytest.raises(ValueError):
        source.load_labels(spark.createDataFrame([(1, 0.5)], "id long, y double"), "y")


def test_stream_scores_like_a_table(spark, rows, tmp_path):
    from gleaner.functions import expressions as X
    from gleaner.streaming import scoring

    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    column = {"proba": X.factorized("x", [1.0], [[-0.1, 0.2]])["proba"]}
    scoring.start(scoring.score_stream(stream, column), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {r.id: r.proba for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.proba for r in scoring.score_stream(rows, column).collect()}


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_numbered_pool(spark, partitions):
    n = 500_000
    saved = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = spark.range(n).selectExpr("cast((id * 7919) % 1000 as int) a", "(id * 104729) % 500000 b", "id c").repartition(5)
        pool = source.load_pool(rows, ["c"], order=["a", "b"], keep=("a", "b"))
        r = pool.selectExpr("count(*) n", "count(distinct id) d", "min(id) lo", "max(id) hi").first()
        assert (r.n, r.d, r.lo, r.hi) == (n, n, 0, n - 1)
        after = pool.selectExpr("id - 1 as id", "a as a2", "b as b2")
        assert pool.join(after, "id").filter("a > a2 or (a = a2 and b > b2)").count() == 0
        assert source.load_pool(rows.limit(0), ["c"], order=["a"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", saved)
