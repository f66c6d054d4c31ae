"""Queries of three-valued models, expressions, block scorers, fits and composite jobs."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import blocks, factorized, inference, interaction, margin, metrics, polytope as P, posterior, sampling, state, twostep
from ..plans import explore
from ..sources.scratch import shared_folder
from .base import BIAS, SEED, SQL, VECTORS_SQL, WEIGHTS, first_rows, labels, pool, state as states, table, vectors

QUERIES, SQLS = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQLS[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def labelled_pool(spark, d, n: int = 60) -> DataFrame:
    """(id, x, y, cat, partial, pos) of the first n events."""
    return first_rows(pool(spark, d), n)


def local(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return blocks.collected(rows.select("id", "x", "y"))


# Categories, bounds, hulls, item sets ------------------------------------------------------------------

PARTS_SQL = """WITH part_pool AS (SELECT p_partkey AS id, p_size::DOUBLE AS x0, (p_retailprice - 900) / 10 AS x1, p_type AS cat, p_brand AS brand, (p_type = 'ECONOMY')::INT::DOUBLE AS y, (p_size BETWEEN 10 AND 30)::INT::DOUBLE AS ysize,
    (p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 920 AND 970)::INT::DOUBLE AS ybox, md5('7:' || p_partkey) AS h FROM part),
lab AS (SELECT * FROM part_pool ORDER BY h, id LIMIT 60)
"""


def parts(spark, d) -> DataFrame:
    t = table(spark, d, "part")
    box = F.col("p_size").between(10, 30)
    return t.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_retailprice") - 900) / 10).alias("x"), F.col("p_type").alias("cat"), F.col("p_brand").alias("brand"), (F.col("p_type") == "ECONOMY").cast("double").alias("y"), box.cast("double").alias("ysize"), (box & F.col("p_retailprice").between(920, 970)).cast("double").alias("ybox"))


@query(PARTS_SQL + ", m AS (SELECT cat, min(y) AS known FROM lab GROUP BY 1) SELECT id, coalesce(known, 0.5)::DOUBLE AS pred FROM part_pool LEFT JOIN m USING (cat)")
def categorical_inference(spark, d):
    p = parts(spark, d)
    model = P.category_model(first_rows(p, 60).select("cat", F.col("y").alias("label")), "cat")
    return P.category_label(p, model, "cat").select("id", "pred")


@query(PARTS_SQL + "SELECT brand, count(DISTINCT ysize) AS n_labels FROM lab GROUP BY 1 HAVING count(DISTINCT ysize) > 1")
def category_conflicts(spark, d):
    return P.conflicts(first_rows(parts(spark, d), 60).select("brand", F.col("ysize").alias("label")), "brand")


@query(PARTS_SQL + """, b AS (SELECT min(x0) FILTER (WHERE ysize = 1) AS l, max(x0) FILTER (WHERE ysize = 1) AS r FROM lab), c AS (SELECT min(x0) FILTER (WHERE ysize = 0 AND x0 > r) AS above, max(x0) FILTER (WHERE ysize = 0 AND x0 < l) AS below FROM lab, b)
SELECT id, CASE WHEN x0 >= above OR x0 <= below THEN 0 WHEN x0 BETWEEN l AND r THEN 1 ELSE 0.5 END::DOUBLE AS pred FROM part_pool, b, c""")
def one_dim_hull(spark, d):
    p = parts(spark, d).withColumn("x", F.slice("x", 1, 1))
    x, y = local(first_rows(p.withColumn("y", F.col("ysize")), 60))
    return p.select("id", P.polytope("positive").fit(x, y).column("x").alias("pred"))


@query(PARTS_SQL + "SELECT min(x0) AS low, max(x0) AS high FROM part_pool WHERE ysize = 1")
def convex_hull_1d(spark, d):
    v = P.hull_vertices(parts(spark, d).filter("ysize = 1"), 1)
    return v.agg(F.min(F.col("x")[0]).alias("low"), F.max(F.col("x")[0]).alias("high"))


@query(PARTS_SQL + """, p AS (SELECT x0, unnest([min(x1), max(x1)]) AS x1 FROM part_pool WHERE ybox = 1 GROUP BY 1),
e AS (SELECT a.x0 AS ax, a.x1 AS ay, b.x0 AS bx, b.x1 AS yb FROM p a, p b WHERE (a.x0, a.x1) <> (b.x0, b.x1)),
good AS (SELECT ax, ay, bx, yb FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE (bx - ax) * (p.x1 - ay) - (yb - ay) * (p.x0 - ax) < -1e-9
    OR (abs((bx - ax) * (p.x1 - ay) - (yb - ay) * (p.x0 - ax)) <= 1e-9 AND ((p.x0 - ax) * (bx - ax) + (p.x1 - ay) * (yb - ay) < -1e-12 OR (p.x0 - ax) * (bx - ax) + (p.x1 - ay) * (yb - ay) > (bx - ax) * (bx - ax) + (yb - ay) * (yb - ay) + 1e-9))))
SELECT DISTINCT round(ax, 6) AS x0, round(ay, 6) AS x1 FROM good""")
def convex_hull_2d(spark, d):
    v = P.hull_vertices(parts(spark, d).filter("ybox = 1"), 2)
    return v.select(r6(F.col("x")[0], "x0"), r6(F.col("x")[1], "x1"))


#: A triangle and two negative points, as literals on both sides.
TRIANGLE = np.array([[10.0, 1.0], [30.0, 1.0], [20.0, 6.0]])
NEGATIVE = np.array([[20.0, 8.0], [40.0, 1.0]])
POLYTOPE_SQL = """CASE WHEN (x1 - 8 >= 0.7 * (x0 - 20) - 1e-9 AND x1 - 8 >= -0.7 * (x0 - 20) - 1e-9) OR (x0 >= 40 - 1e-9 AND x1 >= 1 - (x0 - 40) * 5 / 20 - 1e-9 AND x1 <= 1 + 1e-9) THEN 0
    WHEN x1 >= 1 - 1e-9 AND (x1 - 1) <= (x0 - 10) / 2 + 1e-9 AND (x1 - 1) <= (30 - x0) / 2 + 1e-9 THEN 1 ELSE 0.5 END::DOUBLE"""


def _triangle() -> P.Polytope:
    return P.polytope("positive", 1e-9).fit(np.vstack([TRIANGLE, NEGATIVE]), np.array([1, 1, 1, 0, 0]))


@query(PARTS_SQL + f"SELECT id, {POLYTOPE_SQL} AS pred FROM part_pool")
def polytope_label(spark, d):
    return parts(spark, d).select("id", _triangle().column("x").alias("pred"))


@query(PARTS_SQL + f"SELECT id, 1 - {POLYTOPE_SQL} AS negative, {POLYTOPE_SQL} AS persist FROM part_pool")
def polytope_modes(spark, d):
    x, y = np.vstack([TRIANGLE, NEGATIVE]), np.array([1, 1, 1, 0, 0])
    return parts(spark, d).select("id", P.polytope("negative", 1e-9).fit(x, 1 - y).column("x").alias("negative"), P.polytope("persist", 1e-9).fit(x, y).column("x").alias("persist"))


#: Item sets of users over five kinds; kind 1 makes a user negative.
ITEMS_SQL = """WITH codes(event_type, k) AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 FROM (SELECT DISTINCT event_type FROM events)),
n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
u AS (SELECT user_id AS id, list_sort(list(DISTINCT k::INT)) AS items FROM n JOIN codes USING (event_type) WHERE r <= 1 + user_id % 3 GROUP BY 1),
lab AS (SELECT *, (NOT list_contains(items, 1))::INT AS y FROM (SELECT * FROM u ORDER BY md5('7:' || id), id LIMIT 20)),
pos AS (SELECT DISTINCT unnest(items) AS i FROM lab WHERE y = 1),
neg AS (SELECT DISTINCT min(i) AS i FROM (SELECT id, unnest(items) AS i FROM lab WHERE y = 0) WHERE i NOT IN (SELECT i FROM pos) GROUP BY id HAVING count(*) = 1)
"""


def _users(spark, d) -> DataFrame:
    """(id, items, y): the kinds of a user's first events; y: none is kind 1."""
    from pyspark.sql import Window

    t = table(spark, d, "events")
    kinds = sorted(r[0] for r in t.select("event_type").distinct().collect())  # five
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    code = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).cast("int") - 1
    u = t.withColumn("r", number).filter(F.col("r") <= 1 + F.col("user_id") % 3).groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set(code)).alias("items"))
    return u.withColumn("y", (~F.array_contains("items", 1)).cast("double"))


@query(ITEMS_SQL + "SELECT id, CASE WHEN list_has_any(items, (SELECT coalesce(list(i), []) FROM neg)) THEN 0 WHEN list_has_all((SELECT coalesce(list(i), []) FROM pos), items) THEN 1 ELSE 0.5 END::DOUBLE AS pred FROM u")
def multiset_label(spark, d):
    u = _users(spark, d)
    model = P.MultiSet.fit(first_rows(u, 20).withColumn("label", F.col("y")))
    return u.select("id", model.column("items").alias("pred"))


@query(ITEMS_SQL + "SELECT 'positive' AS kind, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') AS items FROM pos UNION ALL SELECT 'negative', coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') FROM neg")
def multiset_state(spark, d):
    m = P.MultiSet.fit(first_rows(_users(spark, d), 20).withColumn("label", F.col("y")))
    return spark.createDataFrame([("positive", ",".join(map(str, sorted(m.positive)))), ("negative", ",".join(map(str, sorted(m.negative))))], "kind string, items string")


@query(ITEMS_SQL + """, rest AS (SELECT DISTINCT s FROM (SELECT list_sort(list(i)) AS s FROM (SELECT id, unnest(items) AS i FROM lab WHERE y = 0) WHERE i NOT IN (SELECT i FROM pos) GROUP BY id)), pending AS (SELECT s FROM rest WHERE len(s) > 1 AND NOT list_has_any(s, (SELECT coalesce(list(i), []) FROM neg))),
every AS (SELECT m, list_filter([0, 1, 2, 3, 4], lambda k: (m >> k) & 1 = 1) AS s FROM range(32) r(m)),
good AS (SELECT s FROM every WHERE list_has_all(s, (SELECT coalesce(list(i), []) FROM pos)) AND NOT list_has_any(s, (SELECT coalesce(list(i), []) FROM neg)) AND NOT EXISTS (SELECT 1 FROM pending p WHERE list_has_all(every.s, p.s)))
SELECT id, round(count(*) FILTER (WHERE list_has_all(s, items)) / count(*), 6)::DOUBLE AS proba FROM u, good GROUP BY id""")
def multiset_probability(spark, d):
    """The SQL counts all 32 sets of the five items."""
    u = _users(spark, d)
    model = P.MultiSet.fit(first_rows(u, 20).withColumn("label", F.col("y")))
    return u.select("id", r6(model.proba("items", 5, seed=SEED), "proba"))


THREE = "CASE WHEN x0 < 0.4 THEN 1 WHEN x0 > 0.8 THEN 0 ELSE 0.5 END"


def _three():
    x = F.col("x")[0]
    return F.when(x < 0.4, 1.0).when(x > 0.8, 0.0).otherwise(0.5)


@query(SQL + f"SELECT id, least({THREE}, CASE WHEN x1 < 0.5 THEN 1 ELSE 0.5 END)::DOUBLE AS pred, least(0.5, {THREE})::DOUBLE AS one_invalid FROM pool")
def factorized_polytope(spark, d):
    other = F.when(F.col("x")[1] < 0.5, 1.0).otherwise(0.5)
    return pool(spark, d).select("id", P.factorized_label([_three(), other], [True, True]).alias("pred"), P.factorized_label([_three(), other], [True, False]).alias("one_invalid"))


@query(SQL + f"SELECT id, CASE WHEN {THREE} <> 0.5 THEN {THREE} ELSE (proba > 0.5)::INT END::DOUBLE AS pred, round(CASE WHEN {THREE} <> 0.5 THEN {THREE} ELSE proba END, 6)::DOUBLE AS proba FROM sc")
def dual_space_predict(spark, d):
    m = X.factorized("x", BIAS, WEIGHTS)
    return pool(spark, d).select("id", P.dual_space(_three(), m["pred"]).alias("pred"), r6(P.dual_space(_three(), m["proba"]), "proba"))


@query(SQL + f"SELECT id, {THREE}::DOUBLE AS pred FROM pool WHERE id NOT IN (SELECT id FROM st) AND {THREE} <> 0.5")
def dual_space_inference(spark, d):
    unknown = state.view(pool(spark, d), states(spark, d), "unknown")
    return P.infer(unknown, _three())


@query(SQL + f"SELECT id, y AS label, 'user' AS origin FROM lab UNION ALL SELECT id, y, 'cache' FROM inf WHERE {THREE} <> 0.5")
def merge_label_cache(spark, d):
    p = pool(spark, d).withColumn("label", F.col("y"))
    s = states(spark, d)
    user, cached = (p.join(s.filter(F.col("state") == v), "id", "left_semi") for v in ("labeled", "inferred"))
    return P.merge_cache(user, cached, _three())


# Conjunctive inference ---------------------------------------------------------------------------------


def _inferable(spark, d) -> DataFrame:
    """Events' kind, part of the day, part of the user: conjunction of kind <> error and user part <> 2."""
    t = table(spark, d, "events")
    return t.select(F.col("event_id").alias("id"), F.col("event_type").alias("a"), F.floor(F.hour("ts") / 6).cast("string").alias("b"), (F.col("user_id") % 4).cast("string").alias("c"), ((F.col("event_type") != "error") & (F.col("user_id") % 4 != 2)).cast("double").alias("label"))


@query("""WITH e AS (SELECT event_id AS id, event_type AS a, floor(hour(ts) / 6)::INT::VARCHAR AS b, (user_id % 4)::VARCHAR AS c, (event_type <> 'error' AND user_id % 4 <> 2)::INT AS y, md5('7:' || event_id) AS h FROM events),
l AS (SELECT * FROM e ORDER BY h, id LIMIT 200), pa AS (SELECT DISTINCT a FROM l WHERE y = 1), pb AS (SELECT DISTINCT b FROM l WHERE y = 1), pc AS (SELECT DISTINCT c FROM l WHERE y = 1),
na AS (SELECT DISTINCT a FROM l WHERE y = 0 AND a NOT IN (FROM pa) AND b IN (FROM pb) AND c IN (FROM pc)), nc AS (SELECT DISTINCT c FROM l WHERE y = 0 AND c NOT IN (FROM pc) AND b IN (FROM pb) AND a IN (FROM pa))
SELECT id, least(CASE WHEN a IN (FROM pa) THEN 1 WHEN a IN (FROM na) THEN 0 ELSE 0.5 END, CASE WHEN b IN (FROM pb) THEN 1 ELSE 0.5 END, CASE WHEN c IN (FROM pc) THEN 1 WHEN c IN (FROM nc) THEN 0 ELSE 0.5 END)::DOUBLE AS pred FROM e""")
def conjunctive_inference(spark, d):
    rows = _inferable(spark, d)
    known = inference.infer_values(first_rows(rows, 200), ["a", "b", "c"])
    return inference.predict(rows, known, ["a", "b", "c"]).select("id", "pred")


# Two stages --------------------------------------------------------------------------------------------


@query(SQL + "SELECT id, CASE WHEN x0 < 0.5 THEN (x1 < 0.5)::INT ELSE 0 END::DOUBLE AS final FROM pool")
def two_stage_prediction(spark, d):
    scored = pool(spark, d).withColumn("pred", (F.col("x")[0] < 0.5).cast("double"))
    return twostep.two_stage(scored, (F.col("x")[1] < 0.5).cast("double")).select("id", "final")


@query(SQL + "SELECT id, 'training' AS kind FROM lab WHERE p1 = 1 OR pos <= 1 OR pos >= 40 UNION ALL SELECT id, 'inferred' FROM pool WHERE id NOT IN (SELECT id FROM st) AND x0 >= 0.5")
def two_stage_training(spark, d):
    chosen = twostep.training_rows(labels(spark, d), 40).select("id", F.lit("training").alias("kind"))
    unknown = state.view(pool(spark, d), states(spark, d), "unknown").withColumn("pred", (F.col("x")[0] < 0.5).cast("double"))
    return chosen.unionByName(twostep.structured_negatives(unknown).withColumnRenamed("state", "kind"))


# Expressions -------------------------------------------------------------------------------------------


@query(SQL + """SELECT id, least(p0, p1) AS label_and, greatest(p0, p1) AS label_or, (q0 * q1 > 0.5)::INT::DOUBLE AS label_prod, round(least(q0, q1), 6) AS p_min, round(greatest(q0, q1), 6) AS p_max, round(q0 * q1, 6) AS p_prod, round(q0 + q1, 6) AS r_sum, round(q0 * q0 + q1 * q1, 6) AS r_square FROM sc""")
def combine_subspaces(spark, d):
    q = X.factorized("x", BIAS, WEIGHTS)["partial_proba"]
    p = pool(spark, d).withColumn("q", q)
    return p.select("id", X.label_of("q", "AND", "partial").alias("label_and"), X.label_of("q", "OR", "partial").alias("label_or"), X.label_of("q", None).alias("label_prod"), *(r6(X.connect("q", n, X.PROBA_CONNECTORS), f"p_{n.lower()}") for n in ("MIN", "MAX", "PROD")), *(r6(X.connect("q", n, X.RANK_CONNECTORS), f"r_{n.lower()}") for n in ("SUM", "SQUARE")))


@query(SQL + "SELECT id, round((1 - 2 * q0 * (1 - q0)) * (1 - 2 * q1 * (1 - q1)), 6) AS greedy, round((q0 - 0.5) ** 2 + (q1 - 0.5) ** 2, 6) AS square, round(abs(q0 * q1 - 0.5), 6) AS product FROM sc")
def query_losses(spark, d):
    p = pool(spark, d).withColumn("q", X.factorized("x", BIAS, WEIGHTS)["partial_proba"])
    return p.select("id", *(r6(X.connect("q", n, X.LOSSES), n.lower()) for n in ("GREEDY", "SQUARE", "PRODUCT")))


@query(SQL + "SELECT id, round((q0 + q1) / 2, 6) AS mean_proba FROM sc")
def custom_connector(spark, d):
    p = pool(spark, d).withColumn("q", X.factorized("x", BIAS, WEIGHTS)["partial_proba"])
    return p.select("id", r6(X.connect("q", lambda c: X.summed(c) / F.size(c), X.PROBA_CONNECTORS), "mean_proba"))


@query(SQL + "SELECT cat, count(*) AS n FROM pool WHERE x0 < 0.5 GROUP BY 1")
def custom_steps(spark, d):
    return explore.run_steps(pool(spark, d), lambda r: r.filter(F.col("x")[0] < 0.5), lambda r: r.groupBy("cat").agg(F.count(F.lit(1)).alias("n")))


@query(SQL + "SELECT id, round(abs(proba - 0.5), 6) AS rank FROM sc")
def uncertainty_rank(spark, d):
    return pool(spark, d).select("id", r6(X.uncertainty(X.factorized("x", BIAS, WEIGHTS)["proba"]), "rank"))


@query(SQL + """, m AS (SELECT id, 10 * (x0 - 0.5) AS t FROM pool) SELECT id, round(1 / (1 + exp(-t)), 6) AS sigmoid, round(least(t, 0) - ln(1 + exp(-abs(t))), 6) AS log_sigmoid, round(greatest(t, 0) + ln(1 + exp(-abs(t))), 6) AS softplus, CASE WHEN t < 0 THEN round(ln(1 - exp(t)), 6) END AS log1m_exp FROM m""")
def stable_logs(spark, d):
    p = pool(spark, d).withColumn("t", 10 * (F.col("x")[0] - 0.5))
    return p.select("id", *(r6(f(F.col("t")), f.__name__) for f in (X.sigmoid, X.log_sigmoid, X.softplus, X.log1m_exp)))


@query(SQL + "SELECT id, round(proba, 6) AS proba, (proba > 0.5)::INT::DOUBLE AS pred, round(abs(proba - 0.5), 6) AS rank, round(q0, 6) AS q0, (q1 > 0.5)::INT::DOUBLE AS l1 FROM sc")
def factorized_linear(spark, d):
    m = X.factorized("x", BIAS, WEIGHTS)
    return pool(spark, d).select("id", r6(m["proba"], "proba"), m["pred"].alias("pred"), r6(m["rank"], "rank"), r6(m["partial_proba"][0], "q0"), m["partial"][1].alias("l1"))


@query(SQL + "SELECT id, round(q0, 6) AS two_blocks, round(1 / (1 + exp(-(7 - 8 * x0 - 6 * x1))), 6) AS merged FROM sc")
def partition_classifier(spark, d):
    bias, w = factorized.merge_blocks(np.array(BIAS), np.array(WEIGHTS), 0, 1)
    return pool(spark, d).select("id", r6(X.factorized("x", BIAS[:1], WEIGHTS[:1])["proba"], "two_blocks"), r6(X.factorized("x", bias, w)["proba"], "merged"))


HYPOTHESES = ([0.5, -0.3, 0.2, 0.8], [[-1.0, 0.2], [0.7, -0.5], [-0.4, -0.1], [-0.9, -0.6]])


@query(SQL + ", p AS (SELECT id, ((0.5 - x0 + 0.2 * x1 > 0)::INT + (-0.3 + 0.7 * x0 - 0.5 * x1 > 0)::INT + (0.2 - 0.4 * x0 - 0.1 * x1 > 0)::INT + (0.8 - 0.9 * x0 - 0.6 * x1 > 0)::INT) / 4 AS p FROM pool) SELECT id, round(p, 6) AS proba, (p > 0.5)::INT::DOUBLE AS pred, round(abs(p - 0.5), 6) AS rank FROM p")
def version_space_vote(spark, d):
    p = pool(spark, d).withColumn("p", X.votes("x", *HYPOTHESES))
    return p.select("id", r6(F.col("p"), "proba"), (F.col("p") > 0.5).cast("double").alias("pred"), r6(X.uncertainty("p"), "rank"))


@query(SQL + "SELECT 0 AS k, round(min(q0), 6) AS min_proba, round(8.0, 6)::DOUBLE AS norm FROM sc HAVING min(q0) < 0.5 UNION ALL SELECT 1, round(min(q1), 6), 6::DOUBLE FROM sc HAVING min(q1) < 0.5")
def prune_subspaces(spark, d):
    return factorized.prune(pool(spark, d), BIAS, WEIGHTS, 0.5, 1e-6).select("k", r6(F.col("min_proba"), "min_proba"), "norm")


@query(SQL + "SELECT round(avg(CASE WHEN y > 0 THEN -ln(proba) ELSE -ln(1 - proba) END) + 0.25, 6) AS loss FROM sc")
def factorized_loss(spark, d):
    return factorized.loss(pool(spark, d), BIAS, WEIGHTS, 0.25).select(r6(F.col("loss"), "loss"))


@query(SQL + """, g AS (SELECT x0, x1, CASE WHEN y > 0 THEN -1 ELSE proba / (1 - proba) END AS r, 1 - q0 AS s0, 1 - q1 AS s1, y, proba FROM sc)
SELECT round(avg(r * s0), 6) AS b0, round(avg(r * s0 * x0), 6) AS w00, round(avg(r * s0 * x1), 6) AS w01, round(avg(r * s1), 6) AS b1, round(avg(r * s1 * x0), 6) AS w10, round(avg(r * s1 * x1), 6) AS w11 FROM g""")
def factorized_gradient(spark, d):
    g = factorized.gradient(pool(spark, d), np.array(BIAS), np.array(WEIGHTS))
    return g.select(*(r6(F.col("gradient")[i], n) for i, n in enumerate(("b0", "w00", "w01", "b1", "w10", "w11"))))


@query("""WITH w AS (SELECT p_brand, sum(p_size) FILTER (WHERE p_type = 'ECONOMY') AS a, sum(p_retailprice) / 20 AS b, -count(*) AS c FROM part GROUP BY 1)
SELECT p_brand, coalesce(a, 0) / (coalesce(a, 0) + b + abs(c)) > 1 / 3 AS r0, b / (coalesce(a, 0) + b + abs(c)) > 1 / 3 AS r1, abs(c) / (coalesce(a, 0) + b + abs(c)) > 1 / 3 AS r2 FROM w""")
def attribute_relevance(spark, d):
    w = table(spark, d, "part").groupBy("p_brand").agg(F.coalesce(F.sum(F.when(F.col("p_type") == "ECONOMY", F.col("p_size"))), F.lit(0)).cast("double").alias("a"), (F.sum("p_retailprice") / 20).alias("b"), (-F.count(F.lit(1))).cast("double").alias("c"))
    r = X.relevance(F.col("w"))
    return w.select("p_brand", F.array("a", "b", "c").alias("w")).select("p_brand", *(r[i].alias(f"r{i}") for i in range(3)))


@query("""WITH w AS (SELECT p_brand, avg(p_size) - 25 AS a, avg(p_retailprice) / 100 - 10 AS b, count(*) / 10 AS c FROM part GROUP BY 1)
SELECT p_brand, array_to_string(list_filter([CASE WHEN abs(a) > 1 THEN '0-1' END, CASE WHEN abs(b) > 1 THEN '0-2' END, CASE WHEN abs(c) > 1 THEN '1-2' END], lambda v: v IS NOT NULL), ' ') AS pairs FROM w""")
def interaction_decode(spark, d):
    """Pairs of three attributes whose weight is over a tolerance, for a model a brand."""
    w = table(spark, d, "part").groupBy("p_brand").agg((F.avg("p_size") - 25).alias("a"), (F.avg("p_retailprice") / 100 - 10).alias("b"), (F.count(F.lit(1)) / 10).alias("c"))
    weights = F.array(F.lit(9.0), F.lit(9.0), F.lit(9.0), "a", "b", "c")  # those of the attributes themselves come first
    return w.select("p_brand", F.array_join(F.transform(X.pairs_over(weights, 3, 1.0), lambda p: F.concat(p["i"].cast("string"), F.lit("-"), p["j"].cast("string"))), " ").alias("pairs"))


@query("""WITH s AS (SELECT DISTINCT items FROM (SELECT user_id, list_sort(list(DISTINCT k::INT)) AS items FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, dense_rank() OVER (ORDER BY event_type) - 1 AS k FROM events) WHERE r <= 1 + user_id % 3 GROUP BY 1))
SELECT array_to_string(items, ',') AS attributes FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE len(b.items) > len(a.items) AND list_has_all(b.items, a.items))""")
def factorization_sets(spark, d):
    return factorized.factorization(_users(spark, d).select(F.col("items").alias("attributes"))).select(F.array_join(F.col("attributes").cast("array<string>"), ",").alias("attributes"))


@query("""WITH c AS (SELECT n_regionkey AS r, n_nationkey AS n, c_mktsegment AS g FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT r AS k, list_sort(list(DISTINCT n)) AS s FROM c WHERE g = 'BUILDING' GROUP BY 1), u AS (SELECT r AS user_k, list_sort(list(DISTINCT n)) AS us FROM c GROUP BY 1),
i AS (SELECT k, user_k FROM l, u WHERE list_has_all(us, s)), a AS (SELECT k, count(*) AS n FROM i GROUP BY 1), b AS (SELECT user_k, count(*) AS m FROM i GROUP BY 1), o AS (SELECT k, user_k FROM i JOIN a USING (k) JOIN b USING (user_k) WHERE n = 1 AND m = 1)
SELECT k, user_k FROM o WHERE (SELECT count(*) FROM o) = (SELECT count(*) FROM l) AND (SELECT count(*) FROM o) = (SELECT count(*) FROM u)""")
def compatible_factorization(spark, d):
    """Nations of the customers of one segment, by region, within those of all customers."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nations = F.array_sort(F.collect_set("n_nationkey"))
    learned = c.filter("c_mktsegment = 'BUILDING'").groupBy(F.col("n_regionkey").alias("k")).agg(nations.alias("attributes"))
    return factorized.compatible(learned, c.groupBy(F.col("n_regionkey").alias("user_k")).agg(nations.alias("user_attributes")))


@query(SQL + "SELECT id, (q0 * sqrt(q1) > 0.5)::INT::DOUBLE AS block0, (sqrt(q1) > 0.5)::INT::DOUBLE AS block1 FROM sc")
def blended_partial_labels(spark, d):
    """Two subspaces, the second of which lies in both attribute sets."""
    p = pool(spark, d).withColumn("q", X.factorized("x", BIAS, WEIGHTS)["partial_proba"])
    b = X.blend_partial("q", X.blocks_of([[0], [1]], [[0, 1], [1, 2]]))
    return p.select("id", b[0].alias("block0"), b[1].alias("block1"))


# Kernels and block scorers -----------------------------------------------------------------------------

GAMMA = 1 / 64
DIST = "(list_dot_product(v.x, v.x) + list_dot_product(z, z) - 2 * list_dot_product(v.x, z))"


def _refs(spark, d, n: int = 8) -> np.ndarray:
    return np.array([r.x for r in first_rows(vectors(spark, d), n).orderBy("pos").select("x").collect()])


@query(VECTORS_SQL + f"SELECT v.id, ref::INT AS ref, round(exp(-{DIST} / 64), 6) AS rbf, round((list_dot_product(v.x, z) / 64 + 1) ** 3, 6) AS poly, round(list_dot_product(v.x, z), 6) AS linear FROM v, refs")
def kernels(spark, d):
    refs = first_rows(vectors(spark, d), 8).select(F.col("pos").cast("int").alias("ref"), F.col("x").alias("z"))  # eight rows
    both = vectors(spark, d).crossJoin(F.broadcast(refs))
    return both.select("id", "ref", r6(X.rbf_kernel("x", "z", dim=64), "rbf"), r6(X.poly_kernel("x", "z", 3, coef0=1.0, dim=64), "poly"), r6(X.linear_kernel("x", "z"), "linear"))


@query(VECTORS_SQL + f"SELECT v.id, ref::INT AS ref, round(exp(-{DIST} / 64), 6) AS k FROM v, refs")
def kernel_matrix(spark, d):
    return blocks.kernel_table(vectors(spark, d), _refs(spark, d), blocks.Kernel("rbf")).select("id", "ref", r6(F.col("k"), "k"))


@query(VECTORS_SQL + f"SELECT v.id, rid, round(exp(-{DIST} / 64) + CASE WHEN v.id = rid THEN 0.5 ELSE 0 END, 6) AS k FROM v, refs")
def kernel_jitter(spark, d):
    refs = first_rows(vectors(spark, d), 8).select(F.col("id").alias("rid"), F.col("x").alias("z"))
    return vectors(spark, d).crossJoin(F.broadcast(refs)).select("id", "rid", r6(X.jittered(X.rbf_kernel("x", "z", dim=64), F.col("id"), F.col("rid"), 0.5), "k"))


@query(VECTORS_SQL + f", f AS (SELECT v.id, sum(dual * exp(-{DIST} / 64)) + 0.001 AS f FROM v, refs GROUP BY 1) SELECT id, (f > 0)::INT::DOUBLE AS pred, round(1 / (1 + exp(-f)), 6) AS proba, round(abs(f), 6) AS rank FROM f")
def simple_margin(spark, d):
    refs = _refs(spark, d)
    model = blocks.KernelSVM(blocks.Kernel("rbf"), refs, np.where(np.arange(len(refs)) % 2 == 0, 1.0, -1.0), 0.001)
    return blocks.score(vectors(spark, d), model).select("id", "pred", r6(F.col("proba"), "proba"), r6(F.col("rank"), "rank"))


@query(VECTORS_SQL + f", f AS (SELECT v.id, sum(dual * exp(-{DIST} / 64)) AS f FROM v, refs GROUP BY 1) SELECT id, (f > 0)::INT::DOUBLE AS pred, ((f + 0.02 > 0) = (f - 0.02 > 0))::INT::DOUBLE AS rank FROM f")
def query_by_disagreement(spark, d):
    refs = _refs(spark, d)
    dual = np.where(np.arange(len(refs)) % 2 == 0, 1.0, -1.0)
    models = [blocks.KernelSVM(blocks.Kernel("rbf"), refs, dual, b) for b in (0.0, 0.02, -0.02)]
    return blocks.score(vectors(spark, d), blocks.Disagreement(*models)).select("id", "pred", "rank")


def _vector_labels(spark, d, n: int = 40):
    return local(first_rows(vectors(spark, d), n))


@query(VECTORS_SQL + f""", p AS (SELECT x AS z FROM lab WHERE y = 1 ORDER BY pos LIMIT 1), q AS (SELECT x AS w FROM lab WHERE y = 0 ORDER BY pos LIMIT 1),
k AS (SELECT id, exp(-{DIST} / 64) AS k1, exp(-(list_dot_product(v.x, v.x) + list_dot_product(w, w) - 2 * list_dot_product(v.x, w)) / 64) AS k0, exp(-(list_dot_product(z, z) + list_dot_product(w, w) - 2 * list_dot_product(z, w)) / 64) AS k01 FROM v, p, q),
f AS (SELECT id, (k1 - k0) / (1 - k01) AS f FROM k) SELECT id, (f > 0)::INT::DOUBLE AS pred, round(abs(f), 6) AS rank FROM f""")
def fit_kernel_svm(spark, d):
    """A hard margin between the first labelled row of either class, whose solution has a closed form, over all vectors."""
    rows = first_rows(vectors(spark, d), 40).orderBy("pos").collect()  # forty labels
    pair = [next(r for r in rows if r.y == v) for v in (1.0, 0.0)]
    model = blocks.fit_svm(np.array([r.x for r in pair]), np.array([1.0, 0.0]), blocks.Kernel("rbf"), 1e5, tol=1e-13)
    return blocks.score(vectors(spark, d), model).select("id", "pred", r6(F.col("rank"), "rank"))


@query(None)
def ratio_margin(spark, d):
    """Ranks of all unlabelled rows, each added to one fitted model with either label; no SQL fits the two models a row, tests do."""
    x, y = _vector_labels(spark, d)
    rest = vectors(spark, d).join(first_rows(vectors(spark, d), 40).select("id"), "id", "left_anti")
    parts = 4 * spark.sparkContext.defaultParallelism  # small systems for each row are the work, so many small tasks
    return blocks.score(rest.repartition(parts, "id"), margin.RatioMargin(x, y, blocks.Kernel("rbf"), 10.0)).select("id", "pred", r6(F.col("rank"), "rank"))


@query(None)
def fit_disagreement(spark, d):
    """Three fits from labels and a background sample, ranking all rows; tests hold the fits against their conditions."""
    x, y = _vector_labels(spark, d)
    rest = vectors(spark, d).join(first_rows(vectors(spark, d), 40).select("id"), "id", "left_anti")
    background = np.array([r.x for r in sampling.sample(rest, 200, SEED).select("x").collect()])
    return blocks.score(vectors(spark, d), blocks.fit_disagreement((x, y), background, blocks.Kernel("rbf"), 1e3)).select("id", "pred", "rank")


@query(VECTORS_SQL + "SELECT v.id, lab.y AS label_proba FROM v LEFT JOIN lab USING (id)")
def version_space_samples(spark, d):
    """A sampled version space scores all vectors; of a labelled one all hypotheses must say its label."""
    x, y = _vector_labels(spark, d)
    space = blocks.sample_version_space(x, y, 8, 100, 10, SEED, blocks.kernel_features(x, blocks.Kernel("rbf", gamma=1.0)))
    return _labelled_only(spark, d, blocks.score(vectors(spark, d), space))


def _labelled_only(spark, d, scored: DataFrame) -> DataFrame:
    """The probability of labelled rows, null for the others."""
    own = first_rows(vectors(spark, d), 40).select("id", F.lit(True).alias("labelled"))
    return scored.filter("proba between 0 and 1").join(own, "id", "left").select("id", F.when(F.col("labelled"), F.col("proba")).alias("label_proba"))


@query(VECTORS_SQL + "SELECT v.id, lab.y AS label_proba FROM v LEFT JOIN lab USING (id)")
def version_space_chains(spark, d):
    """Three hypotheses from each of eight chains on executors, stacked into one model that scores all vectors."""
    x, y = _vector_labels(spark, d)
    feats = blocks.kernel_features(x, blocks.Kernel("rbf", gamma=1.0))
    tasks = spark.range(8).select(F.col("id").alias("chain"), (F.col("id") + SEED).alias("seed")).repartition(4)
    draws = blocks.sample_chains(tasks, x, y, 50, 5, 3, feats)
    return _labelled_only(spark, d, blocks.score(vectors(spark, d), blocks.stacked(draws, feats)))


@query(SQL + """, g AS (SELECT cat AS chain, row_number() OVER (PARTITION BY cat ORDER BY id) AS r, x0, x1 FROM pool), f AS (SELECT * FROM g WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM pool GROUP BY cat))),
m AS (SELECT chain, 0 AS k, count(*) AS n, avg(x0) AS mean, var_samp(x0) AS var FROM f GROUP BY 1 UNION ALL SELECT chain, 1, count(*), avg(x1), var_samp(x1) FROM f GROUP BY 1),
s AS (SELECT k, avg(n) AS n, avg(var) AS within, avg(n) * var_samp(mean) AS between FROM m GROUP BY 1) SELECT k, round(within, 6) AS within, round(between, 6) AS between, round(sqrt(((n - 1) / n * within + between / n) / within), 6) AS ratio FROM s""")
def chain_diagnostic(spark, d):
    """The attributes of each kind of event as a chain, cut to the length of the shortest."""
    from pyspark.sql import Window

    p = pool(spark, d)
    least = p.groupBy("cat").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))  # one row
    rows = p.withColumn("r", F.row_number().over(Window.partitionBy("cat").orderBy("id"))).crossJoin(F.broadcast(least)).filter("r <= n")
    return blocks.chain_diagnostic(rows.select(F.col("cat").alias("chain"), F.col("x").alias("w"))).select("k", r6(F.col("within"), "within"), r6(F.col("between"), "between"), r6(F.col("ratio"), "ratio"))


FEATURE_H = [[0.1, 1.0, -1.0, 0.5], [-0.05, -0.5, 1.0, 0.2], [0.0, 0.3, 0.3, -1.0]]


@query(VECTORS_SQL + f""", k AS (SELECT v.id, max(exp(-{DIST} / 64)) FILTER (WHERE ref = 0) AS k0, max(exp(-{DIST} / 64)) FILTER (WHERE ref = 1) AS k1, max(exp(-{DIST} / 64)) FILTER (WHERE ref = 2) AS k2 FROM v, refs GROUP BY 1),
p AS (SELECT id, ((0.1 + k0 - k1 + 0.5 * k2 - 0.5 > 0)::INT + (-0.05 - 0.5 * k0 + k1 + 0.2 * k2 - 0.65 > 0)::INT + (0.3 * k0 + 0.3 * k1 - k2 + 0.4 > 0)::INT) / 3 AS p FROM k) SELECT id, round(p, 6) AS proba FROM p""")
def kernel_version_space(spark, d):
    h = np.array(FEATURE_H)
    h[:, 0] += [-0.5, -0.65, 0.4]
    space = blocks.VersionSpace(h, blocks.kernel_features(_refs(spark, d, 3), blocks.Kernel("rbf"), decompose=False))
    return blocks.score(vectors(spark, d), space).select("id", r6(F.col("proba"), "proba"))


@query(None)
def entropy_reduction(spark, d):
    x, y = _vector_labels(spark, d)
    space = blocks.sample_version_space(x, y, 8, 100, 10, SEED, blocks.kernel_features(x, blocks.Kernel("rbf", gamma=1.0)))
    reference = np.array([r.x for r in sampling.sample(vectors(spark, d), 50, SEED + 1).select("x").collect()])
    return blocks.entropy_reduction(vectors(spark, d), space, reference).select("id", r6(F.col("rank"), "rank"))


@query(SQL + """, v AS (SELECT id, h, [0.5 - x0 + 0.2 * x1 > 0, -0.3 + 0.7 * x0 - 0.5 * x1 > 0, 0.2 - 0.4 * x0 - 0.1 * x1 > 0, 0.8 - 0.9 * x0 - 0.6 * x1 > 0] AS says FROM pool),
p AS (SELECT id, says, abs(len(list_filter(says, lambda s: s)) / 4 - 0.5) AS cut FROM v), best AS (SELECT min(cut) AS least FROM p), refs AS (SELECT says AS r FROM v WHERE id IN (SELECT id FROM lab)),
sides AS (SELECT DISTINCT says, side, [i FOR i IN [1, 2, 3, 4] IF says[i] = side] AS who FROM p, best, (VALUES (true), (false)) t(side) WHERE cut = least),
shares AS (SELECT says, side, len(who) AS size, len([i FOR i IN who IF r[i]]) / len(who) AS s FROM sides, refs WHERE len(who) > 0),
e AS (SELECT says, side, any_value(size) / 4 * avg(CASE WHEN s > 0 AND s < 1 THEN -s * ln(s) - (1 - s) * ln(1 - s) ELSE 0 END) AS e FROM shares GROUP BY 1, 2), t AS (SELECT says, sum(e) AS e FROM e GROUP BY 1)
SELECT id, CASE WHEN least = 0.5 THEN 0 WHEN cut = least THEN round(e, 6) END AS rank FROM p CROSS JOIN best LEFT JOIN t USING (says)""")
def expected_entropy(spark, d):
    """Entropy reduction by four given hypotheses over all events, the labelled ones as reference; null where a row cuts the space less evenly."""
    h = np.column_stack([HYPOTHESES[0], HYPOTHESES[1]])
    reference = np.array([r.x for r in first_rows(pool(spark, d), 60).select("x").collect()])
    ranked = blocks.entropy_reduction(pool(spark, d), blocks.VersionSpace(h), reference)
    return ranked.select("id", F.when(F.col("rank") < float("inf"), F.round("rank", 6)).alias("rank"))


#: A posterior over (bias, x[1], x[2]): mode, and the diagonal of its precision.
MODE, PRECISION = [0.2, 3.0, -2.0], [4.0, 2.0, 1.0]


@query(VECTORS_SQL + """, z AS (SELECT id, (0.2 + 3 * x[1] - 2 * x[2]) / sqrt(0.25 + x[1] * x[1] / 2 + x[2] * x[2] + 8 / pi()) / sqrt(2) AS z FROM v),
p AS (SELECT id, 0.5 + list_sum(list_transform(range(0, 50), lambda n: pow(-1, n) * pow(z, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) / sqrt(pi()) AS p FROM z) SELECT id, round(p, 6) AS proba, round(abs(p - 0.5), 6) AS rank FROM p""")
def laplace_posterior(spark, d):
    """Probabilities under a given posterior; the SQL sums the series of the error function."""
    model = blocks.Laplace(np.array(MODE), np.diag(PRECISION), lambda x: x[:, :2])
    return blocks.score(vectors(spark, d), model).select("id", r6(F.col("proba"), "proba"), r6(F.col("rank"), "rank"))


@query(None)
def fit_laplace(spark, d):
    """A posterior from forty labels, scoring all rows; tests hold its mode and Hessian against differences."""
    x, y = _vector_labels(spark, d)
    return blocks.score(vectors(spark, d), blocks.fit_laplace(x, y)).select("id", "pred", r6(F.col("proba"), "proba"))


def _newton_sql(steps: int) -> str:
    """Newton steps from 0, each a pass over the pool and a system of three equations solved by determinants."""
    out = [SQL, ", n0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v)"]
    for k in range(steps + 1):
        out.append(f""", s{k} AS MATERIALIZED (SELECT sum(w) + 1 AS h00, sum(w * x0) AS h01, sum(w * x1) AS h02, sum(w * x0 * x0) + 1 AS h11, sum(w * x0 * x1) AS h12, sum(w * x1 * x1) + 1 AS h22,
    sum(p - y) + any_value(b) AS g0, sum((p - y) * x0) + any_value(u) AS g1, sum((p - y) * x1) + any_value(v) AS g2, any_value(b) AS b, any_value(u) AS u, any_value(v) AS v
    FROM (SELECT *, p * (1 - p) AS w FROM (SELECT x0, x1, y, b, u, v, 1 / (1 + exp(-(b + u * x0 + v * x1))) AS p FROM pool, n{k})))""")
        if k < steps:
            out.append(f""", n{k + 1} AS MATERIALIZED (SELECT b - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b, u - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS u,
    v - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS v FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{k}))""")
    return "".join(out) + f" SELECT round(b, 6) AS b, round(u, 6) AS w0, round(v, 6) AS w1, " + ", ".join(f"round({h}, 4) AS {h}" for h in ("h00", "h01", "h02", "h11", "h12", "h22")) + f" FROM s{steps}"


@query(_newton_sql(10))
def laplace_newton(spark, d):
    """A posterior from the labels of the whole pool: mode and Hessian; the SQL takes the same Newton steps."""
    model = posterior.fit_laplace(pool(spark, d).select("x", "y"), 2, 1.0)
    h = model.hessian
    numbers = [*np.round(model.mode, 6).tolist(), *np.round(h[np.triu_indices(3)], 4).tolist()]
    names = ("b", "w0", "w1", "h00", "h01", "h02", "h11", "h12", "h22")
    return spark.createDataFrame([tuple(numbers)], ", ".join(f"{n} double" for n in names))  # nine numbers


@query(_newton_sql(10).rsplit(" SELECT round(b", 1)[0] + """, i AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s10),
z AS (SELECT id, (b + u * x0 + v * x1) / sqrt(((h11 * h22 - h12 * h12) + x0 * x0 * (h00 * h22 - h02 * h02) + x1 * x1 * (h00 * h11 - h01 * h01) + 2 * x0 * (h02 * h12 - h01 * h22) + 2 * x1 * (h01 * h12 - h02 * h11) + 2 * x0 * x1 * (h01 * h02 - h00 * h12)) / det + 8 / pi()) / sqrt(2) AS z FROM pool, i),
p AS (SELECT id, 0.5 + exp(-t * t) * list_sum(list_transform(range(0, 84), lambda n: pow(4, n) * pow(t, 2 * n + 1) * gamma(n + 1) / gamma(2 * n + 2))) / sqrt(pi()) AS p FROM (SELECT id, least(greatest(z, -5), 5) AS t FROM z)) SELECT id, round(p, 5) AS proba FROM p""")
def laplace_newton_scores(spark, d):
    """What that posterior says of every row."""
    p = pool(spark, d)
    return blocks.score(p, posterior.fit_laplace(p.select("x", "y"), 2, 1.0)).select("id", F.round("proba", 5).alias("proba"))


#: A posterior over the dual of two reference rows: dual, weights sqrt(p (1 - p)), precision.
DUAL, DUAL_WEIGHT, DUAL_PRECISION = [0.8, -0.6], [0.5, 0.4], 0.5


@query(VECTORS_SQL + f""", k AS (SELECT v.id, max(exp(-{DIST} / 64)) FILTER (WHERE ref = 0) AS k0, max(exp(-{DIST} / 64)) FILTER (WHERE ref = 1) AS k1 FROM v, refs GROUP BY 1),
h AS (SELECT 0.25 + 0.5 AS h00, 0.16 + 0.5 AS h11, 0.2 * exp(-{DIST.replace("v.x", "v.z")} / 64) AS h01 FROM refs v, refs r WHERE v.ref = 0 AND r.ref = 1),
m AS (SELECT id, 0.8 * k0 - 0.6 * k1 AS mu, (1 - (0.25 * k0 * k0 * h11 - 2 * 0.2 * k0 * k1 * h01 + 0.16 * k1 * k1 * h00) / (h00 * h11 - h01 * h01)) / 0.5 AS var FROM k, h), z AS (SELECT id, mu / sqrt(var + 8 / pi()) / sqrt(2) AS z FROM m),
p AS (SELECT id, 0.5 + list_sum(list_transform(range(0, 50), lambda n: pow(-1, n) * pow(z, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) / sqrt(pi()) AS p FROM z) SELECT id, round(p, 6) AS proba, round(abs(p - 0.5), 6) AS rank FROM p""".replace("list_dot_product(v.z, z)", "list_dot_product(v.z, r.z)").replace("list_dot_product(z, z) - 2 * list_dot_product(v.z", "list_dot_product(r.z, r.z) - 2 * list_dot_product(v.z"))
def kernel_laplace_posterior(spark, d):
    """Probabilities under a given posterior of the kernel form; the SQL inverts its two equations."""
    model = posterior.KernelLaplace(blocks.Kernel("rbf"), _refs(spark, d, 2), np.array(DUAL), np.array(DUAL_WEIGHT), DUAL_PRECISION)
    return blocks.score(vectors(spark, d), model).select("id", r6(F.col("proba"), "proba"), r6(F.col("rank"), "rank"))


@query(None)
def fit_kernel_laplace(spark, d):
    """The kernel form from forty labels, scoring all rows; tests hold its mode and variance against differences and the Gaussian process it stands for."""
    x, y = _vector_labels(spark, d)
    return blocks.score(vectors(spark, d), posterior.fit_kernel_laplace(x, y, blocks.Kernel("rbf", gamma=1.0), 0.5)).select("id", "pred", r6(F.col("proba"), "proba"))


@query(VECTORS_SQL + f"SELECT v.id, ref::INT AS ref, round(exp(-{DIST} / 64), 5) AS k FROM v, refs")
def nystroem_features(spark, d):
    """A row's features times those of a landmark give the kernel of the two."""
    marks, kernel = _refs(spark, d), blocks.Kernel("rbf")
    work = blocks.nystroem(marks, kernel)
    lands = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(work(marks))], "ref int, z array<double>")  # eight rows
    both = blocks.transform(vectors(spark, d), work).crossJoin(F.broadcast(lands))
    return both.select("id", "ref", F.round(X.dot_columns("x", "z"), 5).alias("k"))


#: Attributes of two subspaces.
SUBSPACES = [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9]]
SUB_DIST = "(list_dot_product({v}, {v}) + list_dot_product({z}, {z}) - 2 * list_dot_product({v}, {z}))"
DIST_0, DIST_1 = SUB_DIST.format(v="v.x[1:4]", z="z[1:4]"), SUB_DIST.format(v="v.x[5:10]", z="z[5:10]")


@query(VECTORS_SQL + f"SELECT v.id, ref::INT AS ref, round(exp(-{DIST_0} / 4), 5) AS k0, round(exp(-{DIST_1} / 6), 5) AS k1 FROM v, refs")
def nystroem_subspaces(spark, d):
    """Features of each subspace side by side: those of a row times those of a landmark give the kernel of the two, subspace by subspace."""
    marks, kernel = _refs(spark, d), blocks.Kernel("rbf")
    work, _ = factorized.kernel_features(marks, kernel, SUBSPACES)
    lands = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(work(marks))], "ref int, z array<double>")  # eight rows
    both = blocks.transform(vectors(spark, d), work).crossJoin(F.broadcast(lands))
    part = lambda c, k: F.slice(c, 1 + 8 * k, 8)
    return both.select("id", "ref", *(F.round(X.dot_columns(part("x", k), part("z", k)), 5).alias(f"k{k}") for k in range(2)))


@query(VECTORS_SQL + "SELECT v.id, ref::INT AS ref, round(list_dot_product(v.x, z), 6) AS product FROM v, refs")
def random_projection(spark, d):
    """Inner products with reference rows; null where the projected rows' product is off by more than the bound for that many dimensions."""
    h, wide = 3, 0.9
    work, share, eps = blocks.projection(64, h, wide, 2000, 0.1, SEED), 1 / (1 + h**0.5), wide / (2 * (1 + h**0.5))
    refs = first_rows(vectors(spark, d), 8).select(F.col("pos").cast("int").alias("ref"), F.col("id").alias("rid"), F.col("x").alias("z"))
    lands = blocks.transform(refs.select(F.col("rid").alias("id"), F.col("z").alias("x")), work).select(F.col("id").alias("rid"), F.col("x").alias("pz"))
    both = blocks.transform(vectors(spark, d), work).withColumnRenamed("x", "px").join(vectors(spark, d).select("id", "x"), "id").crossJoin(F.broadcast(refs.join(lands, "rid")))  # eight rows
    product = X.dot_columns("x", "z")
    kept = share * product + F.when(F.col("x") == F.col("z"), 1 - share).otherwise(0.0)  # a row, and its equals, share their signs
    return both.select("id", "ref", F.when(F.abs(X.dot_columns("px", "pz") - kept) <= eps, F.round(product, 6)).alias("product"))


@query(VECTORS_SQL + """, m AS (SELECT id, 1 / (1 + exp(-(0.1 + x[1] * 3 - x[2] * 2))) AS q0, 1 / (1 + exp(-(x[3] * 4))) AS q1 FROM v) SELECT id, round(q0 * q1, 6) AS proba, round((1 - 2 * q0 * (1 - q0)) * (1 - 2 * q1 * (1 - q1)), 6) AS rank FROM m""")
def subspace_learner(spark, d):
    linear = blocks.Kernel("linear")
    one = blocks.KernelSVM(linear, np.array([[3.0, -2.0]]), np.array([1.0]), 0.1)
    two = blocks.KernelSVM(linear, np.array([[4.0]]), np.array([1.0]), 0.0)
    return blocks.score(vectors(spark, d), blocks.Subspaces([[0, 1], [2]], [one, two])).select("id", r6(F.col("proba"), "proba"), r6(F.col("rank"), "rank"))


@query(VECTORS_SQL + f", k AS (SELECT v.id, max(exp(-{DIST} / 64)) FILTER (WHERE ref = 0) AS k0, max(exp(-{DIST} / 64)) FILTER (WHERE ref = 1) AS k1 FROM v, refs GROUP BY 1) SELECT id, round(1 / (1 + exp(-(2 * k0 - 1))) / (1 + exp(-(3 * k1 - 2))), 6) AS proba FROM k")
def kernel_factorized(spark, d):
    refs = _refs(spark, d, 2)
    features = blocks.transform(vectors(spark, d), lambda x: blocks.Kernel("rbf")(x, refs))
    return features.select("id", r6(X.factorized("x", [-1.0, -2.0], [[2.0, 0.0], [0.0, 3.0]])["proba"], "proba"))


@query(VECTORS_SQL + f""", k AS (SELECT v.id, max(v.y) AS y, max(exp(-{DIST_0} / 4)) FILTER (WHERE ref = 0) AS k0, max(exp(-{DIST_1} / 6)) FILTER (WHERE ref = 0) AS k1 FROM v, refs GROUP BY 1),
p AS (SELECT id, y, 1 / (1 + exp(-(3 * k0 - 2))) / (1 + exp(-(4 * k1 - 3))) AS p FROM k) SELECT round(avg(CASE WHEN y > 0 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS loss FROM p""")
def kernel_factorized_loss(spark, d):
    """The loss of given weights over all vectors, their kernel features made block by block in the gradient's pass."""
    features, _ = factorized.kernel_features(_refs(spark, d, 1), blocks.Kernel("rbf"), SUBSPACES)
    g = factorized.gradient(vectors(spark, d), np.array([-2.0, -3.0]), np.array([[3.0, 0.0], [0.0, 4.0]]), features)
    return g.select(r6(F.col("loss"), "loss"))


@query(None)
def fit_kernel_factorized(spark, d):
    """Two subspaces of Nystroem features fitted on 200 labels score all vectors; tests hold the fit against one on stored features."""
    rows = first_rows(vectors(spark, d), 200)
    model = factorized.fit_kernel(rows, _refs(spark, d, 8), blocks.Kernel("rbf", gamma=1.0), SUBSPACES, penalty="l2", strength=1e-3, steps=150)
    return blocks.score(vectors(spark, d), model).select("id", "pred", F.round("proba", 4).alias("proba"))


class Nearest:
    """A custom learner: the nearer of two means."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.means = x[y == 0].mean(axis=0), x[y == 1].mean(axis=0)

    def score_block(self, x: np.ndarray):
        d0, d1 = (((x - m) ** 2).sum(axis=1) for m in self.means)
        p = 1 / (1 + np.exp(d1 - d0))
        return (p > 0.5).astype(float), p, np.abs(p - 0.5)


class Steady(Nearest):
    """Ranks that differ by rounding only are ties."""

    def score_block(self, x: np.ndarray):
        pred, p, rank = super().score_block(x)
        return pred, p, np.round(rank, 9)


class SteadyFirst(Steady):
    """The same on the first attribute only."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        super().__init__(x[:, :1], y)

    def score_block(self, x: np.ndarray):
        return super().score_block(x[:, :1])


@query(SQL + """, m AS (SELECT avg(x0) FILTER (WHERE y = 0) AS a0, avg(x1) FILTER (WHERE y = 0) AS a1, avg(x0) FILTER (WHERE y = 1) AS b0, avg(x1) FILTER (WHERE y = 1) AS b1 FROM lab)
SELECT id, round(1 / (1 + exp((x0 - b0) ** 2 + (x1 - b1) ** 2 - (x0 - a0) ** 2 - (x1 - a1) ** 2)), 6) AS proba FROM pool, m""")
def custom_learner(spark, d):
    return blocks.score(pool(spark, d), Nearest(*local(labelled_pool(spark, d)))).select("id", r6(F.col("proba"), "proba"))


@query(SQL + """, m AS (SELECT avg(x0) FILTER (WHERE p0 = 0) AS a0, avg(x0) FILTER (WHERE p0 = 1) AS b0, avg(x1) FILTER (WHERE p1 = 0) AS a1, avg(x1) FILTER (WHERE p1 = 1) AS b1 FROM lab),
q AS (SELECT id, 1 / (1 + exp((x0 - b0) ** 2 - (x0 - a0) ** 2)) AS q0, 1 / (1 + exp((x1 - b1) ** 2 - (x1 - a1) ** 2)) AS q1 FROM pool, m) SELECT id, round(q0 * q1, 6) AS proba, round((1 - 2 * q0 * (1 - q0)) * (1 - 2 * q1 * (1 - q1)), 6) AS rank FROM q""")
def fit_subspace_learner(spark, d):
    """One learner a subspace, each fitted on its column and its partial labels."""
    rows = labelled_pool(spark, d).orderBy("id").select("x", "partial").collect()  # sixty labels
    model = blocks.fit_subspaces(np.array([r.x for r in rows]), np.array([r.partial for r in rows]), [[0], [1]], Nearest)
    return blocks.score(pool(spark, d), model).select("id", r6(F.col("proba"), "proba"), r6(F.col("rank"), "rank"))


@query(SQL + """, c AS (SELECT *, (dense_rank() OVER (ORDER BY cat) - 1)::DOUBLE AS code FROM pool), l AS (SELECT * FROM c ORDER BY h, id LIMIT 60),
m AS (SELECT avg(x0) FILTER (WHERE p0 = 0) AS a0, avg(x0) FILTER (WHERE p0 = 1) AS b0 FROM l), k AS (SELECT code, min((cat <> 'error')::INT)::DOUBLE AS known FROM l GROUP BY 1)
SELECT id, round(coalesce(known, 0.5) / (1 + exp((x0 - b0) ** 2 - (x0 - a0) ** 2)), 6) AS proba FROM c LEFT JOIN k USING (code), m""")
def fit_mixed_subspaces(spark, d):
    """A numerical and a categorical subspace, each learner fitted on its own labels."""
    p = pool(spark, d)
    kinds = sorted(r[0] for r in p.select("cat").distinct().collect())  # five
    coded = p.withColumn("x", F.array(F.col("x")[0], (F.array_position(F.array(*map(F.lit, kinds)), F.col("cat")) - 1).cast("double")))
    rows = first_rows(coded, 60).orderBy("id").select("x", F.array(F.col("partial")[0], (F.col("cat") != "error").cast("double")).alias("partial")).collect()
    model = blocks.fit_subspaces(np.array([r.x for r in rows]), np.array([r.partial for r in rows]), [[0], [1]], [Nearest, blocks.Categories.fit])
    return blocks.score(coded, model).select("id", r6(F.col("proba"), "proba"))


# Fits, searches and composite jobs ----------------------------------------------------------------------


@query(None)
def fit_factorized(spark, d):
    """A model fitted on 200 labels scores the whole pool; tests hold the fit against plain steps."""
    bias, w, _ = factorized.fit(labelled_pool(spark, d, 200), 2, "l2", 1e-3, steps=150)
    m = X.factorized("x", bias, w)
    return pool(spark, d).select("id", "y", m["pred"].alias("pred"), F.round(m["proba"], 4).alias("proba"))


@query(SQL + "SELECT id, CASE WHEN abs(proba - 0.5) > 0.4 THEN (proba > 0.5)::INT::DOUBLE END AS pred FROM sc")
def distil(spark, d):
    """A factorized model fitted on another model's predictions over a sample says the same of every row that isn't close to the boundary."""
    target = X.factorized("x", BIAS, WEIGHTS)
    seen = sampling.sample(pool(spark, d), 2000, SEED).select("x", target["pred"].alias("y"))
    bias, w, _ = factorized.fit(seen, 2, None, steps=300)
    clear = F.abs(target["proba"] - 0.5) > 0.4
    return pool(spark, d).select("id", F.when(clear, X.factorized("x", bias, w)["pred"]).alias("pred"))


@query(None)
def learn_factorization(spark, d):
    """From 300 labels: the attribute sets, and a label of each for every row of the pool; tests hold the steps one by one."""
    learned = factorized.learn_factorization(pool(spark, d), labelled_pool(spark, d, 300), 3, 1e-3, 1e-3, steps=200)
    text = "; ".join(",".join(map(str, s)) for s in learned.sets)
    return pool(spark, d).select("id", F.lit(text).alias("factorization"), F.array_join(learned.partial_labels("x").cast("array<string>"), ",").alias("partial"))


def _three_attributes(spark, d):
    rows = first_rows(pool(spark, d), 150).withColumn("x", F.array(F.col("x")[0], F.col("x")[1], (F.col("user_id") % 10) / 10))
    return local(rows)


@query(None)
def partition_brute_force(spark, d):
    """The best partition of three attributes by the labels, with its model's loss over the whole pool."""
    best = factorized.brute_force(spark, *_three_attributes(spark, d)).first()
    rows = pool(spark, d).withColumn("x", F.array(F.col("x")[0], F.col("x")[1], (F.col("user_id") % 10) / 10))
    name = " ".join("+".join(map(str, p)) for p in best.partition)
    return factorized.loss(rows, best.bias, best.w).select(F.lit(name).alias("partition"), F.lit(round(best.loss, 4)).alias("loss"), F.round("loss", 4).alias("pool_loss"))


@query(None)
def partition_greedy(spark, d):
    """The path of merges, with the loss on the labels by level, and that of the last model over the whole pool."""
    x, y = _three_attributes(spark, d)
    path = factorized.greedy(spark, x, y, 200, warm=False)
    last, _ = path[-1]
    bias, w, _ = factorized.fit_partition(x, y, last, 200)
    rows = pool(spark, d).withColumn("x", F.array(F.col("x")[0], F.col("x")[1], (F.col("user_id") % 10) / 10))
    whole = factorized.loss(rows, bias.tolist(), w.tolist()).select(F.round("loss", 4).alias("pool_loss"))
    levels = spark.createDataFrame([(k, " ".join("+".join(map(str, b)) for b in p), round(v, 4)) for k, (p, v) in enumerate(path)], "level int, partition string, loss double")
    return levels.crossJoin(whole)  # one row


@query(None)
def interaction_scan(spark, d):
    return interaction.scan(pool(spark, d), 2, [0.001, 0.1, 10.0])


@query(SQL + """, m AS (SELECT avg(x0) FILTER (WHERE y = 0) AS a0, avg(x1) FILTER (WHERE y = 0) AS a1, avg(x0) FILTER (WHERE y = 1) AS b0, avg(x1) FILTER (WHERE y = 1) AS b1 FROM lab),
r AS (SELECT id, y, h, abs(1 / (1 + exp((x0 - b0) ** 2 + (x1 - b1) ** 2 - (x0 - a0) ** 2 - (x1 - a1) ** 2)) - 0.5) AS rank FROM pool, m WHERE id NOT IN (SELECT id FROM lab)),
picked AS (SELECT * FROM r ORDER BY round(rank, 9), h, id LIMIT 3) SELECT id, y AS label, 6 AS iter, true AS new FROM picked UNION ALL SELECT id, y, floor(pos / 10)::INT, false FROM lab""")
def explore_round(spark, d):
    """One round: a learner fitted on the labels picks three rows, which are labelled."""
    p = pool(spark, d)
    truth = p.select("id", F.col("y").alias("label"), "partial")
    own = labels(spark, d).select("id", "label", "partial", "iter")
    _, after = explore.explore_round(p, truth, own, Steady, 6, 3, seed=SEED)
    return after.select("id", "label", "iter", (F.col("iter") == 6).alias("new"))


@query(PARTS_SQL + """, b AS (SELECT min(x0) FILTER (WHERE ysize = 1) AS l, max(x0) FILTER (WHERE ysize = 1) AS r FROM lab), c AS (SELECT min(x0) FILTER (WHERE ysize = 0 AND x0 > r) AS above, max(x0) FILTER (WHERE ysize = 0 AND x0 < l) AS below FROM lab, b)
SELECT id, CASE WHEN id IN (SELECT id FROM lab) THEN 'labeled' ELSE 'inferred' END AS state FROM part_pool, b, c WHERE id IN (SELECT id FROM lab) OR x0 >= above OR x0 <= below OR x0 BETWEEN l AND r""")
def dual_space_pass(spark, d):
    """Labels of a batch reach the polytope, which then decides unknown rows."""
    p = parts(spark, d).withColumn("x", F.slice("x", 1, 1)).withColumn("y", F.col("ysize"))
    batch = first_rows(p, 60)
    x, y = local(batch)
    own = batch.select("id", F.lit("labeled").alias("state"))
    after, _ = P.dual_space_pass(p, own, p.limit(0).select("id", "x", F.col("y").alias("label")), P.polytope("positive"), x, y)
    return after


@query(SQL + f""", r AS (SELECT id, abs(proba - 0.5) AS rank, h, {THREE} AS p FROM sc WHERE id NOT IN (SELECT id FROM lab)), o AS (SELECT *, row_number() OVER (ORDER BY round(rank, 9), h, id) AS k FROM r),
t AS (SELECT max(k) AS k FROM (SELECT k FROM o WHERE p = 0.5 ORDER BY k LIMIT 20)) SELECT id, p::DOUBLE AS label, p = 0.5 AS asked FROM o WHERE k <= (SELECT k FROM t)""")
def dual_space_draw(spark, d):
    """Twenty rows to ask; rows drawn before them that the polytope decides go to the cache."""
    rows = state.with_state(pool(spark, d), states(spark, d)).filter("state <> 'labeled'")
    scored = rows.select("id", F.round(X.factorized("x", BIAS, WEIGHTS)["rank"], 9).alias("rank"), _three().alias("polytope"))
    ask, cache = sampling.dual_space_draw(scored, 20, SEED)
    return ask.select("id", F.lit(0.5).alias("label"), F.lit(True).alias("asked")).unionByName(cache.select("id", "label", F.lit(False).alias("asked")))


@query("""WITH p AS (SELECT DISTINCT floor((l_quantity - 1) / 10)::BIGINT AS x, round(l_discount * 100)::BIGINT AS y, round(l_tax * 100)::BIGINT AS z FROM lineitem),
ends AS (SELECT *, z IN (min(z) OVER xy, max(z) OVER xy) AND y IN (min(y) OVER xz, max(y) OVER xz) AND x IN (min(x) OVER yz, max(x) OVER yz) AS e FROM p WINDOW xy AS (PARTITION BY x, y), xz AS (PARTITION BY x, z), yz AS (PARTITION BY y, z)),
c AS MATERIALIZED (SELECT x, y, z, row_number() OVER (ORDER BY x, y, z) AS i FROM ends WHERE e),
t AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, (b.y - a.y) * (d.z - a.z) - (b.z - a.z) * (d.y - a.y) AS nx, (b.z - a.z) * (d.x - a.x) - (b.x - a.x) * (d.z - a.z) AS ny, (b.x - a.x) * (d.y - a.y) - (b.y - a.y) * (d.x - a.x) AS nz FROM c a JOIN c b ON a.i < b.i JOIN c d ON b.i < d.i),
faces AS (SELECT nx, ny, nz, ax, ay, az FROM t, c WHERE nx <> 0 OR ny <> 0 OR nz <> 0 GROUP BY ALL HAVING max(nx * (x - ax) + ny * (y - ay) + nz * (z - az)) <= 0 OR min(nx * (x - ax) + ny * (y - ay) + nz * (z - az)) >= 0),
planes AS MATERIALIZED (SELECT DISTINCT i, round(abs(nx) / g, 9) AS u, round(ny * s / g, 9) AS v, round(nz * s / g, 9) AS w FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS g, CASE WHEN nx <> 0 THEN sign(nx) WHEN ny <> 0 THEN sign(ny) ELSE sign(nz) END AS s FROM faces) JOIN c ON nx * (x - ax) + ny * (y - ay) + nz * (z - az) = 0)
SELECT x::DOUBLE AS x0, round(y / 100, 6) AS x1, round(z / 100, 6) AS x2 FROM c WHERE EXISTS (SELECT 1 FROM planes k JOIN planes l ON k.i = l.i JOIN planes m ON k.i = m.i WHERE k.i = c.i AND abs(k.u * (l.v * m.w - l.w * m.v) - k.v * (l.u * m.w - l.w * m.u) + k.w * (l.u * m.v - l.v * m.u)) > 1e-6)""")
def convex_hull_3d(spark, d):
    """Vertices of the hull of all line items' quantity by tens, discount and tax. The SQL, in whole numbers: planes through three points with all others
    on one side; a vertex lies in three of them that meet in a point."""
    t = table(spark, d, "lineitem").select(F.array(F.floor((F.col("l_quantity") - 1) / 10).cast("double"), *(F.col(c).cast("double") for c in ("l_discount", "l_tax"))).alias("x"))
    v = P.hull_vertices(t.distinct(), 3)
    return v.select(*(r6(F.col("x")[k], f"x{k}") for k in range(3)))


#: A cross-polytope in four dimensions and a negative point on its first axis.
RADIUS, BEYOND = 0.3, 0.45


@query(VECTORS_SQL + f"""SELECT id, CASE WHEN x[1] / {BEYOND} - (abs(x[2]) + abs(x[3]) + abs(x[4])) / {RADIUS} >= 1 - 1e-9 THEN 0 WHEN abs(x[1]) + abs(x[2]) + abs(x[3]) + abs(x[4]) <= {RADIUS} + 1e-9 THEN 1 ELSE 0.5 END::DOUBLE AS pred FROM v""")
def polytope_4d(spark, d):
    """Hull and cone in four dimensions, fitted on nine points, over all vectors."""
    points = np.vstack([np.eye(4) * RADIUS, -np.eye(4) * RADIUS, [[BEYOND, 0, 0, 0]]])
    model = P.polytope("positive", 1e-9).fit(points, np.array([1] * 8 + [0]))
    return blocks.score(vectors(spark, d).withColumn("x", F.slice("x", 1, 4)), model).select("id", "pred")


@query(PARTS_SQL + f"SELECT id, {POLYTOPE_SQL} AS pred FROM part_pool")
def save_load_polytope(spark, d):
    path = f"{shared_folder(spark)}/polytope-{uuid.uuid4().hex}"
    _triangle().save(spark, path)
    return parts(spark, d).select("id", P.load_polytope(spark, path).column("x").alias("pred"))


@query(SQL + "SELECT cat AS task, count(*) AS n, (SELECT count(*) FROM pool WHERE y = 1) AS positives, true AS better_than_chance FROM pool GROUP BY 1")
def many_tasks(spark, d):
    """One model a kind of event, all evaluated in one pass."""
    p = pool(spark, d)
    truth = p.select("id", F.col("y").alias("label"))
    own = first_rows(p, 400).select(F.col("cat").alias("task"), "x", "y")
    scores = explore.fit_tasks(own, p, truth)
    return scores.join(p.groupBy(F.col("cat").alias("task")).agg(F.count(F.lit(1)).alias("n")), "task").select("task", "n", (F.col("true_positive") + F.col("false_negative")).alias("positives"), (F.col("fscore") > 0.4).alias("better_than_chance"))


def _runs_sql(learners: dict[str, str], seeds: tuple[int, ...]) -> str:
    """Two rounds of every learner and seed: the first row of either class by hash, the model's score, the row it picks, the score after that."""
    parts, out = [SQL], []
    for name, away in learners.items():
        for seed in seeds:
            t = f"{name}_{seed}"
            model = "SELECT avg(x0) FILTER (WHERE y = 0) AS a0, avg(x1) FILTER (WHERE y = 0) AS a1, avg(x0) FILTER (WHERE y = 1) AS b0, avg(x1) FILTER (WHERE y = 1) AS b1 FROM"
            said = f"SELECT id, x0, x1, y, g, 1 / (1 + exp(({away.format('b')}) - ({away.format('a')}))) AS p FROM g_{t},"
            parts.append(f""", g_{t} AS MATERIALIZED (SELECT id, x0, x1, y, md5('{seed}:' || id) AS g FROM pool), l0_{t} AS MATERIALIZED (FROM (FROM g_{t} WHERE y = 1 ORDER BY g, id LIMIT 1) UNION ALL FROM (FROM g_{t} WHERE y = 0 ORDER BY g, id LIMIT 1)),
p0_{t} AS MATERIALIZED ({said} ({model} l0_{t})), l1_{t} AS MATERIALIZED (FROM l0_{t} UNION ALL FROM (SELECT id, x0, x1, y, g FROM p0_{t} WHERE id NOT IN (SELECT id FROM l0_{t}) ORDER BY round(abs(p - 0.5), 9), g, id LIMIT 1)), p1_{t} AS MATERIALIZED ({said} ({model} l1_{t}))""")
            out += [f"SELECT '{name}' AS learner, {k} AS iter, 2 * count(*) FILTER (WHERE p > 0.5 AND y = 1) / (count(*) FILTER (WHERE p > 0.5) + count(*) FILTER (WHERE y = 1)) AS f, count(*) FILTER (WHERE p > 0.5 AND y = 1) AS tp FROM p{k}_{t}" for k in (0, 1)]
    return "".join(parts) + f" SELECT learner, iter, round(avg(f), 6) AS fscore, round(avg(tp), 6)::DOUBLE AS tp FROM ({' UNION ALL '.join(out)}) GROUP BY ALL"


@query(_runs_sql({"nearest": "(x0 - {0}0) ** 2 + (x1 - {0}1) ** 2", "first": "(x0 - {0}0) ** 2"}, (7, 8, 9)))
def learner_runs(spark, d):
    """Learning curves of two learners, three runs each, all runs side by side in one pass a round."""
    p = pool(spark, d)
    truth = p.select("id", F.col("y").alias("label"), "partial")
    runs = [explore.Run(name, fit, seed) for name, fit in (("nearest", Steady), ("first", SteadyFirst)) for seed in (7, 8, 9)]
    return metrics.learning_curves(explore.explore_many(p, truth, runs, 1), ["fscore", "tp"]).select("learner", "iter", r6(F.col("fscore"), "fscore"), r6(F.col("tp"), "tp"))


@query(SQL + """, f AS (FROM (SELECT * FROM pool WHERE y = 1 ORDER BY id LIMIT 1) UNION ALL FROM (SELECT * FROM pool WHERE y = 0 ORDER BY id LIMIT 1)), m AS (SELECT avg(x0) FILTER (WHERE y = 1) AS a0, avg(x1) FILTER (WHERE y = 1) AS a1, avg(x0) FILTER (WHERE y = 0) AS b0, avg(x1) FILTER (WHERE y = 0) AS b1 FROM f),
p AS (SELECT y, 1 / (1 + exp((x0 - b0) ** 2 + (x1 - b1) ** 2 - (x0 - a0) ** 2 - (x1 - a1) ** 2)) > 0.5 AS yes FROM pool, m) SELECT 0 AS iter, round(count(*) FILTER (WHERE yes AND y = 1) / count(*) FILTER (WHERE yes OR y = 1), 6) AS jaccard, count(*) FILTER (WHERE yes AND y = 0)::DOUBLE AS fp FROM p""")
def custom_exploration(spark, d):
    """Own sampler (least ids), noise (every label turned round), measure and stop rule (after the first round)."""
    p = pool(spark, d)
    truth = p.select("id", F.col("y").alias("label"))
    least = lambda rows, seed: rows.filter("label = 1").orderBy("id").limit(1).unionByName(rows.filter("label = 0").orderBy("id").limit(1))
    turned = lambda asked: asked.withColumn("label", 1 - F.col("label"))
    jaccard = lambda v: v["tp"] / (v["tp"] + v["fp"] + v["fn"])
    log = explore.explore_many(p, truth, [explore.Run("nearest", Steady, SEED)], 5, 1, least, turned, {"jaccard": jaccard}, lambda v: v["jaccard"] >= 0)
    return metrics.learning_curves(log, ["jaccard", "fp"]).select("iter", r6(F.col("jaccard"), "jaccard"), "fp")
