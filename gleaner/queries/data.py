"""Queries of sources, state, sampling, metrics and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import metrics, sampling, state
from ..plans import explore
from ..sources import pool as source
from ..sources.scratch import shared_folder
from .base import BIAS, SEED, SQL, WEIGHTS, labels, pool, state as states, table

QUERIES, SQLS = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQLS[f.__name__] = sql
        return f

    return add


def scored(spark, d) -> DataFrame:
    p = pool(spark, d)
    m = X.factorized("x", BIAS, WEIGHTS)
    return p.select("*", *(c.alias(n) for n, c in m.items() if n != "partial"), m["partial"].alias("partial_pred"))


@query(SQL + "SELECT id, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM pool")
def load_pool(spark, d):
    return pool(spark, d).select("id", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"))


@query("SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS id, p_partkey, p_size::DOUBLE AS x0 FROM part")
def load_pool_numbered(spark, d):
    rows = source.load_pool(table(spark, d, "part"), ["p_size"], order=["p_retailprice", "p_partkey"], keep=("p_partkey",))
    return rows.select("id", "p_partkey", F.col("x")[0].alias("x0"))


@query(SQL + "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE x0 IS NULL OR NOT isfinite(x0) OR x1 IS NULL) AS n_bad, 2::BIGINT AS min_dim, 2::BIGINT AS max_dim FROM pool")
def validate_pool(spark, d):
    return source.pool_report(pool(spark, d))


@query("SELECT doc_id AS id, least(quality, 1 - toxic)::DOUBLE AS label, quality::DOUBLE AS partial0, (1 - toxic)::DOUBLE AS partial1 FROM labels")
def load_labels(spark, d):
    t = table(spark, d, "labels")
    out = source.load_labels(t, F.least("quality", 1 - F.col("toxic")), ["quality", 1 - F.col("toxic")], "doc_id")
    return out.select("id", "label", F.col("partial")[0].alias("partial0"), F.col("partial")[1].alias("partial1"))


@query("SELECT toxic, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS labeled_indexes, string_agg(quality::VARCHAR, ',' ORDER BY doc_id) AS noisy_labels FROM labels GROUP BY 1")
def export_labels(spark, d):
    t = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.array(F.col("quality")).alias("partial"), "toxic")
    out = source.export_labels(t, noisy=True, by=("toxic",))
    return out.select("toxic", F.array_join(F.col("labeled_indexes").cast("array<string>"), ",").alias("labeled_indexes"), F.array_join(F.col("noisy_labels").cast("array<string>"), ",").alias("noisy_labels"))


@query(SQL + "SELECT id, round(proba, 6) AS proba FROM sc")
def save_load_model(spark, d):
    import uuid

    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    source.save_model(source.model_table(spark, BIAS, WEIGHTS), path)
    bias, weights = source.load_model(spark, path)
    return pool(spark, d).select("id", F.round(X.factorized("x", bias, weights)["proba"], 6).alias("proba"))


@query(SQL + "SELECT id, round(x0, 6) AS s0, round(x1, 6) AS s1 FROM pool")
def project_subspaces(spark, d):
    return pool(spark, d).select("id", F.round(X.project("x", [0])[0], 6).alias("s0"), F.round(X.project("x", [1])[0], 6).alias("s1"))


@query("SELECT p_partkey AS id, p_size::DOUBLE AS structured, 2::BIGINT AS n_text, round(p_retailprice + length(p_name), 6) AS text_sum, (p_size < 25)::INT::DOUBLE AS structured_label, (p_retailprice < 950)::INT::DOUBLE AS text_label FROM part")
def split_text_columns(spark, d):
    x = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.length("p_name").cast("double"))
    partial = F.array((F.col("p_size") < 25).cast("double"), (F.col("p_retailprice") < 950).cast("double"))
    s, t, sl, tl = X.split_text(F.col("x"), F.col("partial"), 1)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.alias("x"), partial.alias("partial")).select("id", s[0].alias("structured"), F.size(t).cast("long").alias("n_text"), F.round(t[0] + t[1], 6).alias("text_sum"), sl[0].alias("structured_label"), tl.alias("text_label"))


@query(SQL + """, full_state AS (SELECT id, coalesce(state, 'unknown') AS s FROM pool LEFT JOIN st USING (id))
SELECT 'labeled' AS view, count(*) AS n, sum(id)::BIGINT AS ids FROM full_state WHERE s = 'labeled' UNION ALL SELECT 'inferred', count(*), sum(id)::BIGINT FROM full_state WHERE s = 'inferred'
UNION ALL SELECT 'unknown', count(*), sum(id)::BIGINT FROM full_state WHERE s = 'unknown' UNION ALL SELECT 'unlabeled', count(*), sum(id)::BIGINT FROM full_state WHERE s <> 'labeled'""")
def state_views(spark, d):
    p, s = pool(spark, d), states(spark, d)
    parts = [state.view(p, s, v).agg(F.lit(v).alias("view"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")) for v in ("labeled", "inferred", "unknown", "unlabeled")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(SQL + "SELECT id, round(x0, 6) AS f0, round(x1, 6) AS f1, round(x0 * x0, 9) AS f2, round(x1 * x1, 9) AS f3, round(x0 * x1, 9) AS f4 FROM pool")
def interaction_features(spark, d):
    f = pool(spark, d).select("id", X.interactions("x", 2, True).alias("f"))
    return f.select("id", *(F.round(F.col("f")[i], 6 if i < 2 else 9).alias(f"f{i}") for i in range(5)))


@query("SELECT event_id AS id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 0 END::BIGINT AS category FROM events")
def one_hot_category(spark, d):
    block = F.array(*((F.col("event_type") == v).cast("double") for v in ("click", "error", "purchase", "signup")))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), X.category(block).alias("category"))


@query(SQL + "SELECT id, pos, round(x0, 6) AS x0 FROM lab")
def lookup_rows(spark, d):
    return state.lookup(pool(spark, d), labels(spark, d).select("id", "pos")).select("id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x")[0], 6).alias("x0"))


@query(SQL + "SELECT id, y AS label, p0, p1 FROM inf")
def label_selected(spark, d):
    truth = pool(spark, d).select("id", F.col("y").alias("label"), "partial")
    return state.label_selected(states(spark, d).filter("state = 'inferred'"), truth).select("id", "label", F.col("partial")[0].alias("p0"), F.col("partial")[1].alias("p1"))


@query(SQL + """, batch AS (SELECT id FROM pool ORDER BY h, id LIMIT 300 OFFSET 260)
SELECT state, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT id, state FROM st UNION ALL SELECT id, 'labeled' FROM batch) GROUP BY 1""")
def move_to_labeled(spark, d):
    from .base import first_rows

    p = pool(spark, d)
    batch = first_rows(p, 560).filter("pos >= 260").select("id", F.col("y").alias("label"), "partial")
    moved, _ = state.move_to_labeled(states(spark, d), labels(spark, d).select("id", "label", "partial", "iter"), batch, 9)
    return moved.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(SQL + """SELECT s AS state, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT p.id, CASE WHEN cat = 'error' AND coalesce(state, 'x') <> 'inferred' THEN 'inferred' ELSE coalesce(state, 'unknown') END AS s FROM pool p LEFT JOIN st USING (id)) GROUP BY 1""")
def move_to_inferred(spark, d):
    p, s = pool(spark, d), states(spark, d)
    ids = p.filter("cat = 'error'").join(s.filter("state = 'inferred'"), "id", "left_anti")
    return state.with_state(p, state.move_to_inferred(s, ids)).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(SQL + "SELECT count(*) FILTER (WHERE x0 >= 0.5) AS after_unknown, 60::BIGINT AS after_flush FROM pool JOIN st USING (id)")
def move_to_unknown(spark, d):
    p, s = pool(spark, d), states(spark, d)
    left = state.move_to_unknown(s, p.filter(F.col("x")[0] < 0.5)).agg(F.count(F.lit(1)).alias("after_unknown"))
    return left.crossJoin(state.remove_inferred(s).agg(F.count(F.lit(1)).alias("after_flush")))


@query(SQL + "SELECT id, round(x0, 6) AS x0, p0, p1 FROM lab WHERE pos >= 50")
def training_set(spark, d):
    t = state.training_set(pool(spark, d), labels(spark, d), last=True, partial=True)
    return t.select("id", F.round(F.col("x")[0], 6).alias("x0"), F.col("y")[0].alias("p0"), F.col("y")[1].alias("p1"))


@query(SQL + "SELECT s.id, coalesce(l.y, (s.proba > 0.5)::INT::DOUBLE) AS final FROM sc s LEFT JOIN lab l USING (id)")
def user_labels(spark, d):
    return state.user_labels(scored(spark, d), labels(spark, d)).select("id", "final")


@query(SQL + "SELECT coalesce(state, 'unknown') AS state, count(*) AS n FROM pool LEFT JOIN st USING (id) GROUP BY 1")
def partition_sizes(spark, d):
    return state.sizes(pool(spark, d), states(spark, d))


@query(SQL + "SELECT count(*) AS n_labels, sum(y)::BIGINT AS n_positive, sum(y) > 0 AND sum(y) < count(*) AS both_classes, round(100.0 * sum(y) / count(*), 6) AS selectivity FROM pool")
def label_summary(spark, d):
    return state.label_summary(pool(spark, d).select("id", F.col("y").alias("label")))


@query(SQL + "SELECT id, y AS label, iter FROM (SELECT id, y, 0 AS iter FROM lab UNION ALL SELECT id, y, 1 FROM inf)")
def concat_labels(spark, d):
    p = pool(spark, d).select("id", F.col("y").alias("label"), "partial")
    s = states(spark, d)
    one, two = (p.join(s.filter(F.col("state") == v), "id", "left_semi") for v in ("labeled", "inferred"))
    return state.concat_labels(one, two).select("id", "label", "iter")


@query("""WITH c AS (SELECT count(*) FILTER (WHERE l = 1 AND p = 1) AS tp, count(*) FILTER (WHERE l = 0 AND p = 1) AS fp, count(*) FILTER (WHERE l = 0 AND p = 0) AS tn, count(*) FILTER (WHERE l = 1 AND p = 0) AS fn, cat
    FROM (SELECT event_type AS cat, (value < 50 AND hour(ts) < 12)::INT AS l, (1 / (1 + exp(-(4 - 8 * value / 100))) / (1 + exp(-(3 - 6 * hour(ts) / 24))) > 0.5)::INT AS p FROM events) GROUP BY cat)
SELECT cat, tp AS true_positive, fp AS false_positive, tn AS true_negative, fn AS false_negative, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS fscore FROM c""")
def classification_metrics(spark, d):
    m = metrics.classification_metrics(scored(spark, d).withColumnRenamed("y", "label"), by=("cat",))
    return m.select("cat", *metrics.SCORES[:4], *(F.round(s, 6).alias(s) for s in metrics.SCORES[4:]))


@query(SQL + ", m AS (SELECT l.y, (s.proba > 0.5)::INT AS p FROM lab l JOIN sc s USING (id)) SELECT round(2 * count(*) FILTER (WHERE y = 1 AND p = 1) / greatest(2 * count(*) FILTER (WHERE y = 1 AND p = 1) + count(*) FILTER (WHERE y = 1 AND p = 0) + count(*) FILTER (WHERE y = 0 AND p = 1), 1), 6) AS train_fscore, count(*) FILTER (WHERE y = 1 AND p = 1) AS train_true_positive FROM m")
def training_classification_metrics(spark, d):
    rows = scored(spark, d).join(labels(spark, d).select("id", "label"), "id")
    return metrics.classification_metrics(rows, ("fscore", "true_positive"), prefix="train_").select(F.round("train_fscore", 6).alias("train_fscore"), "train_true_positive")


THREE_SQL = "CASE WHEN x0 < 0.4 THEN 1 WHEN x0 > 0.8 THEN 0 ELSE 0.5 END"


@query(SQL + f", t AS (SELECT {THREE_SQL} AS p FROM pool) SELECT round(count(*) FILTER (WHERE p = 1) / count(*) FILTER (WHERE p > 0), 6) AS tsm FROM t")
def three_set_metric(spark, d):
    x = F.col("x")[0]
    return metrics.three_set_metric(pool(spark, d).select(F.when(x < 0.4, 1.0).when(x > 0.8, 0.0).otherwise(0.5).alias("pred"))).select(F.round("tsm", 6).alias("tsm"))


@query(SQL + "SELECT round(avg(CASE WHEN proba > 0 AND proba < 1 THEN -proba * ln(proba) - (1 - proba) * ln(1 - proba) ELSE 0 END), 6) AS entropy FROM sc")
def prediction_entropy(spark, d):
    return metrics.prediction_entropy(scored(spark, d)).select(F.round("entropy", 6).alias("entropy"))


LOG_SQL = "WITH log AS (SELECT user_id AS run, hour(ts) AS iter, event_type AS key, value, event_id AS seq FROM events) "


def _log(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.hour("ts").cast("long").alias("iter"), F.col("event_type").alias("key"), "value", F.col("event_id").alias("seq"))


@query(LOG_SQL + "SELECT run, iter, key, round(arg_max(value, seq), 6) AS overwrite, round(sum(value), 4) AS total, string_agg(round(value * 100)::BIGINT::VARCHAR, ',' ORDER BY seq, value) AS append FROM log GROUP BY 1, 2, 3")
def deduplicate_log(spark, d):
    out = metrics.deduplicate_log(_log(spark, d))
    return out.select("run", "iter", "key", F.round("overwrite", 6).alias("overwrite"), F.round("total", 4).alias("total"), F.array_join(F.transform("append", lambda v: F.round(v * 100).cast("long").cast("string")), ",").alias("append"))


@query("SELECT event_type AS learner, hour(ts) AS iter, round(avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS even, round(avg(value) FILTER (WHERE user_id % 2 = 1), 6) AS odd FROM events WHERE value >= 10 GROUP BY 1, 2")
def learning_curves(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("learner"), F.hour("ts").cast("long").alias("iter"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("key"), "value", F.when(F.col("value") >= 10, F.col("value")).alias("callback_time"))
    return metrics.learning_curves(log, ["even", "odd"]).select("learner", "iter", F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))


RUNS_SQL = "WITH log AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iter, event_type AS key, value AS fscore, event_id, 200 - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n_unlabeled FROM events) "


def _runs(spark, d) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("run"), number.cast("long").alias("iter"), F.col("event_type").alias("key"), F.col("value").alias("fscore"), "event_id").withColumn("n_unlabeled", 200 - F.col("iter"))


@query(RUNS_SQL + "SELECT run, iter, key FROM (SELECT *, max(iter) OVER (PARTITION BY run) AS m FROM log) WHERE (iter - 1) % 5 = 0 OR iter = m")
def callback_thinning(spark, d):
    return metrics.thin(_runs(spark, d), 5).select("run", "iter", "key")


@query(RUNS_SQL + "SELECT run, iter, stop_iter FROM (SELECT *, min(CASE WHEN iter > 30 OR fscore >= 97 OR n_unlabeled = 0 THEN iter END) OVER (PARTITION BY run) AS stop_iter FROM log) WHERE stop_iter IS NULL OR iter <= stop_iter")
def stop_point(spark, d):
    return metrics.stop_point(_runs(spark, d), 30, "fscore", 97.0).select("run", "iter", "stop_iter")


@query(RUNS_SQL + ", a AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY run ORDER BY iter) THEN 0 ELSE 1 END AS n FROM log), b AS (SELECT *, sum(n) OVER (PARTITION BY run ORDER BY iter) AS g FROM a) SELECT run, iter, row_number() OVER (PARTITION BY run, g ORDER BY iter) - 1 AS repeats, row_number() OVER (PARTITION BY run, g ORDER BY iter) - 1 >= 2 AS stable FROM b")
def factorization_stability(spark, d):
    return metrics.repeats_in_a_row(_runs(spark, d), "key", 2).select("run", "iter", "repeats", "stable")


@query("""WITH l AS (SELECT user_id AS run, ts, event_id, (value < 50 AND hour(ts) < 12)::INT AS y FROM events),
a AS (SELECT *, count(*) OVER w AS n, sum(y) OVER w AS p FROM l WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT run, event_id, n AS n_so_far, p::BIGINT AS positive_so_far, coalesce(lag(p > 0 AND p < n) OVER (PARTITION BY run ORDER BY ts, event_id), false) AS exploring FROM a""")
def labels_in_order(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), "ts", "event_id", ((F.col("value") < 50) & (F.hour("ts") < 12)).cast("double").alias("label"))
    return sampling.arrival(rows, "run", ["ts", "event_id"]).select("run", "event_id", "n_so_far", "positive_so_far", "exploring")


@query(SQL + "SELECT id, round(abs(proba - 0.5), 6) AS rank FROM sc WHERE id NOT IN (SELECT id FROM lab) ORDER BY abs(proba - 0.5), h, id LIMIT 20")
def select_next(spark, d):
    s = states(spark, d)
    return sampling.select_next(state.view(scored(spark, d), s, "unlabeled"), 20, seed=SEED).select("id", F.round("rank", 6).alias("rank"))


@query(SQL + "SELECT id FROM pool ORDER BY h, id LIMIT 500")
def sample_exact(spark, d):
    return sampling.sample(pool(spark, d), 500, SEED).select("id")


@query(SQL + "SELECT id FROM pool ORDER BY h, id LIMIT 500")
def sample_large(spark, d):
    p = pool(spark, d)
    return sampling.large_sample(p, 500, p.count(), SEED).select("id")


@query(SQL + "SELECT id FROM pool WHERE id NOT IN (SELECT id FROM lab) ORDER BY h, id LIMIT 50")
def random_sampler(spark, d):
    return sampling.sample(state.view(pool(spark, d), states(spark, d), "unlabeled"), 50, SEED).select("id")


@query(SQL + "(SELECT id, y AS label FROM pool WHERE y = 1 ORDER BY h, id LIMIT 5) UNION ALL (SELECT id, y FROM pool WHERE y = 0 AND greatest(p0, p1) = 0 ORDER BY h, id LIMIT 7)")
def stratified_sampler(spark, d):
    rows = pool(spark, d).select("id", F.col("y").alias("label"), "partial")
    return sampling.stratified(rows, 5, 7, SEED, in_all_subspaces=True).select("id", "label")


@query(SQL + "SELECT id, y AS label FROM pool WHERE id IN (3, 5, 8, 13, 21)")
def fixed_sampler(spark, d):
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate((3, 5, 8, 13, 21))], "id long, pos int")
    return state.lookup(pool(spark, d), wanted).select("id", F.col("y").alias("label"))


@query(SQL + """, a AS (SELECT id, round(abs(proba - 0.5), 9) AS rank, h, CASE WHEN x0 < 0.4 THEN 1 WHEN x0 > 0.8 THEN 0 ELSE 0.5 END AS p, id NOT IN (SELECT id FROM inf) AS unknown FROM sc WHERE id NOT IN (SELECT id FROM lab)),
coins AS (SELECT count(*) FILTER (WHERE ('0x' || substr(md5('7:pick:' || i), 1, 8))::BIGINT / 4294967296 < 0.5) AS own FROM range(1, 21) r(i)),
u AS (SELECT *, row_number() OVER (ORDER BY rank, h, id) AS k, count(*) FILTER (WHERE p = 0.5) OVER (ORDER BY rank, h, id) AS opened FROM a WHERE unknown),
first_part AS (SELECT id, p, k FROM u WHERE opened < (SELECT own FROM coins) OR (opened = (SELECT own FROM coins) AND p = 0.5)),
v AS (SELECT *, count(*) FILTER (WHERE p = 0.5) OVER (ORDER BY rank, h, id) AS opened FROM a WHERE id NOT IN (SELECT id FROM first_part)),
second_part AS (SELECT id, p FROM v WHERE opened < 20 - (SELECT own FROM coins) OR (opened = 20 - (SELECT own FROM coins) AND p = 0.5))
SELECT id, p::DOUBLE AS label, p = 0.5 AS asked FROM (SELECT id, p FROM first_part UNION ALL FROM second_part)""")
def dual_space_selection(spark, d):
    """Twenty rows to ask, by coin from the unknown rows or from all; what the polytope decides on the way goes to the cache."""
    x = F.col("x")[0]
    rows = state.with_state(scored(spark, d), states(spark, d)).filter("state <> 'labeled'").withColumn("rank", F.round("rank", 9)).withColumn("polytope", F.when(x < 0.4, 1.0).when(x > 0.8, 0.0).otherwise(0.5))
    ask, cache = sampling.dual_space_draw(rows, 20, SEED, 0.5)
    return ask.select("id", F.lit(0.5).alias("label"), F.lit(True).alias("asked")).unionByName(cache.select("id", "label", F.lit(False).alias("asked")))


@query(SQL + "SELECT id, 'unknown' AS state FROM pool")
def reset_state(spark, d):
    return state.with_state(pool(spark, d), states(spark, d).limit(0)).orderBy("id").select("id", "state")


@query(SQL + """, f AS (SELECT *, ('0x' || substr(md5('7:' || id), 1, 8))::BIGINT / 4294967296 < 0.2 AS flip, floor(('0x' || substr(md5('8:' || id), 1, 8))::BIGINT / 4294967296 * 2) AS k FROM pool)
SELECT id, CASE WHEN flip THEN 1 - y ELSE y END AS label, CASE WHEN NOT flip THEN p0 WHEN y = 0 THEN 1 WHEN k = 0 THEN 0 ELSE p0 END::DOUBLE AS p0, CASE WHEN NOT flip THEN p1 WHEN y = 0 THEN 1 WHEN k = 1 THEN 0 ELSE p1 END::DOUBLE AS p1 FROM f""")
def label_noise(spark, d):
    rows = pool(spark, d).select("id", F.lit(0).alias("pos"), F.col("y").alias("label"), "partial")
    return sampling.flip_labels(rows, 0.2, SEED).select("id", "label", F.col("partial")[0].alias("p0"), F.col("partial")[1].alias("p1"))


@query(SQL + """, bg AS (SELECT id FROM pool WHERE id NOT IN (SELECT id FROM lab) ORDER BY h, id LIMIT 200), s AS (SELECT 'positive' AS side, 1::DOUBLE AS v UNION ALL SELECT 'negative', 0)
SELECT side, id, y AS label, 1::DOUBLE AS weight FROM lab, s UNION ALL SELECT side, id, v, 0.00001::DOUBLE FROM bg, s""")
def biased_sets(spark, d):
    p = pool(spark, d)
    own = p.join(labels(spark, d).select("id", "label"), "id").select("id", "x", "label")
    return sampling.biased_sets(own, p, 200, 1e-5, SEED).select("side", "id", "label", "weight")


@query(SQL + "SELECT s.id, round(s.proba, 6) AS proba FROM sc s LEFT JOIN lab l USING (id) WHERE coalesce(l.y, (s.proba > 0.5)::INT) = 1")
def final_retrieval(spark, d):
    return explore.retrieve(scored(spark, d), labels(spark, d)).select("id", F.round("proba", 6).alias("proba"))
