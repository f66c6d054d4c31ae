"""Samples and picks. Randomness is a hash order (functions.hashing), so results don't depend on
partitioning; sizes are exact. A sample is a top-k by hash: partial top-k per partition, one small merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest, uniform


def sample(rows: DataFrame, size: int | None, seed: int) -> DataFrame:
    """size rows without replacement; None: all."""
    return rows if size is None else rows.orderBy(digest(seed, "id"), "id").limit(size)


def large_sample(rows: DataFrame, size: int, total: int, seed: int) -> DataFrame:
    """The same rows as sample(): first those whose hash is small enough (five standard deviations more
    than needed), so that the top-k holds little more than size rows."""
    share = (size + 5 * size**0.5 + 20) / max(total, 1)
    return sample(rows if share >= 1 else rows.filter(uniform(seed, "id") < share), size, seed)


def select_next(ranked: DataFrame, k: int = 1, subsample: int | None = None, seed: int = 0) -> DataFrame:
    """The k rows of least rank (of a sample), ties in hash order."""
    return sample(ranked, subsample, seed).orderBy("rank", digest(seed, "id"), "id").limit(k)


def stratified(rows: DataFrame, pos: int, neg: int, seed: int, in_all_subspaces: bool = False, check: bool = True) -> DataFrame:
    """pos positive and neg negative rows of (id, label, partial); in_all_subspaces: negatives must be
    negative in every subspace. One top-k for each class, never a full sort of a class."""
    positive, negative = rows.filter("label = 1"), rows.filter("label = 0")
    if in_all_subspaces:
        negative = negative.filter(F.array_max("partial") == 0)
    out = sample(positive, pos, seed).unionByName(sample(negative, neg, seed))
    if check:
        got = {r.label: r.n for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if got.get(1.0, 0) < pos or got.get(0.0, 0) < neg:
            raise ValueError(f"too few rows: wanted {pos} and {neg}, found {got}")
    return out


def dual_space_draw(scored: DataFrame, n: int, seed: int, unknown_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(to ask, to cache) of unlabelled rows (id, state, rank, polytope), in the order of rank. For each of the n rows to ask a coin says whether
    it comes from the unknown rows only or from all that are left. A row drawn on the way that the polytope decides isn't asked: it goes to the
    cache with the polytope's label, and its place is drawn again from the same ranking. Two top-k and a pass; how far the draws of a
    ranking got is one row."""
    place = F.struct(F.col("rank"), digest(seed, "id").alias("h"), F.col("id"))
    placed = scored.withColumn("_place", place)
    coins = scored.sparkSession.range(1, n + 1).select((uniform(seed, F.lit("pick"), F.col("id")) < unknown_share).cast("int").alias("own"))
    own = coins.agg(F.sum("own")).first()[0] or 0  # a number that depends on n, share and seed only

    def drawn(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(open rows, decided rows passed, how far)."""
        ask = rows.filter("polytope = 0.5").orderBy("_place").limit(most)
        far = ask.agg(F.max("_place").alias("_last"), F.count(F.lit(1)).alias("_found"))  # one row
        passed = rows.filter("polytope <> 0.5").crossJoin(F.broadcast(far)).filter((F.lit(most) > 0) & ((F.col("_found") < most) | (F.col("_place") < F.col("_last")))).drop("_last", "_found")
        return ask, passed, far

    ask, passed, far = drawn(placed.filter("state = 'unknown'"), own) if own else (placed.limit(0), placed.limit(0), None)
    rest = placed
    if own:
        gone = (F.col("state") == "unknown") & ((F.col("_found") < own) | (F.col("_place") <= F.col("_last")))
        rest = placed.crossJoin(F.broadcast(far)).filter(~gone).drop("_last", "_found")
    more, passed_more, _ = drawn(rest, n - own)
    return ask.unionByName(more).drop("_place"), passed.unionByName(passed_more).select("id", F.col("polytope").alias("label"))


def flip_labels(labels: DataFrame, noise: float, seed: int, skip_initial: int = 0) -> DataFrame:
    """Each label from position skip_initial on is flipped with the given chance: 0 to 1 sets all partial
    labels to 1, 1 to 0 sets one, chosen by hash, to 0. labels: id, pos, label, partial."""
    flip = (F.col("pos") >= skip_initial) & (uniform(seed, "id") < noise)
    chosen = F.floor(uniform(seed + 1, "id") * F.size("partial")).cast("int")
    partial = F.when(~flip, F.col("partial")).when(F.col("label") == 0, F.transform("partial", lambda v: F.lit(1.0))).otherwise(F.transform("partial", lambda v, i: F.when(i == chosen, 0.0).otherwise(v)))
    return labels.select("id", "pos", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), partial.alias("partial"))


def biased_sets(labelled: DataFrame, pool: DataFrame, size: int, weight: float, seed: int) -> DataFrame:
    """(side, id, x, label, weight): the labelled rows and a background sample, all positive on one side,
    all negative on the other. labelled: id, x, label."""
    own = labelled.select("id", "x", "label", F.lit(1.0).alias("weight"))
    background = sample(pool.join(labelled.select("id"), "id", "left_anti"), size, seed).select("id", "x")
    both = [own.unionByName(background.withColumn("label", F.lit(v)).withColumn("weight", F.lit(weight))).withColumn("side", F.lit(side)) for side, v in (("positive", 1.0), ("negative", 0.0))]
    return both[0].unionByName(both[1]).select("side", "id", "x", "label", "weight")


def arrival(labels: DataFrame, by: Column | str, order: list[str]) -> DataFrame:
    """Labels in order of arrival within a run: n_so_far, positive_so_far, and exploring, true from the first
    row after both labels are there."""
    w = Window.partitionBy(by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, pos = F.count(F.lit(1)).over(upto), F.sum("label").over(upto)
    both = labels.withColumn("n_so_far", n).withColumn("positive_so_far", pos.cast("long"))
    has = (F.col("positive_so_far") > 0) & (F.col("positive_so_far") < F.col("n_so_far"))
    return both.withColumn("exploring", F.coalesce(F.lag(has).over(w), F.lit(False)))
