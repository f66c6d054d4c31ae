"""Benchmark decontamination (operator 8), with DataFrame functions only.

Which test items does a document contain? An item is its set of distinct shingles of five lower-cased
words (fewer words: the whole sequence as one). A document contains an item if at least four fifths of
the item's shingles are among the document's.

A plain MinHash banding compares sets of like size; a short item inside a long document is the case it
misses. So items are partitioned by size, and each partition has its own signature length: an item's
signature holds, under each of that many hash functions, its least shingle. A document that contains
the item has each of these minima with a chance of at least 0.8, so the number of functions whose minimum a
document has is binomial, and pairs go on to the exact check from the number on below which a contained item stays with a chance of at most
MISSED (the exact tail: 4 of 20 functions, 6 of 24, 10 of 32); items of up to 16 shingles have all of them in the signature and can't be missed
at all. Documents are hashed once into shingles and looked up among the minima; what is left is verified by exact shingle containment on strings.

A phrase that many items share would pair its documents with all of them. Minima that more than COMMON items have are therefore not
looked up, the most common ones first, as long as what is left of an item's signature must still be hit: with c hits asked for, minima of up to c - 1
functions can be left out, and the others must be hit c less these times. Nothing is lost by that.

Documents are never compared with each other and no document is replicated. The table of minima grows
with the benchmark only; Spark joins it by broadcast where its measured size is under
spark.sql.autoBroadcastJoinThreshold and by a shuffle otherwise. A shingle that every document has is
one row on the small side, and the counts by (document, item) are combined before the shuffle.

Null or empty texts have no shingles: such a document contains nothing and such an item is contained
nowhere. Texts of any length are one row of words; their shingles are hashed one by one. Ids are of any type that has an order.
Rows that share an id are one document, or one item, which contains what any of them does; each row is returned. A row
without an id is returned and contains nothing; an item without an id is left out. Empty tables give empty results, or
documents without items. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import GAP_SQL, LOWER, UPPER, settle

WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Partitions of items by number of shingles: (largest size, hash functions). 0.2 ** 16 = 7e-12.
SIZES = ((16, 16), (64, 20), (256, 24), (1 << 62, 32))
#: The chance with which a contained item may be missed; items that may share a minimum before it counts as common.
MISSED, COMMON = 1e-9, 8


def least_hits(functions: int, missed: float = MISSED) -> int:
    """The most functions so that fewer hits of a contained item have a chance of at most missed; a function hits with a chance of NUMERATOR /
    DENOMINATOR or more."""
    p, below = NUMERATOR / DENOMINATOR, 0.0
    for k in range(functions + 1):
        below += math.comb(functions, k) * p**k * (1 - p) ** (functions - k)
        if below > missed:
            return k
    return functions


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null or blank text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP_SQL), lambda w: w != "")


def shingles(w: Column, width: int = WIDTH) -> Column:
    """Distinct strings of width words joined by spaces; fewer words give one string of all. w must be a
    column that is there already: an expression would be evaluated anew for every shingle."""
    whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    # get() takes one element; slice() would copy the document's array for every shingle.
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(width))))
    return F.array_distinct(F.when(F.size(w) >= width, runs).otherwise(whole))


def _signatures(items: DataFrame) -> DataFrame:
    """(item, variant, h, weight, need): the minima of an item that are looked up, by how many functions each is chosen, and how many functions must hit."""
    functions, cut = F.lit(SIZES[-1][1]), F.lit(least_hits(SIZES[-1][1]))
    for most, n in reversed(SIZES[1:-1]):
        functions, cut = F.when(F.col("n_shingles") <= most, n).otherwise(functions), F.when(F.col("n_shingles") <= most, least_hits(n)).otherwise(cut)
    whole = F.col("n_shingles") <= SIZES[0][0]
    cut = F.when(whole, F.ceil(F.col("n_shingles") * NUMERATOR / DENOMINATOR)).otherwise(cut)
    least = F.transform(F.sequence(F.lit(1), functions), lambda k: F.array_min(F.transform("shingles", lambda s: F.struct(F.xxhash64(k, s).alias("h"), s.alias("s"))))["s"])
    each = items.select("item", F.xxhash64("shingles").alias("variant"), cut.alias("cut"), F.explode(F.when(whole, F.col("shingles")).otherwise(least)).alias("minimum"))
    minima = each.groupBy("item", "variant", "cut", "minimum").agg(F.count(F.lit(1)).alias("weight")).withColumn("h", _hashed(F.split("minimum", " "), F.lit(0)))
    shared = minima.groupBy("h").agg(F.count_distinct("item").alias("items"))
    ranked = minima.join(shared, "h").withColumn("upto", F.sum("weight").over(Window.partitionBy("item", "variant").orderBy(F.desc("items"), "h", "minimum").rowsBetween(Window.unboundedPreceding, 0)))
    left_out = (F.col("items") > COMMON) & (F.col("upto") < F.col("cut"))  # the most common come first, so these are the first ones
    skipped = F.sum(F.when(left_out, F.col("weight")).otherwise(0)).over(Window.partitionBy("item", "variant"))
    return ranked.withColumn("need", F.col("cut") - skipped).filter(~left_out).select("item", "variant", "h", "weight", "need")


def _hashed(w: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH)))  # of the words, so no strings are made


def contained(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, n_found, n_shingles) for every document that contains an item."""
    known = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("w")).select("item", shingles(F.col("w")).alias("shingles")).withColumn("n_shingles", F.size("shingles")).filter("n_shingles > 0 and item is not null")
    minima = _signatures(known)
    split = docs.select(F.col(doc_id).alias("doc"), words(F.col(doc_text)).alias("w")).filter("doc is not null")
    # explode() would infer a filter on the array and evaluate it twice, with the words inlined.
    hashes = split.select("doc", F.explode_outer(_shingle_hashes(F.col("w"))).alias("h"))
    # Each minimum counts once for a document, however often the document repeats it.
    hits = hashes.join(minima, "h").groupBy("doc", "item", "variant", "need", "h").agg(F.max("weight").alias("weight"))
    likely = hits.groupBy("doc", "item", "variant", "need").agg(F.sum("weight").alias("hits")).filter("hits >= need").select("doc", "item").distinct()
    pairs = settle(likely, "op8-pairs")
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("t")).join(pairs.select("doc").distinct(), "doc", "left_semi")
    own = texts.select("doc", words(F.col("t")).alias("w")).select("doc", shingles(F.col("w")).alias("own"))
    exact = pairs.join(known, "item").join(own, "doc").select("doc", "item", "n_shingles", F.size(F.array_intersect("shingles", "own")).alias("n_found"))
    return exact.filter(F.col("n_found") * DENOMINATOR >= F.col("n_shingles") * NUMERATOR).distinct()


def _shingle_hashes(w: Column) -> Column:
    return F.when(F.size(w) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: _hashed(w, i))).when(F.size(w) > 0, F.array(_hashed(w, F.lit(0))))


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc, n_items contained, the item with the largest share (least id on a
    tie), that share, and contaminated (n_items > 0)."""
    hits = contained(docs, items, doc_id=doc_id, doc_text=doc_text, item_id=item_id, item_text=item_text)
    share = F.round(F.col("n_found") / F.col("n_shingles"), 6)
    best = F.min_by("item", F.struct((-share).alias("share"), "item"))
    by_doc = hits.groupBy("doc").agg(F.count_distinct("item").alias("n_items"), best.alias("best_item"), F.max(share).alias("containment"))
    return docs.select(F.col(doc_id).alias("doc")).join(by_doc, "doc", "left").select(
        F.col("doc").alias(doc_id), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("best_item"), F.coalesce("containment", F.lit(0.0)).alias("containment"), F.col("n_items").isNotNull().alias("contaminated")
    )
