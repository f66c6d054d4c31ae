"""Rows that a filter, an estimate or a bound once lost."""

import math
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontam, licences, quality


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licences.scan(docs, licences.known_licences(spark)).collect()}


def test_notices_with_other_spacing_or_hyphens(spark):
    notice = "This is free and unencumbered software released into the public domain."
    odd = [notice, notice.replace("public domain", "public  domain"), notice.replace("public domain", "public-domain"), notice.replace(" ", "\t"), notice.upper()]
    whole = scan(spark, odd)
    assert all(r.n_notices == 1 and r.licence == "Unlicense notice" for r in whole.values())
    lines = scan(spark, [f"A page about birds.\n  {t}  \nThe end of the page." for t in odd])
    assert all(r.n_notices == 1 and r.notices == "Unlicense notice" and r.licence is None for r in lines.values())


@pytest.mark.parametrize("line", ["Copyright Jane Doe", "Copyright, Jane Doe, 2020", "Copyright: the Birds", "(c) 2020 Jane Doe", "Copyright (c) Jane Doe", "Copyright by Jane Doe", "  * Copyright   Jane Doe and others", "COPYRIGHT 1999"])
def test_copyright_lines_with_and_without_a_year(spark, line):
    mit = licences.KNOWN["MIT"]
    assert scan(spark, [f"{line}\n\n{mit}"])[0].licence == "MIT"


def test_wrapped_lines_of_licences_are_no_copyright_lines(spark):
    for name in ("MIT", "BSD-3-Clause", "ISC", "Zlib"):
        text = licences.KNOWN[name]
        for word in ("copyright notice", "copyright holder", "COPYRIGHT HOLDERS", "copyright owner"):
            text = text.replace(f" {word}", f"\n{word}")
        assert scan(spark, [text])[0].licence == name
    known = licences.known_licences(spark).select(F.col("text"), F.explode(F.split("text", "\n")).alias("line"))
    dropped = known.filter(F.lower("line").contains("copyright") & ~licences.canonical(F.col("line")).contains("copyright"))
    assert [r.line for r in dropped.collect() if not r.line.strip().lower().startswith(("copyright (c)", "copyright ©", "copyright 2", "copyright 1"))] == []


def test_cues_are_pieces_of_one_word(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="pieces of one word"):
        licences.scan(docs, licences.known_licences(spark), cues=("public domain",))


def items_and_docs(common, own, n_items, n_docs, seed=0):
    """Items of one common phrase and words of their own; documents with the phrase only."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    phrase = [word() for _ in range(common)]
    items = [(k, " ".join(phrase + [word() for _ in range(own)])) for k in range(n_items)]
    docs = [(k, " ".join([word() for _ in range(30)] + phrase + [word() for _ in range(30)])) for k in range(n_docs)]
    docs += [(10_000 + k, " ".join([word(), text, word()])) for k, text in items[:50]]
    return items, docs


@pytest.mark.parametrize("own", [9, 60, 400])
def test_a_phrase_that_many_items_share_pairs_no_documents_with_all_of_them(spark, own):
    items, docs = items_and_docs(11, own, 200, 100)
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc, r.item) for r in decontam.contained(d, i).collect()}
    assert found == {(10_000 + k, k) for k in range(50)}
    known = i.select(F.col("item_id").alias("item"), decontam.words(F.col("text")).alias("w")).select("item", decontam.shingles(F.col("w")).alias("shingles")).withColumn("n_shingles", F.size("shingles"))
    kept = decontam._signatures(known).groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert own > 60 or kept <= 200 // 2  # shared minima are left out where the signature allows it
    lookups = decontam._signatures(known)
    assert lookups.filter("need < 1").count() == 0


def test_items_of_many_copies_and_shares_at_the_threshold(spark):
    rng = random.Random(1)
    items, docs, want = [], [], set()
    for k in range(120):
        n = rng.choice([5, 9, 14, 20, 40, 90, 300])
        w = [f"i{k % 40}w{j}" for j in range(n)]  # forty items, three times each
        items.append((k, " ".join(w)))
    texts = {k: t.split() for k, t in items}
    for k in range(40):
        for cut in (0.7, 0.79, 0.8, 0.81, 0.95):
            w = list(texts[k])
            keep = max(5, math.ceil((len(w) - 4) * cut) + 4)
            docs.append((len(docs), " ".join(["x", *w[:keep], "y"])))
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for doc, text in docs:
        own = sets(text.split())
        want |= {(doc, k) for k, w in texts.items() if 5 * len(sets(w) & own) >= 4 * len(sets(w))}
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc, r.item) for r in decontam.contained(d, i).collect()} == want


def test_the_cut_is_the_exact_tail():
    for n in (20, 24, 32):
        cut = decontam.least_hits(n)
        tail = lambda k: sum(math.comb(n, j) * 0.8**j * 0.2 ** (n - j) for j in range(k))
        assert tail(cut) <= decontam.MISSED < tail(cut + 1)
    assert all(a < b for a, b in pairwise(map(decontam.least_hits, (20, 24, 32))))


def test_one_text_larger_than_the_sample_leaves_the_others_in_it(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["good", "fine", "calm"] if k % 2 else ["bad", "junk", "spam"], k=40))) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    least = spark.range(300).filter(~quality.held_out("id")).orderBy(F.md5(F.col("id").cast("string").cast("binary"))).first().id
    huge = [(k, t * 2000 if k == least else t) for k, t in rows]
    model = quality.fit(spark.createDataFrame(huge, "doc_id long, text string"), labels, most_bytes=60_000)
    scores = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert min(s for k, s in scores.items() if k % 2) > 0.5 > max(s for k, s in scores.items() if k % 2 == 0)


def test_a_class_of_large_texts_only_is_learnt_from_its_shortest(spark):
    rows = [(k, ("good calm " * 20) if k % 2 else ("spam junk " * (3000 + k))) for k in range(100)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, most_bytes=5000)).collect()}
    assert scores[1] > scores[0] + 0.2
    with pytest.raises(ValueError):
        quality.with_score(docs.withColumn("Score", F.lit(1)), quality.fit(docs, labels, most_bytes=5000))
