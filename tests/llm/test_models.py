"""Licences, language models, revisits, quality and the registered queries."""

import math
import os
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import licences, lmscore, quality, warc

DATA = "/root/testdata/sf0.001"


def test_licences(spark):
    mit = licences.KNOWN["MIT"]
    docs = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit), (2, mit.upper().replace("license", "licence")), (3, mit + " more"), (4, None), (5, ""), (6, "Text.\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0."),
        (7, "nothing"), (7, "nothing"), (8, "MIT License\n\nReleased under the MIT License."), (8, "MIT License\n\nReleased under the MIT License."), (None, "x\nReleased under the MIT License."), (9, "MIT notice " * 50_000 + "\nReleased under the MIT License.\nReleased under the MIT License."),
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, licence string")
    got = {r.doc_id: (r.licence, r.n_notices, r.notices) for r in licences.scan(df, licences.known_licences(spark)).collect()}
    assert got == {
        1: ("MIT", 0, ""), 2: ("MIT", 0, ""), 3: (None, 0, ""), 4: (None, 0, ""), 5: (None, 0, ""), 6: (None, 2, "CC-BY-NC-4.0 notice; MIT notice"), 7: (None, 0, ""),
        8: (None, 1, "MIT notice"), None: (None, 1, "MIT notice"), 9: (None, 2, "MIT notice"),
    }
    assert licences.scan(df.limit(0), licences.known_licences(spark)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(df, licences.known_licences(spark, {"other": "no cue here"}))


def test_licence_variants(spark):
    """Every known text is found wrapped anew, with another holder, other bullets, spellings and punctuation."""
    import textwrap

    changes = (
        lambda t: t, lambda t: "Copyright 2019-2024 A. Body. All rights reserved.\n\n" + t, lambda t: t.replace('"', "''").replace("copyright holder", "copyright owner"), lambda t: t.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("sublicense", "sub-license"),
        lambda t: t.replace("\n1. ", "\n * ").replace("\n2. ", "\n * ").replace("\n3. ", "\n * "), lambda t: t.replace("http://", "https://"), lambda t: "\n\n".join(textwrap.fill(p, 60) if len(p) > 400 and "\n" not in p else p for p in t.split("\n\n")), lambda t: t.replace("acknowledgment", "acknowledgement"),
    )
    rows = [(name, change(text)) for name, text in licences.KNOWN.items() for change in changes]
    got = licences.scan(spark.createDataFrame(rows, "doc_id string, text string"), licences.known_licences(spark)).collect()
    assert len(got) == len(rows) and all(r.licence == r.doc_id for r in got), {r.doc_id for r in got if r.licence != r.doc_id}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense"} <= set(licences.KNOWN)


def test_lm_scores_against_plain_counting(spark):
    texts = ["a b a b c", "c c d", None, "", "a b a b e f", "x y z x y", "A B"]
    wanted = {0, 4}
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame([(0,), (4,), (4,), (None,), (77,)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.score(docs, marks).collect()}
    words = [(t or "").lower().split() for t in texts]
    single, pair, context = ([Counter(), Counter()] for _ in range(3))
    for i, w in enumerate(words):
        for m in (0, 1):
            if m or i in wanted:
                single[m].update(w)
                pair[m].update(zip(["<s>", *w], w))
                context[m].update(["<s>"] * bool(w) + w)  # a word counts as context also at the end of a text
    scale = sum(single[0].values()) / sum(single[1].values())
    for i, w in enumerate(words):
        loss = [0.0, 0.0]
        for m in (0, 1):
            s = scale if m else 1.0
            n = sum(single[m].values()) * s
            for a, b in zip(["<s>", *w], w):
                p1 = (single[m][b] * s + lmscore.FLOOR) / (n + lmscore.FLOOR * lmscore.LEAST_WORDS)
                loss[m] -= math.log((pair[m][a, b] * s + lmscore.PRIOR * p1) / (context[m][a] * s + lmscore.PRIOR)) / len(w)
        assert got[i].n_words == len(w) and abs(got[i].score - (loss[0] - loss[1])) < 1e-4
    assert lmscore.score(docs.limit(0), marks).count() == 0
    assert {r.doc_id: r.score for r in lmscore.score(docs.filter("doc_id < 5"), marks, more=docs.filter("doc_id >= 5")).collect()}.keys() == got.keys()


def test_lm_prefers_wanted_texts(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scores = lmscore.score(docs, labels.filter("quality = 1").select("doc_id"))
    mean = {r.quality: r.m for r in scores.join(labels, "doc_id").groupBy("quality").agg({"score": "avg"}).withColumnRenamed("avg(score)", "m").collect()}
    assert mean[1] < mean[0]


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?b=2&a=1&utm_source=x#top", "https://example.com/a?a=1&b=2", " HTTPS://user:pw@www2.example.com:443/a//?a=1&&b=2&fbclid=z "]
    got = {r.u for r in spark.createDataFrame([(u,) for u in same], "url string").select(warc.canonical_url(warc.F.col("url")).alias("u")).collect()}
    assert got == {"example.com/a?a=1&b=2"}
    assert spark.createDataFrame([("http://a.org",)], "url string").select(warc.canonical_url(warc.F.col("url"))).first()[0] == "a.org/"


def test_urls_of_one_form(spark):
    forms = {
        "a.org/~x/b?q=a-b%2F": ["http://a.org/%7Ex/b?q=a%2Db%2f", "http://A.ORG./%7ex/./b?q=a-b%2F", "a.org/c/../~x/b/?q=a-b%2F"], "a.org/": ["http://a.org", "a.org/..", "http://a.org/./", "http://www.a.org.:80/b/.."],
        "a.org/x%zz%": ["a.org/x%zz%"], "a.org/x?ref=v1": ["http://a.org/x?ref=v1"], "a.org/x?ref=v2": ["http://a.org/x?ref=v2"], "a.org/%C3%A9": ["a.org/%c3%a9"], "a.org/.b/..c/d.": ["a.org/.b/..c/d."], None: ["", "   ", None],
    }
    rows = [(u, form) for form, urls in forms.items() for u in urls]
    got = spark.createDataFrame(rows, "url string, form string").select("url", "form", warc.canonical_url(warc.F.col("url")).alias("u")).collect()
    assert [(r.url, r.u) for r in got] == [(r.url, r.form) for r in got]


def test_only_full_responses_answer_and_repeated_records_answer_alike(spark):
    rows = [(1, "a.org", 1, "response", "e", 200), (2, "a.org", 2, "response", "p", 206), (3, "a.org", 3, "response", "x", 404), (4, "a.org", 4, "revisit", "e", 304), (5, "a.org", 5, "response", "n", None), (6, "a.org", 6, "revisit", "n", 304), (7, "", 6, "revisit", "n", 304), (8, " ", 1, "response", "n", 200)]
    rows = [(*r[:5], None, None, None, r[5]) for r in rows for _ in range(3)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>, status int").repartition(5)
    got = sorted((r.record_id, r.outcome, r.response_id) for r in warc.resolve(df, chunk=1, group=2).collect())
    assert got == [(4, "resolved", 1)] * 3 + [(6, "resolved", 5)] * 3 + [(7, "no url or time", None)] * 3


@pytest.mark.parametrize("group", [1, 2, 4096])
def test_a_hot_url_over_many_chunks(spark, group):
    rng = np.random.default_rng(1)
    rows = [(k, "hot.org" if k % 3 else f"u{k % 50}.org", int(rng.integers(0, 3000)), "response" if rng.random() < 0.3 else "revisit", str(rng.integers(0, 2)), None, None, None) for k in range(3000)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>").repartition(5)
    got = {r.record_id: (r.outcome, r.response_id) for r in warc.resolve(df, chunk=7, group=group).collect()}
    last = {}
    for i, u, at, kind, tag, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "response":
            last[u] = (i, tag)
        else:
            found = last.get(u)
            assert got[i] == (("no earlier response", None) if found is None else ("resolved", found[0]) if found[1] == tag else ("validator differs", None))


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_revisits(spark, chunk):
    h = {"Content-Type": "text/html", "Date": "d1", "ETag": "e", "X": "1"}
    rows = [
        (1, "http://a.org/", 1, "response", '"e1"', None, "d1", h), (2, "https://www.a.org", 9, "revisit", 'W/"e1"', None, None, {"date": "d2", "x": "2", "Vary": "v"}),
        (3, "http://a.org/", 10, "response", '"e2"', None, "d2", None), (4, "http://a.org/", 10, "revisit", '"e2"', None, None, None), (5, "http://a.org/", 11, "revisit", '"e1"', None, None, None),
        (6, "http://b.org/", 5, "revisit", '"e1"', None, None, None), (7, "http://b.org/", 6, "response", None, "m1", "d3", h), (8, "http://b.org/", 50, "revisit", None, "m1", "d3", None), (9, "http://b.org/", 51, "revisit", None, "m1", "other", None),
        (10, "http://b.org/", 52, "revisit", None, None, None, None), (11, None, 5, "revisit", "e", None, None, None), (12, "http://b.org/", None, "revisit", "e", None, None, None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>, found string").repartition(4)
    got = {r.record_id: r for r in warc.resolve(df, chunk=chunk).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {
        2: ("resolved", 1), 4: ("resolved", 3), 5: ("validator differs", None), 6: ("no earlier response", None), 8: ("resolved", 7), 9: ("digest differs", None), 10: ("no validator", None), 11: ("no url or time", None), 12: ("no url or time", None),
    }
    assert got[2].headers == {"Content-Type": "text/html", "ETag": "e", "X": "1", "date": "d2", "Vary": "v"} and got[4].headers == {}
    assert warc.resolve(df.limit(0), chunk=chunk).count() == 0


def test_quality_gradients():
    """Slopes against differences of the loss."""
    rng = np.random.default_rng(0)
    x = quality.joined([quality.sparse(quality.passages(t)) for t in ("one two three " * 40, "x", "", "#$ 12 Three, four. " * 30)])
    x.looks = rng.normal(size=x.looks.shape)
    y, width = np.array([1.0, 0.0, 1.0, 0.0]), quality.FEATURES + quality.VECTOR
    h, g, b = quality.HIDDEN, quality.GATES, quality.BUCKETS
    w = {"vectors": rng.normal(size=(b, quality.VECTOR)), "encode": rng.normal(size=(width, h)) / 5, "encode_bias": rng.normal(size=h), "v": rng.normal(size=(h, g)), "u": rng.normal(size=(h, g)), "a": rng.normal(size=g), "out": rng.normal(size=h), "out_bias": rng.normal(size=1)}
    _, slopes = quality.loss_and_slopes(w, x, y)
    for name, value in w.items():
        rows = np.unique(x.feature)[:4] if name == "vectors" else range(min(3, len(value)))
        for k in rows:
            at = (k,) if value.ndim == 1 else (k, value.shape[1] // 2)
            change = []
            for step in (1e-5, -1e-5):
                moved = {n: v.copy() for n, v in w.items()}
                moved[name][at] += step
                change.append(quality.loss_and_slopes(moved, x, y)[0])
            assert abs((change[0] - change[1]) / 2e-5 - slopes[name][at]) < 1e-6, (name, at)


def test_quality_learns_words_and_streams():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 200).tolist() + ["secret"] * int(k % 2)) for k in range(200)]
    y = np.array([float(k % 2) for k in range(200)])
    m = quality.train([quality.sparse(quality.passages(t)) for t in texts], y, epochs=60)  # one word of one passage tells
    s = np.array([m.score(quality.passages(t)) for t in texts])
    assert ((s > 0.5) == y).mean() > 0.95
    assert abs(m.score(quality.passages(texts[1])) - m.score(quality.passages(texts[1]), block=2)) < 1e-9
    assert quality.train([quality.sparse(quality.passages(t)) for t in texts], np.ones(200)).score(quality.passages("x")) > 0.99
    assert quality.train([], np.zeros(0)).score(quality.passages("")) == 0.5


def test_quality_held_out(spark):
    sf = DATA.replace("0.001", "0.01")
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    r = scored.filter("held_out").join(labels, "doc_id").selectExpr("avg(cast(predicted = quality as double)) a", "count(*) n").first()
    assert r.n > 40 and r.a >= 0.95
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 1.0), (None, "word " * 5000, 0.0)], "doc_id long, text string, quality double")
    got = quality.score(odd, quality.fit(docs, labels)).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def _tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_queries_against_sql(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    from gleaner.llm import queries

    con = _tables()
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted(tuple(repr(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
        assert sorted(tuple(repr(r[c]) for c in sorted(names)) for r in df.collect()) == want, name


def test_revisits_read_their_records_few_times(spark):
    """One join for what chunks start with, one for groups of chunks."""
    pages = spark.createDataFrame([(k, f"http://a.com/{k % 3}", f"t{k}") for k in range(9)], "page_id long, url string, html string")
    plan = warc.resolve(warc.captures(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") + plan.count("Join LeftOuter") == 2
