"""Runs of repeated words against trying every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gleaner.llm import queries, runs
from gleaner.llm.shared import WORDS


def plain(words):
    """(start, length, period) of every run."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)  # periods ascend, so the first is the smallest
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def sequences(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        out = []
        while len(out) < rng.randint(1, 160):
            kind = rng.random()
            if kind < 0.5:
                unit = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
                out += (unit * 12)[: rng.randint(1, 8 * len(unit))]
            else:
                out += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        yield out


def test_every_run_is_found():
    for words in sequences(4000, 1):
        assert runs.runs_of(words) == plain(words), words


def test_words_appended_one_by_one_or_in_steps_give_the_same():
    rng = random.Random(3)
    for words in sequences(400, 2):
        ids = np.array([ord(w) for w in words])
        one, some = runs.Catcher(), runs.Catcher()
        for k in range(len(ids)):
            one.append(ids[k : k + 1])
            if k % 37 == 0:
                assert one.runs() == plain(words[: k + 1])
        at = 0
        while at < len(ids):
            step = rng.randint(1, 30)
            some.append(ids[at : at + step])
            at += step
        assert one.runs() == some.runs() == plain(words)


@pytest.mark.parametrize("words", [["a"] * 5000, ["a", "b"] * 3000, list("abcab") * 1000, [f"w{k % 777}" for k in range(9000)], [f"w{k}" for k in range(4000)] * 4, ["x"] * 5, [], ["a"] * 6 + ["b"] + ["a"] * 6])
def test_long_sequences(words):
    assert runs.runs_of(words) == (plain(words) if len(words) < 200 else long_plain(words))


def long_plain(words):
    """The whole sequence repeats its first words."""
    n = len(words)
    p = next(p for p in range(1, n) if words[p:] == words[: n - p])
    return [(0, n, p)]


def brute(doc, text):
    words = WORDS.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(found), *best, 1000 * best[1] // best[2] if best[2] else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_with_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(w)) for k, w in enumerate(sequences(400, 5))]
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "a\x0bb  c d"), (7, "x " * 9), (7, "x " * 9), *((2000 + k, " ".join(rng.choices("abcde", k=rng.randint(1, 60)))) for k in range(300))]
    spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, start int, _w string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0], r[1:2], r[-2:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute(*r) for r in rows), key=key)


def test_rows_without_an_id_stay_as_they_are_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a a a a a a b"), (None, None)], "doc_id long, text string")
    got = runs.periodic_runs(runs.with_periodic_tails(df)).orderBy("n_words").collect()
    assert [(r.n_words, r.collapsed) for r in got] == [(0, ""), (7, "a b")]
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 9000}
    got = [tuple(r) for r in queries.op12_runs(spark, sf).collect() if r.doc_id in rows]
    assert sorted(got, key=lambda r: r[0]) == [brute(d, rows[d]) for d in sorted(rows)]
