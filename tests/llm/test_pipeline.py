"""The pipeline against plain Python, on a small corpus with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from gleaner.llm import quality  # noqa: E402
from gleaner.llm.shared import WORDS, lowered  # noqa: E402

SCHEMA = "doc_id long, text string, n_chars long, score double, quality_score string, n_words int, n_removed int, kept boolean, doc long, rest string, `a.b` int"


def _rows(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(600)]

    def prose(n):
        return " ".join(w.capitalize() if k % 11 == 0 else w + "." * (k % 11 == 10) for k, w in enumerate(rng.choices(vocab, k=n)))

    items = [prose(n) for n in (6, 12, 30, 70)] + ["too short", "", None]
    texts = [prose(rng.randint(5, 160)) for _ in range(90)]
    passage = prose(45)
    for k in range(30):  # near copies of several degrees
        w = rng.choice(texts[:60]).split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append((" " if k % 2 else "\n").join(w))
    for k in range(12):  # a shared passage
        w = texts[k * 5].split()
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join([*w[:at], passage, *w[at:], prose(60)]))
    for k in range(9):  # leaks
        leak = items[k % 4].split()
        if k > 4:
            leak[-1] = "other"
        texts.append(prose(50) + " " + " ".join(leak).upper() + " " + prose(50))
    texts += ["#$% @@ " * rng.randint(5, 60) for _ in range(25)] + [passage, passage + " " + passage, None, "", "   ", "one two", "One  two", "z " * 4000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    rows += [rows[3], rows[10], (None, texts[0]), (None, None)]
    labels = [(i, 0 if "#$%" in (t or "") else 1) for i, t in rows if i is not None and i % 3]
    return rows, labels, items


def _shingles(text):
    w = WORDS.findall(lowered(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _plain_score(model, text):
    """One bag at a time, as the formula stands."""
    bag = quality.passages(text)
    vectors = [np.mean([model.weights["vectors"][k].mean(axis=0) for k in bag.features[a : a + n]], axis=0) if len(bag.features) else np.zeros(quality.VECTOR) for a, n in zip(bag.starts, bag.sizes)]
    w, hidden, weights = model.weights, [], []
    for looks, vector in zip(bag.looks, vectors):
        h = np.tanh(np.concatenate([(looks - model.mean) / model.scale, vector]) @ w["encode"] + w["encode_bias"])
        hidden.append(h)
        weights.append(np.exp(np.tanh(h @ w["v"]) * (1 / (1 + np.exp(-(h @ w["u"])))) @ w["a"]))
    z = sum(a * h for a, h in zip(weights, hidden)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ w["out"] + w["out_bias"][0])))


def _near(rows):
    sets = {i: _shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [r for r in rows if r[0] is None or top(r[0]) == r[0]]


def _cut(rows, length=20):
    first, out = {}, []
    words = {i: WORDS.findall(t or "") for i, t in rows if i is not None}
    for i in sorted(words):
        for s in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][s : s + length]), (i, s))
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[s : s + length])] != (i, s):
                gone[s : s + length] = [True] * length
        if w and all(gone):
            continue
        if any(gone):
            text, at, matches = "", 0, list(WORDS.finditer(t))
            for k, m in enumerate(matches):  # a word goes with the white space before it
                if not gone[k]:
                    text += t[at : m.end()]
                at = m.end()
            t = text + t[at:]
        out.append((i, t))
    return out


def _clean(rows, items):
    wanted = [s for s in map(_shingles, items) if s]
    return [(i, t) for i, t in rows if i is None or not any(5 * len(s & _shingles(t)) >= 4 * len(s) for s in wanted)]


@pytest.mark.parametrize("seed", [1, 2])
def test_run_against_plain_python(spark, tmp_path, seed):
    rows, labels, items = _rows(seed)
    full = [(i, t, len(t or ""), 0.5, "q", 7, 8, True, 9, "r", k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, SCHEMA).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels] + [(None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(read, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = [_plain_score(model, t) for _, t in rows]
    got = {r["a.b"]: r.found for r in quality.with_score(read, model, score_col="found").collect()}
    assert max(abs(got[k] - s) for k, s in enumerate(scores)) < 1e-6
    steps = [[r for r, s in zip(rows, scores) if s >= 0.3]]
    for step in (_near, _cut, lambda r: _clean(r, items)):
        steps.append(step(steps[-1]))
    assert all(a != b for a, b in zip([rows, *steps], steps)) and len(steps[0]) < len(rows) and len(steps[-1]) > 60, [len(x) for x in steps]
    now = read
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
        assert sorted(((r.doc_id, r.text) for r in now.collect()), key=key) == sorted(want, key=key), name
        assert all(r.n_chars == len(r.text or "") and r.quality_score == "q" and r.rest == "r" for r in now.collect())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in steps[-1]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, some.limit(0), str(tmp_path)).count() == 0, name
        assert stage(spark, some, str(tmp_path)).count() == 2, name


def test_held_out_rows_are_never_learnt_from(spark):
    rows = [(i, ("good words here " if i % 2 else "#$% @@ ") * 30, float(i % 2)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, _, q in rows], "doc_id long, quality double")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in out)  # wrong labels of held-out rows change nothing
    assert {r.doc_id for r in out if r.held_out} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
