"""Near copies, repeats, embeddings and leaks against brute force on small made-up tables."""

import random

import numpy as np
import pytest

from gleaner.llm import components, decontam, embeddings, minhash, repeats
from gleaner.llm.shared import WORDS, lowered


def _closure(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def _corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(n // 3)]
    passage = " ".join(rng.choices(vocab, k=40))
    while len(texts) < n:
        w = rng.choice(texts[: n // 3]).split()
        kind = rng.random()
        if kind < 0.3:
            texts.append(" ".join(w))
        elif kind < 0.7:
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        else:
            k = rng.randrange(len(w) + 1)
            texts.append("\n".join([*w[:k], passage, *w[k:]]))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    texts = [*_corpus(seed), None, "", "   ", "one two", "One  two", "x " * 3000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, keys string").repartition(5)
    sets = []
    for t in texts:
        w = WORDS.findall(lowered(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for share in ((85, 100), (80, 100)):
        links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j])]
        want = _closure(range(len(sets)), links)
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, share=share).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def test_near_copies_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(odd).collect())
    assert got == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True)]


def test_slices_and_units_do_not_change_the_result(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(_corpus(3))), "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "SLICE", 3)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == want


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 150)}, 301: 300}


def _without_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if k in seen:
                gone[i : i + length] = [True] * length
            seen.add(k)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("length, batch", [(20, 1 << 20), (6, 200), (7, 64)])
def test_repeats(spark, monkeypatch, length, batch):
    monkeypatch.setattr(repeats, "BATCH_WORDS", batch)
    texts = [*_corpus(5), None, "", "a b " * 50, "z " * 19, "q " * 20, "q " * 20, "q " * 21]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(4)
    want = dict(enumerate(_without_repeats(texts, length)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.dedup(docs, length=length, spacing=False).collect()}
    assert got == want
    spaced = {r.doc_id: r for r in repeats.dedup(docs.withColumnRenamed("n_words", "more"), length=length, keep=("more",)).collect()}
    assert all(" ".join(WORDS.findall(spaced[i].kept or "")) == want[i][2] for i in want)
    assert spaced[len(texts) - 7].kept is None


def test_repeats_of_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t), (None, t), (3, t), (3, t), (9, t)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 0), (0, 0), (3, 0), (3, 0), (9, 30)]
    assert repeats.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("cell_rows", [4096, 60, 8])
def test_embeddings(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24))
    near = base[rng.integers(0, 300, 150)] + rng.normal(size=(150, 24)) * 0.12
    x = np.vstack([base, near, base[:20], base[:1].repeat(60, axis=0) * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(6)
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g = u @ u.T
    links = [(i, j) for i, j in zip(*np.nonzero(g >= 0.95)) if i < j] + [(9006, 9007)]
    want = _closure([r[0] for r in rows + odd], links)
    counts = {i: 0 for i in want}
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.97 * sum(counts.values()) and all(r.n_links <= counts[i] for i, r in got.items())
    if cell_rows == 4096:
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (counts[i], want[i]) for i in want}


def test_leaks(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocab, k=k)) for k in (3, 5, 8, 20, 40, 90, 300)] + [None, "", "x y"]
    docs = []
    for k in range(60):
        w = rng.choices(vocab, k=rng.randint(0, 400))
        if k % 3 == 0:
            leak = (rng.choice([i for i in items if i]) or "").split()
            if k % 2:
                leak[len(leak) // 2] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = leak
        docs.append(" ".join(w).upper() if k % 5 == 0 else " ".join(w))
    docs += [None, "", "X  Y", items[3]]

    def sets(t):
        w = WORDS.findall(lowered(t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {(d, i) for d, t in enumerate(docs) for i, s in enumerate(items) if sets(s) and 5 * len(sets(s) & sets(t)) >= 4 * len(sets(s))}
    d = spark.createDataFrame([(k, t, 0) for k, t in enumerate(docs)], "doc_id long, text string, item int")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc, r.item) for r in decontam.contained(d, b).collect()} == want
    flags = {r.doc_id: r.contaminated for r in decontam.decontaminate(d, b).collect()}
    assert flags == {k: any(x == k for x, _ in want) for k in range(len(docs))}
    assert decontam.decontaminate(d.limit(0), b).count() == 0 and not any(r.contaminated for r in decontam.decontaminate(d, b.limit(0)).collect())


def test_embeddings_recall_in_many_cells(spark, monkeypatch):
    """Pairs just over the threshold among isotropic vectors, far more cells than a row is in."""
    monkeypatch.setattr(embeddings, "CELL_ROWS", 8)
    rng = np.random.default_rng(1)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 3000, 64)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + (1 - 0.951**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([x, y]))], "vec_id long, embedding array<double>").repartition(4)
    found = embeddings.near_duplicates(df)
    assert embeddings.recall(df, found, queries=1000) >= 0.99
    assert found.filter("n_links > 0").count() >= 0.99 * 6000


def test_embeddings_of_nothing_and_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_leaks_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "x " * 200_000 + "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([("i2", "a b c d e f"), ("i1", "A b C d e f"), ("i1", "A b C d e f"), (None, "a b c d e f"), ("i3", None)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_items, r.best_item, r.contaminated) for r in decontam.decontaminate(docs, items).collect())
    assert got == [(0, 0, None, False), (1, 2, "i1", True), (1, 2, "i1", True), (2, 0, None, False), (3, 2, "i1", True)]


def test_repeats_refuse_clashing_names(spark):
    with pytest.raises(ValueError):
        repeats.dedup(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_words int"), keep=("n_words",))


def test_near_copies_around_a_template(spark, monkeypatch):
    """Several groups in one bucket, leads that aren't near their members, many units of work."""
    monkeypatch.setattr(minhash, "SLICE", 4)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 9)):  # about five shingles each
            w[rng.randrange(200)] = f"c{k % 7}x{rng.randint(0, 3)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    for share in ((80, 100), (90, 100)):
        links = [(i, j) for i in range(90) for j in range(i) if share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j])]
        want = _closure(range(90), links)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, share=share).collect()} == want
