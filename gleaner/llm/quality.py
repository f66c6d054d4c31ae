"""Quality classifier (operator 9): attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of a whole text is encoded twice: by what its
words look like (shares of kinds of characters, lengths, repetition), and by what they are: each word has
three hashed features (the word, its first and its last three bytes, in lower case), each feature a learned vector, and the
passage has their mean. The model maps both to a hidden vector, weighs the passages' hidden vectors with gated attention
(softmax of a . (tanh(V h) * sigmoid(U h)), Ilse, Tomczak and Welling 2018) and scores the weighted sum with a
logistic output. Only the document has a label; vectors, encoder and attention are learnt together from it.

Training takes a bounded sample of labelled documents, whole: of those with the least md5 of the id at most
TRAIN_DOCS, and of these, in that order, as many as TRAIN_BYTES of text hold. Both bounds are parameters; what
the driver gets is about three bytes a byte of that text. A tenth of the sample chooses the epoch that is kept.
Scoring has no bound: every passage of every document, in blocks of passages, with the weights (about 300 kB)
in the closure. No shuffle but the join of labels to the documents that are learnt from.

A null or empty text is one passage without words and is scored like any other; a very long one takes memory
for its words, not for their vectors. Labels that are null, or of unknown documents, are left out; with one class only
the score is that class's share; without any label, or with empty tables, it is a half. A document is learnt from
once for each label, however often its rows repeat. A row without an id is scored, and not held out. Only the named columns are read;
labels, language, source and id are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import BASE, BASE_INVERSE, mapped, mixed, powers, settle

PASSAGE, TRAIN_DOCS, TRAIN_BYTES = 64, 4000, 24 << 20
HIDDEN, GATES, VECTOR, BUCKETS = 16, 8, 8, 1 << 13
EPOCHS, LEAST_STEPS, STEP, DECAY, SEED = 30, 800, 0.01, 1e-4, 7
FEATURES = 26


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 full stop or comma, 5 other signs used in prose,
    6 signs that prose hardly uses, 7 space, 8 line end, 9 part of a longer character."""
    kind = np.zeros(256, np.uint8)
    for k, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"'\"-:;()?!", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t", b"\n\r\x0b\x0c"), 1):
        kind[list(members)] = k
    kind[128:] = 9
    return kind


_KIND = _kinds()


_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[0x41:0x5B] += np.uint64(0x20)
#: Words hashed at a time.
BLOCK = 1 << 19


@dataclass
class Bag:
    """A text: looks (one row of FEATURES a passage), the hashed features of its words (one row a word), at which word
    passages start, and how many words each has (1 for a text without words)."""

    looks: np.ndarray
    features: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words as they stand, and their features: the word, its first and its last three bytes, in lower case."""
    whole, features = np.empty(len(starts), np.uint64), np.empty((len(starts), 3), np.uint16)
    with np.errstate(over="ignore"):
        for at in range(0, len(starts), BLOCK):
            some = slice(at, at + BLOCK)
            base = int(starts[some][0])
            part = raw[base : int(ends[some][-1])]
            first, end = starts[some] - base, ends[some] - base
            low, scale, back = _LOW[part], powers(BASE, len(part)), powers(BASE_INVERSE, len(part))
            sums = []
            for values in (part.astype(np.uint64), low):
                running = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((values + np.uint64(1)) * scale, out=running[1:])
                sums.append(mixed((running[end] - running[first]) * back[first]))
            whole[some] = sums[0]
            edge = [np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)]
            for k in range(3):
                there = end - first > k
                edge[0] = (edge[0] << np.uint64(8)) | np.where(there, low[np.minimum(first + k, end - 1)], 0)
                edge[1] = (edge[1] << np.uint64(8)) | np.where(there, low[np.maximum(end - 1 - k, first)], 0)
            for k, h in enumerate((sums[1], mixed(edge[0] + np.uint64(1 << 40)), mixed(edge[1] + np.uint64(1 << 41)))):
                features[some, k] = h % np.uint64(BUCKETS)
    return whole, features


def passages(text: str | None, size: int = PASSAGE) -> Bag:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    in_word = ~_IS_GAP[raw]
    edges = np.flatnonzero(np.diff(in_word, prepend=False, append=False))
    first, end = edges[::2], edges[1::2]
    n = len(first)
    if not n:
        return Bag(np.zeros((1, FEATURES), np.float32), np.zeros((0, 3), np.uint16), np.zeros(1, np.int64), np.ones(1, np.int64))
    starts = np.arange(0, n, size)
    sizes = np.diff(np.append(starts, n))
    lengths = end - first
    passage = np.repeat(np.arange(len(starts)), sizes)
    kinds = _KIND[raw]
    counts = np.bincount(np.repeat(passage, lengths) * 10 + kinds[in_word], minlength=10 * len(starts)).reshape(-1, 10)
    out = np.zeros((len(starts), FEATURES), np.float32)
    out[:, 0:10] = counts / counts.sum(axis=1, keepdims=True)
    # Repetition: how often a word is one of the words just before it, or of its passage.
    whole, features = _hashed(raw, first, end)
    distinct, code = np.unique(whole, return_inverse=True)
    for k, back in enumerate((1, 2, 3)):
        same = np.zeros(n)
        same[back:] = code[back:] == code[:-back]
        out[:, 10 + k] = np.add.reduceat(same, starts) / sizes
    single = passage * len(distinct) + code
    out[:, 13] = np.bincount(np.unique(single) // len(distinct), minlength=len(starts)) / sizes
    out[:, 14] = len(distinct) / n  # of the whole text
    out[:, 15] = len(np.unique(code[:-1] * len(distinct) + code[1:])) / max(n - 1, 1)
    mean = np.add.reduceat(lengths, starts) / sizes
    out[:, 16] = mean / 10
    out[:, 17] = np.sqrt(np.add.reduceat((lengths - mean[passage]) ** 2, starts) / sizes) / 10
    opens, closes = kinds[first], kinds[end - 1]
    shares = np.stack([opens == 2, closes == 4, closes == 5, closes == 6, (lengths == 1) & (opens == 6), lengths > 25], axis=1)
    out[:, 18:24] = np.add.reduceat(shares.astype(np.float64), starts) / sizes[:, None]
    out[:, 24] = np.log1p(n) / 10
    out[:, 25] = sizes / size
    return Bag(out, features, starts, sizes)


@dataclass
class Sparse:
    """Passages of several bags for training: looks, and of each passage its features (rising within the
    passage) with their shares. bags: how many passages each bag has; cells: how many features each passage has."""

    looks: np.ndarray
    feature: np.ndarray
    share: np.ndarray
    cells: np.ndarray
    bags: np.ndarray


def sparse(bag: Bag) -> Sparse:
    passage = np.repeat(np.arange(len(bag.starts)), bag.sizes if len(bag.features) else 0)
    keys, counts = np.unique((passage[:, None] * BUCKETS + bag.features).ravel(), return_counts=True)
    at = keys // BUCKETS
    return Sparse(bag.looks, (keys % BUCKETS).astype(np.int64), (counts / (3 * bag.sizes[at])).astype(np.float32), np.bincount(at, minlength=len(bag.starts)), np.array([len(bag.starts)]))


def joined(parts: list[Sparse]) -> Sparse:
    return Sparse(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("looks", "feature", "share", "cells", "bags")))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; a run may be empty."""
    out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def loss_and_slopes(w: dict[str, np.ndarray], x: Sparse, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss of bags whose looks are standardised, and its slopes by every weight."""
    cell = np.repeat(np.arange(len(x.cells)), x.cells)
    content = _sums(w["vectors"][x.feature] * x.share[:, None], x.cells)
    both = np.concatenate([x.looks, content], axis=1)
    starts = np.cumsum(x.bags) - x.bags
    bag = np.repeat(np.arange(len(x.bags)), x.bags)
    h = np.tanh(both @ w["encode"] + w["encode_bias"])
    tv, su = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    a = (tv * su) @ w["a"]
    e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    p = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(p[:, None] * h, starts)
    m = z @ w["out"] + w["out_bias"][0]
    loss = float(np.mean(np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y * m))
    d = (_sigmoid(m) - y) / len(y)
    dz = d[:, None] * w["out"]
    dp = (dz[bag] * h).sum(axis=1)
    da = p * (dp - np.add.reduceat(p * dp, starts)[bag])
    dtv, dsu = da[:, None] * w["a"] * su * (1 - tv**2), da[:, None] * w["a"] * tv * su * (1 - su)
    dh = (p[:, None] * dz[bag] + dtv @ w["v"].T + dsu @ w["u"].T) * (1 - h**2)
    dc = (dh @ w["encode"][FEATURES:].T)[cell] * x.share[:, None]
    dv = np.stack([np.bincount(x.feature, dc[:, k], minlength=len(w["vectors"])) for k in range(dc.shape[1])], axis=1)
    return loss, {"vectors": dv, "encode": both.T @ dh, "encode_bias": dh.sum(axis=0), "v": h.T @ dtv, "u": h.T @ dsu, "a": (da[:, None] * tv * su).sum(axis=0), "out": z.T @ d, "out_bias": np.array([d.sum()])}


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]) -> None:
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, bag: Bag, block: int = 16384) -> float:
        """A bag's score; running softmax over blocks, so a text of any length needs one block at a time."""
        w, top, weight, total = self.weights, -np.inf, 0.0, np.zeros(HIDDEN)
        for at in range(0, len(bag.looks), block):
            sizes = bag.sizes[at : at + block]
            first = int(bag.starts[at])
            words = bag.features[first : first + int(sizes.sum())]
            content = np.zeros((len(sizes), VECTOR))
            if len(words):
                of_words = sum(w["vectors"][words[:, k]] for k in range(3))
                content = _sums(of_words, sizes) / (3 * sizes[:, None])
            h = np.tanh(np.concatenate([(bag.looks[at : at + block] - self.mean) / self.scale, content], axis=1) @ w["encode"] + w["encode_bias"])
            a = (np.tanh(h @ w["v"]) * _sigmoid(h @ w["u"])) @ w["a"]
            new_top = max(top, a.max())
            e, shrink = np.exp(a - new_top), np.exp(top - new_top)
            weight, total, top = weight * shrink + e.sum(), total * shrink + e @ h, new_top
        return float(_sigmoid(total / weight @ w["out"] + w["out_bias"][0]))


def train(bags: list[Sparse], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the logistic loss, batches of bags, LEAST_STEPS of them at least; the epoch with the least loss on a tenth kept back."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([b.looks for b in bags]) if bags else np.zeros((1, FEATURES), np.float32)
    mean, scale = every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 1e-3
    width = FEATURES + VECTOR
    w = {"vectors": rng.normal(0, 0.1, (BUCKETS, VECTOR)), "encode": rng.normal(0, width**-0.5, (width, HIDDEN)), "encode_bias": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "a": rng.normal(0, GATES**-0.5, GATES), "out": np.zeros(HIDDEN), "out_bias": np.zeros(1)}
    share = float(labels.mean()) if len(labels) else 0.5
    w["out_bias"][0] = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    if share in (0.0, 1.0) or not len(labels):
        return Model(mean, scale, w)
    scaled = [Sparse((b.looks - mean) / scale, b.feature, b.share, b.cells, b.bags) for b in bags]
    mixed = rng.permutation(len(bags))
    kept_back, used = mixed[: len(bags) // 10], mixed[len(bags) // 10 :]
    aside = joined([scaled[k] for k in kept_back]) if len(kept_back) else None
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(used) // 64)))
    first, second, t, best = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0, (np.inf, w)
    for epoch in range(epochs):
        rate = STEP * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        for some in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            _, g = loss_and_slopes(w, joined([scaled[k] for k in some]), labels[some])
            t += 1
            for k in w:
                grad = g[k] + DECAY * w[k] * (k != "out_bias")
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        now = loss_and_slopes(w, aside, labels[kept_back])[0] if aside is not None else -epoch
        if now < best[0]:
            best = now, dict(w)
    return Model(mean, scale, best[1])


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """A model from labelled documents that aren't held out: in the order of a hash, each that still fits into most_bytes (a larger one
    is passed over), and of a class of which none fits the shortest."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter(F.col("label").isin(0.0, 1.0) & F.col("id").isNotNull() & ~held_out("id"))
    place = F.md5(F.col("id").cast("string").cast("binary"))
    chosen = usable.withColumn("place", place).orderBy("place", "label").limit(most_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most most_docs ids
    sample = settle(rows.groupBy("place", "label").agg(F.min("text").alias("text")), "op9-sample")
    sizes = sample.select("place", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("place", "label").collect()
    taken, used = [], 0
    for r in sizes:
        if used + r["size"] <= most_bytes:
            taken.append(r)
            used += r["size"]
    for label in {r.label for r in sizes} - {r.label for r in taken}:
        taken.append(min((r for r in sizes if r.label == label), key=lambda r: r["size"]))
    sample = sample.filter(F.concat("place", F.col("label").cast("int").cast("string")).isin([f"{r.place}{int(r.label)}" for r in taken])).repartition(16)

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {n: [] for n in ("looks", "feature", "share", "cells")}
        for text in batch.column(1).to_pylist():
            x = sparse(passages(text))
            for n, kind in (("looks", np.float32), ("feature", np.uint16), ("share", np.float32), ("cells", np.int32)):
                out[n].append(getattr(x, n).astype(kind).tobytes())
        return {"place": batch.column(0), "label": batch.column(2)} | out

    rows = mapped(sample.select("place", "text", "label"), work, "place string, label double, looks binary, feature binary, share binary, cells binary").collect()
    rows.sort(key=lambda r: (r.place, r.label, r.feature, r.looks))
    bags = []
    for r in rows:
        looks = np.frombuffer(r.looks, np.float32).reshape(-1, FEATURES)
        bags.append(Sparse(looks, np.frombuffer(r.feature, np.uint16).astype(np.int64), np.frombuffer(r.share, np.float32), np.frombuffer(r.cells, np.int32).astype(np.int64), np.array([len(looks)])))
    return train(bags, np.array([r.label for r in rows]))


def with_score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of every row's whole text in a new column."""
    if score_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {score_col} already")
    at = docs.columns.index(text_col)
    names = docs.columns

    def work(batch: pa.RecordBatch) -> dict:
        scores = [round(model.score(passages(t)), 9) for t in batch.column(at).to_pylist()]
        return {name: batch.column(k) for k, name in enumerate(names)} | {score_col: scores}

    return mapped(docs, work, StructType([*docs.schema, StructField(score_col, DoubleType())]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs."""
    scored = with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
