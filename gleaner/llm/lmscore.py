"""LM scoring (operator 5): cross-entropy difference of two matched n-gram models (Moore and Lewis 2010).

A target model is counted on the documents marked as wanted, a background model on all documents. Both
are bigram models with the unigram model as prior, with the same smoothing and one vocabulary: all words
of all documents, least_words at least (a parameter of score(): with fewer distinct words the prior is spread over this many). Words and pairs are known by 64-bit hashes, so counts are exact but
for equal hashes (at 10 ** 9 distinct pairs 0.03 expected). Background counts are scaled to the target's
number of words, so that the prior weighs alike in both. A document's score is the mean over its words of
(target loss - background loss), in nats: below 0 it is more like the target.

The loss of word b after word a is log(count(a) + PRIOR) - log(count(a, b) + PRIOR * p(b)). A word's count as
context is its count as a word, so a document's sum of the first terms runs over its words but the last,
and the start; all that a pair adds is known where the pairs that end in b are.

How it runs. Texts meet their marks once and are written. A first pass counts words: all, distinct ones (by
range of hashes), and hot words and hot pairs, those that make more than a HOT part of a sample; there are 1 / HOT of
each at most, and their exact counts go to all tasks. In the second pass each piece of text sends its pairs, each with
its documents, to the range of their last word (pairs of hot words: to the range of the pair), packed. The range counts
them, target and background, and right away works out what each document's pairs add; the sums by document come back
to the piece. So pairs are shuffled once for both. Hot pairs are settled inside the piece and aren't sent, so no task
sees a pair that a large part of all documents hold. The sample only says where pairs meet, not what they count. Sums are
whole multiples of 1 / UNIT, so their order doesn't matter; neither vocabulary nor counts come to the driver.

Null and empty texts have no words: they add nothing and score 0. Without any target document all scores
are the background's against an empty model. Marks repeated or null count once or not at all. Rows with
the same id are counted and scored each on its own, rows without an id as unmarked ones. A text of any length is one piece. Empty tables give an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORDS, WordHashes, lowered, mixed, pieces_of, settle

#: Words that the prior spreads FLOOR over, at least, unless score() is told otherwise.
LEAST_WORDS = 1 << 18
#: Text whose pairs meet in a range of hashes, about.
RANGE = 64 << 20
PRIOR, FLOOR, UNIT = 20.0, 0.5, float(1 << 24)
HOT, SAMPLE_ROWS = 1 / 1000, 1000  # so at most 1000 hot words, whose numbers no hash of a word will be
#: Text that a task sorts the words of at a time.
PIECE = 10 << 20
_hashes = WordHashes(seed=11)
_ZSTD = pa.Codec("zstd", compression_level=1)
_NONE = np.zeros(0, np.uint64)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and of the pairs that end in them; and how many words each text has. The
    upper 16 bits of a pair's hash are its last word's, the others (48 bits) are of the word before."""
    hashes = [_hashes.of(WORDS.findall(lowered(t))) if t else _NONE for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    h = np.concatenate(hashes) if len(texts) else _NONE
    before = np.empty(len(h), np.uint64)
    before[1:] = h[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 1
    with np.errstate(over="ignore"):
        pair = mixed((before * np.uint64(0x9E3779B97F4A7C15)) ^ h)
    return h, (pair >> np.uint64(16)) | (h & np.uint64(0xFFFF_0000_0000_0000)), sizes


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, by planes of bytes."""
    sizes = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return sizes + _ZSTD.compress(planes, asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    """What _pack was given, as uint64."""
    n = int.from_bytes(packed[:8], "little")
    sizes = np.frombuffer(packed, np.int64, n, 8)
    raw = np.frombuffer(_ZSTD.decompress(packed[8 * (n + 1) :], int(sizes.sum()) * 8, asbytes=True), np.uint8)
    ends = np.cumsum(sizes) * 8
    return [np.ascontiguousarray(raw[e - 8 * s : e].reshape(8, -1).T).reshape(-1).view(np.uint64) for e, s in zip(ends, sizes)]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _runs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where runs of equal values of both start."""
    return np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.zeros(0, np.int64)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _spread(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of hashes, in their order."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _keys(word: np.ndarray, pair: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What pairs are dealt by: the hash of the last word, or of the pair where the word is hot; and the words, a hot one
    by its number among the hot."""
    at, there = _find(hot, word)
    return np.where(there, (pair << np.uint64(16)) | (pair >> np.uint64(48)), word), np.where(there, at.astype(np.uint64), word)


def _part(docs: DataFrame) -> DataFrame:
    """Some files of a written table, from all over it, whose rows an id's hash has dealt; a table of no files as it is."""
    files = sorted(docs.inputFiles())
    return docs.sparkSession.read.schema(docs.schema).parquet(*files[:: max(1, len(files) // 4)][:4]) if files else docs


def _hot(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words, and of the pairs, that make more than a HOT part of those of some rows, about SAMPLE_ROWS."""
    part = _part(docs)
    rows = part.sample(min(1.0, SAMPLE_ROWS / max(part.count(), 1)), seed=11).select("text").filter(F.length("text") < PIECE // 60).collect()
    word, pair, _ = words_of([r.text for r in rows])
    out = []
    for h in (word, pair):
        keys, n = np.unique(h, return_counts=True)
        out.append(keys[n > HOT * n.sum()])
    return out[0], out[1]


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """values[place], whatever where a place is beyond them."""
    return values[np.minimum(places, np.uint64(len(values) - 1)).astype(np.int64)] if len(values) else np.zeros(len(places), values.dtype)


@dataclass
class Totals:
    """What all ranges need of both models (target, background): words, texts with words, counts of hot words and
    of hot pairs (2 x how many), and the number of distinct words."""

    words: np.ndarray
    starts: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    distinct: int
    least_words: int = LEAST_WORDS

    def __post_init__(self) -> None:
        n, m = self.words.tolist()
        self.scale = (1.0, n / m if n and m else 1.0)
        self.floor = [k * s + FLOOR * max(self.least_words, self.distinct) for k, s in zip((n, m), self.scale)]
        self.start = [float(np.log(k * s + PRIOR)) for k, s in zip(self.starts.tolist(), self.scale)]

    def pair_loss(self, m: int, own: np.ndarray, both: np.ndarray) -> np.ndarray:
        """What a pair adds to a sum of losses, from its last word's count and its own, in units."""
        s = self.scale[m]
        return np.rint((np.log(own * s + PRIOR) - np.log(both * s + PRIOR * (own * s + FLOOR) / self.floor[m])) * UNIT)

    def context_loss(self, m: int, own: np.ndarray) -> np.ndarray:
        return np.rint(np.log(own * self.scale[m] + PRIOR) * UNIT)


def _marked(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, more: DataFrame | None) -> DataFrame:
    """(id, text, part): part 0 is wanted, 1 counted as background only, 2 scored but not counted."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = wanted.select(F.col(id_col).alias("id")).filter("id is not null").distinct().withColumn("wanted", F.lit(True)).hint("merge")  # grows with the input, so it isn't broadcast at any size
    rows = own.join(marks, "id", "left").select("id", "text", F.when(F.col("wanted"), 0).otherwise(1).alias("part"))
    return settle(rows if more is None else rows.unionByName(more.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(2).alias("part"))), "op5-marked")


def totals(marked: DataFrame, ranges: int, least_words: int = LEAST_WORDS) -> Totals:
    hot, pairs = _hot(marked)
    width = 2 + len(hot) + len(pairs)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words by range; and this task's sums, to a range below 0."""
        sums = np.zeros((2, width), np.int64)
        for batch in batches:
            for piece in pieces_of(batch, PIECE):
                word, pair, sizes = words_of(piece.column(0).to_pylist())
                part = piece.column(1).to_numpy()
                of_word = np.repeat(part, sizes)
                sums[:, 1] += [((part <= most) & (sizes > 0)).sum() for most in (0, 1)]
                sums[:, 0] += [(of_word <= most).sum() for most in (0, 1)]
                for keys, h, at in ((hot, word, 2), (pairs, pair, 2 + len(hot))):
                    place, there = _find(keys, h)
                    of_hot = of_word[there]
                    for most in (0, 1):
                        sums[most, at : at + len(keys)] += np.bincount(place[there][of_hot <= most], minlength=len(keys))
                distinct = np.unique(word[of_word <= 1])
                cuts = np.searchsorted(_spread(distinct, ranges), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([_pack(distinct[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())], ["range", "packed"])
        yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId() % ranges]), pa.array([_pack(sums[0], sums[1])], pa.binary())], ["range", "packed"])

    def summed(table: pa.Table) -> pa.Table:
        """(key, target, background): key -1 has the number of distinct words, others the sums."""
        parts = [_unpack(p.as_py()) for p in table["packed"]]
        if table["range"][0].as_py() >= 0:
            n = len(np.unique(np.concatenate([p[0] for p in parts])))
            return pa.table({"key": pa.array([-1], pa.int64()), "target": pa.array([n], pa.int64()), "background": pa.array([0], pa.int64())})
        t, b = (sum(p[m].view(np.int64) for p in parts) for m in (0, 1))
        return pa.table({"key": pa.array(np.arange(width)), "target": pa.array(t), "background": pa.array(b)})

    counted = marked.select("text", "part").mapInArrow(tally, "range long, packed binary").groupBy("range").applyInArrow(summed, "key long, target long, background long")
    rows = {r.key: (r.t, r.b) for r in counted.groupBy("key").agg(F.sum("target").alias("t"), F.sum("background").alias("b")).collect()}  # 2 / HOT at most, and three
    sums = np.array([rows.get(k, (0, 0)) for k in range(width)], np.int64).T
    return Totals(sums[:, 0], sums[:, 1], hot, sums[:, 2 : 2 + len(hot)], pairs, sums[:, 2 + len(hot) :], rows.get(-1, (0, 0))[0], least_words)


def score(docs: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, n_words, target_loss, background_loss, score) for every row of docs, and of more: documents that are scored
    but not counted. wanted: a table of ids of docs."""
    kind = dict(docs.dtypes)[id_col]
    marked = _marked(docs, wanted, id_col, text_col, more)
    mean = _part(marked).agg(F.avg(F.octet_length("text"))).first()[0] or 0.0
    # As many as the text asks for, so that a range's memory doesn't grow with the input; rows are counted by the files' footers.
    ranges = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(mean * marked.count() // RANGE) + 1)
    known = totals(marked, ranges, least_words)
    head = f"range long, chunk long, ids array<{kind}>, sizes array<long>, sums array<long>, packed binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = pa.list_(batch.schema.field(0).type)

            def row(place: int, packed: bytes | None, ids_of: pa.Array | None = None, sizes: np.ndarray | None = None, sums: np.ndarray | None = None) -> pa.RecordBatch:
                own = pa.nulls(1, ids) if ids_of is None else pa.ListArray.from_arrays(pa.array([0, len(ids_of)], pa.int32()), ids_of)
                longs = [pa.array([v], pa.list_(pa.int64())) for v in (sizes, sums)]
                return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([chunk], pa.int64()), own, *longs, pa.array([packed], pa.binary())], ["range", "chunk", "ids", "sizes", "sums", "packed"])

            for piece in pieces_of(batch, PIECE):
                chunk += 1
                # Wanted documents first, then the others that count: two numbers say which is which.
                piece = piece.take(pa.array(np.argsort(piece.column(2).to_numpy(), kind="stable")))
                limits = np.searchsorted(piece.column(2).to_numpy(), [1, 2]).astype(np.int64)
                word, pair, sizes = words_of(piece.column(1).to_pylist())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                ends = np.flatnonzero(sizes)
                key, code = _keys(word, pair, known.hot)
                ended = np.cumsum(sizes)[ends] - 1
                last, last_place = code[ended], _spread(key[ended], ranges)
                at, settled = _find(known.pairs, pair)
                sums = np.zeros((2, len(sizes)), np.int64)
                for m in (0, 1):  # a hot pair's last word is hot
                    loss = known.pair_loss(m, known.hot_counts[m][code[settled].astype(np.int64)], known.pair_counts[m][at[settled]])
                    sums[m] += np.bincount(doc[settled], loss, minlength=len(sizes)).astype(np.int64)
                yield row(chunk % ranges, None, piece.column(0), sizes, sums.ravel())
                order = np.flatnonzero(~settled)
                order = order[np.lexsort((pair[order], key[order]))]
                key, code, pair, doc = key[order], code[order], pair[order], doc[order]
                entry = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(pair) else np.zeros(0, np.int64)
                times = np.diff(entry, append=len(pair))
                key, code, pair, doc = key[entry], code[entry], pair[entry], doc[entry]
                order = np.argsort(last_place, kind="stable")
                last, last_doc, last_place = last[order], ends[order], last_place[order]
                cuts, last_cuts = np.searchsorted(_spread(key, ranges), np.arange(ranges + 1)), np.searchsorted(last_place, np.arange(ranges + 1))
                for at in np.flatnonzero(np.diff(cuts) + np.diff(last_cuts)).tolist():
                    (a, b), (c, e) = cuts[at : at + 2], last_cuts[at : at + 2]
                    at_pair, at_word = a + _runs(pair[a:b], key[a:b]), a + _starts(code[a:b])
                    n_pairs = np.diff(np.searchsorted(at_pair, at_word), append=len(at_pair))
                    yield row(at, _pack(code[at_word], n_pairs, pair[at_pair] & np.uint64(0xFFFF_FFFF_FFFF), np.diff(at_pair, append=b), doc[a:b], times[a:b], last[c:e], last_doc[c:e], limits))

    def answer(asked: pa.Table) -> pa.Table:
        rows = [[x.view(np.int64) if k in (1, 3, 4, 5, 7, 8) else x for k, x in enumerate(_unpack(p.as_py()))] if p.is_valid else None for p in asked["packed"]]
        held = [r for r in rows if r is not None]
        hot = np.uint64(len(known.hot))
        for r in held:  # pairs get back the bits of their word
            r[2] = r[2] | (np.repeat(np.where(r[0] < hot, _at(known.hot, r[0]), r[0]), r[1]) & np.uint64(0xFFFF_0000_0000_0000))
        every, words = (np.unique(np.concatenate([r[k] for r in held])) if held else _NONE for k in (2, 0))
        pair_counts, word_counts = np.zeros((2, len(every)), np.int64), np.zeros((2, len(words)), np.int64)
        for r in held:
            word, n_pairs, pair, n_docs, doc, times, _, _, limits = r
            r.append(np.searchsorted(every, pair))
            at, of_word = np.repeat(np.arange(len(pair)), n_docs), np.searchsorted(words, word)
            for m in (0, 1):
                n = np.bincount(at, times * (doc < limits[m]), minlength=len(pair)).astype(np.int64)
                pair_counts[m][r[9]] += n  # a row has each pair once
                np.add.at(word_counts[m], of_word, np.bincount(np.repeat(np.arange(len(word)), n_pairs), n, minlength=len(word)).astype(np.int64))

        def counts_of(some: np.ndarray, m: int) -> np.ndarray:
            at, there = _find(words, some)
            counts = word_counts[m][at] * there if len(words) else np.zeros(len(some), np.int64)
            return np.where(some < hot, _at(known.hot_counts[m], some), counts)

        out = []
        for r in rows:
            if r is None:
                out.append(None)
                continue
            word, n_pairs, pair, n_docs, doc, times, last, last_doc, _, at = r
            docs_of, which = np.unique(np.concatenate([doc, last_doc]), return_inverse=True)
            sums = []
            for m in (0, 1):
                loss = known.pair_loss(m, np.repeat(counts_of(word, m), n_pairs), pair_counts[m][at])
                sums.append(np.bincount(which, np.concatenate([np.repeat(loss, n_docs) * times, -known.context_loss(m, counts_of(last, m))]), minlength=len(docs_of)).astype(np.int64))
            out.append(_pack(docs_of, *sums))
        return asked.set_column(asked.schema.get_field_index("packed"), "packed", pa.array(out, pa.binary()))

    def gathered(rows: pa.Table) -> pa.Table:
        own = next(k for k, p in enumerate(rows["packed"]) if not p.is_valid)
        ids, sizes = rows["ids"][own].values, rows["sizes"][own].values.to_numpy()
        sums = rows["sums"][own].values.to_numpy().reshape(2, -1).copy()
        for packed in rows["packed"]:
            if packed.is_valid:
                at, *parts = (x.view(np.int64) for x in _unpack(packed.as_py()))
                for m in (0, 1):
                    sums[m, at] += parts[m]
        means = [np.where(sizes > 0, sums[m] / UNIT + known.start[m], 0.0) / np.maximum(sizes, 1) for m in (0, 1)]
        return pa.table({"id": ids, "n_words": sizes, "target_loss": np.round(means[0], 6), "background_loss": np.round(means[1], 6), "score": np.round(means[0] - means[1], 6)})

    met = marked.mapInArrow(ask, head).groupBy("range").applyInArrow(answer, head)
    return met.groupBy("chunk").applyInArrow(gathered, f"id {kind}, n_words long, target_loss double, background_loss double, score double").withColumnRenamed("id", id_col)
