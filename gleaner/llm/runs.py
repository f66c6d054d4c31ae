"""Periodic run detection (operator 12).

Words of a text are appended to a Catcher, one or many at a time. For each power of two m it keeps a catcher for every
completed block of m words: the block's hash. An appended word ends one new window of m words, whose hash is compared with
that of the one block that lies p words before it, p being a period of this level (at most m periods belong to a level, so
there is at most one such block). A hit is a square in the making: comparisons go on from it to the left, and to the right
as far as words have come, and the stretch that they find goes on growing with each word appended while it touches the end.
Stretches of one period that touch merge, since each is grown as far as it goes.

Level m serves the periods p whose runs hold a whole block of m words in the part that repeats p words later, wherever the run
stands: 2 m - 1 <= max(LEAST, 4 p) - p. Each word costs a few array operations a level, so n log n in all. A hit inside a
stretch of a smaller period r <= m is passed over: the two would overlap by p + r words, so p isn't the smallest period.

A run is a stretch of consecutive words with smallest period p (words p apart are equal) of at least max(LEAST, 4 p) words
that no neighbour extends. Words are compared exactly, by their number in the text.

One pass without a shuffle; memory follows the longest text. Null and empty texts have no words and no runs. Repeated rows and rows
without an id are looked at each on its own; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, BASE_INVERSE, WORDS, mapped, mixed, powers

#: A run has this many words and this many periods at least.
LEAST, TIMES = 6, 4
#: Words appended at a time.
STEP = 1 << 16


class Growing:
    """An array that is appended to."""

    def __init__(self, kind: type) -> None:
        self.room, self.n = np.zeros(64, kind), 0

    def append(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room, np.zeros(max(need, 2 * len(self.room)) - len(self.room), self.room.dtype)])
        self.room[self.n : need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class Level:
    """Catchers of blocks of size words: the hash of each completed block."""

    def __init__(self, size: int) -> None:
        self.size, self.seen, self.caught = size, 0, Growing(np.uint64)  # seen: window starts looked at
        self.low, self.high = periods(size)


def periods(size: int) -> tuple[int, int]:
    """Least and greatest period of the level of blocks of that size."""
    return (1, 2) if size == 2 else ((2 * size + 1) // 3, (4 * size - 2) // 3)


class Catcher:
    """Squares of a growing sequence of whole numbers."""

    def __init__(self) -> None:
        self.words, self.sums, self.levels = Growing(np.int64), Growing(np.uint64), []
        self.sums.append(np.zeros(1, np.uint64))
        self.stretches: list[list[int]] = []  # [start, end, period]
        self.open: list[list[int]] = []  # those that touch the end

    def append(self, words: np.ndarray) -> None:
        before = self.words.n
        self.words.append(words)
        n = self.words.n
        with np.errstate(over="ignore"):
            self.sums.append(self.sums.values[-1] + np.cumsum(mixed(words.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[before:], dtype=np.uint64))
        self.open = [s for s in self.open if self._right(s) == n]
        while TIMES * periods(2 << len(self.levels))[0] <= n and n >= LEAST:
            self.levels.append(Level(2 << len(self.levels)))
        for level in self.levels:
            self._advance(level)

    def _advance(self, level: Level) -> None:
        """Compares the new windows of the level with the blocks that its periods allow."""
        m, n, first = level.size, self.words.n, level.seen
        if n - m + 1 <= first:
            return
        sums = self.sums.values
        with np.errstate(over="ignore"):
            hashes = (sums[first + m :] - sums[first : n - m + 1]) * powers(BASE_INVERSE, n)[first : n - m + 1]
        level.caught.append(hashes[-first % m :: m])
        level.seen = n - m + 1
        start = np.arange(first, n - m + 1)
        block = (start - level.low) // m
        hit = np.flatnonzero((level.caught.values[block] == hashes) & (start - block * m <= level.high) & (block >= 0))
        if not len(hit):
            return
        start, block = start[hit], block[hit] * m
        period = start - block
        for p in np.unique(period).tolist():
            at = block[period == p]
            for s in at[~self._inside(at, at + p + m, min(m, p - 1))].tolist():
                if not (self.stretches and self.stretches[-1][2] == p and self.stretches[-1][0] <= s and s + p + m <= self.stretches[-1][1]) and not any(o[2] == p and o[0] <= s for o in self.open):
                    self._grow(s, p, m)

    def _inside(self, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """Which of [start, end) lie in a stretch of a period of most at most."""
        known = sorted((s[0], s[1]) for s in self.stretches if s[2] <= most)
        if not known:
            return np.zeros(len(start), bool)
        starts, ends = (np.array(v) for v in zip(*known))
        reach = np.concatenate([[0], np.maximum.accumulate(ends)])
        return reach[np.searchsorted(starts, start, "right")] >= end

    def _grow(self, s: int, p: int, m: int) -> None:
        """The stretch of period p around the words from s on, of which m are said to be equal to those p later."""
        w = self.words.values
        if not np.array_equal(w[s : s + m], w[s + p : s + p + m]):
            return  # equal hashes only
        step, left = 64, s
        while left > 0:
            low = max(0, left - step)
            unlike = np.flatnonzero(w[low:left] != w[low + p : left + p])
            if len(unlike):
                left = low + int(unlike[-1]) + 1
                break
            left, step = low, 2 * step
        found = [left, s + p + m, p]
        if self._right(found) == len(w):
            self.open.append(found)
        self.stretches.append(found)

    def _right(self, stretch: list[int]) -> int:
        """Moves the end of a stretch to the right as far as words repeat."""
        w, n, (_, end, p), step = self.words.values, self.words.n, stretch, 64
        while end < n:
            high = min(n, end + step)
            unlike = np.flatnonzero(w[end:high] != w[end - p : high - p])
            if len(unlike):
                end += int(unlike[0])
                break
            end, step = high, 2 * step
        stretch[1] = end
        return end

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run so far, by start, then period."""
        least: dict[tuple[int, int], int] = {}
        for start, end, p in self.stretches:
            if end - start >= max(LEAST, TIMES * p) and p < least.get((start, end), end):
                least[start, end] = p
        return sorted((a, b - a, p) for (a, b), p in least.items())


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start, then period."""
    number = dict.fromkeys(words)
    for k, w in enumerate(number):
        number[w] = k
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    catcher = Catcher()
    for at in range(0, len(ids), STEP):
        catcher.append(ids[at : at + STEP])
    return catcher.runs()


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equal ones that of least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, starts, lengths, periods, start, length, period, collapsed) for every row: all runs, by start, then
    period; the strongest; and the words that no run holds after its first period, joined by one space."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_words", "starts", "lengths", "periods", "start", "length", "period", "collapsed")}
        for text in batch.column(1).to_pylist():
            words = WORDS.findall(text or "")
            runs = runs_of(words) if len(words) >= LEAST else []
            out["n_words"].append(len(words))
            for name, values in zip(("starts", "lengths", "periods"), zip(*runs) if runs else ((), (), ())):
                out[name].append(list(values))
            for name, value in zip(("start", "length", "period"), strongest(runs) or (None, None, None)):
                out[name].append(value)
            if runs:
                kept = np.ones(len(words), bool)
                for start, length, period in runs:
                    kept[start + period : start + length] = False
                words = [words[k] for k in np.flatnonzero(kept).tolist()]
            out["collapsed"].append(" ".join(words))
        return {"id": batch.column(0), **out}

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    lists = ", ".join(f"{c} array<long>" for c in ("starts", "lengths", "periods"))
    out = mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), work, f"id {kind}, n_words long, {lists}, start long, length long, period long, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_periodic_tails(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every tenth document by crc32 of its id goes on periodically from some word on. With h = crc32(decimal id), g =
    floor(h / 10) and n words, h divisible by 10: from word a = g mod n on, word i is word a + (i - a) mod p, p = 1 +
    floor((n - a) / (3 + g mod 8)). Rows without an id or words stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = (h % 10 == 0) & (F.size(words) > 0)
    g, n = F.floor(h / 10), F.size("_w").cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.when(chosen, words).alias("_w"), g.alias("_g"))
    a = F.when(n > 0, F.col("_g") % n).cast("int")
    rows = rows.withColumn("_a", a).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    head, period, tail = F.slice("_w", 1, F.col("_a")), F.slice("_w", F.col("_a") + 1, F.col("_p")), (n - F.col("_a")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(tail / F.col("_p")).cast("int"))), 1, tail)
    text = F.when(F.col("_w").isNotNull(), F.array_join(F.concat(head, repeated), " ")).otherwise(F.col("_text"))
    return rows.select(F.col("_id").alias(id_col), text.alias(text_col))
