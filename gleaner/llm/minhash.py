"""MinHash near-dedup (operator 3).

1. Each text becomes its set of word shingles, kept as 64-bit hashes; a task returns per document the
   set's size, its 128-bit digest, band keys and a signature: the minima of universal hash functions
   (multiply, add, take the upper bits), one byte each for estimates.
2. Documents with the same set are one class, combined before the shuffle; from here on a class is its
   least document. Links are between classes, so thousands of copies cost one row.
3. Classes that share a band key are candidates. Buckets with the same members are one bucket. Its least
   member is the bucket's lead.
4. Stars: each class is confirmed on the full sets against one lead, the one it shares most bands with. A lead's
   members are dealt into slices, so no lead meets all of them in one task. Links found join into components.
   A bucket whose members are one component is done: a template with very many near copies ends here, at a
   cost that follows its members.
5. The rest: in each bucket that still has several components all pairs between different ones are held against
   each other, by signatures. Members of the lead's component meet the other members only, and these meet
   each other, in slices; each pair of slices is a unit of work. Documents that have a pair left meet again with
   their texts, and the unit confirms all these pairs on the full sets, unless links have joined the two already.
6. Components by alternating large-star and small-star.

Loss. A pair at the threshold shares no band with chance (1 - s^5)^32: 2e-8 at 0.85, 4e-6 at 0.8. Step 5 leaves
out pairs whose signatures agree in so few places that a pair at the threshold has a chance of at most MISSED
(1e-9, from the exact binomial distribution) to do so. Nothing else is left out.

Null texts and texts without words have an empty set and no links. Fewer words than the width: the
whole sequence is the one shingle. A text of any length is one set; sets, not texts, bound a unit. Rows without
an id get no component and are kept. A repeated row gets the same result each time. Where rows share an id but
not a text, each row has the component of its own text, and the id's least text is what is confirmed. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import WORDS, WordHashes, lowered, mapped, rolling, settle

WIDTH, BANDS, ROWS, FUNCTIONS = 5, 32, 5, 200
#: Members of a bucket, and shingles of them, that one side of a unit of work holds.
SLICE, SLICE_SHINGLES = 1024, 1 << 20
#: Chance that a pair at the threshold is left out for its signatures.
MISSED = 1e-9

_factors = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 63, (2, FUNCTIONS), np.uint64)
_TIMES, _PLUS = _factors[0] * np.uint64(2) + np.uint64(1), _factors[1]
_hashes = WordHashes()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles as sorted hashes."""
    words = WORDS.findall(lowered(text or ""))
    return np.unique(rolling(_hashes.of(words), min(width, len(words)))) if words else np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    least = np.full(FUNCTIONS, np.uint64(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[None, at : at + 2048] * _TIMES[:, None]
            part += _PLUS[:, None]
            np.minimum(least, part.min(axis=1) >> np.uint64(32), out=least)  # the shift keeps the order
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    used = least[: BANDS * ROWS].astype(np.uint32).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(used)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(doc, n, digest, signature, keys) for every row."""

    def work(batch: pa.RecordBatch) -> dict:
        out = {"doc": batch.column(0), "n": [], "digest": [], "signature": [], "keys": []}
        made: dict[bytes, tuple] = {}
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(text, width)
            out["n"].append(len(shingles))
            digest = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None
            if digest is not None and digest not in made:
                least = minima(shingles)
                made[digest] = least.astype(np.uint8).tobytes(), _band_keys(least)
            out["digest"].append(digest)
            signature, keys = made.get(digest, (None, None))
            out["signature"].append(signature)
            out["keys"].append(None if keys is None else keys.tolist())
        return out

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), work, "doc long, n long, digest binary, signature binary, keys array<long>")


def least_agreement(threshold: float, missed: float = MISSED) -> int:
    """The most places in which signatures must agree so that a pair at the threshold agrees in fewer with a chance of
    at most missed. Each of FUNCTIONS places agrees with chance threshold or more."""
    below = 0.0
    for k in range(FUNCTIONS + 1):
        below += math.comb(FUNCTIONS, k) * threshold**k * (1 - threshold) ** (FUNCTIONS - k)
        if below > missed:
            return k
    return FUNCTIONS


def _pairs(signature: np.ndarray, n: np.ndarray, sides: np.ndarray | None, component: np.ndarray, agree: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others after i) of a unit's pairs between different components whose sizes and signatures allow the link."""
    for i in range(len(n) - 1):
        ok = (component[i + 1 :] != component[i]) & (np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i]))
        if sides is not None:
            ok &= sides[i + 1 :] != sides[i]
        others = i + 1 + np.flatnonzero(ok)
        if len(others):
            others = others[(signature[others] == signature[i]).sum(axis=1) >= agree]
        if len(others):
            yield i, others


class _Sets:
    """Disjoint sets of 0..count-1."""

    def __init__(self, count: int) -> None:
        self.up = list(range(count))

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.top(x), self.top(y)
        self.up[b] = a
        return a != b


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with the same bucket, i and j (the first three columns), which come one after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[a])
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


UNIT = "bucket long, i int, j int, slice int, doc long, n long, signature binary, component long"


def _unit(unit: pa.Table) -> tuple:
    """(order, documents, sizes, components, signatures, sides or None), in order of documents."""
    doc, n, component = (unit[c].to_numpy() for c in ("doc", "n", "component"))
    order = np.argsort(doc, kind="stable")
    signature = np.frombuffer(b"".join(unit["signature"].to_pylist()), np.uint8).reshape(-1, FUNCTIONS)[order]
    sides = unit["slice"].to_numpy()[order] if unit["i"][0].as_py() != unit["j"][0].as_py() else None
    return order, doc[order], n[order], component[order], signature, sides


def _together(units: DataFrame) -> DataFrame:
    return units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _enough(both, one, other, share: tuple[int, int]):
    return share[1] * both >= share[0] * (one + other - both)


def _stars(members: DataFrame, texts: DataFrame, share: tuple[int, int], width: int) -> DataFrame:
    """Edges (u, v): each class and the lead that it shares most bands with, if their full sets are similar."""
    chosen = members.filter("doc <> lead").groupBy("doc", "lead").agg(F.sum("weight").alias("w")).groupBy("doc").agg(F.max(F.struct("w", (-F.col("lead")).alias("m")))["m"].alias("m")).select("doc", (-F.col("m")).alias("lead"))
    slices = chosen.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    sent = chosen.join(slices, "lead").select("lead", F.pmod(F.xxhash64("doc"), F.col("slices")).cast("int").alias("slice"), "doc")
    leads = slices.select("lead", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("lead").alias("doc"))
    rows = sent.unionByName(leads).join(texts, "doc").select("lead", "slice", "doc", "text").repartition("lead", "slice").sortWithinPartitions("lead", "slice", F.col("doc") != F.col("lead"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            linked = []
            for lead, doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                mine = shingle_set(text.as_py(), width)
                if doc == lead:  # the first row of each slice
                    hub = mine
                linked.append(doc != lead and _enough(len(np.intersect1d(mine, hub, assume_unique=True)), len(mine), len(hub), share))
            kept = batch.filter(pa.array(linked, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2)], ["u", "v"])

    return rows.mapInArrow(confirm, "u long, v long")


def _open_units(members: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame:
    """Units of work (UNIT) of the buckets that still have several components."""
    placed = members.select("bucket", "doc").join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min(F.struct("doc", "component"))["component"].alias("main")).filter("a < b").select("bucket", "main")
    rows = settle(placed.join(several, "bucket").withColumn("minor", F.col("component") != F.col("main")).drop("main").join(classes.select("doc", "n", "signature"), "doc"), "op3-open")

    def slices(which: str) -> Column:
        return F.greatest(F.ceil(F.count_if(F.expr(which)) / SLICE), F.ceil(F.sum(F.when(F.expr(which), F.col("n")).otherwise(0)) / SLICE_SHINGLES)).cast("int")

    sizes = rows.groupBy("bucket").agg(slices("minor").alias("minors"), slices("not minor").alias("majors"))
    own = F.when(F.col("minor"), F.pmod(F.xxhash64("doc"), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("doc"), F.greatest("majors", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.col("minors") - 1 + F.when(F.col("minor"), F.col("majors")).otherwise(0))
    spread = rows.join(sizes, "bucket").withColumn("slice", own).withColumn("other", F.explode(others))
    return _together(spread.select("bucket", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "doc", "n", "signature", "component"))


def _links_left(units: DataFrame, texts: DataFrame, share: tuple[int, int], width: int) -> DataFrame:
    """Edges (u, v) between different components: every pair that the signatures allow is confirmed on the full
    sets, inside its unit, unless links of the unit have joined the two already."""
    threshold = share[0] / share[1]
    agree = least_agreement(threshold)

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            if len(unit) < 2:
                continue
            order, _, n, component, signature, sides = _unit(unit)
            held = np.zeros(len(n), bool)
            for i, others in _pairs(signature, n, sides, component, agree, threshold):
                held[i] = held[others] = True
            if held.any():
                yield from unit.take(pa.array(order[held])).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            order, doc, n, component, signature, sides = _unit(unit)
            sets = [shingle_set(t, width) for t in unit["text"].take(pa.array(order)).to_pylist()]
            joined, u, v = _Sets(len(doc)), [], []
            for i, others in _pairs(signature, n, sides, component, agree, threshold):
                top = joined.top(i)
                others = [j for j in others.tolist() if joined.top(j) != top]
                if not others:
                    continue
                lengths = np.array([len(sets[j]) for j in others])
                every = np.concatenate([sets[j] for j in others])
                at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
                both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum(lengths) - lengths)
                for k in np.flatnonzero(_enough(both, len(sets[i]), lengths, share)).tolist():
                    if joined.join(i, others[k]):
                        u.append(doc[i])
                        v.append(doc[others[k]])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    still_open = units.mapInArrow(open_rows, UNIT)
    return _together(still_open.join(texts, "doc").select(*(c.split()[0] for c in UNIT.split(", ")), "text")).mapInArrow(confirm, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (80, 100), width: int = WIDTH) -> DataFrame:
    """One row a document: (id, n_shingles, component_id, kept). share: (x, y) links documents with
    y * intersection >= x * union."""
    signed = settle(signatures(docs, id_col, text_col, width), "op3-signed")
    first = F.min(F.struct("doc", "n", "signature", "keys"))
    classes = settle(signed.filter("digest is not null and doc is not null").groupBy("digest").agg(first.alias("r")).select("digest", "r.*"), "op3-classes")
    bands = classes.select("doc", F.explode("keys").alias("bucket"))
    # A bucket is known by its members: how many, the least, and a digest of all.
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("lead"), F.bit_xor(F.xxhash64("doc")).alias("all")).filter("size > 1")
    single = buckets.groupBy("size", "lead", "all").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("weight")).select("bucket", "lead", "weight")
    members = settle(bands.join(single, "bucket").select("bucket", "lead", "weight", "doc"), "op3-members")
    wanted = members.select("doc").distinct().hint("merge")  # grows with the input, so it isn't broadcast at any size
    texts = settle(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")), "op3-texts")
    known = components(_stars(members, texts, share, width), "op3-first")
    rest = _links_left(_open_units(members, known, classes), texts, share, width)
    known = components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest), "op3-rest")
    ends = classes.select("digest", "doc").join(known.withColumnRenamed("node", "doc"), "doc", "left").select("digest", F.coalesce("component", "doc").alias("component_id"))
    # Rows without a set have no class; they don't go through the join, where they would all meet in one task.
    rows = signed.select("doc", "n", "digest")
    out = rows.filter("digest is not null").join(ends, "digest", "left").select("doc", "n", "component_id").unionByName(rows.filter("digest is null").select("doc", "n", F.lit(None).cast("long").alias("component_id")))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
