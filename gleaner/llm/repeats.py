"""Substring dedup (operator 7): words covered by a repeat of `length` words that starts earlier.

Fixed-block anchors. Every document is cut into non-overlapping reference blocks of block words
(block = length // 2, so that any window of length words holds a whole block of whatever document).
Every rolling window of block words probes the index of blocks. Where a probe meets a block of another
place, all windows of length words around it are candidates; they are compared whole, by a 128-bit
hash, and an occurrence that isn't the first one goes. Windows that touch or overlap join to maximal
repeats.

How it runs. A task hashes its documents in batches and sends, for each range of hashes, one packed row:
each hash once per batch, with the batch's first place. A batch knows by itself which of its own places
repeat, so a passage that a third of all documents hold costs one entry a batch, not one a document; of
exact copies in a batch only the first is hashed at all, the later ones are known to repeat whole.
Ranges are as many as the input is large, and so are the shares that documents are dealt into by id: what
a range finds goes back as one packed row a share, where it meets the share's texts. Hits are written to
the shared folder, so lost executors don't repeat the search.

Nulls and empty texts have no words: nothing is removed, the digest is of the empty text. A row without
an id is kept as it is and matched with nothing. A repeated row (same id, same text) is one document;
rows that share an id but not a text share their places. A text of any length is one row of a batch. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .shared import WORDS, WordHashes, mixed, rolling, settle

LENGTH = 20
#: Words hashed at a time in one task; bounds its memory (about 60 bytes a word).
BATCH_WORDS = 1 << 20
#: Text bytes for each range of hashes.
RANGE_BYTES = 8 << 20
#: Anchors need no more of a hash; a chance meeting only makes a candidate that the whole window then refutes.
ANCHOR_BITS = np.uint64(0xFFFF_FFFF_FFFF_0000)
_ZSTD = pa.Codec("zstd", compression_level=1)


def _squeezed(planes: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(planes).tobytes()
    return len(raw).to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def _raw(data: bytes) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True), np.uint8)


def _packed(values: np.ndarray) -> bytes:
    """Integers that rise, as byte planes of their differences, compressed."""
    return _squeezed(np.diff(values.astype(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_raw(data).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """32-bit integers as byte planes, compressed."""
    return _squeezed(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_raw(data).reshape(4, -1).T).view(np.uint32).reshape(-1).astype(np.int64)


class _Batches:
    """Gathers documents' windows and, when enough, turns them into packed rows."""

    def __init__(self, width: int, ranges: int, anchors: bool) -> None:
        self.width, self.ranges, self.anchors = width, ranges, anchors
        self.clear()

    def clear(self) -> None:
        self.ids: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.second: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.count = 0
        self.seen: dict[bytes, int] = {}  # text -> which of the documents
        self.whole: set[int] = set()

    def known(self, doc: int, text: str) -> bool:
        """Whether the batch holds the text already; the copy with the least id stands for all."""
        key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        k = self.seen.get(key)
        if k is None:
            self.seen[key] = len(self.ids)
            return False
        if doc != self.ids[k]:
            self.whole.add(max(doc, self.ids[k]))
            self.ids[k] = min(doc, self.ids[k])
        return True

    def add(self, doc: int, starts: np.ndarray, hashes: np.ndarray, second: np.ndarray | None) -> None:
        self.ids.append(doc)
        self.starts.append(starts)
        self.hashes.append(hashes)
        if second is not None:
            self.second.append(second)
        self.count += len(starts) + 8

    def rows(self) -> Iterator[dict]:
        """range, hash (first half), second half, docs, place of the first occurrence, its flag; and the
        places that repeat within the batch."""
        if not self.count:
            return
        whole = sorted(self.whole)
        order_of_doc = np.argsort(np.array(self.ids, np.int64), kind="stable")
        docs = np.array(self.ids, np.int64)[order_of_doc]
        h = np.concatenate([self.hashes[k] for k in order_of_doc])
        doc = np.repeat(np.arange(len(docs)), [len(self.starts[k]) for k in order_of_doc])
        start = np.concatenate([self.starts[k] for k in order_of_doc]).astype(np.uint64)
        second = np.concatenate([self.second[k] for k in order_of_doc]) if self.second else None
        self.clear()
        if not len(h):
            return
        order = np.argsort(h, kind="stable") if second is None else np.lexsort((second, h))
        h, doc, start = h[order], doc[order], start[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if second is not None:
            second = second[order]
            new[1:] |= second[1:] != second[:-1]
        group = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        several = np.bincount(group)[group] > 1
        if self.anchors:  # every place with a repeated block is a hit; later ones aren't worse than the first
            is_block = np.maximum.reduceat((start % self.width == 0).astype(np.uint8), firsts)
            local = several & ~new
        else:
            is_block, local = np.zeros(len(firsts), np.uint8), ~new
        mine = self.ranges_of(h)
        first_range, own = mine[firsts], np.flatnonzero(local)
        own_range = mine[own]
        for r in np.unique(mine):
            a, b = np.searchsorted(first_range, [r, r + 1])
            f = firsts[a:b]
            c, d = np.searchsorted(own_range, [r, r + 1])
            o = own[c:d]
            used = np.unique(np.concatenate([doc[f], doc[o]]))
            yield {
                "range": int(r), "docs": _packed(docs[used].view(np.uint64)), "h": _packed(h[f]), "h2": b"" if second is None else second[f].tobytes(),
                "doc": _planes(np.searchsorted(used, doc[f])), "start": _planes(start[f]), "flags": (is_block[a:b] | several[f] << 1).astype(np.uint8).tobytes(),
                "own_doc": _planes(np.searchsorted(used, doc[o])), "own_start": _planes(start[o]), "whole": None,
            }
        if whole:
            yield {"range": whole[0] % self.ranges, "whole": whole}

    def ranges_of(self, h: np.ndarray) -> np.ndarray:
        """Equal shares of the hashes' space, in order."""
        return ((h >> np.uint64(32)) * np.uint64(self.ranges)) >> np.uint64(32)


PACKED = "range long, docs binary, h binary, h2 binary, doc binary, start binary, flags binary, own_doc binary, own_start binary, whole array<long>"
FOUND = "share long, docs binary, counts binary, starts binary, whole array<long>"


def _shares(texts: DataFrame) -> int:
    """How many ranges of hashes, and shares of documents, for texts of this size."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _prime(max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // RANGE_BYTES) + 1))


def _prime(n: int) -> int:
    """The least prime from n on: ids in steps then fill all shares, whatever the step."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _share_of(doc: Column, shares: int) -> Column:
    return F.pmod(doc, F.lit(shares))


def _met_ranges(packed: DataFrame, shares: int, anchors: bool) -> DataFrame:
    """(share, docs, counts, starts, whole): places of windows that occur elsewhere (anchors: a place and a
    block) or earlier; whole: exact copies of earlier documents."""
    schema = to_arrow_schema(StructType.fromDDL(FOUND))
    return packed.repartition(shares, "range").groupBy("range").applyInArrow(lambda table: _met(table, anchors, shares, schema), FOUND)


NOTHING = np.zeros(0, np.int64), np.zeros(0, np.uint64), None


def _rows(held: _Batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in held.rows():
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _met(table: pa.Table, anchors: bool, shares: int, schema: pa.Schema) -> pa.Table:
    """Puts the batches' entries of one range together. Entries are at most one a hash and batch."""
    hs, seconds, docs, starts, flags, own, whole = [], [], [], [], [], [], set()
    for batch in table.to_batches():
        for r in batch.to_pylist():
            if r["whole"]:
                whole.update(r["whole"])
                continue
            ids = _unpacked(r["docs"]).view(np.int64)
            hs.append(_unpacked(r["h"]))
            seconds.append(np.frombuffer(r["h2"], np.uint64))
            docs.append(ids[_from_planes(r["doc"])])
            starts.append(_from_planes(r["start"]))
            flags.append(np.frombuffer(r["flags"], np.uint8))
            own.append((ids[_from_planes(r["own_doc"])], _from_planes(r["own_start"])))
    every, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if hs:
        h, doc, start, flag = map(np.concatenate, (hs, docs, starts, flags))
        second = None if anchors else np.concatenate(seconds)
        order = np.lexsort((start, doc, h)) if anchors else np.lexsort((start, doc, second, h))
        h, doc, start, flag = h[order], doc[order], start[order], flag[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if second is not None:
            second = second[order]
            new[1:] |= second[1:] != second[:-1]
        group, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
        if anchors:
            places = np.bincount(group) + np.bincount(group, weights=flag >> 1 & 1)
            blocks = np.bincount(group, weights=flag & 1) > 0
            hit = ((places > 1) & blocks)[group]
        else:
            first = firsts[group]  # a repeated row holds the first place once more
            hit = (doc != doc[first]) | (start != start[first])
        every = np.concatenate([doc[hit], *(o[0] for o in own)])
        at = np.concatenate([start[hit], *(o[1] for o in own)])
    share = every % shares
    order = np.lexsort((at, every, share))
    every, at, share = every[order], at[order], share[order]
    copies = np.array(sorted(whole), np.int64)
    out: dict = {n: [] for n in ("share", "docs", "counts", "starts", "whole")}
    for k in np.union1d(share, copies % shares).tolist():
        a, b = np.searchsorted(share, [k, k + 1])
        docs_of, counts = np.unique(every[a:b], return_counts=True)
        out["share"].append(k)
        out["docs"].append(_packed(docs_of.view(np.uint64)))
        out["counts"].append(_planes(counts))
        out["starts"].append(_planes(at[a:b]))
        out["whole"].append(copies[copies % shares == k].tolist())
    return pa.table(out, schema=schema)


def _places(found: pa.Table) -> tuple[dict[int, np.ndarray], set[int]]:
    """Places by document, and the copies, of one share's rows."""
    docs, places, whole = [], [], set()
    for r in found.to_pylist():
        whole.update(r["whole"] or ())
        docs.append(np.repeat(_unpacked(r["docs"]).view(np.int64), _from_planes(r["counts"])))
        places.append(_from_planes(r["starts"]))
    if not docs:
        return {}, whole
    doc, place = np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    ids, begin = np.unique(doc, return_index=True)
    return {i: place[a:b] for i, a, b in zip(ids.tolist(), begin, [*begin[1:], len(doc)])}, whole


_hashes = WordHashes(400_000)


def _word_hashes(words: list[str]) -> np.ndarray:
    return _hashes.of(words)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, int]:
    """(found, shares): found has packed rows a share of the documents (id modulo shares): the places (word
    numbers from 0) where a window of length words starts that also starts earlier, and the documents that
    are exact copies of earlier ones, all of whose windows do."""
    block = length // 2
    texts = _texts(docs, id_col, text_col).dropna()
    shares = _shares(texts)
    schema = to_arrow_schema(StructType.fromDDL(PACKED))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Batches(block, shares, True)
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for k, doc in enumerate(ids):
                text = column[k].as_py()
                if held.known(doc, text):
                    continue
                hashes = rolling(_word_hashes(WORDS.findall(text)), block) & ANCHOR_BITS
                held.add(doc, *((np.arange(len(hashes)), hashes, None) if len(hashes) > length - block else NOTHING))
                if held.count >= BATCH_WORDS:
                    yield from _rows(held, schema)
        yield from _rows(held, schema)

    hits = settle(_met_ranges(texts.mapInArrow(probe, PACKED), shares, True), "op7-hits")

    def candidates(own: pa.Table, found: pa.Table) -> pa.Table:
        places, whole = _places(found)
        held, out = _Batches(length, shares, False), []
        done: set[tuple[int, bytes]] = set()
        for k, doc in enumerate(own["doc"].to_pylist()):
            at = places.get(doc)
            if at is None or doc in whole:
                continue
            hashes = _word_hashes(WORDS.findall(own["text"][k].as_py()))
            n = len(hashes) - length + 1
            if n <= 0 or (key := (doc, hashes.tobytes())) in done:
                continue
            done.add(key)
            near = np.zeros(len(hashes) + length, np.int64)  # windows that hold a hit
            at = at[at < len(hashes)]
            np.add.at(near, np.maximum(at - (length - block), 0), 1)
            np.add.at(near, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[:n] > 0)
            if len(starts):
                held.add(doc, starts, rolling(hashes, length)[starts], rolling(mixed(hashes ^ BASE_TWO), length)[starts])
        out += held.rows()
        return pa.Table.from_pylist(out, schema=schema)

    dealt = texts.withColumn("share", _share_of(F.col("doc"), shares)).repartition(shares, "share").groupBy("share")
    packed = dealt.cogroup(hits.repartition(shares, "share").groupBy("share")).applyInArrow(candidates, PACKED)
    found = settle(_met_ranges(packed, shares, False), "op7-repeats")
    return found.unionByName(hits.filter(F.size("whole") > 0).withColumns({n: F.lit(e) for n, e in zip(("docs", "counts", "starts"), (_packed(np.zeros(0, np.uint64)), _planes(np.zeros(0)), _planes(np.zeros(0))))})), shares


BASE_TWO = np.uint64(0xD6E8FEB86659FD93)


def _stay(n_words: int, at: np.ndarray | None, whole: bool, length: int) -> np.ndarray:
    """Which words no repeat covers."""
    if whole:
        return np.full(n_words, n_words < length)
    cover = np.zeros(n_words + length, np.int64)
    at = np.unique(at if at is not None else np.zeros(0, np.int64))
    at = at[at + length <= n_words]
    cover[at] += 1
    cover[at + length] -= 1
    return np.cumsum(cover)[:n_words] == 0


def _spaced(text: str, stay: np.ndarray) -> str:
    """The text without the words that go, each with the white space before it; the rest untouched."""
    words, out, at = list(WORDS.finditer(text)), [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[at : words[a - 1].end() if a else words[0].start()])
        at = words[b - 1].end()
    return "".join([*out, text[at:]])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, spacing: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: (id, n_words, n_removed, kept) and the columns named in keep. kept is the text without the covered words:
    with its own white space (null for null), or with spacing=False the words joined by one space."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be an integer")
    if clash := {id_col, "n_words", "n_removed", "kept"} & set(keep):
        raise ValueError(f"columns of the result can't be kept under their names: {sorted(clash)}")
    found, shares = repeats(docs, id_col=id_col, text_col=text_col, length=length)
    more = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("boolean")
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), more.alias("more"))
    # A row without an id has no places, so any share will do.
    own = own.withColumn("share", _share_of(F.coalesce("doc", F.xxhash64("text")), shares))
    schema = StructType([*StructType.fromDDL("doc long, n_words long, n_removed long, kept string"), StructField("more", own.schema["more"].dataType)])
    arrow = to_arrow_schema(schema)

    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        places, whole = _places(found)
        words_of, gone_of, kept = [], [], []
        for k, doc in enumerate(rows["doc"].to_pylist()):
            text = rows["text"][k].as_py()
            words, gone = WORDS.findall(text or ""), 0
            if doc in whole or doc in places:
                stay = _stay(len(words), places.get(doc), doc in whole, length)
                gone = int(len(words) - stay.sum())
            words_of.append(len(words))
            gone_of.append(gone)
            if spacing:
                kept.append(_spaced(text, stay) if gone else text)
            else:
                kept.append(" ".join([w for w, s in zip(words, stay) if s] if gone else words))
        columns = [rows["doc"], pa.array(words_of, pa.int64()), pa.array(gone_of, pa.int64()), pa.array(kept, pa.string()), rows["more"]]
        return pa.table([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    dealt = own.repartition(shares, "share").groupBy("share").cogroup(found.repartition(shares, "share").groupBy("share"))
    done = dealt.applyInArrow(cut, schema)
    return done.select(F.col("doc").cast(kind).alias(id_col), "n_words", "n_removed", "kept", *(F.col("more")[c].alias(c) for c in keep))
