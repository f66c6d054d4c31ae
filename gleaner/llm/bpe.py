"""BPE encoding and decoding (operator 1).

Encoding is exact and takes one pass: an Aho-Corasick automaton gives the longest vocabulary entry at
each byte; entries are laid one after another, each checked against its left neighbour with a table of
pair compatibility (would the merges have left exactly this pair?); a misfit takes the next shorter
prefix, or goes back one entry, and an end once found impossible is never tried again. Decoding
gathers bytes through a table of offsets into the concatenated vocabulary.

No shuffle: texts are independent. Words repeat, so each Python worker remembers a bounded number of
words' ids. Nulls are empty texts; an empty text has no ids and decodes to "". Ties and repeated rows
are encoded each on its own. Columns other than id and text are ignored, so their names don't matter.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

#: How byte-level BPE cuts text before merging; fixed by the vocabulary's published format.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that stand for themselves in the published vocabulary; the others follow from U+0100 on.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: A space here isn't the last of its run of white space, so text can't be cut before it.
UNSAFE_SPACE = re.compile(r" (?:\s|\Z)")
#: Signs that, at the end of a word, are a piece of their own (none of them starts a contraction).
SIGNS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
REMEMBERED = 500_000


def byte_of_symbol() -> dict[str, int]:
    table = {chr(b): b for b in PLAIN_BYTES}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PLAIN_BYTES))})
    return table


class _Remembered(dict):
    """key -> make(key); forgets all when full."""

    def __init__(self, make, most: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Codec:
    """Byte-level BPE read from a tokenizers file whose ids are in order of merging."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, symbols = spec["model"], byte_of_symbol()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab = model["vocab"]
        texts = {i: "".join(chr(symbols[c]) for c in t) for t, i in vocab.items() if all(c in symbols for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: added tokens that take in their surroundings")
        for text, i in self.special.items():
            texts[i] = text.encode().decode("latin-1")
        count = max(texts) + 1
        own = {i for i in texts if i not in self.special.values()}
        self.left, self.right, self.joined = list(range(count)), list(range(count)), {}
        last = -1
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i = vocab[a + b]
            if i <= last:
                raise ValueError(f"{path}: ids aren't in order of merging")
            last = self.joined[vocab[a], vocab[b]] = i
            self.left[i], self.right[i] = vocab[a], vocab[b]
        self.id_of = {texts[i]: i for i in own}
        self.size = [len(texts.get(i, "")) for i in range(count)]
        self.shorter = [-1] * count
        for i in own:
            t = texts[i]
            self.shorter[i] = next((self.id_of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.id_of), -1)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.cut = regex.compile(CUT)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits = _Remembered(lambda pair: self._compatible(*pair))
        self.piece_ids = _Remembered(self.encode_piece, REMEMBERED // 4)
        self.run_ids = _Remembered(self._run)
        self.next_ids = _Remembered(self._next_run)
        joined = b"".join(texts.get(i, "").encode("latin-1") for i in range(count))
        self.bytes, self.sizes = np.frombuffer(joined, np.uint8), np.array(self.size, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together ends with a and b. Undoes the younger of
        the two entries at the seam; an earlier merge across the seam would have come first."""
        before = 1 << 62
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            for left_side in (True, False) if a > b else (False, True):
                if left_side:
                    inner, before_then = self.right[a], a
                else:
                    inner, before_then = self.left[b], b + 1
                if inner != (a if left_side else b):
                    break
            else:
                return True
            before = before_then
            if left_side:
                a = inner
            else:
                b = inner

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of text, after cutting."""
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.id_of.get(s)
        if whole is not None:
            return [whole]
        n, size, shorter, fits = len(s), self.size, self.shorter, self.fits
        longest = [-1] * n
        for end, i in self.automaton.iter(s):  # ends rise, so the last one stored for a start is the longest
            longest[end + 1 - size[i]] = i
        open_end, out, at, entry = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        while True:
            end = at + size[entry]
            if open_end[end] and (not out or fits[out[-1], entry]):
                out.append(entry)
                if end == n:
                    return out
                at, entry = end, longest[end]
                continue
            entry = shorter[entry]
            while entry < 0:
                open_end[at] = 0
                last = out.pop()
                at -= size[last]
                entry = shorter[last]

    def _run(self, run: str) -> bytes:
        ids: list[int] = []
        for piece in self.cut.findall(run):
            ids += self.piece_ids[piece] if len(piece) < 100 else self.encode_piece(piece)
        return array("I", ids).tobytes()

    def _next_run(self, run: str) -> bytes:
        """As _run(" " + run); a word of letters, with or without signs behind it, needs no cutting."""
        if run.isalpha():
            return array("I", self.encode_piece(" " + run)).tobytes()
        word = run.rstrip(SIGNS)
        if word.isalpha():
            return array("I", self.piece_ids[" " + word] + self.piece_ids[run[len(word) :]]).tobytes()
        return self._run(" " + run)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if UNSAFE_SPACE.search(text):
            return self._run(text)
        runs = text.split(" ")  # a cut before a space that ends its run of white space never moves
        head = self.run_ids[runs[0]] if len(runs[0]) < 100 else self._run(runs[0])
        if max(map(len, runs)) < 100:
            return head + b"".join(map(self.next_ids.__getitem__, runs[1:]))
        return head + b"".join(self.next_ids[r] if len(r) < 100 else self._run(" " + r) for r in runs[1:])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.at_special is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), np.uint32)
        return np.frombuffer(b"".join(np.uint32(self.special[p]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(self.at_special.split(text))), np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        out = []
        for k in range(0, len(ids), 1 << 18):
            part = ids[k : k + (1 << 18)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            if len(ends) and ends[-1]:
                out.append(self.bytes[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _ids_array(all_ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, all_ids)])
    flat = np.concatenate(all_ids).astype(np.int32) if all_ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of docs."""

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        return {"id": batch.column(0), "ids": _ids_array([c.encode(t) for t in batch.column(1).to_pylist()])}

    kind = dict(docs.dtypes)[id_col]
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row; null ids are no ids. An id outside the vocabulary is an error."""

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        return {"id": batch.column(0), "text": [c.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]}

    kind = dict(coded.dtypes)[id_col]
    return mapped(coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), work, f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): encoding and decoding in one pass over the rows."""

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        ids = [c.encode(t) for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "ids": _ids_array(ids), "decoded": [c.decode(i) for i in ids]}

    kind = dict(docs.dtypes)[id_col]
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and SHA-256 of the joined ids and of the decoded text, from encode_decode()."""
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
