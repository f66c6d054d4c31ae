"""Token counts (operator 10).

Texts of more than chunk characters are encoded in chunks that overlap, with offsets; neighbours are spliced
at a boundary that both encodings have and that is proven stable: a non-space character on its left and a
white space on its right. No piece that byte-level cutting makes spans such a place, and cutting from there on
doesn't depend on what stands before it, so the tokens on either side are those of the whole text. Where the
overlap holds no such place, it is doubled, up to the rest of the text. A chunk goes to the tokenizer whole.
Shorter texts are one chunk; their stable places cut them into words, and the tokenizer is asked once for each word
that a worker doesn't remember (a bounded number of them).

No shuffle; memory follows the longest text, not its tokens. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows
and rows without an id are counted each on its own; an empty table gives an empty result. A tokenizer of another
kind than byte-level (no proof of stability) encodes every text whole. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

CHUNK, OVERLAP, REMEMBERED = 1 << 13, 1 << 8, 500_000
_STABLE = re.compile(r"(?<=\S)(?=\s)")
#: A space here isn't the last of its run of white space, so text can't be cut before it.
_UNSAFE_SPACE = re.compile(r" (?:\s|\Z)")


@lru_cache(maxsize=2)
def counter(path: str) -> "Counter":
    return Counter(path)


class Counter:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.byte_level = False
        self.sizes: dict[str, int] = {}  # of words, with the space before them
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tokenizer = None
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cutter, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        self.byte_level = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)

    def whole(self, texts: list[str]) -> list[int]:
        if self.tokenizer is None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        if not self.byte_level:
            return self.whole(texts)
        out, odd, short = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            if len(text) > chunk:
                out[k] = self.spliced(text, chunk, overlap)
            elif _UNSAFE_SPACE.search(text):
                odd.append(k)
            else:
                short.append((k, _words(text)))
        for k, n in zip(odd, self.whole([texts[k] for k in odd])):
            out[k] = n
        if len(self.sizes) > REMEMBERED:
            self.sizes.clear()
        new = list({w for _, words in short for w in words if w not in self.sizes})
        self.sizes.update(zip(new, self.whole(new)))
        for k, words in short:
            out[k] = sum(map(self.sizes.__getitem__, words))
        return out

    def _offsets(self, text: str, start: int, end: int) -> np.ndarray:
        """Where the tokens of text[start:end] begin and end: one row a token."""
        return start + np.array(self.tokenizer.encode(text[start:end], add_special_tokens=False).offsets, np.int64).reshape(-1, 2)

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        total, n = 0, len(text)
        at, end = 0, min(n, chunk)  # tokens before `at` are counted; spans cover [at, end)
        spans = self._offsets(text, at, end)
        while end < n:
            width = overlap
            while True:
                low = max(at, end - width)
                if low == at:  # the overlap has reached what is already settled: widen to the right
                    end = min(n, end + width)
                    spans = self._offsets(text, at, end)
                    if end == n:
                        return total + len(spans)
                new_end = min(n, max(low, end - width) + chunk + width)
                new = self._offsets(text, low, new_end)
                splice = self._common(text, low, end, spans, new)
                if splice is not None:
                    break
                width *= 2
            total += int((spans[:, 0] < splice).sum())
            spans, at, end = new[new[:, 0] >= splice], splice, new_end
        return total + len(spans)

    @staticmethod
    def _common(text: str, low: int, end: int, spans: np.ndarray, new: np.ndarray) -> int | None:
        """The first stable place in (low, end) where both encodings have a boundary."""
        left, right = (set(v[(v > low) & (v < end)].tolist()) for v in (spans[:, 1], new[:, 0]))
        return next((m.start() for m in _STABLE.finditer(text, low + 1, end) if m.start() in left and m.start() in right), None)


def _words(text: str) -> list[str]:
    """The text cut before each space."""
    first, *rest = text.split(" ")
    return [first, *(" " + w for w in rest)] if first else [" " + w for w in rest]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = pc.fill_null(batch.column(1), "")
        return {"id": batch.column(0), "n_bytes": pc.binary_length(texts), "n_tokens": counter(path).counts(texts.to_pylist(), chunk, overlap)}

    kind = dict(docs.dtypes)[id_col]
    out = mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
