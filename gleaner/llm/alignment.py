"""Cross-tokenizer alignment (operator 11): tokens of one text by two tokenizers, matched by the bytes that they cover.

Tokenizer A is a byte-level one of the tokenizers library, B a sentencepiece model that puts a space before the text; A gets
the text with that space. Where tokens end comes from the libraries: character offsets of A, spans of B's proto (of bytes). These are
coarse: tokens that cut a character all carry the whole character's offsets, and byte-fallback tokens but the last have empty spans. Such
tokens are placed by the bytes that they decode to. Places where a token of A and one of B both end cut the tokens into groups; the
two tokens that end there are linked.

Text is cut before a space that has neither a space before it nor white space behind it. No token of either tokenizer spans such
a place, nor do tokens on one side depend on the other (B has no piece with a space inside; checked when it is loaded), so what a
word's tokens are doesn't depend on its neighbours, and each worker remembers a bounded number of them. Texts whose words hold U+2581, which B can't tell from a
space, and models with such pieces, take the same way as one word.

Counts of linked id pairs: the rows are dealt into pieces of about PIECE bytes of text as they are read. A piece numbers its
distinct words and pairs; its documents are numbers of words, its words are numbers of pairs. Pair counts of all pieces are added up, the most
frequent partner of each B id is found, and the totals go back to the pieces that asked for them, where they add up by word and then by document. So a pair that every document holds is one row a piece, and nothing is broadcast.

A text that is null, empty, or that the joined bytes of A's or B's tokens don't give back, has no tokens: all numbers are 0 and groups are
''. Repeated rows and rows without an id count each on its own; an empty table gives an empty result; extra columns aren't read. Memory
follows a piece: its text, its links and the totals of its pairs; the longest text is a piece at least.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

PIECE, REMEMBERED, LONG, JOINED = 4 << 20, 200_000, 64, 2000
SPACE = "▁"
#: Numbers of pairs are smaller.
WORDS_AT = 1 << 32


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


#: Tokens of a word (with the space before it), or of a whole text: numbers of tokens of A and B, ids of the groups, pairs, and whether the
#: tokens give its bytes back.
Word = tuple[int, int, str, tuple[int, ...], bool]
NOTHING: Word = (0, 0, "", (), False)


def grouped(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(groups, pairs, ends) of tokens and where they end: a group is a1,a2|b1, a pair a << 32 | b of the two tokens that end with it."""
    x, y = np.array(ends_a, np.int64), np.array(ends_b, np.int64)
    i = np.flatnonzero(np.isin(x, y, assume_unique=True))
    j = np.searchsorted(y, x[i])
    one, two = list(map(str, a)), list(map(str, b))
    groups, from_a, from_b = [], 0, 0
    for p, q in zip((i + 1).tolist(), (j + 1).tolist()):
        groups.append(f"{one[from_a] if p - from_a == 1 else ','.join(one[from_a:p])}|{two[from_b] if q - from_b == 1 else ','.join(two[from_b:q])}")
        from_a, from_b = p, q
    return groups, np.array(a, np.int64)[i] << 32 | np.array(b, np.int64)[j], x[i]


def whole_word(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> Word:
    if not a:
        return NOTHING
    groups, pairs, _ = grouped(a, ends_a, b, ends_b)
    return len(a), len(b), ";".join(groups), tuple(pairs.tolist()), True


class Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, thing: str) -> int:
        n = self[thing] = len(self)
        return n


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> "Aligner":
    return Aligner(path_a, path_b)


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters, added = byte_of_letter(), self.a.get_added_tokens_decoder()
        self.bytes_a = {i: added[i].content.encode() if i in added else bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.fallback = frozenset(i for i in range(n) if self.b.is_byte(i))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if i in self.fallback else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        #: No piece goes on after a space that follows something else, so text can be cut there.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.words: dict[str, Word] = {}

    def spans(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
        """(ids of A, ends, ids of B, ends) of texts without their space; ends count bytes, the space included. A text whose bytes the tokens don't
        give back has no tokens."""
        full = [" " + t for t in texts]
        protos = self.b.encode(texts, return_type="proto", num_threads=1)
        for text, one, two in zip(full, self.a.encode_batch(full, add_special_tokens=False), protos):
            raw, a, pieces = text.encode(), one.ids, two.pieces
            b, spans = [p.id for p in pieces], [p.end for p in pieces]
            if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                yield [], [], [], []
            else:
                yield a, self._ends_a(text, a, one.offsets), b, self._ends_b(b, spans)

    def _ends_a(self, text: str, ids: list[int], offsets: list[tuple[int, int]]) -> list[int]:
        ends = [e for _, e in offsets]
        if text.isascii():
            return ends
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
        cuts = [k for k in range(len(ids) - 1) if offsets[k + 1][0] < ends[k]]  # the next token is of the same character
        ends = at[ends].tolist()
        for k in cuts:
            ends[k] = (ends[k - 1] if k else 0) + len(self.bytes_a[ids[k]])
        return ends

    def _ends_b(self, ids: list[int], spans: list[int]) -> list[int]:
        ends = [e + 1 for e in spans]  # behind the space that B adds
        if not self.fallback.isdisjoint(ids):
            for k, i in enumerate(ids):
                if i in self.fallback:
                    ends[k] = (ends[k - 1] if k else 0) + 1
        return ends

    def encoded(self, words: list[str]) -> list[Word]:
        """Words, encoded by the libraries many in one text, since a call costs more than a word. A word that ends in white space would run
        into the next one and goes alone."""
        out: list[Word] = [NOTHING] * len(words)
        alone, lots, lot, size = [], [], [], 0
        for k, w in enumerate(words):
            if not self.by_word or SPACE in w or not w or w[-1].isspace():
                alone.append(k)
                continue
            lot.append(k)
            size += len(w)
            if size >= JOINED:
                lots.append(lot)
                lot, size = [], 0
        if lot:
            lots.append(lot)
        for lot, tokens in zip(lots, self.spans([" ".join([words[k] for k in lot]) for lot in lots])):
            if not tokens[0]:
                alone += lot  # the bytes of the whole don't come back
            else:
                for k, word in zip(lot, self._apart([words[k] for k in lot], *tokens)):
                    out[k] = word
        for k, tokens in zip(alone, self.spans([words[k] for k in alone])):
            out[k] = whole_word(*tokens)
        return out

    @staticmethod
    def _apart(words: list[str], a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> Iterator[Word]:
        """The words of a text of several."""
        groups, pairs, ends = grouped(a, ends_a, b, ends_b)
        stops = np.cumsum([1 + (len(w) if w.isascii() else len(w.encode())) for w in words])
        to = [np.searchsorted(e, stops, "right").tolist() for e in (ends_a, ends_b, ends)]
        pairs = pairs.tolist()
        from_a = from_b = from_g = 0
        for i, j, g in zip(*to):
            yield i - from_a, j - from_b, groups[from_g] if g - from_g == 1 else ";".join(groups[from_g:g]), tuple(pairs[from_g:g]), True
            from_a, from_b, from_g = i, j, g

    def cut(self, text: str) -> list[str]:
        """Words of the text, without the space before each."""
        if not self.by_word or SPACE in text:
            return [text]
        parts = text.split(" ")
        if "" not in parts and not any(p[0].isspace() for p in parts):
            return parts
        out, empty = parts[:1], parts[0] == ""
        for p in parts[1:]:
            if p == "" or empty or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
            empty = p == ""
        return out

    def align(self, texts: list[str]) -> tuple[list[Word], list[list[int]]]:
        """(words, numbers): the distinct words of the texts, and which of them make each text; none if it has no tokens."""
        number = Numbers()
        made = [list(map(number.__getitem__, self.cut(t))) if t else [] for t in texts]
        every, long = list(number), {}
        if len(self.words) > REMEMBERED:  # words that these texts hold several times are likely to come again
            times = np.bincount(np.fromiter(chain.from_iterable(made), np.int64), minlength=len(every))
            self.words = {every[k]: self.words[every[k]] for k in np.flatnonzero(times > 1).tolist() if every[k] in self.words}
        known = self.words
        new = [w for w in every if w not in known]
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            for w, found in zip(some, self.encoded(some)):
                (known if len(w) <= LONG else long)[w] = found
        words = [known[w] if w in known else long[w] for w in every]
        odd = {k for k, w in enumerate(words) if not w[4]}
        if odd:
            for k, numbers in enumerate(made):
                if not odd.isdisjoint(numbers):  # the whole text's bytes decide
                    word = whole_word(*next(self.spans([texts[k]])))
                    made[k] = [len(words)] if word[4] else []
                    words += [word] * word[4]
        return words, made


def alignments(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, ends_a, b, ends_b): ids of the tokens and where in the bytes of space + text they end."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    ints = ("a", "ends_a", "b", "ends_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                spans = [next(aligner(path_a, path_b).spans([t])) if t else ([], [], [], []) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, pa.list_(pa.int64())) for v in zip(*spans))], ["id", *ints])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} array<long>" for c in ints)).withColumnRenamed("id", id_col)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PIECE bytes of text, by the sizes of its rows."""
    if not batch.num_rows:
        return
    sizes = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: batch.num_rows + 1]) if pa.types.is_string(batch.column(1).type) else np.full(batch.num_rows, batch.nbytes // batch.num_rows)
    number = np.cumsum(sizes, dtype=np.int64) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, which compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


PIECES = "piece long, id {kind}, n_a long, n_b long, n_groups long, groups string, words binary, sizes binary, codes array<long>, counts array<long>"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of so many values each, one after another."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _counted(docs: DataFrame, path_a: str, path_b: str, digest: bool, kind: str) -> DataFrame:
    """PIECES: a row for each document, whose words are numbers of words of its piece, and for each piece one with its distinct pairs and what
    its words are: how many pairs each has, and which (codes null in the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _pieces(batch):
                words, made = aligner(path_a, path_b).align(part.column(1).fill_null("").to_pylist())
                sizes = np.array([len(m) for m in made])
                flat = np.fromiter(chain.from_iterable(made), np.int64, int(sizes.sum()))
                times = np.bincount(flat, minlength=len(words))
                tokens_a, tokens_b, per_word = (np.array(v, np.int64) for v in ([w[0] for w in words], [w[1] for w in words], [len(w[3]) for w in words]))
                n_a, n_b, n_pairs = (_sums(v[flat], sizes) for v in (tokens_a, tokens_b, per_word))
                codes = np.fromiter(chain.from_iterable([w[3] for w in words]), np.int64, int(per_word.sum()))
                distinct, place = np.unique(codes, return_inverse=True)
                counts = np.bincount(place.ravel(), np.repeat(times, per_word), len(distinct)).astype(np.int64)
                rank = np.empty(len(words), np.int64)  # frequent words get small numbers
                order = np.argsort(-times, kind="stable")
                rank[order] = np.arange(len(words))
                links = place.ravel()[np.argsort(np.repeat(rank, per_word), kind="stable")]  # word by word, in the order of their ranks
                groups = [";".join([words[k][2] for k in m]) for m in made]
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                nothing = [None] * len(made)
                columns = [
                    pa.array([piece] * (len(made) + 1), pa.int64()), pa.concat_arrays([pa.nulls(1, part.column(0).type), part.column(0)]),
                    *(pa.array([None, *v.tolist()], pa.int64()) for v in (n_a, n_b, n_pairs)), pa.array([None, *groups], pa.string()),
                    pa.array([_planes(links), *map(_planes, np.split(rank[flat], np.cumsum(sizes)[:-1]))], pa.binary()), pa.array([_planes(per_word[order]), *nothing], pa.binary()),
                    pa.array([distinct.tolist(), *nothing], pa.list_(pa.int64())), pa.array([counts.tolist(), *nothing], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "id", "n_a", "n_b", "n_groups", "groups", "words", "sizes", "codes", "counts"])
                piece += 1

    return docs.mapInArrow(run, PIECES.format(kind=kind))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """(code, n, best): how often each pair of ids is linked in all documents, and whether no pair of its B id is so more often."""
    each = pieces.filter("codes is not null").select(F.explode(F.arrays_zip("codes", "counts")).alias("p")).select(F.col("p.codes").alias("code"), F.col("p.counts").alias("n"))
    totals = settle(each.groupBy("code").agg(F.sum("n").alias("n")), "op11-pairs")
    b = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = totals.groupBy(b).agg(F.max("n").alias("most"))
    return totals.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, *, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row: numbers of tokens, groups and links; links
    whose pair is linked no less often, in all documents, than any other pair of its B id; the sum of the links' counts; the groups' ids, or the
    SHA-256 of that text (with digest)."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = settle(_counted(read, path_a, path_b, digest, kind), "op11-pieces")
    asked = pieces.filter("codes is not null").select("piece", F.posexplode("codes").alias("number", "code"))
    answers = asked.join(pair_counts(pieces), "code")
    # Of a piece come first the answers, by the pairs' numbers, then its words, then its documents.
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    told = answers.select("piece", F.col("number").cast("long"), "n", "best", none("id", kind), *(none(c, "long") for c in NUMBERS[:3]), none("groups", "string"), none("words", "binary"), none("sizes", "binary"))
    place = F.when(F.col("codes").isNotNull(), WORDS_AT).otherwise(WORDS_AT + 1).cast("long")
    own = pieces.select("piece", place.alias("number"), none("n", "long"), none("best", "boolean"), "id", *NUMBERS[:3], "groups", "words", "sizes")
    rows = told.unionByName(own).repartition("piece").sortWithinPartitions("piece", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, n, best, sums, bests = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, stage = batch.column(0).to_numpy(), np.maximum(batch.column(1).to_numpy(), WORDS_AT - 1)
            turn = (keys[1:] != keys[:-1]) | (stage[1:] != stage[:-1])
            cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                part = batch.slice(a, z - a)
                if keys[a] != piece:
                    piece, n, best = keys[a], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                if stage[a] < WORDS_AT:
                    n.append(part.column(2).to_numpy())
                    best.append(part.column(3).to_numpy(zero_copy_only=False).astype(np.int64))
                elif stage[a] == WORDS_AT:  # what a word adds to its documents
                    links, sizes = _numbers(part.column(9)[0].as_py()), _numbers(part.column(10)[0].as_py()).astype(np.int64)
                    sums, bests = (_sums(np.concatenate(v)[links], sizes) for v in (n, best))
                    n, best = [], []
                else:
                    made = [_numbers(planes) for planes in part.column(9).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), part.column(6), part.column(7), part.column(7), *(pa.array([int(v[m].sum()) for m in made], pa.int64()) for v in (bests, sums)), part.column(8)], ["id", *NUMBERS, "groups"])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups string").withColumnRenamed("id", id_col)
