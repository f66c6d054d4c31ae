"""BPE and token counts against the tokenizers library."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gleaner.llm import bpe, tokencount  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "<|endoftext|>", "é", "ß", "日本", "'s", "'ll", "1", "23", "!!", "…", "　", "\t", "\r\n", "_", "²", "Ⅷ", "\x85", "\xa0", "é", "🙂", "the", " the", "aaaa", "‍", "\x1c", "word's", "***"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_round_trip(library):
    codec = bpe.codec(PATH)
    for t in texts(3000, 1):
        ids = codec.encode(t)
        assert list(ids) == library.encode(t, add_special_tokens=False).ids, t
        assert codec.decode(ids) == library.decode(list(ids), skip_special_tokens=False) == t


@pytest.mark.parametrize("t", ["a" * 20000, "ab" * 9000, "é" * 3000, "the " * 5000, " " * 3000, "日本" * 4000])
def test_long_texts(library, t):
    n = len(library.encode(t, add_special_tokens=False).ids)
    assert list(bpe.codec(PATH).encode(t)) == library.encode(t, add_special_tokens=False).ids
    assert tokencount.counter(PATH).counts([t], 1000, 16) == [n]


def test_splicing_gives_the_whole_count(library):
    c = tokencount.counter(PATH)
    for t in texts(1500, 2):
        assert c.counts([t], 8, 3) == [len(library.encode(t, add_special_tokens=False).ids)], t


def test_sentencepiece_counts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokencount.counter(path).counts(["Hello  world", "", "日本"], 8, 3) == [len(sp.encode(t)) for t in ("Hello  world", "", "日本")]


def test_partial_ids_decode_like_the_library(library):
    codec, ids = bpe.codec(PATH), library.encode("日本🙂é", add_special_tokens=False).ids
    import numpy as np

    for k in range(len(ids) + 1):
        assert codec.decode(np.array(ids[:k], np.int64)) == library.decode(ids[:k], skip_special_tokens=False)


def test_rows(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (1, "Hello world", "x"), (None, " a", "z"), (4, "word " * 30000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column named as one of ours
    got = bpe.digests(bpe.encode_decode(docs, PATH)).collect()
    want = sorted((r[0] if r[0] is not None else -1, len(library.encode(r[1] or "").ids), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.decoded_sha256) for r in got) == want
    two = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(r.text for r in two.collect()) == sorted(r[1] or "" for r in rows)
    counts = tokencount.count_tokens(docs, PATH).collect()
    assert sorted((r.n_tokens, r.n_bytes, r.over_limit) for r in counts) == sorted((len(library.encode(r[1] or "").ids), len((r[1] or "").encode()), len(library.encode(r[1] or "").ids) > 512) for r in rows)
    empty = docs.limit(0)
    assert bpe.encode_decode(empty, PATH).count() == 0 and tokencount.count_tokens(empty, PATH).count() == 0


def test_longer_documents_are_spliced(library, monkeypatch):
    """At the size that is used, on texts that hold every kind of part."""
    c, calls = tokencount.counter(PATH), []
    common = tokencount.Counter._common
    monkeypatch.setattr(tokencount.Counter, "_common", staticmethod(lambda *a: calls.append(common(*a)) or calls[-1]))
    rng = random.Random(3)
    long = ["".join(rng.choices(PARTS, k=9000)), "word " * 9000, " ".join(rng.choices(PARTS, k=20000))]
    assert c.counts(long, tokencount.CHUNK, tokencount.OVERLAP) == [len(library.encode(t, add_special_tokens=False).ids) for t in long]
    assert sum(x is not None for x in calls) > 10
