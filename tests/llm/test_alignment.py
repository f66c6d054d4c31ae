"""Alignment of two tokenizers against whole encodings and decoded bytes."""

import hashlib
import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from gleaner.llm import alignment, queries  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", " ", "  ", "\n", " \n ", "<|endoftext|>", "<s>", "<0x41>", "é", "日本", "𝄞", "🙂", "▁", "　", "\t", "\r\n", "\x00", "\x1c", "the", " the", "word's", "12", "ß", "é", "***", "\xa0", "Straße", "\x85"]


def key(row):
    return tuple((v is None, v) for v in row)


def plain(text):
    """(a, ends, b, ends) of the whole text by decoded bytes alone."""
    if not text:
        return [], [], [], []
    tool = alignment.aligner(A, B)
    a = tool.a.encode(" " + text, add_special_tokens=False).ids
    b = tool.b.encode(text, return_type=int)
    letters = alignment.byte_of_letter()
    raw_a = [bytes(letters[c] for c in tool.a.id_to_token(i)) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if tool.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tool.b.id_to_piece(i)]]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], [], [], []
    ends = []
    for raw in (raw_a, raw_b):
        at, out = 0, []
        for r in raw:
            at += len(r)
            out.append(at)
        ends.append(out)
    return a, ends[0], b, ends[1]


def brute(rows):
    """op11's rows by whole encodings."""
    found, count = [], Counter()
    for doc, text in rows:
        a, ea, b, eb = plain(text)
        at_a, at_b = dict(zip(ea, a)), dict(zip(eb, b))
        common = [e for e in ea if e in at_b]
        links = [(at_a[e], at_b[e]) for e in common]
        count.update(links)
        groups, low = [], 0
        for e in common:
            groups.append(",".join(str(i) for i, x in zip(a, ea) if low < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, eb) if low < x <= e))
            low = e
        found.append((doc, len(a), len(b), links, ";".join(groups)))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((doc, n_a, n_b, len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for doc, n_a, n_b, links, g in found), key=key)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 24))) for _ in range(n)]


def test_spans_of_the_libraries_are_those_of_the_decoded_bytes():
    tool = alignment.aligner(A, B)
    for t in texts(2000, 1):
        if t:
            assert next(tool.spans([t])) == plain(t), t


def test_words_give_what_whole_texts_give():
    tool = alignment.aligner(A, B)
    for t in texts(4000, 2):
        a, ea, b, eb = plain(t)
        _, _, groups, codes, _ = alignment.whole_word(a, ea, b, eb)
        words, made = tool.align([t])
        found = [words[k] for k in made[0]]
        assert ";".join(w[2] for w in found) == groups, t
        assert tuple(c for w in found for c in w[3]) == codes, t
        assert (sum(w[0] for w in found), sum(w[1] for w in found)) == (len(a), len(b)), t


@pytest.mark.parametrize("t", ["a" * 3000, "日本" * 900, "the " * 2000, " " * 500, "𝄞" * 300, "x" * 100 + " y " * 100])
def test_long_texts(t):
    a, ea, b, eb = plain(t)
    words, made = alignment.aligner(A, B).align([t])
    assert ";".join(words[k][2] for k in made[0]) == alignment.whole_word(a, ea, b, eb)[2]


def test_texts_together_give_what_each_gives_alone():
    tool = alignment.aligner(A, B)
    every = texts(3000, 4)
    words, made = tool.align(every)
    for t, numbers in zip(every, made):
        assert ";".join(words[k][2] for k in numbers) == alignment.whole_word(*plain(t))[2], t


def test_rows_with_odd_ones_repeats_and_small_pieces(spark):
    rows = [(k, t) for k, t in enumerate(texts(300, 3))]
    rows += [(1000, None), (1001, ""), (1002, "one ▁ text"), (7, "the hot word the the"), (7, "the hot word the the"), (None, "the cat"), *((2000 + k, "the cat sat") for k in range(200))]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, id int, code int")
    want = brute(rows)
    for parts in (1, 5):
        got = alignment.align(df.repartition(parts), A, B, digest=True)
        assert sorted(map(tuple, got.collect()), key=key) == want
    whole = {r.doc_id: r for r in alignment.align(df, A, B).collect()}
    assert whole[2000].groups.count(";") == whole[2000].n_groups - 1
    assert whole[1002].n_a == whole[1000].n_links == 0 and whole[1002].groups == ""


def test_many_pieces_give_what_one_gives(spark):
    df = spark.createDataFrame([(k, f"word{k % 50} and the other {k} " * 40) for k in range(400)], "doc_id long, text string").coalesce(1)
    one = sorted(map(tuple, alignment.align(df, A, B, digest=True).collect()))
    many = sorted(map(tuple, alignment.align(df.repartition(23), A, B, digest=True).collect()))
    assert one == many == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table_and_spans_of_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B).count() == 0
    row = alignment.alignments(spark.createDataFrame([(1, "日a")], "doc_id long, text string"), A, B).first()
    assert row.ends_a[-1] == row.ends_b[-1] == 5


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_alignment(spark, sf)
    assert got.columns[-1] == "groups_sha256"
    assert sorted(map(tuple, got.collect())) == brute(rows)
