"""Operators against plain counting where a bound once stood in for the whole job."""

import math
import random
from collections import Counter

from gleaner.llm import lmscore, minhash


def test_lm_counts_more_words_and_pairs_than_slots(spark):
    texts = [" ".join(w for k in range(60) for w in ("the", f"w{i}x{k}", f"w{(i * 7 + k) % 900}y")) for i in range(5000)]
    wanted = set(range(0, 5000, 5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in lmscore.score(docs, spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()}
    single, pair = [Counter(), Counter()], [Counter(), Counter()]
    words = [t.split() for t in texts]
    for i, w in enumerate(words):
        for m in (0, 1):
            if m or i in wanted:
                single[m].update(w)
                pair[m].update(zip(["<s>", *w], w))
    starts = [len(wanted), len(texts)]
    n = [sum(s.values()) for s in single]
    scale = [1.0, n[0] / n[1]]
    assert len(single[1]) > lmscore.LEAST_WORDS
    for i in range(0, 5000, 37):
        loss = []
        for m in (0, 1):
            total = 0.0
            for a, b in zip(["<s>", *words[i]], words[i]):
                own = (single[m][b] * scale[m] + lmscore.FLOOR) / (n[m] * scale[m] + lmscore.FLOOR * len(single[1]))
                p = (pair[m][a, b] * scale[m] + lmscore.PRIOR * own) / ((starts[m] if a == "<s>" else single[m][a]) * scale[m] + lmscore.PRIOR)
                assert p <= 1
                total -= math.log(p)
            loss.append(total / len(words[i]))
        assert got[i].n_words == len(words[i])
        assert abs(got[i].target_loss - loss[0]) < 2e-6 and abs(got[i].background_loss - loss[1]) < 2e-6, i
    assert len(got) == len(texts)
    assert len(lmscore._hot(docs)[0])  # "the" was dealt by pair, the others by word


def test_minhash_finds_every_planted_pair_near_the_threshold(spark):
    rng = random.Random(5)
    docs, linked = [], set()
    for k in range(3000):
        one = [f"p{k}w{i}" for i in range(104)]  # 100 shingles; each change at a fifth word costs five
        two = list(one)
        two[-rng.randint(6, 8) :] = [f"p{k}v{i}" for i in range(8)]
        docs += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
        if 100 * len(a & b) >= 85 * len(a | b):
            linked.add(k)
    assert 1000 < len(linked)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    gone = {r.doc_id for r in minhash.near_duplicates(df, share=(85, 100)).filter("not kept").collect()}
    assert gone == {2 * k + 1 for k in linked}
