import random

import pytest

from trade_insights.llm import substrings, suffixes

import brute


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["ab", "c", "dée", "f", "g1", "hij", "k", "l", "mm", "n", "ö"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = some(60)
    docs = []
    for i in range(25):
        w = some(rng.randrange(0, 60))
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(10) : 40 + rng.randrange(20)]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(30, docs[3][1]), (31, docs[3][1]), (3, docs[3][1]), (3, docs[3][1])]  # copies, repeated rows
    docs += [(32, None), (33, ""), (34, " \n\t "), (None, docs[0][1] + " x"), (None, docs[0][1] + " x"), (5, "other " * 30 + docs[6][1])]
    docs += [(40, "ab " * 800), (41, "q" * 2500), (42, "xyz" * 300), (43, "ab " * 90), (44, "".join(chr(300 + rng.randrange(20)) for _ in range(500)) * 2)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 0, "c", "c", 1) for i, t in docs], "doc_id long, text string, key int, head string, digest string, runs int")


@pytest.mark.parametrize("seed,hot,window", [(1, 1 << 15, 20), (2, 3, 20), (3, 0, 8), (4, 1 << 15, 8)])
def test_substrings_equal_brute_force(spark, seed, hot, window):
    docs = corpus(seed)
    got = substrings.cleaned(frame(spark, docs), window=window, hot=hot).collect()
    want = brute.substrings(docs, window)
    assert len(got) == len(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((i is None, i or 0, *want[i, t or ""]) for i, t in docs)
    for r in got:
        assert r.n_removed == sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2]))
        assert brute.sha(r.kept.encode()) == r.kept_sha256


@pytest.mark.parametrize("seed,hot,length", [(1, 1 << 15, 200), (2, 3, 200), (3, 0, 40), (4, 1 << 15, 40)])
def test_suffixes_equal_brute_force(spark, seed, hot, length):
    docs = corpus(seed)
    got = suffixes.cleaned(frame(spark, docs), length=length, hot=hot).collect()
    want = brute.suffixes(docs, length)
    assert len(got) == len(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i is None, i or 0, *want[i, t or ""]) for i, t in docs)


def test_small_batches_equal_brute_force(spark, monkeypatch):
    """Groups that end anywhere in a batch of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = corpus(9)
        a = substrings.cleaned(frame(spark, docs)).collect()
        b = suffixes.cleaned(frame(spark, docs)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one, two = brute.substrings(docs, 20), brute.suffixes(docs, 200)
    assert sorted(r.kept_sha256 for r in a) == sorted(one[i, t or ""][-1] for i, t in docs)
    assert sorted(r.kept_sha256 for r in b) == sorted(two[i, t or ""][-1] for i, t in docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.cleaned(docs).collect() == [] and suffixes.cleaned(docs).collect() == []
