import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from trade_insights.llm import periodic
from trade_insights.llm.common import table
from trade_insights.llm.queries import op13_periodic

from brute import WORD, sha


def plain_runs(w, min_length=6, min_power=4):
    """(start, length, period) by trying every period."""
    best = {}
    for q in range(1, len(w) // min_power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_power * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def plain(words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode())


def rewritten(doc_id, words):
    if doc_id is None or not words:
        return words
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]


def sequence(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(3)):
        p = rng.randrange(1, 7)
        at, unit = rng.randrange(50), [rng.randrange(3) for _ in range(p)]
        w[at:at] = (unit * 9)[: rng.randrange(4 * p, 6 * p)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_every_period_tried(seed):
    rng = random.Random(seed)
    for _ in range(100):
        batch = [sequence(rng) for _ in range(rng.randrange(1, 6))]
        found = periodic.found_runs([np.array(w, np.int64) for w in batch])
        assert [[tuple(r) for r in x.tolist()] for x in found] == [plain_runs(w) for w in batch]
        found = periodic.found_runs([np.array(w, np.int64) for w in batch], min_length=2, min_power=2)
        assert [[tuple(r) for r in x.tolist()] for x in found] == [plain_runs(w, 2, 2) for w in batch]


def test_suffix_array_and_common_lengths():
    rng = random.Random(9)
    text = [rng.randrange(3) for _ in range(80)]
    s = periodic.SuffixArray(np.array(text), np.zeros(80, np.int64), np.full(80, 80))
    order = sorted(range(80), key=lambda i: text[i:])
    assert s.suffixes.tolist() == order and s.inverse[s.suffixes].tolist() == list(range(80))
    for k in range(1, 80):
        a, b = text[order[k - 1] :], text[order[k] :]
        assert s.lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


TEXTS = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "x a b a b a b a b a b y", "n\x0bm\x0cn\x0dm\tn m n m", "a b " * 6, "q " * 30_000 + "r s " * 20_000, "a b c " * 5 + "d " * 9 + "a b c " * 5, "a a b a a b a a b a a b a a c"]


def test_digests_equal_plain_version(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (5, TEXTS[5]), (None, TEXTS[6]), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, start string, n_words int")
    got = sorted((repr(r.doc_id), *tuple(r)[2:]) for r in periodic.digests(df).collect())
    short = [(i, t) for i, t in docs if len(t or "") < 1000]
    want = [(repr(i), *plain(WORD.findall(t or ""))) for i, t in short]
    long = [(repr(9), 2, 0, 30_000, 1, 30_000_000, sha(b"0,30000,1\n30000,40000,2\n"), sha(b"q r s"))]
    assert got == sorted(want + long)
    rows = {r.doc_id: r for r in periodic.collapsed(df.where("doc_id = 10")).collect()}
    assert rows[10].text == "a b c d a b c" and rows[10].n_words == 39
    assert [tuple(r)[1:] for r in periodic.runs(df.where("doc_id = 6")).collect()] == [(1, 10, 2, "a b")]


def test_query_equals_plain_version(spark):
    small = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    rows = op13_periodic(spark, small).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 5
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for r in rows:
        w = rewritten(r.doc_id, WORD.findall(docs[r.doc_id] or ""))
        if len(w) < 1500:
            assert tuple(r[c] for c in columns) == plain(w)


def test_planted_words(spark):
    docs = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(200)] + [(None, "a b"), (7, None)]
    got = periodic.planted(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    want = {(i, " ".join(rewritten(i, (t or "").split()))) for i, t in docs}
    assert {(r.doc_id, r.text or "") for r in got} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(docs).collect() == [] and periodic.runs(docs).collect() == [] and periodic.collapsed(docs).collect() == []
