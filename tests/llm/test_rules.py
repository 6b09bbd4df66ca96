import random

import numpy as np
import pytest

from trade_insights.llm import rules

import brute


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "c", "dée", "f", "g1", "hij", "klmno", "p#q", "r|s", "Ü", "日本"]) + rng.choice(["", "x", "y7", "zz"])
    docs = []
    for i in range(300):
        lines = [" ".join(word() for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 8))]
        if i % 4 == 0:
            lines += lines[: rng.randrange(len(lines))]
        if i % 10 == 0:
            lines.append("z " * rng.randrange(1, 40))
        docs.append((i, rng.choice(["\n", "\n\n", "\r\n", "\n \t"]).join(lines), "en" if i % 3 else None, f"s{i % 2}"))
    docs += [(400, None, "en", "s0"), (401, "", None, None), (402, " \n\x0b\x0c\r", "en", "s1"), (403, "a b c d", "en", "s1"), (404, "a b c d e a b c d e", "en", "s1"), (405, "long words here " * 7000, "xx", "s9"), (1, docs[1][1], "en", "s1"), (None, docs[2][1], "en", "s0"), (406, "a a a a a a a", "en", "s0")]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_and_base_rules_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, source string, group int, w string")
    rows = rules.judged(df).collect()
    key = lambda i, *x: (i is None, i or 0, *x)
    want = []
    for i, t, _, _ in docs:
        c = brute.counts(t)
        want.append(key(i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert sorted(key(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == sorted(want)
    assert not any(r.kept and r.base_failed for r in rows)


def mcd(x, floors):
    """The estimate of one group with exact quantiles."""
    lower = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    m = np.array([lower(c, 0.5) for c in x.T])
    s = np.diag([(1.4826 * lower(np.abs(c - k), 0.5)) ** 2 for c, k in zip(x.T, m)])
    distance = lambda: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s + np.diag(np.square(floors))), x - m)
    for _ in range(rules.STEPS):
        d = distance()
        near = x[d <= lower(d, rules.CORE)]
        m, s = near.mean(axis=0), np.cov(near.T, bias=True)
    d = distance()
    return d / max(lower(d, 0.5) / rules.CHI2_MEDIAN, 1.0)


def test_verdicts_equal_a_plain_estimate(spark):
    rng = random.Random(5)
    docs = []
    for i in range(400):
        words = [rng.choice("abcdefghij") * rng.randrange(2, 9) + str(i % 7) for _ in range(rng.randrange(30, 200))]
        if i % 20 == 0:
            words = [w + "%%%" for w in words]
        if i % 20 == 1:
            words = [w.upper() for w in words]
        docs.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), "en", f"s{i % 2}"))
    docs += [(1000 + i, docs[0][1], "rare", f"r{i}") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judged(df).collect()}
    assert all(got[1000 + i].kept and got[1000 + i].distance is None for i in range(5))  # too few to judge
    for source in ("s0", "s1"):
        own = [d for d in docs if d[2] == "en" and d[3] == source]
        x = []
        for _, text, _, _ in own:
            n, chars, symbols, dups, repeats = brute.counts(text)
            n_lines = len([y for y in text.split("\n") if y.strip()])
            x.append([np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(dups / n_lines), np.sqrt(repeats / n), np.sqrt(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / chars)])
        d = mcd(np.array(x), rules.FLOORS)
        for (i, text, _, _), e in zip(own, d):
            n = len(text.split())
            assert got[i].distance == pytest.approx(e * n / (n + rules.HALF_EVIDENCE), rel=0.02, abs=0.02)
            assert got[i].kept == (got[i].distance <= rules.CHI2_CUT)
    assert all(not got[i].kept for i in range(0, 400) if i % 20 < 2)
    assert sum(got[i].kept for i in range(400)) >= 355


def test_no_python_on_the_path(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string, lang string, source string")
    plan = rules.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    assert rules.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
