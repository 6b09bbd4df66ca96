import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trade_insights.llm import mixing

import brute

def weights():
    domain, lang = F.col("domain"), F.col("lang")
    return {"domain": F.when(domain == "d1", 3.0).when(domain == "d9", 0.0).otherwise(1.0),
            "lang": F.when(lang == "en", 2.0).when(lang == "xx", None).otherwise(1.0), "source": F.lit(1.0)}


W = {"domain": lambda d: {"d1": 3.0, "d9": 0.0}.get(d, 1.0), "lang": lambda x: 2.0 if x == "en" else 0.0 if x == "xx" else 1.0, "source": lambda x: 1.0}


def corpus():
    docs = []
    for i in range(400):
        hot = i % 3 == 0
        docs.append((i, "w " * (1 + i * 7 % 23), "d1" if hot else f"d{i % 4}", ["en", "de", None][i % 5 % 3], "s0" if hot else f"s{i % 6}"))
    docs += [(1, "w w", "d1", "en", "s0"), (2, docs[2][1], *docs[2][2:]), (900, None, "d1", "en", "s0"), (901, "", None, None, None), (902, "x " * 3000, "d2", "de", "s1"), (903, "x", "d9", "en", "s0"), (904, "x", "d1", "xx", "s0"), (None, "y y", "d1", "en", "s0")]
    return docs


def wanted(docs, share, epochs, seed):
    units = defaultdict(int)
    for i, t, *leaf in docs:
        units[i, tuple("\0" if x is None else x for x in leaf)] += len(brute.WORD.findall(t or ""))
    tokens = defaultdict(int)
    for (_, leaf), n in units.items():
        tokens[leaf] += n
    budgets = {(): float(int(sum(tokens.values()) * share))}
    for k, level in enumerate(("domain", "lang", "source")):
        new = {}
        for parent, budget in budgets.items():
            children = {}
            for leaf, n in tokens.items():
                if leaf[:k] == parent:
                    w, cap = children.get(leaf[k], (W[level](leaf[k]), 0))
                    children[leaf[k]] = w, cap + n * epochs
            new |= {(*parent, name): b for name, b in brute.shared_out(budget, children).items()}
        budgets = new
    out = {}
    for leaf, n in tokens.items():
        full = int(budgets[leaf] // n) if n else 0
        rest = int(budgets[leaf] - full * n)
        key = lambda i: (hashlib.md5(f"{seed}/{full}/{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i)  # noqa: E731,B023
        total = 0
        for i in sorted((i for i, x in units if x == leaf), key=key):
            total += units[i, leaf]
            out[i, leaf] = (full + (total <= rest)) if units[i, leaf] else 0
    return out


@pytest.mark.parametrize("share,epochs,bucket", [(0.6, 4, 4096), (0.6, 1, 8), (0.9, 3, 8), (2.5, 2, 4096), (0.0, 1, 8)])
def test_equal_to_brute_force(spark, monkeypatch, share, epochs, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, shelf string, lang string, source string, budget int, copies int")
    got = mixing.mixed_in(df, F.col("shelf"), weights(), share=share, max_epochs=epochs, seed=7).collect()
    want = wanted(docs, share, epochs, 7)
    assert {(r.doc_id, ("\0" if r.domain is None else r.domain, "\0" if r.lang is None else r.lang, "\0" if r.source is None else r.source)): r.copies for r in got} == want
    assert sum(r.n_tokens * r.copies for r in got) <= share * sum(r.n_tokens for r in got) + 1
    rows = mixing.taken(df, F.col("shelf"), weights(), share=share, max_epochs=epochs, seed=7)
    assert rows.columns == df.columns
    times = defaultdict(int)
    for i, _, *leaf in docs:
        times[i, tuple("\0" if x is None else x for x in leaf)] += 1
    assert rows.count() == sum(want[u] * n for u, n in times.items())


def test_no_python_on_the_path(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, shelf string, lang string, source string")
    plan = mixing.mixed_in(df, F.col("shelf"), weights(), share=0.5)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mixed_in(df, mixing.shelf(F.col("source")), mixing.chosen_weights(), share=0.5).collect() == []
    assert mixing.taken(df, mixing.shelf(F.col("source")), mixing.chosen_weights(), share=0.5).collect() == []
