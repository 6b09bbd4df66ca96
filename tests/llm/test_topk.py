import math
import random

import pytest
from pyspark.sql import functions as F

from trade_insights.llm import topk


def brute(rows, k, scale):
    ok = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            for i, y in ok:
                if i != q:
                    s = sum(a * b for a, b in zip(x, y))
                    out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, s))
    return {(q, r + 1, i, s) for q, found in out.items() for r, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])}


def vectors(seed, n, big=1.0):
    rng = random.Random(seed)
    rows = [(i - 50, [rng.gauss(0, 1) * big * (1 + 3 * (j == 0)) * (1 + i % 7) for j in range(12)]) for i in range(n)]
    same = [0.5] * 12
    rows += [(1000 + i, same) for i in range(40)]  # one vector many times: ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (None, same), (2020, []), (2040, [1.0, 2.0]), (0, same), (0, same), (2060, [0.0] * 12)]
    return rows


@pytest.mark.parametrize("seed,n,k,big", [(1, 300, 20, 1.0), (2, 30, 200, 1.0), (3, 300, 5, 3e5)])
def test_equal_to_brute_force(spark, monkeypatch, seed, n, k, big):
    monkeypatch.setattr(topk, "SLICE", 64)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rows = vectors(seed, n, big)
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, slice int, norm double")
    got = topk.nearest(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=k).collect()
    assert {tuple(r) for r in got} == brute(rows, k, 64)
    assert len(got) == len(brute(rows, k, 64))


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(1 << 24) + i, 3.0 + i, -float(1 << 22)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.nearest(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=7).collect()
    assert {tuple(r) for r in got} == brute(rows, 7, 64)


def test_too_large_scores_raise(spark):
    df = spark.createDataFrame([(i, [1e9] * 3) for i in range(30)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        topk.nearest(df, F.col("vec_id") % 20 == 0).collect()


def test_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.nearest(spark.createDataFrame([(1, [1.0])], schema), F.col("vec_id") % 20 == 0).collect() == []
