import random

import numpy as np
import pytest

from trade_insights.llm import near

import brute


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["ab", "c", "dée", "f", "g1", "hij", "k"]) + str(rng.randrange(30)) for _ in range(n)]
    docs, k = [], 0
    for _ in range(8):
        base = some(rng.randrange(20, 120))
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            docs.append((k, " ".join(w)))
            k += 1
    docs += [(k, docs[0][1]), (k + 1, docs[0][1].replace(" ", "\n")), (0, docs[0][1]), (3, docs[9][1])]
    docs += [(500, None), (501, ""), (502, "  \n"), (503, "one two"), (504, "one two"), (505, "one  two\n"), (None, docs[1][1]), (None, None), (506, "w " * 3000), (507, "w w w w w w")]
    rng.shuffle(docs)
    return docs


def check(spark, docs, kept_too=True):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, node string, label int")
    rows = near.joined(df).collect()
    got = {(r.doc_id, r.class_id, r.n_links) for r in rows}
    want = {(i, c, n) for (i, _), (c, n) in brute.near(docs).items()}
    assert got == want and len(rows) == len(brute.near(docs))
    if not kept_too:
        return
    kept = near.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(c) for c in one_for_each_group(docs))


def one_for_each_group(docs):
    """The smallest ids of the groups, by components of all distinct rows."""
    low = -(1 << 63)
    rows = sorted({(low if i is None else i, brute.shingle_set(t)) for i, t in docs}, key=lambda x: x[0])
    seen, out = set(), []
    for k, (i, s) in enumerate(rows):
        if k in seen:
            continue
        out.append(None if i == low else i)
        seen.add(k)
        todo = [k]
        while todo:
            x = rows[todo.pop()][1]
            more = [j for j, (_, y) in enumerate(rows) if j not in seen and x and y and 5 * len(x & y) >= 4 * len(x | y)]
            seen |= {*more}
            todo += more
        # rows without words are documents of their own; those that agree in the id are one
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    check(spark, corpus(seed))


def test_groups_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 2)
    check(spark, corpus(3))


def copies(n, seed, edits=(0, 6)):
    """Texts of one passage with some words exchanged, some words of few kinds."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(100)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(*edits)):
            w[rng.randrange(100)] = rng.choice(["x", "y", f"e{i}"])
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("edits", [(0, 2), (0, 8)])
def test_large_groups_compared_by_blocks(spark, monkeypatch, edits):
    monkeypatch.setattr(near, "BLOCK", 40)
    monkeypatch.setattr(near, "MOST", 30)
    monkeypatch.setattr(near, "BLOCKS", 4)
    docs = copies(300, 5, edits) + [(1000 + i, t) for i, t in copies(20, 6)] + [(2000 + i, f"own words {i} " * 9) for i in range(30)]
    check(spark, docs, kept_too=False)


def test_tables_grow_with_the_group(spark, monkeypatch):
    """Near copies in one group: no written table grows faster than the group."""
    rows = {}
    real = near.stored

    def counted(df, name):
        out = real(df, name)
        rows[name.rstrip("0123456789")] = max(rows.get(name.rstrip("0123456789"), 0), out.count())
        return out

    from trade_insights.llm import graph
    monkeypatch.setattr(near, "stored", counted)
    monkeypatch.setattr(graph, "stored", counted)
    sizes = []
    for n in (600, 1800):
        rows.clear()
        near.joined(spark.createDataFrame(copies(n, n, (1, 9)), "doc_id long, text string")).collect()
        sizes.append(dict(rows))
    assert sizes[0].keys() == sizes[1].keys() and "near-pairs" in sizes[0]
    for name, few in sizes[0].items():
        assert sizes[1][name] <= max(3.6 * few + 60, 2 * 1800), (name, few, sizes[1][name])


def test_recall_of_pairs_at_the_threshold():
    """Pairs of similarity 0.8 to 0.85 share a prefix in some tree."""
    rng = np.random.default_rng(3)
    depth, found, n = near.prefix_depth(near.SIMILARITY, near.RECALL), 0, 3000
    for _ in range(n):
        size = int(rng.integers(60, 300))
        values = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        own = int(rng.integers(int(size * 0.15 / 1.85) + 1, int(size * 0.2 / 1.8) + 1))  # of each side
        a, b = values[:size], np.concatenate([values[own:size], values[size : size + own]])
        assert 0.8 <= (size - own) / (size + own) <= 0.86
        x, y = (near.signature(v).reshape(near.TREES, near.DEPTH)[:, :depth] for v in (a, b))
        found += bool((x == y).all(axis=1).any())
    assert found >= 0.999 * n


def test_prefixes_shorten_until_the_recall_is_reached():
    assert near.prefix_depth(0.8, 0.5) == near.DEPTH
    depth = near.prefix_depth(0.8, near.RECALL)
    assert 1 - (1 - 0.8**depth) ** near.TREES >= near.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** near.TREES


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.joined(docs).collect() == [] and near.one_of_each(docs).collect() == []
