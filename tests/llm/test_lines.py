import random

import pytest

from trade_insights.llm import lines
from trade_insights.llm.oracle import LINES

import brute


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + rng.choice(["", "", "s", "ed"])
    docs = []
    for i in range(40):
        body = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(3, 9))]
        if i % 2:
            body.insert(rng.randrange(len(body)), f"Posted on day {i} by user {word()} at noon")
        if i % 3 == 0:
            body.append("All rights reserved by the owners")
        if i % 7 == 0:
            body += ["", "  \t", "Read more"]
        docs.append((i, "\n".join(body)))
    docs += [(100 + i, docs[1][1]) for i in range(12)]  # copies stay whole
    docs += [(2, docs[2][1]), (2, "All rights reserved by the owners"), (200, None), (201, ""), (202, "\n\n"), (None, docs[3][1]), (None, None), (203, "long " * 20_000 + "\nAll rights reserved by the owners")]
    return docs


@pytest.mark.parametrize("seed,min_docs", [(1, 10), (2, 3)])
def test_equal_to_brute_force(spark, seed, min_docs):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 5, "y") for i, t in docs], "doc_id long, text string, leaf string, places int, c0 string")
    rows = lines.cleaned(df, min_docs).collect()
    want = brute.lines(docs, min_docs)
    key = lambda i, t, k: (i is None, i or 0, t is None, k)
    assert sorted(key(r.doc_id, r.text, r.text or "") for r in rows) == sorted(key(i, t, want[i, t or ""]) for i, t in docs)
    assert all((r.leaf, r.places, r.c0) == ("x", 5, "y") for r in rows)
    assert sum(r.n_dropped for r in rows) > 10 and any(r.left_whole for r in rows)


def twin(docs):
    """{doc_id: (n_lines, n_dropped, left_whole, sha)} by the DuckDB twin."""
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}))
    return {r[0]: r[1:] for r in con.sql(LINES).fetchall()}


def agree(spark, docs):
    rows = lines.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == twin(docs)


def mixed_corpus():
    """Two templates in a leaf, short one-offs, short footers, pages with long footers."""
    footers = ["Please read our terms before you use any part of this site", "Please read our news every morning and tell all friends about them"]
    docs = [page(i, footers[i % 2]) for i in range(40)] + [page(100 + i, f"This is a {name(i)}") for i in range(12)] + [page(200 + i, "All rights reserved.") for i in range(12)]
    docs += [page(300 + i, "Posted by user {} at noon in the large public reading room".format(name(i))) for i in range(15)] + [page(400 + i, "Posted by user {} who has left us many years ago already".format(name(i))) for i in range(15)]
    docs += [(500 + i, f"{name(i)} {name(i + 50)}\n" + " ".join(["Terms of use and privacy notes"] * 4)) for i in range(15)] + [page(600 + i, "1 22 333") for i in range(12)] + [page(700 + i, "Read more") for i in range(9)]
    docs += [(800 + i, docs[0][1]) for i in range(12)] + [(900, None), (901, ""), (902, "\n \n")]
    return docs


def test_operator_twin_and_plain_version_agree(spark):
    docs = mixed_corpus()
    agree(spark, docs)
    want, rows = brute.lines(docs, 10), lines.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text or "" for r in rows} == {i: want[i, t or ""] for i, t in docs}
    # the other corpus too, without the ids that the twin's table cannot have
    ids = [i for i, _ in corpus(1)]
    once = [(5000 + i, t) for i, t in corpus(1) if i is not None and ids.count(i) == 1]
    agree(spark, once + docs[:5])


def test_repeated_rows_count_once(spark):
    rare = [page(i, "All rights reserved by the owners") for i in range(6)]
    often = [page(100 + i, "Imprint and contact of the editors") for i in range(10)]
    rows = lines.cleaned(spark.createDataFrame(rare * 3 + often * 2, "doc_id long, text string")).collect()
    assert len(rows) == 38 and {(r.doc_id < 100, r.n_dropped) for r in rows} == {(True, 0), (False, 1)}


def test_short_lines(spark):
    short = ["All rights reserved."] * 12 + ["Menu"] * 10 + [f"Page {i}" for i in range(12)]
    kept = ["Home page"] * 9 + [f"{i} {i + 1}" for i in range(12)]  # too rare; fields only
    assert left(spark, [page(i, t) for i, t in enumerate(short + kept)]) == sorted(kept)


def test_no_python_on_the_path(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    plan = lines.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    assert lines.cleaned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def name(i):
    return "".join(chr(97 + int(c)) for c in f"{i:04d}")


def page(i, line):
    return (i, "\n".join([" ".join(f"{name(i)}{name(k)}" for k in range(30)), line]))


def left(spark, docs):
    """Last lines of the documents that keep them."""
    rows = lines.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    last = {i: t.split("\n")[-1] for i, t in docs}
    assert all(r.n_lines == 2 and r.n_dropped in (0, 1) and not r.left_whole for r in rows)
    return sorted(last[r.doc_id] for r in rows if not r.n_dropped)


def test_two_templates_in_a_leaf(spark):
    footers = ["Please read our terms before you use any part of this site", "Please read our news every morning and tell all friends about them"]
    assert left(spark, [page(i, footers[i % 2]) for i in range(40)]) == []
    # a field of words, no two of them alike, in either template
    footers = ["Posted by user {} at noon in the large public reading room", "Posted by user {} who has left us many years ago already"]
    assert left(spark, [page(i, footers[i % 2].format(name(i))) for i in range(40)]) == []


def test_template_among_prose(spark):
    prose = ["Please read our " + " ".join(f"{name(i)}{x}" for x in "klmnopqrs") for i in range(300)]
    footer = "Please read our terms before you use any part of this site"
    docs = [page(i, t) for i, t in enumerate([footer] * 20 + prose)]
    assert left(spark, docs) == sorted(prose)
    rare = "Please read our terms or leave this site now and for ever"
    assert left(spark, [*docs, *(page(1000 + i, rare) for i in range(9))]) == sorted(prose + [rare] * 9)


def test_short_lines_with_a_common_start_stay(spark):
    lines_ = [f"This is a {name(i)}" for i in range(12)] + [f"There was once {name(i)} {name(i + 50)}" for i in range(12)]
    docs = [page(i, t) for i, t in enumerate(lines_)]
    assert left(spark, docs) == sorted(lines_)
    assert left(spark, [*docs, *(page(100 + i, "Here is our menu") for i in range(10))]) == sorted(lines_)
