import random

import pytest
from pyspark.sql import functions as F

from trade_insights.llm import fingerprints
from trade_insights.llm.common import table
from trade_insights.llm.queries import op12_fingerprints

from brute import sha


def of(text):
    return fingerprints.shown(fingerprints.of([text])[0])


def edited(text, following):
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def check(rows, order):
    """Rows against documents in the order of the definition."""
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        e = edited(t, after)
        a, b, c = (fingerprints.of([x]) for x in (t, e, after))
        want.append((repr(i), len(t), sha(e.encode()), of(t), of(e), round(float(fingerprints.likeness(a, b)[0]), 9), round(float(fingerprints.likeness(a, c)[0]), 9)))
    got = [(repr(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got) == sorted(want)


def text(rng, lines):
    return "\n".join(" ".join(rng.choice(["ab", "cé", "d.", "日本", "e!", "fgh"]) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 30))) for _ in range(lines))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_equal_to_plain_version(spark, parts):
    rng = random.Random(parts)
    docs = [(i, text(rng, rng.randrange(1, 8))) for i in rng.sample(range(-300, 900), 60)]
    docs += [(2000, None), (2001, ""), (2002, "\n"), (2003, "x"), (2004, "y " * 60_000), (2005, docs[0][1]), (None, "last of all")]
    df = spark.createDataFrame([(i, t, "c", 2) for i, t in docs], "doc_id long, text string, near_next string, range int")
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = fingerprints.with_edits(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    check(rows, [(i, t or "") for i, t in sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0)))])


def test_repeated_rows(spark):
    docs = [(5, "five\nlines"), (3, "three"), (3, "three"), (3, "three"), (1, "one")]
    rows = fingerprints.with_edits(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    check(rows, docs)
    # several texts of one id: each is followed by another document, whatever their order
    rows = fingerprints.with_edits(spark.createDataFrame([(3, "ab"), (3, "cd"), (3, "ef")], "doc_id long, text string")).collect()
    assert {r.edited_sha256 for r in rows} in [{sha(x.encode()) for x in s} for s in (("ac", "ce", "ea"), ("ae", "ec", "ca"))]


def test_an_id_with_many_texts_has_many_ranges(spark):
    docs = [(7, f"text {i} " * (i % 9)) for i in range(150)] + [(None, f"no id {i}") for i in range(150)] + [(i, f"own {i}") for i in range(100, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashed = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    check(fingerprints.with_edits(df).collect(), [(r.doc_id, r.text) for r in order])
    rows = df.selectExpr("doc_id", "xxhash64(text) AS hash", "coalesce(~doc_id, 9223372036854775807) AS down")
    ranges = fingerprints._ranges(rows).select("doc_id", "range").distinct().groupBy("doc_id").count()
    assert {r.doc_id: r["count"] for r in ranges.collect()}[7] > 10


def test_counts_of_cuts(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i,) for i in range(-5, 60)], "down long")
    for n in (0, 1, 2, 7, 8, 9, 40):
        cuts = sorted(rng.choice([rng.randrange(50), 20]) for _ in range(n))
        rows = df.select("down", fingerprints._before(cuts, lambda c: c < F.col("down"), 4).alias("less"), fingerprints._before(cuts, lambda c: c <= F.col("down"), 4).alias("upto")).collect()
        assert all((r.less, r.upto) == (sum(c < r.down for c in cuts), sum(c <= r.down for c in cuts)) for r in rows)


def test_a_single_document_and_an_empty_table(spark):
    rows = fingerprints.with_edits(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    check(rows, [(3, "abcdef")])
    assert rows[0].near_next == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.with_edits(empty).collect() == [] and fingerprints.fingerprints(empty).collect() == []


def test_multiset_of_paragraphs():
    a, b, c = "one. two. three", "four five", "six\tseven!"
    assert of("\n".join([a, b, c])) == of("\n".join([c, a, b])) != of("\n".join([a, b, b, c]))
    assert of(a + "\n") != of(a) and of("ab\nc") != of("a\nbc") and len({of(x) for x in ("", "\n", "\n\n", " ", a, b)}) == 6
    assert fingerprints.added(of(a), [b, c]) == of("\n".join([a, b, c]))
    assert fingerprints.removed(of("\n".join([a, b, c, b])), [b, c]) == of("\n".join([a, b]))
    many = fingerprints.of(["line\n" * 20_000])[0]
    assert (many == fingerprints.sums([["line"] * 20_000 + [""]])[0]).all()


def test_likeness_follows_the_shared_text():
    rng = random.Random(4)
    lines = lambda n: [" ".join(str(rng.random()) for _ in range(9)) for _ in range(n)]
    for share in (0, 0.25, 0.5, 0.75, 0.9):
        kept = lines(int(200 * share))
        x, y = ("\n".join(kept + lines(200 - len(kept))) for _ in range(2))
        near = float(fingerprints.likeness(fingerprints.of([x]), fingerprints.of([y]))[0])
        assert abs(near - share) < 0.2
    x = "\n".join(lines(50))
    assert fingerprints.likeness(fingerprints.of([x]), fingerprints.of([x]))[0] == 1
    # a text of one paragraph is like itself with another second half
    a, b = (". ".join(lines(40)) for _ in range(2))
    assert 0.3 < fingerprints.likeness(fingerprints.of([a]), fingerprints.of([edited(a, b)]))[0] < 0.7


def test_query_equals_plain_version(spark):
    small = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in table(spark, small, "documents").collect()]
    check(op12_fingerprints(spark, small).collect(), sorted(docs, key=lambda x: -x[0]))
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(table(spark, small, "documents")).collect()}
    assert prints == {i: of(t) for i, t in docs}
    assert len(set(prints.values())) == len({tuple(sorted(t.split("\n"))) for _, t in docs})
