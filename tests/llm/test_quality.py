import math
import random
import zlib

import zstandard
from pyspark.sql import functions as F

from trade_insights.llm import quality
from trade_insights.llm.common import table

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = quality.classified(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).collect()
    assert len(rows) == table(spark, SMALL, "documents").count()
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    other = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, other)
    assert (a.good, a.bad, a.slope, a.offset) == (b.good, b.bad, b.slope, b.offset)


def test_edges(spark):
    good = [f"a calm sentence about topic {i} and its many sides" for i in range(40)]
    bad = ["BUY!!! $$$ NOW " * (3 + i % 5) for i in range(40)]
    docs = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (502, " \n"), (503, "a calm sentence " * 20_000), (None, good[0]), (3, good[3])]
    df = spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, score double, c0 string")
    labels = spark.createDataFrame([(i, int(i < 40), None) for i in range(80)] + [(None, 1, 1), (7, None, 1), (9999, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classified(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (500, 501, 502)}) == 1
    kept = quality.accepted(df, quality.fit(df, labels))
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)


def test_without_labels_of_both_kinds(spark):
    df = spark.createDataFrame([(i, "some text") for i in range(9)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classified(df, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.score for r in quality.classified(df, ones).collect()} == {1.0}
    assert quality.classified(df.limit(0), ones).collect() == []


def test_what_stands_late_in_a_text_is_learnt(spark):
    rng = random.Random(2)
    some = lambda kinds, n: " ".join(rng.choice(kinds) + rng.choice("abcdefgh") for _ in range(n))
    start = some(["plain", "common", "words"], 2000)[:9000]
    docs = [(i, start + some(["river", "meadow", "harvest", "quiet"], 600) if i % 2 else start + some(["$WIN", "CLICK!", "xxx", "%%"], 600)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    rows = [r for r in quality.classified(df, labels).collect() if r.held_out]
    assert len(rows) > 10 and all(r.predicted == r.doc_id % 2 for r in rows)


def test_scores_follow_from_the_dictionaries(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.fit(docs, labels)
    assert len(model.good) > 1000 and len(model.bad) > 1000

    def size(text, dictionary):
        made = zstandard.ZstdCompressionDict(dictionary)
        return sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=made, write_content_size=False, write_dict_id=False).compress(text[i : i + quality.BLOCK])) for i in range(0, len(text), quality.BLOCK))

    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.where("doc_id % 50 = 0").collect():
        data = (r.text or "").encode()
        x = (size(data, model.bad) - size(data, model.good)) / len(data) if data.strip() else 0.0
        assert abs(scores[r.doc_id] - 1 / (1 + math.exp(-(model.slope * 100 * x + model.offset)))) < 1e-9


def test_blocks_of_a_text_are_bounded(spark):
    docs = [(i, f"short text {i} " * 3) for i in range(30)] + [(i, " ".join(f"w{i}{k}" for k in range(40_000))) for i in range(30, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    few = quality.fit(df, labels, of_text=1)
    assert max(len(few.good), len(few.bad)) <= 20 * quality.BLOCK < len(quality.fit(df, labels, of_text=100).good)
