"""Operator 10: a compression classifier for text quality.

A zstandard dictionary is built from good labelled texts and one from bad
ones. A text is cut into blocks and each block compressed with either; the
difference of the compressed sizes, divided by the size of the text, says
which kind of text it resembles. A logistic curve, fitted on labelled texts
that built neither dictionary and moved to the labels' own shares, makes it a
score between 0 and 1.

Fitting uses a bounded sample of the labelled texts: ``per_class`` texts of
each label, the rows with the smallest hashes of their ids, so that it does not
depend on partitions. Half of them build the dictionaries, each with up to
``of_text`` blocks drawn by hash out of the whole text, so that long texts do
not fill a dictionary. The other half fits the curve: their differences are computed over whole texts, by tasks. Scoring reads every whole
text, however long. What reaches the driver are the blocks and a number for
each text of the second half.

A null or empty text, and one of blanks only, gets the score of difference
0. Texts with equal differences get equal scores. Labels that are null, and labels of documents that are missing, are not
learnt from; of several labels of a document the largest counts. If one of
the two labels is missing altogether, each text gets the share of label 1
(0.5 without any label). Repeated rows are scored alike. An empty table gives an
empty result. ``accepted`` keeps all columns, whatever their names; ``score`` and
``classified`` ignore columns with names of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, small_pieces, stored

FOLDS = 5
#: Bounds of the labelled sample, for each label.
PER_CLASS, OF_TEXT = 1500, 4
BLOCK = 2048
DICTIONARY = 256 << 10
LEVEL = 3
#: Texts at least this likely to be good are predicted so.
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    constant: float | None = None


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(parts: list[bytes]) -> bytes:
    """A dictionary of blocks; their plain end where there is too little text
    to build one from."""
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


class Differences:
    """Normalised size differences under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.of = []
        for d in (good, bad):
            data = zstandard.ZstdCompressionDict(d)
            if d:
                data.precompute_compress(level=LEVEL)
            self.of.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))

    def __call__(self, text: bytes) -> float:
        if not text.strip():
            return 0.0
        good, bad = (sum(len(z.compress(b)) for b in blocks(text)) for z in self.of)
        return (bad - good) / len(text)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y on x, by Newton steps."""
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _measured(sample: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """doc_id, label and difference of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = Differences(good, bad)
        for b in small_pieces(batches):
            x = [difference(t) for t in as_bytes(b.column("bytes"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.float64())], ["doc_id", "label", "difference"])

    return arrow_pass(sample.select("doc_id", "label", "bytes"), run, "doc_id long, label int, difference double")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, of_text: int = OF_TEXT) -> Model:
    """Learn from labelled documents outside the held-out fold, from a sample
    of at most ``2 * per_class`` texts."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
              .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
              .where(fold(F.col("doc_id")) != 0).withColumn("key", F.xxhash64("doc_id")))
    drawn = None
    for label in (0, 1):
        part = marked.where(F.col("label") == label).orderBy("key", "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("bytes"))
    sample = texts.join(drawn, "doc_id").where("length(bytes) > 0").groupBy("doc_id", "label", "key").agg(F.max("bytes").alias("bytes"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("key", "doc_id"))
    sample = stored(sample.withColumn("half", place % 2), "quality-sample")
    found = {(r.label, r.half): r["count"] for r in sample.groupBy("label", "half").count().collect()}
    n = {label: found.get((label, 0), 0) + found.get((label, 1), 0) for label in (0, 1)}
    if min(n.values()) < 2:
        return Model(b"", b"", 0.0, 0.0, n[1] / sum(n.values()) if sum(n.values()) else 0.5)
    starts = F.sequence(F.lit(0), F.floor((F.length("bytes") - 1) / BLOCK).cast("int"))
    cut = sample.where("half = 1").select("label", "doc_id", "bytes", F.explode(starts).alias("at"))
    drawn = F.row_number().over(Window.partitionBy("label", "doc_id").orderBy(F.xxhash64("doc_id", "at"), "at"))
    cut = cut.select("label", "doc_id", "at", F.substring("bytes", F.col("at") * BLOCK + 1, F.lit(BLOCK)).alias("block"), drawn.alias("drawn")).where(F.col("drawn") <= of_text)
    blocks_ = sorted(cut.select("label", F.xxhash64("doc_id").alias("key"), "doc_id", "at", "block").collect())
    built = [dictionary([bytes(r.block) for r in blocks_ if r.label == label]) for label in (1, 0)]
    measured = sorted(tuple(r) for r in _measured(sample.where("half = 0"), *built).collect())
    x, y = np.array([m[2] for m in measured]), np.array([float(m[1]) for m in measured])
    slope, offset = logistic(x * 100, y)
    shares = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    offset += np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(*built, slope, float(offset))


def probability(model: Model, difference):
    return 1 / (1 + np.exp(-np.clip(model.slope * 100 * difference + model.offset, -30, 30)))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, ``difference`` and ``score`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = Differences(model.good, model.bad)
        for b in small_pieces(batches):
            if model.constant is None:
                x = np.array([difference(t) for t in as_bytes(b.column(1))], float)
                s = probability(model, x)
            else:
                x = np.zeros(b.num_rows)
                s = np.full(b.num_rows, model.constant)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64()), pa.array(s, pa.float64())], [id_column, "difference", "score"])

    return arrow_pass(docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")), run, f"`{id_column}` long, difference double, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), F.col(f"`{text}`").cast("string").alias("scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = Differences(model.good, model.bad)
        for b in small_pieces(batches):
            keep = [(probability(model, difference(t)) if model.constant is None else model.constant) >= threshold for t in as_bytes(b.column("scored"))]
            yield b.select(names).filter(pa.array(keep))

    kept = arrow_pass(plain, run, plain.select(*names).schema)
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")
