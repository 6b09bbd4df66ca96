"""Operator 12: document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs, the lines between line feeds, blank
ones included. Each paragraph is hashed to a vector of ``WIDTH`` numbers, and
the fingerprint is the sum of the vectors modulo 2**32. So it does not depend
on the order of the paragraphs, equal multisets have equal fingerprints, and a
paragraph is inserted or deleted by adding or subtracting its vector, without
the rest of the text (``added``, ``removed``, ``moved``).

The upper 8 bits of a number are drawn by SHAKE-128 from the whole paragraph;
``WIDTH`` of them tell multisets apart. Modulo 2**24, a divisor of 2**32, the
sum is a homomorphic hash as well: there a paragraph's vector is the sum over
its sentences of a random sign times the root of the sentence's length. The
squared norm of the difference of two fingerprints, taken modulo 2**24, then
estimates by how many bytes two texts differ, and ``likeness`` is one minus its
share of the squared norms: 1 for equal fingerprints, about 0 for texts without
a common sentence, with a standard error of about WIDTH**-0.5.

``with_edits`` also fingerprints an edited version of each text, whose second
half is the start of the next document's, by deleting the paragraphs from the
cut on and inserting those that take their place. The next document is found
by one shuffle of the texts: quantiles of doc_id cut the falling order into
``RANGES`` ranges for each shuffle partition, each range is sorted, and a copy
of the first document of the next range closes it. Tasks stream over their
ranges; what the driver holds are the quantiles and the ranges' numbers.

Documents are ordered by falling doc_id (null last), then by a hash of the
text. An id that holds many rows is cut into ranges by that hash; only rows
that agree in id and text meet in one range, where they are streamed too.
Equal rows are interchangeable, so results do not depend on their order. The
last document's next is the first; a single document is its own next. A null
text counts as empty, which is one blank paragraph. Memory of a task holds some
1 MB of text, or one longer text and its successor. An empty table gives an
empty result, and other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, small_pieces, stored

WIDTH = 256
#: Bits of a number that measure likeness; those above them tell texts apart.
NEAR_BITS = 24
SENTENCE = re.compile(r"(?<=[.!?] )")
BATCH = 1 << 20
#: Ranges of documents for each shuffle partition.
RANGES = 8


def paragraphs(text: str) -> list[str]:
    return text.split("\n")


def vectors(parts: list[str]) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each paragraph."""
    whole, signs, roots, owner = [], [], [], []
    for k, part in enumerate(parts):
        whole.append(hashlib.shake_128(part.encode()).digest(WIDTH))
        for sentence in SENTENCE.split(part):
            data = sentence.encode()
            signs.append(hashlib.blake2b(data, digest_size=WIDTH // 8).digest())
            roots.append(max(1, isqrt(len(data))))
            owner.append(k)
    out = np.frombuffer(b"".join(whole), np.uint8).reshape(-1, WIDTH).astype(np.uint32) << np.uint32(NEAR_BITS)
    owner = np.array(owner)
    for at in range(0, len(owner), 4096):
        sign = np.unpackbits(np.frombuffer(b"".join(signs[at : at + 4096]), np.uint8).reshape(-1, WIDTH // 8), axis=1).astype(np.int32)
        sign = (2 * sign - 1) * np.array(roots[at : at + 4096], np.int32)[:, None]
        first = np.flatnonzero(np.diff(owner[at : at + 4096], prepend=-1))
        out[owner[at : at + 4096][first]] += np.add.reduceat(sign, first, axis=0, dtype=np.int32).view(np.uint32)
    return out


def sums(parts: list[list[str]]) -> np.ndarray:
    """The sum of the vectors of each list of paragraphs; empty lists give 0."""
    flat = [p for x in parts for p in x]
    size = np.array([len(x) for x in parts])
    out = np.zeros((len(parts), WIDTH), np.uint32)
    if flat:
        full = np.flatnonzero(size)
        out[full] = np.add.reduceat(vectors(flat), (np.cumsum(size) - size)[full], axis=0, dtype=np.uint32)
    return out


def of(texts: list[str]) -> np.ndarray:
    return sums([paragraphs(t) for t in texts])


def shown(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


def read(shown_as: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(shown_as), "<u4")


def added(shown_as: str, parts: list[str]) -> str:
    """The fingerprint after the insertion of paragraphs."""
    return shown(read(shown_as) + sums([parts])[0])


def removed(shown_as: str, parts: list[str]) -> str:
    """The fingerprint after the deletion of paragraphs."""
    return shown(read(shown_as) - sums([parts])[0])


def signed(numbers: np.ndarray) -> np.ndarray:
    """The parts that measure likeness, between plus and minus 2**23."""
    up = np.uint32(32 - NEAR_BITS)
    return ((numbers << up).view(np.int32) >> np.int32(up)).astype(np.float64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two arrays of fingerprints, between 0 and 1."""
    far = (signed(a - b) ** 2).sum(axis=1)
    norms = (signed(a) ** 2).sum(axis=1) + (signed(b) ** 2).sum(axis=1)
    near = np.clip(1 - far / np.maximum(norms, 1), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, near)


def cut(text: str) -> tuple[int, int]:
    """Where the edited half begins, and where the paragraph that holds this
    place begins."""
    at = len(text) - len(text) // 2
    return at, text.rfind("\n", 0, at) + 1


def moved(texts: list[str], after: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Fingerprints of the texts, those of the edited texts, and the edited
    texts: a fingerprint loses the paragraphs from the cut on and gains those
    that take their place."""
    places = [cut(t) for t in texts]
    # paragraphs before the one that is cut, those from it on, and what takes their place
    heads = [paragraphs(t[: start - 1]) if start else [] for t, (_, start) in zip(texts, places)]
    tails = [paragraphs(t[start:]) for t, (_, start) in zip(texts, places)]
    new = [t[start:at] + x[: len(t) - at] for t, x, (at, start) in zip(texts, after, places)]
    n = len(texts)
    made = sums([*heads, *tails, *map(paragraphs, new)])
    own = made[:n] + made[n : 2 * n]
    return own, own - made[n : 2 * n] + made[2 * n :], [t[:start] + x for t, x, (_, start) in zip(texts, new, places)]


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches, BATCH):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([shown(x) for x in of(texts)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_chars long, fingerprint string")


def _of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ranges of documents in order, each closed by the first document of
    the next (``closes``), the result of every document."""
    ids, texts, closes = [], [], []
    for b in small_pieces(batches, BATCH):
        ids += b.column("doc_id").to_pylist()
        texts += b.column("text").to_pylist()
        closes += b.column("closes").to_pylist()
        at = [k for k in range(len(texts) - 1) if not closes[k]]
        if at:
            own, edited, made = moved([texts[k] for k in at], [texts[k + 1] for k in at])
            prints = dict(zip(at, own))
            others = [k + 1 for k in at if k + 1 not in prints]
            prints |= zip(others, of([texts[k] for k in others]))
            after = np.stack([prints[k + 1] for k in at])
            columns = [[ids[k] for k in at], [len(texts[k]) for k in at], [hashlib.sha256(t.encode()).hexdigest() for t in made], [shown(x) for x in own],
                       [shown(x) for x in edited], likeness(own, edited), likeness(own, after)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], RESULT)
        ids, texts, closes = ids[-1:], texts[-1:], closes[-1:]


def _ranges(rows: DataFrame) -> DataFrame:
    """Add the number of its range to each row, rising in the order of
    ``ORDER``. An id that several quantiles fall on has as many ranges more,
    cut by the hash of the text."""
    n = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("down", [(k + 1) / n for k in range(n - 1)] or [0.5], max(10_000, 4 * n))).first()[0] or []
    below = _before(cuts, lambda c: c < F.col("down"))
    equal = _before(cuts, lambda c: c <= F.col("down")) - below
    share = F.col("hash") / F.lit(2.0**64) + 0.5
    return rows.withColumn("range", (below + F.least(F.floor(share * (equal + 1)), equal)).cast("int"))


def _before(cuts: list[int], holds: Callable[[Column], Column], step: int = 128) -> Column:
    """How many of the rising cuts a condition holds for, which holds for the
    first ones: counted over every ``step``-th, then over those after it."""
    values = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    start = F.greatest(F.size(F.filter(values(cuts[::step]), holds)) - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(values(cuts), start + 1, step), holds))


ORDER = ["range", "closes", "down", "missing", "hash"]


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the complement of an id falls as the id rises, and does not overflow
    rows = rows.withColumn("down", F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1))).withColumn("missing", F.col("doc_id").isNull())
    rows = _ranges(rows.withColumn("hash", F.xxhash64("text")))
    # a row for each range, however many documents there are
    heads = rows.groupBy("range").agg(F.min(F.struct("down", "missing", "hash")).alias("head")).select("range", "head.*")
    firsts = rows.join(F.broadcast(heads), ["range", "down", "missing", "hash"], "left_semi").groupBy("range").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    firsts = stored(firsts, "fingerprint-ranges")
    there = sorted(r[0] for r in firsts.select("range").collect())
    before = docs.sparkSession.createDataFrame(list(zip(there, there[-1:] + there[:-1])), "range int, before int")
    closing = firsts.join(before, "range").select(F.col("before").alias("range"), "doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in (("down", "long"), ("missing", "boolean"), ("hash", "long"))), F.lit(True).alias("closes"))
    laid = rows.withColumn("closes", F.lit(False)).unionByName(closing).repartition("range").sortWithinPartitions(*ORDER)
    return arrow_pass(laid.select("doc_id", "text", "closes"), _of_ranges, SCHEMA)
