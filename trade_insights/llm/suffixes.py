"""Operator 3: suffix-array dedup with prefix-free parsing, on bytes.

A rolling hash over ``GRAM`` bytes triggers phrase ends: of every ``SPREAD``
places in a row, that of the smallest hash is one. So a 200-byte string fixes
its own trigger, at an offset below ``SPREAD``, and equal strings have it at the
same offset. What stands left of a trigger belongs to the dictionary of phrase
ends, what stands right of it to the parse. Triggers whose right side starts
like that of another one are dealt out by this start; there the dictionary is
sorted from its right end and the parse from its left end (with the lengths
that neighbours have in common), and both orders combine into the order of the
corpus: strings of one offset, sorted by dictionary suffix and parse, are
neighbours if they are equal. Equal strings are marked wherever they occur.

A start that recurs more than ``HOT`` times has its strings dealt out and
counted one by one (by the 64-bit hashes of start and string; elsewhere the
bytes themselves are compared), so no task holds a group that grows with the
corpus. Equal
texts are one text here; all of it recurs if it is long enough.

Null and empty texts have no bytes; shorter texts than 200 bytes lose none.
Rows that agree in doc_id and text are one document and get the same result.
Removed runs may cut a character in two; the kept bytes are what is left. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import RangeHash, arrow_pass, as_bytes, small_pieces, sorted_groups, stored
from .text_arrays import byte_values

LENGTH, GRAM, SPREAD = 200, 16, 160
#: Rows of triggers that a task orders at once, whole groups.
ROWS = 20_000
_GRAM, _KEY, _STRING = RangeHash(31), RangeHash(32), RangeHash(33)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by running minima of blocks."""
    n = len(v)
    rows = np.full(-(-n // width) * width, np.iinfo(v.dtype).max, v.dtype)
    rows[:n] = v
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def triggers(values: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The trigger of each string of ``length`` bytes."""
    n = len(values)
    if n < length:
        return np.zeros(0, np.int64)
    spread = min(SPREAD, length - GRAM + 1)
    at = np.arange(n - (length - spread))
    order = (_GRAM.of(_GRAM.prefix(values), at, at + GRAM) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    return (sliding_min(order, spread) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors_of(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    values = byte_values(text)
    place = np.unique(triggers(values, length))
    common = length - min(SPREAD, length - GRAM + 1) + 1
    return (_KEY.of(_KEY.prefix(values), place, place + common) if len(place) else np.zeros(0, np.uint64)), place


MEMBERS = "key long, hot boolean, head long, node long, place int, least int, most int, left binary, right binary"


def members(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """For each recurring trigger the least and most bytes that its strings
    have before it, and the bytes on its left and right."""
    names = ["key", "hot", "head", "node", "place", "least", "most", "left", "right"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for b in small_pieces(batches, 1 << 20):
        out: list[list] = [[] for _ in names]
        for head, node, text, seeds in zip(b.column("head").to_pylist(), b.column("node").to_pylist(), as_bytes(b.column("text")), b.column("seeds").to_pylist()):
            at = triggers(byte_values(text), length)
            place = np.array([s["place"] for s in seeds])
            lo, hi = np.searchsorted(at, place).tolist(), (np.searchsorted(at, place + 1) - 1).tolist()
            for s, first, last in zip(seeds, lo, hi):
                p = s["place"]
                least, most = p - last, p - first
                for o, v in zip(out, (s["key"], s["hot"], head, node, p, least, most, text[p - most : p], text[p : p + length - least])):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)


def _padded(parts: list[bytes], width: int, reverse: bool = False) -> np.ndarray:
    out = np.frombuffer(b"".join([p.rjust(width, b"\0") if reverse else p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)
    return out[:, ::-1] if reverse else out


def _ordered(key: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by key and bytes, and how many bytes each has in
    common with the row before it (0 where the key changes)."""
    whole = np.ascontiguousarray(np.column_stack([key.astype(">u8").view(np.uint8).reshape(-1, 8), rows]))
    order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
    s, k, n = rows[order], key[order], size[order]
    unequal = np.column_stack([s[1:] != s[:-1], np.ones(len(s) - 1, bool)])
    common = np.zeros(len(s), np.int64)
    common[1:] = np.where(k[1:] == k[:-1], np.minimum(unequal.argmax(axis=1), np.minimum(n[1:], n[:-1])), 0)
    return order, common


class RangeMin:
    """Minima of ranges of an array, from minima of ranges of powers of two."""

    def __init__(self, a: np.ndarray):
        self.levels = [a]
        while len(self.levels[-1]) > (w := 1 << (len(self.levels) - 1)):
            top = self.levels[-1]
            self.levels.append(np.minimum(top[: len(top) - w], top[w:]))
        self.table = np.zeros((len(self.levels), len(a)), a.dtype)
        for k, row in enumerate(self.levels):
            self.table[k, : len(row)] = row

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of [first, end), not empty."""
        k = (np.frexp((end - first).astype(np.float64))[1] - 1).astype(np.int64)
        return np.minimum(self.table[k, first], self.table[k, end - (1 << k)])


def equal_strings(key: np.ndarray, least: np.ndarray, most: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and offsets of the strings that equal another row's."""
    n = len(key)
    by_right, common_right = _ordered(key, _padded(right, length), np.array([len(x) for x in right]))
    by_left, common_left = _ordered(key, _padded(left, max(1, int(most.max())), True), np.array([len(x) for x in left]))
    rank = np.empty(n, np.int64)
    rank[by_right] = np.arange(n)
    smallest = RangeMin(common_right)
    apart = np.ones(n, bool)
    apart[1:] = key[by_left[1:]] != key[by_left[:-1]]
    rows, offsets = [], []
    for o in range(int(least.min()), int(most.max()) + 1):
        kind = np.empty(n, np.int64)
        kind[by_left] = np.cumsum(apart | (common_left < o))
        here = np.flatnonzero((least <= o) & (o <= most))
        if len(here) < 2:
            continue
        here = here[np.argsort(kind[here] * n + rank[here])]
        k, r = kind[here], rank[here]
        same = np.zeros(len(here) + 1, bool)
        pair = np.flatnonzero(k[1:] == k[:-1])
        same[pair + 1] = smallest(r[pair] + 1, r[pair + 1] + 1) >= length - o
        found = here[same[1:] | same[:-1]]
        rows.append(found)
        offsets.append(np.full(len(found), o, np.int64))
    return (np.concatenate(rows), np.concatenate(offsets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def repeats(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Runs of the strings that occur more than once."""
    for group in sorted_groups(batches, "key", ROWS):
        group = group.combine_chunks()
        key, head, node, place, least, most = (group.column(c).to_numpy() for c in ("key", "head", "node", "place", "least", "most"))
        # a document that stands in the table twice is one
        _, own = np.unique(np.column_stack([key, head, node, place]), axis=0, return_index=True)
        left, right = as_bytes(group.column("left").chunk(0)), as_bytes(group.column("right").chunk(0))
        row, offset = equal_strings(key[own].view(np.uint64), least[own], most[own], [left[i] for i in own], [right[i] for i in own], length)
        row = own[row]
        yield A.run_batch(head, node, row, place[row] - offset, length)


def single(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The strings of hot triggers, each as a hash with its place."""
    for b in small_pieces(batches, 1 << 18):
        out: list[list] = [[], [], [], [], []]
        for key, head, node, place, least, most, left, right in zip(*(b.column(c).to_pylist() for c in ("key", "head", "node", "place", "least", "most")), as_bytes(b.column("left")), as_bytes(b.column("right"))):
            at = np.arange(most - least + 1)
            hashes = _STRING.of(_STRING.prefix(byte_values(left + right)), at, at + length).view(np.int64)
            for o, v in zip(out, (np.full(len(at), key), hashes, np.full(len(at), head), np.full(len(at), node), place - most + at)):
                o.append(v)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(k) if o else np.zeros(0, k)) for o, k in zip(out, kinds)], ["key", "window", "head", "node", "start"])


def found_runs(docs: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    texts = A.heads(docs, partial(anchors_of, length=length), "suf")
    seeds = A.recurring(texts, hot, "suf")
    rows = stored(A.extended(docs, seeds, partial(members, length=length), MEMBERS), "suf-members")
    runs = arrow_pass(A.by_key(rows.where("not hot").drop("hot")), partial(repeats, length=length), A.RUNS)
    windows = arrow_pass(rows.where("hot").drop("hot"), partial(single, length=length), "key long, window long, head long, node long, start int")
    pairs = A.window_pairs(windows, F.lit(True))
    return texts, runs.unionByName(pairs.select("head", "node", F.array("start", F.col("start") + length).alias("runs")))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<int>"


def cleaned(docs: DataFrame, length: int = LENGTH, hot: int = A.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)
    and spans (alternating first and end byte of each removed run)."""
    texts, runs = found_runs(docs, length, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches):
            out: list[list] = [[] for _ in range(6)]
            for head, last, runs, text in zip(*(b.column(c).to_pylist() for c in ("head", "last", "runs")), as_bytes(b.column("text"))):
                gone = A.marked(runs, len(text)) if head == last else np.full(len(text), len(text) >= length)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for o, v in zip(out, (len(text), int(gone.sum()), len(edge) // 2, hashlib.sha256(left).hexdigest(), left, edge.astype(np.int32))):
                    o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(o, k) for o, k in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return A.with_facts(docs, A.facts(texts, runs, "suf"), run, RESULT)
