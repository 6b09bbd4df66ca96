"""Operator 1: substring dedup by seed and extend, on words.

Words are the runs of anything but ASCII blanks. Among the 5-grams of a window
of 20 words the one of smallest hash is the window's anchor (winnowing), so
equal windows have equal anchors at equal offsets. Documents are joined on
anchors that recur: a seed is extended to both sides, by each number of words
that its windows have before and after it, and an extension that also starts
earlier (in a document of smaller doc_id, or earlier in the same one) is a
repeat. Repeats that touch or overlap are joined to the maximal ones, whose
words are removed.

A key that recurs more than ``HOT`` times has its extensions dealt out and
aggregated one by one, so no task holds a group that grows with the corpus.
Windows are equal if the 64-bit hashes of both anchor and window are.

Null, empty and blank texts have no words; texts of fewer than 20 words lose
none. Rows that agree in doc_id and text are one document (neither is earlier)
and get the same result; of different texts under one doc_id the one with the
smaller digest is earlier; a null doc_id is earlier than any. An empty table
gives an empty result; further columns are ignored.
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
from .text_arrays import spans, word_hashes

WINDOW, GRAM = 20, 5
_GRAM, _WINDOW = RangeHash(21), RangeHash(22)
#: Rows of recurring anchors that a task compares at once, whole groups.
ROWS = 30_000


def chosen(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of each window, and the keys of all grams."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(h) - gram + 1)
    keys = _GRAM.of(_GRAM.prefix(h), at, at + gram)
    spread = window - gram + 1
    seen = np.lib.stride_tricks.sliding_window_view(keys, spread)
    return seen.argmin(axis=1) + np.arange(len(seen)), keys


def anchors_of(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    place, keys = chosen(word_hashes(text)[2], window, gram)
    place = np.unique(place)
    return keys[place], place


MEMBERS = "key long, hot boolean, head long, node long, start int, windows array<bigint>"


def members(batches: Iterator[pa.RecordBatch], window: int = WINDOW, gram: int = GRAM) -> Iterator[pa.RecordBatch]:
    """The windows of each seed, as hashes of its extensions in order."""
    for b in small_pieces(batches, 1 << 20):
        out: dict[str, list] = {c: [] for c in ("key", "hot", "head", "node", "start", "windows")}
        for head, node, text, seeds in zip(b.column("head").to_pylist(), b.column("node").to_pylist(), as_bytes(b.column("text")), b.column("seeds").to_pylist()):
            h = word_hashes(text)[2]
            place, _ = chosen(h, window, gram)
            at = np.arange(len(place))
            hashes = _WINDOW.of(_WINDOW.prefix(h), at, at + window).view(np.int64)
            for s in seeds:
                lo, hi = np.searchsorted(place, [s["place"], s["place"] + 1])
                for c, v in zip(out, (s["key"], s["hot"], head, node, lo, hashes[lo:hi])):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["hot"], pa.bool_()), pa.array(out["head"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["windows"], pa.list_(pa.int64()))], list(out))


def repeats(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Runs of the windows that have an earlier equal one."""
    for group in sorted_groups(batches, "key", ROWS):
        group = group.combine_chunks()
        key, head, node, start = (group.column(c).to_numpy() for c in ("key", "head", "node", "start"))
        windows = group.column("windows").chunk(0)
        size = np.diff(windows.offsets.to_numpy())
        row = np.repeat(np.arange(len(key)), size)
        value = windows.flatten().to_numpy()
        at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((at, node[row], head[row], value, key[row]))
        r, v, w = row[order], value[order], at[order]
        fresh = np.ones(len(r), bool)
        fresh[1:] = (v[1:] != v[:-1]) | (key[r[1:]] != key[r[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
        later = (head[r] != head[r[first]]) | (node[r] != node[r[first]]) | (w != w[first])
        yield A.run_batch(head, node, r[later], w[later].astype(np.int64), window)


def found_runs(docs: DataFrame, window: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    texts = A.heads(docs, partial(anchors_of, window=window, gram=gram), "sub")
    seeds = A.recurring(texts, hot, "sub")
    rows = stored(A.extended(docs, seeds, partial(members, window=window, gram=gram), MEMBERS), "sub-members")
    runs = arrow_pass(A.by_key(rows.where("not hot").drop("hot")), partial(repeats, window=window), A.RUNS)
    windows = rows.where("hot").select("key", "head", "node", "start", F.posexplode("windows").alias("i", "window")).select("key", "window", "head", "node", (F.col("start") + F.col("i")).alias("start"))
    later = A.window_pairs(windows, F.struct("head", "node", "start") > F.col("first"))
    runs = runs.unionByName(later.select("head", "node", F.array("start", F.col("start") + window).alias("runs")))
    return texts, runs


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<int>"


def cleaned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = A.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by
    one space) and spans (alternating first and end word of each maximal
    repeat) of each document."""
    texts, runs = found_runs(docs, window, gram, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches):
            n_words, n_removed, digests, kept, found = [], [], [], [], []
            for own, head, runs, text in zip(b.column("id").to_pylist(), b.column("head").to_pylist(), b.column("runs").to_pylist(), as_bytes(b.column("text"))):
                first, end = spans(text)
                gone = A.marked(runs, len(first)) if own == head else np.full(len(first), len(first) >= window)
                left = b" ".join([text[x:y] for x, y in zip(first[~gone].tolist(), end[~gone].tolist())])
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                for out, v in zip((n_words, n_removed, digests, kept, found), (len(first), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode(), edge.astype(np.int32))):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return A.with_facts(docs, A.facts(texts, runs, "sub"), run, RESULT)
