"""What the operators on repeated passages share: texts reduced to anchors,
the anchors that recur, and the way from repeated windows back to documents.

A document is a doc_id with a text; rows that agree in both are one. Documents
of equal texts are represented by the one with the smallest doc_id, the head
(null counts as the smallest), so a group of copies of any size is one text
here. An anchor is a position of a text that the content around it chooses, with a key
that hashes content which every window of this anchor holds: only windows
whose anchor's key occurs twice can recur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, small_pieces, stored

NO_ID = -(1 << 63)
#: Occurrences of a key beyond which its windows are dealt out one by one.
HOT = 32_768


def documents(docs: DataFrame) -> DataFrame:
    """id (null doc_ids as the smallest), doc_id, text (null as empty) and its digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def heads(docs: DataFrame, anchors_of: Callable[[bytes], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """digest, head, last (smallest and largest id of the copies), node (tells
    texts of one id apart), keys and places of the anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches):
            found = [anchors_of(t) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), pa.array([k.view(np.int64) for k, _ in found], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in found], pa.list_(pa.int32()))], ["id", "digest", "keys", "places"])

    own = arrow_pass(documents(docs).select("id", "text", "digest"), run, "id long, digest binary, keys array<bigint>, places array<int>")
    texts = own.groupBy("digest").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.first(F.struct("keys", "places")).alias("at"))
    return stored(texts.select("digest", "head", "last", F.xxhash64("digest").alias("node"), "at.keys", "at.places"), f"{name}-heads")


def recurring(texts: DataFrame, hot: int, name: str) -> DataFrame:
    """head, digest, node and seeds (place, key, whether the key is hot) of
    texts with anchors whose keys occur more than once."""
    anchors = texts.select("head", "node", F.inline(F.arrays_zip("places", "keys"))).withColumnsRenamed({"places": "place", "keys": "key"})
    often = stored(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > hot).alias("hot")), f"{name}-often")
    seeds = anchors.join(often, "key").groupBy("head", "node").agg(F.collect_list(F.struct("place", "key", "hot")).alias("seeds"))
    return stored(seeds, f"{name}-seeds")


def extended(docs: DataFrame, seeds: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over the texts that have seeds: head, node, text, seeds."""
    own = documents(docs).withColumn("node", F.xxhash64("digest"))
    rows = own.join(seeds, (own["id"] == seeds["head"]) & (own["node"] == seeds["node"])).select(seeds["head"], seeds["node"], "text", "seeds")
    return arrow_pass(rows, run, schema)


def by_key(members: DataFrame) -> DataFrame:
    return members.repartition("key").sortWithinPartitions("key")


def runs_of(owner: np.ndarray, start: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each owner, the union of the ranges [start, start + length) as
    alternating starts and ends."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    if not len(owner):
        return
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1
    edges = np.column_stack([start[first], start[last] + length])
    owners = owner[first]
    cuts = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1).tolist(), len(owners)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(owners[a]), edges[a:b].ravel()


RUNS = "head long, node long, runs array<int>"


def run_batch(head: np.ndarray, node: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """A batch of RUNS of the ranges at ``start`` of the texts of ``row``."""
    texts, owner = np.unique(np.column_stack([head, node]), axis=0, return_inverse=True)
    found = list(runs_of(owner.ravel()[row], start, length))
    at = np.array([o for o, _ in found], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(texts[at, 0] if len(at) else [], pa.int64()), pa.array(texts[at, 1] if len(at) else [], pa.int64()), pa.array([r.astype(np.int32) for _, r in found], pa.list_(pa.int32()))], ["head", "node", "runs"])


def facts(texts: DataFrame, runs: DataFrame, name: str) -> DataFrame:
    """digest, head, last and the runs of each text (null: none)."""
    runs = runs.groupBy("head", "node").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return stored(texts.select("digest", "head", "last", "node").join(runs, ["head", "node"], "left").select("digest", "head", "last", "runs"), f"{name}-facts")


def window_pairs(windows: DataFrame, one: Column) -> DataFrame:
    """Of rows key, window, head, node, start: those with an equal window for
    which ``one``, on first and last occurrence of the window, holds."""
    place = F.struct("head", "node", "start")
    ends = stored(windows.groupBy("key", "window").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first <> final"), "window-ends")
    return windows.join(ends, ["key", "window"]).where(one)


def marked(runs: list[int] | None, n: int) -> np.ndarray:
    """Which of n places the runs cover."""
    step = np.zeros(n + 1, np.int32)
    if runs:
        r = np.asarray(runs, np.int64)
        np.add.at(step, r[0::2], 1)
        np.add.at(step, r[1::2], -1)
    return np.cumsum(step[:-1]) > 0


def with_facts(docs: DataFrame, found: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over every document: id, doc_id, text, head, last, runs."""
    return arrow_pass(documents(docs).join(found, "digest").select("id", "doc_id", "text", "head", "last", "runs"), run, schema)
