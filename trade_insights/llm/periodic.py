"""Operator 13: runs of repeated words, by an enhanced suffix array.

Each text is its sequence of words. The texts of a batch share one suffix array
(prefix doubling; a suffix ends with its text, so texts never mix), with the
inverse array (ISA) and the common lengths of neighbours (LCP). An LCP interval
is found from the nearest smaller lengths on both sides, as a range of ranks:
no tree and no nodes. For an interval of depth d, every suffix i outside the
largest child is asked whether suffix i + d or i - d has its rank in the
interval but in another child. If so, the words from the smaller of the two on
are a square of period d, and the next word breaks the period (a branching
tandem repeat). The square is rotated to the left as long as words d apart
agree, which gives the whole run; of runs with equal ends the smallest period
stays, so squares of multiples of a period merge into its run.

A run is kept if it has ``MIN_LENGTH`` words and ``MIN_POWER`` periods or more.
Work is O(n log n) for a text of n words. There is no shuffle: a text is judged
by itself, so no key and no group of copies can gather in a task. A batch holds
about ``BATCH`` bytes of text; a longer text is a batch of its own, and a task
needs some 150 bytes for each of its words.

Words are compared as they are, never by hash. Null, empty and blank texts have
no words and no runs. Of runs with equal length / period the one with the
smallest start, then the smallest period is the greatest. Repeated rows are
treated alike, an empty table gives an empty result, and other columns, also
such with names of the result, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, once, small_pieces, words

MIN_LENGTH, MIN_POWER = 6, 4
BATCH = 2 << 20


class SuffixArray:
    """Suffix array, its inverse and the LCP table of sequences laid end to
    end: ``symbols`` are small integers, ``stop`` the end of each position's
    sequence, ``owner`` its number. ``levels[k]`` has equal values where the
    next 2**k symbols are equal and within one sequence."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, stop: np.ndarray):
        n = self.n = len(symbols)
        key = owner * (int(symbols.max()) + 1) + symbols
        order = np.argsort(key, kind="stable")
        slots, rank = np.arange(n), np.full(n + 1, -1, np.int32)
        sorted_key, suffixes, self.levels, step = key[order], order.copy(), [], 1
        while True:
            first = np.ones(len(slots), bool)
            np.not_equal(sorted_key[1:], sorted_key[:-1], out=first[1:])
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(slots)))
            rank = rank.copy()
            suffixes[slots] = order
            rank[order] = np.repeat(slots[at], size)
            self.levels.append(rank)
            still = np.repeat(size > 1, size)
            if not still.any():
                break
            slots, order = slots[still], order[still]
            after = order + step
            key = rank[order].astype(np.int64) * (n + 2) + np.where(after < stop[order], rank[np.minimum(after, n)] + 1, 0)
            by = np.argsort(key, kind="stable")
            order, sorted_key, step = order[by], key[by], 2 * step
        self.suffixes, self.inverse = suffixes, rank
        self.lcp = self._neighbours()

    def _neighbours(self) -> np.ndarray:
        """Common lengths of each suffix and the one before it in order, with a
        0 at both ends; from the largest power of two down."""
        lcp = np.zeros(self.n + 1, np.int64)
        first = self.levels[0]
        at = np.flatnonzero(first[self.suffixes[1:]] == first[self.suffixes[:-1]]) + 1
        a, b = self.suffixes[at - 1].copy(), self.suffixes[at].copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][a] == self.levels[k][b]) << k
            a += same
            b += same
        lcp[at] = b - self.suffixes[at]
        return lcp

    def back(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols before x equal those before y, x < y being places of
        one sequence."""
        x, y, start = x.copy(), y.copy(), x
        for k in range(len(self.levels) - 1, -1, -1):
            p = x - (1 << k)
            same = ((p >= 0) & (self.levels[k][np.maximum(p, 0)] == self.levels[k][np.maximum(y - (1 << k), 0)])) << k
            x -= same
            y -= same
        return start - x

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each rank with a common length d > 0 to the one before: the first
        and the end rank of the interval of all suffixes that share d symbols,
        by doubling steps over range minima."""
        at = np.flatnonzero(self.lcp)
        d = self.lcp[at]
        gaps = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        longest = int(np.diff(np.append(gaps, len(at))).max(initial=0))
        tables = [self.lcp]
        while 1 << len(tables) <= longest:
            half = 1 << (len(tables) - 1)
            tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
        low, high = at.copy(), at + 1
        for k in range(len(tables) - 1, -1, -1):
            p = low - (1 << k)
            low -= ((p >= 0) & (tables[k][np.maximum(p, 0)] >= d)).astype(np.int64) << k
            inside = high < len(tables[k])
            high += (inside & (tables[k][np.minimum(high, len(tables[k]) - 1)] >= d)).astype(np.int64) << k
        return at, low - 1, high


def tandems(s: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching tandem repeats: squares whose next
    symbol breaks the period."""
    at, low, high = s.intervals()
    if not len(at):
        return at, at
    order = np.argsort(low * (s.n + 1) + high, kind="stable")
    at, low, high = at[order], low[order], high[order]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    group = np.flatnonzero(new)
    # the children of an interval lie between its first rank, its places of depth d and its end
    begin = np.insert(at, group, low[group])
    last = np.append(group[1:], len(at))
    end = np.insert(at, last, high[group])
    owner = np.insert(np.cumsum(new) - 1, group, np.arange(len(group)))
    size = end - begin
    heads = group + np.arange(len(group))
    largest = size == np.maximum.reduceat(size, heads)[owner]
    seen = np.cumsum(largest)
    largest &= seen - (seen[heads] - largest[heads])[owner] == 1  # one of several largest
    small = np.flatnonzero(~largest)
    count = size[small]
    child = np.repeat(small, count)
    rank = np.arange(len(child)) - np.repeat(np.cumsum(count) - count, count) + begin[child]
    i, d = s.suffixes[rank], s.lcp[at[group]][owner[child]]
    first, stop = low[group][owner[child]], high[group][owner[child]]

    def other_child(j: np.ndarray) -> np.ndarray:
        r = s.inverse[np.clip(j, 0, s.n)]
        return (j >= 0) & (j <= s.n) & (r >= first) & (r < stop) & ((r < begin[child]) | (r >= end[child]))

    ahead, behind = other_child(i + d), other_child(i - d)
    starts, periods = np.concatenate([i[ahead], (i - d)[behind]]), np.concatenate([d[ahead], d[behind]])
    return starts, periods


def found_runs(sequences: list[np.ndarray], min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[np.ndarray]:
    """For each sequence of small integers its runs as rows start, length,
    period, by start and period."""
    sizes = np.array([len(x) for x in sequences], np.int64)
    ends = np.cumsum(sizes)
    out = [np.zeros((0, 3), np.int64)] * len(sequences)
    if not sizes.sum():
        return out
    s = SuffixArray(np.concatenate(sequences).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), np.repeat(ends, sizes))
    i, d = tandems(s)
    start, end = i - s.back(i, i + d), i + 2 * d
    keep = end - start >= np.maximum(min_length, min_power * d)
    runs = np.unique(np.stack([start[keep], end[keep], d[keep]], axis=1), axis=0)
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # the smallest period of equal stretches
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    for k in np.unique(owner):
        r = runs[owner == k]
        out[k] = np.stack([r[:, 0] - (ends[k] - sizes[k]), r[:, 1] - r[:, 0], r[:, 2]], axis=1)
    return out


def read(texts: list[bytes], **least) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text."""
    number: dict[bytes, int] = {}
    split = [t.split() for t in texts]  # bytes split at the six blanks of the contracts, and at no other
    ids = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in split]
    return zip(split, found_runs(ids, **least))


def left_over(found: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return found
    gone = np.zeros(len(found) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [w for w, g in zip(found, np.cumsum(gone).tolist()) if not g]


def greatest(runs: np.ndarray) -> list[int] | None:
    """The run of greatest length / period, compared exactly."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = [start, length, period]
    return best


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> DataFrame:
    """doc_id, start (word number), length, period (in words) and the words of
    one period, for every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches, BATCH):
            rows = [(i, s, n, p, b" ".join(w[s : s + p]).decode()) for i, (w, found) in zip(b.column("doc_id").to_pylist(), read(as_bytes(b.column("text")), min_length=min_length, min_power=min_power)) for s, n, p in found.tolist()]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "start", "length", "period", "unit"])

    return arrow_pass(_rows(docs), run, "doc_id long, start long, length long, period long, unit string")


def collapsed(docs: DataFrame, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> DataFrame:
    """doc_id, text with one period left of each run (words joined by one
    space), n_words, n_runs, and the run of greatest length / period."""
    return _pass(docs, False, min_length, min_power)


def digests(docs: DataFrame) -> DataFrame:
    """``collapsed`` with digests in place of the texts and of the runs."""
    return _pass(docs, True, MIN_LENGTH, MIN_POWER)


def _pass(docs: DataFrame, digest: bool, min_length: int, min_power: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches, BATCH):
            rows = []
            for w, found in read(as_bytes(b.column("text")), min_length=min_length, min_power=min_power):
                best = greatest(found)
                text = b" ".join(left_over(w, found))
                row = {"n_words": len(w), "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2]}
                if digest:
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
                    row |= {"runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text).hexdigest()}
                else:
                    row["text"] = text.decode()
                rows.append(row)
            made = pa.RecordBatch.from_pylist(rows, pa.schema([pa.field(n, pa.string() if n in texts else pa.int64()) for n in names]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made.columns], ["doc_id", *names])

    texts = ["runs_sha256", "collapsed_sha256"] if digest else ["text"]
    names = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", *texts]
    return arrow_pass(_rows(docs), run, "doc_id long, " + ", ".join(f"{n} {'string' if n in texts else 'long'}" for n in names))


def planted(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """doc_id and text, where one document in ``one_in`` (by the CRC of its id)
    repeats some of its words from a place on: word i >= a becomes word
    a + (i - a) % p. A null id's document stays as it is."""
    crc: Column = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = _rows(docs).withColumn("g", F.floor(crc / one_in).cast("long"))
    rows = rows.select("doc_id", "text", "g", once(F.when(crc % one_in == 0, words(F.col("text"))), "w"))
    n = F.size("w")
    a = F.when(n > 0, F.col("g") % n)
    rows = rows.select("*", once(a, "a")).withColumn("p", F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)).cast("long") + 1)
    from_place = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.when(F.col("a").isNotNull(), F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a").cast("int")), from_place)).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))
