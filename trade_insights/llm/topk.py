"""Operator 2: exact top-k search over norm-sorted inner products.

Vectors of integers (the components times a scale, rounded down) are ranged by
descending length into slices and cut into blocks. All are rotated by the
eigenvectors of their second moments, so the first coordinates hold most of
each inner product. A block of queries first meets the block of the longest
vectors, which gives each query a floor: the score of its k-th best so far.
Then it meets the blocks of every slice, longest first: a block is passed over
if no product of lengths reaches a floor, a vector if its partial sum plus the
product of the remaining lengths (Cauchy-Schwarz) does not, and the rest are
scored exactly with integers. The floors rise on the way; the best k of a query
over all slices are the result. The outcome does not depend on the rotation,
which only decides what is skipped.

Each pair of a query block and a slice is a piece of work of its own. Nothing
grows with the data in any task or on the driver but the moments, whose size
is the square of the dimension.

Vectors that are null or hold a null or non-finite component, and rows with a
null id, take no part. Shorter vectors count as padded with zeros. Rows that
agree in id and vector are one; of different vectors under one id each is a
candidate, and each a query, but never for its own id. With fewer candidates
than k all are returned. Ties go to the smaller id. Scores that do not fit 64
bits raise an error. Empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, stored

K, SCALE = 20, 64
SLICE, BLOCK, QUERY_BLOCK = 16_384, 2048, 512
#: Share of the rotated coordinates in a partial sum.
PART = 0.25
#: Share of candidate pairs beyond which a block is scored as a whole.
DENSE = 0.05
#: Integers below this are exact as doubles.
EXACT = float(1 << 53)


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (doubles with integer values) and norm of the valid rows."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))
    out = out.distinct()
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _square(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the second moments, by falling eigenvalue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _square(b.column("v"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "value"])

    sums = arrow_pass(vectors.select("v"), run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    moments = np.zeros(dim * dim)
    for r in sums:
        moments[r["at"]] = r["value"]
    return np.linalg.eigh(moments.reshape(dim, dim))[1][:, ::-1].copy()


def blocks(vectors: DataFrame, parts: int, size: int, dim: int, name: str) -> DataFrame:
    """slice (0 has the longest vectors), block (in the slice, longest first),
    n, top_norm, ids and vectors (packed, by falling norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed(table: pa.Table) -> pa.RecordBatch:
            ids, norm, x = table.column("vec_id").to_numpy(), table.column("norm").to_numpy(), _square(table.column("v"), dim)
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([k], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([float(norm[0])]), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["slice", "block", "n", "top_norm", "ids", "vectors"])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - rows)
                b = b.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == size:
                    yield packed(pa.Table.from_batches(held))
                    k, held, rows = k + 1, [], 0
        if held:
            yield packed(pa.Table.from_batches(held))

    order = (F.col("norm").desc(), F.col("vec_id"))
    dealt = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(arrow_pass(dealt, run, "slice int, block int, n int, top_norm double, ids binary, vectors binary"), name)


class Best:
    """The k best of each query of a block, and its floor."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rot: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.q, self.k, self.floors = ids, q, k, floors.copy()
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.turned, self.cut = q @ rot, max(1, int(q.shape[1] * PART))
        self.rest = np.sqrt((self.turned[:, self.cut :] ** 2).sum(axis=1))
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def meet(self, ids: np.ndarray, v: np.ndarray, rot: np.ndarray) -> None:
        norm = np.sqrt((v * v).sum(axis=1))
        slack = 1e-9 * norm.max(initial=0) * self.norm.max(initial=0) + 1e-6
        here = np.flatnonzero(self.norm * norm.max(initial=0) >= self.floors - slack)
        if not len(here):
            return
        turned = v @ rot
        rest = np.sqrt((turned[:, self.cut :] ** 2).sum(axis=1))
        bound = self.turned[here, : self.cut] @ turned[:, : self.cut].T
        bound += self.rest[here, None] * rest[None, :]
        keep = bound >= (self.floors[here] - slack)[:, None]
        keep &= self.ids[here, None] != ids[None, :]
        row, column = np.nonzero(keep)
        if not len(row):
            return
        exact = np.abs(self.q).max() * np.abs(v).max() * v.shape[1] < EXACT
        if not exact and np.abs(self.q[here] @ v.T).max() > 9e18:
            raise OverflowError("an inner product does not fit a 64-bit integer")
        q, w = (self.q[here], v) if exact else (self.q[here].astype(np.int64), v.astype(np.int64))
        if len(row) > DENSE * keep.size:
            score = (q @ w.T)[row, column]
        else:
            score = np.einsum("ij,ij->i", q[row], w[column])
        score = score.astype(np.int64)
        good = score >= np.maximum(self.floors[here], -(2.0**62))[row]
        row, column, score = row[good], column[good], score[good]
        cuts = np.searchsorted(row, np.arange(len(here) + 1))
        for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
            at = slice(cuts[i], cuts[i + 1])
            s, d = np.concatenate([self.found[here[i]][0], score[at]]), np.concatenate([self.found[here[i]][1], ids[column[at]]])
            first = np.lexsort((d, -s))[: self.k]
            self.found[here[i]] = s[first], d[first]
            if len(first) == self.k:
                self.floors[here[i]] = max(self.floors[here[i]], float(s[first[-1]]))


def _block(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def _met(pairs: DataFrame, v: DataFrame, q: DataFrame, dim: int, rot: np.ndarray, k: int, floors_only: bool) -> DataFrame:
    """Queries of each q_slice, q_block of pairs against the blocks of its
    slice. Their best as rows, or only the floors of each query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = None, None

        def told() -> pa.RecordBatch:
            if floors_only:
                return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int32()), pa.array([best.floors.tobytes()], pa.binary()), pa.array([float(best.floors.min())])], ["q_slice", "q_block", "floors", "least_floor"])
            n = [len(s) for s, _ in best.found]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, n)), pa.array(np.concatenate([d for _, d in best.found])), pa.array(np.concatenate([s for s, _ in best.found]))], ["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                mine = r["q_slice"], r["q_block"], r["slice"]
                if mine != own:
                    if best is not None:
                        yield told()
                    ids, x = _block(r["q_ids"], r["q_vectors"], dim)
                    floors = np.frombuffer(r["floors"], np.float64) if r["floors"] else np.full(len(ids), -np.inf)
                    own, best = mine, Best(ids, x, rot, floors, k)
                best.meet(*_block(r["ids"], r["vectors"], dim), rot)
        if best is not None:
            yield told()

    work = ["q_slice", "q_block", "slice"]
    rows = pairs.join(v, ["slice", "block"]).join(q.withColumnsRenamed({"slice": "q_slice", "block": "q_block", "ids": "q_ids", "vectors": "q_vectors"}).select("q_slice", "q_block", "q_ids", "q_vectors"), ["q_slice", "q_block"])
    rows = rows.select(*work, "block", "ids", "vectors", "q_ids", "q_vectors", "floors").repartition(*work).sortWithinPartitions(*work, "block")
    return arrow_pass(rows, run, "q_slice int, q_block int, floors binary, least_floor double" if floors_only else "query_id long, vec_id long, score long")


def nearest(rows: DataFrame, queries: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` the
    k best inner products with the other rows."""
    vectors = stored(integers(rows, scale), "top-vectors")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.count(F.when(queries, 1)).alias("q")).first()
    dim = max(1, size["dim"] or 1)
    rot = rotation(vectors, dim)
    v = blocks(vectors, max(1, -(-size["n"] // SLICE)), BLOCK, dim, "top-blocks")
    q = blocks(vectors.where(queries), max(1, -(-size["q"] // SLICE)), QUERY_BLOCK, dim, "top-queries")
    top = v.where((F.col("slice") == 0) & (F.col("block") == 0)).select("slice", "block")
    own = q.select(F.col("slice").alias("q_slice"), F.col("block").alias("q_block"), F.col("top_norm").alias("q_norm"))
    first = own.select("q_slice", "q_block", F.lit(0).alias("slice"), F.lit(0).alias("block"), F.lit(None).cast("binary").alias("floors")).join(top, ["slice", "block"], "left_semi")
    floors = stored(_met(first, v, q, dim, rot, k, True), "top-floors")
    last = v.agg(F.max("slice")).first()[0] or 0
    # every query block with every slice, then with those of its blocks that can reach a floor
    work = own.join(floors, ["q_slice", "q_block"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(last))))
    pairs = work.join(v.select("slice", "block", "top_norm"), "slice").where(F.col("q_norm") * F.col("top_norm") * (1 + 1e-9) + 1e-6 >= F.col("least_floor"))
    found = _met(pairs.select("q_slice", "q_block", "slice", "block", "floors"), v, q, dim, rot, k, False)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # vectors of one id: each pair of ids has its best score
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
