"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from ..sources.store import delete_folder

#: The words of the contracts: runs of anything but these six ASCII blanks.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same blanks as a Java pattern.
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new folder for a table, or the one that holds all tables of this
    application, below the shared checkpoint folder."""
    own = work_dir(spark, f"llm/{spark.sparkContext.applicationId}")
    return f"{own}/{name}-{uuid.uuid4().hex}" if name else own


def clear(spark: SparkSession) -> None:
    """Remove the tables that the operators have written in this application.
    Their results read them, so this comes after the last use of a result."""
    delete_folder(spark, scratch(spark))


#: Folders that this driver's applications have written, in order.
_written: list[str] = []


def written() -> int:
    """How many tables have been written so far."""
    return len(_written)


def release(spark: SparkSession, since: int) -> None:
    """Remove the tables written after the first ``since``, but for the last,
    into which what read the others has been written."""
    for at in range(since, len(_written) - 1):
        if _written[at]:
            delete_folder(spark, _written[at])
            _written[at] = ""


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read to a new folder below the
    cluster's shared checkpoint folder, and read it back: the lineage ends
    there, and a lost executor costs no recomputation. The driver's garbage is
    collected, which lets Spark remove the shuffle files of the finished step."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    _written.append(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each
    application; Spark serves the file from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


#: In a Python worker: how to free the tables that operators keep between its
#: tasks, by module.
held: dict[str, Callable[[], None]] = {}


def free_others(own: str) -> None:
    for module in [m for m in held if m != own]:
        held.pop(module)()


def arrow_pass(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers. Spark uses
    a worker for one step after the other; what other operators have kept in
    it is freed first."""
    ship(df.sparkSession)
    own = getattr(run, "func", run).__module__

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_others(own)
        yield from run(batches)

    return df.mapInArrow(passed, schema)


def small_pieces(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``most`` bytes, or one
    row where a single row is larger."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(n, int(n * most / max(batch.nbytes, 1))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words(text: Column) -> Column:
    """The array of words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def once(c: Column, name: str) -> Column:
    """A column computed once for a row though expressions on it, lambdas too,
    read it often: the optimiser does not move a generator's output."""
    return F.inline(F.array(F.struct(c.alias(name))))


def word_count(text: Column) -> Column:
    """Number of words of a text without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


_SPLIT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64)."""
    x = x + _SPLIT[0]
    x = (x ^ (x >> np.uint64(30))) * _SPLIT[1]
    x = (x ^ (x >> np.uint64(27))) * _SPLIT[2]
    return x ^ (x >> np.uint64(31))


def odd_powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd 64-bit base drawn from ``seed``, and those of
    its inverse modulo 2**64."""
    base = int(mixed(np.array([seed], np.uint64))[0]) | 5
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        if n:
            p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class RangeHash:
    """Hashes of ranges of a sequence of 64-bit values, by prefix sums of
    value times power (modulo 2**64). ``grow`` keeps the powers long enough."""

    def __init__(self, seed: int):
        self.seed, self.size = seed, 0

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            self.up, self.down = odd_powers(self.seed, self.size)
        return self.up, self.down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1) -> Iterator[pa.Table]:
    """From batches sorted by ``key``, tables that hold whole groups: one group
    each, or as many as it takes for about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        if held and held[-1].column(key)[-1].as_py() != keys[0] and size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        at = 0
        for start, end in zip(cuts, cuts[1:]):
            if start and size + start - at >= rows and start > at:
                held.append(batch.slice(at, start - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, start
        held.append(batch.slice(at))
        size += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)
