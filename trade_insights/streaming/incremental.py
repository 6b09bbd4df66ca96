"""Incremental ingest of dropped import files with Structured Streaming.

A file-source stream lists new files in the drop folder (``binaryFile``
format, only the ``path`` column is selected, so contents are not read by the
stream itself). Each micro-batch hands its new paths, at most
``max_files_per_trigger`` of them, to ``foreachBatch``, which ingests them all
in one plan (S1-S15): every file is one upload batch, exactly like the upload
endpoint, and the earlier file's row stays where two files hold the same one.

Exactly-once result under at-least-once delivery: the upload batch id is
derived from the file path (not the clock), the batches' own earlier rows are
left out of the dedup and what the store holds of them is replaced, so a replayed
micro-batch leaves the store as if it ran once. Progress is tracked in the
stream checkpoint, so a restarted job only sees files it has not finished.
"""

from __future__ import annotations

import hashlib
import os
from typing import Callable

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from ..operators.ingest import check_category, ingest_files
from ..schema import CATEGORIES
from ..sources.store import read_exports, store_exists

# Files that a trigger takes in at most, unless the caller says otherwise.
MAX_FILES = 500


# Fixed schema of the binaryFile source (a stream source needs it up front).
BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def batch_id_for(path: str) -> str:
    """Stable upload-batch id of a dropped file: the start of its name, for
    readers, and the digest of its whole path, which tells files apart."""
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    safe = "".join(ch if ch.isalnum() or ch in "-_" else "_" for ch in stem)[:40]
    return f"{safe}-{hashlib.sha256(path.encode()).hexdigest()}"


def category_from_folder(path: str) -> str:
    """Category = name of the folder the file was dropped into."""
    folder = os.path.basename(os.path.dirname(path.rstrip("/")))
    return check_category(folder if folder in CATEGORIES else folder.lower())


def incremental_ingest(spark: SparkSession, in_dir: str, checkpoint: str, store_path: str,
                       fmt: str = "csv", category_of: Callable[[str], str] = category_from_folder,
                       max_files_per_trigger: int = MAX_FILES, available_now: bool = True,
                       reports: list | None = None):
    """Start the stream; with ``available_now`` it processes every file
    present and stops. Returns the StreamingQuery. Per-file import reports
    are appended to ``reports`` when a list is given."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("pathGlobFilter", f"*.{fmt}")
              .option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", str(max_files_per_trigger)))
    files = reader.load(in_dir).select("_metadata.file_path")

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        # The new file paths of this trigger: metadata, bounded by max_files_per_trigger.
        rows = [(f, category_of(unquote(f)), batch_id_for(unquote(f))) for f in sorted(r.file_path for r in batch.collect())]
        if not rows:
            return
        paths = [unquote(f) for f, _, _ in rows]
        own = spark.createDataFrame(rows, "source_file string, category string, batch_id string")
        report = ingest_files(spark, paths, fmt, store_path, store_exists(spark, store_path), own)
        if reports is not None:
            reports.extend(r.asDict() for r in report.collect())

    writer = (files.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_to_completion(spark: SparkSession, in_dir: str, checkpoint: str, store_path: str,
                      **kw) -> DataFrame:
    """Process every file present now, then return the stored table."""
    q = incremental_ingest(spark, in_dir, checkpoint, store_path, available_now=True, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return read_exports(spark, store_path)
