"""Write a multi-block report, one dataset per block ("sheet").

The set is complete when its marker is there: it is removed before the first
block is written and made anew after the last. ``read_report`` takes only
complete sets.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from .store import delete_folder, read_text, store_exists, write_text

SINK_FORMATS = ("parquet", "csv", "json")
MARKER = "_COMPLETE.json"


class IncompleteReportError(RuntimeError):
    """The report's write is not over, or ended early."""


def safe_name(name: str) -> str:
    """Path-safe form of an entity or block name: non-alphanumerics -> '_'."""
    return re.sub(r"[^a-zA-Z0-9]", "_", name)


def _plain_columns(df: DataFrame) -> DataFrame:
    # Parquet rejects some characters in column names (" ,;{}()\n\t=");
    # the display headers are kept for CSV/JSON and made safe for Parquet.
    return df.toDF(*[re.sub(r"[ ,;{}()\n\t=]+", "_", c).strip("_") for c in df.columns])


def write_report(blocks: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> dict[str, str]:
    """Write each block to ``path/<safe block name>``; returns block -> path.

    Each block is written by its own distributed job; nothing is collected. A
    set that ends early has no marker.
    """
    if fmt not in SINK_FORMATS:
        raise ValueError(f"unsupported report format {fmt!r}; expected one of {SINK_FORMATS}")
    out, spark = {}, None
    for name, df in blocks.items():
        if spark is None:
            spark = df.sparkSession
            delete_folder(spark, f"{path.rstrip('/')}/{MARKER}")
        target = f"{path.rstrip('/')}/{safe_name(name)}"
        frame = _plain_columns(df) if fmt == "parquet" else df
        writer = frame.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(target)
        out[name] = target
    if spark is not None:
        told = json.dumps({"format": fmt, "blocks": {name: safe_name(name) for name in blocks}})
        write_text(spark, f"{path.rstrip('/')}/{MARKER}", told)
    return out


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The blocks of a complete set, by name; an error if it is not complete."""
    path = path.rstrip("/")
    if not store_exists(spark, f"{path}/{MARKER}"):
        raise IncompleteReportError(f"{path} holds no complete report")
    told = json.loads(read_text(spark, f"{path}/{MARKER}"))
    reader = spark.read.option("header", True) if told["format"] == "csv" else spark.read
    return {name: reader.format(told["format"]).load(f"{path}/{folder}") for name, folder in told["blocks"].items()}
