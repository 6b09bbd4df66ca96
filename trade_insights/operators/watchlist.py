"""Watchlists (tracked competitors / clients) and name search W1-W4.

A watchlist is a small dimension DataFrame ``(name, created_at, active)``;
names are unique, trimmed and upper-case; removal is a soft delete.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import metrics as M
from ..functions.match import like_any
from ..functions.parse import trimmed
from ..schema import WATCHLIST_SCHEMA
from ..sources.store import Store
from .base import Watchlist, by_then_keys, desc, member_flag

ALREADY_EXISTS = "Already exists"


def empty_watchlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], WATCHLIST_SCHEMA)


def active(wl: DataFrame) -> DataFrame:
    """Active names, ordered by name."""
    return wl.filter(F.col("active")).orderBy("name")


def _requests(spark: SparkSession, names: "Sequence[str] | DataFrame") -> DataFrame:
    """seq, given of the names as requested, in order."""
    if isinstance(names, DataFrame):
        return names.select("seq", "given")
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "seq long, given string")


def apply_changes(wl: DataFrame, adds: "Sequence[str] | DataFrame" = (), removes: "Sequence[str] | DataFrame" = ()
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add names (trim + upper, blanks skipped) and soft-delete names.

    Names come as lists, or as DataFrames (seq, given) and (name). Returns
    ``(new_watchlist, added, errors)``. A name already present — even
    inactive — or repeated within ``adds`` is an error row
    ``(name, error='Already exists')`` carrying the name as given.
    """
    req = _requests(wl.sparkSession, adds)
    req = req.withColumn("name", F.upper(trimmed(F.col("given")))).filter(F.col("name") != F.lit(""))
    first = F.row_number().over(Window.partitionBy("name").orderBy("seq"))
    req = req.withColumn("__first", first == 1)
    existing = wl.select("name")
    fresh = req.filter("__first").join(existing, "name", "left_anti")
    added = fresh.select("name").orderBy("name")
    errors = (req.join(fresh.select("seq"), "seq", "left_anti")
                 .select(F.col("given").alias("name"), F.lit(ALREADY_EXISTS).alias("error"), "seq")
                 .orderBy("seq").drop("seq"))
    if isinstance(removes, DataFrame):
        gone = removes.select(F.upper(trimmed(F.col("name"))).alias("__gone")).distinct()
        kept = (wl.join(gone, F.col("name") == F.col("__gone"), "left")
                  .withColumn("active", F.col("active") & F.col("__gone").isNull()).drop("__gone"))
    else:
        remove_names = [r.strip().upper() for r in removes if r and r.strip()]
        kept = wl.withColumn("active", F.col("active") & ~F.col("name").isin(remove_names))
    new_rows = fresh.select("name", F.current_timestamp().alias("created_at"),
                            F.lit(True).alias("active"))
    return kept.unionByName(new_rows), added, errors


def search_words(q: str | None) -> list[str] | None:
    """Upper-cased whitespace-separated words longer than one character.

    None means "no search" (query shorter than 2 characters); an empty list
    means "no usable word", which searches without a word filter.
    """
    if not q or len(q) < 2:
        return None
    return [w for w in q.strip().upper().split() if len(w) > 1]


def _search(e: DataFrame, col: str, q: str | None, wl: Watchlist, k: int, extra: list) -> DataFrame:
    words = search_words(q)
    rows = e.filter(F.col(col).isNotNull() & (F.col(col) != F.lit("")))
    if words is None:
        rows = rows.filter(F.lit(False))
    elif words:
        rows = rows.filter(like_any(F.upper(F.col(col)), words))
    order = by_then_keys([desc("shipment_count")], ["name"])
    top = (rows.groupBy(F.col(col).alias("name"))
               .agg(M.lines("shipment_count"), M.fob_total(), *extra).orderBy(*order).limit(k))
    return member_flag(top, "name", wl, "already_tracked").orderBy(*order)


def _search_stored(store: Store, role: str, q: str | None, wl: Watchlist, k: int) -> DataFrame:
    words = search_words(q)
    rows = store.names.filter((F.col("role") == role) & (F.col("name") != F.lit("")))
    if words is None:
        rows = rows.filter(F.lit(False))
    elif words:
        rows = rows.join(store.names_like(role, words), "name", "left_semi")
    order = by_then_keys([desc("shipment_count")], ["name"])
    extra = [M.concat_distinct("country", "countries")] if role == "consignee" else []
    top = rows.groupBy("name").agg(F.sum("lines").alias("shipment_count"), M.money(F.sum("fob")).alias("total_fob"), *extra).orderBy(*order).limit(k)
    return member_flag(top, "name", wl, "already_tracked").orderBy(*order)


def search_exporters_stored(store: Store, q: str | None, wl: Watchlist, k: int = 20) -> DataFrame:
    """W3 from the store's name index, equal to ``search_exporters`` of its
    lines: words are looked up by their grams, and no line is read."""
    return _search_stored(store, "exporter", q, wl, k)


def search_consignees_stored(store: Store, q: str | None, wl: Watchlist, k: int = 20) -> DataFrame:
    """W4 from the store's name index."""
    return _search_stored(store, "consignee", q, wl, k)


def search_exporters(e: DataFrame, q: str | None, wl: Watchlist, k: int = 20) -> DataFrame:
    """Exporters whose name contains any search word; top k by lines;
    flagged when already tracked."""
    return _search(e, "exporter_name", q, wl, k, [])


def search_consignees(e: DataFrame, q: str | None, wl: Watchlist, k: int = 20) -> DataFrame:
    """As W3 for consignees, with their distinct destination countries."""
    return _search(e, "consignee_name", q, wl, k,
                   [M.concat_distinct("country_of_destination", "countries")])
