"""Aggregate expressions shared by every report (the "metric pack").

All of them are built-in Spark aggregates, so partial aggregation happens
map-side before any shuffle. Money is stored as DECIMAL(18,2); sums are exact
decimals and are turned into DOUBLE only for output, so the value does not
depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES, USD_TO_INR


# Relative standard deviation of the opt-in approximate distinct counts.
APPROX_RSD = 0.01


def shipments(alias: str = "shipment_count", exact: bool = True) -> Column:
    """Number of shipments = distinct declarations."""
    return n_distinct("declaration_id", alias, exact)


def lines(alias: str = "line_count") -> Column:
    """Number of shipment lines."""
    return F.count(F.lit(1)).alias(alias)


def fob_sum_exact() -> Column:
    """SUM(fob_value) kept as an exact decimal (for INR and ratios)."""
    return F.sum("fob_value")


def fob_total(alias: str = "total_fob") -> Column:
    return money(fob_sum_exact()).alias(alias)


def qty_total(alias: str = "total_quantity") -> Column:
    return F.sum("quantity").alias(alias)


def n_distinct(col: str, alias: str, exact: bool = True) -> Column:
    """COUNT(DISTINCT col). ``exact=False`` uses a HyperLogLog++ sketch
    (``approx_count_distinct``): fixed-size partial states merged map-side,
    no per-value shuffle — the option for very large scans."""
    if exact:
        return F.count_distinct(col).alias(alias)
    return F.approx_count_distinct(col, rsd=APPROX_RSD).alias(alias)


def avg_fob(alias: str) -> Column:
    """AVG(fob_value) per line, as DOUBLE (exact sum / count)."""
    return (money(fob_sum_exact()) / F.count("fob_value")).alias(alias)


def concat_distinct(col: str, alias: str) -> Column:
    """Distinct non-NULL values joined by ',' in sorted order (NULL if none).

    Written as a DISTINCT aggregate so Catalyst plans it with the distinct
    counts: values are de-duplicated per (group, value) through the shuffle
    first, and the final per-group list only ever holds the distinct values
    the report returns — a hot group never builds a list of its raw rows.
    """
    values = F.array_sort(F.expr("collect_list(DISTINCT `" + col.replace("`", "``") + "`)"))
    return F.when(F.size(values) > 0, F.array_join(values, ",")).alias(alias)


def categories(alias: str) -> Column:
    """The categories present, joined by ',' in sorted order (NULL if none).
    An import is tagged with one of the known ones, so a flag for each does,
    and no distinct aggregate is needed."""
    found = F.concat_ws(",", *(F.max(F.when(F.col("data_type") == F.lit(c), F.lit(c))) for c in sorted(CATEGORIES)))
    return F.when(found != F.lit(""), found).alias(alias)


def money(c: Column) -> Column:
    """Exact decimal money amount -> DOUBLE for output."""
    return c.cast("double")


def inr_exact(usd: Column) -> Column:
    """USD decimal amount -> INR rounded to 2 decimals, still decimal."""
    return F.round(usd.cast("decimal(32,2)") * F.lit(USD_TO_INR).cast("decimal(3,1)"), 2)


def to_inr(usd: Column, alias: str) -> Column:
    """ROUND(usd * 83.5, 2) computed in decimal, returned as DOUBLE."""
    return money(inr_exact(usd)).alias(alias)


def fob_total_inr(alias: str) -> Column:
    return to_inr(fob_sum_exact(), alias)


def pct_change(cur: Column, prev: Column) -> Column:
    """(cur - prev) / prev * 100 as DOUBLE; NULL for no or zero previous."""
    c = cur.cast("double")
    p = prev.cast("double")
    return F.when(p.isNotNull() & (p != 0), (c - p) / p * F.lit(100.0))
