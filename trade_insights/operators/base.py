"""Shared building blocks: grouped rollups, top-k, watchlist membership."""

from __future__ import annotations

from typing import Iterable, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.match import apply_filter, norm_name

# A watchlist is either a list of names, which becomes an IN filter that
# Parquet can use to skip row groups, or a DataFrame with a ``name`` column
# (and optionally ``active``), which is joined. The caller chooses; nothing
# switches with the size.
Watchlist = Union[Sequence[str], DataFrame]


def rollup(df: DataFrame, keys: Sequence[str | Column], aggs: Sequence[Column],
           order_by: Sequence[Column] | None = None, k: int | None = None,
           where: Column | None = None) -> DataFrame:
    """filter -> groupBy(keys).agg(aggs) -> orderBy -> limit(k).

    With ``k`` the sort+limit is planned as TakeOrderedAndProject: each task
    keeps its own top k, so only k rows per task reach the final merge.
    """
    out = apply_filter(df, where).groupBy(*keys).agg(*aggs)
    if order_by:
        out = out.orderBy(*order_by)
    if k is not None:
        out = out.limit(k)
    return out


def with_lists(top: DataFrame, rows: DataFrame, keys: dict[str, str], lists: dict[str, str],
               all_groups: bool) -> DataFrame:
    """Add the concatenated distinct values of ``rows`` (alias -> column) to
    the groups in ``top``, whose key columns ``keys`` maps to those of rows.

    The lists are built for the groups of ``top`` only, which a limit has made
    few. With ``all_groups`` there is no such limit; then each list is made
    from the distinct (group, value) pairs of its own, so no group ever holds
    its lines.
    """
    names = list(keys)
    same = lambda a, b: [a[k].eqNullSafe(b[f"__{k}"]) for k in names]
    keyed = [F.col(c).alias(f"__{k}") for k, c in keys.items()]
    if not all_groups:
        wanted = top.select(*names)
        rows = rows.join(wanted, [rows[c].eqNullSafe(wanted[k]) for k, c in keys.items()], "left_semi")
        parts = [rows.groupBy(*keyed).agg(*(M.concat_distinct(c, a) for a, c in lists.items()))]
    else:
        parts = [rows.select(*keyed, F.col(c).alias(a)).distinct().groupBy(*(f"__{k}" for k in names)).agg(M.concat_distinct(a, a))
                 for a, c in lists.items()]
    out = top
    for part in parts:
        out = out.join(part, same(out, part), "left").drop(*(f"__{k}" for k in names))
    return out


def desc(col: str) -> Column:
    return F.col(col).desc_nulls_last()


def asc(col: str) -> Column:
    return F.col(col).asc_nulls_last()


def by_then_keys(first: Iterable[Column], keys: Iterable[str]) -> list[Column]:
    """Order by ``first`` then the group keys ascending: a total order, so a
    LIMIT picks the same rows on every run and in every engine."""
    return list(first) + [asc(k) for k in keys]


def active_names(wl: Watchlist) -> list[str] | DataFrame:
    """Active, normalised watchlist names (list stays a list)."""
    if isinstance(wl, DataFrame):
        names = wl.filter(F.col("active")) if "active" in wl.columns else wl
        return names.select(F.upper(F.trim("name")).alias("name")).distinct()
    seen, out = set(), []
    for n in wl:
        if n and n.strip():
            u = norm_name(n)
            if u not in seen:
                seen.add(u)
                out.append(u)
    return out


def with_company(e: DataFrame, company: str, wl: Watchlist) -> Watchlist:
    """The watchlist with the company's own name, in the form it came in."""
    if not isinstance(wl, DataFrame):
        return [company, *wl]
    own = e.sparkSession.createDataFrame([(norm_name(company),)], "name string")
    return active_names(wl).unionByName(own).distinct()


def keep_members(df: DataFrame, col: str, wl: Watchlist) -> DataFrame:
    """Rows whose ``col`` is an active watchlist name (a semi join)."""
    names = active_names(wl)
    if isinstance(names, list):
        return df.filter(F.col(col).isin(names))
    return df.join(names, df[col] == names["name"], "left_semi")


def member_flag(df: DataFrame, col: str, wl: Watchlist, alias: str) -> DataFrame:
    """Adds boolean ``alias``: is ``col`` an active watchlist name."""
    names = active_names(wl)
    if isinstance(names, list):
        return df.withColumn(alias, F.col(col).isin(names) if names else F.lit(False))
    flagged = names.select(F.col("name").alias("__wl_name"), F.lit(True).alias("__wl_hit"))
    out = df.join(flagged, df[col] == flagged["__wl_name"], "left")
    return out.withColumn(alias, F.coalesce(F.col("__wl_hit"), F.lit(False))) \
              .drop("__wl_name", "__wl_hit")
