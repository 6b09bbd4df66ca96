"""Company benchmarking B1-B7: own totals, competitors, market, share, rank.

Scalars (market totals, the company's total) are one-row aggregates used
through uncorrelated scalar subqueries, which Spark evaluates once and
broadcasts as a literal; no cross join is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.match import apply_filter, company_like, month_is
from ..schema import MONEY
from .base import Watchlist, by_then_keys, desc, keep_members, rollup


def _bench_metrics() -> list:
    return [M.shipments("shipments"), M.fob_total("total_fob"), M.qty_total("total_qty"),
            M.n_distinct("product_description", "products"),
            M.n_distinct("country_of_destination", "countries"),
            M.n_distinct("consignee_name", "clients"),
            M.avg_fob("avg_fob_per_shipment")]


def company_benchmark(e: DataFrame, company: str, month: str | None = None) -> DataFrame:
    """B1: one row for the own company (LIKE match); the average is per line."""
    return apply_filter(e.filter(company_like(company)), month_is(month)).agg(*_bench_metrics())


def competitor_benchmark(e: DataFrame, wl: Watchlist, month: str | None = None) -> DataFrame:
    """B2: the same metrics per tracked exporter (exact match), by fob desc."""
    return rollup(keep_members(e, "exporter_name", wl), [F.col("exporter_name").alias("name")],
                  _bench_metrics(), order_by=by_then_keys([desc("total_fob")], ["name"]),
                  where=month_is(month))


def market_totals(e: DataFrame, month: str | None = None) -> DataFrame:
    """Shipments, fob and number of exporters of the whole market."""
    return apply_filter(e, month_is(month)).agg(
        M.shipments("shipments"), M.fob_total("total_fob"),
        M.n_distinct("exporter_name", "exporters"))


def client_vendor_analysis(e: DataFrame, company: str, month: str | None = None,
                           with_products: bool = True, own: DataFrame | None = None) -> DataFrame:
    """For every client of the company, all its vendors with an
    own-company flag; by client, then fob desc. ``own`` may give lines that
    hold all of the company's."""
    rows = apply_filter(e, month_is(month))
    clients = (apply_filter(e if own is None else own, month_is(month)).filter(company_like(company) & F.col("consignee_name").isNotNull()
                           & (F.col("consignee_name") != F.lit("")))
               .select("consignee_name").distinct())
    sub = rows.join(clients, "consignee_name", "left_semi")
    aggs = [M.shipments("shipments"), M.fob_total("total_fob"), M.qty_total("total_qty")]
    if with_products:
        aggs.append(M.n_distinct("product_description", "products"))
    out = sub.groupBy(F.col("consignee_name").alias("client"), F.col("exporter_name").alias("vendor")) \
        .agg(*aggs)
    out = out.select("client", "vendor",
                     F.when(company_like(company, "vendor"), F.lit(1)).otherwise(F.lit(0))
                      .alias("is_your_company"), *[c for c in out.columns if c not in ("client", "vendor")])
    return out.orderBy(F.col("client").asc_nulls_last(), desc("total_fob"), F.col("vendor").asc_nulls_last())


def market_share(e: DataFrame, company: str, month: str | None = None) -> DataFrame:
    """Company fob / market fob * 100 rounded to 2 decimals; 0 when the
    market is empty. Both sums come from one scan."""
    rows = apply_filter(e, month_is(month))
    sums = rows.agg(
        F.sum(F.when(company_like(company), F.col("fob_value"))).alias("c"),
        F.sum("fob_value").alias("m"))
    c = M.money(F.coalesce(F.col("c"), F.lit(0).cast(MONEY)))
    m = M.money(F.col("m"))
    share = F.round((c / m * F.lit(100.0)).cast("decimal(20,8)"), 2).cast("double")
    return sums.select(
        c.alias("company_fob"), m.alias("market_fob"),
        F.when(m > 0, share).otherwise(F.lit(0.0)).alias("market_share_pct"))


def company_rank(e: DataFrame, company: str, month: str | None = None) -> DataFrame:
    """1 + number of exporters whose total fob is strictly above the
    company's combined total (all matching names together)."""
    per_exporter = apply_filter(e, month_is(month)).groupBy("exporter_name").agg(F.sum("fob_value").alias("t"))
    company_total = per_exporter.filter(company_like(company)).agg(
        F.coalesce(F.sum("t"), F.lit(0).cast(MONEY)).alias("t"))
    above = per_exporter.filter(F.col("t") > company_total.scalar())
    return above.agg((F.count(F.lit(1)) + F.lit(1)).alias("company_rank"))


def market_position(e: DataFrame, company: str, wl: Watchlist, month: str | None = None) -> DataFrame:
    """The company and the tracked exporters as one series by fob."""
    own = company_benchmark(e, company, month).select(
        F.lit(company.strip().upper()).alias("name"),
        F.coalesce(F.col("total_fob"), F.lit(0.0)).alias("fob"), F.lit(True).alias("is_you"))
    others = competitor_benchmark(e, wl, month).select(
        "name", F.col("total_fob").alias("fob"), F.lit(False).alias("is_you"))
    return own.unionByName(others).orderBy(desc("fob"), F.col("is_you").desc(), F.col("name").asc_nulls_last())
