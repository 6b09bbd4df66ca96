"""Month-over-month comparison M1-M7.

Both months are read with one ``month_year IN (cur, prev)`` partition
filter. Per-entity metrics are aggregated per (entity, month) in one pass and
only then split and joined: the join sides hold one row per entity. New
relationships come from one aggregation per pair over both months, with a flag
for the month before; their product lists are built for the top k pairs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.match import entity_is, months_in, role_column
from .base import Watchlist, by_then_keys, desc, keep_members, rollup, with_lists

COMPETITOR_METRICS = ["shipments", "total_fob", "total_qty", "products", "countries", "clients"]
CLIENT_METRICS = ["shipments", "total_fob", "total_qty", "products", "suppliers"]


def _period_metrics(rows: DataFrame, key: str, extra: list[Column]) -> DataFrame:
    return rows.groupBy(key, "month_year").agg(
        M.shipments("shipments"), M.fob_total("total_fob"), M.qty_total("total_qty"),
        M.n_distinct("product_description", "products"), *extra)


def _side(per_month: DataFrame, key: str, month: str, prefix: str, names: list[str]) -> DataFrame:
    return per_month.filter(F.col("month_year") == F.lit(month)).select(
        F.col(key).alias("name"), *[F.col(n).alias(f"{prefix}_{n}") for n in names])


def competitor_month_comparison(e: DataFrame, wl: Watchlist, cur: str, prev: str) -> DataFrame:
    """M1: tracked exporters in two months, full outer join on name.

    Entities only in ``prev`` are dropped (change -100 / -100); entities only
    in ``cur`` are new (change NULL). A zero previous value gives NULL.
    """
    rows = keep_members(e, "exporter_name", wl).filter(months_in(cur, prev))
    per_month = _period_metrics(rows, "exporter_name", [
        M.n_distinct("country_of_destination", "countries"),
        M.n_distinct("consignee_name", "clients")])
    c = _side(per_month, "exporter_name", cur, "cur", COMPETITOR_METRICS)
    p = _side(per_month, "exporter_name", prev, "prev", COMPETITOR_METRICS)
    j = c.join(p, "name", "full")
    dropped = F.col("cur_shipments").isNull()
    return j.select(
        "name", *[f"cur_{n}" for n in COMPETITOR_METRICS], *[f"prev_{n}" for n in COMPETITOR_METRICS],
        F.when(dropped, F.lit(-100.0)).otherwise(M.pct_change(F.col("cur_shipments"), F.col("prev_shipments")))
         .alias("shipment_change_pct"),
        F.when(dropped, F.lit(-100.0)).otherwise(M.pct_change(F.col("cur_total_fob"), F.col("prev_total_fob")))
         .alias("fob_change_pct"),
        (~dropped & F.col("prev_shipments").isNull()).alias("is_new"),
        dropped.alias("is_dropped"),
    ).orderBy(by_then_keys([], ["name"]))


def client_month_comparison(e: DataFrame, wl: Watchlist, cur: str, prev: str) -> DataFrame:
    """M2: tracked consignees, current month rows only (left join)."""
    rows = keep_members(e, "consignee_name", wl).filter(months_in(cur, prev))
    per_month = _period_metrics(rows, "consignee_name", [M.n_distinct("exporter_name", "suppliers")])
    c = _side(per_month, "consignee_name", cur, "cur", CLIENT_METRICS)
    p = _side(per_month, "consignee_name", prev, "prev", CLIENT_METRICS)
    j = c.join(p, "name", "left")
    return j.select(
        "name", *[f"cur_{n}" for n in CLIENT_METRICS], *[f"prev_{n}" for n in CLIENT_METRICS],
        M.pct_change(F.col("cur_shipments"), F.col("prev_shipments")).alias("shipment_change_pct"),
        M.pct_change(F.col("cur_total_fob"), F.col("prev_total_fob")).alias("fob_change_pct"),
        F.col("prev_shipments").isNull().alias("is_new"),
    ).orderBy(by_then_keys([], ["name"]))


PAIR = ["consignee_name", "exporter_name"]


def new_pairs(rows: DataFrame, cur: str, prev: str, aggs: list[Column], null_is_a_name: bool) -> DataFrame:
    """Pairs with lines in ``cur`` but none in ``prev``, with ``aggs`` over
    their lines of ``cur``; rows may hold both months. Where null is no name, a pair
    with a null never counts as seen before."""
    before = F.max(F.col("month_year") == F.lit(prev))
    out = rows.filter(months_in(cur, prev)).groupBy(*PAIR).agg(
        F.max(F.col("month_year") == F.lit(cur)).alias("__now"), before.alias("__before"), *aggs)
    seen = F.col("__before")
    if not null_is_a_name:
        seen = seen & F.col(PAIR[0]).isNotNull() & F.col(PAIR[1]).isNotNull()
    return out.filter(F.col("__now") & ~seen).drop("__now", "__before")


def in_month(column: str, month: str) -> Column:
    """The column for lines of the month, NULL for others."""
    return F.when(F.col("month_year") == F.lit(month), F.col(column))


def _new_pairs(rows: DataFrame, cur: str, prev: str, k: int | None, null_is_a_name: bool) -> DataFrame:
    found = new_pairs(rows, cur, prev, [F.count_distinct(in_month("declaration_id", cur)).alias("shipments"),
                                        M.money(F.sum(in_month("fob_value", cur))).alias("total_fob")], null_is_a_name)
    found = found.withColumnsRenamed({"consignee_name": "client", "exporter_name": "new_supplier"})
    order = by_then_keys([desc("total_fob")], ["client", "new_supplier"])
    top = found.orderBy(*order) if k is None else found.orderBy(*order).limit(k)
    keys = {"client": "consignee_name", "new_supplier": "exporter_name"}
    return with_lists(top, rows.filter(F.col("month_year") == F.lit(cur)), keys,
                      {"products": "product_description"}, k is None).orderBy(*order)


def new_suppliers_to_tracked_clients(e: DataFrame, wl: Watchlist, cur: str, prev: str,
                                     k: int | None = 50) -> DataFrame:
    """M3: (tracked client, exporter) pairs present in ``cur`` but not ``prev``."""
    return _new_pairs(keep_members(e, "consignee_name", wl), cur, prev, k, True)


def new_relationships(e: DataFrame, cur: str, prev: str, k: int | None = 100,
                      require_names: bool = True) -> DataFrame:
    """M4: all (consignee, exporter) pairs new in ``cur``; top k by fob."""
    if require_names:
        e = e.filter(F.col("consignee_name").isNotNull() & F.col("exporter_name").isNotNull())
    return _new_pairs(e, cur, prev, k, False)


MONTH_ROW_COLUMNS = ["declaration_id", "shipment_date", "exporter_name", "consignee_name",
                     "product_description", "hs_code", "quantity", "unit", "fob_value",
                     "country_of_destination", "port_of_loading", "port_of_discharge"]


def _period(cur: str, prev: str) -> Column:
    return F.when(F.col("month_year") == F.lit(cur), F.lit("current")).otherwise(F.lit("previous"))


def _entity_two_months(e: DataFrame, entity: str, role: str, cur: str, prev: str) -> DataFrame:
    role_column(role)
    return e.filter(entity_is(entity, role) & months_in(cur, prev))


def entity_month_rows(e: DataFrame, entity: str, role: str, cur: str, prev: str) -> DataFrame:
    """M5: the entity's lines in both months (``period`` = current/previous)."""
    rows = _entity_two_months(e, entity, role, cur, prev).select(
        _period(cur, prev).alias("period"),
        *[M.money(F.col(c)).alias(c) if c == "fob_value" else F.col(c) for c in MONTH_ROW_COLUMNS])
    rest = [c for c in MONTH_ROW_COLUMNS if c != "shipment_date"]
    return rows.orderBy(F.col("period"), *by_then_keys([desc("shipment_date")], rest))


def entity_month_products(e: DataFrame, entity: str, role: str, cur: str, prev: str) -> DataFrame:
    """M6: per (product, hs) quantity and fob, for each of the two months."""
    rows = _entity_two_months(e, entity, role, cur, prev)
    keys = ["product_description", "hs_code"]
    return rollup(rows, [_period(cur, prev).alias("period"), *keys],
                  [M.qty_total("qty"), M.fob_total("fob")],
                  order_by=by_then_keys([F.col("period"), desc("fob")], keys))


def entity_month_countries(e: DataFrame, entity: str, role: str, cur: str, prev: str) -> DataFrame:
    """M7: per country shipments and fob, for each of the two months."""
    rows = _entity_two_months(e, entity, role, cur, prev)
    return rollup(rows, [_period(cur, prev).alias("period"), "country_of_destination"],
                  [M.shipments("shipments"), M.fob_total("fob")],
                  order_by=by_then_keys([F.col("period"), desc("fob")], ["country_of_destination"]))
