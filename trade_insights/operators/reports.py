"""Analytical reports A1-A22: dashboards, watchlist summaries, entity detail.

Each report is one filter (month partition filter, pushed entity/watchlist
filter) followed by one grouped aggregate. Aggregates run partially map-side;
distinct counts are planned by Catalyst (one Expand for several distinct
columns), which spreads a hot group over the shuffle on (group, value) before
the final per-group merge. A LIMIT is a TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.keys import DIGEST
from ..functions.match import all_of, apply_filter, entity_is, month_is, months_in
from ..sources.indexes import distinct_counts
from ..sources.store import Store
from .base import Watchlist, asc, by_then_keys, desc, keep_members, rollup, with_company, with_lists

# ---------------------------------------------------------------- A1


def months(e: DataFrame) -> DataFrame:
    """A1: distinct non-NULL months, newest first."""
    return (e.select("month_year").filter(F.col("month_year").isNotNull())
             .distinct().orderBy(desc("month_year")))


# ---------------------------------------------------------------- A2-A5b


def competitor_summary(e: DataFrame, wl: Watchlist, month: str | None = None) -> DataFrame:
    """A2: per tracked exporter: shipments, fob, products, countries,
    categories, first/last shipment date; by fob desc."""
    return rollup(
        keep_members(e, "exporter_name", wl), ["exporter_name"],
        [M.shipments(), M.fob_total(), M.n_distinct("product_description", "product_count"),
         M.n_distinct("country_of_destination", "country_count"),
         M.categories("categories"),
         F.min("shipment_date").alias("first_shipment"),
         F.max("shipment_date").alias("last_shipment")],
        order_by=by_then_keys([desc("total_fob")], ["exporter_name"]),
        where=month_is(month))


def competitor_baseline(e: DataFrame, wl: Watchlist, compare_month: str) -> DataFrame:
    """A3: shipments and fob of the tracked exporters in the compare month."""
    return rollup(keep_members(e, "exporter_name", wl), ["exporter_name"],
                  [M.shipments(), M.fob_total()], where=month_is(compare_month))


def client_summary(e: DataFrame, wl: Watchlist, month: str | None = None) -> DataFrame:
    """A4: per tracked consignee: shipments, fob, products, suppliers,
    categories, first/last shipment date; by fob desc."""
    return rollup(
        keep_members(e, "consignee_name", wl), ["consignee_name"],
        [M.shipments(), M.fob_total(), M.n_distinct("product_description", "product_count"),
         M.n_distinct("exporter_name", "supplier_count"),
         M.categories("categories"),
         F.min("shipment_date").alias("first_shipment"),
         F.max("shipment_date").alias("last_shipment")],
        order_by=by_then_keys([desc("total_fob")], ["consignee_name"]),
        where=month_is(month))


def client_baseline(e: DataFrame, wl: Watchlist, compare_month: str) -> DataFrame:
    """A5: shipments and fob of the tracked consignees in the compare month."""
    return rollup(keep_members(e, "consignee_name", wl), ["consignee_name"],
                  [M.shipments(), M.fob_total()], where=month_is(compare_month))


def _trend(e: DataFrame, wl: Watchlist, key: str, extra: list, month: str, compare_month: str) -> DataFrame:
    """The current month's rows with the compare month's shipments and
    fob and the fob % change, by fob. One scan of both months, aggregated per
    name and month; the months then meet in a second, small aggregation."""
    rows = keep_members(e, key, wl).filter(months_in(month, compare_month))
    own = [M.shipments(), M.fob_total(), *extra, M.categories("categories"),
           F.min("shipment_date").alias("first_shipment"), F.max("shipment_date").alias("last_shipment")]
    per_month = rows.groupBy(key, "month_year").agg(*own)
    of = lambda m, c: F.max(F.when(F.col("month_year") == F.lit(m), F.col(c)))
    names = [c for c in per_month.columns if c not in (key, "month_year")]
    out = per_month.groupBy(key).agg(
        *[of(month, c).alias(c) for c in names],
        of(compare_month, "shipment_count").alias("prev_shipment_count"),
        of(compare_month, "total_fob").alias("prev_total_fob"))
    return (out.filter(F.col("shipment_count").isNotNull())
               .withColumn("fob_change_pct", M.pct_change(F.col("total_fob"), F.col("prev_total_fob")))
               .orderBy(*by_then_keys([desc("total_fob")], [key])))


def competitor_trend(e: DataFrame, wl: Watchlist, month: str, compare_month: str) -> DataFrame:
    return _trend(e, wl, "exporter_name",
                  [M.n_distinct("product_description", "product_count"),
                   M.n_distinct("country_of_destination", "country_count")], month, compare_month)


def client_trend(e: DataFrame, wl: Watchlist, month: str, compare_month: str) -> DataFrame:
    return _trend(e, wl, "consignee_name",
                  [M.n_distinct("product_description", "product_count"),
                   M.n_distinct("exporter_name", "supplier_count")], month, compare_month)


# ---------------------------------------------------------------- A6


def company_comparison(e: DataFrame, company: str, wl: Watchlist,
                       month: str | None = None, exact: bool = False) -> DataFrame:
    """Own company + tracked exporters (exact name match).

    Two levels, as the application computes it: aggregate per (exporter,
    category), then add the per-category counts up per exporter — a
    declaration present in both categories counts twice. ``exact=True`` gives
    true distinct counts per exporter instead. ``categories`` lists the
    exporter's categories by category fob, largest first.
    """
    company_u = company.strip().upper()
    sub = apply_filter(keep_members(e, "exporter_name", with_company(e, company, wl)), month_is(month))
    if exact:
        out = sub.groupBy("exporter_name").agg(
            M.shipments(), M.fob_total(), M.n_distinct("product_description", "product_count"),
            M.n_distinct("country_of_destination", "country_count"),
            M.n_distinct("consignee_name", "client_count"),
            M.categories("categories"))
    else:
        per_cat = sub.groupBy("exporter_name", "data_type").agg(
            M.shipments(), M.fob_sum_exact().alias("cat_fob"),
            M.n_distinct("product_description", "product_count"),
            M.n_distinct("country_of_destination", "country_count"),
            M.n_distinct("consignee_name", "client_count"))
        ranked = F.array_sort(F.collect_list(
            F.when(F.col("data_type").isNotNull(),
                   F.struct((-F.col("cat_fob")).alias("neg_fob"), F.col("data_type").alias("c")))))
        out = per_cat.groupBy("exporter_name").agg(
            F.sum("shipment_count").alias("shipment_count"),
            M.money(F.sum("cat_fob")).alias("total_fob"),
            F.sum("product_count").alias("product_count"),
            F.sum("country_count").alias("country_count"),
            F.sum("client_count").alias("client_count"),
            F.array_join(F.transform(ranked, lambda s: s["c"]), ",").alias("categories"))
    return (out.withColumn("is_company", F.col("exporter_name") == F.lit(company_u))
               .orderBy(*by_then_keys([desc("total_fob")], ["exporter_name"])))


# ---------------------------------------------------------------- A7-A15 entity block


def _entity_rows(e: DataFrame, entity: str, role: str, month: str | None) -> DataFrame:
    return e.filter(all_of([entity_is(entity, role), month_is(month)]))


def entity_summary(e: DataFrame, entity: str, role: str, month: str | None = None) -> DataFrame:
    """One row for one exporter or consignee."""
    return _entity_rows(e, entity, role, month).agg(
        M.shipments("total_shipments"), M.fob_total(), M.qty_total(),
        M.n_distinct("product_description", "unique_products"),
        M.n_distinct("country_of_destination", "unique_countries"),
        M.n_distinct("hs_code", "unique_hs_codes"),
        F.min("shipment_date").alias("first_shipment"),
        F.max("shipment_date").alias("last_shipment"))


PRODUCT_KEYS = ["product_description", "hs_code", "data_type", "unit"]


def entity_products(e: DataFrame, entity: str, role: str, month: str | None = None,
                    k: int | None = 50) -> DataFrame:
    """Per (product, hs, category, unit) of the entity; top k by fob."""
    return rollup(_entity_rows(e, entity, role, month), PRODUCT_KEYS,
                  [M.shipments(), M.qty_total(), M.fob_total(), M.avg_fob("avg_fob_per_shipment")],
                  order_by=by_then_keys([desc("total_fob")], PRODUCT_KEYS), k=k)


def entity_countries(e: DataFrame, entity: str, role: str, month: str | None = None) -> DataFrame:
    """Per destination country of the entity, by fob desc."""
    return rollup(_entity_rows(e, entity, role, month), ["country_of_destination"],
                  [M.shipments(), M.qty_total(), M.fob_total()],
                  order_by=by_then_keys([desc("total_fob")], ["country_of_destination"]))


def entity_ports(e: DataFrame, entity: str, role: str, month: str | None = None,
                 k: int | None = 20) -> DataFrame:
    """A10: per (loading, discharge) route; top k by shipments."""
    keys = [F.col("port_of_loading").alias("indian_port"),
            F.col("port_of_discharge").alias("foreign_port")]
    return rollup(_entity_rows(e, entity, role, month), keys,
                  [M.shipments(), M.fob_total()],
                  order_by=by_then_keys([desc("shipment_count")], ["indian_port", "foreign_port"]),
                  k=k)


def entity_monthly_trend(e: DataFrame, entity: str, role: str) -> DataFrame:
    """Per month of the entity (all months; no month filter)."""
    rows = e.filter(all_of([entity_is(entity, role), F.col("month_year").isNotNull()]))
    return rollup(rows, ["month_year"], [M.shipments(), M.qty_total(), M.fob_total()],
                  order_by=[asc("month_year")])


def entity_suppliers(e: DataFrame, consignee: str, month: str | None = None,
                     k: int | None = 20) -> DataFrame:
    """A consignee's exporters with their distinct products; top k by fob."""
    rows = _entity_rows(e, consignee, "consignee", month)
    order = by_then_keys([desc("total_fob")], ["exporter_name"])
    top = rollup(rows, ["exporter_name"], [M.shipments(), M.fob_total()], order_by=order, k=k)
    return with_lists(top, rows, {"exporter_name": "exporter_name"}, {"products": "product_description"}, k is None).orderBy(*order)


def entity_clients(e: DataFrame, exporter: str, month: str | None = None,
                   k: int | None = 20) -> DataFrame:
    """An exporter's (consignee, country) pairs; top k by fob."""
    keys = ["consignee_name", "country_of_destination"]
    return rollup(_entity_rows(e, exporter, "exporter", month), keys,
                  [M.shipments(), M.fob_total()],
                  order_by=by_then_keys([desc("total_fob")], keys), k=k)


RECENT_COLUMNS = ["declaration_id", "shipment_date", "product_description", "quantity", "unit",
                  "fob_value", "country_of_destination", "consignee_name", "exporter_name",
                  "port_of_loading", "port_of_discharge"]


def entity_recent_shipments(e: DataFrame, entity: str, role: str, month: str | None = None,
                            k: int | None = 50) -> DataFrame:
    """Newest k lines of the entity (11 columns)."""
    rows = _entity_rows(e, entity, role, month).select(
        *RECENT_COLUMNS[:5], M.money(F.col("fob_value")).alias("fob_value"), *RECENT_COLUMNS[6:])
    rest = [c for c in RECENT_COLUMNS if c != "shipment_date"]
    out = rows.orderBy(*by_then_keys([desc("shipment_date")], rest))
    return out.limit(k) if k is not None else out


PAGE_COLUMNS = ["declaration_id", "exporter_name", "consignee_name", "product_description",
                "product_category", "data_type", "hs_code", "quantity", "unit", "fob_value",
                "fob_currency", "port_of_loading", "port_of_discharge", "country_of_destination",
                "shipment_date", "month_year", "upload_batch", "created_at"]


def _page_rows(e: DataFrame, entity: str, role: str, month: str | None) -> DataFrame:
    return _entity_rows(e, entity, role, month).select(
        *[M.money(F.col(c)).alias(c) if c == "fob_value" else F.col(c) for c in PAGE_COLUMNS])


PAGE_ORDER = ["shipment_date", *[c for c in PAGE_COLUMNS if c != "shipment_date"]]


def shipments_page(e: DataFrame, entity: str, role: str, month: str | None = None,
                   page: int = 1, limit: int = 50) -> DataFrame:
    """One page of the entity's lines, newest first (LIMIT/OFFSET). A
    task keeps all rows up to the page's end; for deep pages use
    ``shipments_after``."""
    rows = _page_rows(e, entity, role, month)
    ordered = rows.orderBy(*by_then_keys([desc("shipment_date")], PAGE_ORDER[1:]))
    offset = max(page - 1, 0) * limit
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def shipments_after(e: DataFrame, entity: str, role: str, last: dict | None, month: str | None = None,
                    limit: int = 50) -> DataFrame:
    """A15 by key: the page after the row ``last`` (a row of the page before,
    as a dict; None for the first page). Any page costs the same: each task
    keeps ``limit`` rows. Rows equal to ``last`` in all columns belong to its
    page."""
    rows = _page_rows(e, entity, role, month)
    if last is not None:
        later, equal = F.lit(False), F.lit(True)
        for c in PAGE_ORDER:
            value, kind = last[c], rows.schema[c].dataType
            here = F.lit(value).cast(kind)
            if value is None:
                beyond, same = F.lit(False), F.col(c).isNull()
            elif c == "shipment_date":
                beyond, same = (F.col(c) < here) | F.col(c).isNull(), F.col(c) == here
            else:
                beyond, same = (F.col(c) > here) | F.col(c).isNull(), F.col(c) == here
            later = later | (equal & beyond)
            equal = equal & same
        rows = rows.filter(F.coalesce(later, F.lit(False)))
    return rows.orderBy(*by_then_keys([desc("shipment_date")], PAGE_ORDER[1:])).limit(limit)


def shipments_total(e: DataFrame, entity: str, role: str, month: str | None = None) -> DataFrame:
    """A15 total: number of lines of the entity (one row)."""
    return _entity_rows(e, entity, role, month).agg(F.count(F.lit(1)).alias("total"))


# ---------------------------------------------------------------- A16-A18


def _optional_entity(entity: str | None, role: str | None):
    if not entity:
        return None
    return entity_is(entity, role or "consignee")


def product_breakdown(e: DataFrame, entity: str | None = None, role: str | None = None,
                      month: str | None = None, k: int | None = 50) -> DataFrame:
    """Per (product, category): shipments, qty, fob; top k by fob."""
    keys = ["product_description", "data_type"]
    return rollup(e, keys, [M.shipments(), M.qty_total(), M.fob_total()],
                  order_by=by_then_keys([desc("total_fob")], keys), k=k,
                  where=all_of([_optional_entity(entity, role), month_is(month)]))


def country_breakdown(e: DataFrame, entity: str | None = None, role: str | None = None,
                      month: str | None = None) -> DataFrame:
    """Per country: shipments, fob; by fob desc."""
    return rollup(e, ["country_of_destination"], [M.shipments(), M.fob_total()],
                  order_by=by_then_keys([desc("total_fob")], ["country_of_destination"]),
                  where=all_of([_optional_entity(entity, role), month_is(month)]))


def monthly_trends(e: DataFrame, entity: str | None = None, role: str | None = None,
                   exact: bool = True) -> DataFrame:
    """Per month: shipments, fob, products (entity filter needs a role)."""
    ent = entity_is(entity, role) if entity and role else None
    return rollup(e, ["month_year"],
                  [M.shipments(exact=exact), M.fob_total(),
                   M.n_distinct("product_description", "product_count", exact)],
                  order_by=[asc("month_year")],
                  where=all_of([F.col("month_year").isNotNull(), ent]))


def monthly_trends_stored(store: Store) -> DataFrame:
    """A18 over all lines of a store, from its indexes."""
    of = lambda table: getattr(store, table).filter("month_year is not null")
    products = distinct_counts(of("bitmaps"), ["month_year"]).select("month_year", F.col("product_description").alias("product_count"))
    shipped = of("declarations").groupBy("month_year").agg(F.count_distinct(*DIGEST).alias("shipment_count"))
    money = of("names").filter(F.col("role") == "exporter").groupBy("month_year").agg(M.money(F.sum("fob")).alias("total_fob"))
    rows = money.join(shipped, "month_year", "left").join(products, "month_year", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("month_year", zero("shipment_count"), "total_fob", zero("product_count")).orderBy(asc("month_year"))


# ---------------------------------------------------------------- A19-A22 dashboard


def dashboard_summary(e: DataFrame, month: str | None = None, exact: bool = True) -> DataFrame:
    """One row of market totals (``exact=False``: approximate distinct counts)."""
    return apply_filter(e, month_is(month)).agg(M.shipments("total_shipments", exact), M.fob_total(),
                    M.n_distinct("exporter_name", "unique_exporters", exact),
                    M.n_distinct("consignee_name", "unique_consignees", exact),
                    M.n_distinct("country_of_destination", "unique_countries", exact),
                    M.n_distinct("product_description", "unique_products", exact))


def dashboard_summary_stored(store: Store, month: str | None = None) -> DataFrame:
    """A19 from the store's indexes, equal to ``dashboard_summary`` of its
    lines: names, countries and products are bits of united bitmaps, shipments
    are counted from the months' sets of declarations, and money is added up
    per exporter. No line is read."""
    of = lambda table: apply_filter(getattr(store, table), month_is(month))
    money = of("names").filter(F.col("role") == "exporter").agg(M.money(F.sum("fob")))
    return distinct_counts(of("bitmaps"), []).select(
        of("declarations").agg(F.count_distinct(*DIGEST)).scalar().alias("total_shipments"), money.scalar().alias("total_fob"),
        F.col("exporter_name").alias("unique_exporters"), F.col("consignee_name").alias("unique_consignees"),
        F.col("country_of_destination").alias("unique_countries"), F.col("product_description").alias("unique_products"))


def dashboard_by_category(e: DataFrame, month: str | None = None) -> DataFrame:
    """Shipments and fob per category."""
    return rollup(e, ["data_type"], [M.shipments(), M.fob_total()],
                  order_by=[asc("data_type")], where=month_is(month))


def dashboard_top_exporters(e: DataFrame, month: str | None = None, k: int = 10) -> DataFrame:
    """Top k exporters by fob."""
    return rollup(e, ["exporter_name"], [M.shipments(), M.fob_total()],
                  order_by=by_then_keys([desc("total_fob")], ["exporter_name"]), k=k,
                  where=month_is(month))


def dashboard_top_countries(e: DataFrame, month: str | None = None, k: int = 10) -> DataFrame:
    """Top k destination countries by fob."""
    return rollup(e, ["country_of_destination"], [M.shipments(), M.fob_total()],
                  order_by=by_then_keys([desc("total_fob")], ["country_of_destination"]), k=k,
                  where=month_is(month))


def with_display(df: DataFrame, name_col: str, usd_col: str) -> DataFrame:
    """Adds the dashboard's display columns (G23-G25): a cleaned name and the
    USD / INR amount strings."""
    from ..functions import display as D
    return df.select("*", D.clean_name(F.col(name_col)).alias("display_name"),
                     D.format_usd(F.col(usd_col)).alias(f"{usd_col}_usd_text"),
                     D.format_inr(F.col(usd_col)).alias(f"{usd_col}_inr_text"))

