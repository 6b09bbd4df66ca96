"""Report datasets E1-E10: each builds ``dict[block name -> DataFrame]``,
one lazy DataFrame per sheet, with the display headers of the downloads.
``sources.sink.write_report`` (E0) writes such a dict.

Every block is its own plan over the fact table with pruned columns and
partition filters; blocks share no cached state, so a lost executor only
re-runs the tasks of the block being written.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.match import (all_of, apply_filter, company_like, entity_is, like_any, month_is,
                               months_in, role_column)
from ..operators import compare as C
from ..operators import custom as X
from ..operators import intelligence as I
from ..operators.patterns import matching_names
from ..operators.base import Watchlist, active_names, by_then_keys, desc, keep_members, with_company
from ..schema import LABEL_CLIENT, LABEL_COMPETITOR, LABEL_OWN


def blocks(*names: str):
    """Declare the block names a report set returns."""
    def deco(fn):
        @wraps(fn)
        def run(*a, **kw):
            out = fn(*a, **kw)
            assert list(out) == list(names), (list(out), names)
            return out
        run.blocks = list(names)
        return run
    return deco


def bound(fn, **kw):
    """Report set with its parameters fixed: ``e -> dict``."""
    def build(e: DataFrame) -> dict[str, DataFrame]:
        return fn(e, **kw)
    build.blocks = fn.blocks
    return build


def _type_label(pred) -> F.Column:
    return F.when(pred, F.lit(LABEL_OWN)).otherwise(F.lit(LABEL_COMPETITOR))


# ---------------------------------------------------------------- E1


@blocks("companies", "vendors")
def export_benchmarking(e: DataFrame, company: str, wl: Watchlist, month: str | None = None):
    """(a) company and competitors matched by LIKE %name% for every name,
    with type label and INR; (b) the company's clients and all their vendors."""
    scan = apply_filter(e, month_is(month))
    exporters = scan.select("exporter_name").distinct()
    watched = active_names(wl)
    if isinstance(watched, DataFrame):
        own = scan.sparkSession.createDataFrame([(company.strip(),)], "name string")
        matched = matching_names(exporters.select(F.col("exporter_name").alias("name")), watched.select("name").unionByName(own)).withColumnRenamed("name", "exporter_name")
    else:
        matched = exporters.filter(like_any(F.upper(F.col("exporter_name")), [company, *watched]))
    rows = scan.join(matched, "exporter_name", "left_semi")
    companies = rows.groupBy("exporter_name").agg(
        M.shipments("Shipments"), M.fob_total("Total FOB (USD)"),
        M.fob_total_inr("Total FOB (INR)"), M.qty_total("Total Quantity"),
        M.n_distinct("product_description", "Products"),
        M.n_distinct("country_of_destination", "Countries"),
        M.n_distinct("consignee_name", "Clients"))
    companies = companies.select(
        F.col("exporter_name").alias("Company"), _type_label(company_like(company)).alias("Type"),
        *[c for c in companies.columns if c != "exporter_name"]
    ).orderBy(*by_then_keys([desc("Total FOB (USD)")], ["Company"]))

    scoped = scan
    clients = (scoped.filter(company_like(company) & F.col("consignee_name").isNotNull()
                             & (F.col("consignee_name") != F.lit("")))
               .select("consignee_name").distinct())
    vend = scoped.join(clients, "consignee_name", "left_semi").groupBy(
        "consignee_name", "exporter_name").agg(
        M.shipments("Shipments"), M.fob_total("FOB (USD)"), M.fob_total_inr("FOB (INR)"),
        M.qty_total("Quantity"))
    vendors = vend.select(
        F.col("consignee_name").alias("Client"), F.col("exporter_name").alias("Vendor"),
        _type_label(company_like(company)).alias("Type"),
        "Shipments", "FOB (USD)", "FOB (INR)", "Quantity",
    ).orderBy(F.col("Client").asc_nulls_last(), desc("FOB (USD)"), F.col("Vendor").asc_nulls_last())
    return {"companies": companies, "vendors": vendors}


# ---------------------------------------------------------------- E2


@blocks("competitors", "clients", "new_relationships")
def export_monthly_comparison(e: DataFrame, competitors: Watchlist, clients: Watchlist,
                              cur: str, prev: str):
    """Tracked exporters and clients per month (both months), and the
    new (client, supplier) pairs of the current month, top 100."""
    two = e.filter(months_in(cur, prev))
    comp = keep_members(two, "exporter_name", competitors).groupBy("exporter_name", "month_year").agg(
        M.shipments("Shipments"), M.fob_total("FOB (USD)"), M.fob_total_inr("FOB (INR)"),
        M.qty_total("Quantity"), M.n_distinct("product_description", "Products"))
    comp = comp.select(F.col("exporter_name").alias("Competitor"), F.col("month_year").alias("Month"),
                       "Shipments", "FOB (USD)", "FOB (INR)", "Quantity", "Products") \
               .orderBy("Competitor", "Month")
    cli = keep_members(two, "consignee_name", clients).groupBy("consignee_name", "month_year").agg(
        M.shipments("Shipments"), M.fob_total("FOB (USD)"), M.fob_total_inr("FOB (INR)"),
        M.qty_total("Quantity"), M.n_distinct("exporter_name", "Suppliers"))
    cli = cli.select(F.col("consignee_name").alias("Client"), F.col("month_year").alias("Month"),
                     "Shipments", "FOB (USD)", "FOB (INR)", "Quantity", "Suppliers") \
             .orderBy("Client", "Month")
    fob = F.sum(C.in_month("fob_value", cur))
    fresh = C.new_pairs(e, cur, prev, [F.count_distinct(C.in_month("declaration_id", cur)).alias("Shipments"),
                                       M.money(fob).alias("FOB (USD)"), M.to_inr(fob, "FOB (INR)")], False)
    new_rel = fresh.select(F.col("consignee_name").alias("Client"),
                           F.col("exporter_name").alias("New Supplier"),
                           "Shipments", "FOB (USD)", "FOB (INR)") \
                   .orderBy(*by_then_keys([desc("FOB (USD)")], ["Client", "New Supplier"])).limit(100)
    return {"competitors": comp, "clients": cli, "new_relationships": new_rel}


# ---------------------------------------------------------------- E3


@blocks("summary", "details")
def export_custom_report(e: DataFrame, countries: str | None = None, exporters: str | None = None,
                         consignees: str | None = None, month: str | None = None):
    """The custom report summary (rounded, with INR) and its lines."""
    pred = X.custom_filter(countries, exporters, consignees, month)
    group = X._group_column(countries, exporters)
    summary = e.filter(pred).groupBy(group.alias("Entity")).agg(
        M.shipments("Total Shipments"),
        F.round(F.sum("quantity"), 2).alias("Total Quantity"),
        M.n_distinct("product_description", "Total Products"),
        M.money(F.round(M.fob_sum_exact(), 2)).alias("Total Value (USD)"),
        M.fob_total_inr("Total Value (INR)"),
    ).orderBy(*by_then_keys([desc("Total Value (USD)")], ["Entity"]))
    details = X.custom_report_details(e, countries, exporters, consignees, month)
    return {"summary": summary, "details": details}


# ---------------------------------------------------------------- E4


@blocks("prospects", "products", "own_products")
def export_prospective_clients(e: DataFrame, company: str, own: DataFrame | None = None):
    """All prospects with INR (no limit), their per-product detail (no
    minimum and no 'NULL'-name filter) and the company's own products."""
    mine = e if own is None else own
    p = I.prospective_clients(e, company, k=None, inr=True, own=own)
    prospects = p.select(
        F.col("consignee_name").alias("Consignee Name"), F.col("country_of_destination").alias("Country"),
        F.col("total_shipments").alias("Total Shipments"), F.col("total_fob").alias("Total FOB (USD)"),
        F.col("total_fob_inr").alias("Total FOB (INR)"), F.col("total_quantity").alias("Total Quantity"),
        F.col("hs_codes").alias("HS Codes"), F.col("products").alias("Products"),
        F.col("current_suppliers").alias("Current Suppliers"))
    rows = (e.join(I.company_hs_list(mine, company), "hs_code", "left_semi")
             .filter(~company_like(company) & F.col("consignee_name").isNotNull()
                     & (F.col("consignee_name") != F.lit(""))))
    keys = ["consignee_name", "product_description", "hs_code", "exporter_name", "unit"]
    prod = rows.groupBy(*keys).agg(M.shipments("Shipments"), M.fob_total("FOB (USD)"),
                                   M.fob_total_inr("FOB (INR)"), M.qty_total("Quantity"))
    products = prod.select(
        F.col("consignee_name").alias("Consignee"), F.col("product_description").alias("Product"),
        F.col("hs_code").alias("HS Code"), "Shipments", "FOB (USD)", "FOB (INR)", "Quantity",
        F.col("unit").alias("Unit"), F.col("exporter_name").alias("Current Supplier"),
    ).orderBy(desc("FOB (USD)"))
    own_products = I.company_products(mine, company).select(
        F.col("hs_code").alias("HS Code"), F.col("product_description").alias("Product"),
        F.col("data_type").alias("Category"))
    return {"prospects": prospects, "products": products, "own_products": own_products}


# ---------------------------------------------------------------- E5


@blocks("opportunities", "clients")
def export_cross_sell(e: DataFrame, company: str, own: DataFrame | None = None):
    """E5: all cross-sell opportunities with INR — none when the company has
    no HS codes — and the company's client list."""
    rows = I.cross_sell_rows(e, company, empty_hs_gives_all=False, own=own)
    agg = rows.groupBy(*I.CROSS_SELL_KEYS).agg(
        M.shipments("Shipments"), M.fob_total("Total FOB (USD)"), M.fob_total_inr("Total FOB (INR)"),
        M.qty_total("Total Quantity"))
    opp = agg.select(
        F.col("consignee_name").alias("Your Client"), F.col("country_of_destination").alias("Country"),
        F.col("hs_code").alias("HS Code"), F.col("product_description").alias("Product"),
        F.col("exporter_name").alias("Competitor"), "Shipments", "Total FOB (USD)", "Total FOB (INR)",
        "Total Quantity", F.col("unit").alias("Unit"),
    ).orderBy(desc("Total FOB (USD)"))
    clients = I.company_clients(e if own is None else own, company).select(F.col("consignee_name").alias("Client Name"))
    return {"opportunities": opp, "clients": clients}


# ---------------------------------------------------------------- E6


@blocks("summary", "products", "countries", "shipments")
def export_entity_details(e: DataFrame, entity: str, role: str, month: str | None = None):
    """One entity's summary (zero / 'N/A' defaults), products, countries
    and all lines, with INR."""
    rows = e.filter(all_of([entity_is(entity, role), month_is(month)]))
    s = rows.agg(M.shipments("n"), M.fob_sum_exact().alias("fob"), F.sum("quantity").alias("q"),
                 M.n_distinct("product_description", "p"), M.n_distinct("country_of_destination", "c"),
                 F.min("shipment_date").alias("first"), F.max("shipment_date").alias("last"))
    zero = F.lit(0).cast("decimal(28,2)")
    summary = s.select(
        F.lit(entity).alias("Entity"),
        F.lit(LABEL_COMPETITOR if role_column(role) == "exporter_name" else LABEL_CLIENT).alias("Type"),
        F.col("n").alias("Total Shipments"),
        M.money(F.coalesce(F.col("fob"), zero)).alias("Total FOB (USD)"),
        M.money(F.coalesce(M.inr_exact(F.col("fob")), zero)).alias("Total FOB (INR)"),
        F.coalesce(F.col("q"), F.lit(0.0)).alias("Total Quantity"),
        F.col("p").alias("Unique Products"), F.col("c").alias("Unique Countries"),
        F.coalesce(F.date_format("first", "yyyy-MM-dd"), F.lit("N/A")).alias("First Shipment"),
        F.coalesce(F.date_format("last", "yyyy-MM-dd"), F.lit("N/A")).alias("Last Shipment"))
    pk = ["product_description", "hs_code", "data_type", "unit"]
    prod = rows.groupBy(*pk).agg(M.shipments("Shipments"), M.qty_total("Quantity"),
                                 M.fob_total("FOB (USD)"), M.fob_total_inr("FOB (INR)"))
    products = prod.select(
        F.col("product_description").alias("Product"), F.col("hs_code").alias("HS Code"),
        F.col("data_type").alias("Category"), "Shipments", "Quantity", F.col("unit").alias("Unit"),
        "FOB (USD)", "FOB (INR)").orderBy(desc("FOB (USD)"))
    countries = rows.groupBy(F.col("country_of_destination").alias("Country")).agg(
        M.shipments("Shipments"), M.qty_total("Quantity"), M.fob_total("FOB (USD)"),
        M.fob_total_inr("FOB (INR)")).orderBy(desc("FOB (USD)"))
    cols = [("declaration_id", "Declaration ID"), ("shipment_date", "Date"),
            ("exporter_name", "Exporter"), ("consignee_name", "Consignee"),
            ("product_description", "Product"), ("hs_code", "HS Code"), ("quantity", "Quantity"),
            ("unit", "Unit"), ("fob_value", "FOB (USD)"), (None, "FOB (INR)"),
            ("country_of_destination", "Country"), ("port_of_loading", "Port of Loading"),
            ("port_of_discharge", "Port of Discharge")]
    shipments = X.detail_listing(rows, cols).orderBy(desc("Date"))
    return {"summary": summary, "products": products, "countries": countries, "shipments": shipments}


# ---------------------------------------------------------------- E7-E10


def _line_listing(rows: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    return rows.select(*[M.money(F.col(s)).alias(n) if s == "fob_value" else F.col(s).alias(n)
                         for s, n in cols])


_ROW_TAIL = [("product_description", "Product"), ("data_type", "Category"), ("quantity", "Quantity"),
             ("unit", "Unit"), ("fob_value", "FOB Value"), ("fob_currency", "Currency")]


def export_competitor_rows(e: DataFrame, wl: Watchlist, month: str | None = None) -> DataFrame:
    """13-column lines of the tracked exporters; date desc, exporter."""
    cols = [("exporter_name", "Exporter"), ("declaration_id", "Declaration ID"),
            ("consignee_name", "Consignee"), *_ROW_TAIL,
            ("port_of_loading", "Port of Loading"), ("port_of_discharge", "Port of Discharge"),
            ("country_of_destination", "Country"), ("shipment_date", "Shipment Date")]
    rows = apply_filter(keep_members(e, "exporter_name", wl), month_is(month))
    return _line_listing(rows, cols).orderBy(desc("Shipment Date"), F.col("Exporter").asc_nulls_last())


def export_client_rows(e: DataFrame, wl: Watchlist, month: str | None = None) -> DataFrame:
    """13-column lines of the tracked consignees; date desc, consignee."""
    cols = [("consignee_name", "Client/Consignee"), ("exporter_name", "Supplier"),
            ("declaration_id", "Declaration ID"), *_ROW_TAIL,
            ("port_of_loading", "Port of Loading"), ("port_of_discharge", "Port of Discharge"),
            ("country_of_destination", "Country"), ("shipment_date", "Shipment Date")]
    rows = apply_filter(keep_members(e, "consignee_name", wl), month_is(month))
    return _line_listing(rows, cols).orderBy(desc("Shipment Date"),
                                             F.col("Client/Consignee").asc_nulls_last())


def export_company_comparison_rows(e: DataFrame, company: str, wl: Watchlist,
                                   month: str | None = None) -> DataFrame:
    """12-column lines of the company and the tracked exporters (exact
    match), type label by equality; exporter, date desc."""
    rows = apply_filter(keep_members(e, "exporter_name", with_company(e, company, wl)), month_is(month))
    cols = [("exporter_name", "Company"), ("declaration_id", "Declaration ID"),
            ("consignee_name", "Client"), *_ROW_TAIL,
            ("country_of_destination", "Country"), ("shipment_date", "Shipment Date")]
    out = _line_listing(rows, cols)
    out = out.select("Company", F.when(F.col("Company") == F.lit(company.strip().upper()),
                                       F.lit(LABEL_OWN)).otherwise(F.lit(LABEL_COMPETITOR)).alias("Type"),
                     *[n for _, n in cols[1:]])
    return out.orderBy(F.col("Company").asc_nulls_last(), desc("Shipment Date"))


def export_summary(e: DataFrame, month: str | None = None, exact: bool = True) -> DataFrame:
    """Every exporter with shipments, fob, products, countries, clients
    and categories; by fob desc (``exact=False``: approximate counts)."""
    out = apply_filter(e, month_is(month)).groupBy(F.col("exporter_name").alias("Exporter")).agg(
        M.shipments("Shipments", exact), M.fob_total("Total FOB"),
        M.n_distinct("product_description", "Products", exact),
        M.n_distinct("country_of_destination", "Countries", exact),
        M.n_distinct("consignee_name", "Clients", exact), M.categories( "Categories"))
    return out.orderBy(*by_then_keys([desc("Total FOB")], ["Exporter"]))
