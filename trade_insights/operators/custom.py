"""Custom filtered reports C1-C3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.match import ROLE_COLUMNS, all_of, like_any, month_is
from ..sources.indexes import lines_of
from ..sources.store import Store
from .base import by_then_keys, desc


def split_terms(csv: str | None) -> list[str]:
    """'a, b,,c' -> ['A', 'B', 'C'] (trimmed, upper-cased, blanks dropped)."""
    if not csv:
        return []
    return [t.strip().upper() for t in csv.split(",") if t.strip()]


def custom_filter(countries: str | None = None, exporters: str | None = None,
                  consignees: str | None = None, month: str | None = None) -> Column:
    """OR of LIKE %term% inside a dimension, AND across dimensions.

    Raises ValueError when no term is given in any dimension.
    """
    c, x, k = split_terms(countries), split_terms(exporters), split_terms(consignees)
    if not (c or x or k):
        raise ValueError("provide at least one country, exporter or consignee")
    pred = all_of([like_any(F.upper(F.col("country_of_destination")), c),
                   like_any(F.upper(F.col("exporter_name")), x),
                   like_any(F.upper(F.col("consignee_name")), k),
                   month_is(month)])
    return pred


def stored_lines(store: Store, countries: str | None = None, exporters: str | None = None,
                 consignees: str | None = None) -> DataFrame:
    """The lines of a store that can meet ``custom_filter``: its exporters or
    consignees are looked up in the name index, and the names found become a
    filter that Parquet skips by, in the order of the lines that suits it. The
    reports below, applied to them, give what they give for all lines."""
    terms = {"exporter": split_terms(exporters), "consignee": split_terms(consignees)}
    role = next((r for r in ("exporter", "consignee") if terms[r]), None)
    if role is None:
        return store.lines
    column = ROLE_COLUMNS[role]
    return lines_of(store.by(column), column, store.names_like(role, terms[role]))


def company_lines(store: Store, company: str) -> DataFrame:
    """The lines of the own company (LIKE match), found in the same way."""
    return lines_of(store.lines, "exporter_name", store.names_like("exporter", [company]))


def _group_column(countries, exporters) -> Column:
    if split_terms(countries):
        return F.col("country_of_destination")
    if split_terms(exporters):
        return F.col("exporter_name")
    return F.col("consignee_name")


def custom_report_summary(e: DataFrame, countries: str | None = None, exporters: str | None = None,
                          consignees: str | None = None, month: str | None = None) -> DataFrame:
    """Grouped by country if countries are given, else exporter, else
    consignee (decided when the plan is built); by value desc."""
    pred = custom_filter(countries, exporters, consignees, month)
    out = e.filter(pred).groupBy(_group_column(countries, exporters).alias("group_by")).agg(
        M.shipments("total_shipments"), M.qty_total("total_quantity"),
        M.n_distinct("product_description", "total_products"), M.fob_total("total_value"),
        M.n_distinct("exporter_name", "exporters"), M.n_distinct("consignee_name", "consignees"))
    return out.orderBy(*by_then_keys([desc("total_value")], ["group_by"]))


DETAIL_COLUMNS = [
    ("declaration_id", "Declaration ID"), ("shipment_date", "Shipment Date"),
    ("exporter_name", "Exporter"), ("consignee_name", "Consignee"),
    ("product_description", "Product"), ("hs_code", "HS Code"), ("quantity", "Quantity"),
    ("unit", "Unit"), ("fob_value", "FOB Value (USD)"), (None, "FOB Value (INR)"),
    ("country_of_destination", "Country"), ("port_of_loading", "Port of Loading"),
    ("port_of_discharge", "Port of Discharge"), ("data_type", "Category"),
]


def detail_listing(rows: DataFrame, columns=DETAIL_COLUMNS) -> DataFrame:
    """Line listing with display headers; the INR column is derived."""
    sel = []
    for src, name in columns:
        if src is None:
            sel.append(M.to_inr(F.col("fob_value"), name))
        elif src == "fob_value":
            sel.append(M.money(F.col(src)).alias(name))
        else:
            sel.append(F.col(src).alias(name))
    return rows.select(*sel)


def custom_report_details(e: DataFrame, countries: str | None = None, exporters: str | None = None,
                          consignees: str | None = None, month: str | None = None) -> DataFrame:
    """14-column line listing incl. INR value, newest first."""
    pred = custom_filter(countries, exporters, consignees, month)
    out = detail_listing(e.filter(pred))
    names = [n for _, n in DETAIL_COLUMNS if n != "Shipment Date"]
    return out.orderBy(*by_then_keys([desc("Shipment Date")], names))
