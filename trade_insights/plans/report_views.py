"""Multi-block report views: the blocks one application screen shows,
as ``dict[block name -> DataFrame]``.

A view over few of the table's lines (one entity, two months) first writes
these lines to the shared checkpoint folder, in one pruned scan of the table,
and its blocks read them from there. The other views' blocks are independent
lazy plans over the table with their own filters. Nothing is cached, so a lost
executor costs no more than the tasks in flight. Write a view with
``sources.sink.write_report``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame

from ..functions.match import entity_is, months_in
from ..operators import benchmark as B
from ..operators import compare as C
from ..operators import custom as X
from ..operators import intelligence as I
from ..operators import reports as R
from ..operators.base import Watchlist
from ..session import work_dir


def _subset(e: DataFrame, which: Column) -> DataFrame:
    """The lines that a view's blocks share, written once and read back."""
    path = work_dir(e.sparkSession, f"view-{uuid.uuid4().hex}")
    e.filter(which).write.parquet(path)
    return e.sparkSession.read.schema(e.schema).parquet(path)


def dashboard(e: DataFrame, month: str | None = None) -> dict[str, DataFrame]:
    """Totals, per category, top exporters, top countries."""
    return {"summary": R.dashboard_summary(e, month), "by_category": R.dashboard_by_category(e, month),
            "top_exporters": R.dashboard_top_exporters(e, month),
            "top_countries": R.dashboard_top_countries(e, month)}


def competitor_analysis(e: DataFrame, wl: Watchlist, month: str | None = None,
                        compare_month: str | None = None) -> dict[str, DataFrame]:
    """A2/A3: tracked exporters, with the compare month when both are given."""
    out = {"competitors": R.competitor_summary(e, wl, month)}
    if month and compare_month:
        out["comparison"] = R.competitor_baseline(e, wl, compare_month)
    return out


def client_analysis(e: DataFrame, wl: Watchlist, month: str | None = None,
                    compare_month: str | None = None) -> dict[str, DataFrame]:
    """A4/A5: tracked consignees, with the compare month when both are given."""
    out = {"clients": R.client_summary(e, wl, month)}
    if month and compare_month:
        out["comparison"] = R.client_baseline(e, wl, compare_month)
    return out


def entity_details(e: DataFrame, entity: str, role: str, month: str | None = None) -> dict[str, DataFrame]:
    """One exporter's or consignee's profile, from one scan."""
    e = _subset(e, entity_is(entity, role))
    out = {"summary": R.entity_summary(e, entity, role, month),
           "products": R.entity_products(e, entity, role, month),
           "countries": R.entity_countries(e, entity, role, month),
           "ports": R.entity_ports(e, entity, role, month),
           "monthly_trend": R.entity_monthly_trend(e, entity, role)}
    if role in ("consignee", "client"):
        out["suppliers"] = R.entity_suppliers(e, entity, month)
    else:
        out["clients"] = R.entity_clients(e, entity, month)
    out["recent_shipments"] = R.entity_recent_shipments(e, entity, role, month)
    return out


def shipments(e: DataFrame, entity: str, role: str, month: str | None = None, page: int = 1,
              limit: int = 50) -> dict[str, DataFrame]:
    """One page of lines and the total line count."""
    return {"shipments": R.shipments_page(e, entity, role, month, page, limit),
            "total": R.shipments_total(e, entity, role, month)}


def monthly_comparison(e: DataFrame, competitors: Watchlist, clients: Watchlist, cur: str,
                       prev: str) -> dict[str, DataFrame]:
    """M1-M4: competitor and client comparison, new suppliers, new pairs,
    from one scan of the two months."""
    e = _subset(e, months_in(cur, prev))
    return {"competitor_comparison": C.competitor_month_comparison(e, competitors, cur, prev),
            "client_comparison": C.client_month_comparison(e, clients, cur, prev),
            "new_suppliers_to_clients": C.new_suppliers_to_tracked_clients(e, clients, cur, prev),
            "clients_new_suppliers": C.new_relationships(e, cur, prev)}


def monthly_comparison_details(e: DataFrame, entity: str, role: str, cur: str,
                               prev: str) -> dict[str, DataFrame]:
    """M5-M7: one entity's lines, products and countries in both months,
    from one scan."""
    e = _subset(e, entity_is(entity, role) & months_in(cur, prev))
    return {"rows": C.entity_month_rows(e, entity, role, cur, prev),
            "products": C.entity_month_products(e, entity, role, cur, prev),
            "countries": C.entity_month_countries(e, entity, role, cur, prev)}


def benchmarking(e: DataFrame, company: str, wl: Watchlist, month: str | None = None) -> dict[str, DataFrame]:
    """Own company, competitors, market, share, rank, client vendors."""
    return {"company": B.company_benchmark(e, company, month),
            "competitors": B.competitor_benchmark(e, wl, month),
            "market": B.market_totals(e, month),
            "market_share": B.market_share(e, company, month),
            "rank": B.company_rank(e, company, month),
            "client_vendors": B.client_vendor_analysis(e, company, month),
            "market_position": B.market_position(e, company, wl, month)}


def prospective_clients(e: DataFrame, company: str) -> dict[str, DataFrame]:
    """The company's products and the prospective buyers."""
    return {"company_products": I.company_products(e, company),
            "prospective_clients": I.prospective_clients(e, company)}


def cross_sell(e: DataFrame, company: str) -> dict[str, DataFrame]:
    """The company's clients, its HS codes, cross-sell opportunities."""
    return {"clients": I.company_clients(e, company), "hs_codes": I.company_hs_codes(e, company),
            "opportunities": I.cross_sell(e, company)}


def custom_report(e: DataFrame, countries: str | None = None, exporters: str | None = None,
                  consignees: str | None = None, month: str | None = None) -> dict[str, DataFrame]:
    """Grouped summary and line details of a filtered report."""
    return {"summary": X.custom_report_summary(e, countries, exporters, consignees, month),
            "details": X.custom_report_details(e, countries, exporters, consignees, month)}
