"""Report edge fixtures (FIXTURES.md §4) and cross-report properties."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trade_insights.operators import benchmark as B
from trade_insights.operators import compare as C
from trade_insights.operators import custom as X
from trade_insights.operators import intelligence as I
from trade_insights.operators import reports as R
from trade_insights.operators import watchlist as W
from trade_insights.plans import report_sets as E
from trade_insights.schema import EXPORTS_SCHEMA
from trade_insights.sources import write_report

NOV, DEC = "2024-11", "2024-12"


def line(decl, exp, con, prod, hs, fob, month, country="UAE", cat="fruits", qty=10.0):
    day = dt.date(int(month[:4]), int(month[5:]), 5)
    return (decl, exp, con, prod, cat, cat, hs, qty, "KGS", Decimal(fob), "USD", "MUMBAI", "JEBEL ALI",
            country, day, month, "b", None, None)


@pytest.fixture(scope="module")
def e(spark):
    rows = [
        # tracked exporter in both months; its November fob is zero
        line("D1", "BOTH CO", "BUYER A", "Mango", "0804", "0.00", NOV),
        line("D2", "BOTH CO", "BUYER A", "Mango", "0804", "100.00", DEC),
        # tracked exporter only in December (new) / only in November (dropped)
        line("D3", "NEW CO", "BUYER B", "Grapes", "0806", "50.00", DEC),
        line("D4", "OLD CO", "BUYER B", "Grapes", "0806", "70.00", NOV),
        # own company under two legal names, selling 0804 to BUYER A and a placeholder buyer
        line("D5", "ACME AGRO PVT LTD", "BUYER A", "Mango", "0804", "300.00", DEC),
        line("D6", "ACME AGRO INDIA", "TO ORDER", "Mango", "0804", "30.00", DEC),
        line("D7", "ACME AGRO INDIA", "NULL", "Mango", "0804", "30.00", DEC),
        # other buyers of the company's HS code
        line("D8", "RIVAL", "BUYER C", "Mango", "0804", "40.00", DEC),
        line("D9", "RIVAL", "BUYER C", "Mango", "0804", "45.00", NOV),
        line("D10", "RIVAL", "", "Mango", "0804", "5.00", DEC),
        # BUYER A also buys onions from a rival: a cross-sell opportunity
        line("D11", "RIVAL", "BUYER A", "Onion", "0703", "60.00", DEC, cat="vegetables"),
        # a name with a LIKE wildcard character
        line("D12", "100% FRESH", "BUYER D", "Lime", "0805", "9.00", DEC, country="OMAN"),
    ]
    return spark.createDataFrame(rows, EXPORTS_SCHEMA)


def by(rows, key):
    return {r[key]: r for r in rows}


def test_new_dropped_and_zero_previous(e):
    out = by(C.competitor_month_comparison(e, ["BOTH CO", "NEW CO", "OLD CO"], DEC, NOV).collect(), "name")
    assert out["BOTH CO"].fob_change_pct is None          # previous fob is zero
    assert out["BOTH CO"].shipment_change_pct == 0.0
    assert out["NEW CO"].is_new and out["NEW CO"].fob_change_pct is None
    assert out["OLD CO"].is_dropped and out["OLD CO"].fob_change_pct == -100.0
    assert out["OLD CO"].shipment_change_pct == -100.0 and not out["OLD CO"].is_new


def test_client_comparison_has_no_dropped_rows(e):
    out = C.client_month_comparison(e, ["BUYER A", "BUYER B", "BUYER C"], DEC, NOV).collect()
    assert {r.name for r in out} == {"BUYER A", "BUYER B", "BUYER C"}
    out_nov_only = C.client_month_comparison(e, ["BUYER B"], NOV, DEC).collect()
    assert [r.name for r in out_nov_only] == ["BUYER B"]


def test_new_supplier_to_tracked_client(e):
    out = C.new_suppliers_to_tracked_clients(e, ["BUYER A", "BUYER B"], DEC, NOV).collect()
    pairs = {(r.client, r.new_supplier) for r in out}
    assert ("BUYER A", "RIVAL") in pairs and ("BUYER B", "NEW CO") in pairs
    assert ("BUYER A", "BOTH CO") not in pairs


def test_empty_watchlist(e):
    assert R.competitor_summary(e, []).count() == 0
    assert C.competitor_month_comparison(e, [], DEC, NOV).count() == 0
    assert B.competitor_benchmark(e, []).count() == 0


def test_company_matched_by_like_across_legal_names(e):
    bench = B.company_benchmark(e, "acme agro").first()
    assert bench.shipments == 3 and bench.total_fob == 360.0
    assert [r.company_rank for r in B.company_rank(e, "ACME AGRO").collect()] == [1]


def test_prospects_skip_blank_and_null_names(e):
    out = I.prospective_clients(e, "ACME AGRO", min_shipments=1).collect()
    names = {r.consignee_name for r in out}
    assert "BUYER C" in names and "" not in names and "NULL" not in names
    assert "BUYER A" in names  # buyers of the company are not excluded


def test_cross_sell_and_company_without_hs_codes(e):
    out = I.cross_sell(e, "ACME AGRO").collect()
    assert {(r.client_name, r.hs_code) for r in out} == {("BUYER A", "0703")}
    # A company with no HS codes: the report keeps every code, the export is empty.
    e2 = e.withColumn("hs_code", F.when(F.col("exporter_name").contains("ACME AGRO"), F.lit("")).otherwise(F.col("hs_code")))
    assert {r.hs_code for r in I.cross_sell(e2, "ACME AGRO").collect()} == {"0804", "0703"}
    assert E.export_cross_sell(e2, "ACME AGRO")["opportunities"].count() == 0


def test_wildcard_terms_keep_like_semantics(e):
    # '%' in a term is a wildcard, as in the application's LIKE.
    assert {r.group_by for r in X.custom_report_summary(e, exporters="100%").collect()} == {"100% FRESH"}
    assert W.search_exporters(e, "10_%", []).count() == 1
    assert X.custom_report_summary(e, countries="om_n").count() == 1


def test_placeholder_names_shown_as_not_available(e):
    out = R.with_display(R.entity_clients(e, "ACME AGRO INDIA"), "consignee_name", "total_fob").collect()
    assert {r.display_name for r in out} == {"Name Not Available"}


# ---------------------------------------------------------------- properties


def test_market_shares_add_to_100(exports):
    names = [r.exporter_name for r in exports.select("exporter_name").distinct().collect()]
    total = sum(B.market_share(exports, n).first().market_share_pct for n in names)
    assert abs(total - 100.0) < 0.01 * len(names)


def test_top_exporter_has_rank_one(exports):
    top = R.dashboard_top_exporters(exports, k=1).first().exporter_name
    assert B.company_rank(exports, top).first().company_rank == 1


def test_top_exporters_subset_of_summary(exports):
    top = {(r.exporter_name, r.total_fob) for r in R.dashboard_top_exporters(exports).collect()}
    summ = {(r.Exporter, r["Total FOB"]) for r in E.export_summary(exports).collect()}
    assert top <= summ


def test_category_fob_adds_up(exports):
    by_cat = sum(r.total_fob for r in R.dashboard_by_category(exports).collect())
    assert abs(by_cat - R.dashboard_summary(exports).first().total_fob) < 1e-6


def test_write_report_one_dataset_per_block(exports):
    blocks = E.export_entity_details(exports, "SUPPLIER#000000005", "exporter")
    out = write_report(blocks, tempfile.mkdtemp(prefix="trade_insights-report-"), "parquet")
    assert set(out) == {"summary", "products", "countries", "shipments"}
    assert all(os.path.isdir(p) for p in out.values())
    spark = exports.sparkSession
    assert spark.read.parquet(out["shipments"]).count() == blocks["shipments"].count()


def test_report_views_build_every_block(exports):
    from trade_insights.plans import report_views as V
    views = [V.dashboard(exports, "1998-06"), V.entity_details(exports, "SUPPLIER#000000005", "exporter"),
             V.entity_details(exports, "CUSTOMER#000000022", "consignee"),
             V.monthly_comparison(exports, ["SUPPLIER#000000001"], ["CUSTOMER#000000022"], "1998-06", "1998-05"),
             V.benchmarking(exports, "SUPPLIER#000000003", ["SUPPLIER#000000001"], "1998-06"),
             V.competitor_analysis(exports, ["SUPPLIER#000000001"], "1998-06", "1998-05"),
             V.cross_sell(exports, "SUPPLIER#000000003"), V.custom_report(exports, countries="NATION_1")]
    for view in views:
        for name, df in view.items():
            assert df.columns, name
            df.limit(1).collect()
    assert "suppliers" in views[2] and "clients" in views[1]


def test_approximate_counts_are_close(exports):
    exact = R.dashboard_summary(exports).first()
    approx = R.dashboard_summary(exports, exact=False).first()
    for f in ("total_shipments", "unique_exporters", "unique_consignees", "unique_countries", "unique_products"):
        assert abs(approx[f] - exact[f]) <= max(2, 0.05 * exact[f]), f
    assert approx.total_fob == exact.total_fob
