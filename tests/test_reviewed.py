"""Order, watchlists as tables, size-independent filters, deep pages."""

import pytest
from pyspark.sql import functions as F

from trade_insights import catalog as K
from trade_insights.operators import base
from trade_insights.operators import compare as C
from trade_insights.operators import reports as R
from trade_insights.operators import watchlist as W
from trade_insights.plans import report_sets as E


def as_table(spark, names):
    return spark.createDataFrame([(n.lower() + " ", True) for n in names] + [("SUPPLIER#000000002", False)], "name string, active boolean")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_empty_month_is_no_filter(exports):
    assert rows(R.dashboard_summary(exports, "")) == rows(R.dashboard_summary(exports))
    assert rows(R.company_comparison(exports, K.COMPANY, K.COMPETITORS, "")) == rows(R.company_comparison(exports, K.COMPANY, K.COMPETITORS))


def test_trend_is_ordered_and_scans_once(spark, exports):
    trend = R.competitor_trend(exports, K.COMPETITORS, K.CUR, K.PREV)
    got = [(-r.total_fob, r.exporter_name) for r in trend.collect()]
    assert got == sorted(got) and len(got) > 1
    assert trend._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert rows(R.competitor_summary(exports, K.COMPETITORS, K.CUR)) == [r[: len(r) - 3] for r in rows(trend)]


def test_a_table_gives_the_rows_of_a_list(spark, exports):
    table = as_table(spark, K.COMPETITORS)
    for report in (lambda w: R.competitor_summary(exports, w, K.CUR), lambda w: R.company_comparison(exports, K.COMPANY, w, K.CUR),
                   lambda w: R.competitor_trend(exports, w, K.CUR, K.PREV), lambda w: W.search_exporters(exports, K.SEARCH_EXPORTER_Q, w),
                   lambda w: E.export_benchmarking(exports, K.COMPANY, w, K.CUR)["companies"],
                   lambda w: E.export_company_comparison_rows(exports, K.COMPANY, w, K.CUR).orderBy("Company", "Declaration ID", "Product", "Quantity")):
        assert rows(report(table)) == rows(report(K.COMPETITORS))


def test_five_thousand_names(spark, exports):
    names = [f"SUPPLIER#{i:09d}" for i in range(0, 10_000, 2)]
    want = sorted({r.exporter_name for r in exports.select("exporter_name").distinct().collect()} & set(names))
    assert want
    for watch in (names, spark.createDataFrame([(n,) for n in names], "name string")):
        assert sorted(r.exporter_name for r in base.keep_members(exports, "exporter_name", watch).select("exporter_name").distinct().collect()) == want
        flagged = base.member_flag(exports.select("exporter_name").distinct(), "exporter_name", watch, "hit")
        assert sorted(r.exporter_name for r in flagged.filter("hit").collect()) == want


def test_new_relationships_scan_both_months_once(exports):
    plan = C.new_pairs(exports, K.CUR, K.PREV, [F.count(F.lit(1)).alias("n")], False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


@pytest.mark.parametrize("limit", [7, 50])
def test_pages_by_key_agree_with_offsets(exports, limit):
    last = None
    for page in range(1, 6):
        by_offset = R.shipments_page(exports, K.EXPORTER, "exporter", page=page, limit=limit).collect()
        by_key = R.shipments_after(exports, K.EXPORTER, "exporter", last, limit=limit).collect()
        assert by_key == by_offset and by_key
        last = by_key[-1].asDict()
    assert "GlobalLimit " + str(limit) in R.shipments_after(exports, K.EXPORTER, "exporter", last, limit=limit)._jdf.queryExecution().optimizedPlan().toString()


def test_scratch_folder_of_a_cluster_must_be_named(monkeypatch):
    from trade_insights import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_views_share_one_scan(exports):
    from trade_insights.plans import report_views as V
    views = (V.entity_details(exports, K.EXPORTER, "exporter"), V.monthly_comparison(exports, K.COMPETITORS, K.CLIENTS, K.CUR, K.PREV),
             V.monthly_comparison_details(exports, K.EXPORTER, "exporter", K.CUR, K.PREV))
    plain = (R.entity_products(exports, K.EXPORTER, "exporter"), C.new_relationships(exports, K.CUR, K.PREV), C.entity_month_products(exports, K.EXPORTER, "exporter", K.CUR, K.PREV))
    for view, name, want in zip(views, ("products", "clients_new_suppliers", "products"), plain):
        assert rows(view[name]) == rows(want)
        for block in view.values():
            assert "/view-" in block.inputFiles()[0] and not any("/exports-" in f for f in block.inputFiles())
