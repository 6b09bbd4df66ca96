"""Plan shape: partition pruning, pushed filters, no Python UDFs, semi joins
instead of driver-side key lists."""

from trade_insights import catalog as K
from trade_insights.operators import benchmark as B
from trade_insights.operators import compare as C
from trade_insights.operators import intelligence as I
from trade_insights.operators import reports as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_is_a_partition_filter(exports):
    p = plan(R.dashboard_top_exporters(exports, K.CUR))
    assert "PartitionFilters: [isnotnull(month_year" in p and "= 1998-06" in p
    assert "TakeOrderedAndProject" in p


def test_entity_filter_is_pushed(exports):
    p = plan(R.entity_countries(exports, K.EXPORTER, "exporter"))
    assert "PushedFilters: [IsNotNull(exporter_name), EqualTo(exporter_name,SUPPLIER#000000005)]" in p


def test_watchlist_is_an_in_filter(exports):
    p = plan(R.competitor_summary(exports, K.COMPETITORS, K.CUR))
    assert "PushedFilters: [In(exporter_name" in p


def test_two_step_reports_are_single_plans(exports):
    for df in (I.prospective_clients(exports, K.COMPANY), I.cross_sell(exports, K.COMPANY),
               C.new_relationships(exports, K.CUR, K.PREV)):
        p = plan(df)
        assert "LeftSemi" in p or "LeftAnti" in p
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_rank_uses_scalar_subquery_not_cross_join(exports):
    p = plan(B.company_rank(exports, K.COMPANY))
    assert "Subquery" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


FORBIDDEN = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
             "BroadcastNestedLoopJoin", "FlatMapGroupsInPandas", "MapInPandas")


def test_no_udf_or_cross_join_in_any_registered_query(spark):
    from conftest import SF_SMALL

    from trade_insights.catalog import QUERIES
    for name, fn in QUERIES.items():
        if name == "incremental_ingest":  # a streaming run; its batches are ingest_file plans
            continue
        p = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        bad = [f for f in FORBIDDEN if f in p]
        assert not bad, (name, bad)
