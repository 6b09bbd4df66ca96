"""What a query moves: lines are joined as they are read, and indexes are
written at their first use."""

import datetime
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from trade_insights import catalog as K
from trade_insights.operators import reports as R
from trade_insights.plans import report_sets as E
from trade_insights.session import work_dir
from trade_insights.sources import fixture_store
from trade_insights.sources.fixture import SIDES, exports_from_tpch
from trade_insights.sources.store import TableStore, store_exists

from conftest import SF_SMALL


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return TableStore(spark, work_dir(spark, f"test-{uuid.uuid4().hex}"), SF_SMALL)


@pytest.mark.parametrize("by", [*SIDES, "declaration_id"])
def test_lines_are_the_same_whatever_they_meet_first(spark, exports, by):
    assert rows(exports_from_tpch(spark, SF_SMALL, by)) == rows(exports)


def test_a_filtered_report_writes_nothing(spark, tables, exports):
    report = R.client_baseline(tables.by("consignee_name"), K.CLIENTS, K.PREV)
    assert not store_exists(spark, tables.path) and rows(report) == rows(R.client_baseline(exports, K.CLIENTS, K.PREV))


def test_indexes_made_at_first_use_hold_the_same(spark, tables):
    whole = fixture_store(spark, SF_SMALL)
    assert rows(tables.names_like("exporter", [K.COMPANY])) == rows(whole.names_like("exporter", [K.COMPANY]))
    assert store_exists(spark, f"{tables.path}/grams") and not store_exists(spark, f"{tables.path}/names")
    for table in ("names", "grams", "declarations"):
        assert rows(getattr(tables, table)) == rows(getattr(whole, table)), table
    for month in (None, K.CUR):
        assert rows(R.dashboard_summary_stored(tables, month)) == rows(R.dashboard_summary(whole.lines, month))
    assert R.monthly_trends_stored(tables).collect() == R.monthly_trends(whole.lines).collect()


def test_prospects_join_the_lines_once(spark, tables):
    from trade_insights.operators import intelligence as I
    report = I.prospective_clients(tables.by("hs_code"), K.COMPANY, k=None, own=tables.lines)
    assert "l_partkey" not in plan(report) and rows(report) == rows(I.prospective_clients(fixture_store(spark, SF_SMALL).lines, K.COMPANY, k=None))


def shuffled_rows(df):
    """Rows that the shuffles of a plan have written."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


ORDERS = 20_000


@pytest.fixture(scope="module")
def many_orders(spark):
    """Lines of few tracked exporters among many orders, parts and customers,
    with repeated, null and unknown keys."""
    folder = tempfile.mkdtemp(prefix="trade_insights-tables-")
    put = lambda df, name: df.write.parquet(f"{folder}/{name}.parquet")
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    put(made([(0, "R0")], "r_regionkey int, r_name string"), "region")
    put(made([(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int"), "nation")
    put(made([(i, f"Supplier#{i:09d}", i % 2) for i in range(40)] + [(41, "supplier#000000001", 0), (4, "Supplier#000000004", 1), (42, None, 0), (None, "Supplier#000000005", 0)],
             "s_suppkey long, s_name string, s_nationkey int"), "supplier")
    n = spark.range(ORDERS)
    put(n.select(F.col("id").alias("p_partkey"), F.format_string("part %d", F.col("id") % 7).alias("p_name"), F.lit("B").alias("p_brand"), F.lit(1).alias("p_size")), "part")
    put(n.select(F.col("id").alias("c_custkey"), F.format_string("c%d", "id").alias("c_name"), (F.col("id") % 2).cast("int").alias("c_nationkey"), F.lit("M").alias("c_mktsegment")), "customer")
    put(n.union(spark.range(0, ORDERS, 5)).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("o_custkey")), "orders")
    days = [datetime.datetime(1998, m, 3, 7) for m in (4, 5, 6)] + [None]
    lines = [(i * 37 % (ORDERS + 500) if i % 13 else None, i * 7 % ORDERS if i % 17 else None, i % 43 if i % 19 else None, float(i % 9), i / 4, days[i % 4]) for i in range(4_000)]
    put(made(lines + lines[:300], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"), "lineitem")
    return folder


@pytest.fixture
def small_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "32k")
    yield
    spark.conf.set(key, was)


def test_few_lines_meet_the_orders_without_a_shuffle_of_them(spark, many_orders, small_broadcasts):
    e = exports_from_tpch(spark, many_orders)
    want = E.export_monthly_comparison(e, K.COMPETITORS, K.CLIENTS, K.CUR, K.PREV)["competitors"]
    found = K.QUERIES["export_monthly_comparison_competitors"](spark, many_orders)
    assert want.count() == 10 and found.collect() == want.collect()
    assert shuffled_rows(want) > ORDERS and shuffled_rows(found) < ORDERS / 5


@pytest.mark.parametrize("exporters", [["SUPPLIER#000000001", "SUPPLIER#000000004", "SUPPLIER#000000005"], ["NOBODY"], []])
@pytest.mark.parametrize("months", [[K.CUR, K.PREV], [K.PREV], ["1970-01"]])
def test_lines_of_exporters_are_the_filtered_lines(spark, many_orders, exporters, months):
    of = TableStore(spark, work_dir(spark, f"test-{uuid.uuid4().hex}"), many_orders).of(exporters, months)
    want = exports_from_tpch(spark, many_orders).filter(F.col("exporter_name").isin(exporters) & F.col("month_year").isin(months))
    assert of.schema.names == want.schema.names and rows(of) == rows(want)


def test_lines_of_exporters_in_a_written_store(spark, tables):
    stored = fixture_store(spark, SF_SMALL)
    found = rows(stored.of(K.COMPETITORS, [K.CUR, K.PREV]))
    assert found and found == rows(tables.of(K.COMPETITORS, [K.CUR, K.PREV]))


def test_many_lines_of_exporters_are_shuffled(spark, many_orders):
    """Where the lines are too many for a broadcast, the same rows come."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        of = TableStore(spark, work_dir(spark, f"test-{uuid.uuid4().hex}"), many_orders).of(K.COMPETITORS, [K.CUR, K.PREV])
        want = exports_from_tpch(spark, many_orders).filter(F.col("exporter_name").isin(K.COMPETITORS) & F.col("month_year").isin([K.CUR, K.PREV]))
        assert "Broadcast" not in of._jdf.queryExecution().executedPlan().toString() and rows(of) == rows(want)
    finally:
        spark.conf.set(key, was)
