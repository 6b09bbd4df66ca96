"""The store: commits, indexes, what reports read of it."""

import datetime as dt
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trade_insights import catalog as K
from trade_insights.functions.match import like_any
from trade_insights.operators import custom as X
from trade_insights.operators import ingest as S
from trade_insights.operators import reports as R
from trade_insights.operators import watchlist as W
from trade_insights.schema import EXPORT_COLUMNS, EXPORTS_SCHEMA
from trade_insights.sources import Store, compact, fixture_store, indexes, read_exports, write_exports
from trade_insights.sources import store as T

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def stored(spark):
    return fixture_store(spark, SF_SMALL)


def new_store():
    return tempfile.mkdtemp(prefix="trade_insights-store-") + "/store"


def line(number, batch, month="2024-01", exporter="ACME", consignee="B1", country="UAE", product="Mango", qty=1.0):
    row = dict.fromkeys(EXPORT_COLUMNS)
    row |= {"declaration_id": number, "exporter_name": exporter, "consignee_name": consignee, "product_description": product, "hs_code": "0804", "data_type": "fruits",
            "quantity": qty, "fob_value": Decimal("10.00"), "country_of_destination": country, "month_year": month, "upload_batch": batch}
    if month:
        row["shipment_date"] = dt.date(int(month[:4]), int(month[5:]), 15)
    return tuple(row[c] for c in EXPORT_COLUMNS)


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), EXPORTS_SCHEMA)


def held(spark, path, table="lines"):
    return sorted((r.declaration_id, r.month_year, r.upload_batch) for r in read_exports(spark, path, table).collect())


def rows(df):
    return sorted(map(repr, df.collect()))


# ---------------------------------------------------------------- commits


@pytest.mark.parametrize("point", ["_publish", "_clean"])
def test_a_write_that_ends_early_leaves_old_or_new(spark, monkeypatch, point):
    path = new_store()
    write_exports(lines(spark, line("D1", "a"), line("D2", "a", "2024-02"), line("D9", "b")), path)
    old = [("D1", "2024-01", "a"), ("D2", "2024-02", "a"), ("D9", "2024-01", "b")]
    new = [("D1", "2024-03", "a"), ("D9", "2024-01", "b")]

    def ends(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(T, point, ends)
        with pytest.raises(KeyboardInterrupt):
            write_exports(lines(spark, line("D1", "a", "2024-03")), path)
    want = old if point == "_publish" else new
    assert held(spark, path) == held(spark, path, "by_consignee") == want
    assert read_exports(spark, path, "keys").count() == len(want)
    # the next write succeeds and cleans up what the other left
    write_exports(lines(spark, line("D1", "a", "2024-03")), path)
    assert held(spark, path) == held(spark, path, "by_consignee") == new and not T.live(spark, path).dead


def test_an_unfinished_state_file_does_not_count(spark):
    path = new_store()
    write_exports(lines(spark, line("D1", "a")), path)
    state = T.live(spark, path)
    with open(f"{path}/_live/{state.number + 1:012d}.json", "w") as f:
        f.write('{"number": 7, "comm')
    assert T.live(spark, path) == state and held(spark, path) == [("D1", "2024-01", "a")]


def test_a_second_writer_of_one_state_fails(spark):
    path = new_store()
    write_exports(lines(spark, line("D1", "a")), path)
    state = T.live(spark, path)
    with pytest.raises(T.ConcurrentWriteError):
        T._publish(spark, path, state)
    assert held(spark, path) == [("D1", "2024-01", "a")]


def test_replaced_batches_and_compaction(spark):
    path = new_store()
    write_exports(lines(spark, line("D1", "a"), line("D2", "b b/%")), path)
    write_exports(lines(spark, line("D3", "c", None)), path, replaced=["a"])
    assert held(spark, path) == [("D2", "2024-01", "b b/%"), ("D3", None, "c")]
    write_exports(lines(spark), path, replaced=["c"])
    assert held(spark, path) == [("D2", "2024-01", "b b/%")]
    write_exports(lines(spark, line("D4", "d")), path)
    before = held(spark, path)
    assert len(T.live(spark, path).commits) == 2
    compact(spark, path)
    assert held(spark, path) == before and len(T.live(spark, path).commits) == 1
    ids = read_exports(spark, path, "dictionary")
    assert ids.count() == ids.select("column", "id").distinct().count() == ids.select("column", "value").distinct().count()


def test_an_empty_store(spark):
    path = new_store()
    assert read_exports(spark, path).columns == EXPORT_COLUMNS and read_exports(spark, path).count() == 0
    write_exports(lines(spark), path)
    s = Store(spark, path)
    assert held(spark, path) == []
    assert [tuple(r) for r in R.dashboard_summary_stored(s).collect()] == [tuple(r) for r in R.dashboard_summary(s.lines).collect()] == [(0, None, 0, 0, 0, 0)]
    assert R.monthly_trends_stored(s).collect() == [] and W.search_exporters_stored(s, "acme", []).collect() == []


# ---------------------------------------------------------------- duplicate check


def scans(df):
    """The folders of a plan's file scans."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return {f.split("/commit=")[0].rsplit("/", 1)[1] for f in df.inputFiles() if "/commit=" in f}, text


def test_an_import_reads_keys_and_no_lines(spark):
    path = new_store()
    write_exports(lines(spark, *(line(f"D{m}-{k}", f"m{m}", f"2023-{m:02d}") for m in range(1, 13) for k in range(20))), path)
    new = lines(spark, *(line(f"D3-{k}", "new", "2023-03") for k in range(15, 25)), line("D4-1", "new", "2023-04"), line("x", "new", None), line("x", "new", None)).withColumn("ingest_seq", F.monotonically_increasing_id())
    out = S.dedup_exports(new, read_exports(spark, path, "keys"), ["2023-03", "2023-04"])
    folders, plan = scans(out)
    assert folders == {"keys"}
    assert sorted(r.declaration_id for r in out.collect()) == [*(f"D3-{k}" for k in range(20, 25)), "x", "x"]
    assert rows(out) == rows(S.dedup_exports(new, read_exports(spark, path), ["2023-03", "2023-04"]))
    # another month's key is another line, a later upload of the same is not
    assert S.dedup_exports(lines(spark, line("D3-1", "n", "2023-05")).withColumn("ingest_seq", F.lit(1)), read_exports(spark, path, "keys")).count() == 1


def test_a_hot_key_is_dealt_out(spark):
    path = new_store()
    write_exports(lines(spark, line("hot", "old")), path)
    hot = lines(spark, line("hot", "n"), line("own", "n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100_000)))).withColumn("ingest_seq", F.col("copy") * 10 + F.when(F.col("declaration_id") == "own", 1).otherwise(0)).drop("copy")
    out = S.dedup_exports(hot.select(*EXPORT_COLUMNS).repartition(16), read_exports(spark, path, "keys"))
    assert [(r.declaration_id, r.ingest_seq) for r in out.collect()] == [("own", 11)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "__salt" in plan
    # a key's copies meet the index as one row, and their first in many salts
    salted = hot.select(F.pmod(F.xxhash64("ingest_seq"), F.lit(S.SALTS)).alias("s")).groupBy("s").count()
    assert salted.agg(F.max("count")).first()[0] < 3 * 200_000 / S.SALTS


def test_keys_tell_lines_apart(spark):
    a, b = line("1", "x"), line("2", "x")
    zero, minus = line("3", "x", qty=0.0), line("3", "x", qty=-0.0)
    df = lines(spark, a, b, zero, minus, line("4", "x", None))
    found = indexes.keys(df)
    assert found.count() == 4 and found.select("key_hi", "key_lo").distinct().count() == 3


# ---------------------------------------------------------------- reports from indexes


def test_indexes_give_what_the_lines_give(stored):
    e = stored.lines
    for month in (None, K.CUR, "1901-01"):
        assert rows(R.dashboard_summary_stored(stored, month)) == rows(R.dashboard_summary(e, month))
    assert [tuple(r) for r in R.monthly_trends_stored(stored).collect()] == [tuple(r) for r in R.monthly_trends(e).collect()]
    for q in (K.SEARCH_EXPORTER_Q, K.SEARCH_CONSIGNEE_Q, "#0 9", "sup%er", "r_0", "a", "", None, "nobody at all", "00000001 zz"):
        assert W.search_exporters_stored(stored, q, K.COMPETITORS).collect() == W.search_exporters(e, q, K.COMPETITORS).collect()
        assert W.search_consignees_stored(stored, q, K.CLIENTS).collect() == W.search_consignees(e, q, K.CLIENTS).collect()


def test_summary_reads_no_line(stored):
    for df in (R.dashboard_summary_stored(stored), R.monthly_trends_stored(stored), W.search_consignees_stored(stored, K.SEARCH_CONSIGNEE_Q, K.CLIENTS)):
        folders, plan = scans(df)
        assert not folders & {"lines", "by_consignee"} and "Expand" not in plan


def test_counts_over_replaced_and_repeated_values(spark):
    path = new_store()
    write_exports(lines(spark, line("D1", "a", consignee=""), line("D2", "a", exporter="Z", product=None), line("D3", "b", "2024-02", consignee=None)), path)
    write_exports(lines(spark, line("D1", "c", "2024-03", exporter="NEW"), line(None and "x" or "D7", "d", None, country=None)), path, replaced=["a"])
    write_exports(lines(spark, line("D1", "e", "2024-02", consignee="B9")), path)
    s = Store(spark, path)
    for month in (None, "2024-02", "2024-01"):
        assert rows(R.dashboard_summary_stored(s, month)) == rows(R.dashboard_summary(s.lines, month))
    assert R.monthly_trends_stored(s).collect() == R.monthly_trends(s.lines).collect()


@pytest.mark.parametrize("terms", [["#00000001"], ["0000000", "nothing"], ["R#0%15"], ["_00000002"], ["#0"], ["%"], ["zz"], ["\\"], ["plier%er#"]])
def test_names_found_by_grams(stored, terms):
    found = sorted(r.name for r in indexes.names_like(stored.names, stored.grams, "exporter", terms).collect())
    want = sorted(r[0] for r in stored.lines.select("exporter_name").distinct().filter(like_any(F.upper("exporter_name"), terms)).collect())
    assert found == want


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_filtered_reports_on_found_lines(stored, most, monkeypatch):
    monkeypatch.setattr(X, "lines_of", lambda *a: indexes.lines_of(*a, most=most))
    for terms in ((K.FILTER_COUNTRIES, K.FILTER_EXPORTERS, None), (None, None, K.FILTER_CONSIGNEES), (None, K.FILTER_EXPORTERS, K.FILTER_CONSIGNEES), (K.FILTER_COUNTRIES, None, None)):
        found = X.stored_lines(stored, *terms)
        assert rows(X.custom_report_summary(found, *terms)) == rows(X.custom_report_summary(stored.lines, *terms))
        assert rows(X.custom_report_details(found, *terms)) == rows(X.custom_report_details(stored.lines, *terms))


def scanned_rows(df):
    """Rows that the scans of a plan hand on, after row groups and pages are skipped."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        own = [p.metrics().apply("numOutputRows").value()] if "FileSourceScan" in kind else []
        return own + [x for i in range(p.children().size()) for x in walk(p.children().apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_filters_on_names_skip_rows_in_either_order(spark):
    path = new_store()
    n = 30_000
    df = spark.range(n).select(F.col("id").cast("string").alias("declaration_id"), F.format_string("X%03d", F.col("id") % 100).alias("exporter_name"),
                               F.format_string("C%04d", F.col("id") * 7919 % 3000).alias("consignee_name"), F.lit("2024-01").alias("month_year"), F.lit("b").alias("upload_batch"))
    for c in EXPORTS_SCHEMA.fields:
        if c.name not in df.columns:
            df = df.withColumn(c.name, F.lit(None).cast(c.dataType))
    write_exports(df.select(*EXPORT_COLUMNS), path)
    s = Store(spark, path)
    own = lambda e, column, name: scanned_rows(e.filter(F.col(column) == name).select("declaration_id"))
    assert own(s.lines, "exporter_name", "X042")[0] <= n / 10 and own(s.by_consignee, "consignee_name", "C0042")[0] <= n / 10
    assert own(s.lines, "consignee_name", "C0042")[0] > n / 2
    assert s.by("consignee_name") is s.by_consignee and s.by("exporter_name") is s.lines
    listed = indexes.lines_of(s.by_consignee, "consignee_name", spark.createDataFrame([("C0042",), ("C0043",)], "name string")).select("declaration_id")
    assert scanned_rows(listed)[0] <= n / 10 and listed.count() == 20
