"""Hot keys: one exporter with a third of all rows, one line copied a third
of the time. Results against brute force (pandas) on the same input; plans
must aggregate partially before shuffling."""

import pandas as pd
from pyspark.sql import functions as F

from trade_insights.operators import ingest as S
from trade_insights.operators import reports as R
from trade_insights.schema import EXPORT_COLUMNS


def hot(exports):
    # Every third declaration is re-attributed to one exporter.
    pick = F.xxhash64("declaration_id") % 3 == 0
    return exports.withColumn("exporter_name", F.when(pick, F.lit("HOT EXPORTER")).otherwise(F.col("exporter_name")))


def test_hot_exporter_summary_matches_brute_force(exports):
    e = hot(exports)
    from trade_insights.plans.report_sets import export_summary
    got = {r.Exporter: (r.Shipments, round(r["Total FOB"], 2), r.Categories) for r in export_summary(e).collect()}
    pdf = e.select("exporter_name", "declaration_id", "fob_value", "data_type").toPandas()
    pdf["fob_value"] = pdf["fob_value"].astype(float)
    want = {}
    for name, g in pdf.groupby("exporter_name"):
        want[name] = (g.declaration_id.nunique(), round(g.fob_value.sum(), 2), ",".join(sorted(g.data_type.unique())))
    assert got == want
    assert max(v[0] for v in got.values()) == got["HOT EXPORTER"][0]


def test_hot_group_is_partially_aggregated(exports):
    p = R.dashboard_top_exporters(hot(exports))._jdf.queryExecution().executedPlan().toString()
    # The first shuffle is keyed by (exporter, declaration): the hot exporter's
    # rows spread over all reducers, after a map-side partial sum.
    first_exchange = p.rindex("Exchange hashpartitioning(")
    assert p.startswith("Exchange hashpartitioning(exporter_name", first_exchange)
    assert "declaration_id" in p[first_exchange:p.index("\n", first_exchange)]
    assert p.rindex("partial_sum") > first_exchange


def test_group_of_copies_collapses_map_side(spark, exports):
    lines = exports.withColumn("ingest_seq", F.monotonically_increasing_id())
    one = lines.limit(1)
    copies = (one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3000))))
                 .withColumn("ingest_seq", F.lit(10_000_000) + F.col("copy")).drop("copy"))
    batch = lines.unionByName(copies.select(*lines.columns))
    out = S.dedup_exports(batch)
    assert out.count() == exports.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # partial aggregate below the exchange: copies collapse before the shuffle
    assert "partial_min" in plan and "__salt" in plan
    pdf = batch.select(*EXPORT_COLUMNS).toPandas()
    assert len(pdf.drop_duplicates(subset=["declaration_id", "shipment_date", "product_description", "hs_code",
                                           "quantity", "fob_value"])) == out.count()
