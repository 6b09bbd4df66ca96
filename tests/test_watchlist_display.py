"""Watchlists (W1-W2), search edge cases, display columns, custom filter."""

import pytest
from pyspark.sql import functions as F

from trade_insights.functions import display as D
from trade_insights.operators import custom as X
from trade_insights.operators import watchlist as W
from trade_insights.schema import WATCHLIST_SCHEMA


def test_active_and_changes(spark):
    wl = spark.createDataFrame([("ACME", None, True), ("OLD CO", None, False)], WATCHLIST_SCHEMA)
    wl2, added, errors = W.apply_changes(wl, adds=[" new co ", "acme", "old co", "", "NEW CO"],
                                         removes=["acme"])
    assert [r.name for r in added.collect()] == ["NEW CO"]
    assert [(r.name, r.error) for r in errors.collect()] == [
        ("acme", "Already exists"), ("old co", "Already exists"), ("NEW CO", "Already exists")]
    assert [r.name for r in W.active(wl2).collect()] == ["NEW CO"]


def test_search_short_query_is_empty(exports):
    assert W.search_exporters(exports, "a", []).count() == 0


def test_search_without_usable_words_returns_overall_top(exports):
    out = W.search_exporters(exports, "a b", ["SUPPLIER#000000001"]).collect()
    assert len(out) == 10  # sf0.001 has 10 exporters; no word filter
    assert any(r.already_tracked for r in out)


def test_custom_filter_requires_a_term():
    with pytest.raises(ValueError):
        X.custom_filter(" , ", None, "")


@pytest.mark.parametrize("usd,text", [(0, "$0"), (None, "$0"), (12.5, "$12.50"), (1500, "$1.5K"),
                                      (2_345_678, "$2.35M")])
def test_format_usd(spark, usd, text):
    df = spark.createDataFrame([(None if usd is None else float(usd),)], "v double")
    assert df.select(D.format_usd(F.col("v"))).first()[0] == text


@pytest.mark.parametrize("usd,text", [(0, "₹0"), (10, "₹835"), (100, "₹8.4K"), (2000, "₹1.67 L"),
                                      (200_000, "₹1.67 Cr")])
def test_format_inr(spark, usd, text):
    df = spark.createDataFrame([(None if usd is None else float(usd),)], "v double")
    assert df.select(D.format_inr(F.col("v"))).first()[0] == text


@pytest.mark.parametrize("name,shown", [("TO ORDER", "Name Not Available"), (" n/a ", "Name Not Available"),
                                        ("X", "Name Not Available"), (None, "Name Not Available"),
                                        ("ACME", "ACME")])
def test_clean_name(spark, name, shown):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(D.clean_name(F.col("n"))).first()[0] == shown
