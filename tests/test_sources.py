"""S1 import formats, the empty-import error, and the report sink formats."""

import json
import os
import tempfile

import pytest

from trade_insights.operators import ingest as S
from trade_insights.plans import report_sets as E
from trade_insights.sources import read_raw, write_report
from trade_insights.sources.raw import EmptyImportError, require_rows

ROW = {"SB No": "D9", "Shipper": " acme ", "Buyer": "b co", "Item": "Mango", "HS Code": "0804",
       "Qty": 12.5, "FOB (USD)": "$1,000.00", "Shipment Date": "2024-03-01"}


def _clean(spark, raw):
    return S.clean(S.resolve_columns(S.with_sequence(raw)), "fruits", "b").collect()[0]


def test_json_import_cells_become_text(spark):
    folder = tempfile.mkdtemp(prefix="trade_insights-src-")
    path = os.path.join(folder, "in.json")
    with open(path, "w") as f:
        f.write(json.dumps(ROW) + "\n")
    raw = read_raw(spark, path, "json")
    assert all(t == "string" for _, t in raw.dtypes)
    row = _clean(spark, raw)
    assert (row.declaration_id, row.exporter_name, row.quantity, str(row.fob_value)) == ("D9", "ACME", 12.5, "1000.00")


def test_parquet_import(spark):
    folder = tempfile.mkdtemp(prefix="trade_insights-src-")
    path = os.path.join(folder, "in.parquet")
    spark.createDataFrame([ROW]).write.parquet(path)
    row = _clean(spark, read_raw(spark, path, "parquet"))
    assert (row.declaration_id, row.product_description, str(row.shipment_date)) == ("D9", "Mango", "2024-03-01")


def test_empty_import_is_an_error(spark):
    folder = tempfile.mkdtemp(prefix="trade_insights-src-")
    path = os.path.join(folder, "empty.csv")
    with open(path, "w") as f:
        f.write("SB No,Shipper\n")
    with pytest.raises(EmptyImportError):
        require_rows(read_raw(spark, path, "csv"))


def test_unknown_format_rejected(spark):
    with pytest.raises(ValueError):
        read_raw(spark, "/nowhere", "xlsx")


def test_csv_report_keeps_display_headers(exports):
    blocks = E.export_entity_details(exports, "CUSTOMER#000000022", "consignee")
    out = write_report(blocks, tempfile.mkdtemp(prefix="trade_insights-report-"), "csv")
    back = exports.sparkSession.read.option("header", True).csv(out["summary"])
    assert "Total FOB (USD)" in back.columns and back.count() == 1
