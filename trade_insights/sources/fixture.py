"""Canonical shipment lines derived from the TPC-H-style test tables.

This only reshapes test rows into the fact-table schema (one line item = one
shipment line, order = declaration, supplier = exporter, customer = consignee);
it does none of the reports' work. The column mapping is fixed so the DuckDB
oracle can inline the same view.

Join plan: the lines meet suppliers, parts and orders (with their customers),
and pass through a shuffle with few bytes: the narrow sides come first, and the
names of nations and regions are looked up last, by their numbers. Where a
reader filters by one of the sides, it asks for that side first, so that what
it filters out is not shuffled. No broadcast hints: the planner broadcasts a
side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime), and falls
back to a shuffled sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid
from collections.abc import Callable

from ..schema import EXPORT_COLUMNS, MONEY
from ..session import work_dir

FIXTURE_BATCH = "fixture"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The side that holds a column that readers filter by.
SIDES = {"exporter_name": "supplier", "hs_code": "part", "consignee_name": "orders"}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables' columns that the lines are made of."""
    columns = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"],
               "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"],
               "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
               "part": ["p_partkey", "p_name", "p_brand", "p_size"]}
    return {t: read_table(spark, sf_dir, t).select(*c) for t, c in columns.items()}


#: Keys by which the lines meet each side.
_ON = {"supplier": ("l_suppkey", "s_suppkey"), "part": ("l_partkey", "p_partkey"), "orders": ("l_orderkey", "o_orderkey")}


def _on(side: str) -> Column:
    line, own = _ON[side]
    return F.col(line) == F.col(own)


def _exporter() -> Column:
    return F.upper("s_name")


def _ship_date() -> Column:
    return F.col("l_shipdate").cast("date")


def _month() -> Column:
    return F.date_format(_ship_date(), "yyyy-MM")


def exports_from_tpch(spark: SparkSession, sf_dir: str, by: str = "exporter_name") -> DataFrame:
    """Lazy DataFrame of canonical shipment lines over the test tables. ``by``
    names the column whose side the lines meet first."""
    t = _tables(spark, sf_dir)
    return _joined(t, t["lineitem"], sorted(_ON, key=lambda s: s != SIDES.get(by)))


def exports_of(spark: SparkSession, sf_dir: str, exporters: list[str], months: list[str],
               place: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The lines of these exporters in these months. What is left of the
    suppliers, then of the lines, then of the orders is put in a file by
    ``place``, so that the planner knows its size: few lines are broadcast to
    the tables that they meet, which no shuffle moves then; many are shuffled."""
    t = _tables(spark, sf_dir)
    suppliers = place(t["supplier"].filter(_exporter().isin(exporters)).hint("rebalance"), "supplier")
    lines = place(t["lineitem"].filter(_month().isin(months)).join(suppliers, _on("supplier")).hint("rebalance"), "lineitem")
    t["orders"] = place(t["orders"].join(lines, _on("orders"), "left_semi").hint("rebalance"), "orders")
    return _joined(t, lines, ["part", "orders"])


def _joined(t: dict[str, DataFrame], lines: DataFrame, sides: list[str]) -> DataFrame:
    """The lines with the sides that they have not met yet, in this order."""
    nation, orders = t["nation"], t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    for side in sides:
        lines = lines.join(orders if side == "orders" else t[side], _on(side))
    to = (nation.join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
          .select(F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("cn_name"), "r_name"))
    lines = (
        lines.join(to, F.col("c_nationkey") == F.col("cn_key"))
        .join(nation.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sn_name")),
              F.col("s_nationkey") == F.col("sn_key"))
    )
    category = F.when(F.col("p_partkey") % 2 == 0, F.lit("fruits")).otherwise(F.lit("vegetables"))
    out = lines.select(
        F.col("o_orderkey").cast("string").alias("declaration_id"),
        _exporter().alias("exporter_name"),
        F.upper("c_name").alias("consignee_name"),
        F.col("p_name").alias("product_description"),
        category.alias("product_category"),
        category.alias("data_type"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("hs_code"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.lit("KGS").alias("unit"),
        F.col("l_extendedprice").cast(MONEY).alias("fob_value"),
        F.lit("USD").alias("fob_currency"),
        F.col("sn_name").alias("port_of_loading"),
        F.concat(F.col("r_name"), F.lit(" / "), F.col("c_mktsegment")).alias("port_of_discharge"),
        F.col("cn_name").alias("country_of_destination"),
        _ship_date().alias("shipment_date"),
        _month().alias("month_year"),
        F.lit(FIXTURE_BATCH).alias("upload_batch"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("long").alias("ingest_seq"),
    )
    return out.select(*EXPORT_COLUMNS)


# Header rows of the two stand-in import files built from the test tables.
RAW_HEADERS = ["SB No", "Exporter Name", "Shipper", "Buyer", "Item Description", "HS", "Qty",
               "UOM", "FOB (USD)", "Currency", "Port", "POD", "Destination Country", "SB Date"]
SECOND_HEADERS = ["SB Date", "Buyer", *[h for h in RAW_HEADERS if h not in ("SB Date", "Buyer")]]

# What the second upload says in a column that is not part of the key.
SECOND_PORT = "SECOND PORT"

# Date layouts by declaration number modulo 12; a day serial for 0.
DATE_LAYOUTS = {1: "M/d/yyyy", 2: "yyyy-MM-dd", 3: "yyyy-MM-dd HH:mm:ss", 4: "yyyy/MM/dd", 5: "M/d/yy", 6: "M/d/yyyy H:mm",
                7: "dd-MMM-yy", 8: "d MMM yyyy", 9: "MMM d, yyyy", 10: "dd-MMMM-yyyy", 11: "yyyy-MM-dd'T'HH:mm:ss"}
UNDATED_EVERY, NO_ID_EVERY = 97, 89


def raw_import_from_tpch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two import sheets as customs export files would look: loose headers in
    two orders, text cells ('23.0 KGS', '$68,423.46', dates in many layouts,
    day serials), names padded with blanks, tabs and no-break spaces and
    lower-cased, lines without a date and without a declaration number, a junk
    row with no identifying cell for lines with quantity > 45, and in the
    second file the lines with quantity < 5 again, with another port.

    Only renders rows; all parsing, matching and dedup is the ingest job's.
    """
    lines = exports_from_tpch(spark, sf_dir)
    number, d = F.col("declaration_id").cast("long"), F.col("shipment_date")
    date_cell = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    for k, layout in DATE_LAYOUTS.items():
        date_cell = F.when(number % 12 == k, F.date_format(d.cast("timestamp") + F.expr("INTERVAL 13 HOURS 5 MINUTES"), layout)).otherwise(date_cell)
    date_cell = F.when(number % 12 == 2, F.concat(F.lit("\t"), date_cell)).otherwise(date_cell)
    date_cell = F.when(number % UNDATED_EVERY == 0, F.lit("not known")).otherwise(date_cell)
    qty_cell = F.concat(F.col("quantity").cast("string"), F.lit(" KGS"))
    sheet = lines.select(
        F.when(number % NO_ID_EVERY == 0, F.lit("\u00a0")).otherwise(F.concat(F.col("declaration_id"), F.lit("\t"))).alias("SB No"),
        F.when(F.col("quantity").cast("long") % 2 == 0, F.col("exporter_name"))
         .otherwise(F.lit("\t\u00a0")).alias("Exporter Name"),
        F.concat(F.lit("  "), F.lower("exporter_name"), F.lit(" \t")).alias("Shipper"),
        F.concat(F.lit("\u00a0"), F.col("consignee_name"), F.lit("\t")).alias("Buyer"),
        F.col("product_description").alias("Item Description"),
        F.col("hs_code").alias("HS"),
        qty_cell.alias("Qty"),
        F.lit("").alias("UOM"),
        F.concat(F.lit("$"), F.format_number(F.col("fob_value").cast("double"), 2)).alias("FOB (USD)"),
        F.lit("").alias("Currency"),
        F.col("port_of_loading").alias("Port"),
        F.col("port_of_discharge").alias("POD"),
        F.col("country_of_destination").alias("Destination Country"),
        date_cell.alias("SB Date"),
        F.col("quantity"),
    )
    again = sheet.filter(F.col("quantity") < 5).withColumn("Port", F.lit(SECOND_PORT))
    blank = F.lit("")
    # Junk rows keep only cells no identity field can match, not even through
    # the header matcher's substring phase ('Port' would match 'exporter').
    junk = sheet.filter(F.col("quantity") > 45).select(
        *[(F.col(h) if h == "Qty" else F.lit("USD") if h == "Currency" else blank).alias(h)
          for h in RAW_HEADERS], "quantity")
    return sheet.unionByName(junk).select(*RAW_HEADERS), again.select(*SECOND_HEADERS)


_SHEETS: dict[tuple[str, str], str] = {}


def raw_import_file(spark: SparkSession, sf_dir: str) -> str:
    """The stand-in sheets written once per session as CSV uploads (header
    row, one file per task, the first upload's folder first by name) in the
    shared checkpoint folder; returns the folder that holds both."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    path = _SHEETS.get(key)
    if path is None:
        path = work_dir(spark, f"raw-import-{uuid.uuid4().hex[:12]}")
        for name, sheet in zip(("first", "second"), raw_import_from_tpch(spark, sf_dir)):
            (sheet.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
                  .option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}"))
        _SHEETS[key] = path
    return path
