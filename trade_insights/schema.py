"""Canonical fact-table schema and the fixed values the results depend on."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

# Type of money amounts: sums of any number of them fit a DECIMAL(38,2).
MONEY = "decimal(28,2)"

# Canonical shipment-line table. One row per declaration line; a "shipment"
# is a distinct declaration_id. Missing text is '' (never NULL) after ingest.
EXPORTS_SCHEMA = T.StructType([
    T.StructField("declaration_id", T.StringType(), False),
    T.StructField("exporter_name", T.StringType(), True),
    T.StructField("consignee_name", T.StringType(), True),
    T.StructField("product_description", T.StringType(), True),
    T.StructField("product_category", T.StringType(), True),
    T.StructField("data_type", T.StringType(), True),
    T.StructField("hs_code", T.StringType(), True),
    T.StructField("quantity", T.DoubleType(), True),
    T.StructField("unit", T.StringType(), True),
    T.StructField("fob_value", T.DecimalType(28, 2), True),
    T.StructField("fob_currency", T.StringType(), True),
    T.StructField("port_of_loading", T.StringType(), True),
    T.StructField("port_of_discharge", T.StringType(), True),
    T.StructField("country_of_destination", T.StringType(), True),
    T.StructField("shipment_date", T.DateType(), True),
    T.StructField("month_year", T.StringType(), True),
    T.StructField("upload_batch", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("ingest_seq", T.LongType(), True),
])

EXPORT_COLUMNS = [f.name for f in EXPORTS_SCHEMA.fields]

# Partition layout of the stored fact table.
PARTITION_COLUMNS = ["month_year", "upload_batch"]

# Six-column uniqueness key of a shipment line (first row wins on ingest).
DEDUP_KEY = ["declaration_id", "shipment_date", "product_description",
             "hs_code", "quantity", "fob_value"]

WATCHLIST_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("active", T.BooleanType(), False),
])

# ---------------------------------------------------------------------------
# Fixed values. These must equal the application's own values for results to
# agree; they are stated here as given, in their original order.
# ---------------------------------------------------------------------------

# The two product categories an upload may be tagged with.
CATEGORIES = ("fruits", "vegetables")

# USD -> INR conversion constant.
USD_TO_INR = Decimal("83.5")

# Default unit and currency when the import leaves them blank.
DEFAULT_UNIT = "KGS"
DEFAULT_CURRENCY = "USD"

# Header aliases per canonical field, in the order they are tried.
ALIASES: dict[str, list[str]] = {
    "declaration_id": [
        "Declaration ID", "DECLARATION_ID", "declaration_id", "Dec ID",
        "Declaration No", "DECLARATION_NO", "declaration_no", "Declaration_No",
        "DeclarationNo", "DECLARATIONNO", "Dec No", "DEC_NO", "DecNo",
        "SB No", "SB_No", "SB NO", "SB_NO", "SBNO", "Sb No",
        "Shipping Bill No", "SHIPPING_BILL_NO", "Shipping Bill Number",
        "Bill No", "BILL_NO", "Bill Number", "Reference No", "Ref No",
        "Invoice No", "INVOICE_NO", "Invoice Number", "ID", "Sr No", "SrNo",
        "S.No", "SNO", "Record ID", "RECORD_ID", "Unique ID",
    ],
    "exporter_name": [
        "Exporter Name", "EXPORTER_NAME", "exporter_name", "Exporter",
        "EXPORTER", "Indian Exporter", "INDIAN_EXPORTER", "Shipper",
        "SHIPPER", "Shipper Name", "Seller", "SELLER", "Seller Name",
        "Company", "Company Name", "COMPANY_NAME", "Supplier", "SUPPLIER",
    ],
    "consignee_name": [
        "Consignee Name", "CONSIGNEE_NAME", "consignee_name", "Consignee",
        "CONSIGNEE", "Buyer", "BUYER", "Buyer Name", "BUYER_NAME",
        "Foreign Buyer", "FOREIGN_BUYER", "Importer", "IMPORTER",
        "Importer Name", "Customer", "CUSTOMER", "Customer Name",
        "Consinee Name", "CONSINEE_NAME", "Consinee", "CONSINEE",
    ],
    "product_description": [
        "Product Description", "PRODUCT_DESCRIPTION", "product_description",
        "Product", "PRODUCT", "Item", "ITEM", "Item Description",
        "ITEM_DESCRIPTION", "Description", "DESCRIPTION", "Goods",
        "GOODS", "Goods Description", "GOODS_DESCRIPTION", "Goods_Description",
        "Product Name", "PRODUCT_NAME", "Commodity", "COMMODITY",
        "HS Description", "Item Name", "ItemDescription",
    ],
    "hs_code": [
        "HS Code", "HS_CODE", "hs_code", "HSCode", "HSCODE", "HS",
        "ITC Code", "ITC_CODE", "ITCCode", "ITC HS", "ITC_HS",
        "Tariff Code", "TARIFF_CODE", "Chapter", "CHAPTER",
    ],
    "quantity": [
        "Quantity", "QUANTITY", "quantity", "Qty", "QTY", "qty",
        "Unit Quantity", "UNIT_QUANTITY", "Net Quantity", "NET_QUANTITY",
        "Weight", "WEIGHT", "Net Weight", "NET_WEIGHT", "Gross Weight",
    ],
    "unit": [
        "Unit", "UNIT", "unit", "UQC", "UOM", "Unit of Measure",
        "UNIT_OF_MEASURE", "Quantity Unit", "QUANTITY_UNIT",
    ],
    "fob_value": [
        "FOB Value", "FOB_VALUE", "fob_value", "FOB", "Fob",
        "FOB USD", "FOB_USD", "Fob Usd", "FOB Usd", "Fob USD",
        "FOB INR", "FOB_INR", "Fob Inr", "Value",
        "VALUE", "Invoice Value", "INVOICE_VALUE", "Total Value",
        "TOTAL_VALUE", "Amount", "AMOUNT", "Price", "PRICE",
        "Value USD", "Value INR", "FOB (USD)", "FOB (INR)",
    ],
    "fob_currency": [
        "Currency", "CURRENCY", "currency", "Curr", "CURR",
        "Currency Code", "CURRENCY_CODE",
    ],
    "port_of_loading": [
        "Port of Loading", "PORT_OF_LOADING", "port_of_loading",
        "Indian Port", "INDIAN_PORT", "Loading Port", "LOADING_PORT",
        "Port", "PORT", "Origin Port", "ORIGIN_PORT", "From Port",
        "Departure Port", "DEPARTURE_PORT", "POL", "Port Code",
    ],
    "port_of_discharge": [
        "Port of Discharge", "PORT_OF_DISCHARGE", "port_of_discharge",
        "Foreign Port", "FOREIGN_PORT", "Discharge Port", "DISCHARGE_PORT",
        "Destination Port", "DESTINATION_PORT", "To Port", "POD",
        "Arrival Port", "ARRIVAL_PORT", "Final Port",
    ],
    "country_of_destination": [
        "Country", "COUNTRY", "country", "Destination Country",
        "DESTINATION_COUNTRY", "Country of Destination", "COUNTRY_OF_DESTINATION",
        "Destination", "DESTINATION", "Foreign Country", "FOREIGN_COUNTRY",
        "Importing Country", "IMPORTING_COUNTRY", "To Country",
    ],
    "shipment_date": [
        "Shipment Date", "SHIPMENT_DATE", "shipment_date", "Date", "DATE",
        "SB Date", "SB_DATE", "Shipping Date", "SHIPPING_DATE",
        "Bill Date", "BILL_DATE", "Export Date", "EXPORT_DATE",
        "Invoice Date", "INVOICE_DATE", "Dispatch Date", "DISPATCH_DATE",
    ],
}

# Placeholder consignee/exporter names shown as "Name Not Available".
PLACEHOLDER_NAMES = ["TO ORDER", "TO THE ORDER", "NULL", "N/A", "NA", "NONE",
                     "-", "--", "NIL", "NOT AVAILABLE"]
NAME_NOT_AVAILABLE = "Name Not Available"

# Row labels used by the company-vs-competitor reports.
LABEL_OWN = "Your Company"
LABEL_COMPETITOR = "Competitor"
LABEL_CLIENT = "Client"
