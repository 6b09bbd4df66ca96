"""Sales intelligence I1-I5: own products, prospective buyers, cross-sell.

The application runs these as two steps (collect keys, then an IN list);
here each is one plan with a semi / anti join, so no key list ever passes
through the driver. The own company is matched by ``LIKE %company%``. Where
``own`` gives lines that hold all of the company's, such as those that
``custom.company_lines`` finds by the name index, its codes and clients are
taken from them instead of from a scan of all lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.match import company_like, not_placeholder_name
from ..session import work_dir
from .base import by_then_keys, desc, rollup, with_lists


def _company_rows(e: DataFrame, company: str) -> DataFrame:
    return e.filter(company_like(company))


def _not_company(company: str):
    return ~company_like(company)


def _non_blank(col: str):
    return F.col(col).isNotNull() & (F.col(col) != F.lit(""))


def company_products(e: DataFrame, company: str) -> DataFrame:
    """Distinct (hs code, product, category) the company exports."""
    return _company_rows(e, company).select("hs_code", "product_description", "data_type").distinct()


def company_hs_list(e: DataFrame, company: str) -> DataFrame:
    """Distinct non-blank HS codes among the company's products."""
    return _company_rows(e, company).filter(_non_blank("hs_code")).select("hs_code").distinct()


def _written(rows: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder and read back."""
    path = work_dir(rows.sparkSession, f"rows-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def prospective_clients(e: DataFrame, company: str, k: int | None = 100,
                        min_shipments: int | None = 2, drop_null_name: bool = True,
                        inr: bool = False, own: DataFrame | None = None) -> DataFrame:
    """Buyers of the company's HS codes from other exporters.

    Per (consignee, country): shipments, fob, quantity and the distinct HS
    codes, products and current suppliers; at least ``min_shipments``
    shipments; top k by fob. Buyers that already buy from the company are
    not excluded (the application does not exclude them either). The lines of
    these codes are written once, in the columns that the sums and the lists
    both read, so that ``e`` is read and joined once.
    """
    rows = (e.join(company_hs_list(e if own is None else own, company), "hs_code", "left_semi")
             .filter(_not_company(company) & _non_blank("consignee_name")))
    if drop_null_name:
        rows = rows.filter(not_placeholder_name("consignee_name"))
    keys = ["consignee_name", "country_of_destination"]
    rows = _written(rows.select(*keys, "declaration_id", "fob_value", "quantity", "hs_code", "product_description", "exporter_name"))
    aggs = [M.shipments("total_shipments"), M.fob_total()]
    if inr:
        aggs.append(M.fob_total_inr("total_fob_inr"))
    aggs.append(M.qty_total())
    out = rows.groupBy(*keys).agg(*aggs)
    if min_shipments is not None:
        out = out.filter(F.col("total_shipments") >= min_shipments)
    order = by_then_keys([desc("total_fob")], keys)
    if k is not None:
        out = out.orderBy(*order).limit(k)
    lists = {"hs_codes": "hs_code", "products": "product_description", "current_suppliers": "exporter_name"}
    return with_lists(out, rows, {c: c for c in keys}, lists, k is None).orderBy(*order)


def company_clients(e: DataFrame, company: str) -> DataFrame:
    """Distinct real consignee names of the company."""
    return (_company_rows(e, company).filter(not_placeholder_name("consignee_name"))
            .select("consignee_name").distinct())


def company_hs_codes(e: DataFrame, company: str) -> DataFrame:
    """I4: distinct non-blank HS codes the company sells to its I3 clients.

    "Consignee is one of the company's clients" holds for a company row
    exactly when its consignee is a real name, so this is a filter on the
    company's own rows rather than a join.
    """
    return (_company_rows(e, company)
            .filter(not_placeholder_name("consignee_name") & _non_blank("hs_code"))
            .select("hs_code").distinct())


CROSS_SELL_KEYS = ["consignee_name", "hs_code", "product_description", "exporter_name",
                   "country_of_destination", "unit"]


def cross_sell_rows(e: DataFrame, company: str, empty_hs_gives_all: bool = True, own: DataFrame | None = None) -> DataFrame:
    """Lines other exporters ship to the company's clients in HS codes the
    company does not sell them. With no company HS codes at all, every HS code
    counts (``empty_hs_gives_all``) or nothing does."""
    own = e if own is None else own
    hs = company_hs_codes(own, company)
    rows = (e.join(company_clients(own, company), "consignee_name", "left_semi")
             .filter(_not_company(company) & F.col("product_description").isNotNull())
             .join(hs, "hs_code", "left_anti"))
    if empty_hs_gives_all:
        # NOT IN (list) drops NULL codes, unless the list is empty (no filter).
        return rows.filter(F.col("hs_code").isNotNull() | ~hs.exists())
    return rows.filter(F.col("hs_code").isNotNull() & hs.exists())


def cross_sell(e: DataFrame, company: str, k: int | None = 100, own: DataFrame | None = None) -> DataFrame:
    """Per (client, hs, product, competitor, country, unit) shipments,
    fob and quantity; top k by fob."""
    out = cross_sell_rows(e, company, own=own).groupBy(*CROSS_SELL_KEYS).agg(
        M.shipments(), M.fob_total(), M.qty_total())
    out = out.select(
        F.col("consignee_name").alias("client_name"), "country_of_destination", "hs_code",
        "product_description", F.col("exporter_name").alias("competitor"),
        "shipment_count", "total_fob", "total_quantity", "unit")
    order = by_then_keys([desc("total_fob")], ["client_name", "hs_code", "product_description",
                                               "competitor", "country_of_destination", "unit"])
    out = out.orderBy(*order)
    return out.limit(k) if k is not None else out
