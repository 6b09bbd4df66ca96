"""DuckDB twins of the registered queries (the correctness gate).

Each statement inlines the fact-table view over the test tables as a CTE
and computes the same answer in plain SQL, the way the application's own
SQL does (IN lists, LIKE, LEFT JOIN ... IS NULL, scalar subqueries). Column
names, money types (exact decimal sums returned as DOUBLE), tie-breakers and
NULL ordering match the Spark side.
"""

from __future__ import annotations

from . import catalog as K
from .sources.fixture import RAW_HEADERS

VIEW = """
exports AS (
SELECT CAST(o.o_orderkey AS VARCHAR) AS declaration_id, UPPER(s.s_name) AS exporter_name,
  UPPER(cu.c_name) AS consignee_name, p.p_name AS product_description,
  CASE WHEN p.p_partkey % 2 = 0 THEN 'fruits' ELSE 'vegetables' END AS product_category,
  CASE WHEN p.p_partkey % 2 = 0 THEN 'fruits' ELSE 'vegetables' END AS data_type,
  p.p_brand || '-' || CAST(p.p_size AS VARCHAR) AS hs_code, CAST(l.l_quantity AS DOUBLE) AS quantity,
  'KGS' AS unit, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS fob_value, 'USD' AS fob_currency,
  sn.n_name AS port_of_loading, r.r_name || ' / ' || cu.c_mktsegment AS port_of_discharge,
  cn.n_name AS country_of_destination, CAST(l.l_shipdate AS DATE) AS shipment_date,
  strftime(CAST(l.l_shipdate AS DATE), '%Y-%m') AS month_year, 'fixture' AS upload_batch,
  CAST(NULL AS TIMESTAMP) AS created_at
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer cu ON o.o_custkey = cu.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey JOIN nation cn ON cu.c_nationkey = cn.n_nationkey
JOIN region r ON cn.n_regionkey = r.r_regionkey)"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(names) -> str:
    return ", ".join(q(n) for n in names)


def with_view(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([VIEW, *ctes]) + "\n" + body


COMP = inlist(K.COMPETITORS)
CLI = inlist(K.CLIENTS)
CO = q("%" + K.COMPANY + "%")
CUR, PREV = q(K.CUR), q(K.PREV)
EXP, CON = q(K.EXPORTER), q(K.CONSIGNEE)

FOB = "CAST(SUM(fob_value) AS DOUBLE)"
SHIP = "COUNT(DISTINCT declaration_id)"
INR = "CAST(ROUND(CAST(SUM(fob_value) AS DECIMAL(18,2)) * CAST(83.5 AS DECIMAL(3,1)), 2) AS DOUBLE)"
INR_LINE = "CAST(ROUND(CAST(fob_value AS DECIMAL(18,2)) * CAST(83.5 AS DECIMAL(3,1)), 2) AS DOUBLE)"


def cat(col: str) -> str:
    return f"string_agg(DISTINCT {col}, ',' ORDER BY {col})"


def pct(c: str, p: str) -> str:
    return (f"CASE WHEN {p} IS NOT NULL AND {p} <> 0 THEN "
            f"(CAST({c} AS DOUBLE) - CAST({p} AS DOUBLE)) / CAST({p} AS DOUBLE) * 100.0 END")


def order(*cols: str) -> str:
    return ", ".join(cols)


A = "ASC NULLS LAST"
D = "DESC NULLS LAST"

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- dashboard / breakdowns
SQL["months"] = with_view("SELECT DISTINCT month_year FROM exports WHERE month_year IS NOT NULL")

_DASH = (f"SELECT {SHIP} AS total_shipments, {FOB} AS total_fob, COUNT(DISTINCT exporter_name) AS unique_exporters, "
         "COUNT(DISTINCT consignee_name) AS unique_consignees, COUNT(DISTINCT country_of_destination) AS unique_countries, "
         "COUNT(DISTINCT product_description) AS unique_products FROM exports")
SQL["dashboard_summary"] = with_view(_DASH)
SQL["dashboard_summary_month"] = with_view(_DASH + f" WHERE month_year = {CUR}")
SQL["dashboard_by_category"] = with_view(
    f"SELECT data_type, {SHIP} AS shipment_count, {FOB} AS total_fob FROM exports GROUP BY data_type")


def _top(col: str, where: str, k: int) -> str:
    return with_view(f"SELECT {col}, {SHIP} AS shipment_count, {FOB} AS total_fob FROM exports {where} "
                     f"GROUP BY {col} ORDER BY total_fob {D}, {col} {A} LIMIT {k}")


SQL["dashboard_top_exporters"] = _top("exporter_name", f"WHERE month_year = {CUR}", 10)
SQL["dashboard_top_exporters_all"] = _top("exporter_name", "", 10)
SQL["dashboard_top_countries"] = _top("country_of_destination", f"WHERE month_year = {CUR}", 10)


def _products(where: str) -> str:
    return with_view(
        f"SELECT product_description, data_type, {SHIP} AS shipment_count, SUM(quantity) AS total_quantity, "
        f"{FOB} AS total_fob FROM exports {where} GROUP BY product_description, data_type "
        f"ORDER BY total_fob {D}, product_description {A}, data_type {A} LIMIT 50")


SQL["product_breakdown"] = _products("")
SQL["product_breakdown_entity"] = _products(f"WHERE UPPER(exporter_name) = {EXP} AND month_year = {CUR}")


def _countries(where: str) -> str:
    return with_view(f"SELECT country_of_destination, {SHIP} AS shipment_count, {FOB} AS total_fob FROM exports "
                     f"{where} GROUP BY country_of_destination")


SQL["country_breakdown"] = _countries("")
SQL["country_breakdown_entity"] = _countries(f"WHERE UPPER(consignee_name) = {CON}")


def _trends(extra: str) -> str:
    return with_view(f"SELECT month_year, {SHIP} AS shipment_count, {FOB} AS total_fob, "
                     f"COUNT(DISTINCT product_description) AS product_count FROM exports "
                     f"WHERE month_year IS NOT NULL {extra} GROUP BY month_year")


SQL["monthly_trends"] = _trends("")
SQL["monthly_trends_entity"] = _trends(f"AND UPPER(exporter_name) = {EXP}")

# ---------------------------------------------------------------- watchlist summaries


def _comp_summary(month: str | None) -> str:
    m = f"AND month_year = {month}" if month else ""
    return (f"SELECT exporter_name, {SHIP} AS shipment_count, {FOB} AS total_fob, "
            f"COUNT(DISTINCT product_description) AS product_count, "
            f"COUNT(DISTINCT country_of_destination) AS country_count, {cat('data_type')} AS categories, "
            f"MIN(shipment_date) AS first_shipment, MAX(shipment_date) AS last_shipment FROM exports "
            f"WHERE UPPER(exporter_name) IN ({COMP}) {m} GROUP BY exporter_name")


def _client_summary(month: str) -> str:
    return (f"SELECT consignee_name, {SHIP} AS shipment_count, {FOB} AS total_fob, "
            f"COUNT(DISTINCT product_description) AS product_count, "
            f"COUNT(DISTINCT exporter_name) AS supplier_count, {cat('data_type')} AS categories, "
            f"MIN(shipment_date) AS first_shipment, MAX(shipment_date) AS last_shipment FROM exports "
            f"WHERE UPPER(consignee_name) IN ({CLI}) AND month_year = {month} GROUP BY consignee_name")


def _baseline(col: str, names: str, month: str) -> str:
    return (f"SELECT {col}, {SHIP} AS shipment_count, {FOB} AS total_fob FROM exports "
            f"WHERE UPPER({col}) IN ({names}) AND month_year = {month} GROUP BY {col}")


SQL["competitor_summary"] = with_view(_comp_summary(CUR))
SQL["competitor_summary_all"] = with_view(_comp_summary(None))
SQL["competitor_baseline"] = with_view(_baseline("exporter_name", COMP, PREV))
SQL["client_summary"] = with_view(_client_summary(CUR))
SQL["client_baseline"] = with_view(_baseline("consignee_name", CLI, PREV))


def _trend(col: str, cur_sql: str, base_sql: str) -> str:
    return with_view(
        f"SELECT c.*, b.shipment_count AS prev_shipment_count, b.total_fob AS prev_total_fob, "
        f"{pct('c.total_fob', 'b.total_fob')} AS fob_change_pct FROM c LEFT JOIN b USING ({col})",
        f"c AS ({cur_sql})", f"b AS ({base_sql})")


SQL["competitor_trend"] = _trend("exporter_name", _comp_summary(CUR), _baseline("exporter_name", COMP, PREV))
SQL["client_trend"] = _trend("consignee_name", _client_summary(CUR), _baseline("consignee_name", CLI, PREV))


def _company_comparison(month: str | None) -> str:
    m = f"AND month_year = {month}" if month else ""
    names = inlist([K.COMPANY] + K.COMPETITORS)
    per = (f"SELECT exporter_name, data_type, {SHIP} AS s, SUM(fob_value) AS f, "
           f"COUNT(DISTINCT product_description) AS p, COUNT(DISTINCT country_of_destination) AS c, "
           f"COUNT(DISTINCT consignee_name) AS cl FROM exports WHERE UPPER(exporter_name) IN ({names}) {m} "
           f"GROUP BY exporter_name, data_type")
    return with_view(
        f"SELECT exporter_name, CAST(SUM(s) AS BIGINT) AS shipment_count, CAST(SUM(f) AS DOUBLE) AS total_fob, "
        f"CAST(SUM(p) AS BIGINT) AS product_count, CAST(SUM(c) AS BIGINT) AS country_count, "
        f"CAST(SUM(cl) AS BIGINT) AS client_count, "
        f"string_agg(data_type, ',' ORDER BY f DESC, data_type) AS categories, "
        f"exporter_name = {q(K.COMPANY)} AS is_company FROM per GROUP BY exporter_name",
        f"per AS ({per})")


SQL["company_comparison"] = _company_comparison(CUR)
SQL["company_comparison_all"] = _company_comparison(None)

# ---------------------------------------------------------------- entity detail
_ENT_X = f"UPPER(exporter_name) = {EXP}"
_ENT_C = f"UPPER(consignee_name) = {CON}"

SQL["entity_summary"] = with_view(
    f"SELECT {SHIP} AS total_shipments, {FOB} AS total_fob, SUM(quantity) AS total_quantity, "
    f"COUNT(DISTINCT product_description) AS unique_products, COUNT(DISTINCT country_of_destination) AS unique_countries, "
    f"COUNT(DISTINCT hs_code) AS unique_hs_codes, MIN(shipment_date) AS first_shipment, "
    f"MAX(shipment_date) AS last_shipment FROM exports WHERE {_ENT_X} AND month_year = {CUR}")
SQL["entity_summary_consignee"] = with_view(
    f"SELECT {SHIP} AS total_shipments, {FOB} AS total_fob, SUM(quantity) AS total_quantity, "
    f"COUNT(DISTINCT product_description) AS unique_products, COUNT(DISTINCT country_of_destination) AS unique_countries, "
    f"COUNT(DISTINCT hs_code) AS unique_hs_codes, MIN(shipment_date) AS first_shipment, "
    f"MAX(shipment_date) AS last_shipment FROM exports WHERE {_ENT_C}")
SQL["entity_products"] = with_view(
    f"SELECT product_description, hs_code, data_type, unit, {SHIP} AS shipment_count, "
    f"SUM(quantity) AS total_quantity, {FOB} AS total_fob, "
    f"CAST(SUM(fob_value) AS DOUBLE) / COUNT(fob_value) AS avg_fob_per_shipment FROM exports WHERE {_ENT_X} "
    f"GROUP BY product_description, hs_code, data_type, unit "
    f"ORDER BY total_fob {D}, product_description {A}, hs_code {A}, data_type {A}, unit {A} LIMIT 50")
SQL["entity_countries"] = with_view(
    f"SELECT country_of_destination, {SHIP} AS shipment_count, SUM(quantity) AS total_quantity, "
    f"{FOB} AS total_fob FROM exports WHERE {_ENT_X} GROUP BY country_of_destination")
SQL["entity_ports"] = with_view(
    f"SELECT port_of_loading AS indian_port, port_of_discharge AS foreign_port, {SHIP} AS shipment_count, "
    f"{FOB} AS total_fob FROM exports WHERE {_ENT_C} GROUP BY port_of_loading, port_of_discharge "
    f"ORDER BY shipment_count {D}, indian_port {A}, foreign_port {A} LIMIT 20")
SQL["entity_monthly_trend"] = with_view(
    f"SELECT month_year, {SHIP} AS shipment_count, SUM(quantity) AS total_quantity, {FOB} AS total_fob "
    f"FROM exports WHERE {_ENT_X} AND month_year IS NOT NULL GROUP BY month_year")
SQL["entity_suppliers"] = with_view(
    f"SELECT exporter_name, {SHIP} AS shipment_count, {FOB} AS total_fob, {cat('product_description')} AS products "
    f"FROM exports WHERE {_ENT_C} GROUP BY exporter_name ORDER BY total_fob {D}, exporter_name {A} LIMIT 20")
SQL["entity_clients"] = with_view(
    f"SELECT consignee_name, country_of_destination, {SHIP} AS shipment_count, {FOB} AS total_fob "
    f"FROM exports WHERE {_ENT_X} GROUP BY consignee_name, country_of_destination "
    f"ORDER BY total_fob {D}, consignee_name {A}, country_of_destination {A} LIMIT 20")
_RECENT = ["declaration_id", "shipment_date", "product_description", "quantity", "unit", "fob_value",
           "country_of_destination", "consignee_name", "exporter_name", "port_of_loading", "port_of_discharge"]
SQL["entity_recent_shipments"] = with_view(
    "SELECT " + ", ".join(("CAST(fob_value AS DOUBLE) AS fob_value" if c == "fob_value" else c) for c in _RECENT)
    + f" FROM exports WHERE {_ENT_X} ORDER BY shipment_date {D}, "
    + ", ".join(f"{c} {A}" for c in _RECENT if c != "shipment_date") + " LIMIT 50")
_PAGE = ["declaration_id", "exporter_name", "consignee_name", "product_description", "product_category",
         "data_type", "hs_code", "quantity", "unit", "fob_value", "fob_currency", "port_of_loading",
         "port_of_discharge", "country_of_destination", "shipment_date", "month_year", "upload_batch", "created_at"]
SQL["shipments_page"] = with_view(
    "SELECT " + ", ".join(("CAST(fob_value AS DOUBLE) AS fob_value" if c == "fob_value" else c) for c in _PAGE)
    + f" FROM exports WHERE {_ENT_X} ORDER BY shipment_date {D}, "
    + ", ".join(f"{c} {A}" for c in _PAGE if c != "shipment_date") + " LIMIT 50 OFFSET 50")
SQL["shipments_after"] = SQL["shipments_page"]
SQL["shipments_total"] = with_view(f"SELECT COUNT(*) AS total FROM exports WHERE {_ENT_X}")

# ---------------------------------------------------------------- intelligence
_HS = (f"hs AS (SELECT DISTINCT hs_code FROM exports WHERE UPPER(exporter_name) LIKE {CO} "
       f"AND hs_code IS NOT NULL AND hs_code <> '')")
_REAL = "consignee_name IS NOT NULL AND consignee_name <> '' AND UPPER(consignee_name) <> 'NULL'"
_CLIENTS = f"clients AS (SELECT DISTINCT consignee_name FROM exports WHERE UPPER(exporter_name) LIKE {CO} AND {_REAL})"
_CHS = (f"chs AS (SELECT DISTINCT hs_code FROM exports WHERE UPPER(exporter_name) LIKE {CO} "
        f"AND UPPER(consignee_name) IN (SELECT UPPER(consignee_name) FROM clients) "
        f"AND hs_code IS NOT NULL AND hs_code <> '')")

SQL["company_products"] = with_view(
    f"SELECT DISTINCT hs_code, product_description, data_type FROM exports WHERE UPPER(exporter_name) LIKE {CO}")
SQL["prospective_clients"] = with_view(
    f"SELECT consignee_name, country_of_destination, {SHIP} AS total_shipments, {FOB} AS total_fob, "
    f"SUM(quantity) AS total_quantity, {cat('hs_code')} AS hs_codes, {cat('product_description')} AS products, "
    f"{cat('exporter_name')} AS current_suppliers FROM exports WHERE hs_code IN (SELECT hs_code FROM hs) "
    f"AND UPPER(exporter_name) NOT LIKE {CO} AND {_REAL} GROUP BY consignee_name, country_of_destination "
    f"HAVING {SHIP} >= 2 ORDER BY total_fob {D}, consignee_name {A}, country_of_destination {A} LIMIT 100", _HS)
SQL["company_clients"] = with_view("SELECT consignee_name FROM clients", _CLIENTS)
SQL["company_hs_codes"] = with_view("SELECT hs_code FROM chs", _CLIENTS, _CHS)
SQL["cross_sell"] = with_view(
    f"SELECT consignee_name AS client_name, country_of_destination, hs_code, product_description, "
    f"exporter_name AS competitor, {SHIP} AS shipment_count, {FOB} AS total_fob, SUM(quantity) AS total_quantity, "
    f"unit FROM exports WHERE UPPER(consignee_name) IN (SELECT UPPER(consignee_name) FROM clients) "
    f"AND UPPER(exporter_name) NOT LIKE {CO} AND hs_code NOT IN (SELECT hs_code FROM chs) "
    f"AND product_description IS NOT NULL "
    f"GROUP BY consignee_name, hs_code, product_description, exporter_name, country_of_destination, unit "
    f"ORDER BY total_fob {D}, client_name {A}, hs_code {A}, product_description {A}, competitor {A}, "
    f"country_of_destination {A}, unit {A} LIMIT 100", _CLIENTS, _CHS)

# ---------------------------------------------------------------- month comparison
_CM = ["shipments", "total_fob", "total_qty", "products", "countries", "clients"]
_KM = ["shipments", "total_fob", "total_qty", "products", "suppliers"]


def _per_month(col: str, names: str, extra: str) -> str:
    return (f"m AS (SELECT {col} AS name, month_year, {SHIP} AS shipments, {FOB} AS total_fob, "
            f"SUM(quantity) AS total_qty, COUNT(DISTINCT product_description) AS products, {extra} FROM exports "
            f"WHERE UPPER({col}) IN ({names}) AND month_year IN ({CUR}, {PREV}) GROUP BY {col}, month_year)")


SQL["competitor_month_comparison"] = with_view(
    "SELECT COALESCE(c.name, p.name) AS name, "
    + ", ".join(f"c.{n} AS cur_{n}" for n in _CM) + ", " + ", ".join(f"p.{n} AS prev_{n}" for n in _CM)
    + f", CASE WHEN c.shipments IS NULL THEN -100.0 ELSE {pct('c.shipments', 'p.shipments')} END AS shipment_change_pct"
    + f", CASE WHEN c.shipments IS NULL THEN -100.0 ELSE {pct('c.total_fob', 'p.total_fob')} END AS fob_change_pct"
    + ", (c.shipments IS NOT NULL AND p.shipments IS NULL) AS is_new, (c.shipments IS NULL) AS is_dropped "
    + f"FROM (SELECT * FROM m WHERE month_year = {CUR}) c FULL OUTER JOIN (SELECT * FROM m WHERE month_year = {PREV}) p "
    + "ON c.name = p.name",
    _per_month("exporter_name", COMP,
               "COUNT(DISTINCT country_of_destination) AS countries, COUNT(DISTINCT consignee_name) AS clients"))
SQL["client_month_comparison"] = with_view(
    "SELECT c.name AS name, "
    + ", ".join(f"c.{n} AS cur_{n}" for n in _KM) + ", " + ", ".join(f"p.{n} AS prev_{n}" for n in _KM)
    + f", {pct('c.shipments', 'p.shipments')} AS shipment_change_pct"
    + f", {pct('c.total_fob', 'p.total_fob')} AS fob_change_pct, (p.shipments IS NULL) AS is_new "
    + f"FROM (SELECT * FROM m WHERE month_year = {CUR}) c LEFT JOIN (SELECT * FROM m WHERE month_year = {PREV}) p "
    + "ON c.name = p.name",
    _per_month("consignee_name", CLI, "COUNT(DISTINCT exporter_name) AS suppliers"))
SQL["new_suppliers_to_tracked_clients"] = with_view(
    f"SELECT consignee_name AS client, exporter_name AS new_supplier, {SHIP} AS shipments, {FOB} AS total_fob, "
    f"{cat('product_description')} AS products FROM cur WHERE NOT EXISTS (SELECT 1 FROM prevp "
    f"WHERE prevp.consignee_name IS NOT DISTINCT FROM cur.consignee_name "
    f"AND prevp.exporter_name IS NOT DISTINCT FROM cur.exporter_name) GROUP BY consignee_name, exporter_name "
    f"ORDER BY total_fob {D}, client {A}, new_supplier {A} LIMIT 50",
    f"cur AS (SELECT * FROM exports WHERE UPPER(consignee_name) IN ({CLI}) AND month_year = {CUR})",
    f"prevp AS (SELECT DISTINCT consignee_name, exporter_name FROM exports "
    f"WHERE UPPER(consignee_name) IN ({CLI}) AND month_year = {PREV})")


def _new_rel(select: str, require_names: bool, order_by: str, k: int) -> str:
    names = "AND curr.consignee_name IS NOT NULL AND curr.exporter_name IS NOT NULL" if require_names else ""
    return with_view(
        f"SELECT {select} FROM exports curr LEFT JOIN (SELECT DISTINCT consignee_name, exporter_name FROM exports "
        f"WHERE month_year = {PREV}) prev ON curr.consignee_name = prev.consignee_name "
        f"AND curr.exporter_name = prev.exporter_name WHERE curr.month_year = {CUR} AND prev.exporter_name IS NULL "
        f"{names} GROUP BY curr.consignee_name, curr.exporter_name ORDER BY {order_by} LIMIT {k}")


SQL["new_relationships"] = _new_rel(
    "curr.consignee_name AS client, curr.exporter_name AS new_supplier, "
    "COUNT(DISTINCT curr.declaration_id) AS shipments, CAST(SUM(curr.fob_value) AS DOUBLE) AS total_fob, "
    "string_agg(DISTINCT curr.product_description, ',' ORDER BY curr.product_description) AS products",
    True, f"total_fob {D}, client {A}, new_supplier {A}", 100)

_M5 = ["declaration_id", "shipment_date", "exporter_name", "consignee_name", "product_description", "hs_code",
       "quantity", "unit", "fob_value", "country_of_destination", "port_of_loading", "port_of_discharge"]
_PERIOD = f"CASE WHEN month_year = {CUR} THEN 'current' ELSE 'previous' END"
SQL["entity_month_rows"] = with_view(
    f"SELECT {_PERIOD} AS period, "
    + ", ".join(("CAST(fob_value AS DOUBLE) AS fob_value" if c == "fob_value" else c) for c in _M5)
    + f" FROM exports WHERE {_ENT_X} AND month_year IN ({CUR}, {PREV})")
SQL["entity_month_products"] = with_view(
    f"SELECT {_PERIOD} AS period, product_description, hs_code, SUM(quantity) AS qty, {FOB} AS fob "
    f"FROM exports WHERE {_ENT_X} AND month_year IN ({CUR}, {PREV}) GROUP BY 1, product_description, hs_code")
SQL["entity_month_countries"] = with_view(
    f"SELECT {_PERIOD} AS period, country_of_destination, {SHIP} AS shipments, {FOB} AS fob "
    f"FROM exports WHERE {_ENT_C} AND month_year IN ({CUR}, {PREV}) GROUP BY 1, country_of_destination")

# ---------------------------------------------------------------- benchmarking
_BM = (f"{SHIP} AS shipments, {FOB} AS total_fob, SUM(quantity) AS total_qty, "
       f"COUNT(DISTINCT product_description) AS products, COUNT(DISTINCT country_of_destination) AS countries, "
       f"COUNT(DISTINCT consignee_name) AS clients, CAST(SUM(fob_value) AS DOUBLE) / COUNT(fob_value) "
       f"AS avg_fob_per_shipment")
SQL["company_benchmark"] = with_view(f"SELECT {_BM} FROM exports WHERE UPPER(exporter_name) LIKE {CO}")
SQL["competitor_benchmark"] = with_view(
    f"SELECT exporter_name AS name, {_BM} FROM exports WHERE UPPER(exporter_name) IN ({COMP}) "
    f"AND month_year = {CUR} GROUP BY exporter_name")
SQL["market_totals"] = with_view(
    f"SELECT {SHIP} AS shipments, {FOB} AS total_fob, COUNT(DISTINCT exporter_name) AS exporters "
    f"FROM exports WHERE 1=1 AND month_year = {CUR}")
SQL["client_vendor_analysis"] = with_view(
    f"SELECT consignee_name AS client, exporter_name AS vendor, "
    f"CASE WHEN UPPER(exporter_name) LIKE {CO} THEN 1 ELSE 0 END AS is_your_company, {SHIP} AS shipments, "
    f"{FOB} AS total_fob, SUM(quantity) AS total_qty, COUNT(DISTINCT product_description) AS products "
    f"FROM exports WHERE UPPER(consignee_name) IN (SELECT UPPER(consignee_name) FROM cl) AND month_year = {CUR} "
    f"GROUP BY consignee_name, exporter_name",
    f"cl AS (SELECT DISTINCT consignee_name FROM exports WHERE UPPER(exporter_name) LIKE {CO} "
    f"AND month_year = {CUR} AND consignee_name IS NOT NULL AND consignee_name != '')")
SQL["market_share"] = with_view(
    "SELECT CAST(COALESCE(c, 0) AS DOUBLE) AS company_fob, CAST(m AS DOUBLE) AS market_fob, "
    "CASE WHEN CAST(m AS DOUBLE) > 0 THEN CAST(ROUND(CAST(CAST(COALESCE(c, 0) AS DOUBLE) / CAST(m AS DOUBLE) "
    "* 100.0 AS DECIMAL(20,8)), 2) AS DOUBLE) ELSE 0.0 END AS market_share_pct FROM s",
    f"s AS (SELECT SUM(CASE WHEN UPPER(exporter_name) LIKE {CO} THEN fob_value END) AS c, "
    f"SUM(fob_value) AS m FROM exports)")


def _rank(month: str | None) -> str:
    m = f"AND month_year = {month}" if month else ""
    return with_view(
        f"SELECT COUNT(*) + 1 AS company_rank FROM (SELECT exporter_name, SUM(fob_value) AS total_fob "
        f"FROM exports WHERE 1=1 {m} GROUP BY exporter_name HAVING SUM(fob_value) > "
        f"(SELECT COALESCE(SUM(fob_value), 0) FROM exports WHERE UPPER(exporter_name) LIKE {CO} {m}))")


SQL["company_rank"] = _rank(None)
SQL["company_rank_month"] = _rank(CUR)
SQL["market_position"] = with_view(
    f"SELECT {q(K.COMPANY)} AS name, COALESCE({FOB}, 0.0) AS fob, TRUE AS is_you FROM exports "
    f"WHERE UPPER(exporter_name) LIKE {CO} AND month_year = {CUR} "
    f"UNION ALL SELECT exporter_name AS name, {FOB} AS fob, FALSE AS is_you FROM exports "
    f"WHERE UPPER(exporter_name) IN ({COMP}) AND month_year = {CUR} GROUP BY exporter_name")

# ---------------------------------------------------------------- custom reports


def _terms(csv: str | None) -> list[str]:
    return [t.strip().upper() for t in (csv or "").split(",") if t.strip()]


def _custom_where(countries, exporters, consignees, month) -> str:
    conds = []
    for col, terms in (("country_of_destination", _terms(countries)), ("exporter_name", _terms(exporters)),
                       ("consignee_name", _terms(consignees))):
        if terms:
            conds.append("(" + " OR ".join(f"UPPER({col}) LIKE {q('%' + t + '%')}" for t in terms) + ")")
    w = " AND ".join(conds)
    return w + (f" AND month_year = {q(month)}" if month else "")


def _custom_group(countries, exporters) -> str:
    return ("country_of_destination" if _terms(countries) else
            "exporter_name" if _terms(exporters) else "consignee_name")


def _custom_summary(countries, exporters, consignees, month) -> str:
    g = _custom_group(countries, exporters)
    return with_view(
        f"SELECT {g} AS group_by, {SHIP} AS total_shipments, SUM(quantity) AS total_quantity, "
        f"COUNT(DISTINCT product_description) AS total_products, {FOB} AS total_value, "
        f"COUNT(DISTINCT exporter_name) AS exporters, COUNT(DISTINCT consignee_name) AS consignees "
        f"FROM exports WHERE {_custom_where(countries, exporters, consignees, month)} GROUP BY {g}")


SQL["custom_report_summary"] = _custom_summary(K.FILTER_COUNTRIES, K.FILTER_EXPORTERS, None, None)
SQL["custom_report_summary_exporters"] = _custom_summary(None, K.FILTER_EXPORTERS, None, K.CUR)
SQL["custom_report_summary_consignees"] = _custom_summary(None, None, K.FILTER_CONSIGNEES, None)

_DETAILS = (
    'SELECT declaration_id AS "Declaration ID", shipment_date AS "Shipment Date", exporter_name AS "Exporter", '
    'consignee_name AS "Consignee", product_description AS "Product", hs_code AS "HS Code", quantity AS "Quantity", '
    'unit AS "Unit", CAST(fob_value AS DOUBLE) AS "FOB Value (USD)", ' + INR_LINE + ' AS "FOB Value (INR)", '
    'country_of_destination AS "Country", port_of_loading AS "Port of Loading", '
    'port_of_discharge AS "Port of Discharge", data_type AS "Category" FROM exports WHERE ')
SQL["custom_report_details"] = with_view(
    _DETAILS + _custom_where(K.FILTER_COUNTRIES, K.FILTER_EXPORTERS, None, K.CUR))

# ---------------------------------------------------------------- name search


def _search(col: str, qstr: str, names: str, extra: str) -> str:
    words = [w for w in qstr.strip().upper().split() if len(w) > 1]
    like = (" AND (" + " OR ".join(f"UPPER({col}) LIKE {q('%' + w + '%')}" for w in words) + ")") if words else ""
    return with_view(
        f"SELECT t.*, t.name IN ({names}) AS already_tracked FROM (SELECT {col} AS name, COUNT(*) AS shipment_count, "
        f"{FOB} AS total_fob{extra} FROM exports WHERE {col} IS NOT NULL AND {col} != ''{like} GROUP BY {col} "
        f"ORDER BY shipment_count {D}, name {A} LIMIT 20) t")


SQL["search_exporters"] = _search("exporter_name", K.SEARCH_EXPORTER_Q, COMP, "")
SQL["search_consignees"] = _search("consignee_name", K.SEARCH_CONSIGNEE_Q, CLI,
                                   f", {cat('country_of_destination')} AS countries")

# ---------------------------------------------------------------- report datasets
_ALL = [K.COMPANY] + K.COMPETITORS
_LIKE_ALL = " OR ".join(f"UPPER(exporter_name) LIKE {q('%' + n + '%')}" for n in _ALL)
_TYPE = f"CASE WHEN UPPER(exporter_name) LIKE {CO} THEN 'Your Company' ELSE 'Competitor' END"

SQL["export_benchmarking_companies"] = with_view(
    f'SELECT exporter_name AS "Company", {_TYPE} AS "Type", {SHIP} AS "Shipments", {FOB} AS "Total FOB (USD)", '
    f'{INR} AS "Total FOB (INR)", SUM(quantity) AS "Total Quantity", COUNT(DISTINCT product_description) AS "Products", '
    f'COUNT(DISTINCT country_of_destination) AS "Countries", COUNT(DISTINCT consignee_name) AS "Clients" '
    f'FROM exports WHERE ({_LIKE_ALL}) AND month_year = {CUR} GROUP BY exporter_name')
SQL["export_benchmarking_vendors"] = with_view(
    f'SELECT consignee_name AS "Client", exporter_name AS "Vendor", {_TYPE} AS "Type", {SHIP} AS "Shipments", '
    f'{FOB} AS "FOB (USD)", {INR} AS "FOB (INR)", SUM(quantity) AS "Quantity" FROM exports '
    f'WHERE UPPER(consignee_name) IN (SELECT UPPER(consignee_name) FROM cl) AND month_year = {CUR} '
    f'GROUP BY consignee_name, exporter_name',
    f"cl AS (SELECT DISTINCT consignee_name FROM exports WHERE UPPER(exporter_name) LIKE {CO} "
    f"AND month_year = {CUR} AND consignee_name IS NOT NULL AND consignee_name != '')")
SQL["export_monthly_comparison_competitors"] = with_view(
    f'SELECT exporter_name AS "Competitor", month_year AS "Month", {SHIP} AS "Shipments", {FOB} AS "FOB (USD)", '
    f'{INR} AS "FOB (INR)", SUM(quantity) AS "Quantity", COUNT(DISTINCT product_description) AS "Products" '
    f'FROM exports WHERE UPPER(exporter_name) IN ({COMP}) AND month_year IN ({CUR}, {PREV}) '
    f'GROUP BY exporter_name, month_year')
SQL["export_monthly_comparison_clients"] = with_view(
    f'SELECT consignee_name AS "Client", month_year AS "Month", {SHIP} AS "Shipments", {FOB} AS "FOB (USD)", '
    f'{INR} AS "FOB (INR)", SUM(quantity) AS "Quantity", COUNT(DISTINCT exporter_name) AS "Suppliers" '
    f'FROM exports WHERE UPPER(consignee_name) IN ({CLI}) AND month_year IN ({CUR}, {PREV}) '
    f'GROUP BY consignee_name, month_year')
SQL["export_monthly_comparison_new_relationships"] = _new_rel(
    'curr.consignee_name AS "Client", curr.exporter_name AS "New Supplier", '
    'COUNT(DISTINCT curr.declaration_id) AS "Shipments", CAST(SUM(curr.fob_value) AS DOUBLE) AS "FOB (USD)", '
    'CAST(ROUND(CAST(SUM(curr.fob_value) AS DECIMAL(18,2)) * CAST(83.5 AS DECIMAL(3,1)), 2) AS DOUBLE) AS "FOB (INR)"',
    False, f'"FOB (USD)" {D}, "Client" {A}, "New Supplier" {A}', 100)
_CW = _custom_where(K.FILTER_COUNTRIES, K.FILTER_EXPORTERS, None, None)
SQL["export_custom_report_summary"] = with_view(
    f'SELECT {_custom_group(K.FILTER_COUNTRIES, K.FILTER_EXPORTERS)} AS "Entity", {SHIP} AS "Total Shipments", '
    f'ROUND(SUM(quantity), 2) AS "Total Quantity", COUNT(DISTINCT product_description) AS "Total Products", '
    f'CAST(ROUND(SUM(fob_value), 2) AS DOUBLE) AS "Total Value (USD)", {INR} AS "Total Value (INR)" '
    f'FROM exports WHERE {_CW} GROUP BY 1')
SQL["export_custom_report_details"] = with_view(_DETAILS + _CW)
SQL["export_prospective_clients_prospects"] = with_view(
    f'SELECT consignee_name AS "Consignee Name", country_of_destination AS "Country", {SHIP} AS "Total Shipments", '
    f'{FOB} AS "Total FOB (USD)", {INR} AS "Total FOB (INR)", SUM(quantity) AS "Total Quantity", '
    f'{cat("hs_code")} AS "HS Codes", {cat("product_description")} AS "Products", '
    f'{cat("exporter_name")} AS "Current Suppliers" FROM exports WHERE hs_code IN (SELECT hs_code FROM hs) '
    f'AND UPPER(exporter_name) NOT LIKE {CO} AND {_REAL} GROUP BY consignee_name, country_of_destination '
    f'HAVING {SHIP} >= 2', _HS)
SQL["export_prospective_clients_products"] = with_view(
    f'SELECT consignee_name AS "Consignee", product_description AS "Product", hs_code AS "HS Code", '
    f'{SHIP} AS "Shipments", {FOB} AS "FOB (USD)", {INR} AS "FOB (INR)", SUM(quantity) AS "Quantity", '
    f'unit AS "Unit", exporter_name AS "Current Supplier" FROM exports WHERE hs_code IN (SELECT hs_code FROM hs) '
    f"AND UPPER(exporter_name) NOT LIKE {CO} AND consignee_name IS NOT NULL AND consignee_name != '' "
    f'GROUP BY consignee_name, product_description, hs_code, exporter_name, unit', _HS)
SQL["export_prospective_clients_own_products"] = with_view(
    f'SELECT DISTINCT hs_code AS "HS Code", product_description AS "Product", data_type AS "Category" '
    f'FROM exports WHERE UPPER(exporter_name) LIKE {CO}')
SQL["export_cross_sell_opportunities"] = with_view(
    f'SELECT consignee_name AS "Your Client", country_of_destination AS "Country", hs_code AS "HS Code", '
    f'product_description AS "Product", exporter_name AS "Competitor", {SHIP} AS "Shipments", '
    f'{FOB} AS "Total FOB (USD)", {INR} AS "Total FOB (INR)", SUM(quantity) AS "Total Quantity", unit AS "Unit" '
    f'FROM exports WHERE UPPER(consignee_name) IN (SELECT UPPER(consignee_name) FROM clients) '
    f'AND UPPER(exporter_name) NOT LIKE {CO} AND hs_code NOT IN (SELECT hs_code FROM chs) '
    f'AND product_description IS NOT NULL AND EXISTS (SELECT 1 FROM chs) '
    f'GROUP BY consignee_name, hs_code, product_description, exporter_name, country_of_destination, unit',
    _CLIENTS, _CHS)
SQL["export_cross_sell_clients"] = with_view('SELECT consignee_name AS "Client Name" FROM clients', _CLIENTS)
SQL["export_entity_details_summary"] = with_view(
    f'SELECT {q(K.CONSIGNEE)} AS "Entity", \'Client\' AS "Type", {SHIP} AS "Total Shipments", '
    f'COALESCE({FOB}, 0.0) AS "Total FOB (USD)", COALESCE({INR}, 0.0) AS "Total FOB (INR)", '
    f'COALESCE(SUM(quantity), 0.0) AS "Total Quantity", COUNT(DISTINCT product_description) AS "Unique Products", '
    f'COUNT(DISTINCT country_of_destination) AS "Unique Countries", '
    f'COALESCE(strftime(MIN(shipment_date), \'%Y-%m-%d\'), \'N/A\') AS "First Shipment", '
    f'COALESCE(strftime(MAX(shipment_date), \'%Y-%m-%d\'), \'N/A\') AS "Last Shipment" FROM exports WHERE {_ENT_C}')
SQL["export_entity_details_products"] = with_view(
    f'SELECT product_description AS "Product", hs_code AS "HS Code", data_type AS "Category", {SHIP} AS "Shipments", '
    f'SUM(quantity) AS "Quantity", unit AS "Unit", {FOB} AS "FOB (USD)", {INR} AS "FOB (INR)" FROM exports '
    f'WHERE {_ENT_C} GROUP BY product_description, hs_code, data_type, unit')
SQL["export_entity_details_countries"] = with_view(
    f'SELECT country_of_destination AS "Country", {SHIP} AS "Shipments", SUM(quantity) AS "Quantity", '
    f'{FOB} AS "FOB (USD)", {INR} AS "FOB (INR)" FROM exports WHERE {_ENT_C} GROUP BY country_of_destination')
SQL["export_entity_details_shipments"] = with_view(
    'SELECT declaration_id AS "Declaration ID", shipment_date AS "Date", exporter_name AS "Exporter", '
    'consignee_name AS "Consignee", product_description AS "Product", hs_code AS "HS Code", quantity AS "Quantity", '
    'unit AS "Unit", CAST(fob_value AS DOUBLE) AS "FOB (USD)", ' + INR_LINE + ' AS "FOB (INR)", '
    'country_of_destination AS "Country", port_of_loading AS "Port of Loading", '
    f'port_of_discharge AS "Port of Discharge" FROM exports WHERE {_ENT_C}')
_TAIL = ('product_description AS "Product", data_type AS "Category", quantity AS "Quantity", unit AS "Unit", '
         'CAST(fob_value AS DOUBLE) AS "FOB Value", fob_currency AS "Currency"')
SQL["export_competitor_rows"] = with_view(
    f'SELECT exporter_name AS "Exporter", declaration_id AS "Declaration ID", consignee_name AS "Consignee", {_TAIL}, '
    f'port_of_loading AS "Port of Loading", port_of_discharge AS "Port of Discharge", '
    f'country_of_destination AS "Country", shipment_date AS "Shipment Date" FROM exports '
    f'WHERE UPPER(exporter_name) IN ({COMP}) AND month_year = {CUR}')
SQL["export_client_rows"] = with_view(
    f'SELECT consignee_name AS "Client/Consignee", exporter_name AS "Supplier", declaration_id AS "Declaration ID", '
    f'{_TAIL}, port_of_loading AS "Port of Loading", port_of_discharge AS "Port of Discharge", '
    f'country_of_destination AS "Country", shipment_date AS "Shipment Date" FROM exports '
    f'WHERE UPPER(consignee_name) IN ({CLI})')
SQL["export_company_comparison_rows"] = with_view(
    f'SELECT exporter_name AS "Company", CASE WHEN UPPER(exporter_name) = {q(K.COMPANY)} THEN \'Your Company\' '
    f'ELSE \'Competitor\' END AS "Type", declaration_id AS "Declaration ID", consignee_name AS "Client", {_TAIL}, '
    f'country_of_destination AS "Country", shipment_date AS "Shipment Date" FROM exports '
    f'WHERE UPPER(exporter_name) IN ({inlist(_ALL)}) AND month_year = {CUR}')
SQL["export_summary"] = with_view(
    f'SELECT exporter_name AS "Exporter", {SHIP} AS "Shipments", {FOB} AS "Total FOB", '
    f'COUNT(DISTINCT product_description) AS "Products", COUNT(DISTINCT country_of_destination) AS "Countries", '
    f'COUNT(DISTINCT consignee_name) AS "Clients", {cat("data_type")} AS "Categories" FROM exports '
    f'GROUP BY exporter_name')

# ---------------------------------------------------------------- ingest
_STORED = [c for c in _PAGE if c != "created_at"]


def _stored(category: str | None, batch: str) -> str:
    cols = []
    for c in _STORED:
        if c == "fob_value":
            cols.append("CAST(fob_value AS DOUBLE) AS fob_value")
        elif c in ("data_type", "product_category") and category:
            cols.append(f"{q(category)} AS {c}")
        elif c == "upload_batch":
            cols.append(f"{q(batch)} AS upload_batch")
        else:
            cols.append(c)
    return "SELECT " + ", ".join(cols) + " FROM exports"


# The import files (sources/fixture.py): what a line becomes once it is read.
_NO_ID, _UNDATED = "CAST(declaration_id AS BIGINT) % 89 = 0", "CAST(declaration_id AS BIGINT) % 97 = 0"
# A generated id starts with the first 15 bytes of the exporter's cell.
_CELL = "CASE WHEN CAST(quantity AS BIGINT) % 2 = 0 THEN exporter_name ELSE '  ' || lower(exporter_name) || ' ' || chr(9) END"
_AUTO = f"'AUTO-' || to_base64(encode(substr({_CELL}, 1, 15)))"


def _ingested(category: str, batch: str | None) -> str:
    """Accepted rows: each line once, but lines that are never duplicates (no
    date, or a generated id) a second time from the second upload."""
    cells = {"declaration_id": f"CASE WHEN {_NO_ID} THEN {_AUTO} ELSE declaration_id END",
             "fob_value": "CAST(fob_value AS DOUBLE)", "data_type": q(category), "product_category": q(category),
             "shipment_date": f"CASE WHEN NOT ({_UNDATED}) THEN shipment_date END",
             "month_year": f"CASE WHEN NOT ({_UNDATED}) THEN month_year END"}
    if batch:
        cells["upload_batch"] = q(batch)
    names = [c for c in _STORED if batch or c != "upload_batch"]
    one = "SELECT " + ", ".join(f"{cells.get(c, c)} AS {c}" for c in names) + " FROM exports"
    two = "SELECT " + ", ".join(f"{q('SECOND PORT') if c == 'port_of_loading' else cells.get(c, c)} AS {c}" for c in names) + " FROM exports"
    return f"{one} UNION ALL {two} WHERE quantity < 5 AND ({_NO_ID} OR {_UNDATED})"


SQL["ingest_accepted"] = with_view(_ingested("fruits", "b1"))
SQL["incremental_ingest"] = with_view(_ingested("fruits", None))
SQL["dedup_exports"] = with_view(_stored(None, "fixture"))
SQL["import_report"] = with_view(
    "SELECT 'b2' AS upload_batch, n + again + junk AS rows_processed, n + twice AS inserted, "
    "again + junk - twice AS skipped, junk AS no_id_count, undated AS undated_count, "
    f"CAST(0 AS BIGINT) AS fob_overflow_count, 'vegetables' AS data_type, {q(','.join(RAW_HEADERS))} AS columns_found FROM (SELECT COUNT(*) AS n, "
    "COUNT(*) FILTER (WHERE quantity < 5) AS again, COUNT(*) FILTER (WHERE quantity > 45) AS junk, "
    f"COUNT(*) FILTER (WHERE quantity < 5 AND ({_NO_ID} OR {_UNDATED})) AS twice, "
    f"COUNT(*) FILTER (WHERE {_UNDATED}) + COUNT(*) FILTER (WHERE quantity < 5 AND {_UNDATED}) AS undated FROM exports)")

# ---------------------------------------------------------------- watchlists (W1, W2), report read back
_TRACKED = "SELECT upper(s_name) AS name, s_suppkey % 9 <> 0 AS active FROM supplier WHERE s_suppkey % 3 = 0"
SQL["active_watchlist"] = f"SELECT name FROM ({_TRACKED}) WHERE active"
_ADDS = "SELECT s_suppkey AS seq, ' ' || chr(9) || lower(s_name) AS given, upper(s_name) AS name FROM supplier WHERE s_suppkey % 2 = 0"
_REMOVED = "SELECT upper(s_name) FROM supplier WHERE s_suppkey % 5 = 0"
_FRESH = f"SELECT name, seq FROM ({_ADDS}) WHERE name NOT IN (SELECT name FROM ({_TRACKED}))"
SQL["watchlist_after_changes"] = (f"SELECT name, active AND name NOT IN ({_REMOVED}) AS active FROM ({_TRACKED}) "
                                  f"UNION ALL SELECT name, TRUE AS active FROM ({_FRESH})")
SQL["watchlist_added"] = f"SELECT name FROM ({_FRESH})"
SQL["watchlist_errors"] = f"SELECT given AS name, 'Already exists' AS error FROM ({_ADDS}) WHERE seq NOT IN (SELECT seq FROM ({_FRESH}))"
SQL["written_report"] = SQL["export_benchmarking_companies"]
for _name, _written in (("Total FOB (USD)", "Total_FOB_USD"), ("Total FOB (INR)", "Total_FOB_INR"), ("Total Quantity", "Total_Quantity")):
    SQL["written_report"] = SQL["written_report"].replace(f'"{_name}"', f'"{_written}"')
_ACTIVE = f"SELECT name FROM ({_TRACKED}) WHERE active"
SQL["competitor_summary_table"] = SQL["competitor_summary"].replace(inlist(K.COMPETITORS), _ACTIVE)
SQL["export_benchmarking_companies_table"] = SQL["export_benchmarking_companies"].replace(
    f"({_LIKE_ALL})", f"(UPPER(exporter_name) LIKE {CO} OR EXISTS (SELECT 1 FROM ({_ACTIVE}) w WHERE UPPER(exporter_name) LIKE '%' || w.name || '%'))")
SQL["company_comparison_table"] = SQL["company_comparison"].replace(inlist([K.COMPANY, *K.COMPETITORS]), f"{_ACTIVE} UNION SELECT {q(K.COMPANY)}")


# ---------------------------------------------------------------- display columns
def _fixed(x: str, d: int) -> str:
    return f"printf('%.{d}f', CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {d}) AS DOUBLE))"


def _usd_text(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR {v} = 0 THEN '$0' "
            f"WHEN {v} >= 1000000 THEN '$' || {_fixed(v + ' / 1000000', 2)} || 'M' "
            f"WHEN {v} >= 1000 THEN '$' || {_fixed(v + ' / 1000', 1)} || 'K' "
            f"ELSE '$' || {_fixed(v, 2)} END")


def _inr_text(v: str) -> str:
    i = f"({v} * 83.5)"
    return (f"CASE WHEN {v} IS NULL OR {v} = 0 THEN '₹0' "
            f"WHEN {i} >= 10000000 THEN '₹' || {_fixed(i + ' / 10000000', 2)} || ' Cr' "
            f"WHEN {i} >= 100000 THEN '₹' || {_fixed(i + ' / 100000', 2)} || ' L' "
            f"WHEN {i} >= 1000 THEN '₹' || {_fixed(i + ' / 1000', 1)} || 'K' "
            f"ELSE '₹' || {_fixed(i, 0)} END")


_PLACEHOLDERS = inlist(["TO ORDER", "TO THE ORDER", "NULL", "N/A", "NA", "NONE", "-", "--", "NIL", "NOT AVAILABLE"])
SQL["dashboard_top_exporters_display"] = with_view(
    "SELECT t.*, CASE WHEN exporter_name IS NULL OR exporter_name = '' THEN 'Name Not Available' "
    f"WHEN UPPER(TRIM(exporter_name)) IN ({_PLACEHOLDERS}) OR LENGTH(UPPER(TRIM(exporter_name))) < 2 "
    "THEN 'Name Not Available' ELSE exporter_name END AS display_name, "
    f"{_usd_text('total_fob')} AS total_fob_usd_text, {_inr_text('total_fob')} AS total_fob_inr_text "
    f"FROM (SELECT exporter_name, {SHIP} AS shipment_count, {FOB} AS total_fob FROM exports "
    f"GROUP BY exporter_name ORDER BY total_fob {D}, exporter_name {A} LIMIT 10) t")
