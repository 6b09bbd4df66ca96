"""Sources and sinks: raw imports, the stored fact table, report datasets."""

from .fixture import exports_from_tpch
from .raw import read_raw
from .sink import write_report
from .store import Store, compact, fixture_exports, fixture_store, read_exports, table_store, write_exports

__all__ = ["Store", "compact", "exports_from_tpch", "fixture_exports", "fixture_store",
           "read_exports", "read_raw", "table_store", "write_exports", "write_report"]
