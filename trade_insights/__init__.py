"""trade_insights — customs shipment analytics as PySpark DataFrame plans.

Layout
------
``schema``      canonical fact-table schema and the fixed value lists.
``session``     session / checkpoint-folder helpers.
``functions``   Column expressions: metric pack, matching, parsing, display.
``sources``     raw import reader, fact-table store, report sink, test fixture.
``operators``   ingest cleaning + dedup, watchlists, reports, comparisons,
                intelligence, benchmarking, custom reports.
``plans``       multi-block report sets (one DataFrame per sheet).
``streaming``   incremental file ingest on Structured Streaming.

Every operator takes DataFrames and plain parameters and returns a lazy
DataFrame (or a ``dict[str, DataFrame]`` for multi-block reports); nothing is
collected to the driver.
"""

__all__ = ["schema", "session"]
