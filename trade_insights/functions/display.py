"""Display columns (G23-G25): currency strings and placeholder names.

Pure column expressions, evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NAME_NOT_AVAILABLE, PLACEHOLDER_NAMES, USD_TO_INR


def _fixed(x: Column, decimals: int) -> Column:
    # toFixed(): round half away from zero on the decimal value, no grouping.
    return F.format_string(f"%.{decimals}f", F.round(x.cast("decimal(38,10)"), decimals).cast("double"))


def format_usd(value: Column) -> Column:
    """'$1.23M' (>= 1e6), '$4.5K' (>= 1e3), '$12.00'; zero or NULL -> '$0'."""
    v = value.cast("double")
    return (
        F.when(v.isNull() | (v == 0), F.lit("$0"))
        .when(v >= 1_000_000, F.concat(F.lit("$"), _fixed(v / 1_000_000, 2), F.lit("M")))
        .when(v >= 1_000, F.concat(F.lit("$"), _fixed(v / 1_000, 1), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), _fixed(v, 2)))
    )


def format_inr(value_usd: Column) -> Column:
    """INR string of a USD amount: Cr (>= 1e7), L (>= 1e5), K (>= 1e3)."""
    usd = value_usd.cast("double")
    inr = usd * float(USD_TO_INR)
    return (
        F.when(usd.isNull() | (usd == 0), F.lit("₹0"))
        .when(inr >= 10_000_000, F.concat(F.lit("₹"), _fixed(inr / 10_000_000, 2), F.lit(" Cr")))
        .when(inr >= 100_000, F.concat(F.lit("₹"), _fixed(inr / 100_000, 2), F.lit(" L")))
        .when(inr >= 1_000, F.concat(F.lit("₹"), _fixed(inr / 1_000, 1), F.lit("K")))
        .otherwise(F.concat(F.lit("₹"), _fixed(inr, 0)))
    )


def clean_name(name: Column) -> Column:
    """Placeholder or too-short names -> 'Name Not Available'."""
    u = F.upper(F.trim(name))
    return (
        F.when(name.isNull() | (name == F.lit("")), F.lit(NAME_NOT_AVAILABLE))
        .when(u.isin(PLACEHOLDER_NAMES) | (F.length(u) < 2), F.lit(NAME_NOT_AVAILABLE))
        .otherwise(name)
    )
