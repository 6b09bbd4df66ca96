"""Row predicates: month, entity, company and search-term matching.

Names are stored trimmed and upper-cased by ingest, so equality and LIKE run
on the raw column (no ``upper()`` wrapper). That keeps ``exporter_name = X``
a pushed Parquet filter and ``month_year = M`` a partition filter.

User terms keep LIKE's ``%`` and ``_`` wildcards, as the application does;
only a backslash is doubled, because it is Spark's LIKE escape character.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLE_COLUMNS = {
    "exporter": "exporter_name",
    "competitor": "exporter_name",
    "consignee": "consignee_name",
    "client": "consignee_name",
}


def role_column(role: str) -> str:
    """Column that names an entity of the given role."""
    try:
        return ROLE_COLUMNS[role]
    except KeyError:
        raise ValueError(f"unknown role {role!r}; expected one of {sorted(ROLE_COLUMNS)}")


def norm_name(name: str) -> str:
    """Names are compared trimmed and upper-case."""
    return name.strip().upper()


def like_pattern(term: str) -> str:
    """'%TERM%' for a LIKE, wildcards in the term kept, backslash escaped."""
    return "%" + term.upper().replace("\\", "\\\\") + "%"


def contains_term(col: str | Column, term: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.like(like_pattern(term))


def like_any(col: str | Column, terms: Iterable[str]) -> Column | None:
    """OR of ``col LIKE %t%`` over the terms; None when there are no terms."""
    preds = [contains_term(col, t) for t in terms]
    return reduce(lambda a, b: a | b, preds) if preds else None


def all_of(preds: Iterable[Column | None]) -> Column | None:
    """AND of the given predicates, skipping None; None when nothing is left."""
    ps = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, ps) if ps else None


def month_is(month: str | None) -> Column | None:
    """``month_year = month`` or no predicate when month is empty."""
    return (F.col("month_year") == F.lit(month)) if month else None


def months_in(*months: str) -> Column:
    return F.col("month_year").isin(list(months))


def entity_is(entity: str | None, role: str | None) -> Column | None:
    if not entity or not role:
        return None
    return F.col(role_column(role)) == F.lit(norm_name(entity))


def company_like(company: str, col: str = "exporter_name") -> Column:
    """Own company matched by ``LIKE %company%`` (the I*/B*/E1 match mode)."""
    return contains_term(col, company)


def not_placeholder_name(col: str) -> Column:
    """Consignee/exporter name that is non-NULL, non-blank and not 'NULL'."""
    c = F.col(col)
    return c.isNotNull() & (c != F.lit("")) & (F.upper(c) != F.lit("NULL"))


def apply_filter(df, pred: Column | None):
    return df if pred is None else df.filter(pred)
