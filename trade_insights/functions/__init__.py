"""Column expressions: metric pack, matching, parsing, display formats."""

from . import display, match, metrics, parse

__all__ = ["display", "match", "metrics", "parse"]
