"""Names that hold any of many other names: LIKE '%pattern%' for a table of
patterns, without trying each pattern on each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the runs of letters that bring names and patterns together. Names
#: of one form, such as numbered ones, share nearly all of their short runs.
GRAMS = (16, 8, 3, 2, 1)


def _runs(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` letters of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1)))
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _pattern_runs(pattern: Column) -> Column:
    """Runs that every match of a pattern has: the longest that the parts
    between its wildcards give, of the lengths ``GRAMS``; the empty one if there
    are wildcards only."""
    parts = F.split(pattern, "[%_]")
    # a lambda of two arguments would get each part's place as its second
    of_length = lambda n: F.array_distinct(F.flatten(F.transform(parts, lambda p: _runs(p, n))))
    of = [of_length(n) for n in GRAMS]
    out = F.array(F.lit(""))
    for runs in reversed(of):
        out = F.when(F.size(runs) > 0, runs).otherwise(out)
    return out


def matching_names(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """The distinct ``name`` of ``names`` that hold, in upper case, a ``name``
    of ``patterns`` (``%`` and ``_`` as in LIKE).

    A pattern meets the names by its rarest run of letters only, which is
    counted over the names; a pattern with a run that no name has meets none.
    What so meets is verified by LIKE.
    """
    upper = names.filter("name is not null").select("name", F.upper("name").alias("__upper")).distinct()
    runs = F.concat(F.array(F.lit("")), *(_runs(F.col("__upper"), n) for n in GRAMS))
    have = upper.select("name", "__upper", F.explode(runs).alias("run"))
    often = have.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    wanted = patterns.filter("name is not null").select(F.upper("name").alias("pattern")).distinct()
    wanted = wanted.withColumn("__runs", _pattern_runs(F.col("pattern")))
    wanted = wanted.select("pattern", F.size("__runs").alias("all"), F.explode("__runs").alias("run")).join(often, "run")
    rarest = wanted.groupBy("pattern", "all").agg(F.count(F.lit(1)).alias("there"), F.min(F.struct("n", "run")).alias("rare"))
    rarest = rarest.filter(F.col("there") == F.col("all")).select("pattern", F.col("rare.run").alias("run"))
    like = F.like(F.col("__upper"), F.concat(F.lit("%"), F.replace(F.col("pattern"), F.lit("\\"), F.lit("\\\\")), F.lit("%")))
    return have.join(rarest, "run").filter(like).select("name").distinct()
