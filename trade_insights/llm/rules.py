"""Operator 7: quality rules with robust multivariate outliers.

Counts of each whole text become a short vector of transformed shares. For
each language and source the minimum-covariance-determinant estimate is made
from the texts that pass the base rules: starting at medians and median
absolute deviations, concentration steps take the three quarters of the texts
nearest to the centre and compute centre and covariance anew. A text whose
squared Mahalanobis distance, weighted down for short texts, lies beyond the
cut is rejected.

Only DataFrame functions are used. What the steps gather are mergeable
aggregates for each group, so a hot source costs no more than its share, and
the estimates join the texts as a table with a row for each group.

Null and empty texts have no words and fail the base rules. Null languages and
sources form groups of their own. Groups with fewer than ``MIN_GROUP`` passing
texts are judged together; if even these are too few, they are kept. Repeated
rows count as often as they occur. Columns other than doc_id, text, lang and
source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

WINDOW = 5
MIN_WORDS, MOST_REPEATED_PCT = 10, 20
MIN_GROUP = 40
#: Share of a group's texts that a concentration step goes on with.
CORE = 0.75
STEPS = 4
#: Quantiles of the chi-square distribution with five degrees of freedom.
CHI2_MEDIAN, CHI2_CUT = 4.351, 36.0
#: Words that count as half the evidence in the distance of a short text.
HALF_EVIDENCE = 15
#: Least standard deviations: of the log of the mean word length, and of the
#: square roots of shares.
FLOORS = (0.05, 0.04, 0.15, 0.15, 0.06)
P = len(FLOORS)
ACCURACY = 1000


def _repeated(windows: Column) -> Column:
    """Number of words covered by 5-word windows found twice or more, given
    the hashes of a text's windows in order."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    # ``same[j]``: entry j of the sorted pairs has the hash of entry j - 1
    same = F.concat(F.array(F.lit(False)), F.zip_with(F.slice(pairs, 1, n - 1), F.slice(pairs, 2, n - 1), lambda a, b: a["h"] == b["h"]), F.array(F.lit(False)))
    found = F.zip_with(F.zip_with(pairs, F.slice(same, 1, n), lambda p, s: F.struct(p["i"].alias("i"), s.alias("s"))), F.slice(same, 2, n), lambda a, s: F.when(a["s"] | s, a["i"]))
    at = F.sort_array(F.filter(found, lambda x: x.isNotNull()))
    return F.aggregate(at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
                       lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("sum")),
                       lambda acc: acc["sum"])


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                      F.inline(F.array(F.struct(
                          text.alias("text"), words(text).alias("w"), lines.alias("lines"),
                          F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars")))))
    at = lambda i, k: F.get(F.col("w"), i + k)
    windows = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    # a generator's output is computed once, however often it is used below
    cut = cut.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars",
                     (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                     (F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
                     F.size("lines").cast("long").alias("n_lines"),
                     (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                     F.inline(F.array(F.struct(windows.alias("windows")))))
    return cut.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_repeated(F.col("windows")))).drop("windows")


def vectors(counted: DataFrame) -> DataFrame:
    """Add base_failed and the transformed statistics x0..x4 (null where the
    base rules fail)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PCT * F.col("n_words"))
    chars, n = F.col("word_chars").cast("double"), F.col("n_words").cast("double")
    xs = (F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.col("n_lines")), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_capitals") / chars))
    out = counted.withColumn("base_failed", failed)
    return out.withColumns({f"x{i}": F.when(~failed, x) for i, x in enumerate(xs)})


def _distance() -> Column:
    """Squared distance of x from the centre m under the group's estimate:
    forward substitution with the Cholesky factor l."""
    y: list[Column] = []
    for i in range(P):
        v = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * y[j]
        y.append(v / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for v in y:
        total = total + v * v
    return total


def _factored(params: DataFrame) -> DataFrame:
    """Cholesky factor of the covariances c, whose diagonals get the floors."""
    for i in range(P):
        for j in range(i + 1):
            v = F.col(f"c{j}{i}")
            if i == j:
                v = v + FLOORS[i] ** 2
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            v = F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l{j}{j}")
            params = params.withColumn(f"l{i}{j}", v)
    return params


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """group, centre m, factor l and scale of each group of rows x0..x4."""
    names = [f"x{i}" for i in range(P)]
    medians = stored(rows.groupBy("group").agg(*(F.percentile_approx(x, 0.5, ACCURACY).alias(f"m{i}") for i, x in enumerate(names))), "mcd-medians")
    spread = [F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, ACCURACY) for i, x in enumerate(names)]
    start = rows.join(medians, "group").groupBy("group").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *((1.4826 * s).alias(f"s{i}") for i, s in enumerate(spread)))
    start = start.select("group", *(f"m{i}" for i in range(P)), *((F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{j}{i}") for i in range(P) for j in range(i + 1)))
    params = stored(_factored(start), "mcd-start")
    near = lambda x: F.when(F.col("d") <= F.col("radius"), F.col(x))
    for step in range(steps):
        placed = rows.join(params, "group").select("group", *names, _distance().alias("d"))
        radius = stored(placed.groupBy("group").agg(F.percentile_approx("d", CORE, ACCURACY).alias("radius")), f"mcd-radius{step}")
        moments = placed.join(radius, "group").groupBy("group").agg(
            *(F.avg(near(x)).alias(f"m{i}") for i, x in enumerate(names)),
            *(F.covar_pop(near(names[j]), near(names[i])).alias(f"c{j}{i}") for i in range(P) for j in range(i + 1)))
        params = stored(_factored(moments), f"mcd-step{step}")
    scale = rows.join(params, "group").select("group", _distance().alias("d")).groupBy("group").agg((F.percentile_approx("d", 0.5, ACCURACY) / CHI2_MEDIAN).alias("scale"))
    return stored(params.join(scale, "group"), "mcd")


def judged(docs: DataFrame, cut: float = CHI2_CUT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and distance (null where the base rules fail or the
    group is too small) of each document."""
    own = F.struct(F.col("lang"), F.col("source"))
    rows = stored(vectors(counts(docs)).withColumn("own", F.xxhash64(F.to_json(own, {"ignoreNullFields": "false"}))), "rules-vectors")
    sizes = rows.where("not base_failed").groupBy("own").agg(F.count("*").alias("n_group"))
    sizes = stored(sizes.select("own", F.when(F.col("n_group") >= MIN_GROUP, F.col("own")).otherwise(F.lit(0)).alias("group")), "rules-groups")
    rows = rows.join(sizes, "own", "left")
    passing = rows.where("not base_failed").select("group", *(f"x{i}" for i in range(P)))
    found = estimates(passing)
    enough = stored(passing.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_GROUP).select("group"), "rules-enough")
    evidence = F.col("n_words") / (F.col("n_words") + HALF_EVIDENCE)
    distance = F.when(~F.col("base_failed"), _distance() / F.greatest(F.col("scale"), F.lit(1.0)) * evidence)
    return (rows.join(found.join(enough, "group"), "group", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.coalesce(distance <= cut, F.lit(True))).alias("kept"), distance.alias("distance")))
