"""Operator 8: mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree of domains, languages and sources. Among the
children of a node it is divided by weight; a child cannot take more than its
subtree holds (its tokens times ``max_epochs``), and what it leaves goes to its
siblings by weight, so a shortage leaves a node only when the whole node is
short. A leaf that gets more than it holds is passed whole so many times; the
rest is a prefix, by tokens, of its documents in an order that seed and epoch
fix.

Only DataFrame functions are used. The prefix of a leaf is found through sums
of buckets of the order, of about ``BUCKET_ROWS`` documents each; only the
documents of the bucket that the budget ends in are sorted one by one, so a
source with a third of all rows needs no large task.

Null domains, languages and sources are nodes of their own. Texts that are
null, empty or blank have no tokens and are never taken. Rows of one doc_id in
one leaf are one unit: they are taken or left together, and their tokens
counted together. Ties of the order go to the smaller doc_id. An empty table
gives an empty result. A null or negative weight counts as 0, and a node of
weight 0 gets nothing. Columns of other names are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

LEVELS = ("domain", "lang", "source")
BUCKET_ROWS = 1024
#: Added to a null name of a node, which no other name starts with.
NO_NAME = "\x00"


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NO_NAME))


def _weight(c: Column) -> Column:
    return F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def divided(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children with columns weight, cap and parent_budget:
    the parent's budget by weight, no child above its cap, what a child cannot
    take going to the others by weight."""
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy("ratio", name)
    out = children.withColumn("ratio", ratio)
    out = out.withColumns({
        "place": F.row_number().over(order),
        "filled": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    level = F.when(F.col("open") > 0, (F.col("parent_budget") - F.col("filled")) / F.col("open")).otherwise(F.lit(0.0))
    out = out.withColumn("level", level)
    # the first child, by ratio, that its share does not fill sets the level for all after it
    out = out.withColumn("first_open", F.min(F.when((F.col("weight") == 0) | (F.col("cap") > F.col("level") * F.col("weight")), F.struct("place", "level"))).over(by))
    full = F.col("first_open").isNull() | (F.col("place") < F.col("first_open.place"))
    out = out.withColumn("budget", F.when(full, F.col("cap")).otherwise(F.greatest(F.col("first_open.level") * F.col("weight"), F.lit(0.0))))
    return out.drop("ratio", "place", "filled", "open", "level", "first_open")


def budgets(leaves: DataFrame, weights: dict[str, Column], share: float | None, target: float | None, max_epochs: int) -> DataFrame:
    """budget of each leaf; leaves has the names of LEVELS, tokens, n_units."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    level, above = None, []
    for k, name in enumerate(LEVELS):
        path = list(LEVELS[: k + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"), F.sum("n_units").alias("n_units")).withColumn("weight", _weight(weights[name]))
        if level is None:
            if target is None:
                target = math.floor((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
            nodes = nodes.withColumn("parent_budget", F.lit(float(target)))
        else:
            nodes = nodes.join(level.select(*above, F.col("budget").alias("parent_budget")), above)
        level, above = divided(nodes, above, name), path
    return level


def mixed_in(docs: DataFrame, domain: Column, weights: dict[str, Column], share: float | None = None, target: float | None = None,
             max_epochs: int = 1, seed: int = 7, tokens: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, budget (of the leaf) and copies
    (0 where a document is left out) of each unit. The budget is ``target``
    tokens, or ``share`` of all; ``weights`` has a column for each level."""
    size = word_count(F.col("text").cast("string")) if tokens is None else tokens
    units = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), _named(domain).alias("domain"), _named(F.col("lang")).alias("lang"), _named(F.col("source")).alias("source"), size.cast("long").alias("n_tokens"))
             .groupBy("doc_id", *LEVELS).agg(F.sum("n_tokens").alias("n_tokens")))
    units = stored(units, "mix-units")
    leaves = stored(units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.lit(1)).alias("n_units")), "mix-leaves")
    leaf = budgets(leaves, weights, share, target, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    leaf = stored(leaf.select(*LEVELS, "budget", epochs.alias("epochs"), F.greatest(F.lit(1), F.ceil(F.col("n_units") / BUCKET_ROWS)).cast("long").alias("n_buckets"),
                              F.floor(F.col("budget") - epochs * F.col("tokens")).cast("long").alias("rest")), "mix-budgets")
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = units.join(leaf, [*LEVELS]).withColumn("key", key)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("n_buckets") / F.lit(1 << 32)))
    sums = rows.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("of_bucket"))
    upto = F.sum("of_bucket").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    buckets = stored(sums.withColumn("before", upto - F.col("of_bucket")).select(*LEVELS, "bucket", "before", (F.col("before") + F.col("of_bucket") <= F.col("rest")).alias("whole")), "mix-buckets")
    rows = rows.join(buckets, [*LEVELS, "bucket"])
    ends = ~F.col("whole") & (F.col("before") <= F.col("rest"))
    # rows outside the bucket that the budget ends in need no order: each stands alone
    within = Window.partitionBy(*LEVELS, "bucket", F.when(ends, F.lit(0).cast("long")).otherwise(F.xxhash64("doc_id"))).orderBy("key", F.col("doc_id").asc_nulls_first())
    running = F.col("before") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.col("whole") | (ends & (running <= F.col("rest")))
    copies = F.when(F.col("n_tokens") > 0, F.col("epochs") + F.when(last, F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("int")
    name = lambda c: F.when(F.col(c) != NO_NAME, F.col(c)).alias(c)
    return rows.select("doc_id", *(name(c) for c in LEVELS), "n_tokens", "budget", copies.alias("copies"))


def taken(docs: DataFrame, domain: Column, weights: dict[str, Column], **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken,
    with the columns of ``docs`` alone."""
    mine = [f"d{i}" for i in range(len(docs.columns))]
    chosen = mixed_in(docs, domain, weights, **how).where("copies > 0")
    chosen = stored(chosen.select(F.col("doc_id").alias("key0"), _named(F.col("domain")).alias("key1"), _named(F.col("lang")).alias("key2"), _named(F.col("source")).alias("key3"), "copies"), "mix-chosen")
    keys = [F.col("doc_id").cast("long"), _named(domain), _named(F.col("lang")), _named(F.col("source"))]
    wide = docs.select(*(k.alias(f"own{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`").alias(m) for c, m in zip(docs.columns, mine)))
    on = F.col("own0").eqNullSafe(F.col("key0"))
    for i in (1, 2, 3):
        on = on & (F.col(f"own{i}") == F.col(f"key{i}"))
    out = wide.join(chosen, on).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*(F.col(m).alias(c) for c, m in zip(docs.columns, mine)))


#: Domains of the given tables: four shelves of sources, by the digits of their names.
def shelf(source: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("shelf"), F.pmod(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})', 1) as int)"), F.lit(4)).cast("string")))


def chosen_weights() -> dict[str, Column]:
    """The production weights of the registered query and the pipeline."""
    d, lang = F.col("domain"), F.col("lang")
    return {"domain": F.when(d == "shelf0", 4.0).when(d == "shelf1", 3.0).when(d == "shelf2", 2.0).otherwise(1.0),
            "lang": F.when(lang == "en", 5.0).when(lang == "de", 2.0).when(lang == "fr", 2.0).otherwise(1.0),
            "source": F.lit(1.0)}
