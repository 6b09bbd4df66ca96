"""Tables that the store keeps beside its lines, so that common questions read
no line: made by Spark from each commit's lines, and valid for its batches.

``keys``          digest of the six-column key of each line: the duplicate
                  check of an import joins with these 16 bytes a line, of the
                  months that the import touches.
``names``         lines and money of each exporter, and of each consignee and
                  country, by month: name search adds these up.
``grams``         every three letters that follow each other in a name, sorted
                  by them: a contains-search reads the pages of its own letters.
``dictionary``    a number for each exporter, consignee, country and product,
                  the same in all commits.
``bitmaps``       the numbers that occur in a month, as bitmaps: the union of
                  any months is an OR, and its size a bit count.
``declarations``  digests of a month's declarations. They grow with the lines,
                  so a dictionary of them would have to be joined as a whole
                  with every import; their sets are kept instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import digest, line_key, whole_key
from ..functions.match import like_any

#: Columns whose distinct values are numbered and counted from bitmaps.
COUNTED = ["exporter_name", "consignee_name", "country_of_destination", "product_description"]
GRAM = 3
#: Names that a filter on lines lists, which Parquet can skip by; more are joined.
MOST_LISTED = 1000

SCHEMAS = {
    "keys": "month_year string, key_hi long, key_lo long, upload_batch string",
    "names": "month_year string, role string, name string, country string, lines long, fob decimal(38,2), upload_batch string",
    "grams": "gram string, role string, name string, upload_batch string",
    "bitmaps": "month_year string, column string, bucket long, bits binary, upload_batch string",
    "declarations": "month_year string, key_hi long, key_lo long, upload_batch string",
    "dictionary": "column string, value string, id long",
}
#: What each table is sorted by, so that row groups and pages can be skipped.
SORTED = {"keys": ["month_year", "key_hi"], "names": ["role", "name"], "grams": ["gram", "role", "name"],
          "bitmaps": ["month_year", "column", "bucket"], "declarations": ["month_year", "key_hi"], "dictionary": ["column", "value"]}


def keys(lines: DataFrame) -> DataFrame:
    return lines.filter(whole_key()).select("month_year", *line_key(), "upload_batch")


def names(lines: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    roles = F.array(*(F.struct(F.lit(role).alias("role"), F.col(name).alias("name"), country.alias("country"))
                      for role, name, country in (("exporter", "exporter_name", none), ("consignee", "consignee_name", F.col("country_of_destination")))))
    rows = lines.select("month_year", "upload_batch", "fob_value", F.inline(roles))
    return rows.groupBy("month_year", "upload_batch", "role", "name", "country").agg(F.count(F.lit(1)).alias("lines"), F.sum("fob_value").cast("decimal(38,2)").alias("fob"))


def _grams(text: Column) -> Column:
    """Distinct runs of three letters; none for shorter texts."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (GRAM - 1), F.lit(1)))
    return F.when(F.char_length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM)))))


def named(lines: DataFrame) -> DataFrame:
    """Who exports and who receives, without what ``names`` adds up."""
    roles = F.array(*(F.struct(F.lit(role).alias("role"), F.col(name).alias("name")) for role, name in (("exporter", "exporter_name"), ("consignee", "consignee_name"))))
    return lines.select("upload_batch", F.inline(roles))


def grams(found: DataFrame) -> DataFrame:
    """From the ``names`` of a commit."""
    once = found.filter("name is not null").select("upload_batch", "role", "name").distinct()
    return once.select("upload_batch", "role", "name", F.explode(_grams(F.upper(F.col("name")))).alias("gram"))


def declarations(lines: DataFrame) -> DataFrame:
    return lines.filter("declaration_id is not null").select("month_year", "upload_batch", *digest(F.col("declaration_id"))).distinct()


def values(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct values of the counted columns in each month and batch: names
    and countries as the lines' ``names`` hold them, the others from the lines."""
    by_name = F.when(F.col("role") == "exporter", F.lit(COUNTED[0])).otherwise(F.lit(COUNTED[1]))
    cells = F.inline(F.array(F.struct(by_name.alias("column"), F.col("name").alias("value")), F.struct(F.lit(COUNTED[2]).alias("column"), F.col("country").alias("value"))))
    rows = found.select("month_year", "upload_batch", cells)
    for c in COUNTED[3:]:
        rows = rows.unionByName(lines.select("month_year", "upload_batch", F.lit(c).alias("column"), F.col(c).alias("value")).distinct())
    return rows.filter("value is not null").distinct()


def numbered(found: DataFrame, dictionary: DataFrame, place) -> DataFrame:
    """Numbers for the values that the dictionary lacks, dense and above its
    own: each partition counts its values, and the sums of the partitions
    before give its first number. ``place`` writes a table and reads it back."""
    new = found.select("column", "value").distinct().join(dictionary, ["column", "value"], "left_anti")
    new = place(new.withColumn("part", F.spark_partition_id()))
    parts = new.groupBy("column", "part").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("column").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = dictionary.groupBy("column").agg(F.max("id").alias("most"))
    parts = parts.select("column", "part", before.alias("before")).join(base, "column", "left")
    own = F.row_number().over(W.partitionBy("column", "part").orderBy("value"))
    rows = new.withColumn("own", own).join(parts, ["column", "part"])
    return rows.select("column", "value", (F.coalesce("most", F.lit(0)) + F.col("before") + F.col("own")).cast("long").alias("id"))


def bitmaps(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    rows = found.join(dictionary, ["column", "value"])
    return rows.groupBy("month_year", "upload_batch", "column", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def distinct_counts(found: DataFrame, by: list[str]) -> DataFrame:
    """From rows of ``bitmaps``: how many distinct values of each column, for
    each value of ``by``: columns named as the counted ones."""
    united = found.groupBy(*by, "column", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return united.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("column") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTED))


def term_grams(term: str) -> list[str]:
    """Grams that every name holding the term has: those of its parts between
    LIKE's wildcards."""
    parts = term.upper().replace("_", "%").split("%")
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def names_like(names: DataFrame, grams: DataFrame, role: str, terms: list[str]) -> DataFrame:
    """The distinct names of a role that hold any of the terms (``%`` and ``_``
    as in LIKE), as ``name``. Where each term has grams, only names that have
    all grams of a term are tried; else all names are."""
    wanted = [term_grams(t) for t in terms]
    if all(wanted):
        rows = grams.filter((F.col("role") == role) & F.col("gram").isin(sorted({g for w in wanted for g in w})))
        found = rows.groupBy("name").agg(F.collect_set("gram").alias("found"))
        has = [F.size(F.array_intersect("found", F.array(*map(F.lit, w)))) == len(w) for w in wanted]
        tried = found.filter(reduce(lambda a, b: a | b, has)).select("name")
    else:
        tried = names.filter(F.col("role") == role).select("name").distinct()
    return tried.filter(like_any(F.upper(F.col("name")), terms))


def lines_of(lines: DataFrame, column: str, found: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """The lines whose ``column`` is one of the names found. Up to ``most`` of
    them become a list, by which Parquet skips row groups and pages; more are
    joined. At most ``most + 1`` names reach the driver."""
    listed = [r[0] for r in found.limit(most + 1).collect()]
    if len(listed) <= most:
        return lines.filter(F.col(column).isin(sorted(listed)))
    return lines.join(found.withColumnRenamed("name", column), column, "left_semi")
