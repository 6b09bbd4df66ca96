"""Operator 4: line dedup with a log-template tree.

Lines fall down a tree of fixed depth: by their number of tokens, then by their
leading tokens, where a token with a digit is a variable field. In a leaf, a
position keeps its token if ``CONSTANT`` of the leaf's lines have it there and
becomes variable otherwise; a line belongs to the leaf's template if at least
``SIMILAR`` of its tokens are the template's, one beyond the leading tokens
among them, since those are equal in all the leaf. Templates whose lines stand in
``MIN_DOCS`` documents or more recur, and their lines are dropped.

A leaf holds further templates, since positions become variable where it mixes
lines of several kinds or furniture and prose. Each of its lines keeps the
tokens that recur at their position in the leaf; lines that keep the same ones
and stand in ``MIN_DOCS`` documents make a template. A line belongs to it if
``SIMILAR`` of its tokens, and of those after the leading ones, are the
template's, or if it is the template itself.

Lines of up to ``LEAD`` tokens have a leaf of their own for each masked list of
tokens, whose template is this list; one of fields only has none.

A document more than half of whose words stand in such lines is a copy of
others rather than a page with furniture; it is left whole, as whole copies
are the work of near-duplicate detection. This is a rule of the operator, not
a limit of its work: near copies that differ in a line and short pages with
long common parts look alike, and cutting the former would leave of each copy
only what it has of its own.

Only DataFrame functions are used. Leaves with too few documents are dropped
before any token is counted, equal lines are counted once with their number,
and what a hot line gathers is summed before each shuffle.

A null text stays null and an empty one empty. Blank lines are never dropped.
Long texts and long lines are handled like any other; equal counts of tokens at
a position go to the largest token. Rows that
agree in doc_id and text are treated alike and count as one document; a null
doc_id is a value like any other. An empty table gives an empty result. Other
columns are passed through, also such with names that are used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, stored, words
from .common import once as _once

LEAD = 3
MIN_DOCS = 10
CONSTANT, SIMILAR = 0.8, 0.6
#: Share of a document's words in recurring lines beyond which it is left whole.
MOST_DROPPED = 0.5
VARIABLE = "<*>"
KEY = ["doc_id", "digest"]


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def _id(doc_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (as text that is never null), digest of the text, and text."""
    return docs.select(_id(F.col("doc_id")).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, BLANK_RUN), "")


def _leaf(tokens: Column) -> Column:
    own = (F.size(tokens) > LEAD) | F.exists(tokens, lambda t: ~t.rlike("[0-9]"))
    return F.when(own, F.xxhash64(F.size(tokens), *(_masked(F.get(tokens, F.lit(i))) for i in range(LEAD))))


def _equal(tokens: Column, template: Column) -> Column:
    """Number of tokens that are the template's; a variable position has none."""
    return F.size(F.filter(F.zip_with(tokens, template, lambda a, b: (a == b) & (b != VARIABLE)), lambda x: x))


def _rest(tokens: Column) -> Column:
    return F.slice(tokens, LEAD + 1, F.greatest(F.size(tokens) - LEAD, F.lit(0)))


def _near(tokens: Column, template: Column) -> Column:
    """Whether a line belongs to a further template of its leaf: as the leading
    tokens are equal in all the leaf, the others must be similar by themselves."""
    rest = _equal(_rest(tokens), _rest(template))
    similar = (rest >= (F.size(tokens) - LEAD) * SIMILAR) | ((tokens == template) & (rest > 0))
    return similar & (_equal(tokens, template) >= F.size(tokens) * SIMILAR)


def _further(found: DataFrame, kinds: DataFrame, spots: DataFrame, covered: DataFrame, min_docs: int) -> DataFrame:
    """leaf and line of the lines that belong to further templates of their
    leaf, but for those ``covered`` already: of each line, the tokens that stand at their position in ``min_docs``
    of the leaf's lines are constant, and lines of equal constants make a
    template if they stand in ``min_docs`` documents.

    A line whose own constants make a template belongs to it. Of the others,
    one that agrees with m of a template's k constants has one of any k - m + 1
    of them; lines and templates meet by the rarest so many.
    """
    often = stored(spots.where((F.col("n") >= min_docs) & (F.col("i") >= LEAD) & (F.col("token") != VARIABLE)), "lines-often")
    placed = kinds.where(F.size("tokens") > LEAD).select("leaf", "line", F.posexplode("tokens").alias("i", "token"))
    placed = stored(placed.join(often.select("leaf", "i", "token"), ["leaf", "i", "token"], "left_semi"), "lines-constants")
    constant = placed.groupBy("leaf", "line").agg(F.collect_list("i").alias("at"))
    pattern = F.transform("tokens", lambda t, i: F.when((i < LEAD) | F.array_contains("at", i), t).otherwise(VARIABLE))
    own = kinds.join(constant, ["leaf", "line"]).select("leaf", "line", "n", "tokens", _once(pattern, "pattern")).where(_near(F.col("tokens"), F.col("pattern")))
    own = stored(own.select("leaf", "line", "n", "pattern", F.xxhash64("pattern").alias("kind")), "lines-patterns")
    wanted = own.groupBy("leaf", "kind").agg(F.sum("n").alias("n"), F.first("pattern").alias("pattern")).where(F.col("n") >= min_docs)
    wanted = stored(wanted.drop("n"), "lines-wanted")
    at = found.select("leaf", "line", *KEY).join(own.join(wanted, ["leaf", "kind"], "left_semi").select("leaf", "line", "kind"), ["leaf", "line"])
    enough = at.select("leaf", "kind", *KEY).distinct().groupBy("leaf", "kind").count().where(F.col("count") >= min_docs)
    templates = stored(wanted.join(enough, ["leaf", "kind"], "left_semi"), "lines-kinds-wanted")
    parts = templates.select("leaf", "kind", F.size("pattern").alias("size"), F.posexplode("pattern").alias("i", "token")).join(often, ["leaf", "i", "token"])
    one = Window.partitionBy("leaf", "kind")
    parts = parts.select("*", F.row_number().over(one.orderBy("n", "i")).alias("place"), F.count("*").over(one).alias("k"))
    agreed = F.ceil((F.col("size") - LEAD) * SIMILAR - 1e-9)
    keys = parts.where(F.col("place") <= F.greatest(F.lit(1), F.col("k") - agreed + 1)).select("leaf", "kind", "i", "token")
    owned = own.join(templates.select("leaf", "kind"), ["leaf", "kind"], "left_semi").select("leaf", "line")
    open_ = placed.join(covered.unionByName(owned), ["leaf", "line"], "left_anti")
    tried = open_.join(keys, ["leaf", "i", "token"]).select("leaf", "line", "kind").distinct()
    tried = tried.join(kinds.select("leaf", "line", "tokens"), ["leaf", "line"]).join(templates, ["leaf", "kind"])
    return owned.unionByName(tried.where(_near(F.col("tokens"), F.col("pattern"))).select("leaf", "line").distinct())


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, digest and positions (from 0, in order) of the lines that
    recurring templates cover, with the words that stand in them."""
    keyed = _keyed(docs)
    leaves = F.transform(F.transform(F.split("text", "\n"), _tokens), _leaf)
    placed = stored(keyed.select(*KEY, leaves.alias("leaves")).dropDuplicates(KEY), "lines-leaves")
    once = placed.select(F.explode(F.array_distinct("leaves")).alias("leaf")).where("leaf is not null")
    common = stored(once.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "lines-common")
    at = placed.select(*KEY, F.posexplode("leaves").alias("place", "leaf")).where("leaf is not null").join(common, "leaf", "left_semi")
    at = stored(at.groupBy(*KEY).agg(F.collect_list(F.struct("place", "leaf")).alias("at")), "lines-places")
    # the candidate lines themselves, from one pass over the texts
    found = keyed.groupBy(*KEY).agg(F.first("text").alias("text")).join(at, KEY).select(*KEY, "at", _once(F.split("text", "\n"), "lines"))
    tokens = lambda x: F.transform(_tokens(F.get(F.col("lines"), x)), _masked)
    found = found.select(*KEY, F.inline(F.transform("at", lambda x: F.struct(x["place"].alias("place"), x["leaf"].alias("leaf"), tokens(x["place"]).alias("tokens")))))
    found = found.withColumn("line", F.xxhash64("tokens"))
    found = stored(found, "lines-candidates")
    kinds = stored(found.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens")), "lines-kinds")
    spots = kinds.select("leaf", "n", F.posexplode("tokens").alias("i", "token"))
    spots = stored(spots.groupBy("leaf", "i", "token").agg(F.sum("n").alias("n")), "lines-spots")
    tops = spots.groupBy("leaf", "i").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
    constant = F.when(F.col("top.n") >= F.col("all") * CONSTANT, F.col("top.token")).otherwise(F.lit(VARIABLE))
    templates = stored(tops.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("i", constant.alias("token")))).alias("template")).select("leaf", F.col("template.token").alias("template")), "lines-templates")
    main = (_equal(F.col("tokens"), F.col("template")) >= F.size("tokens") * SIMILAR) & (_equal(_rest(F.col("tokens")), _rest(F.col("template"))) > 0)
    main = main | (F.size("tokens") <= LEAD)  # the leaf is the whole list
    members = stored(kinds.join(templates, "leaf").where(main).select("leaf", "line"), "lines-members")
    enough = found.join(members, ["leaf", "line"]).select("leaf", *KEY).distinct().groupBy("leaf").count().where(F.col("count") >= min_docs)
    covered = stored(members.join(enough, "leaf", "left_semi"), "lines-covered")
    near = stored(_further(found, kinds, spots, covered, min_docs), "lines-further")
    gone = found.join(covered.unionByName(near).distinct(), ["leaf", "line"])
    return gone.groupBy(*KEY).agg(F.collect_list("place").alias("places"), F.sum(F.size("tokens")).alias("words_found"))


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with the recurring lines dropped from ``text`` and
    three columns more: n_lines, n_dropped, left_whole."""
    found = stored(recurring(docs, min_docs).select(F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest"), "places", "words_found"), "lines-found")
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.select(_id(F.col("doc_id")).alias("own_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_digest"), F.col("text").cast("string").alias("own_text"),
                       *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names) if c != "text"))
    out = wide.join(found, (F.col("own_id") == F.col("found_id")) & (F.col("own_digest") == F.col("found_digest")), "left").select("*", _once(F.split("own_text", "\n"), "own_lines"))
    whole = F.coalesce(F.col("words_found") > MOST_DROPPED * F.size(words(F.col("own_text"))), F.lit(False))
    lines = F.col("own_lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
    cut = F.col("places").isNotNull() & ~whole
    text = F.when(cut, F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i)))).otherwise(F.col("own_text"))
    columns = [(text if c == "text" else F.col(n)).alias(c) for c, n in zip(docs.columns, names)]
    return out.select(*columns, F.when(F.col("own_text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                      F.when(cut, F.size("places")).otherwise(F.lit(0)).cast("long").alias("n_dropped"), whole.alias("left_whole"))


def digests(docs: DataFrame) -> DataFrame:
    out = cleaned(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", "left_whole", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
