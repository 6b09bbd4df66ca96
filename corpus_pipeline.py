"""A training corpus from the table of documents, in five stages.

Each stage takes what its predecessor wrote: documents of low quality go, then
the lines of recurring templates, then all but one of each group of near
duplicates; the rest is mixed to target weights and encoded.

What the stages do with odd rows:

* A null, empty or blank text has no words: the classifier scores it like one
  of difference 0, no line of it goes, it is no near duplicate of another
  document, the mix leaves it out, as it has no tokens.
* A null doc_id is a document like any other; a null lang or source is a value
  of its own. Rows that agree in doc_id and text are one document from the near
  duplicates on; before, each stays with its kind.
* Equal scores fare alike, of equal documents the smallest doc_id stays, and
  the mix orders by a hash of doc_id, then by doc_id.
* Long texts are read whole by every stage. An empty table gives an empty
  result. Further columns, whatever their names, are passed through until the
  last stage, which returns doc_id, n_tokens, digests and ids.

The tables that a stage's operators have written go when its result is there,
and a stage's result goes when that of the next is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trade_insights.llm import bpe, lines, mixing, near, quality
from trade_insights.llm.common import release, stored, table, written
from trade_insights.llm.queries import BPE_FILE

#: Share of the tokens at hand that the mix takes, none of them twice.
MIX_SHARE = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates."""
    out = lines.cleaned(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates."""
    return near.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of shelves, languages and sources."""
    return mixing.taken(docs, mixing.shelf(F.col("source")), mixing.chosen_weights(), share=MIX_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of ids and decoded text."""
    return bpe.digests(docs, BPE_FILE, with_ids=True)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]
#: The classifier's and the tokenizer's work is no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        release(spark, first)
    return docs
