"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, fingerprints, lines, mixing, near, periodic, quality, rules, substrings, suffixes, topk, warc
from .common import table
from .oracle import ORACLE  # noqa: F401

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tenths of all tokens, from up to four epochs of a source."""
    return mixing.mixed_in(table(spark, sf_dir, "documents"), mixing.shelf(F.col("source")), mixing.chosen_weights(), share=0.6, max_epochs=4)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BPE_FILE)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cleaned(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.joined(table(spark, sf_dir, "documents")).drop("node")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("digest_holds")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), BPE_FILE, PIECE_FILE)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, of which one in ten repeats its own words."""
    return periodic.digests(periodic.planted(table(spark, sf_dir, "documents"))).drop("n_words")


QUERIES = {f.__name__: f for f in (op1_substrings, op2_topk, op3_suffixes, op4_lines, op5_near, op6_warc, op7_rules, op8_mix, op9_bpe, op10_quality, op11_alignment, op12_fingerprints, op13_periodic)}
