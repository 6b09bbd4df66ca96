import re

from trade_insights.llm.common import clear, scratch, sorted_groups, stored
from trade_insights.sources.store import store_exists
from trade_insights.llm.oracle import ORACLE
from trade_insights.llm.queries import QUERIES

import corpus_pipeline
import pyarrow as pa
import pytest


def test_a_query_for_each_operator_and_the_pipeline():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    from __spark_entry__ import queries
    assert {*QUERIES, "pipeline"} <= set(queries())


def test_clear_removes_the_tables_of_this_application(spark):
    df = stored(spark.range(5), "test")
    assert df.count() == 5 and store_exists(spark, scratch(spark))
    clear(spark)
    assert not store_exists(spark, scratch(spark))
    assert stored(spark.range(5), "test").count() == 5


@pytest.mark.parametrize("rows", [1, 3, 100])
@pytest.mark.parametrize("cuts", [[], [1], [2, 5], [1, 2, 3, 4, 5, 6, 7], [0, 3, 3, 8]])
def test_sorted_groups_hold_whole_groups(rows, cuts):
    keys = [1, 1, 2, 3, 3, 3, 3, 9]
    table = pa.table({"key": keys, "at": range(len(keys))})
    edges = [0, *cuts, len(keys)]
    batches = [b for a, z in zip(edges, edges[1:]) for b in table.slice(a, z - a).combine_chunks().to_batches() or [pa.RecordBatch.from_pydict({"key": pa.array([], pa.int64()), "at": pa.array([], pa.int64())})]]
    groups = [g.to_pydict() for g in sorted_groups(iter(batches), "key", rows)]
    assert [x for g in groups for x in g["at"]] == list(range(len(keys)))
    owners = [k for g in groups for k in sorted(set(g["key"]))]
    assert owners == sorted(set(keys))
    assert all(len(g["at"]) >= rows for g in groups[:-1])
    if rows == 1:
        assert len(groups) == 4
