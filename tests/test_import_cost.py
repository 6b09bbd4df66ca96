"""An import's files are looked through once, its rules are compiled, and its
rows stay where they are when duplicates are dropped."""

import random

from pyspark.sql import functions as F

from trade_insights.functions import parse as P
from trade_insights.operators import ingest as S
from trade_insights.schema import EXPORTS_SCHEMA
from trade_insights.sources import raw


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_looked_through_once_and_rules_are_compiled(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("SB No,SB Date,Qty\n1,2024-01-05,2 KGS\n")
    (tmp_path / "b.csv").write_text("SB Date,SB No,Qty\n2024-01-06,2,3 KGS\n")
    passes, plain = [], raw.csv_files
    for module in (raw, S):
        monkeypatch.setattr(module, "csv_files", lambda *a: passes.append(a) or plain(*a))
    staged = S.staged_rows(spark, str(tmp_path), "csv", None, "fruits", "b")
    assert len(passes) == 1
    rules = [x for x in plan_of(staged).replace(P.WHITESPACE, "").split("\n") if "regexp" in x]
    assert rules and not any("*(" in x[:x.index("Project")] for x in rules)
    assert sorted((r.declaration_id, r.quantity, r.month_year) for r in staged.collect()) == [("1", 2.0, "2024-01"), ("2", 3.0, "2024-01")]


def test_cells_are_trimmed_of_any_white_space(spark):
    cells = [None, "", "a", "a b", "é", "~", "\x7f", "\x01a", "a b"]
    cells += [x for w in P.WHITESPACE for x in (w, w + "a", "a" + w, w + "é" + w, w + "a b" + w)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {r.i: (r.t, r.b, r.d) for r in rows.select("i", P.trimmed(F.col("c")).alias("t"), P.blank_to_null(F.col("c")).alias("b"), P.with_default(F.col("c"), "KGS").alias("d")).collect()}
    for i, c in enumerate(cells):
        t = None if c is None else c.strip(P.WHITESPACE)
        assert got[i] == (t, c if t else None, t or "KGS"), repr(c)


def test_rows_stay_where_they_are_when_duplicates_are_dropped(spark, tmp_path, monkeypatch):
    draw = random.Random(3)
    places = [(draw.choice("abc"), draw.choice([0, 128, 1 << 30]), seq * 7) for seq in draw.sample(range(9000), 9000)]
    rows = [(f, b, (ord(f) + b % 5 << 33) + s, None if draw.random() < 0.05 else f"D{draw.randrange(3000)}", float(draw.randrange(2))) for f, b, s in places]
    df = spark.createDataFrame(rows, "source_file string, source_block long, ingest_seq long, declaration_id string, quantity double")
    same = {"date": F.lit("2024-01-01"), "timestamp": F.lit(None)}
    df = df.select("*", *(same.get(f.dataType.typeName(), F.lit("2")).cast(f.dataType).alias(f.name) for f in EXPORTS_SCHEMA.fields if f.name not in df.columns))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    first = {}
    for f, b, s, *key in rows:
        first[tuple(key)] = min(first.get(tuple(key), (f, b, s)), (f, b, s))
    want = sorted(s for f, b, s, *key in rows if key[0] is None or first[tuple(key)] == (f, b, s))
    out = S.dedup_exports(df)
    plan = plan_of(out)
    assert "SortAggregate" not in plan and "SortMergeJoin [ingest_seq" not in plan
    whole = [x for x in plan.split("\n") if "Join" in x and "__list" in x]
    assert whole and all("BroadcastHashJoin" in x for x in whole)
    assert sorted(r.ingest_seq for r in out.collect()) == want
    monkeypatch.setattr(S, "MOST_KNOWN", 0)  # an import too large for that
    assert sorted(r.ingest_seq for r in S.dedup_exports(df).collect()) == want


def test_numbered_names_meet_by_long_runs(spark):
    from trade_insights.operators.patterns import _pattern_runs
    some = spark.createDataFrame([("SUPPLIER#000012345",), ("TRADERS%#00012345",), ("ab",)], "p string")
    got = {r.p: {len(x) for x in r.runs} for r in some.select("p", _pattern_runs(F.col("p")).alias("runs")).collect()}
    assert got == {"SUPPLIER#000012345": {16}, "TRADERS%#00012345": {8}, "ab": {2}}
