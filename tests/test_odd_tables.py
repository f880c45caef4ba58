"""Registered queries on tables with odd rows, against their SQL."""

import datetime as dt
import re
from collections import Counter
from itertools import combinations, groupby

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gneissflow import session
from gneissflow.operators import history
from gneissflow.plans import code_queries, queries


def against_sql(spark, name, d, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, d)
    want = con.sql(entry.oracle_sql()[name])
    rows = sorted(map(str, map(tuple, got.select(*want.columns).collect())))
    assert rows == sorted(map(str, want.fetchall()))
    return rows


@pytest.mark.parametrize("name", ["interval_overlap", "whole_scope_fallback"])
def test_hours_of_the_nearest_second(spark, tmp_path, name):
    at = lambda hour, s=0.0: dt.datetime(1970, 1, 1) + dt.timedelta(hours=hour, seconds=s)
    rows = []
    for user, begin in enumerate((500_000, 0, -100)):
        for seconds in (-0.6, -0.5, -0.4, 0.4, 0.5, 0.6, 3599.5, 3600.5, -3600.5):
            for gap in range(-5, 6):
                rows.append((len(rows), at(begin + gap, seconds), user * 100 + len(rows) // 11, "view", 1.0))
            rows.append((len(rows), at(begin), rows[-1][2], "click", 99.0))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert len(against_sql(spark, name, str(tmp_path), "events")) > 50


def test_history_tasks_follow_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rows = [(i // 3 if i < 900 else 9000, "1", "-", f"p{i * 7 % 40}") for i in range(1000)] + [(None, "1", "1", "p1"), (5000, "1", "1", None), (5000, "1", "1", "p2")]
    log = spark.createDataFrame(rows, "commit_no long, added string, deleted string, path string")
    narrow = [r for r in rows if r[0] is not None and r[0] != 9000]
    pairs = history.cochange(log)
    # a commit of three paths has three pairs
    assert history.narrow_commits(log).rdd.getNumPartitions() >= len(rows) / 50 and pairs.rdd.getNumPartitions() >= 900 / 50
    want = Counter((a, b) for _, g in groupby(narrow, lambda r: r[0]) for a, b in combinations(sorted({r[3] for r in g if r[3]}), 2))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == want
    assert {r.path: r.churn for r in history.churn(log).collect()} == Counter({p: sum(int(r[1]) + (r[2] == "1") for r in narrow if r[3] == p) for p in {r[3] for r in narrow}})
    parts = log.where("commit_no IS NOT NULL").withColumn("part", F.expr("commit_no % 3"))
    history.add_ranges(parts, str(tmp_path))
    total = history.totals(spark, str(tmp_path))[1]
    assert total.rdd.getNumPartitions() >= len(want) / 50 and {(r.a, r.b): r.n for r in total.collect()} == want


def test_call_edges_follow_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    edges = queries.call_edges(spark, sf)
    assert edges.rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() / 100
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()  # names are not sent whole


def test_code_graph_sends_no_table_whole(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    g = code_queries.Reading(spark, sf).graph()
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (g.edges, g.unresolved, code_queries.code_integrity(spark, sf)):
        plan = plan_of(df)
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert re.search(r"via_file#\d+, prop#\d+, _salt#\d+\], \[via_file", plan_of(g.unresolved))  # null keys are dealt out
