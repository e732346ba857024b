"""Streams against batch forms, for several cuts into batches and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from lumenfield.plans import standin
from lumenfield.plans.runtime_queries import cancel_actions, transition_actions
from lumenfield.streaming import ordered, requests, telemetry, transitions

CUTS = [(1, False), (4, True)]


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("batches,shuffled", CUTS)
def test_cancellations(spark, sf_dir, batches, shuffled):
    a = cancel_actions(spark, sf_dir)
    late = "60 days" if shuffled else "1 hour"
    run = lambda s: requests.cancelled_stream(s, 864_000, late)
    folder = ordered.play(a, batches, shuffled)
    got = ordered.drained(spark, run(ordered.opened(spark, folder, 1)), f"{folder}-out")
    want = rows(requests.consumed(a, 864_000))
    assert rows(got) == want and any("True" in r for r in want) and any("False" in r for r in want)
    assert ordered.state_rows(spark, f"{folder}-out") == 0


@pytest.mark.parametrize("batches,shuffled,again_ms", [(2, False, 500), (4, True, 7_200_000)])
def test_baselines(spark, sf_dir, batches, shuffled, again_ms):
    t = standin.telemetry(spark, sf_dir)
    late = "60 days" if shuffled else "1 hour"
    got = ordered.played(t, lambda s: telemetry.baseline_stream(s, again_ms, late), batches, shuffled)
    assert rows(got.select("source_id", "seq", "cpu", "memory", "gpu")) == rows(telemetry.baseline(t, again_ms))


def test_second_look_and_force(spark):
    def samples(*values):
        return spark.createDataFrame([(1, i, 1_000_000 * 0 + t, c, 0.0, None, b) for i, (t, c, b) in enumerate(values)], "source_id long, seq long, t long, cpu double, memory double, gpu double, busy boolean").withColumn("ts", F.timestamp_millis("t")).drop("t")

    got = lambda s: [(r.source_id, r.seq) for r in telemetry.baseline(s).collect()]
    assert got(samples((0, 10.0, False))) == [(1, 0)]
    assert got(samples((0, 10.0, False), (500, 30.0, False))) == []  # current when looked at again
    assert got(samples((0, 10.0, False), (400, 12.0, False), (501, 30.0, False))) == [(1, 1)]
    assert got(samples((0, 10.0, True), (600, 10.0, False), (900, 10.0, True), (1000, 9.0, False))) == [(1, 3)]
    assert got(samples(*((i * 1000, 50.0, False) for i in range(45)))) == [(1, 40)]


def test_transitions_over_cuts_restart_and_initial_state(spark, sf_dir):
    a = transition_actions(spark, sf_dir)
    whole = rows(ordered.played(a, transitions.transition_stream, 3))
    assert sum("True)" in r for r in whole) > 0
    # half, a stop, the rest from the checkpoint: nothing comes twice
    folder = ordered.play(a, 2)
    files = sorted(spark.read.parquet(folder).inputFiles())
    import os
    import shutil

    part = f"{folder}-half"
    os.makedirs(part)
    by_age = sorted(files, key=lambda f: os.stat(f.removeprefix("file://")).st_mtime_ns)
    for f in by_age[:1]:
        shutil.copy2(f.removeprefix("file://"), part)
    ordered.drained(spark, transitions.transition_stream(ordered.opened(spark, part, 1)), f"{folder}-out")
    for f in by_age[1:]:
        shutil.copy2(f.removeprefix("file://"), part)
    assert rows(ordered.drained(spark, transitions.transition_stream(ordered.opened(spark, part, 1)), f"{folder}-out")) == whole
    # a transition that is on already isn't begun again, and its last tile finalises it
    a = spark.createDataFrame([(1, 1, "begin", 5, 5), (1, 2, "tile", None, None), (1, 3, "tile", None, None), (2, 4, "begin", 2, 1), (2, 5, "begin", 9, 9), (2, 6, "tile", None, None), (3, 7, "begin", 0, 4), (3, 8, "tile", None, None)], "source_id long, seq long, action string, visible int, idle int").withColumn("ts", F.timestamp_seconds("seq"))
    initial = spark.createDataFrame([(1, json.dumps({"rest": 2}))], "source_id long, json string")
    got = ordered.played(a, lambda s: transitions.transition_stream(s, initial=initial))
    assert {(r.seq, r.started, r.requeued, r.remaining, r.finalise) for r in got.collect()} == {
        (1, False, 0, 2, False), (2, False, 0, 1, False), (3, False, 0, 0, True), (4, True, 1, 1, False), (5, False, 0, 1, False), (6, False, 0, 0, True), (7, False, 0, 0, False), (8, False, 0, 0, False)}


@pytest.mark.parametrize("batches", [1, 3])
def test_responses(spark, sf_dir, batches):
    from lumenfield.plans.runtime_queries import actions

    a = actions(spark, sf_dir)
    sides = lambda s: (s.where("closed or action = 'track'"), s.where("closed or action = 'release'"))
    got = ordered.played(a, lambda s: requests.responses_within(*sides(s), "3 days"), batches).where("seq is not null")
    want = requests.responses_within(a.where("action = 'track'"), a.where("action = 'release'"), "3 days")
    assert rows(got) == rows(want) and any("None" in r for r in rows(want)) and any("datetime" in r for r in rows(want))


@pytest.fixture(scope="module")
def odd_events(tmp_path_factory):
    """Events of few keys, most of them of one: without keys, times or ids, ids and times that come twice, responses just within the bound and just beyond it, times before 1970; the folder, and its tables in DuckDB."""
    import duckdb

    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"""COPY (
        SELECT CASE WHEN i % 41 <> 0 THEN (i // 7 * 50 + CASE WHEN hot THEN 1 ELSE i % 3 END)::BIGINT END AS event_id,
            CASE WHEN i % 37 <> 0 THEN make_timestamp(86400000000 * (i * 7919 % 43 - 12) + i // 130 % 3 // 2) END AS ts,
            CASE WHEN i % 29 <> 0 THEN CASE WHEN hot THEN 3 ELSE i // 10 % 5 END::BIGINT END AS user_id,
            CASE WHEN i % 31 <> 0 THEN ['view', 'error', 'purchase', 'click', 'view', 'signup'][(i * 7907 // 11 % 6)::INT + 1] END AS event_type,
            (i % 9 / 50)::DOUBLE AS value, '{{"k": 1}}' AS props FROM (SELECT i, i % 10 < 8 AS hot FROM range(1500) t(i))) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


def same_as_sql(df, con, name):
    from lumenfield.plans.registry import SQL

    want = con.execute(SQL[name]).fetchall()
    assert rows(df.select("source_id", "request_id", "seq", "answered_us")) == sorted(map(repr, want))
    return want


def test_first_responses_of_odd_events(spark, odd_events):
    from lumenfield.plans.registry import QUERIES

    folder, con = odd_events
    got = QUERIES["j08_first_responses"](spark, folder)
    want = same_as_sql(got, con, "j08_first_responses")
    assert any(r[3] is None for r in want) and any(r[3] is not None and r[3] < 0 for r in want) and any(None in r[:3] for r in want)
    # a key's requests aren't met with all its responses
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_response_stream_of_odd_events(spark, odd_events):
    from lumenfield.plans.registry import QUERIES

    folder, con = odd_events
    same_as_sql(QUERIES["j08_response_stream"](spark, folder), con, "j08_response_stream")


@pytest.mark.parametrize("batches,shuffled", CUTS)
def test_first_responses_over_cuts(spark, sf_dir, batches, shuffled):
    from lumenfield.plans.runtime_queries import actions

    a = actions(spark, sf_dir)
    late = 60 * 86_400 if shuffled else 3600
    folder = ordered.play(a, batches, shuffled)
    got = ordered.drained(spark, requests.first_responses_stream(ordered.opened(spark, folder, 1), 259_200, late), f"{folder}-out")
    want = rows(requests.first_responses(a.where("action = 'track'"), a.where("action = 'release'"), 259_200))
    assert rows(got) == want and any("None" in r for r in want) and any("datetime" in r for r in want)
    # a row a request, not one a response, and nothing is held in the end
    assert spark.read.format("statestore").option("path", f"{folder}-out-checkpoint").option("stateVarName", "waiting").load().count() == 0
