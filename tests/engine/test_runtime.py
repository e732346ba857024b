from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenfield.functions import tiles
from lumenfield.operators import caching
from lumenfield.plans import viewing
from lumenfield.sources import catalog
from lumenfield.streaming import messages as ms
from lumenfield.streaming import requests, telemetry

MESSAGE = "seq int, protocol_version int, type string, source_id int, bands array<int>, tx int, ty int"


def test_message_kinds(spark):
    ok = [26, 16, 8]
    rows = [
        (2, "tile_complete", 1, ok, 0, 0, "error"), (None, "ready", 1, ok, 0, 0, "error"), (1, "tile_complete", 2, ok, 0, 0, "stale-source"), (1, "tile_complete", 0, ok, 0, 0, "tile-complete"),
        (1, "tile_complete", 1, None, 0, 0, "tile-complete-malformed"), (1, "tile_complete", 1, [1, 2], 0, 0, "tile-complete-malformed"), (1, "tile_complete", 1, [1, 16, 8], 0, 0, "tile-complete-stale-bands"),
        (1, "tile_complete", 1, ok, None, 0, "tile-complete-malformed"), (1, "canceled", 1, None, None, None, "canceled"), (1, "spectrum_error", 1, None, None, None, "spectrum-error"), (1, "what", 1, None, None, None, "unknown"),
    ]
    df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], MESSAGE)
    assert {r.seq: r.kind for r in ms.classified(df, 1, (26, 16, 8)).collect()} == {i: r[-1] for i, r in enumerate(rows)}


ACTIONS = [(1, "a", 1, "track"), (1, "b", 2, "track"), (1, "a", 3, "release"), (1, "a", 4, "release"), (0, "x", 5, "track"), (2, "c", 6, "track"), (1, "d", 7, "track"), (2, None, 8, "invalidate"), (2, "e", 9, "track"), (2, None, 10, "track")]
SCHEMA = "source_id long, request_id string, seq long, action string"


def test_request_state_in_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(ACTIONS, SCHEMA)
    assert sorted(map(tuple, requests.pending(df).collect())) == [(1, "b"), (1, "d"), (2, "e")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = requests.tracked_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.seq: r.effect for r in spark.table("tracked").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True, 8: True, 9: True, 10: False}


def test_streamed_windows_equal_the_batch(spark, tmp_path, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    live = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = telemetry.windowed(live, late="60 days").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = telemetry.windowed(spark.read.schema(schema).parquet(f"{sf_dir}/events.parquet"))
    rows = lambda df: {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in df.collect()}
    assert rows(spark.table("windows")) == rows(batch) != {}


def test_classified_stream(spark, tmp_path):
    spark.createDataFrame([('{"protocolVersion":1,"type":"tile_complete","sourceId":1,"payload":{"bands":[26,16,8],"tile":{"x":1,"y":2}}}',), ("junk",)], "value string").coalesce(1).write.parquet(str(tmp_path / "m"))
    live = ms.classified(ms.parsed(spark.readStream.schema("value string").parquet(str(tmp_path / "m"))), 1, (26, 16, 8))
    q = live.select("kind").writeStream.format("memory").queryName("kinds").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.kind for r in spark.table("kinds").collect()) == ["error", "tile-complete"]


def test_preload_order(spark):
    g = tiles.tile_grid(spark, 1024, 1024)
    got = viewing.preload(g, g.where("tx = 0 and ty = 0"), g.where("tx = 1 and ty = 1")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1), (0, 1, 1)]


def test_eviction_and_plans(spark):
    e = spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 60), (1, "c", 3, 70), (2, "d", 4, 500)], "source_id int, tile string, seq int, bytes int")
    assert sorted(r.tile for r in caching.kept(e, 130, 9).collect()) == ["b", "c"] and sorted(r.tile for r in caching.kept(e, 1000, 1).collect()) == ["c", "d"]
    plan = caching.stats_plan(spark.createDataFrame([(1,), (2,)], "band int"), spark.createDataFrame([(1, 0.0), (2, 1.0)], "band int, min double")).first()
    assert plan.ready and plan.missing == []


def test_baseline_is_forced(spark):
    rows = [(1, i, 90.0, 1.0 + i, None, False) for i in range(1, 60)] + [(2, 1, 5.0, 1.0, 7.0, True), (2, 2, 6.0, 2.0, 8.0, False)]
    s = spark.createDataFrame(rows, "source_id int, seq int, cpu double, memory double, gpu double, busy boolean")
    base = {r.source_id: (r.seq, r.gpu) for r in telemetry.baseline(s).collect()}
    assert base == {1: (41, None), 2: (2, 8.0)}
    peaks = {(r.source_id, r.seq): r for r in telemetry.peaks(s, telemetry.baseline(s)).collect()}
    assert peaks[1, 59].peak_memory == 60 and peaks[1, 59].peak_gpu is None and peaks[2, 2].peak_gpu == 8


def test_initial_view_waits_for_all_tiles(spark):
    t0 = datetime(2024, 1, 1)
    at = lambda ms_: t0 + timedelta(milliseconds=ms_)
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "source_id int, tile string")
    done = spark.createDataFrame([(1, "a", at(5)), (1, "a", at(90)), (1, "b", at(17)), (2, "a", at(3))], "source_id int, tile string, ts timestamp")
    start = spark.createDataFrame([(1, t0), (2, t0)], "source_id int, started timestamp")
    assert [tuple(r) for r in telemetry.initial_view(t, done, start).collect()] == [(1, 17.0)]


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"version": 1, "samples": [{"id": "a", "title": "A", "kind": "envi-http", "headerUrl": "/h", "dataUrl": "/d", "headers": {"k": "v"}}, {"id": "b", "title": " ", "kind": "envi-http", "headerUrl": "/h", "dataUrl": "/d"}]}')
    s = catalog.read_catalog(spark, str(tmp_path / "c.json"))
    assert {r.id: (r.problem, r.validation_tier, r.headers) for r in s.collect()} == {"a": (None, "local", {"k": "v"}), "b": ("missing title", "local", None)}
    with pytest.raises(ValueError, match="missing title"):
        catalog.checked(s)
    with pytest.raises(ValueError, match="duplicate"):
        catalog.checked(s.where("id = 'a'").union(s.where("id = 'a'")))
    catalog.write_catalog(catalog.checked(s.where("id = 'a'")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert catalog.by_tier(s, "all").count() == 2 and catalog.sample(s, "zz").count() == 0
    assert spark.range(1).select(catalog.browser_may_read(F.lit("https://a.b/x"), F.lit("https://A.b"), F.lit(None))).first()[0]
