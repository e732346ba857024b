"""Growing files, dead letters, stored limits and header records."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenfield.functions import records
from lumenfield.operators.cube import Cube
from lumenfield.operators.stats_store import StatsStore
from lumenfield.plans import standin
from lumenfield.sources import synthetic
from lumenfield.sources.lines_stream import LineSource, LineStream, samples_of
from lumenfield.streaming import letters, ordered


def test_growing_files_over_stops(spark, tmp_path):
    spark.dataSource.register(LineSource)
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    os.makedirs(folder)
    want = []

    def write(name, text):
        with open(f"{folder}/{name}", "a") as f:
            f.write(text)

    def run():
        live = samples_of(spark.readStream.format("growing_lines").option("path", folder).option("range_bytes", 50).load())
        q = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.file, r.seq) for r in spark.read.parquet(out).collect())

    def lines(a, b):
        return "".join(json.dumps({"source_id": 1, "seq": i, "ts": "2024-01-01T00:00:00Z", "cpu_usage": 0.5 * i, "pad": "é" * (i % 90)}, ensure_ascii=False) + "\n" for i in range(a, b))

    write("a.jsonl", lines(0, 40))
    write("b.jsonl", lines(0, 7)[:-30])  # the last line has no end yet
    write(".hidden", "x\n")
    want = [("a.jsonl", i) for i in range(40)] + [("b.jsonl", i) for i in range(6)]
    assert run() == want
    write("b.jsonl", lines(0, 7)[-30:] + lines(7, 9))
    os.rename(f"{folder}/a.jsonl", str(tmp_path / "away"))
    want += [("b.jsonl", i) for i in range(6, 9)]
    assert run() == want
    assert run() == want
    reader = LineStream(folder, 50)
    reader.partitions({"a.jsonl": 10}, {"a.jsonl": 10})
    assert reader.latestOffset()["a.jsonl"] == 10  # away, but in its place


def test_lines_of_stretches_are_each_read_once(tmp_path):
    text = b"".join(b"%d%s\n" % (i, b"x" * (i * 7 % 40)) for i in range(60)) + b"open"
    (tmp_path / "f").write_bytes(text)
    for size in (1, 3, 17, 64, 10_000):
        r = LineStream(str(tmp_path), size)
        end = r.latestOffset()
        got = [(a, v) for p in r.partitions({}, end) for b in r.read(p) for a, v in zip(b["at"].to_pylist(), b["value"].to_pylist())]
        assert [v for _, v in sorted(got)] == text.decode().split("\n")[:-1], size
        mid = text.index(b"\n", 200) + 1
        later = [v for p in r.partitions({"f": mid}, end) for b in r.read(p) for v in b["value"].to_pylist()]
        assert sorted(later) == sorted(text[mid:].decode().split("\n")[:-1]), size
    with pytest.raises(OSError):
        list(LineStream(str(tmp_path), 10).read(LineStream(str(tmp_path), 1 << 20).partitions({}, {"f": len(text) + 9})[0]))


def test_dead_letters_come_once_after_a_replay(spark, sf_dir, tmp_path):
    m = standin.messages(spark, sf_dir)
    folder = ordered.play(m, 3)
    out = str(tmp_path / "out")
    for check in ("one", "again"):  # a second run from nothing plays every batch again
        live = ordered.opened(spark, folder, 1).where("not closed").drop("closed")
        assert letters.routed(live, out, str(tmp_path / check)).awaitTermination(300)
        dead, good = (letters.letters(spark, out, live.schema, x) for x in (True, False))
        assert (dead.count(), good.count()) == (m.where("protocol_version <> 1").count(), m.where("protocol_version = 1").count())
        p = letters.progress(spark, out).orderBy("batch").collect()
        assert p[-1].total == m.count() and p[-1].total_dead == dead.count() and len(p) >= 3


def test_stored_limits(spark, tmp_path):
    h = synthetic.header(interleave="bil")
    head, data = synthetic.write(str(tmp_path), h)
    cube, store = Cube.load(spark, head, data), StatsStore(spark, str(tmp_path / "stats"))
    asked = []
    plain = cube.band_stats
    object.__setattr__(cube, "band_stats", lambda bands, **o: asked.append(bands) or plain(bands, **o))
    first = {tuple(r) for r in store.ensure(1, cube, [3, 8, 3], size=16).collect()}
    assert {b for b, *_ in first} == {3, 8} and asked == [[3, 8]]
    assert {tuple(r) for r in store.ensure(1, cube, [8, 3], size=16).collect()} == first and len(asked) == 1
    assert store.ensure(1, cube, [3, 8, 20], size=16).count() == 3 and asked[1:] == [[20]]
    assert store.ensure(2, cube, [3], size=16).count() == 1 and store.ensure(0, cube, [3], size=16).count() == 1
    assert store.unload(1) and not store.unload(1) and store.missing(1, [3]) == [3] and store.missing(2, [3]) == [] and store.missing(0, [3]) == [3]
    with pytest.raises(IndexError):
        store.ensure(2, cube, [99])


GOOD = {"samples": 3, "lines": "4", "bands": 2, "interleave": "BIL", "dataType": "Float", "byteOrder": 0, "headerOffset": None, "bytesPerPixel": 4}


@pytest.mark.parametrize("more,error", [
    ({}, None), ({"samples": 0}, "samples"), ({"lines": 1.5}, "lines"), ({"bands": None}, "bands"), ({"interleave": "x"}, "interleave"), ({"dataType": 7}, "dataType"), ({"byteOrder": "9"}, "byteOrder"), ({"headerOffset": -1}, "headerOffset"),
    ({"wavelength": [1, "x"]}, "wavelength"), ({"bandMetadata": [{"index": 0}]}, "bandMetadata"), ({"wavelength": "no list"}, None),
])
def test_header_records(spark, more, error):
    df = spark.createDataFrame([(json.dumps(GOOD | more),)], "t string").select(records.record(F.col("t")).alias("r")).select("r.*")
    r = df.first()
    assert (r.error is None) == (error is None) and (error is None or error in r.error and r.samples is None)
    if not more:
        assert (r.samples, r.lines, r.bands, r.interleave, r.data_type, r.byte_order, r.header_offset, r.bytes_per_pixel) == (3, 4, 2, "bil", "f32", "lsb", 0, 4)


def test_nested_header_fields(spark):
    rec = GOOD | {
        "wavelength": [400, "500.5"], "customFields": {"a": 1, "b": "x"}, "description": "", "fileType": "ENVI", "sensorType": 5, "epsg": 1, "mapInfo": "top", "affineTransform": [0, 1, 0, 0, 0, -1],
        "spatialReference": {"epsg": 32650, "mapInfo": None}, "bandMetadata": [{"index": 1, "name": "r", "wavelength": None, "displayRole": "RED"}, {"index": "2", "displayRole": "pink", "wavelength": 5}],
    }
    rows = [(json.dumps(rec),), (None,), ("[1]",), ("{",)]
    got = spark.createDataFrame(rows, "t string").select(records.record(F.col("t")).alias("r")).select("r.*").collect()
    r = got[0]
    assert r.error is None and r.wavelength == [400.0, 500.5] and r.custom_fields == {"a": "1", "b": "x"} and (r.description, r.file_type, r.sensor_type) == (None, "ENVI", None)
    assert r.epsg == 32650 and r.map_info == "top" and r.affine == [0, 1, 0, 0, 0, -1]
    assert [tuple(b) for b in r.band_metadata] == [(1, "r", None, "red"), (2, None, 5.0, None)]
    assert [x.error for x in got[1:]] == ["no header record"] * 3
