import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators.cube import Cube
from lumenfield.sources import header as hd
from lumenfield.sources import ranges, synthetic
from lumenfield.sources.cube_writer import stored, write_cube
from lumenfield.sources.envi import CubeDataSource, CubeReader


def cells(df):
    return {(r.x, r.y, r.band): r.value for r in df.collect()}


@pytest.mark.parametrize("layout", ["bsq", "bil", "bip"])
@pytest.mark.parametrize("end", ["img", "parts"])
@pytest.mark.parametrize("shape", ["cells", "spectra"])
def test_written_bytes_equal_the_plain_layout(spark, tmp_path, layout, end, shape):
    rng = np.random.default_rng(4)
    values = rng.integers(-900, 900, (6, 11, 7))
    h = hd.Header(7, 11, 6, layout, "i16", "msb", 5, wavelength=tuple(float(b) for b in range(6)))
    rows = [(x, y, b + 1, float(values[b, y, x])) for b in range(6) for y in range(11) for x in range(7)]
    df = spark.createDataFrame(rows, "x int, y int, band int, value double").repartition(5)
    if shape == "spectra":
        df = df.groupBy("x", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda s: s["value"]).alias("spectrum"))
    head, data = f"{tmp_path}/c.hdr", f"{tmp_path}/c.{end}"
    write_cube(df, h, head, data, lines=4)
    _, plain = synthetic.write(str(tmp_path), h, values, "plain")
    with open(plain, "rb") as f:
        assert ranges.open_bytes(data).read_all() == f.read()
    cube = Cube.load(spark, head, data)
    assert cube.header == h and cells(cube.cells()) == {r[:3]: r[3] for r in rows}
    assert cells(cube.cells([2, 5], 3, 9)) == {r[:3]: r[3] for r in rows if r[2] in (2, 5) and 3 <= r[1] < 9}
    left = sorted(f for f in os.listdir(tmp_path) if not f.startswith("plain"))
    assert left == (["c.hdr", "c.img"] if end == "img" else ["c.hdr", "c.parts", next(f for f in left if f.startswith("c.parts."))])


def test_absent_cells_are_zero_and_a_second_write_replaces_the_first(spark, tmp_path):
    h = hd.Header(3, 5, 2, "bsq", "f32")
    head, data = f"{tmp_path}/c.hdr", f"{tmp_path}/c.parts"
    write_cube(spark.createDataFrame([(0, 0, 1, 1.0)], "x int, y int, band int, value double"), h, head, data, 2)
    write_cube(spark.createDataFrame([(1, 4, 2, 2.5), (0, 1, 1, None)], "x int, y int, band int, value double"), h, head, data, 2)
    assert {k: v for k, v in cells(Cube.load(spark, head, data).cells()).items() if v} == {(1, 4, 2): 2.5}
    assert len([f for f in os.listdir(tmp_path) if f.startswith("c.parts.")]) == 1
    assert tuple(Cube.load(spark, head, data).summary().first()) == ("c.parts", "parts", 3, 5, 2, "BSQ", "f32", "LSB", 120)
    write_cube(spark.createDataFrame([], "x int, y int, band int, value double"), h, head, f"{tmp_path}/e.img")
    assert not any(cells(Cube.load(spark, head, f"{tmp_path}/e.img").cells()).values())


@pytest.mark.parametrize("end", ["img", "parts"])
@pytest.mark.parametrize("rows", [[(3, 0, 1, 1.0)], [(0, 0, 3, 1.0)], [(0, 0, 1, 70000.0)], [(0, 0, 1, float("nan"))], [(0, 0, 1, 1.0), (0, 0, 1, 2.0)]], ids=["outside", "band", "range", "nan", "twice"])
def test_bad_rows_fail_and_leave_nothing(spark, tmp_path, rows, end):
    h = hd.Header(3, 5, 2, "bil", "u16")
    with pytest.raises(Exception, match="cube|fit|twice"):
        write_cube(spark.createDataFrame(rows, "x int, y int, band int, value double"), h, f"{tmp_path}/c.hdr", f"{tmp_path}/c.{end}", 2)
    assert os.listdir(tmp_path) == []


def test_rows_that_are_not_dealt_by_strip_are_refused(spark, tmp_path):
    h = hd.Header(2, 4, 1, "bip", "u8")
    df = spark.createDataFrame([(0, y, 1, 1.0) for y in (0, 3, 1, 2)], "x int, y int, band int, value double").repartition(4)
    spark.dataSource.register(CubeDataSource)
    write = lambda d: d.write.format("cube").options(header=f"{tmp_path}/c.hdr", data=f"{tmp_path}/c.img", text=hd.render(h), strip_lines="2").mode("overwrite").save()
    with pytest.raises(Exception, match="write_cube"):
        write(df.orderBy(F.col("y") % 2).coalesce(1))
    with pytest.raises(Exception, match="write_cube"):
        write(df.repartitionByRange(2, F.col("y") % 2))
    assert os.listdir(tmp_path) == []


def test_values_in_stored_types():
    h = lambda t: hd.Header(1, 1, 1, "bsq", t)
    assert stored(np.array([1.5, 2.5, -0.4]), h("i16")).tolist() == [2, 2, 0]
    for kind, bad in (("u8", 256), ("u8", -1), ("i64", 2.0**63), ("u64", 2.0**64), ("f32", 1e39), ("u16", np.inf)):
        with pytest.raises(ValueError):
            stored(np.array([bad], float), h(kind))
    assert np.isinf(stored(np.array([np.inf]), h("f32"))).all()


def test_parts_of_strided_ranges():
    p = ranges.Part("f", 100, 10, 4, 20, 3)  # 10..14, 30..34, 50..54
    assert p.pieces(0, 100) == [(10, 100, 4), (30, 104, 4), (50, 108, 4)]
    assert p.pieces(12, 31) == [(0, 102, 2), (18, 104, 1)] and p.pieces(14, 30) == [] and p.pieces(33, 51) == [(0, 107, 1), (17, 108, 1)]
    assert ranges.joined([(50, 60), (0, 10), (12, 20), (90, 95)], 5) == [[1, 2], [0], [3]]
    assert ranges.packed([5, 5, 20, 1, 1], 10) == [[0, 1], [2], [3, 4]] and ranges.packed([], 10) == []


def test_many_small_ranges_are_few_tasks_and_reads(tmp_path):
    h = hd.Header(100, 200, 64, "bsq", "u16")
    head, data = synthetic.write(str(tmp_path), h, np.arange(64 * 200 * 100).reshape(64, 200, 100) % 60000)
    asked = []

    class Counting(ranges.LocalBytes):
        def read(self, start, end):
            asked.append((start, end))
            return super().read(start, end)

    reader = CubeReader(h, Counting(data), None, None, (7, 8))
    [task] = reader.partitions()
    assert len(task.strips) == 64
    got = {b["band"][i].as_py(): b["value"][i].as_py() for b in reader.read(task) for i in range(0, 1)}
    assert len(asked) == 1 and got[3] == (2 * 20000 + 700) % 60000  # 40 KB from line to line: one read goes over them
    far = CubeReader(hd.Header(100, 20_000, 64, "bsq", "u16"), Counting(data), None, None, (7, 8))
    assert len(far.partitions()) == 1 and len(ranges.joined([(s.start, s.end) for s in far.strips()], 1 << 16)) == 64
    assert len(CubeReader(hd.Header(1000, 20_000, 64, "bsq", "f32"), Counting(data), None, None).partitions()) > 100


@pytest.mark.parametrize("layout", ["bsq", "bip"])
def test_broken_tiles_are_skipped(spark, tmp_path, layout):
    h = synthetic.header(interleave=layout)
    head, data = synthetic.write(str(tmp_path), h)
    whole = synthetic.pixels(spark)
    kept = 48 * 48 * 32 * 2 * 5 // 6
    os.truncate(data, kept)  # by line: the last row of tiles; by band: the last bands
    cube = Cube.load(spark, head, data)
    with pytest.raises(Exception, match="range"):
        cube.cells().count()
    broken = cube.failures(size=16).collect()
    got = {r.band: (round(r.min, 9), round(r.max, 9)) for r in cube.band_stats(size=16, permissive=True).collect()}
    from lumenfield.functions.tiles import sample_tiles
    from lumenfield.operators import stats

    tiles = sample_tiles(48, 48, 16)
    if layout == "bip":
        assert [(r.y, r.band) for r in broken] == [(32, None)] and "range" in broken[0].error
        want = stats.band_stats(whole, [t for t in tiles if t[1] < 2], 16).collect()
    else:
        # bands 27 and on are gone, and the third row of tiles of no earlier band
        assert {r.band for r in broken} == set(range(27, 33))
        want = [r for r in stats.band_stats(whole, tiles, 16).collect() if r.band <= 26]
        got = {b: v for b, v in got.items() if b <= 26}
    assert got == {r.band: (round(r.min, 9), round(r.max, 9)) for r in want}
    assert cube.first_stats([1], size=16).count() == 1
