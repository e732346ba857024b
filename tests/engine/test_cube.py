"""Golden values of the synthetic cube, and functions against them."""

import pytest
from pyspark.sql import functions as F

from lumenfield.functions import bands, geo, stretch, tiles, viewport
from lumenfield.operators.cube import Cube
from lumenfield.sources import synthetic


@pytest.fixture(scope="module")
def cube(spark):
    return Cube(synthetic.header(), synthetic.pixels(spark).cache())


def test_sampled_statistics(cube):
    got = {r.band: r for r in cube.band_stats().collect()}
    for b, lo, hi in ((1, 91.898325, 203.886398), (8, 792.044103, 904.067008), (16, 1592.020217, 1703.934644), (26, 2591.902192, 2704.025760)):
        assert got[b].min == pytest.approx(lo, abs=1e-5) and got[b].max == pytest.approx(hi, abs=1e-5)


def test_composites(cube):
    for rgb, want in (((26, 16, 8), {(0, 0): (196, 36, 130), (2, 3): (150, 212, 84), (24, 24): (68, 130, 223), (47, 47): (93, 155, 27)}), ((30, 20, 10), {(0, 0): (39, 100, 162), (47, 47): (157, 219, 59)})):
        got = {(r.x, r.y): (r.r, r.g, r.b) for r in cube.composite(*rgb, tile=(0, 0)).collect()}
        assert len(got) == 48 * 48 and all(got[k] == v for k, v in want.items())
    assert cube.composite(26, 16, 8, tile=(5, 0)).count() == 0


def test_profiles_probes_and_bounds(cube):
    p = cube.profile(2, 3).orderBy("band").collect()
    assert [r.value for r in p[:4]] == [177, 284, 391, 401] and p[-1].value == 3203 and p[0].wavelength == 400
    probe = cube.probe(2, 3).first()
    assert (probe.world.x, probe.world.y) == (500060, 4099910) and len(probe.spectrum) == 32
    assert cube.probe(48, 0).count() == 0
    for call, error in ((lambda: cube.spectrum(48, 0), IndexError), (lambda: cube.band(33), IndexError), (lambda: cube.band("1"), TypeError)):
        with pytest.raises(error):
            call()
    assert tuple(cube.metadata(5).first()) == (48, 48, 32, "BSQ", "u16", "LSB", 5)


def test_statistics_are_kept(cube):
    cube.stored.clear()
    first = cube.keep_stats([26, 8, 26])
    cube.stored[26] = (0.0, 1.0)
    assert cube.keep_stats([26, 8]) == {26: (0.0, 1.0), 8: first[8]}
    cube.stored.clear()


def test_files_equal_the_relation(spark, cube, tmp_path):
    for layout in ("bsq", "bil", "bip"):
        head, data = synthetic.write(str(tmp_path), synthetic.header(interleave=layout), name=layout)
        c = Cube.load(spark, head, data)
        assert c.pixels.exceptAll(cube.pixels).count() == 0 and c.pixels.count() == 73728
        assert c.header.custom_fields["wavelength units"] == "Nanometers"


def test_operations_on_one_file_cube_leave_each_other_alone(spark, cube, tmp_path):
    """Every operation gives the relation's rows after every other one, in the three layouts."""
    operations = {
        "count": lambda c: [(c.pixels.count(),)],
        "band": lambda c: sorted(map(tuple, c.band(3).collect())),
        "tile": lambda c: sorted(map(tuple, c.tile(5, 1, 2, 16).collect())),
        "spectrum": lambda c: sorted(map(tuple, c.spectrum(1, 2).collect())),
        "probe": lambda c: [tuple(c.probe(7, 40).first())],
        "stats": lambda c: sorted((r.band, round(r.min, 6), round(r.max, 6)) for r in c.band_stats(size=16).collect()),
        "stats of bands": lambda c: sorted((r.band, round(r.min, 6), round(r.max, 6)) for r in c.band_stats([8, 26], size=16).collect()),
        "composite": lambda c: sorted(map(tuple, c.composite(26, 16, 8, (2, 0), 16).collect())),
    }
    want = {n: f(cube) for n, f in operations.items()}
    cube.stored.clear()
    for layout in ("bsq", "bil", "bip"):
        c = Cube.load(spark, *synthetic.write(str(tmp_path), synthetic.header(interleave=layout), name=layout))
        names = list(operations)
        # a walk in which every operation follows every other one
        for step in range(1, len(names)) if layout == "bsq" else (1, len(names) - 1):
            for i in range(len(names)):
                n = names[i * step % len(names)]
                assert operations[n](c) == want[n], (layout, n)
    plan = c.band_stats([8], count=2, size=16)
    assert plan.rdd.getNumPartitions() >= 1 and c.cells([8], 0, 16).count() == 16 * 48


def test_running_values_over_cut_histories(spark):
    import random

    from lumenfield.operators.prefix import running

    rng = random.Random(4)
    rows = [(k, s, rng.choice([None, rng.randrange(100)])) for k in ("a", "b", None) for s in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k string, s long, v int")
    plain = {w: sorted(map(str, running(df, "k", "s", {"m": "v"}, {"n": F.lit(1)}, {"p": "v"}, w).collect())) for w in (1, 37, 10**6)}
    assert plain[1] == plain[37] == plain[10**6]
    got = sorted((r for r in running(df, "k", "s", {"m": "v"}, {"n": F.lit(1)}, {"p": "v"}, 37).collect() if r.k == "a"), key=lambda r: r.s)
    own = sorted((s, v) for k, s, v in rows if k == "a")
    assert [(r.n, r.p) for r in got] == [(i + 1, own[i - 1][1] if i else None) for i in range(60)]


def test_nearest_rank_with_outliers_and_ties(spark):
    values = [float(i % 50) for i in range(5000)] + [1e30, float("inf"), -1e30, float("nan"), None]
    df = spark.createDataFrame([(b, v if b == 1 or v is None else -v) for b in (1, 2) for v in values], "band int, value double")
    from lumenfield.operators import stats

    got = {r.band: (r.low, r.high) for r in stats.nearest_rank(df).collect()}
    for b in (1, 2):
        own = sorted(v if b == 1 else -v for v in values if v is not None and v == v)
        n = len(own)
        assert got[b] == (own[int(n * 0.02)], own[min(n - 1, -int(-n * 0.98 // 1))])


def test_tiny_cube_of_the_layout_tests(spark):
    rows = [(x, y, b, float(b * 100 + 10 * y + x)) for b in range(1, 5) for y in range(2) for x in range(3)]
    c = Cube(synthetic.header(3, 2, 4), spark.createDataFrame(rows, "x int, y int, band int, value float"))
    c.stored = dict.fromkeys((1, 2, 3), (0.0, 400.0))
    first = c.composite(3, 2, 1).where("x = 0 and y = 0").first()
    assert (first.r, first.g, first.b, first.a) == (191, 128, 64, 255)
    assert [r.value for r in c.spectrum(1, 1).orderBy("band").collect()] == [111, 211, 311, 411]


def test_tiles():
    assert tiles.grid(1025, 1025) == (3, 3)
    assert tiles.sample_tiles(1025, 1025) == [(0, 0), (2, 2), (1, 1), (2, 0), (0, 2)] and tiles.sample_tiles(48, 48) == [(0, 0)]
    for bad in ((0, 1), (1.5, 1), (True, 1)):
        with pytest.raises(TypeError):
            tiles.grid(*bad)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_band_choice(spark):
    lit = lambda v: F.array(*map(F.lit, v))
    nothing = F.lit(None).cast("map<string,string>")
    for n, want in ((32, (30, 20, 10)), (16, (16, 8, 1)), (3, (3, 2, 1)), (2, (2, 1, 1)), (1, (1, 1, 1))):
        assert tuple(one(spark, bands.default_bands(F.lit(n), F.lit(None).cast("array<double>"), nothing))[0]) == want
    for w, units, want in (((450.0, 470.0, 550.0, 650.0, 800.0), "nanometers", (4, 3, 2)), ((0.45, 0.47, 0.55, 0.65, 0.8), "micrometers", (4, 3, 2)), ((900.0, 1000.0, 1100.0, 1200.0, 1300.0), "", (4, 3, 2))):
        fields = F.create_map(F.lit("wavelength units"), F.lit(units))
        assert tuple(one(spark, bands.default_bands(F.lit(5), lit(w), fields))[0]) == want
    for text, want in (("{12, 8, 4}", (12, 8, 4)), ("{80, 40, 20}", (30, 20, 10))):
        assert tuple(one(spark, bands.default_bands(F.lit(64), F.lit(None).cast("array<double>"), F.create_map(F.lit("Default Bands"), F.lit(text))))[0]) == want
    assert one(spark, bands.unique_bands(lit(("1", "1", "2", "0", "x", "3"))))[0] == [1, 2, 3]


def test_coordinates(spark):
    a = F.array(*map(F.lit, (500000.0, 30.0, 0.0, 4100000.0, 0.0, -30.0)))
    there, back = one(spark, geo.pixel_to_world(a, F.lit(2), F.lit(3)), geo.world_to_pixel(a, F.lit(500060), F.lit(4099910)))
    assert tuple(there) == (500060, 4099910) and tuple(back) == (2, 3)
    assert one(spark, geo.world_to_pixel(F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0, 2.0, 4.0))), F.lit(1), F.lit(1)))[0] is None
    assert one(spark, geo.pixel_to_world(a, F.lit(float("nan")), F.lit(1)))[0] is None


def test_stretch_edges(spark):
    q = lambda v: stretch.quantise(stretch.stretch(F.lit(v).cast("float"), F.lit(0.0), F.lit(400.0)))
    assert tuple(one(spark, *(q(v) for v in (float("nan"), float("inf"), float("-inf"), 300.0, 200.0)))) == (0, 255, 0, 191, 128)
    low, high = one(spark, *stretch.limits(F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert (low, high) == (0, 255)


def test_viewport(spark):
    home = viewport.view(*viewport.HOME)
    zoomed = viewport.zoom(home, F.lit(2.0), F.lit(0.0), F.lit(0.0))
    a = viewport.aspect(F.lit(100), F.lit(100), F.lit(50), F.lit(50))
    assert tuple(one(spark, viewport.visible_bounds(zoomed, a))[0]) == (0.25, 0.25, 0.5, 0.5)
    assert tuple(one(spark, viewport.zoom(zoomed, F.lit(0.4), F.lit(0.3), F.lit(0.3)))[0]) == viewport.HOME
    assert tuple(one(spark, viewport.pan(home, F.lit(0.5), F.lit(0.5), a))[0]) == viewport.HOME
    assert one(spark, viewport.aspect(F.lit(2), F.lit(1), F.lit(0), F.lit(5)))[0] == (1.0, 1.0)
