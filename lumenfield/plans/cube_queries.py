"""Queries over the cube: projections, filters, joins, statistics, stretch, geometry."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, geo, stretch, text, tiles, viewport
from ..operators import caching, chunks, cube, stats
from ..operators.stats_store import StatsStore
from ..sources.synthetic import shared_folder
from . import viewing
from .registry import query
from .standin import BANDS, DIM, FILE_PX, MAP_INFO, PX, SAMPLES, SIZE, file_cube, pixels, table, wide
from .standin import cube as make_cube

D = "double"


def r6(c, name: str):
    return F.round(c.cast(D), 6).alias(name)


# ---- projections and filters ---------------------------------------------------------------------


@query("p01_band_projection", f"WITH {PX} SELECT x, y, band, value::DOUBLE AS value FROM px WHERE band = 7")
def p01(spark, d):
    return make_cube(spark, d).band(7).select("x", "y", "band", F.col("value").cast(D).alias("value"))


@query("p02_rgb_values", f"WITH {PX} SELECT x, y, max(value) FILTER (band = 26)::DOUBLE AS r, max(value) FILTER (band = 16)::DOUBLE AS g, max(value) FILTER (band = 8)::DOUBLE AS b FROM px GROUP BY x, y")
def p02(spark, d):
    return cube.wide_of(pixels(spark, d), [26, 16, 8]).select("x", "y", *(F.col(c).cast(D).alias(c) for c in "rgb"))


@query("p03_tile_window", f"WITH {PX} SELECT x, y, value::DOUBLE AS value FROM px WHERE band = 3 AND x BETWEEN 24 AND 24 AND y BETWEEN 8 AND 15")
def p03(spark, d):
    return make_cube(spark, d).tile(3, 3, 1, SIZE).select("x", "y", F.col("value").cast(D).alias("value"))


@query("p04_tiles_outside", f"WITH {PX}, t(tx, ty) AS (VALUES (0, 0), (3, 0), (9, 0), (0, 999)) SELECT tx, ty, count(x) AS n FROM t LEFT JOIN px ON x // 8 = tx AND y // 8 = ty AND band = 1 GROUP BY ALL")
def p04(spark, d):
    c = make_cube(spark, d)
    counts = [c.tile(1, tx, ty, SIZE).agg(F.lit(tx).alias("tx"), F.lit(ty).alias("ty"), F.count(F.lit(1)).alias("n")) for tx, ty in ((0, 0), (3, 0), (9, 0), (0, 999))]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("p05_pixel_spectrum", f"WITH {PX} SELECT band, value::DOUBLE AS value FROM px WHERE x = 4 AND y = 3")
def p05(spark, d):
    return make_cube(spark, d).spectrum(4, 3).select("band", F.col("value").cast(D).alias("value"))


@query("p06_probe_outside", f"WITH {PX} SELECT x, y, count(*) AS bands, round(sum(value::DOUBLE), 4) AS total FROM px WHERE (x, y) IN ((-1, 0), (0, 0), (24, 3), (25, 0), (0, 1000000)) GROUP BY x, y")
def p06(spark, d):
    c = make_cube(spark, d)
    at = [c.probe(x, y).select("x", "y", F.size("spectrum").cast("long").alias("bands"), F.round(F.aggregate("spectrum", F.lit(0.0), lambda t, s: t + s["value"]), 4).alias("total")) for x, y in ((-1, 0), (0, 0), (24, 3), (25, 0), (0, 1_000_000))]
    return functools.reduce(DataFrame.union, at)


@query("p08_finite_filter", f"WITH {PX}, v AS (SELECT band, CASE WHEN (x + y + band) % 7 = 0 THEN 'NaN'::DOUBLE WHEN (x + y) % 11 = 0 THEN '-Infinity'::DOUBLE ELSE value::DOUBLE END AS value FROM px) SELECT band, count(*) AS n, round(sum(value), 4) AS total FROM v WHERE isfinite(value) GROUP BY band")
def p08(spark, d):
    v = F.when((F.col("x") + F.col("y") + F.col("band")) % 7 == 0, F.lit(float("nan"))).when((F.col("x") + F.col("y")) % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value").cast(D))
    return pixels(spark, d).select("band", v.alias("value")).where(stretch.is_finite(F.col("value"))).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("p09_band_check", """WITH k AS (SELECT event_id, (props->>'k')::INT - 5 AS k FROM events), v AS (SELECT event_id, k, CASE WHEN event_id % 5 = 0 THEN k || '.5' WHEN event_id % 7 = 0 THEN 'x' ELSE ' ' || k || ' ' END AS v FROM k)
SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'integer' WHEN k < 1 OR k > 64 THEN 'range' ELSE 'ok' END AS verdict FROM v""")
def p09(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") - 5
    v = F.when(F.col("event_id") % 5 == 0, F.concat(k.cast("string"), F.lit(".5"))).when(F.col("event_id") % 7 == 0, "x").otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", bands.check_band(v, F.lit(BANDS)).alias("verdict"))


@query("p10_repaired_bands", """WITH k AS (SELECT event_id, (props->>'k')::INT - 5 AS k, event_id % 40 + 1 AS n FROM events), v AS (SELECT *, k BETWEEN 1 AND n AND 1 <= n AS ok FROM k)
SELECT event_id, CASE WHEN ok THEN k WHEN n >= 30 THEN 30 WHEN n = 1 THEN 1 WHEN n = 2 THEN 2 ELSE n END::INT AS r, CASE WHEN ok THEN 1 WHEN n >= 30 THEN 20 WHEN n <= 2 THEN 1 ELSE greatest(1, ceil(n / 2.0)) END::INT AS g,
CASE WHEN ok THEN k WHEN n >= 30 THEN 10 ELSE 1 END::INT AS b, NOT ok AS changed FROM v""")
def p10(spark, d):
    k, n = F.get_json_object("props", "$.k").cast("int") - 5, (F.col("event_id") % 40 + 1).cast("int")
    got = bands.repaired(k, F.lit(1), k, n)
    return table(spark, d, "events").select("event_id", got.alias("g")).select("event_id", "g.bands.r", "g.bands.g", "g.bands.b", "g.changed")


@query("p11_visible_tiles", """WITH s AS (SELECT n_nationkey AS id, 100 + n_nationkey * 37 AS samples, 900 - n_nationkey * 21 AS lines, 1 + n_nationkey / 4.0 AS scale, (n_nationkey % 5 - 2) / 10.0 AS ox, (n_nationkey % 3 - 1) / 10.0 AS oy FROM nation),
a AS (SELECT *, samples / lines AS ia, 640 / 480 AS ca FROM s), b AS (SELECT *, CASE WHEN ia > ca THEN 1.0 ELSE ia / ca END AS ax, CASE WHEN ia > ca THEN ca / ia ELSE 1.0 END AS ay FROM a),
u AS (SELECT *, greatest(0.0, least(1.0, ((-1 - ox) / scale / ax + 1) / 2)) AS l, greatest(0.0, least(1.0, ((1 - ox) / scale / ax + 1) / 2)) AS r, greatest(0.0, least(1.0, ((1 - oy) / scale / -ay + 1) / 2)) AS t, greatest(0.0, least(1.0, ((-1 - oy) / scale / -ay + 1) / 2)) AS m FROM b)
SELECT id, tx::INT AS tx, ty::INT AS ty FROM u, range(0, 100) p(tx), range(0, 100) q(ty) WHERE tx >= greatest(0, floor(l * samples / 64)) AND tx < least(ceil(samples / 64), ceil((l + greatest(r - l, 0)) * samples / 64)) AND ty >= greatest(0, floor(t * lines / 64)) AND ty < least(ceil(lines / 64), ceil((t + greatest(m - t, 0)) * lines / 64))""")
def p11(spark, d):
    n = F.col("n_nationkey")
    s = table(spark, d, "nation").select(n.alias("id"), (100 + n * 37).alias("samples"), (900 - n * 21).alias("lines"), viewport.view(1 + n / 4, (n % 5 - 2) / 10, (n % 3 - 1) / 10).alias("v"))
    a = viewport.aspect(F.col("samples"), F.col("lines"), F.lit(640), F.lit(480))
    s = s.withColumn("bounds", viewport.visible_bounds(F.col("v"), a))
    x0, x1 = viewport.visible_span(F.col("bounds.x"), F.col("bounds.width"), F.col("samples"), 64)
    y0, y1 = viewport.visible_span(F.col("bounds.y"), F.col("bounds.height"), F.col("lines"), 64)
    span = lambda lo, hi: F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    return s.select("id", F.explode(span(x0, x1)).alias("tx"), span(y0, y1).alias("ys")).select("id", "tx", F.explode("ys").alias("ty"))


# ---- joins ---------------------------------------------------------------------------------------


@query("j01_spectrum_wavelength", f"WITH {PX} SELECT band, 390.0 + 10 * band AS wavelength, value::DOUBLE AS value FROM px WHERE x = 2 AND y = 1")
def j01(spark, d):
    return make_cube(spark, d).profile(2, 1).select("band", "wavelength", F.col("value").cast(D).alias("value"))


@query("j02_probe_wavelengths", f"WITH {PX} SELECT band, CASE WHEN band % 5 <> 0 AND band <= 60 THEN 390.0 + 10 * band END AS wavelength, value::DOUBLE AS value FROM px WHERE x = 2 AND y = 1")
def j02(spark, d):
    w = F.array(*(F.lit(float("nan") if b % 5 == 0 else 390.0 + 10 * b) for b in range(1, 61)))
    at = F.try_element_at(w, F.col("band"))
    return make_cube(spark, d).spectrum(2, 1).select("band", F.when(stretch.is_finite(at), at).alias("wavelength"), F.col("value").cast(D).alias("value"))


#: What is cached of the bands: limits of some, of others a null.
CACHED_SQL = f"{PX}, ch AS (SELECT band, CASE WHEN band % 3 = 0 THEN max(value) END AS min FROM px WHERE band % 2 = 0 GROUP BY band)"


def cached_bands(spark, d) -> DataFrame:
    return pixels(spark, d).where("band % 2 = 0").groupBy("band").agg(F.max(F.when(F.col("band") % 3 == 0, F.col("value"))).alias("min"))


@query("j03_missing_stats", f"WITH {CACHED_SQL} SELECT count(*) = 0 AS ready, string_agg(band, ',' ORDER BY band) AS missing FROM (SELECT DISTINCT band FROM px) WHERE band NOT IN (SELECT band FROM ch WHERE min IS NOT NULL)")
def j03(spark, d):
    plan = caching.stats_plan(pixels(spark, d).select("band"), cached_bands(spark, d))
    return plan.select("ready", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


STATS_SQL = f"""{PX}, {DIM}, g AS (SELECT samples, lines, ceil(samples / 8.0)::INT - 1 AS mx, ceil(lines / 8.0)::INT - 1 AS my FROM dim),
t AS (SELECT DISTINCT unnest([[0, 0], [mx, my], [mx // 2, my // 2], [mx, 0], [0, my]]) AS t FROM g),
c AS (SELECT band, count(*) AS n, sum(value::DOUBLE) AS s, sum(value::DOUBLE * value::DOUBLE) AS q FROM px JOIN t ON x // 8 = t[1] AND y // 8 = t[2] GROUP BY band, t),
l AS (SELECT band, s / n AS m, sqrt(greatest((q - s * s / n) / n, 0)) AS sd FROM c),
st AS (SELECT band, min(m - 2 * sd) AS lo, max(m + 2 * sd) AS hi FROM l GROUP BY band)"""


@query("q03_sampled_band_stats", f"WITH {STATS_SQL} SELECT band, round(lo, 6) AS min, round(hi, 6) AS max FROM st")
def q03(spark, d):
    return make_cube(spark, d).band_stats(size=SIZE).select("band", r6(F.col("min"), "min"), r6(F.col("max"), "max"))


Q01_SQL = f"""WITH {STATS_SQL}, s6 AS (SELECT band, round(lo, 6)::FLOAT AS lo, round(hi, 6)::FLOAT AS hi FROM st WHERE band IN (26, 16, 8)),
n AS (SELECT x, y, band, least(greatest((value - lo) / greatest(hi - lo, 1e-9::FLOAT), 0::FLOAT), 1::FLOAT)::FLOAT AS t FROM px JOIN s6 USING (band))
SELECT x, y, max(floor(t::DOUBLE * 255 + 0.5)) FILTER (band = 26)::INT AS r, max(floor(t::DOUBLE * 255 + 0.5)) FILTER (band = 16)::INT AS g, max(floor(t::DOUBLE * 255 + 0.5)) FILTER (band = 8)::INT AS b, 255 AS a FROM n {{where}} GROUP BY x, y"""


def composite(spark, d, tile=None) -> DataFrame:
    c = make_cube(spark, d)
    kept = c.keep_stats([26, 16, 8], size=SIZE)
    c.stored = {b: (round(lo, 6), round(hi, 6)) for b, (lo, hi) in kept.items()}
    return c.composite(26, 16, 8, tile, SIZE)


@query("q01_rgb_composite", Q01_SQL.format(where=""))
def q01(spark, d):
    return composite(spark, d)


@query("q01_rgb_tile", Q01_SQL.format(where="WHERE x // 8 = 1 AND y // 8 = 1"))
def q01_tile(spark, d):
    return composite(spark, d, (1, 1))


@query("j04_stretch_join", f"""WITH {STATS_SQL}, s6 AS (SELECT band, round(lo, 6)::FLOAT AS lo, round(hi, 6)::FLOAT AS hi FROM st)
SELECT band, count(*) AS n, sum(floor(least(greatest(((value - lo) / greatest(hi - lo, 1e-9::FLOAT))::FLOAT, 0::FLOAT), 1::FLOAT)::DOUBLE * 255 + 0.5)::INT)::BIGINT AS total FROM px JOIN s6 USING (band) GROUP BY band""")
def j04(spark, d):
    c = make_cube(spark, d)
    s = F.broadcast(c.band_stats(size=SIZE).select("band", F.round("min", 6).alias("lo"), F.round("max", 6).alias("hi")))  # a row a band
    t = stretch.quantise(stretch.stretch(F.col("value"), F.col("lo"), F.col("hi")))
    return c.pixels.join(s, "band").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("total"))


@query("j06_missing_tiles", f"WITH {DIM} SELECT tx::INT AS tx, ty::INT AS ty FROM dim, range(0, 4) p(tx), range(0, ceil(lines / 8.0)::INT) q(ty) WHERE NOT (tx = 1 AND ty IN (0, 1))")
def j06(spark, d):
    c = make_cube(spark, d).header
    cached = spark.createDataFrame([(1, 0), (1, 1)], "tx int, ty int")
    return viewing.missing_tiles(spark, c.samples, c.lines, SIZE, (640, 480), viewport.view(*viewport.HOME), cached).select("tx", "ty")


@query("q08_preload_plan", f"""WITH {DIM}, g AS (SELECT tx::INT AS tx, ty::INT AS ty FROM dim, range(0, 4) p(tx), range(0, ceil(lines / 8.0)::INT) q(ty)), v AS (SELECT * FROM g WHERE tx < 2 AND ty < 2),
c AS (SELECT floor(avg(tx))::INT AS cx, floor(avg(ty))::INT AS cy FROM v)
SELECT tx, ty, (abs(tx - cx) + abs(ty - cy))::INT AS distance FROM g, c WHERE NOT (tx < 2 AND ty < 2) AND NOT (tx = 2 AND ty = 0)""")
def q08(spark, d):
    c = make_cube(spark, d).header
    g = tiles.tile_grid(spark, c.samples, c.lines, SIZE)
    return viewing.preload(g, g.where("tx < 2 and ty < 2"), g.where("tx = 2 and ty = 0")).select("tx", "ty", F.col("distance").cast("int").alias("distance"))


@query("a06_visible_centre", f"WITH {DIM} SELECT floor(avg(tx))::BIGINT AS cx, floor(avg(ty))::BIGINT AS cy FROM dim, range(0, 4) p(tx), range(0, ceil(lines / 8.0)::INT) q(ty) WHERE tx >= 1")
def a06(spark, d):
    c = make_cube(spark, d).header
    cx, cy = viewing.centre(tiles.tile_grid(spark, c.samples, c.lines, SIZE).where("tx >= 1"))
    return spark.createDataFrame([(cx, cy)], "cx long, cy long")


@query("j10_nearest_bands", """WITH n AS (SELECT n_nationkey AS id, 380 + n_nationkey * 17 AS base, 3 + n_nationkey % 9 AS step FROM nation), w AS (SELECT id, b, base + step * b * 1.0 AS w FROM n, range(1, 41) t(b)),
e AS (SELECT id, min(w) AS lo, max(w) AS hi FROM w GROUP BY id), t AS (SELECT id, CASE WHEN lo <= 480 AND hi >= 650 THEN [650.0, 550.0, 470.0] ELSE [lo + (hi - lo) * 0.75, lo + (hi - lo) * 0.5, lo + (hi - lo) * 0.25] END AS t FROM e),
r AS (SELECT id, arg_min(b, (abs(w - t[1]), b)) AS r FROM w JOIN t USING (id) GROUP BY id), g AS (SELECT id, arg_min(b, (abs(w - t[2]), b)) AS g FROM w JOIN t USING (id) JOIN r USING (id) WHERE b <> r GROUP BY id),
b AS (SELECT id, arg_min(b, (abs(w - t[3]), b)) AS b FROM w JOIN t USING (id) JOIN r USING (id) JOIN g USING (id) WHERE b <> r AND b <> g GROUP BY id)
SELECT id, r::INT AS r, g::INT AS g, b.b::INT AS b FROM r JOIN g USING (id) JOIN b USING (id)""")
def j10(spark, d):
    n = F.col("n_nationkey")
    w = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda b: (380 + n * 17 + (3 + n % 9) * b).cast(D))
    got = bands.wavelength_bands(w, F.lit(40), F.lit("nm"))
    return table(spark, d, "nation").select(n.alias("id"), got.alias("g")).select("id", "g.r", "g.g", "g.b")


@query("q06_default_bands", """WITH n AS (SELECT n_nationkey AS id FROM nation)
SELECT id, CASE id % 4 WHEN 0 THEN 12 WHEN 1 THEN 26 WHEN 2 THEN 30 ELSE 26 END AS r, CASE id % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 20 ELSE 16 END AS g, CASE id % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 10 ELSE 8 END AS b FROM n""")
def q06(spark, d):
    n = F.col("n_nationkey")
    field = F.when(n % 4 == 0, F.create_map(F.lit(" Default_Bands"), F.lit("{12, 8, 4}"))).when(n % 4 == 3, F.create_map(F.lit("default bands"), F.lit("{80, 40, 20}"))).otherwise(F.create_map(F.lit("wavelength units"), F.lit("Nanometers")))
    w = F.when(n % 4 != 2, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: (400 + 10 * b).cast(D)))
    return table(spark, d, "nation").select(n.alias("id"), bands.default_bands(F.lit(64), w, field).alias("g")).select("id", "g.r", "g.g", "g.b")


@query("j13_probe_rgb", f"WITH {PX} SELECT max(value) FILTER (band = 26)::DOUBLE AS r, max(value) FILTER (band = 16)::DOUBLE AS g, max(value) FILTER (band = 8)::DOUBLE AS b FROM px WHERE x = 5 AND y = 5")
def j13(spark, d):
    return wide(spark, d).where("x = 5 and y = 5").select(*(F.element_at("spectrum", n).cast(D).alias(c) for c, n in (("r", 26), ("g", 16), ("b", 8))))


@query("q05_pixel_probe", f"WITH {PX} SELECT 3 AS x, 2 AS y, 500090.0 AS wx, 4099940.0 AS wy, band, 390.0 + 10 * band AS wavelength, value::DOUBLE AS value FROM px WHERE x = 3 AND y = 2")
def q05(spark, d):
    p = make_cube(spark, d).probe(3, 2)
    return p.select("x", "y", F.col("world.x").alias("wx"), F.col("world.y").alias("wy"), F.explode("spectrum").alias("s")).select("x", "y", "wx", "wy", "s.band", "s.wavelength", F.col("s.value").cast(D).alias("value"))


# ---- aggregates ----------------------------------------------------------------------------------


@query("a01_chunk_limits", f"""WITH {PX}, v AS (SELECT x, y, band, CASE WHEN x < 8 AND y < 8 AND band = 2 THEN 'NaN'::DOUBLE ELSE value::DOUBLE END AS v FROM px),
c AS (SELECT band, x // 8 AS tx, y // 8 AS ty, count(*) FILTER (isfinite(v)) AS n, sum(v) FILTER (isfinite(v)) AS s, sum(v * v) FILTER (isfinite(v)) AS q FROM v GROUP BY ALL)
SELECT band, tx, ty, n, CASE WHEN n = 0 THEN 0.0 ELSE round(s / n - 2 * sqrt(greatest((q - s * s / n) / n, 0)), 6) END AS low, CASE WHEN n = 0 THEN 255.0 ELSE round(s / n + 2 * sqrt(greatest((q - s * s / n) / n, 0)), 6) END AS high FROM c""")
def a01(spark, d):
    p = pixels(spark, d)
    v = F.when((F.col("x") < 8) & (F.col("y") < 8) & (F.col("band") == 2), F.lit(float("nan"))).otherwise(F.col("value").cast(D))
    tx, ty = tiles.tile_of(F.col("x"), F.col("y"), SIZE)
    return stats.chunk_limits(p.select("band", v.alias("value"), tx.alias("tx"), ty.alias("ty"))).select("band", "tx", "ty", "n", r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query("a03_pooled_stats", f"WITH {PX} SELECT band, count(*) AS n, round(avg(value::DOUBLE), 6) AS mean, round(stddev_pop(value::DOUBLE), 6) AS sd, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max FROM px GROUP BY band")
def a03(spark, d):
    return stats.pooled_stats(pixels(spark, d)).select("band", "n", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), "min", "max")


@query("a04_nearest_rank_limits", f"""WITH {PX}, r AS (SELECT band, value::DOUBLE AS v, row_number() OVER (PARTITION BY band ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY band) AS n FROM px)
SELECT band, max(v) FILTER (rn = least(floor(n::FLOAT * (2::FLOAT / 100::FLOAT)), n - 1)) AS low, max(v) FILTER (rn = least(ceil(n::FLOAT * (98::FLOAT / 100::FLOAT)), n - 1)) AS high FROM r GROUP BY band""")
def a04(spark, d):
    return stats.nearest_rank(pixels(spark, d))


@query("a05_summaries", f"WITH {PX} SELECT band, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, count(*) AS n, '400 - 1030 nm (64 bands)' AS axis FROM px GROUP BY band")
def a05(spark, d):
    w = F.array(*(F.lit(400.0 + 10 * b) for b in range(BANDS)))
    return pixels(spark, d).groupBy("band").agg(F.min("value").cast(D).alias("low"), F.max("value").cast(D).alias("high"), F.count(F.lit(1)).alias("n")).withColumn("axis", text.wavelength_summary(w, F.lit("Nanometers")))


# ---- stretch, geometry, offsets ------------------------------------------------------------------


@query("f05_f07_stretch_quantise", f"""WITH {PX}, v AS (SELECT x, y, band, CASE WHEN (x + band) % 13 = 0 THEN 'NaN'::FLOAT WHEN (y + band) % 17 = 0 THEN 'Infinity'::FLOAT ELSE value END AS v FROM px)
SELECT x, y, band, CASE WHEN isnan(v) THEN 0 ELSE floor(least(greatest(((v - -0.2::FLOAT) / 0.4::FLOAT)::FLOAT, 0::FLOAT), 1::FLOAT)::DOUBLE * 255 + 0.5) END::INT AS q FROM v""")
def f05(spark, d):
    v = F.when((F.col("x") + F.col("band")) % 13 == 0, F.lit(float("nan")).cast("float")).when((F.col("y") + F.col("band")) % 17 == 0, F.lit(float("inf")).cast("float")).otherwise(F.col("value"))
    p = pixels(spark, d).select("x", "y", "band", v.alias("v"))
    return p.select("x", "y", "band", stretch.quantise(stretch.stretch(F.col("v"), F.lit(-0.2), F.lit(0.2))).alias("q"))


@query("f06_percentile_stretch", f"""WITH {PX}, r AS MATERIALIZED (SELECT x, y, band, value, row_number() OVER (PARTITION BY band ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY band) AS n FROM px),
l AS MATERIALIZED (SELECT band, max(value) FILTER (rn = least(floor(n::FLOAT * (2::FLOAT / 100::FLOAT)), n - 1)) AS lo, max(value) FILTER (rn = least(ceil(n::FLOAT * (98::FLOAT / 100::FLOAT)), n - 1)) AS hi FROM r GROUP BY band)
SELECT x, y, band, floor(least(greatest(((value - lo) / greatest(hi - lo, 1e-9::FLOAT))::FLOAT, 0::FLOAT), 1::FLOAT)::DOUBLE * 255 + 0.5)::INT AS q FROM r JOIN l USING (band)""")
def f06(spark, d):
    p = pixels(spark, d)
    lim = F.broadcast(stats.nearest_rank(p))  # a row a band
    return p.join(lim, "band").select("x", "y", "band", stretch.quantise(stretch.stretch(F.col("value"), F.col("low"), F.col("high"))).alias("q"))


@query("f02_f03_world_of_pixel", f"WITH {PX} SELECT DISTINCT x, y, 500000.0 + 30 * x AS wx, 4100000.0 - 30 * y AS wy FROM px")
def f03(spark, d):
    return make_cube(spark, d).with_world(wide(spark, d).select("x", "y")).select("x", "y", F.col("world.x").alias("wx"), F.col("world.y").alias("wy"))


@query("f04_pixel_of_world", "SELECT o_orderkey, round((500000 + o_custkey * 7.5 - 500000.0) / 30, 6) AS px, round((4100000 - o_totalprice - 4100000.0) / -30, 6) AS py FROM orders")
def f04(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (500000 + F.col("o_custkey") * 7.5).alias("wx"), (4100000 - F.col("o_totalprice")).alias("wy"))
    return make_cube(spark, d).with_pixel(o, "wx", "wy").select("o_orderkey", r6(F.col("pixel.x"), "px"), r6(F.col("pixel.y"), "py"))


@query("f04_singular_affine", "SELECT n_nationkey AS id, n_nationkey % 2 = 1 AS has_inverse FROM nation")
def f04_singular(spark, d):
    n = F.col("n_nationkey")
    a = F.when(n % 2 == 1, F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0, 2.0, 5.0)))).otherwise(F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0, 2.0, 4.0))))
    return table(spark, d, "nation").select(n.alias("id"), geo.world_to_pixel(a, n, n).isNotNull().alias("has_inverse"))


@query("p15_p16_f28_f29_map_info", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'UTM' END AS projection, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 30.0 END AS size_x, CASE n_nationkey % 5 WHEN 0 THEN 50 WHEN 3 THEN 11 END AS zone,
CASE n_nationkey % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' END AS hemisphere, CASE n_nationkey % 5 WHEN 0 THEN 'WGS-84' WHEN 1 THEN 'NAD27' WHEN 2 THEN 'WGS-84' END AS datum, CASE n_nationkey % 5 WHEN 0 THEN 'Meters' WHEN 2 THEN 'Degrees' END AS units FROM nation""")
def f28(spark, d):
    fixed = "UTM, 1, 1, 500000, 4100000, 30, 30"
    texts = [f"{fixed}, 50, North, WGS-84, units=Meters", f"{fixed}, SOUTH, NAD27, rotation=3", f"{fixed}, WGS-84,, Units = Degrees", f"{fixed},11", "UTM, 1, x, 500000, 4100000, 30, 30, 50"]
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    i = geo.map_info(t)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), i.alias("i")).select("id", F.col("i.projection_name").alias("projection"), F.col("i.pixel_size.x").alias("size_x"), "i.zone", "i.hemisphere", "i.datum", "i.units")


@query("f36_crs_summary", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'UTM, Zone ' || n_nationkey + 1 || CASE WHEN n_nationkey % 2 = 0 THEN ' N' ELSE ' S' END || ', WGS-84, Meters' WHEN n_nationkey % 3 = 1 THEN 'coordinate system string present' ELSE '--' END AS summary FROM nation""")
def f36(spark, d):
    n = F.col("n_nationkey")
    whole = F.concat(F.lit("UTM, 1, 1, 500000, 4100000, 30, 30, "), (n + 1).cast("string"), F.when(n % 2 == 0, ", North").otherwise(", South"), F.lit(", WGS-84, units=Meters"))
    info = geo.map_info(F.when(n % 3 == 0, whole).otherwise("UTM"))
    return table(spark, d, "nation").select(n.alias("id"), geo.crs_summary(info, F.when(n % 3 == 1, F.lit("PROJCS[]"))).alias("summary"))


@query("f41_spatial_precedence", "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN '1.0,2.0,0.0,3.0,0.0,-2.0' WHEN 1 THEN '500000.0,30.0,0.0,4100000.0,0.0,-30.0' END AS affine FROM nation")
def f41(spark, d):
    n = F.col("n_nationkey")
    own = F.when(n % 3 == 0, F.array(*map(F.lit, (1.0, 2.0, 0.0, 3.0, 0.0, -2.0)))).otherwise(F.array(F.lit(1.0), F.lit(float("nan"))))
    read = table(spark, d, "nation").select(n.alias("id"), own.alias("own"), geo.map_info(F.when(n % 3 != 2, F.lit(MAP_INFO))).alias("info"))
    shown = F.array_join(F.transform("affine", lambda v: F.format_string("%.1f", v)), ",")
    return read.select("id", F.coalesce(geo.valid_affine(F.col("own")), geo.affine_of(F.col("info"))).alias("affine")).select("id", F.when(F.col("affine").isNotNull(), shown).alias("affine"))


@query("f08_tile_grid", f"WITH {DIM} SELECT tx::INT AS tx, ty::INT AS ty, (least((tx + 1) * 8, samples) - tx * 8)::INT AS eff_w, (least((ty + 1) * 8, lines) - ty * 8)::INT AS eff_h FROM dim, range(0, 4) p(tx), range(0, ceil(lines / 8.0)::INT) q(ty)")
def f08(spark, d):
    c = make_cube(spark, d).header
    return tiles.tile_grid(spark, c.samples, c.lines, SIZE)


@query("f09_local_index", f"WITH {PX} SELECT DISTINCT x, y, x // 8 AS tx, y // 8 AS ty, ((y % 8) * (least((x // 8 + 1) * 8, 25) - x // 8 * 8) + x % 8)::BIGINT AS i FROM px")
def f09(spark, d):
    tx, ty = tiles.tile_of(F.col("x"), F.col("y"), SIZE)
    return wide(spark, d).select("x", "y", tx.alias("tx"), ty.alias("ty"), tiles.local_index(F.col("x"), F.col("y"), F.lit(SAMPLES), SIZE).alias("i"))


@query("f10_cell_offsets", """SELECT o_orderkey, l AS layout, 4294967424 + 2 * CASE l WHEN 'bsq' THEN (b * 800 + y) * 1000 + x WHEN 'bil' THEN (y * 64 + b) * 1000 + x ELSE (y * 1000 + x) * 64 + b END AS at
FROM (SELECT o_orderkey, o_orderkey % 1000 AS x, o_custkey % 800 AS y, o_orderkey % 64 AS b FROM orders), (SELECT unnest(['bsq', 'bil', 'bip']) AS l)""")
def f10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("x"), (F.col("o_custkey") % 800).alias("y"), (F.col("o_orderkey") % 64).alias("b"), F.explode(F.array(*map(F.lit, ("bsq", "bil", "bip")))).alias("layout"))
    n = lambda v: F.lit(v).cast("long")
    return o.select("o_orderkey", "layout", tiles.cell_offset(F.col("layout"), F.col("x"), F.col("y"), F.col("b"), n(1000), n(800), n(64), n(2), n(2**32 + 128)).alias("at"))


@query("s17_strip_ranges", """SELECT n_nationkey AS id, CASE WHEN n_nationkey * 8 < 100 THEN 128 + (3 * 100 + n_nationkey * 8) * 50 * 2 END::BIGINT AS s, CASE WHEN n_nationkey * 8 < 100 THEN 128 + (3 * 100 + n_nationkey * 8) * 50 * 2 + (least(n_nationkey * 8 + 8, 100) - n_nationkey * 8) * 50 * 2 END::BIGINT AS e FROM nation""")
def s17(spark, d):
    n = lambda v: F.lit(v).cast("long")
    s, e = tiles.strip_range(n(3), F.col("n_nationkey").cast("long"), n(50), n(100), n(2), n(128), 8)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), s.alias("s"), e.alias("e"))


@query("t02_sample_tiles", f"""WITH RECURSIVE {DIM}, g AS (SELECT ceil(samples / 8.0)::INT - 1 AS mx, ceil(lines / 8.0)::INT - 1 AS my FROM dim), c AS (SELECT unnest(range(1, 8)) AS o, unnest([[0, 0], [mx, my], [mx // 2, my // 2], [mx, 0], [0, my], [mx // 4, my // 4], [mx * 3 // 4, my * 3 // 4]]) AS t FROM g
UNION ALL SELECT 8 + ty * (mx + 1) + tx, [tx::INT, ty::INT] FROM g, range(0, mx + 1) p(tx), range(0, my + 1) q(ty)), f AS (SELECT t, min(o) AS o FROM c GROUP BY t),
r AS (SELECT t, row_number() OVER (ORDER BY o)::INT AS place FROM f QUALIFY place <= 9) SELECT place, t[1]::INT AS tx, t[2]::INT AS ty, count(*) AS n FROM r JOIN embeddings ON vec_id % 25 // 8 = t[1] AND vec_id // 25 // 8 = t[2] GROUP BY ALL""")
def t02(spark, d):
    c = make_cube(spark, d)
    order = tiles.sample_tiles(c.header.samples, c.header.lines, SIZE, 9)
    inside = stats.in_tiles(c.wide, order, SIZE)
    place = F.array_position(F.array(*(F.struct(F.lit(x).alias("tx"), F.lit(y).alias("ty")) for x, y in order)), F.struct("tx", "ty")).cast("int")
    return inside.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)


VIEW_SQL = """s AS (SELECT o_orderkey, 200 + o_orderkey % 700 AS samples, 100 + o_custkey % 500 AS lines, 1 + o_orderkey % 5 AS scale, (o_custkey % 7 - 3) / 10.0 AS ox, (o_orderkey % 5 - 2) / 10.0 AS oy, o_orderkey % 640 AS cx, o_custkey % 480 AS cy FROM orders),
a AS (SELECT *, samples / lines AS ia, 640 / 480 AS ca FROM s), b AS (SELECT *, CASE WHEN ia > ca THEN 1.0::DOUBLE ELSE ia / ca END AS ax, CASE WHEN ia > ca THEN ca / ia ELSE 1.0::DOUBLE END AS ay FROM a)"""


def views(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = table(spark, d, "orders").select("o_orderkey", (200 + k % 700).alias("samples"), (100 + c % 500).alias("lines"), viewport.view(1 + k % 5, (c % 7 - 3) / 10, (k % 5 - 2) / 10).alias("v"), (k % 640).alias("cx"), (c % 480).alias("cy"))
    return s.withColumn("a", viewport.aspect(F.col("samples"), F.col("lines"), F.lit(640), F.lit(480)))


@query("f11_aspect", f"WITH {VIEW_SQL} SELECT o_orderkey, round(ax, 6) AS ax, round(ay, 6) AS ay FROM b")
def f11(spark, d):
    return views(spark, d).select("o_orderkey", r6(F.col("a.x"), "ax"), r6(F.col("a.y"), "ay"))


@query("f12_visible_bounds", f"""WITH {VIEW_SQL}, u AS (SELECT *, greatest(0.0, least(1.0, ((-1 - ox) / scale / ax + 1) / 2)) AS l, greatest(0.0, least(1.0, ((1 - ox) / scale / ax + 1) / 2)) AS r, greatest(0.0, least(1.0, ((1 - oy) / scale / -ay + 1) / 2)) AS t, greatest(0.0, least(1.0, ((-1 - oy) / scale / -ay + 1) / 2)) AS m FROM b)
SELECT o_orderkey, floor(l * 1e6 + 0.001)::BIGINT AS bx, floor(t * 1e6 + 0.001)::BIGINT AS by, floor(greatest(r - l, 0) * 1e6 + 0.001)::BIGINT AS bw, floor(greatest(m - t, 0) * 1e6 + 0.001)::BIGINT AS bh FROM u""")
def f12(spark, d):
    b = viewport.visible_bounds(F.col("v"), F.col("a"))
    return views(spark, d).withColumn("b", b).select("o_orderkey", *(F.floor(F.col(f"b.{c}") * 1e6 + 0.001).alias(n) for c, n in (("x", "bx"), ("y", "by"), ("width", "bw"), ("height", "bh"))))


@query("f13_canvas_to_pixel", f"""WITH {VIEW_SQL}, u AS (SELECT *, floor((((cx / 640 * 2 - 1) - ox) / scale / ax + 1) / 2 * samples) AS x, floor((((cy / 480 * -2 + 1) - oy) / scale / -ay + 1) / 2 * lines) AS y FROM b)
SELECT o_orderkey, CASE WHEN x >= 0 AND x < samples AND y >= 0 AND y < lines THEN x END::INT AS x, CASE WHEN x >= 0 AND x < samples AND y >= 0 AND y < lines THEN y END::INT AS y FROM u""")
def f13(spark, d):
    p = viewport.canvas_to_pixel(F.col("cx"), F.col("cy"), F.lit(640), F.lit(480), F.col("samples"), F.col("lines"), F.col("v"))
    return views(spark, d).withColumn("p", p).select("o_orderkey", "p.x", "p.y")


@query("f14_f15_zoom_pan", """WITH s AS (SELECT o_orderkey, 1.5 + o_orderkey % 3 AS z, (o_custkey % 5 - 2) / 4.0 AS p FROM orders), a AS (SELECT *, greatest(1.0, z) AS s1, -0.2 * z + 0.2 AS x1, -0.1 * z + 0.1 AS y1 FROM s),
b AS (SELECT *, greatest(-(s1 - 1), least(s1 - 1, x1 + p)) AS x2, greatest(-(s1 - 1) * 0.5, least((s1 - 1) * 0.5, y1 - p)) AS y2 FROM a)
SELECT o_orderkey, round(CASE WHEN s1 * 0.5 <= 1 THEN 1.0 ELSE s1 * 0.5 END, 6) AS scale, round(CASE WHEN s1 * 0.5 <= 1 THEN 0 ELSE x2 * 0.5 END, 6) AS offset_x, round(CASE WHEN s1 * 0.5 <= 1 THEN 0 ELSE y2 * 0.5 END, 6) AS offset_y FROM b""")
def f14(spark, d):
    z, p = 1.5 + F.col("o_orderkey") % 3, (F.col("o_custkey") % 5 - 2) / 4
    step = lambda kind, *v: F.struct(F.lit(kind).alias("kind"), *((x if hasattr(x, "cast") else F.lit(x)).cast(D).alias(n) for n, x in zip("pqr", v, strict=True)))
    steps = F.array(step("zoom", z, 0.2, 0.1), step("pan", p, p, 0.0), step("zoom", 0.5, 0.0, 0.0))
    v = viewport.replay(steps, F.struct(F.lit(1.0).alias("x"), F.lit(0.5).alias("y")))
    return table(spark, d, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", r6(F.col("v.scale"), "scale"), r6(F.col("v.offset_x"), "offset_x"), r6(F.col("v.offset_y"), "offset_y"))


@query("f16_initial_scale", "SELECT o_orderkey, round(greatest(s / least(s, 2048), l / least(l, 2048)), 6) AS scale FROM (SELECT o_orderkey, 1 + o_orderkey % 9000 AS s, 1 + o_custkey * 3 AS l FROM orders)")
def f16(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r6(viewport.initial_scale(1 + F.col("o_orderkey") % 9000, 1 + F.col("o_custkey") * 3), "scale"))


@query("f17_tile_to_clip", f"""WITH {VIEW_SQL} SELECT o_orderkey, round(64 / samples * ax * scale, 6) AS sx, round(64 / lines * ay * scale, 6) AS sy, round(((64 + 32) / samples * 2 - 1) * ax * scale + ox, 6) AS cx, round((1 - 32 / lines * 2) * ay * scale + oy, 6) AS cy FROM b""")
def f17(spark, d):
    c = viewport.tile_to_clip(F.lit(1), F.lit(0), F.lit(64), F.lit(64), F.col("samples"), F.col("lines"), 64, F.col("v"), F.col("a"))
    return views(spark, d).withColumn("c", c).select("o_orderkey", r6(F.col("c.scale_x"), "sx"), r6(F.col("c.scale_y"), "sy"), r6(F.col("c.offset_x"), "cx"), r6(F.col("c.offset_y"), "cy"))


@query("f19_f20_targets", """SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 1.0 ELSE 0.001 END AS scale, CASE n_nationkey % 3 WHEN 0 THEN '650.0,550.0,470.0' WHEN 1 THEN '0.65,0.55,0.47' ELSE '2.0,1.5,1.25' END AS targets FROM nation WHERE n_nationkey % 3 < 2
UNION ALL SELECT n_nationkey, 0.001, '2.0,1.75,1.5' FROM nation WHERE n_nationkey % 3 = 2""")
def f19(spark, d):
    n = F.col("n_nationkey")
    units = F.element_at(F.array(F.lit("Nanometers"), F.lit("um"), F.lit("")), (n % 3 + 1).cast("int"))
    low, high = (F.element_at(F.array(*map(F.lit, v)), (n % 3 + 1).cast("int")) for v in ((400.0, 0.4, 1.25), (1000.0, 1.0, 2.25)))
    scale = bands.unit_scale(units.substr(1, 9), high)
    scale = bands.unit_scale(F.lower(F.regexp_replace(units, "Nanometers", "nanometers")), high)
    t = bands.rgb_targets(low, high, scale)
    return table(spark, d, "nation").select(n.alias("id"), scale.alias("scale"), F.array_join(F.transform(t, lambda v: F.round(v, 6).cast("string")), ",").alias("targets"))


@query("f21_fallback_bands", "SELECT n_nationkey + 1 AS n, CASE WHEN n < 3 THEN n ELSE n END::INT AS r, CASE WHEN n <= 2 THEN 1 ELSE ceil(n / 2.0) END::INT AS g, 1 AS b FROM (SELECT n_nationkey, n_nationkey + 1 AS n FROM nation)")
def f21(spark, d):
    n = F.col("n_nationkey") + 1
    return table(spark, d, "nation").select(n.alias("n"), bands.fallback_bands(n).alias("g")).select("n", "g.r", "g.g", "g.b")


@query("u01_f26_f27_band_lists", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '12,8,4' ELSE '3,-1,3,7' END AS listed, CASE WHEN n_nationkey % 2 = 0 THEN '12,8,4' ELSE '3,7' END AS once, 'default bands' AS key FROM nation""")
def u01(spark, d):
    t = F.when(F.col("n_nationkey") % 2 == 0, "{12, 8 4}").otherwise("3 -1,3, x 7 2.5")
    join = lambda a: F.array_join(a.cast("array<string>"), ",")
    parts = F.split(F.regexp_replace(t, "[{}]", " "), r"[,\s]+")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), join(bands.band_list(t)).alias("listed"), join(bands.unique_bands(parts)).alias("once"), bands.field_key(F.lit("  Default__bands ")).alias("key"))


@query("a11_background_stats", f"WITH {CACHED_SQL}, w AS (SELECT DISTINCT band FROM px WHERE band NOT IN (SELECT band FROM ch WHERE min IS NOT NULL)) SELECT band, row_number() OVER (ORDER BY band)::INT AS processed, count(*) OVER () AS total, round(row_number() OVER (ORDER BY band) / count(*) OVER () * 100, 6) AS progress FROM w")
def a11(spark, d):
    got = viewing.background_stats(pixels(spark, d).select("band").distinct(), cached_bands(spark, d).where("min is not null"))
    return got.select("band", "processed", "total", r6(F.col("progress"), "progress"))


@query("f24_chart_points", f"WITH {PX}, s AS (SELECT band, value::DOUBLE AS v FROM px WHERE x = 1 AND y = 1), e AS (SELECT min(v) AS lo, max(v) AS hi FROM s) SELECT band, round(34 + (band - 1) / 63 * 300, 4) AS cx, round(8 + (1 - (v - lo) / (hi - lo)) * 86, 4) AS cy FROM s, e")
def f24(spark, d):
    s = make_cube(spark, d).spectrum(1, 1).select("band", F.col("value").cast(D).alias("v"))
    w = Window.partitionBy()  # one pixel's bands
    cx = text.chart_point(F.col("band"), F.lit(1), F.lit(BANDS), 34.0, 300.0, False)
    cy = text.chart_point(F.col("v"), F.min("v").over(w), F.max("v").over(w), 8.0, 86.0, True)
    return s.select("band", F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"))


@query("s35_synthetic_cube", f"WITH {PX} SELECT x, y, band, (band * 100 + (13 * x + 17 * y + 7 * (band - 1)) % 97)::DOUBLE AS value, round(value::DOUBLE, 6) AS beside FROM px")
def s35(spark, d):
    """The formula's cube, as large as the table's, beside the table's own values."""
    from ..sources.synthetic import pixels as synthetic

    h = make_cube(spark, d).header
    made = synthetic(spark, h.samples, h.lines, h.bands).select("x", "y", "band", F.col("value").cast(D).alias("value"))
    return made.join(pixels(spark, d).select("x", "y", "band", r6(F.col("value"), "beside")), ["x", "y", "band"])


# ---- cubes in files ------------------------------------------------------------------------------

FILE_STATS = f"""{FILE_PX}, g AS (SELECT 3 AS mx, ceil(lines / 8.0)::INT - 1 AS my, lines FROM fd), t AS (SELECT DISTINCT unnest([[0, 0], [mx, my], [mx // 2, my // 2], [mx, 0], [0, my]]) AS t FROM g),
ch AS (SELECT band, t, avg(value::DOUBLE) AS m, stddev_pop(value::DOUBLE) AS sd FROM px JOIN t ON x // 8 = t[1] AND y // 8 = t[2] GROUP BY ALL), st AS (SELECT band, round(min(m - 2 * sd), 6) AS min, round(max(m + 2 * sd), 6) AS max FROM ch GROUP BY band)"""


def register_files(layout: str) -> None:
    """Queries that read the cube's bytes in one layout: cells, a composite's tile, a pixel, statistics, chunks."""

    @query(f"s18_file_cells_{layout}", f"WITH {FILE_PX} SELECT x, y, band, value::DOUBLE AS value FROM px")
    def cells(spark, d):
        return file_cube(spark, d, layout).cells().select("x", "y", "band", F.col("value").cast(D).alias("value"))

    @query(f"q01_file_tile_{layout}", f"""WITH {FILE_STATS}, n AS (SELECT x, y, band, least(greatest((value - min::FLOAT) / greatest(max::FLOAT - min::FLOAT, 1e-9::FLOAT), 0::FLOAT), 1::FLOAT)::FLOAT AS t FROM px JOIN st USING (band) WHERE x // 8 = 1 AND y // 8 = 0)
SELECT x, y, max(floor(t::DOUBLE * 255 + 0.5)) FILTER (band = 26)::INT AS r, max(floor(t::DOUBLE * 255 + 0.5)) FILTER (band = 16)::INT AS g, max(floor(t::DOUBLE * 255 + 0.5)) FILTER (band = 8)::INT AS b, 255 AS a FROM n GROUP BY x, y""")
    def tile(spark, d):
        c = file_cube(spark, d, layout)
        c.stored = {b: (round(lo, 6), round(hi, 6)) for b, (lo, hi) in c.keep_stats([26, 16, 8], size=SIZE).items()}
        return c.composite(26, 16, 8, (1, 0), SIZE)

    @query(f"q02_file_pixel_{layout}", f"WITH {FILE_PX} SELECT band, (390 + 10 * band)::DOUBLE AS wavelength, value::DOUBLE AS value FROM px WHERE x = 7 AND y = 5")
    def pixel(spark, d):
        return file_cube(spark, d, layout).profile(7, 5).select("band", "wavelength", F.col("value").cast(D).alias("value"))

    @query(f"q03_file_stats_{layout}", f"WITH {FILE_STATS} SELECT band, min, max FROM st")
    def file_stats(spark, d):
        return file_cube(spark, d, layout).band_stats(size=SIZE).select("band", r6(F.col("min"), "min"), r6(F.col("max"), "max"))

    @query(f"q04_chunk_profile_{layout}", f"WITH {FILE_PX} SELECT band, value::DOUBLE AS value FROM px WHERE x = 11 AND y = 4")
    def chunk_profile(spark, d):
        c = file_cube(spark, d, layout)
        return chunks.chunk_profile(chunks.byte_chunks(spark, c.options["data"], 3000), c.header, 11, 4).select("band", F.col("value").cast(D).alias("value"))

    @query(f"s25_chunk_rgb_{layout}", f"WITH {FILE_PX} SELECT x, y, max(value) FILTER (band = 26)::DOUBLE AS r, max(value) FILTER (band = 16)::DOUBLE AS g, max(value) FILTER (band = 8)::DOUBLE AS b FROM px GROUP BY x, y")
    def chunk_rgb(spark, d):
        c = file_cube(spark, d, layout)
        return chunks.chunk_rgb(chunks.byte_chunks(spark, c.options["data"], 3000), c.header, 26, 16, 8).select("x", "y", *(F.col(n).cast(D).alias(n) for n in "rgb"))


for _layout in ("bsq", "bil", "bip"):
    register_files(_layout)


@query("q04_spectral_profile", f"WITH {FILE_PX} SELECT band, 390.0 + 10 * band AS wavelength, value::DOUBLE AS value FROM px WHERE x = 7 AND y = 5")
def q04(spark, d):
    c = file_cube(spark, d, "bip")
    p = chunks.chunk_profile(chunks.byte_chunks(spark, c.options["data"], 4096), c.header, 7, 5).where("error is null")
    return p.join(F.broadcast(c.wavelengths()), "band").select("band", "wavelength", F.col("value").cast(D).alias("value"))


@query("q09_stored_stats", f"WITH {STATS_SQL} SELECT band, round(lo, 6) AS min, round(hi, 6) AS max, band IN (8, 16, 26) AS first FROM st WHERE band % 2 = 0")
def q09(spark, d):
    """Limits worked out for a first view, then for every second band: the first three come from the table."""
    store = StatsStore(spark, shared_folder(spark))
    c = make_cube(spark, d)
    first = [r.band for r in store.ensure(1, c, [26, 16, 8], size=SIZE).select("band").collect()]
    every = store.ensure(1, c, list(range(2, BANDS + 1, 2)), size=SIZE)
    return every.select("band", r6(F.col("min"), "min"), r6(F.col("max"), "max"), F.col("band").isin(first).alias("first"))


#: Lines that are whole in a payload stored by pixel without its last third.
SHORT_SQL = f"{FILE_STATS}, whole AS (SELECT lines, (lines * 2 * 25 * 64 * 4 // 3) // (25 * 64 * 4) AS n FROM fd), ok AS (SELECT t FROM t, whole WHERE least(t[2] * 8 + 8, lines) <= n)"


@query("a03_skipped_tiles", f"WITH {SHORT_SQL} SELECT band, round(min(m - 2 * sd), 6) AS min, round(max(m + 2 * sd), 6) AS max FROM ch WHERE t IN (SELECT t FROM ok) GROUP BY band")
def a03_skipped(spark, d):
    return file_cube(spark, d, "bip", cut_short=True).band_stats(size=SIZE, permissive=True).select("band", r6(F.col("min"), "min"), r6(F.col("max"), "max"))


@query("a03_first_view", f"WITH {SHORT_SQL} SELECT band, round(min(m - 2 * sd), 6) AS min, round(max(m + 2 * sd), 6) AS max FROM ch, g WHERE t IN ([0, 0], [mx, my]) AND t IN (SELECT t FROM ok) AND band IN (26, 16, 8) GROUP BY band")
def a03_first(spark, d):
    return file_cube(spark, d, "bip", cut_short=True).first_stats([26, 16, 8], SIZE).select("band", r6(F.col("min"), "min"), r6(F.col("max"), "max"))


@query("a03_failed_tiles", f"WITH {SHORT_SQL} SELECT DISTINCT t[2]::INT AS ty FROM t WHERE t NOT IN (SELECT t FROM ok)")
def a03_failed(spark, d):
    return file_cube(spark, d, "bip", cut_short=True).failures(size=SIZE).select("ty").distinct()


@query("q02_pixel", f"WITH {PX} SELECT band, (390 + 10 * band)::DOUBLE AS wavelength, value::DOUBLE AS value FROM px WHERE x = 7 AND y = 5")
def q02(spark, d):
    return make_cube(spark, d).profile(7, 5).select("band", "wavelength", F.col("value").cast(D).alias("value"))
