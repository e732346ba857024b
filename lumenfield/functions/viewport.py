"""Viewport geometry as column expressions. A view is a struct (scale, offset_x, offset_y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME = (1.0, 0.0, 0.0)


def view(scale, x, y) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(c(scale).alias("scale"), c(x).alias("offset_x"), c(y).alias("offset_y"))


def aspect(samples: Column, lines: Column, width: Column, height: Column) -> Column:
    """(x, y) factors that keep the image's shape on the canvas; (1, 1) without a canvas."""
    image, canvas = samples / lines, F.try_divide(width, height)
    none = (F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0)
    x = F.when(none | (image > canvas), 1.0).otherwise(image / canvas)
    y = F.when(~none & (image > canvas), canvas / image).otherwise(1.0)
    return F.struct(x.alias("x"), y.alias("y"))


def unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def visible_bounds(v: Column, a: Column) -> Column:
    """What part of the image the canvas shows, (x, y, width, height) of 0..1."""
    edge_x = lambda side: unit(((F.lit(side) - v["offset_x"]) / v["scale"] / a["x"] + 1) / 2)
    edge_y = lambda side: unit(((F.lit(side) - v["offset_y"]) / v["scale"] / -a["y"] + 1) / 2)
    left, right, top, bottom = edge_x(-1.0), edge_x(1.0), edge_y(1.0), edge_y(-1.0)
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(right - left, F.lit(0.0)).alias("width"), F.greatest(bottom - top, F.lit(0.0)).alias("height"))


def visible_span(start: Column, length: Column, extent: Column, size: int) -> tuple[Column, Column]:
    """First tile and the one after the last along an axis."""
    first = F.greatest(F.lit(0), F.floor(start * extent / size))
    end = F.least(F.ceil(extent / size), F.ceil((start + length) * extent / size))
    return first.cast("int"), end.cast("int")


def canvas_to_pixel(cx: Column, cy: Column, width: Column, height: Column, samples: Column, lines: Column, v: Column) -> Column:
    """The pixel under a point of the canvas, or null outside the image."""
    a = aspect(samples, lines, width, height)
    mx, my = cx / width * 2 - 1, cy / height * -2 + 1
    u = ((mx - v["offset_x"]) / v["scale"] / a["x"] + 1) / 2
    w = ((my - v["offset_y"]) / v["scale"] / -a["y"] + 1) / 2
    x, y = F.floor(u * samples), F.floor(w * lines)
    inside = (x >= 0) & (x < samples) & (y >= 0) & (y < lines)
    return F.when(inside, F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))


def zoom(v: Column, factor: Column, ax: Column, ay: Column) -> Column:
    """Zoom about an anchor; back home when the scale crosses 1 downwards."""
    new = v["scale"] * factor
    scale = F.greatest(F.lit(1.0), new)
    move = scale > 1.0
    x = F.when(move, (v["offset_x"] - ax) * factor + ax).otherwise(v["offset_x"])
    y = F.when(move, (v["offset_y"] - ay) * factor + ay).otherwise(v["offset_y"])
    return F.when((v["scale"] > 1.0) & (new <= 1.0), view(*HOME)).otherwise(view(scale, x, y))


def pan(v: Column, dx: Column, dy: Column, a: Column) -> Column:
    """Move, held to what keeps the image on the canvas; nothing at scale 1."""
    hold = lambda o, factor: F.greatest(-(v["scale"] - 1) * factor, F.least((v["scale"] - 1) * factor, o))
    return F.when(v["scale"] <= 1.0, v).otherwise(view(v["scale"], hold(v["offset_x"] + dx, a["x"]), hold(v["offset_y"] - dy, a["y"])))


def replay(steps: Column, a: Column) -> Column:
    """The view after an array of steps (kind 'zoom' or 'pan', p, q, r), from home."""
    return F.aggregate(steps, view(*HOME), lambda v, s: F.when(s["kind"] == "zoom", zoom(v, s["p"], s["q"], s["r"])).otherwise(pan(v, s["p"], s["q"], a)))


def initial_scale(samples: Column, lines: Column, most: int = 2048) -> Column:
    return F.greatest(samples / F.least(samples, F.lit(most)), lines / F.least(lines, F.lit(most)))


def tile_to_clip(tx: Column, ty: Column, eff_w: Column, eff_h: Column, samples: Column, lines: Column, size: int, v: Column, a: Column) -> Column:
    """Scale and offset that place a tile's unit square on the canvas."""
    sx, sy = eff_w / samples * a["x"] * v["scale"], eff_h / lines * a["y"] * v["scale"]
    cx = ((tx * size + eff_w / 2) / samples * 2 - 1) * a["x"] * v["scale"] + v["offset_x"]
    cy = (1 - (ty * size + eff_h / 2) / lines * 2) * a["y"] * v["scale"] + v["offset_y"]
    return F.struct(sx.alias("scale_x"), sy.alias("scale_y"), cx.alias("offset_x"), cy.alias("offset_y"))
