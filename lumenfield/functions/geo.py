"""Map information, affine transforms and coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stretch import is_finite

EPSILON = 2.220446049250313e-16


def tokens(text: Column) -> Column:
    """Comma-separated tokens, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda t: t != "")


def number(token: Column) -> Column:
    """A finite number or null."""
    n = token.try_cast("double")
    return F.when(is_finite(n), n)


def whole(token: Column) -> Column:
    """A non-negative integer or null."""
    n = number(token)
    return F.when((n >= 0) & (n == F.floor(n)), n.cast("int"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_info(text: Column) -> Column:
    """The map-info struct of a header value, or null with fewer than seven tokens or a number that isn't finite.

    After the seven fixed tokens come, each optional: zone, hemisphere, datum; name=value tokens may
    stand anywhere among them.
    """

    def fixed(t: Column) -> Column:
        return let(F.transform(F.slice(t, 2, 6), number), lambda n: F.when((F.size(t) >= 7) & F.forall(n, lambda v: v.isNotNull()), whole_info(t, n)))

    def whole_info(t: Column, n: Column) -> Column:
        pair = lambda i: F.struct(F.get(n, F.lit(i)).alias("x"), F.get(n, F.lit(i + 1)).alias("y"))
        tail = F.slice(t, 8, F.greatest(F.size(t) - 7, F.lit(0)))
        rest = let(F.filter(tail, lambda v: ~v.rlike(r"^\w+\s*=")), place)
        units = F.filter(F.transform(tail, lambda v: F.trim(F.regexp_extract(v, r"(?i)^units\s*=\s*(.+)$", 1))), lambda v: v != "")
        return F.struct(
            F.get(t, F.lit(0)).alias("projection_name"), pair(0).alias("reference_pixel"), pair(2).alias("reference_coordinate"), pair(4).alias("pixel_size"),
            rest["zone"].alias("zone"), rest["hemisphere"].alias("hemisphere"), rest["datum"].alias("datum"), F.get(units, F.lit(0)).alias("units"), t.alias("raw_tokens"),
        )

    def place(plain: Column) -> Column:
        zone = whole(F.get(plain, F.lit(0)))
        first = F.when(zone.isNotNull(), 1).otherwise(0)
        name = F.lower(F.get(plain, first))
        side = F.when(name == "north", "North").when(name == "south", "South")
        return F.struct(zone.alias("zone"), side.alias("hemisphere"), F.get(plain, first + F.when(side.isNotNull(), 1).otherwise(0)).alias("datum"))

    return F.when(text.isNotNull(), let(tokens(text), fixed))


def affine_of(info: Column) -> Column:
    """The six affine numbers of a map-info struct; rotation is never applied."""
    rp, rc, ps = info["reference_pixel"], info["reference_coordinate"], info["pixel_size"]
    zero = F.lit(0.0)
    return F.when(info.isNotNull(), F.array(rc["x"] + (1 - rp["x"]) * ps["x"], ps["x"], zero, rc["y"] + (rp["y"] - 1) * ps["y"], zero, -ps["y"]))


def valid_affine(a: Column) -> Column:
    """a if it has six finite numbers, else null."""
    return F.when((F.size(a) == 6) & F.forall(a, is_finite), a)


def pixel_to_world(affine: Column, x: Column, y: Column) -> Column:
    """World coordinates of a pixel's corner, or null."""
    a = [F.try_element_at(affine, F.lit(i)) for i in range(1, 7)]
    x, y = x.cast("double"), y.cast("double")
    made = F.struct((a[0] + a[1] * x + a[2] * y).alias("x"), (a[3] + a[4] * x + a[5] * y).alias("y"))
    return F.when(affine.isNotNull() & is_finite(x) & is_finite(y), made)


def world_to_pixel(affine: Column, x: Column, y: Column) -> Column:
    """Fractional pixel of world coordinates, or null where the transform has no inverse."""
    a = [F.try_element_at(affine, F.lit(i)) for i in range(1, 7)]
    x, y = x.cast("double"), y.cast("double")
    det = a[1] * a[5] - a[2] * a[4]
    dx, dy = x - a[0], y - a[3]
    made = F.struct(F.try_divide(a[5] * dx - a[2] * dy, det).alias("x"), F.try_divide(a[1] * dy - a[4] * dx, det).alias("y"))
    return F.when(affine.isNotNull() & is_finite(x) & is_finite(y) & is_finite(det) & (F.abs(det) >= EPSILON), made)


def crs_summary(info: Column, crs: Column) -> Column:
    """Projection, zone, hemisphere, datum and units in one line, or what else is known."""
    with_comma = lambda lead, v: F.coalesce(F.concat(F.lit(lead), v), F.lit(""))
    line = F.concat(
        info["projection_name"], F.when(info["zone"] > 0, with_comma(", Zone ", info["zone"].cast("string"))).otherwise(""),
        with_comma(" ", F.substring(info["hemisphere"], 1, 1)), with_comma(", ", info["datum"]), with_comma(", ", info["units"]),
    )
    return F.coalesce(line, F.when(crs.isNotNull(), "coordinate system string present"), F.lit("--"))
