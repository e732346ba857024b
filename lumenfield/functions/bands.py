"""Choosing and checking display bands, as column expressions. Bands count from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stretch import is_finite

#: Preferred bands, and wavelengths in nanometres of red, green and blue.
PREFERRED = (30, 20, 10)
TARGETS = (650.0, 550.0, 470.0)
VISIBLE = (480.0, 650.0)


def field_key(key: Column) -> Column:
    """A header key for comparison: trimmed, lower case, dashes and runs of space as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), "[_-]+", " "), r"\s+", " ")


def custom_field(fields: Column, name: str) -> Column:
    """The value of a header's map under a key that compares equal, or null."""
    hit = F.filter(F.map_entries(fields), lambda e: field_key(e["key"]) == name)
    return F.try_element_at(hit, F.lit(1))["value"]


def whole_number(v: Column) -> Column:
    n = F.trim(v.cast("string")).try_cast("double")
    return F.when(is_finite(n) & (n == F.floor(n)), n.cast("int"))


def band_list(text: Column) -> Column:
    """The integers of a header value such as {12, 8, 4}."""
    parts = F.split(F.regexp_replace(text, "[{}]", " "), r"[,\s]+")
    return F.array_compact(F.transform(F.filter(parts, lambda p: p != ""), whole_number))


def unique_bands(values: Column) -> Column:
    """Positive integers among text values, each once, in the order first seen."""
    return F.array_distinct(F.filter(F.transform(values, whole_number), lambda b: b.isNotNull() & (b > 0)))


def triple(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def check_band(value: Column, bands: Column) -> Column:
    """'integer' for a value that isn't one, 'range' for one outside 1..bands, else 'ok'."""
    n = whole_number(value)
    return F.when(n.isNull(), "integer").when((n < 1) | (n > bands), "range").otherwise("ok")


def checked_triple(r: Column, g: Column, b: Column, bands: Column) -> Column:
    """The three bands if all are valid, else null."""
    ok = F.lit(True)
    for v in (r, g, b):
        ok = ok & (check_band(v, bands) == "ok")
    return F.when(ok, triple(whole_number(r), whole_number(g), whole_number(b)))


def fallback_bands(bands: Column, preferred: tuple[int, int, int] = PREFERRED) -> Column:
    """The preferred bands where they exist, else the last, middle and first."""
    return (
        F.when(bands >= max(preferred), triple(*map(F.lit, preferred)))
        .when(bands == 1, triple(F.lit(1), F.lit(1), F.lit(1)))
        .when(bands == 2, triple(F.lit(2), F.lit(1), F.lit(1)))
        .otherwise(triple(bands, F.greatest(F.lit(1), F.ceil(bands / 2)), F.lit(1)))
    )


def unit_scale(units: Column, longest: Column) -> Column:
    """Nanometres to the header's unit: by its name, or by whether the longest wavelength is below 100."""
    u = F.lower(F.trim(F.coalesce(units, F.lit(""))))
    micro = u.contains("µm") | u.rlike(r"\b(um|micron|microns|micrometer|micrometers)\b")
    return F.when(u.rlike(r"\b(nm|nanometer|nanometers)\b"), 1.0).when(micro, 0.001).otherwise(F.when(longest < 100, 0.001).otherwise(1.0))


def rgb_targets(low: Column, high: Column, scale: Column) -> Column:
    """Three target wavelengths: visible red, green and blue if the range covers them, else at 75, 50 and 25 %."""
    seen = (low <= VISIBLE[0] * scale) & (high >= VISIBLE[1] * scale)
    return F.when(seen, F.array(*(F.lit(t) * scale for t in TARGETS))).otherwise(F.array(*(low + (high - low) * p for p in (0.75, 0.5, 0.25))))


def nearest_distinct(entries: Column, targets: Column) -> Column:
    """For each target in turn the nearest entry (band, wavelength) not taken yet, ties to the smaller band; arrays of bands."""

    def pick(taken: Column, target: Column) -> Column:
        left = F.filter(entries, lambda e: ~F.array_contains(taken, e["band"]))
        pool = F.when(F.size(left) > 0, left).otherwise(entries)
        ranked = F.transform(pool, lambda e: F.struct(F.abs(e["wavelength"] - target).alias("d"), e["band"].alias("band")))
        return F.concat(taken, F.array(F.array_min(ranked)["band"]))

    return F.aggregate(targets, F.array().cast("array<int>"), pick)


def wavelength_bands(wavelength: Column, bands: Column, units: Column) -> Column:
    """Display bands by wavelength, or null with fewer than three finite ones."""
    numbered = F.transform(F.slice(wavelength, 1, bands), lambda w, i: F.struct((i + 1).cast("int").alias("band"), w.alias("wavelength")))
    entries = F.filter(numbered, lambda e: is_finite(e["wavelength"]))
    values = F.transform(entries, lambda e: e["wavelength"])
    low, high = F.array_min(values), F.array_max(values)
    got = nearest_distinct(entries, rgb_targets(low, high, unit_scale(units, high)))
    return F.when(F.size(entries) >= 3, triple(got[0], got[1], got[2]))


def default_bands(bands: Column, wavelength: Column, fields: Column) -> Column:
    """The header's own default bands, else by wavelength, else the fallback."""
    own = band_list(custom_field(fields, "default bands"))
    at = lambda i: F.try_element_at(own, F.lit(i)).cast("string")
    from_header = F.when(F.size(own) >= 3, checked_triple(at(1), at(2), at(3), bands))
    return F.coalesce(from_header, wavelength_bands(wavelength, bands, custom_field(fields, "wavelength units")), fallback_bands(bands))


def repaired(r: Column, g: Column, b: Column, bands: Column) -> Column:
    """(bands, changed): a valid selection as it is, else the fallback."""
    ok = checked_triple(r, g, b, bands)
    return F.struct(F.coalesce(ok, fallback_bands(bands)).alias("bands"), ok.isNull().alias("changed"))
