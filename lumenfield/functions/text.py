"""Labels, log lines, identifiers and small parsers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stretch import is_finite

#: The first pattern that a log line matches names its level and source.
LOG_RULES = (
    ("error|failed|fatal", "ERROR", "Runtime"),
    ("warn", "WARN", "Runtime"),
    ("metric|time|performance|initial view|band switch", "PERF", "Renderer"),
    ("tile|preload", "INFO", "Tiles"),
    ("stats|statistics", "INFO", "Stats"),
    ("hdr|header|load|sample|file", "INFO", "Loader"),
    ("renderer|webgl|webgpu", "INFO", "Renderer"),
)
#: Console filters, by source, level or text.
CONSOLE = {
    "network": ("Network", None, "http|range|remote|catalog|request"),
    "tiles": ("Tiles", None, "tile|preload"),
    "stats": ("Stats", "PERF", "stat|metric|time|fps|cache|band switch"),
}
NOISE = ("Renderer recovery failed: Failed to acquire WebGPU adapter",)


def log_entry(message: Column) -> Column:
    """(level, source) of a log line."""
    entry = lambda level, source: F.struct(F.lit(level).alias("level"), F.lit(source).alias("source"))
    out = entry("INFO", "UI")
    for pattern, level, source in reversed(LOG_RULES):
        out = F.when(message.rlike(f"(?i){pattern}"), entry(level, source)).otherwise(out)
    return out


def in_console(entry: Column, message: Column, name: str) -> Column:
    """Whether a log line passes a console filter."""
    source, level, pattern = CONSOLE[name]
    ok = (entry["source"] == source) | message.rlike(f"(?i){pattern}")
    return ok | (entry["level"] == level) if level else ok


def first_language(message: Column) -> Column:
    """A message in Han script and another language, split by ' / ': its first part."""
    both = message.rlike(r"\p{IsHan}") & message.contains(" / ")
    return F.when(both, F.trim(F.split(message, " / ")[0])).otherwise(message)


def renderer_status(message: Column) -> Column:
    """(kind, stage, fallback) that a renderer's status line tells of; null for other lines."""
    line = r"^Renderer (initialization completed|recovered after device loss) \(([^,)]+)(, fallback mode)?\)\.$"
    part = lambda i: F.regexp_extract(message, line, i)
    stage = F.when(part(1) == "recovered after device loss", "recovered").otherwise("initialized")
    return F.when(message.rlike(line), F.struct(part(2).alias("kind"), stage.alias("stage"), (part(3) != "").alias("fallback")))


def actionable(message: Column, noise: tuple[str, ...] = NOISE) -> Column:
    ok = F.lit(True)
    for n in noise:
        ok = ok & ~message.contains(n)
    return ok


def fixed(v: Column, digits: int) -> Column:
    """v with so many decimals. The binary value is rounded, not its shortest decimal form; halves go up."""
    size = F.abs(v.cast("double"))
    whole = F.floor(size)
    part = ((size - whole) * float(1 << 62)).cast("long").cast("decimal(20,0)")
    steps = F.call_function("div", part * F.lit(10**digits) + F.lit(1 << 61), F.lit(1 << 62).cast("decimal(20,0)"))
    shown = ((whole * F.lit(10**digits) + steps).cast("decimal(24,0)") / F.lit(10**digits)).cast(f"decimal(24,{digits})").cast("string")
    exact = F.when(size < 1e12, F.concat(F.when(v < 0, "-").otherwise(""), shown))
    return exact.otherwise(F.format_string(f"%.{digits}f", v.cast("double")))


def format_number(v: Column, digits: int = 4) -> Column:
    return F.when(is_finite(v), fixed(v, digits)).otherwise("--")


def format_bytes(n: Column) -> Column:
    """Bytes in steps of 1024 up to GB, without decimals from 100."""
    n = n.cast("double")
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    v = n / F.pow(F.lit(1024.0), step)
    shown = F.when(v >= 100, fixed(v, 0)).otherwise(fixed(v, 1))
    return F.when(is_finite(n) & (n > 0), F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1))).otherwise("--")


def format_ms(v: Column) -> Column:
    return F.when(is_finite(v), F.concat(fixed(v, 1), F.lit(" ms"))).otherwise("--")


def clamp_unit(v: Column, otherwise: float = 0.0) -> Column:
    return F.when(is_finite(v), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).otherwise(F.lit(otherwise))


def name_of_url(url: Column, fallback: str = "remote-source") -> Column:
    """The last segment of a URL's path, or the fallback."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1)), F.lit(fallback))


def content_range_total(value: Column) -> Column:
    """The total of a Content-Range header; null where it is unknown (*) or malformed."""
    got = F.regexp_extract(F.trim(value), r"(?i)^bytes\s+\d+-\d+/(\d+)$", 1)
    return F.when(got != "", got.cast("long"))


def request_headers(headers: Column) -> Column:
    """A header map without nulls; null if nothing is left."""
    kept = F.map_filter(headers, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def stats_request_id(source: Column, bands: Column, initial: Column) -> Column:
    return F.concat_ws(":", F.lit("stats"), source.cast("string"), F.when(initial, "initial").otherwise("background"), F.array_join(bands.cast("array<string>"), ","))


def tile_request_id(source: Column, phase: Column, tx: Column, ty: Column, bands: Column) -> Column:
    return F.concat_ws(":", F.lit("tile"), source.cast("string"), phase, F.concat_ws(",", tx.cast("string"), ty.cast("string")), F.array_join(bands.cast("array<string>"), ","))


def unit_label(units: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(units, F.lit(""))))
    short = F.when(u.rlike("^(um|µm|micrometer|micrometers|micron|microns)$"), "um").when(u.rlike("^(nm|nanometer|nanometers)$"), "nm")
    return F.coalesce(short, F.when(u != "", u))


def spectral_axis(wavelength: Column, units: Column, n_values: Column) -> Column:
    """Label of a spectrum's axis: wavelengths only if there is a finite one for each value, else bands."""
    w = F.slice(wavelength, 1, n_values)
    whole = wavelength.isNotNull() & (F.size(w) == n_values) & F.forall(w, is_finite)
    unit = F.coalesce(unit_label(units), F.when(F.array_max(w) > 100, "nm").otherwise("um"))
    return F.when(whole, F.concat(F.lit("Wavelength ("), unit, F.lit(")"))).otherwise("Band")


def wavelength_summary(wavelength: Column, units: Column) -> Column:
    """'400 - 1030 nm (64 bands)', or '--' without finite wavelengths."""
    w = F.filter(wavelength, is_finite)
    low, high = F.array_min(w), F.array_max(w)
    unit = F.coalesce(unit_label(units), F.when(high > 100, "nm").otherwise("um"))
    shown = lambda v: F.when(high > 100, fixed(v, 0)).otherwise(fixed(v, 2))
    return F.when(F.coalesce(F.size(w), F.lit(0)) > 0, F.concat(shown(low), F.lit(" - "), shown(high), F.lit(" "), unit, F.lit(" ("), F.size(w).cast("string"), F.lit(" bands)"))).otherwise("--")


def chart_point(v: Column, low: Column, high: Column, start: float, extent: float, up: bool) -> Column:
    """Where a value stands on a chart's axis; a flat range spans 1."""
    share = (v - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.lit(start) + (1 - share if up else share) * F.lit(extent)
