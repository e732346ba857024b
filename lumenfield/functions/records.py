"""Header records as JSON, normalised column by column: semi-structured values in, one struct out.

A record is read once as VARIANT. Field names are the record's own (dataType, byteOrder, ...); types,
byte orders and layouts have aliases; whole numbers may come as numbers or as text. A place in
spatialReference goes before the same field at the top. What makes a record unusable is a value: the
first field that can't be read stands in error, and all else is null. Null texts and texts that
aren't JSON objects are errors too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.header import LAYOUTS, ORDERS, ROLES, TYPE_CODES, TYPE_NAMES, WIDTHS

#: Names of types as they may stand in a record, and the types meant.
TYPES = {str(code): name for code, name in TYPE_CODES.items()} | TYPE_NAMES | {name: name for name in WIDTHS}


def among(value: Column, names: dict[str, str]) -> Column:
    """What a name stands for, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.lower(F.trim(value)))


def finite(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def whole_number(value: Column, least: int) -> Column:
    """A number without a fraction, from `least` on, as long; else null."""
    n = finite(value)
    return F.when((n == F.floor(n)) & (n >= least) & (n < 2.0**53), n.cast("long"))


def text_or_null(value: Column) -> Column:
    return F.when(value != "", value)


def record(text: Column) -> Column:
    """A struct of a header record's fields and its error."""
    v = F.try_parse_json(text)
    get = lambda path, kind="string", at=v: F.try_variant_get(at, f"$.{path}", kind)
    is_string = lambda path, at=v: F.schema_of_variant(F.try_variant_get(at, f"$.{path}", "variant")) == "STRING"
    string = lambda path, at=v: F.when(is_string(path, at), text_or_null(get(path, at=at)))
    numbers = lambda path: F.transform(get(path, "array<variant>"), lambda x: finite(F.try_variant_get(x, "$", "string")))
    # null counts as zero where zero is allowed; a field that isn't there doesn't
    offset = F.when(F.is_variant_null(F.try_variant_get(v, "$.headerOffset", "variant")), F.lit("0")).otherwise(get("headerOffset"))
    plain = {
        "samples": whole_number(get("samples"), 1), "lines": whole_number(get("lines"), 1), "bands": whole_number(get("bands"), 1), "interleave": F.when(F.lower(get("interleave")).isin(*LAYOUTS), F.lower(get("interleave"))),
        "dataType": among(get("dataType"), TYPES), "byteOrder": among(get("byteOrder"), ORDERS), "headerOffset": whole_number(offset, 0), "bytesPerPixel": whole_number(get("bytesPerPixel"), 1),
    }
    wavelength = numbers("wavelength")

    def band(b: Column) -> Column:
        role = F.when(is_string("displayRole", b), F.lower(get("displayRole", at=b)))
        return F.struct(whole_number(get("index", at=b), 1).alias("index"), string("name", b).alias("name"), finite(get("wavelength", at=b)).alias("wavelength"), F.when(role.isin(*ROLES), role).alias("display_role"))

    metadata = F.transform(get("bandMetadata", "array<variant>"), band)
    place = lambda name, kind="string": F.coalesce(get(f"spatialReference.{name}", kind), get(name, kind))
    affine = F.transform(place("affineTransform", "array<variant>"), lambda x: finite(F.try_variant_get(x, "$", "string")))
    error = F.coalesce(
        F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit("no header record")),
        *(F.when(c.isNull(), F.lit(f"{name} can't be read")) for name, c in plain.items()),
        F.when(F.exists(wavelength, lambda x: x.isNull()), F.lit("wavelength can't be read")),
        F.when(F.exists(metadata, lambda b: b["index"].isNull()), F.lit("bandMetadata can't be read")),
    )
    fields = {
        "samples": plain["samples"], "lines": plain["lines"], "bands": plain["bands"], "interleave": plain["interleave"], "data_type": plain["dataType"], "byte_order": plain["byteOrder"], "header_offset": plain["headerOffset"],
        "bytes_per_pixel": plain["bytesPerPixel"], "description": string("description"), "file_type": string("fileType"), "sensor_type": string("sensorType"), "wavelength": wavelength, "custom_fields": get("customFields", "map<string,string>"),
        "band_metadata": metadata, "map_info": place("mapInfo"), "coordinate_system_string": place("coordinateSystemString"), "epsg": whole_number(place("epsg"), 1),
        "affine": F.when((F.size(affine) == 6) & F.forall(affine, lambda x: x.isNotNull()), affine),
    }
    return F.struct(*(F.when(error.isNull(), c).alias(n) for n, c in fields.items()), error.alias("error"))
