"""Cube headers: parsing the text, normalising the record.

A header is small, so one is parsed on the driver (parse) and many are parsed as rows (parse_all).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type codes of the format, and names that stand for a type.
TYPE_CODES = {1: "u8", 2: "i16", 3: "i32", 4: "f32", 5: "f64", 6: "complex-f32", 9: "complex-f64", 12: "u16", 13: "u32", 14: "i64", 15: "u64", 16: "u8"}
TYPE_NAMES = {
    "uint8": "u8", "byte": "u8", "int16": "i16", "int32": "i32", "float32": "f32", "float": "f32", "float64": "f64", "complexf32": "complex-f32", "cf32": "complex-f32",
    "complexf64": "complex-f64", "cf64": "complex-f64", "uint16": "u16", "uint32": "u32", "int64": "i64", "uint64": "u64",
}
WIDTHS = {"u8": 1, "i16": 2, "u16": 2, "i32": 4, "u32": 4, "f32": 4, "i64": 8, "u64": 8, "f64": 8, "complex-f32": 8, "complex-f64": 16}
ORDERS = {"0": "lsb", "1": "msb", "lsb": "lsb", "little": "lsb", "little-endian": "lsb", "msb": "msb", "big": "msb", "big-endian": "msb"}
LAYOUTS = ("bil", "bip", "bsq")
ROLES = ("red", "green", "blue", "nir", "gray", "other")
REQUIRED = ("samples", "lines", "bands", "data type", "interleave")
NAMED = (*REQUIRED, "byte order", "header offset", "description", "file type", "sensor type", "map info", "coordinate system string", "wavelength")


class HeaderError(ValueError):
    """A header that can't be read."""


def data_type(value: object) -> str:
    text = str(value).strip().lower()
    name = TYPE_CODES.get(int(text)) if re.fullmatch(r"\d+", text) else TYPE_NAMES.get(text, text if text in WIDTHS else None)
    if name is None:
        raise HeaderError(f"unsupported data type: {value}")
    return name


def byte_order(value: object) -> str:
    if (name := ORDERS.get(str(value).strip().lower())) is None:
        raise HeaderError(f"unsupported byte order: {value}")
    return name


def layout(value: object) -> str:
    if (name := str(value).strip().lower()) not in LAYOUTS:
        raise HeaderError(f"unsupported interleave: {value}")
    return name


def fields_of(text: str) -> dict[str, str]:
    """Keys (lower case) and values of a header text.

    Blank lines and those from ';' are passed over, as are lines without '='. A value in braces may
    run over lines, which are joined by one space, up to the last '}' of the closing line. The last
    of equal keys counts.
    """
    out: dict[str, str] = {}
    rows = iter(text.splitlines())
    for row in rows:
        row = row.strip()
        if not row or row.startswith(";") or "=" not in row:
            continue
        key, value = (part.strip() for part in row.split("=", 1))
        if value.startswith("{"):
            value = value[1:]
            while "}" not in value:
                more = next(rows, None)
                if more is None:
                    raise HeaderError(f"the value of {key} isn't closed")
                value = f"{value.strip()} {more.strip()}"
            value = value[: value.rindex("}")].strip()
        out[key.lower()] = value
    return out


@dataclass(frozen=True)
class Header:
    samples: int
    lines: int
    bands: int
    interleave: str
    data_type: str
    byte_order: str = "lsb"
    header_offset: int = 0
    description: str | None = None
    file_type: str | None = None
    sensor_type: str | None = None
    map_info: str | None = None
    coordinate_system_string: str | None = None
    wavelength: tuple[float, ...] | None = None
    custom_fields: dict[str, str] = field(default_factory=dict)

    @property
    def bytes_per_pixel(self) -> int:
        return WIDTHS[self.data_type]

    def __post_init__(self) -> None:
        for name in ("samples", "lines", "bands"):
            if getattr(self, name) < 1:
                raise HeaderError(f"{name} must be positive")


def number(fields: dict[str, str], key: str, default: str | None = None) -> int:
    if (value := fields.get(key, default)) is None:
        raise HeaderError(f"missing field: {key}")
    if not re.fullmatch(r"\+?\d+", value.strip()):
        raise HeaderError(f"not a number: {key} = {value}")
    return int(value)


def wavelengths(value: str | None) -> tuple[float, ...] | None:
    """All of a list of numbers, or nothing."""
    try:
        return None if value is None else tuple(float(v) for v in value.split(","))
    except ValueError:
        return None


def parse(text: str) -> Header:
    f = fields_of(text)
    sizes = [number(f, k) for k in ("samples", "lines", "bands")]
    kind = data_type(number(f, "data type"))
    if "interleave" not in f:
        raise HeaderError("missing field: interleave")
    return Header(
        *sizes, layout(f["interleave"]), kind, byte_order(number(f, "byte order", "0")), number(f, "header offset", "0"),
        f.get("description"), f.get("file type"), f.get("sensor type"), f.get("map info"), f.get("coordinate system string"),
        wavelengths(f.get("wavelength")), {k: v for k, v in f.items() if k not in NAMED},
    )


def band_metadata(rows: list[dict]) -> list[dict]:
    """Band records with an index; a wavelength that isn't finite and an unknown display role are left out."""
    out = []
    for i, r in enumerate(rows):
        w = r.get("wavelength")
        w = float(w) if w is not None and math.isfinite(float(w)) else None
        role = r.get("display_role")
        out.append({"index": r.get("index", i + 1), "name": r.get("name"), "wavelength": w, "display_role": role if role in ROLES else None})
    return out


SCHEMA = (
    "samples int, lines int, bands int, interleave string, data_type string, byte_order string, header_offset long, bytes_per_pixel int, description string, file_type string, "
    "sensor_type string, map_info string, coordinate_system_string string, wavelength array<double>, custom_fields map<string,string>, error string"
)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entries_of(text: Column) -> Column:
    """What fields_of() finds, as a struct of done (keys and values in their order) and key (of a value that isn't closed, or null)."""
    blank = r" \t\x0B\f\x1C-\x1F"
    trim = lambda c: F.regexp_replace(c, f"^[{blank}]+|[{blank}]+$", "")
    upto_brace = lambda c: trim(F.regexp_extract(c, r"(?s)^(.*)\}", 1))
    pair = "struct<key:string,value:string>"

    def step(state: Column, row: Column) -> Column:
        put = lambda key, value: F.concat(state["done"], F.array(F.struct(key.alias("key"), value.alias("value"))))
        none = F.lit(None).cast("string")
        made = lambda done, key=none, held=none: F.struct(done.alias("done"), key.alias("key"), held.alias("held"))

        def inside(more: Column) -> Column:
            return F.when(more.contains("}"), made(put(state["key"], upto_brace(more)))).otherwise(made(state["done"], state["key"], more))

        def fresh(r: Column) -> Column:
            key, value = F.lower(trim(F.substring_index(r, "=", 1))), trim(F.regexp_replace(r, "(?s)^[^=]*=", ""))
            opened = F.regexp_replace(value, r"^\{", "")
            return (
                F.when((r == "") | r.startswith(";") | ~r.contains("="), state)
                .when(~value.startswith("{"), made(put(key, value)))
                .when(opened.contains("}"), made(put(key, upto_brace(opened))))
                .otherwise(made(state["done"], key, opened))
            )

        return F.when(state["key"].isNotNull(), let(F.concat(trim(state["held"]), F.lit(" "), trim(row)), inside)).otherwise(let(trim(row), fresh))

    first = F.struct(F.array().cast(f"array<{pair}>").alias("done"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("held"))
    return F.aggregate(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), first, step)


def header_of(text: Column) -> Column:
    """A header text as a struct of SCHEMA, by expressions only: what parse() gives, or why there is nothing, in error."""
    def fields(found: Column) -> Column:
        # of equal keys the last counts: the first of the reversed ones
        done = F.reverse(found["done"])
        get = lambda name: F.get(F.filter(done, lambda e: e["key"] == name), F.lit(0))["value"]
        keys = F.array_distinct(F.transform(done, lambda e: e["key"]))
        custom = F.map_from_entries(F.transform(F.filter(keys, lambda k: ~k.isin(*NAMED)), lambda k: F.struct(k.alias("key"), F.get(F.filter(done, lambda e: e["key"] == k), F.lit(0))["value"].alias("value"))))
        value = {k: get(k) for k in NAMED}
        whole = lambda k, other=None: F.when(F.coalesce(value[k], F.lit(other)).rlike(r"^\s*\+?[0-9]+\s*$"), F.trim(F.coalesce(value[k], F.lit(other))).try_cast("long"))
        among = lambda c, names: F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), c.cast("string"))
        kind = among(whole("data type"), {str(k): v for k, v in TYPE_CODES.items()})
        order = among(whole("byte order", "0"), ORDERS)
        shape = F.when(F.lower(F.trim(value["interleave"])).isin(*LAYOUTS), F.lower(F.trim(value["interleave"])))
        numbered = lambda k, other=None: F.when(F.coalesce(value[k], F.lit(other)).isNull(), F.lit(f"missing field: {k}")).when(whole(k, other).isNull(), F.concat(F.lit(f"not a number: {k} = "), value[k]))
        error = F.coalesce(
            F.when(found["key"].isNotNull(), F.concat(F.lit("the value of "), found["key"], F.lit(" isn't closed"))),
            *(numbered(k) for k in ("samples", "lines", "bands", "data type")), F.when(kind.isNull(), F.concat(F.lit("unsupported data type: "), whole("data type").cast("string"))),
            F.when(value["interleave"].isNull(), F.lit("missing field: interleave")), F.when(shape.isNull(), F.concat(F.lit("unsupported interleave: "), value["interleave"])),
            numbered("byte order", "0"), F.when(order.isNull(), F.concat(F.lit("unsupported byte order: "), whole("byte order", "0").cast("string"))), numbered("header offset", "0"),
            *(F.when(whole(k) < 1, F.lit(f"{k} must be positive")) for k in ("samples", "lines", "bands")),
        )
        waves = F.transform(F.split(value["wavelength"], ","), lambda v: F.trim(v).try_cast("double"))
        out = {
            "samples": whole("samples").try_cast("int"), "lines": whole("lines").try_cast("int"), "bands": whole("bands").try_cast("int"), "interleave": shape, "data_type": kind, "byte_order": order, "header_offset": whole("header offset", "0"),
            "bytes_per_pixel": F.try_element_at(F.create_map(*(F.lit(x) for p in WIDTHS.items() for x in p)), kind), "description": value["description"], "file_type": value["file type"], "sensor_type": value["sensor type"],
            "map_info": value["map info"], "coordinate_system_string": value["coordinate system string"], "wavelength": F.when(F.forall(waves, lambda v: v.isNotNull()), waves), "custom_fields": custom,
        }
        return F.struct(*(F.when(error.isNull(), c).alias(n) for n, c in out.items()), error.alias("error"))

    return let(entries_of(F.coalesce(text, F.lit(""))), fields)


def parse_all(headers: DataFrame, text: str = "value") -> DataFrame:
    """headers with a struct column header; headers that can't be read have its error set."""
    return headers.withColumn("header", header_of(F.col(text)).cast("struct<" + ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in SCHEMA.split(", "))) + ">"))


def render(h: Header) -> str:
    """A header text that parses to h."""
    codes = {name: code for code, name in reversed(TYPE_CODES.items())}
    rows = ["ENVI", f"samples = {h.samples}", f"lines = {h.lines}", f"bands = {h.bands}", f"header offset = {h.header_offset}", f"data type = {codes[h.data_type]}", f"interleave = {h.interleave}", f"byte order = {int(h.byte_order == 'msb')}"]
    for key in ("description", "map info", "coordinate system string"):
        if (value := getattr(h, key.replace(" ", "_"))) is not None:
            rows.append(f"{key} = {{{value}}}")
    if h.wavelength:
        rows.append("wavelength = {" + ", ".join(map(repr, h.wavelength)) + "}")
    return "\n".join(rows + [f"{k} = {{{v}}}" for k, v in h.custom_fields.items()]) + "\n"
