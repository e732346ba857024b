"""The synthetic reference cube: as a relation, and as header and payload files."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .header import Header, render
from .ranges import store_of

SAMPLES, LINES, BANDS = 48, 48, 32


def cell(x, y, band):
    """Value at a pixel; band from 1. Works on columns and on arrays."""
    return band * 100 + (13 * x + 17 * y + 7 * (band - 1)) % 97


def pixels(spark: SparkSession, samples: int = SAMPLES, lines: int = LINES, bands: int = BANDS) -> DataFrame:
    n = F.col("id")
    part = lambda c: c.cast("int")
    df = spark.range(samples * lines * bands).select(part(n % samples).alias("x"), part(F.floor(n / samples) % lines).alias("y"), part(F.floor(n / (samples * lines)) + 1).alias("band"))
    return df.withColumn("value", cell(F.col("x"), F.col("y"), F.col("band")).cast("float"))


def header(samples: int = SAMPLES, lines: int = LINES, bands: int = BANDS, interleave: str = "bsq", **more) -> Header:
    return Header(samples, lines, bands, interleave, more.pop("data_type", "u16"), wavelength=tuple(400.0 + 10 * b for b in range(bands)), map_info="UTM, 1, 1, 500000, 4100000, 30, 30, 50, North, WGS-84, units=Meters", custom_fields={"wavelength units": "Nanometers"}, **more)


def write(folder: str, h: Header, values: np.ndarray | None = None, name: str = "cube") -> tuple[str, str]:
    """Header and payload files of a cube (bands, lines, samples), small enough for one machine; paths."""
    from .envi import NUMPY

    if values is None:
        b, y, x = np.ogrid[1 : h.bands + 1, 0 : h.lines, 0 : h.samples]
        values = cell(x, y, b)
    axes = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[h.interleave]
    stored = values.transpose(axes).astype(np.dtype(NUMPY[h.data_type]).newbyteorder("<" if h.byte_order == "lsb" else ">"))
    store, inside = store_of(folder)
    store.create_dir(inside)
    for end, raw in ((".hdr", render(h).encode()), (".img", b"\0" * h.header_offset + stored.tobytes())):
        with store.open_output_stream(f"{inside}/{name}{end}") as f:
            f.write(raw)
    return f"{folder}/{name}.hdr", f"{folder}/{name}.img"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one of a local session where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared}/cube-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="lumenfield-cube-")
