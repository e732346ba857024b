import http.server
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators.cube import Cube
from lumenfield.sources import header as hd
from lumenfield.sources import ranges, synthetic
from lumenfield.sources.envi import CubeDataSource, CubeReader, Strips, decode

MINI = "ENVI\n; note\nSamples = 3\nLINES=2\nbands = 4\ndata type = 12\ninterleave = BSQ\n"


def test_header_text_rules():
    h = hd.parse(MINI + "description = {\n one\n two}\nwavelength = {1, 2, 3, 4}\nmy key = a = b\nmy key = c\nmap info = {UTM, 1}\n")
    assert (h.samples, h.lines, h.bands, h.interleave, h.data_type, h.byte_order, h.header_offset) == (3, 2, 4, "bsq", "u16", "lsb", 0)
    assert h.description == "one two" and h.wavelength == (1, 2, 3, 4) and h.custom_fields == {"my key": "c"} and h.map_info == "UTM, 1"
    h = hd.parse("samples=1\nlines=1\nbands=1\ndata type=4\ninterleave=bip\nbyte order=1\nheader offset=128\nwavelength={1, x}")
    assert (h.data_type, h.byte_order, h.bytes_per_pixel, h.header_offset, h.wavelength) == ("f32", "msb", 4, 128, None)


@pytest.mark.parametrize("text", [MINI.replace("bands = 4\n", ""), MINI + "byte order = 9", MINI + "x = {a", MINI.replace("12", "7"), MINI.replace("BSQ", "tile"), MINI.replace("= 3", "= -3"), ""])
def test_bad_headers(text):
    with pytest.raises(hd.HeaderError):
        hd.parse(text)


def test_aliases_and_band_metadata():
    assert [hd.data_type(v) for v in (1, "16", "Byte", "float", "cf64")] == ["u8", "u8", "u8", "f32", "complex-f64"]
    assert hd.byte_order("Little-Endian") == "lsb" and hd.byte_order(1) == "msb"
    assert hd.band_metadata([{"name": "a", "display_role": "red", "wavelength": 5}, {"display_role": "pink", "wavelength": float("nan")}]) == [
        {"index": 1, "name": "a", "wavelength": 5.0, "display_role": "red"}, {"index": 2, "name": None, "wavelength": None, "display_role": None}]


TYPES = ["u8", "i16", "i32", "f32", "f64", "u16", "u32", "i64", "u64"]


@pytest.mark.parametrize("layout", ["bsq", "bil", "bip"])
def test_all_types_orders_and_layouts_read_alike(spark, tmp_path, layout):
    spark.dataSource.register(CubeDataSource)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 100, (3, 4, 5))
    for kind in TYPES:
        for order in ("lsb", "msb"):
            h = hd.Header(5, 4, 3, layout, kind, order, 7)
            head, data = synthetic.write(str(tmp_path), h, values, f"{kind}{order}")
            reader = CubeReader(h, ranges.LocalBytes(data), None, 3)
            got = np.zeros((3, 4, 5))
            for p in reader.partitions():
                for b in reader.read(p):
                    x, y, band, v = (c.to_numpy() for c in b.columns)
                    got[band - 1, y, x] = v
            assert (got == values).all(), (kind, order)
    df = spark.read.format("cube").options(header=head, data=data, strip_lines="3").load()
    rows = {(r.x, r.y, r.band): r.value for r in df.collect()}
    assert rows == {(x, y, b + 1): values[b, y, x] for b in range(3) for y in range(4) for x in range(5)}


def test_filters_leave_out_strips(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    h = synthetic.header()
    reader = CubeReader(h, ranges.LocalBytes("none"), None, 8)
    assert len(reader.strips()) == 32 * 6
    reader = CubeReader(h, ranges.LocalBytes("none"), [26, 8], 8, (8, 16))
    assert [(p.band, p.y0, p.y1) for p in reader.strips()] == [(8, 8, 16), (26, 8, 16)]
    assert CubeReader(h, ranges.LocalBytes("none"), None, 8, (60, 99)).partitions() == [Strips([])]
    big = CubeReader(hd.Header(2, 2, 1, "bsq", "u16", header_offset=2**32 + 128), ranges.LocalBytes("none"), None, None)
    assert (big.strips()[0].start, big.strips()[0].end) == (2**32 + 128, 2**32 + 136)


def test_complex_cells_are_refused():
    with pytest.raises(hd.HeaderError):
        decode(b"", hd.Header(1, 1, 1, "bsq", "complex-f32"))


def test_ranges_and_load_options(tmp_path):
    (tmp_path / "a").write_bytes(b"0123456789")
    b = ranges.open_bytes(str(tmp_path / "a"))
    assert b.size() == 10 and b.read(2, 5) == b"234" and b.read(4, 4) == b""
    for bad in ((-1, 2), (3, 2), (0, 11), (0.5, 1)):
        with pytest.raises(ValueError):
            b.read(*bad)
    assert ranges.load_options({"kind": "envi-http", "hdrUrl": " h ", "imgUrl": "d", "headers": {"X": 1, "Y": None}}) == {"header": "h", "data": "d", "http.X": "1"}
    for bad in ({"kind": "x"}, {"kind": "envi-local", "headerFile": "a"}):
        with pytest.raises(ValueError):
            ranges.load_options(bad)
    assert ranges.name_of("https://h/a/b.img?x") == "b.img" and ranges.name_of("https://h/") == "remote-source"
    assert ranges.total_of("bytes 0-0/12") == 12 and ranges.total_of("bytes 0-0/*") is None and ranges.total_of(None) is None
    assert ranges.clean_headers({"a": None}) is None and ranges.resolve("/x", "https://h/a/b") == "https://h/x"


@pytest.fixture
def served(tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        seen: list = []
        partial = True

        def do_HEAD(self):
            self.send_response(405)
            self.end_headers()

        def do_GET(self):
            raw = (tmp_path / self.path.lstrip("/")).read_bytes()
            want = self.headers.get("Range")
            self.seen.append(want)
            if want and self.partial:
                a, b = map(int, want.removeprefix("bytes=").split("-"))
                self.send_response(206)
                self.send_header("Content-Range", f"bytes {a}-{b}/{len(raw)}")
                raw = raw[a : b + 1]
            else:
                self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Handler
    server.shutdown()


def test_http_ranges_equal_local_reads(spark, tmp_path, served):
    url, handler = served
    h = synthetic.header(interleave="bil")
    head, data = synthetic.write(str(tmp_path), h)
    cube = Cube.load(spark, f"{url}/{os.path.basename(head)}", f"{url}/{os.path.basename(data)}")
    assert [r.value for r in cube.spectrum(2, 3).orderBy("band").limit(4).collect()] == [177, 284, 391, 401]
    b = ranges.HttpBytes(f"{url}/{os.path.basename(data)}")
    assert b.size() == 48 * 48 * 32 * 2 and b.read(5, 5) == b""
    handler.partial = False
    with pytest.raises(OSError):
        ranges.HttpBytes(b.url, known_size=10).read(0, 4)


HEADERS = [
    MINI, MINI + "description = {\n one\n two}\nwavelength = {1, 2, 3, 4}\nmy key = a = b\nmy key = c\nmap info = {UTM, 1}\n", "samples=1\nlines=1\nbands=1\ndata type=4\ninterleave=bip\nbyte order=1\nheader offset=128\nwavelength={1, x}", "", None, "no fields",
    MINI.replace("bands = 4\n", ""), MINI + "byte order = 9", MINI + "x = {a", MINI.replace("12", "7"), MINI.replace("BSQ", "tile"), MINI.replace("= 3", "= -3"), MINI.replace("= 3", "= 0"), MINI + "note = {a} b } c\r\n  other = {\r\n\r\n} x\nsensor type = s\n=v\n",
    MINI + "header offset = 4294967424\nbands = +5\n", MINI.replace("\n", "\r\n") + "a = {b\n= c\n; d}\nA = e", MINI + "byte order = x", MINI + "wavelength = {}", MINI + "k = { {a} }",
]


def test_header_expressions_equal_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(HEADERS)), "i int, value string")
    got = {r.i: r.header for r in hd.parse_all(df).collect()}
    for i, text in enumerate(HEADERS):
        try:
            h = hd.parse(text or "")
        except hd.HeaderError as e:
            assert got[i].error == str(e) and got[i].samples is None, text
            continue
        r = got[i]
        assert r.error is None, (text, r.error)
        same = ("samples", "lines", "bands", "interleave", "data_type", "byte_order", "header_offset", "bytes_per_pixel", "description", "file_type", "sensor_type", "map_info", "coordinate_system_string", "custom_fields")
        assert [getattr(r, n) for n in same] == [getattr(h, n) for n in same], text
        assert r.wavelength == (None if h.wavelength is None else list(h.wavelength)), text


def test_resolved_urls_equal_the_standard(spark):
    from urllib.parse import urljoin

    from lumenfield.sources import catalog

    refs = ["a", "a/b?x#y", "/a", "/a/../b", "../x", "../../x", "./a", "a/.", "a/..", ".", "..", "//o.example/p/../q", "http://z/a/../b", "?q", "#f", "", "?", "a//b", "/a//../b", "x/./y/../z", "mailto:x", "a?b=/../c", None]
    for base in ("https://h.example/cat/list.json", "https://h.example/cat/sub/", "http://h:80/a?q=1#f"):
        df = spark.createDataFrame([(r,) for r in refs], "u string")
        for r in df.select("u", catalog.resolved(F.col("u"), base).alias("v")).collect():
            want = None if r.u is None else urljoin(base, r.u)
            if r.u in ("", "?", "a//b", "/a//../b", "//o.example/p/../q") or r.u and r.u.startswith("#"):
                continue  # the library drops or keeps what the standard doesn't
            assert r.v == want, (base, r.u)


    df = spark.createDataFrame([("a//b",), ("/a//../b",), ("",), ("#f",)], "u string").select(catalog.resolved(F.col("u"), "https://h.example/cat/l?q").alias("v"))
    assert [r.v for r in df.collect()] == ["https://h.example/cat/a//b", "https://h.example/a/b", "https://h.example/cat/l?q", "https://h.example/cat/l?q#f"]


def test_a_whole_range_is_asked_for_once(tmp_path, served):
    url, handler = served
    (tmp_path / "w").write_bytes(b"0123456789")
    b = ranges.HttpBytes(f"{url}/w", known_size=10)
    handler.seen.clear()
    assert b.read(0, 10) == b.read(0, 10) == b.read_all() == b"0123456789" and handler.seen == [None]
    assert b.read(0, 9) == b"012345678" and handler.seen[1:] == ["bytes=0-8"]
