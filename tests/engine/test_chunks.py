import numpy as np
import pytest

from lumenfield.operators import chunks as ck
from lumenfield.sources import header as hd
from lumenfield.sources import synthetic


@pytest.mark.parametrize("layout", ["bsq", "bil", "bip"])
@pytest.mark.parametrize("order", ["lsb", "msb"])
def test_cells_of_chunks_equal_the_cube(spark, tmp_path, layout, order):
    h = hd.Header(5, 7, 4, layout, "u16", order, 6)
    values = np.arange(4 * 7 * 5).reshape(4, 7, 5) * 401 % 65536
    _, data = synthetic.write(str(tmp_path), h, values)
    for size in (2, 6, 34, 1000):  # cut anywhere between cells
        c = ck.byte_chunks(spark, data, size, start=6).repartition(3)
        got = {(r.x, r.y, r.band): (r.value, r.error) for r in ck.chunk_cells(c, h).collect()}
        assert got == {(x, y, b + 1): (float(values[b, y, x]), None) for b in range(4) for y in range(7) for x in range(5)}, size
    c = ck.byte_chunks(spark, data, 34, start=6)
    assert {(r.band, r.value) for r in ck.chunk_profile(c, h, 3, 5).collect()} == {(b + 1, float(values[b, 5, 3])) for b in range(4)}
    assert {tuple(r) for r in ck.chunk_rgb(c, h, 4, 1, 1).collect()} == {(x, y, *(float(values[b, y, x]) for b in (3, 0, 0))) for y in range(7) for x in range(5)}
    # one chunk: only the bands that stand in it
    one = ck.chunk_profile(c.where("start = 6"), h, 0, 0)
    want = {"bsq": {1}, "bil": {1, 2, 3, 4}, "bip": {1, 2, 3, 4}}[layout]
    assert {r.band for r in one.collect()} == want


def test_errors_are_values(spark):
    h = hd.Header(2, 2, 2, "bip", "u16", header_offset=4)
    rows = [(4, b"\1\0"), (5, b"\1\0"), (4, b"\1\0\2"), (0, b"\1\0"), (18, b"\1\0\2\0"), (None, b""), (6, None), (4, b"")]
    got = ck.chunk_cells(spark.createDataFrame(rows, "start long, chunk binary"), h).collect()
    assert [(r.x, r.y, r.band, r.value) for r in got if r.error is None] == [(0, 0, 1, 1.0)]
    bad = sorted((r.start is None, r.start or 0, r.error) for r in got if r.error)
    assert [b[:2] for b in bad] == [(False, 0), (False, 4), (False, 5), (False, 6), (False, 18), (True, 0)] and all(b[2] for b in bad)
    with pytest.raises(IndexError):
        ck.chunk_profile(spark.createDataFrame([], "start long, chunk binary"), h, 2, 0)
    assert ck.chunk_cells(spark.createDataFrame([], "start long, chunk binary"), h).count() == 0


def test_offsets_beyond_32_bits():
    h = hd.Header(100_000, 100_000, 300, "bip", "f32", header_offset=2**32)
    cell = ck.numbers(h, 99_999, 99_999)
    assert cell[-1] == 100_000 * 100_000 * 300 - 1
    assert [int(v[-1]) for v in ck.places(h, cell)] == [99_999, 99_999, 300]
    start = 2**32 + int(cell[0]) * 4
    assert ck.fault(h, start, b"\0" * 1200) is None and "beyond" in ck.fault(h, start, b"\0" * 1204)
