"""Vector codes against plain Lloyd rounds in Python integers."""

import math
import random

import duckdb
import numpy as np
import pytest

from lumenfield.llm import code_books as cb

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """vec_id, code, error of the kept rows and the codebooks, by measuring everything in every round."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in kept]
    d = len(cut[0]) // parts
    cut = [[q[p * d : p * d + d] for p in range(parts)] for q in cut]
    books = [[list(q[p]) for q in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for q in cut:
                groups.setdefault(near(q[p], books[p]), []).append(q[p])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for r, q in zip(kept, cut):
        code = [near(q[p], books[p]) for p in range(parts)]
        out.append((r[0], bytes(code).hex(), sum(far(q[p], books[p][e]) for p, e in enumerate(code)), r[2]))
    return out, books


def vectors(n, dim=16, seed=3, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(9)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(700),
    vectors(300, spread=0.0),  # nine distinct vectors: entries are equal, ties go to the lower index
    vectors(5) + [(None, [0.5] * 16, 1)] * 3,  # fewer rows than entries, repeated rows with a null id
    vectors(200) + [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [float("nan")] * 16, 0), (903, [float("inf")] * 16, 0)],
    [(i, [x * 300 for x in v], label) for i, v, label in vectors(150)],  # components beyond 16 bits
], ids=["clusters", "ties", "few", "broken", "large"])
def test_equals_plain_rounds(spark, rows):
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, books, measured = cb.vector_codes(df, chunk_bytes=2000)
    want, plain_books = plain(rows)
    assert books.tolist() == plain_books
    text = lambda x: None if x is None else str(x)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, text(label), code, error)) for i, code, error, label in want)


def test_rounds_measure_only_what_bounds_allow(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 64))
    v = (centres[rng.integers(0, 16, 4000)] + rng.normal(0, 0.02, (4000, 64))).astype(np.float32)
    v[:16] = centres
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    _, _, measured = cb.vector_codes(df)
    assert measured[0] == 4000 * 8 and sum(measured[1:]) < 0.2 * 4000 * 8


def test_heaps_pop_in_key_order_and_keep_every_row():
    rng = np.random.default_rng(2)
    h = cb.Heaps.empty(4)
    entries = rng.integers(0, 4, 500).astype(np.uint8)
    keys = rng.normal(size=500).astype(np.float32)
    h.push(np.arange(500, dtype=np.int32), entries, keys)
    assert (h.entry() == entries).all()
    rows, own = h.pop(np.array([0.0, -9.0, 9.0, 0.5]))
    assert set(rows) == {i for i in range(500) if keys[i] <= (0.0, -9.0, 9.0, 0.5)[entries[i]]} and (own == entries[rows]).all()
    h.push(rows, (own + 1) % 4, keys[rows])
    assert sorted(h.row) == list(range(500)) and all((np.diff(h.key[a:b]) >= 0).all() for a, b in zip(h.start, h.start[1:]))


def test_digest_equals_its_sql(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("code", cb.F.lit("clash")).withColumn("id", cb.F.lit(1))
    got = cb.code_digest(df)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    cur = con.execute(cb.CODE_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


def test_empty_and_unequal(spark):
    assert cb.code_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cb.code_digest(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        cb.vector_codes(spark.createDataFrame([(1, [0.0] * 9, 1)], SCHEMA))
