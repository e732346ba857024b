"""Vector codes: product quantisation whose codebooks are trained by Lloyd's rounds over heaps.

Components become integers, vectors are cut into equal parts, and each part position has its own
codebook. A round assigns every part to the nearest entry and moves each entry to the mean of its
parts. What a round need not look at again is told by the triangle inequality: a part keeps an upper
bound of the distance to its entry and a lower bound of that to any other. Both loosen as entries
move, by sums that are the same for all parts of an entry, so the slack between them is stored once,
as key = lower - upper + (what the entry had drifted when the part was last looked at), in the
entry's own heap. A part can have changed its entry only if its key is no greater than what the
entry has drifted by now: these parts are popped, measured against all entries exactly, and pushed
under new keys. The others aren't touched, and sums and counts change only by parts that moved.

The rows are written once as chunks of some megabytes in the shared folder. A chunk has its own
heaps, eight bytes a part: a heap is an array in key order, so popping takes a prefix and pushing is
one merge. Each round writes the heaps anew, by chunk and round, under a temporary name that is then
renamed: a task that is lost or run twice starts from the round before and writes the same bytes.
The driver holds the codebooks, their drift and one sum an entry and no rows.

Keys are single-precision numbers rounded down, and a part whose two bounds meet is measured again,
so assignments, ties to the lower index included, are those of measuring everything.

Rows whose vector is null or holds a null or non-finite component are dropped. Repeated rows each
give a row; codebooks start from the smallest ids, null ids last, equal ids by their vectors. With
fewer rows than entries each row starts one. An empty table gives an empty result. Vectors of unequal
length, of a length that the parts don't divide, or with components whose squares leave 64-bit
integers raise ValueError.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import save, shared_file, shared_folder, spread_join

#: Components are floor(SCALE * x).
SCALE = 4096
#: Rows measured at once, rows put out at once.
BLOCK = 1 << 16
#: A sum a label is broadcast up to so many labels, and dealt with the rows by label beyond.
MOST_LABELS = 100_000


def whole(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantised(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """The integers of a batch of vectors, one row each, in the smallest type that holds them."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError(f"vectors have {dim} components; one has {lengths[lengths != dim][0]}")
    v = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)
    most = int(np.abs(v).max(initial=0))
    if 4 * dim * most * most >= 1 << 62:
        raise ValueError(f"a component of {most / SCALE} is too large to be squared")
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest entry (ties: the lower index), the squared distance to it and that to the second; exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64  # whole numbers of this size are exact in doubles
    c = entries.astype(kind)
    own = (c * c).sum(1)
    best, first, second = np.empty(len(x), np.uint8), np.empty(len(x)), np.empty(len(x))
    for at in range(0, len(x), BLOCK):
        y = x[at : at + BLOCK].astype(kind)
        d = (y * y).sum(1)[:, None] - 2 * (y @ c.T) + own
        i = np.arange(len(y))
        b = d.argmin(1)
        best[at : at + BLOCK], first[at : at + BLOCK] = b, d[i, b]
        d[i, b] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
        second[at : at + BLOCK] = d.min(1) if len(c) > 1 else np.inf
    return best, first, second


class Heaps:
    """The heaps of one part position in one chunk, an entry each: rows start[e]..start[e + 1], keys ascending."""

    def __init__(self, start: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        self.start, self.key, self.row = start, key, row

    @classmethod
    def empty(cls, k: int) -> Heaps:
        return cls(np.zeros(k + 1, np.int64), np.empty(0, np.float32), np.empty(0, np.int32))

    def entry(self) -> np.ndarray:
        """The entry of every row of the chunk."""
        out = np.empty(len(self.row), np.uint8)
        out[self.row] = np.repeat(np.arange(len(self.start) - 1, dtype=np.uint8), np.diff(self.start))
        return out

    def pop(self, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a key no greater than their entry's bound, and their entries; they leave the heaps."""
        limit = np.nextafter(bound.astype(np.float32), np.float32(np.inf))
        ends = [a + int(np.searchsorted(self.key[a:b], t, "right")) for a, b, t in zip(self.start, self.start[1:], limit)]
        taken = np.zeros(len(self.key), bool)
        for a, b in zip(self.start, ends):
            taken[a:b] = True
        counts = np.array(ends) - self.start[:-1]
        rows = self.row[taken]
        self.start = np.concatenate([[0], np.cumsum(np.diff(self.start) - counts)])
        self.key, self.row = self.key[~taken], self.row[~taken]
        return rows, np.repeat(np.arange(len(counts), dtype=np.uint8), counts)

    def push(self, rows: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        order = np.lexsort((keys, entries))
        rows, entries, keys = rows[order], entries[order], keys[order]
        new = np.searchsorted(entries, np.arange(len(self.start)))
        at = [a + np.searchsorted(self.key[a:b], keys[i:j]) for a, b, i, j in zip(self.start, self.start[1:], new, new[1:])]
        at = np.concatenate(at).astype(np.int64)
        self.key, self.row = np.insert(self.key, at, keys), np.insert(self.row, at, rows)
        self.start = self.start + new


def looked_at(x: np.ndarray, heaps: Heaps, entries: np.ndarray, drift: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One part position's round in a chunk: the rows measured, their entries before (-1 in the first round) and now."""
    if first:
        rows, old = np.arange(len(x), dtype=np.int32), np.full(len(x), -1, np.int16)
    else:
        rows, old = heaps.pop(drift)
    now, near, far = nearest(x[rows], entries)
    upper, lower = np.sqrt(near), np.sqrt(far)
    at = drift[now]
    keys = lower - upper + at
    keys = np.nextafter((keys - 1e-12 * np.where(np.isfinite(lower), lower + upper + at, 0)).astype(np.float32), np.float32(-np.inf))
    heaps.push(rows, now, keys)
    return rows, old.astype(np.int16), now


def changes(x: np.ndarray, rows: np.ndarray, old: np.ndarray, now: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the rows that moved change in each entry's count and sums."""
    count, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    moved = old != now
    y = x[rows[moved]].astype(np.int64)
    for sign, side in ((1, now[moved]), (-1, old[moved])):
        for e in range(k):
            if (own := side == e).any():
                count[e] += sign * int(own.sum())
                sums[e] += sign * y[own].sum(0)
    return count, sums


def put(path: str, raw: bytes) -> None:
    """A whole file at a time: written beside and renamed, so a second attempt can't be read half done."""
    name = f"{path}.{uuid.uuid4().hex}"
    with shared_file(name, "w") as f:
        f.write(raw)
    fs, inside = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
    fs.move(inside, inside.removesuffix(name[len(path) :]))


def store_heaps(path: str, heaps: list[Heaps]) -> None:
    out = io.BytesIO()
    np.savez(out, **{f"{n}{p}": getattr(h, n) for p, h in enumerate(heaps) for n in ("start", "key", "row")})
    put(path, out.getvalue())


def stored_heaps(path: str, parts: int) -> list[Heaps]:
    with shared_file(path, "r") as f, np.load(io.BytesIO(f.read())) as z:
        return [Heaps(*(z[f"{n}{p}"] for n in ("start", "key", "row"))) for p in range(parts)]


def remove(path: str) -> None:
    fs, inside = pa.fs.FileSystem.from_uri(path)
    if fs.get_file_info(inside).type != pa.fs.FileType.NotFound:
        fs.delete_dir(inside)


def chunk_rows(dim: int, chunk_bytes: int):
    """A mapInArrow function: (id, vector, label) -> chunks (chunk, ids, labels, q, width)."""

    def chunk(held: list[tuple]) -> pa.RecordBatch:
        q = np.concatenate([h[2] for h in held])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(q)], pa.int32()), pa.concat_arrays([h[i] for h in held])) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, pa.array([q.tobytes()], pa.binary()), pa.array([q.dtype.itemsize], pa.int32())], names=["chunk", "ids", "labels", "q", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0), batch.column(2), quantised(batch.column(1), dim)))
                size += held[-1][2].nbytes
            if size >= chunk_bytes:
                yield chunk(held)
                held, size = [], 0
        if held:
            yield chunk(held)

    return run


def opened(batch: pa.RecordBatch, i: int, parts: int) -> tuple[str, np.ndarray]:
    """A chunk's name and its integers as (row, part, place)."""
    name, raw, width = (batch.column(c)[i].as_py() for c in ("chunk", "q", "width"))
    n = len(batch.column("ids")[i])
    return name, np.frombuffer(raw, f"<i{width}").reshape(n, parts, -1)


def round_of(folder: str, number: int, entries: np.ndarray, drift: np.ndarray):
    """A mapInArrow function: chunks -> changes (part, entry, n, sums, measured) of a round, once a task."""
    parts, k, d = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, measured = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64), np.zeros(parts, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                name, x = opened(batch, i, parts)
                heaps = stored_heaps(f"{folder}/heaps-{number - 1}/{name}", parts) if number else [Heaps.empty(k) for _ in range(parts)]
                for p in range(parts):
                    rows, old, now = looked_at(x[:, p], heaps[p], entries[p], drift[p], not number)
                    c, s = changes(x[:, p], rows, old, now, k)
                    count[p] += c
                    sums[p] += s
                    measured[p] += len(rows)
                store_heaps(f"{folder}/heaps-{number}/{name}", heaps)
        n = parts * k
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), pa.array(sums.ravel()))
        each = [np.repeat(np.arange(parts, dtype=np.int32), k), np.tile(np.arange(k, dtype=np.int32), parts), count.ravel()]
        spread = np.where(each[1] == 0, measured[each[0]], 0)
        yield pa.RecordBatch.from_arrays([*map(pa.array, each), flat, pa.array(spread)], names=["part", "entry", "n", "sums", "measured"])

    return run


def coded(folder: str, last: int, entries: np.ndarray, drift: np.ndarray):
    """A mapInArrow function: chunks -> (id, label, code, error), by a last look at the heaps."""
    parts, _, _ = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, x = opened(batch, i, parts)
                heaps = stored_heaps(f"{folder}/heaps-{last}/{name}", parts)
                code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p in range(parts):
                    looked_at(x[:, p], heaps[p], entries[p], drift[p], False)
                    code[:, p] = heaps[p].entry()
                    for at in range(0, len(x), BLOCK):
                        y = x[at : at + BLOCK, p].astype(np.int64) - entries[p][code[at : at + BLOCK, p]]
                        error[at : at + BLOCK] += (y * y).sum(1)
                text = code.tobytes().hex()
                codes = [text[a : a + 2 * parts] for a in range(0, len(text), 2 * parts)]
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                for at in range(0, len(x), BLOCK):
                    own = slice(at, at + BLOCK)
                    yield pa.RecordBatch.from_arrays([ids[own], labels[own], pa.array(codes[own], pa.string()), pa.array(error[own])], names=["id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, chunk_bytes: int = 8 << 20) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Rows (id, label as text, code, error), the final codebooks (part, entry, place) and how many parts each round measured.

    code has two hex digits a part, so entries is 256 at most; error is the squared distance to the
    entries. A round in which no entry moves ends the training, as the rounds after it would be equal.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label")).where(whole("vector"))
    start = own.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not start:
        return spark.createDataFrame([], "id long, label string, code string, error long"), np.zeros((parts, 0, 0), np.int64), []
    dim = len(start[0].vector)
    if not dim or dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    books = np.concatenate([quantised(pa.array([r.vector], pa.list_(pa.float64())), dim).astype(np.int64) for r in start]).reshape(len(start), parts, -1).transpose(1, 0, 2)
    k, d = books.shape[1:]
    folder = shared_folder(spark, "codes")
    own.mapInArrow(chunk_rows(dim, chunk_bytes), "chunk string, ids array<long>, labels array<string>, q binary, width int").write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    drift = np.zeros((parts, k))
    counts, sums, measured = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), object), []
    fs, inside = pa.fs.FileSystem.from_uri(folder)
    for number in range(rounds):
        fs.create_dir(f"{inside}/heaps-{number}")
        made = chunks.mapInArrow(round_of(folder, number, books, drift), "part int, entry int, n long, sums array<long>, measured long")
        totals = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(d))).alias("sums"), F.sum("measured").alias("measured")).collect()
        remove(f"{folder}/heaps-{number - 1}")
        measured.append(sum(r.measured for r in totals))
        for r in totals:
            counts[r.part, r.entry] += r.n
            sums[r.part, r.entry] += np.array(r.sums, object)
        before = books
        books = np.array([[[s // n for s in sums[p, e]] if (n := int(counts[p, e])) else before[p, e].tolist() for e in range(k)] for p in range(parts)], np.int64)
        moved = np.sqrt(((books - before).astype(np.float64) ** 2).sum(2))
        if not moved.any():
            break
        # an entry's own move, and the greatest move of another
        order = np.argsort(moved, axis=1)
        most = np.take_along_axis(moved, order[:, -1:], 1)
        other = np.repeat(most, k, 1)
        if k > 1:
            np.put_along_axis(other, order[:, -1:], np.take_along_axis(moved, order[:, -2:-1], 1), 1)
        drift = drift + (moved + other) * (1 + 1e-12)
    out = save(chunks.mapInArrow(coded(folder, number, books, drift), "id long, label string, code string, error long"))
    remove(folder)
    return out, books, measured


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the error summed over equal labels, nulls together) and codebooks_sha256."""
    rows, books, _ = vector_codes(vectors)
    rows = rows.withColumn("key", F.concat(F.col("label").isNull().cast("string"), F.coalesce("label", F.lit(""))))
    sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"))
    few = sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    # a label may hold a third of the rows: its rows stay where they are, or are dealt over many tasks
    joined = rows.join(F.broadcast(sums), "key") if few else spread_join(rows, sums, "key", "id", 64)
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def lloyd_sql(rounds: int = 6) -> str:
    """The digest in DuckDB SQL, each round two common tables."""
    d = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    # an entry below 16 in the last digit of 16: the minimum takes ties to the lower index
    assign = f"SELECT rn, p, CAST(min(({d})::BIGINT * 16 + e) AS BIGINT) AS m FROM pt JOIN %s USING (p) GROUP BY rn, p"
    steps = []
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({assign % f'b{r}'})",
            f"s{r} AS (SELECT p, m %% 16 AS e, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN pt USING (rn, p), range(1, 65) t(i) WHERE i <= len(v) GROUP BY p, m %% 16, i)".replace("%%", "%"),
            f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM s{r} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)",
        ]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS MATERIALIZED (SELECT rn, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM kept, range(8) t(p)),
b0 AS (SELECT p, rn - 1 AS e, v AS c FROM pt WHERE rn <= 16),
{", ".join(steps)},
f AS MATERIALIZED ({assign % f'b{rounds}'}),
coded AS (SELECT rn, string_agg(lpad(to_hex(m % 16), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM f GROUP BY rn),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rn), books"""


CODE_SQL = lloyd_sql()
