"""Quality classification by co-training.

Two views of a document: its text (hashed counts of words, word pairs and four-byte runs, and shares
of characters, words and lines of certain kinds) and its page metadata (source, language, length). A
logistic classifier of each view is fitted on a bounded, hashed sample of labelled documents
(max_labelled, split over the classes). In each round both classifiers score all documents in one
pass, and a bounded, hashed sample of those that one is confident about (max_exchanged a class)
joins the other's training rows as pseudo-labels; labelled documents of the sample and documents
that have joined before are passed over. Of the sample, three fifths train, a fifth calibrates each
view and a fifth fits the logistic combination of the two calibrated views. Every document is
scored. Both classes of the sample are weighted to their shares of all labels.

Features are made from whole texts, in each pass anew: nothing of the size of the corpus is written.
The fits run in one task over (max_labelled + 4 * max_exchanged * rounds) sampled rows of two
kilobytes at most; the driver gets their ids and the models.

Null texts count as empty, null metadata as a value of its own. Repeated rows score alike and count
once in a fit. Of a document's labels the majority counts; ties and nulls are ignored. Where a class
has fewer than five labelled documents every score is 0.5 and every document is kept. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge_dropout import mix
from .util import cut, save

PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Class of each byte: a punctuation mark each, then capitals, small letters, digits, bytes above 127, space, line end, others.
CLASS_OF = np.full(256, len(PUNCTUATION) + 6, np.int64)
CLASS_OF[PUNCTUATION] = np.arange(len(PUNCTUATION))
for _i, _r in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), [32], [10])):
    CLASS_OF[list(_r)] = len(PUNCTUATION) + _i
CLASSES = len(PUNCTUATION) + 7
SHARES = CLASSES + 6
HASHED = {"source": 32, "lang": 8}
META = 3 + sum(HASHED.values())
#: Columns of hashed words, word pairs and four-byte runs.
WORDS, PAIRS, RUNS = 384, 256, 256
TEXT = SHARES + WORDS + PAIRS + RUNS
#: Ridge of the text view: the many hashed columns are held shorter than the shares.
RIDGE = np.repeat([1.0, 50.0], [SHARES, TEXT - SHARES])
ODD = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse, modulo 2 ** 64."""
    up, down = np.full(n, ODD), np.full(n, np.uint64(pow(int(ODD), -1, 2**64)))
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def counted(owner: np.ndarray, at: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(owner * width + at, minlength=n * width).reshape(n, width).astype(np.float32)


def repeats(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Of each owner's keys, how many are equal to an earlier one."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    return np.bincount(o[1:][(o[1:] == o[:-1]) & (k[1:] == k[:-1])], minlength=n)


def text_views(raws: list[bytes | None]) -> np.ndarray:
    """The text views of some documents, a row each: square roots of shares.

    Words are told apart by a rolling hash of their bytes, worked out for all texts at once.
    """
    n = len(raws)
    size = np.fromiter((len(r or b"") for r in raws), np.int64, n)
    # a line end after each text keeps words and lines apart
    data = np.frombuffer(b"\n".join(r or b"" for r in raws) + b"\n", np.uint8)
    first = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(n), size + 1)
    inside = np.ones(len(data), bool)
    inside[first + size] = False
    kinds = counted(owner[inside], CLASS_OF[data[inside]], n, CLASSES)

    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])

    def pieces(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of the runs between gaps."""
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        a, b = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        return a, b, mix((sums[b] - sums[a]) * down[a])

    a, b, word = pieces(BLANK[data])
    of = owner[a]
    n_words = np.bincount(of, minlength=n)
    capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    shouted = (capital[b] - capital[a] > 1) & (small[b] == small[a])
    pair = of[1:] == of[:-1]
    same = np.bincount(of[1:][pair & (word[1:] == word[:-1])], minlength=n)
    la, _, line = pieces(data == 10)
    n_lines, most = np.bincount(owner[la], minlength=n), np.maximum(n_words, 1)
    shares = [
        np.bincount(of[shouted], minlength=n) / most,
        same / most,
        repeats(of, word, n) / most,
        repeats(owner[la], line, n) / np.maximum(n_lines, 1),
        np.minimum(1.0, size / most / 20),
        1 / most,
    ]
    kinds /= np.maximum(size, 1)[:, None]
    words = counted(of, (word % np.uint64(WORDS)).astype(np.int64), n, WORDS) / most[:, None]
    couple = mix(word[:-1] + mix(word[1:] ^ ODD))[pair]
    pairs = counted(of[1:][pair], (couple % np.uint64(PAIRS)).astype(np.int64), n, PAIRS) / np.maximum(n_words - 1, 1)[:, None]
    d = data.astype(np.uint32)
    run = (d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24) if len(d) > 3 else d[:0]
    whole = owner[: len(run)] == owner[3:] if len(d) > 3 else np.zeros(0, bool)
    runs = counted(owner[: len(run)][whole], (run[whole] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64), n, RUNS) / np.maximum(size - 2, 1)[:, None]
    return np.sqrt(np.hstack([kinds, np.stack(shares, 1), words, pairs, runs]).astype(np.float32))


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = np.log1p(max(0, n_chars or 0)) / 10
    parts = [np.array([size, size * size, n_chars is None], np.float32)]
    for value, (name, width) in zip((source, lang), HASHED.items(), strict=True):
        hot = np.zeros(width, np.float32)
        hot[zlib.crc32(f"{name}:{value}".encode()) % width] = 1
        parts.append(hot)
    return np.concatenate(parts)


def parts_of(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with text (string or binary), source, lang and n_chars, of some megabytes of text, with both views."""
    text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
    upto = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most)))
        part = batch.slice(at, end - at)
        meta = [part.column(part.schema.get_field_index(k)).to_pylist() for k in ("source", "lang", "n_chars")]
        yield part, text_views(text.slice(at, end - at).to_pylist()), np.stack([meta_view(*x) for x in zip(*meta, strict=True)])
        at = end


def seen(docs: DataFrame) -> DataFrame:
    """doc_id, text (binary), source, lang and n_chars, and nothing else, of docs."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )


# ---- logistic fits on bounded samples ------------------------------------------------------------


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1], -30, 30)


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float | np.ndarray = 1.0, rounds: int = 25, steps: int = 30) -> Logistic:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients, on standardised columns."""
    # in blocks, so that only the single-precision matrix is held whole
    blocks = [slice(i, i + 1024) for i in range(0, len(x), 1024)]
    mean = sum(x[b].sum(0, dtype=np.float64) for b in blocks) / len(x)
    scale = np.sqrt(sum(np.square(x[b] - mean).sum(0) for b in blocks) / len(x))
    scale[scale < 1e-6] = 1
    z = np.ones((len(x), x.shape[1] + 1), np.float32)
    for b in blocks:
        z[b, :-1] = np.clip((x[b] - mean) / scale, -8, 8)
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.append(np.broadcast_to(ridge, x.shape[1]), 1e-6)
    w = np.zeros(z.shape[1])
    single = np.float32  # products with the matrix stay in single precision
    for _ in range(rounds):
        p = probability(np.clip(z @ w.astype(single), -30, 30)).astype(np.float64)
        curve = (weight * p * (1 - p)).astype(single)
        rest = z.T @ (weight * (y - p)).astype(single) - penalty * w
        start = np.abs(rest).max()
        if start < 1e-3:
            break
        step, way, size = np.zeros_like(w), rest.copy(), rest @ rest
        for _ in range(steps):
            bent = z.T @ (curve * (z @ way.astype(single))) + (penalty + 1e-9) * way
            far = size / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            size, last = rest @ rest, size
            if np.abs(rest).max() < 1e-2 * start:
                break
            way = rest + size / last * way
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return Logistic(mean, scale, w)


@dataclass
class Model:
    """Both views' classifiers, their calibrations, the fit that combines them, and what each was fitted on."""

    text: Logistic
    meta: Logistic
    by_text: Logistic
    by_meta: Logistic
    both: Logistic
    used: dict[str, list]

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.by_text.logit(self.text.logit(x_text)[:, None])
        b = self.by_meta.logit(self.meta.logit(x_meta)[:, None])
        return probability(a), probability(b), probability(self.both.logit(np.stack([a, b], 1)))


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f2").reshape(-1, width).astype(np.float32)


ROW = "turn int, to int, y int, place long, doc_id long, text binary, meta binary"


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows (ROW, turn and to -1; both views packed) of a hashed sample of the labelled documents, at most half of `most` a class; and the classes' sizes."""
    named = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    named = named.where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    there = cut(named.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    sizes = {r.y: r.n for r in there.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]
    chosen = chosen[0].unionAll(chosen[1])
    # bounded by `most` rows of two numbers
    own = seen(docs).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text, meta in parts_of(batch):
                packed = [pa.array([r.astype("<f2").tobytes() for r in v], pa.binary()) for v in (text, meta)]
                sha = pa.array([zlib.crc32(t or b"") for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), *packed, sha], names=["doc_id", "y", "text", "meta", "tie"])

    made = own.mapInArrow(run, "doc_id long, y int, text binary, meta binary, tie long")
    one = made.groupBy("doc_id").agg(F.min(F.struct("tie", "text", "meta", "y")).alias("r"))
    return save(one.select(F.lit(-1).alias("turn"), F.lit(-1).alias("to"), "r.y", F.xxhash64("doc_id").alias("place"), "doc_id", "r.text", "r.meta")), sizes


def exchange(docs: DataFrame, text: Logistic, meta: Logistic, confident: float, most: int, turn: int, left_out: dict[str, np.ndarray]) -> DataFrame:
    """Rows (ROW, one view packed) for each view's training: those that the other view's classifier is sure of, `most` a class by hash of the id, in one pass over docs.

    left_out: ids not to take, by the view that would get them.
    """
    TURN = np.uint64(turn + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[int, tuple[int, int, bytes]]] = {}
        for batch in batches:
            for part, *x in parts_of(batch.filter(batch.column(0).is_valid())):
                ids = part.column(0).to_numpy()
                order = mix(ids.astype(np.uint64) + mix(np.array([TURN]))[0])
                for to, (model, own, other) in enumerate(((meta, x[1], x[0]), (text, x[0], x[1]))):
                    p = probability(model.logit(own))
                    free = ~np.isin(ids, left_out["text" if to == 0 else "meta"])
                    for y, sure in enumerate((p <= 1 - confident, p >= confident)):
                        best = held.setdefault((to, y), {})
                        for i in np.flatnonzero(sure & free).tolist():
                            best[int(ids[i])] = int(order[i]), int(ids[i]), other[i].astype("<f2").tobytes()
                        if len(best) > 2 * most:
                            held[to, y] = {r[1]: r for r in sorted(best.values())[:most]}
        for (to, y), best in held.items():
            rows = sorted(best.values())[:most]
            cols = [[to] * len(rows), [y] * len(rows), [r[0] - 2**63 for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["to", "y", "place", "doc_id", "x"])

    found = cut(seen(docs).mapInArrow(run, "to int, y int, place long, doc_id long, x binary"))
    best = [found.where((F.col("to") == to) & (F.col("y") == y)).orderBy("place", "doc_id", "x").limit(most) for to in (0, 1) for y in (0, 1)]
    view = lambda n: F.when(F.col("to") == n, F.col("x"))
    return save(functools.reduce(DataFrame.unionAll, best).select(F.lit(turn).alias("turn"), "to", "y", "place", "doc_id", view(0).alias("text"), view(1).alias("meta")))


def fits(rows: pa.Table, sizes: dict[int, int], last: bool) -> Model | tuple[Logistic, Logistic]:
    """The views' classifiers from ROWs; at last, the whole model."""
    rows = rows.sort_by([(c, "ascending") for c in ("turn", "to", "y", "place", "doc_id")])
    own = rows.filter(pc.less(rows["turn"], 0)).sort_by([("place", "ascending"), ("doc_id", "ascending")])
    y, ids = own["y"].to_numpy(), own["doc_id"].to_numpy()
    # the n-th document of a class by hash: 0 to 2 train, 3 calibrates, 4 combines
    fold = np.empty(len(y), np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % 5
    weight = np.array([sizes[c] / (y == c).sum() for c in (0, 1)])
    weight = (weight / weight.max())[y]
    learn, calibrate, combine = fold < 3, fold == 3, fold == 4
    width = {"text": TEXT, "meta": META}
    x = {v: unpacked(own[v].to_pylist(), width[v]) for v in width}
    extra = {}
    for to, view in enumerate(width):
        got = rows.filter(pc.and_(pc.greater_equal(rows["turn"], 0), pc.equal(rows["to"], to))).select(["turn", "doc_id", "y", view])
        extra[view] = list({r[:2]: r for r in zip(*(c.to_pylist() for c in got.columns), strict=True)}.values())
    del rows, own

    def fitted(view: str) -> Logistic:
        more = extra[view]
        xs = np.concatenate([x[view][learn], unpacked([r[3] for r in more], width[view])])
        return fit(xs, np.concatenate([y[learn], [r[2] for r in more]]), np.concatenate([weight[learn], np.ones(len(more))]), RIDGE if view == "text" else 1.0)

    text, meta = fitted("text"), fitted("meta")
    if not last:
        return text, meta
    a, b = text.logit(x["text"])[:, None], meta.logit(x["meta"])[:, None]
    by_text, by_meta = (fit(v[calibrate], y[calibrate], weight[calibrate]) for v in (a, b))
    both = fit(np.stack([by_text.logit(a), by_meta.logit(b)], 1)[combine], y[combine], weight[combine])
    used = {"learn": ids[learn].tolist(), "calibrate": ids[calibrate].tolist(), "combine": ids[combine].tolist()} | {v: [r[1] for r in extra[v]] for v in extra}
    return Model(text, meta, by_text, by_meta, both, used)


def fitted_in_a_task(rows: list[DataFrame], sizes: dict[int, int], last: bool = False) -> Model | tuple[Logistic, Logistic]:
    """fits() of the bounded samples in one task, so that the driver gets the weights and not the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = fits(pa.Table.from_batches(list(batches)), sizes, last)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], names=["model"])

    return pickle.loads(functools.reduce(DataFrame.unionByName, rows).coalesce(1).mapInArrow(run, "model binary").first().model)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_exchanged: int = 1_000, rounds: int = 2, confident: float = 0.97) -> Model | None:
    sample, sizes = labelled_sample(docs, labels, max_labelled)
    given = sample.select("y", "doc_id").toPandas()  # max_labelled pairs of numbers at most
    if any((given.y == c).sum() < 5 for c in (0, 1)):
        return None
    taken = {v: [given.doc_id.to_numpy(np.int64)] for v in ("text", "meta")}
    extra = []
    for turn in range(rounds):
        left_out = {v: np.unique(np.concatenate(ids)) for v, ids in taken.items()}
        extra.append(exchange(docs, *fitted_in_a_task([sample, *extra], sizes), confident, max_exchanged, turn, left_out))
        got = extra[-1].select("to", "doc_id").toPandas()
        for to, v in enumerate(taken):
            taken[v].append(got.doc_id[got.to == to].to_numpy(np.int64))
    return fitted_in_a_task([sample, *extra], sizes, last=True)


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score (calibrated probabilities of good quality) and kept (score >= least)."""
    model = train(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *x in parts_of(batch):
                got = model.scores(*x) if model else [np.full(part.num_rows, 0.5)] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, got), pa.array(got[2] >= least)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return seen(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs that score at least `least`, all columns. The last pass scores from the text itself, so nothing is joined back."""
    model = train(docs, labels, **options)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *x in parts_of(batch):
                yield part.filter(pa.array(model.scores(*x)[2] >= least))

    return docs.mapInArrow(run, docs.schema)
