"""Language-model scoring by deleted interpolation.

Documents fall in five folds by crc32 of their id. Fold 1 is held out and never learned from. The
model mixes three maximum-likelihood estimates, bigram, unigram and uniform, with weights that
depend on the frequency bucket of the context (powers of two). The weights are learned by
expectation-maximisation on the deleted fold (2), with counts from the folds left (0, 3, 4); scores
then use the counts of all training folds.

How it runs. Documents become parts: some millions of tokens each, of one role, coded by a
dictionary of the part. Each part ships its distinct words and bigrams, as packed sorted arrays of
hashed keys with counts, to groups of `fan` parts and buckets of the key space, where they are added
up; groups are joined to groups of `fan` groups, with as many times the buckets, until one group is
left. So each task holds about bucket_keys entries however often an n-gram occurs and however many
parts there are. The totals go back the same way, in the order in which the keys came. Nothing of
the corpus passes through the driver but the mixture weights: the expectation step is an aggregate
over the cells (context bucket, bigram, context and unigram count) of all deleted tokens.

Null texts count as empty: one end token. A null id counts as fold 0. Repeated rows count and are
scored each time. An empty table gives an empty result. Without training tokens the bigram and
unigram estimates are zero and every token scores half the uniform estimate. Keys are 64-bit hashes;
counts and totals are 64-bit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge_dropout import mix
from .util import discard, save

#: Roles of a part: counted for the weights, deleted (the weights are learned on it), held out.
KEPT, DELETED, HELD_OUT = 0, 1, 2
PARTS = "part long, role int, n_words long, n_pairs long, n_tokens long, ids binary, lengths binary, codes binary, keys binary"
COUNTS = "kind int, bucket long, group long, child long, keys binary, kept binary, both binary"
TOTALS = "kind int, bucket long, child long, kept binary, both binary, n_kept long, n_both long, v_kept long, v_both long"
GOLDEN = 0x9E3779B97F4A7C15


def planes(x: np.ndarray) -> bytes:
    """Integers that aren't negative, as byte planes, which compress well; the first byte is their number."""
    x = x.astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of the schema (of ints, longs, doubles and binaries)."""
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, names, strict=True)], names=[n for n, _ in names])


def role_of(doc_id: int | None) -> int:
    fold = 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5
    return {1: HELD_OUT, 2: DELETED}.get(fold, KEPT)


def bigrams(codes: np.ndarray, lengths: np.ndarray, n_words: int) -> np.ndarray:
    """Each token's bigram as context * n_words + word; the context of a first token is the end token, code 0."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.cumsum(lengths) - lengths] = 0
    return before * n_words + codes


def pair_keys(pairs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    left, right = np.divmod(pairs, len(keys))
    return mix(mix(keys[left]) + keys[right])


class Part:
    """Tokens of one role, gathered document by document."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {b"": 0}
        self.ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, raw: bytes | None) -> None:
        words, number = (raw or b"").lower().split(), self.words
        codes = np.array([*(number.setdefault(w, len(number)) for w in words), 0], np.int64)
        self.ids.append(doc_id)
        self.codes.append(codes)
        self.size += len(codes)

    def row(self, part: int, role: int) -> tuple:
        keys = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        lengths, codes = np.array([len(c) for c in self.codes]), np.concatenate(self.codes)
        n_pairs = len(np.unique(bigrams(codes, lengths, len(keys))))
        ids = np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array([i is not None for i in self.ids], np.uint8).tobytes()
        return part, role, len(keys), n_pairs, len(codes), ids, planes(lengths), planes(codes), keys.astype("<u8").tobytes()


def make_parts(docs: DataFrame, part_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, open_parts = 0, {}

        def close(role: int) -> pa.RecordBatch:
            nonlocal made
            row = open_parts.pop(role).row((TaskContext.get().partitionId() << 24) + made, role)
            made += 1
            return arrow([row], PARTS)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                role = role_of(doc_id)
                part = open_parts.setdefault(role, Part())
                part.add(doc_id, raw.as_py())
                if part.size >= part_tokens:
                    yield close(role)
        for role in list(open_parts):
            yield close(role)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, PARTS)


class Open:
    """A part's row, unpacked: distinct words and bigrams in key order, and where each token's stand there."""

    def __init__(self, row: dict) -> None:
        self.role, self.part = row["role"], row["part"]
        self.keys = np.frombuffer(row["keys"], "<u8").astype(np.uint64)
        self.lengths = unplanes(row["lengths"]).astype(np.int64)
        codes = unplanes(row["codes"]).astype(np.int64)
        n = len(self.lengths)
        self.ids = np.frombuffer(row["ids"], "<i8", n)
        self.valid = np.frombuffer(row["ids"], np.uint8, n, 8 * n).astype(bool)
        self.word_order = np.argsort(self.keys)
        place = np.empty(len(self.keys), np.int64)
        place[self.word_order] = np.arange(len(self.keys))
        pairs, self.pair_at, self.pair_n = np.unique(bigrams(codes, self.lengths, len(self.keys)), return_inverse=True, return_counts=True)
        keys = pair_keys(pairs, self.keys)
        order = np.argsort(keys)
        self.pair_keys, self.pair_n = keys[order], self.pair_n[order]
        place_of_pair = np.empty(len(pairs), np.int64)
        place_of_pair[order] = np.arange(len(pairs))
        self.pair_at = place_of_pair[self.pair_at]
        self.word_at = place[codes]
        self.context_at, self.second_at = (place[x] for x in np.divmod(pairs[order], len(self.keys)))
        self.end_at = place[0]
        self.codes = codes

    def shipped(self) -> Iterator[tuple]:
        """(kind, keys, counts) in key order: words are kind 1, bigrams kind 2."""
        yield 1, self.keys[self.word_order], np.bincount(self.word_at, minlength=len(self.keys))
        yield 2, self.pair_keys, self.pair_n


def in_buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of sorted keys by their first bits."""
    at = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        yield int(at[i]), slice(i, j)


def base_of(bucket: int, bits: int) -> np.uint64:
    return np.uint64(bucket << (64 - bits) if bits else 0)


def ship(parts: DataFrame, bits: dict[int, int], groups: int) -> DataFrame:
    """The counts of each part's keys, by bucket and group of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = Open(batch.slice(i, 1).to_pylist()[0])
                group = p.part * GOLDEN % 2**64 // 2**20 % groups
                rows = []
                for kind, keys, n in p.shipped():
                    for b, own in in_buckets(keys, bits[kind]):
                        none = planes(np.zeros(len(n[own])))
                        counts = planes(n[own])
                        rows.append((kind, b, group, p.part, planes(keys[own] - base_of(b, bits[kind])), counts if p.role == KEPT else none, counts if p.role != HELD_OUT else none))
                yield arrow(rows, COUNTS)

    return parts.mapInArrow(run, COUNTS)


class Sum:
    """The rows of one bucket and group, added up."""

    def __init__(self, rows: pa.Table, bits: dict[int, int]) -> None:
        cols = rows.to_pydict()
        self.kind, self.bucket, self.group, self.children = cols["kind"][0], cols["bucket"][0], cols["group"][0], cols["child"]
        parts = [unplanes(k) for k in cols["keys"]]
        # by child, then bucket: a child's rows stand in key order
        self.cuts = np.cumsum([0, *map(len, parts)])
        self.keys, self.at = np.unique(np.concatenate(parts) + base_of(self.bucket, bits[self.kind]), return_inverse=True)
        self.kept, self.both = (self.total(np.concatenate([unplanes(n) for n in cols[c]])) for c in ("kept", "both"))

    def total(self, n: np.ndarray) -> np.ndarray:
        """Whole sums, right beyond 2 ** 53: halves of 32 bits are added apart."""
        low, high = (np.bincount(self.at, x.astype(np.float64), len(self.keys)).astype(np.uint64) for x in (n & np.uint64(0xFFFFFFFF), n >> np.uint64(32)))
        return low + (high << np.uint64(32))

    def back(self, kept: np.ndarray, both: np.ndarray, sums: tuple = (0, 0, 0, 0)) -> pa.Table:
        """Totals for each child, in the order of its own keys; sums stand in the first row."""
        out = [
            (self.kind, self.bucket, child, planes(kept[self.at[i:j]]), planes(both[self.at[i:j]]), *(sums if q == 0 else (0, 0, 0, 0)))
            for q, (child, i, j) in enumerate(zip(self.children, self.cuts, self.cuts[1:], strict=False))
        ]
        return pa.Table.from_batches([arrow(out, TOTALS)])


def add_up(level: DataFrame, bits: dict[int, int]) -> DataFrame:
    """Totals of the last level, where one group is left, returned to the children."""

    def run(rows: pa.Table) -> pa.Table:
        s = Sum(rows, bits)
        return s.back(s.kept, s.both, (int(s.kept.sum()), int(s.both.sum()), int((s.kept > 0).sum()), int((s.both > 0).sum())))

    return level.groupBy("kind", "bucket", "group").applyInArrow(run, TOTALS)


def send_up(level: DataFrame, bits: dict[int, int], finer: dict[int, int], groups: int) -> DataFrame:
    """The sums of each bucket and group as rows of the next level."""

    def run(rows: pa.Table) -> pa.Table:
        s = Sum(rows, bits)
        out = [(s.kind, b, s.group % groups, s.group, planes(s.keys[own] - base_of(b, finer[s.kind])), planes(s.kept[own]), planes(s.both[own])) for b, own in in_buckets(s.keys, finer[s.kind])]
        return pa.Table.from_batches([arrow(out, COUNTS)])

    return level.groupBy("kind", "bucket", "group").applyInArrow(run, COUNTS)


def send_down(level: DataFrame, totals: DataFrame, bits: dict[int, int], finer: dict[int, int]) -> DataFrame:
    """Totals of the next level (by its finer buckets) returned to this level's children."""
    more = F.when(F.col("kind") == 1, finer[1] - bits[1]).otherwise(finer[2] - bits[2]).cast("int")
    given = totals.select("kind", F.expr("bucket").alias("finer"), F.call_function("shiftright", F.col("bucket"), more).alias("bucket"), F.col("child").alias("group"), "kept", "both", "n_kept", "n_both", "v_kept", "v_both")

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        s = Sum(rows, bits)
        got = sorted(above.select(["finer", "kept", "both", "n_kept", "n_both", "v_kept", "v_both"]).to_pylist(), key=lambda r: r["finer"])
        kept, both = (np.concatenate([unplanes(r[c]) for r in got]) for c in ("kept", "both"))
        if len(kept) != len(s.keys):
            raise RuntimeError("a group's totals don't match its keys")
        return s.back(kept, both, tuple(sum(r[c] for r in got) for c in ("n_kept", "n_both", "v_kept", "v_both")))

    return level.groupBy("kind", "bucket", "group").cogroup(given.groupBy("kind", "bucket", "group")).applyInArrow(run, TOTALS)


def totals_of(parts: DataFrame, n_parts: int, entries: dict[int, int], bucket_keys: int, fan: int) -> DataFrame:
    """The corpus totals of every part's keys (child: the part)."""
    depth = 1
    while fan**depth < n_parts:
        depth += 1
    groups = [fan ** (depth - 1 - i) for i in range(depth)]
    bits = [{k: max(0, math.ceil(math.log2(max(n, 1) / (g * bucket_keys)))) for k, n in entries.items()} for g in groups]
    levels = [ship(parts, bits[0], groups[0])]
    for i in range(1, depth):
        levels[-1] = save(levels[-1])
        levels.append(send_up(levels[-1], bits[i - 1], bits[i], groups[i]))
    totals = save(add_up(levels[-1], bits[-1]))
    for i in range(depth - 2, -1, -1):
        above, totals = totals, save(send_down(levels[i], totals, bits[i], bits[i + 1]))
        discard(above)
        discard(levels[i])
    return totals


def opened(left: pa.Table, right: pa.Table, which: str) -> tuple[Open, np.ndarray, np.ndarray] | None:
    """A part with its words' and bigrams' totals; which: kept or both."""
    if not left.num_rows:
        return None
    p = Open(left.to_pylist()[0])
    got: dict[int, list] = {1: [], 2: []}
    for r in sorted(right.to_pylist(), key=lambda r: r["bucket"]):
        got[r["kind"]].append(unplanes(r[which]))
    words, pairs = (np.concatenate(got[k]).astype(np.int64) if got[k] else np.zeros(0, np.int64) for k in (1, 2))
    if len(words) != len(p.keys) or len(pairs) != len(p.pair_keys):
        raise RuntimeError("a part's totals don't match its keys")
    return p, words, pairs


def context_bucket(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1]  # 0 for an unseen context, then 1 + floor(log2 n)


def estimates(p: Open, words: np.ndarray, pairs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket, bigram estimate and unigram estimate of each bigram."""
    context = words[p.context_at]
    return context_bucket(context), pairs / np.maximum(context, 1), words[p.second_at] / max(total, 1)


CELLS = "b long, c2 long, c long, c1 long, n long"


def deleted_cells(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """(b, c2, c, c1, n): how many deleted tokens of a part have the context bucket, bigram, context and unigram count. c is zero where c2 is."""

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        got = opened(left, right, "kept")
        if got is None:
            return pa.Table.from_batches([arrow([], CELLS)])
        p, words, pairs = got
        context = words[p.context_at]
        cols = [context_bucket(context).astype(np.int64), pairs, np.where(pairs > 0, context, 0), words[p.second_at]]
        code, known = np.zeros(len(pairs), np.int64), []
        for c in cols:
            values, at = np.unique(c, return_inverse=True)
            known.append(values)
            code = np.unique(code, return_inverse=True)[1] * len(values) + at
        _, one, at = np.unique(code, return_index=True, return_inverse=True)
        return pa.table(dict(zip("b c2 c c1 n".split(), [*(c[one] for c in cols), np.bincount(at, p.pair_n).astype(np.int64)], strict=True)))

    asked = parts.where(F.col("role") == DELETED)
    given = totals.join(asked.select(F.col("part").alias("child")), "child", "left_semi").select("kind", "bucket", "child", "kept")
    return asked.groupBy("part").cogroup(given.groupBy("child")).applyInArrow(cells, CELLS)


def learn(cells: DataFrame, total: int, uniform: float, rounds: int) -> dict[int, tuple[float, float, float]]:
    """Weights (bigram, unigram, uniform) by context bucket, by expectation-maximisation over the cells; 66 buckets at most."""
    estimate = F.col("c2") / F.greatest("c", F.lit(1)), F.col("c1") / F.lit(max(total, 1)), F.lit(uniform)
    table = np.full((66, 3), 1 / 3)
    weights = {}
    for _ in range(rounds):
        share = [F.get(F.array(*map(F.lit, table[:, i].tolist())), F.col("b").cast("int")) * estimate[i] for i in range(3)]
        shared = cells.select("b", "n", *(s.alias(f"s{i}") for i, s in enumerate(share)))
        part = F.col("n") / (F.col("s0") + F.col("s1") + F.col("s2"))
        rows = shared.groupBy("b").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}") * part).alias(f"w{i}") for i in range(3))).collect()
        for r in rows:
            table[r.b] = [r.w0 / r.n, r.w1 / r.n, r.w2 / r.n]
        weights = {r.b: None for r in rows}
    for b in weights:
        w = np.maximum(table[b], 1e-9)
        weights[b] = tuple(w / w.sum())
    return weights


def weight_table(weights: dict[int, tuple[float, float, float]], size: int = 66) -> np.ndarray:
    """A row a bucket; a bucket without deleted tokens takes the next lower one's, the lowest takes (0, 1, 1) halves."""
    table, last = np.empty((size, 3)), (0.0, 0.5, 0.5)
    for b in range(size):
        last = weights.get(b, last)
        table[b] = last
    return table


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_parts(parts: DataFrame, totals: DataFrame, total: int, distinct: int, weights: np.ndarray) -> DataFrame:
    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORES.split(", ")]
        got = opened(left, right, "both")
        if got is None:
            types = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
            return pa.table({k: pa.array([], t) for k, t in zip(names, types, strict=True)})
        p, words, pairs = got
        bucket, f2, f1 = estimates(p, words, pairs, total)
        w = weights[bucket]
        token = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (distinct + 1))[p.pair_at]
        base = np.log10((words + 0.5) / (total + 0.5 * (distinct + 1)))[p.word_at]
        starts = np.cumsum(p.lengths) - p.lengths
        add = lambda x: np.add.reduceat(x, starts)
        n = len(starts)
        cols = [pa.array(p.ids, mask=~p.valid), pa.array(np.full(n, p.role == HELD_OUT)), p.lengths, add((words > 0)[p.word_at].astype(np.int64)), np.full(n, total), add(base), add(token)]
        return pa.table(dict(zip(names, cols, strict=True)))

    given = totals.select("kind", "bucket", "child", "both").groupBy("child")
    return parts.groupBy("part").cogroup(given).applyInArrow(scores, SCORES)


def lm_scores(docs: DataFrame, part_tokens: int = 4_000_000, bucket_keys: int = 500_000, fan: int = 1024, rounds: int = 20) -> DataFrame:
    """Scores of every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    parts = save(make_parts(docs, part_tokens))
    n_parts, words, pairs = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_pairs"), F.lit(0))).first()
    totals = totals_of(parts, n_parts, {1: words, 2: pairs}, bucket_keys, fan)
    n_kept, n_both, v_kept, v_both = totals.where("kind = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_kept", "n_both", "v_kept", "v_both"))).first()
    cells = save(deleted_cells(parts, totals).groupBy("b", "c2", "c", "c1").agg(F.sum("n").alias("n")))  # equal cells of all parts are one in the rounds
    weights = weight_table(learn(cells, n_kept, 1 / (v_kept + 1), rounds))
    return score_parts(parts, totals, n_both, v_both, weights)
