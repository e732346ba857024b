"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint is the bitwise majority of its word shingles' 64-bit hashes. Fingerprints that
differ in at most `distance` bits are linked. With `blocks` blocks of bits, at most `distance` of
them can hold a difference, so every linked pair agrees on some choice of blocks - distance whole
blocks: fingerprints are grouped by each such choice and compared inside the groups only, bit by
bit. Two agreeing blocks of six (about 21 bits) keep the groups small; equal fingerprints are one
row from the start.

A group gives a spanning forest of its links, not all pairs. A group above max_group is dealt into
chunks that are compared two at a time by separate tasks, so no task holds more than two chunks.

Null and empty texts have fingerprint zero, linked like any other. Repeated rows each give a row.
Null ids are ignored for the smallest id of a component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import components, cut, spread_join

BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.int64)


def shingle_hashes(raw: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit hashes of a UTF-8 text's word shingles in their order, repeats included. A text of fewer words is one shingle."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[-n:] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes, unsigned."""
    n = len(hashes)
    h = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(h[:, i], minlength=256) @ BITS for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    return majority(shingle_hashes(raw, width, seed))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_hash (64 bits of the text, for telling rows of one id apart) and fp (signed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, text_hash long, fp long")


def masks(distance: int, blocks: int) -> list[int]:
    """The masks of all choices of blocks - distance blocks, as signed 64-bit integers."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(block, blocks - distance))]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that span the links among fps: each node reached is compared with those not yet reached."""
    edges, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = []
            for at in range(0, len(front), 256):
                part = front[at : at + 256]
                near = np.bitwise_count(fps[part, None] ^ fps[None, rest]) <= distance
                hit = near.any(0)
                if hit.any():
                    edges += zip(part[near[:, hit].argmax(0)].tolist(), rest[hit].tolist(), strict=True)
                    reached.append(rest[hit])
                    rest = rest[~hit]
                    if not len(rest):
                        break
            front = np.concatenate(reached) if reached else front[:0]
    return edges


def group_links(distance: int):
    """A mapInArrow function: rows sorted by their group columns, the last column fp -> links (a, b)."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]])) if len(fp) else np.zeros(1, np.int64)
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [fp[two]], [fp[two + 1]]
        for at, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if got := forest(fp[at : at + n], distance):
                i, j = np.array(got).T
                a.append(fp[at + i])
                b.append(fp[at + j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = held_fp = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:-1]], 1)
            fp = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            if held_fp is not None:
                key, fp = np.concatenate([held_key, key]), np.concatenate([held_fp, fp])
            last = int(np.flatnonzero((key != key[-1]).any(1)).max(initial=-1)) + 1  # the last group may go on
            held_key, held_fp = key[last:], fp[last:]
            yield links(key[:last], fp[:last])
        if held_fp is not None:
            yield links(held_key, held_fp)

    return run


def near_links(fps: DataFrame, distance: int = 4, blocks: int = 6, max_group: int = 8192) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column fp, distinct) within distance of each other."""
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(distance, blocks)))).alias("choice", "bits"))
    shared = cut(keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a block with a ten-thousandth of all rows or more is one of 10,000 a choice at most: these are sent to
    # the rows, which are dealt into chunks where they stand; no other block brings a join much into one task
    rows, crowd = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = max(max_group, rows // 10_000)
    joined = keyed.join(shared.where(F.col("n") <= most), ["choice", "bits"])
    if crowd > most:
        joined = joined.unionByName(keyed.join(F.broadcast(shared.where(F.col("n") > most)), ["choice", "bits"]))
    chunks = F.ceil(F.col("n") / max_group).cast("int")
    dealt = joined.withColumn("own", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
    dealt = dealt.select("choice", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    dealt = dealt.select("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = dealt.repartition("choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j")
    return dealt.mapInArrow(group_links(distance), "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """doc_id, text_hash, fp, root (the smallest fp reachable by links) and component_id (the smallest doc_id) of every row of docs."""
    rows = cut(fingerprints(docs, width))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(near_links(reps.select("fp"), distance, blocks), "a", "b")
    named = reps.join(roots, reps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(spread_join(named, least, "root", "fp").select("fp", "root", "component_id"), "fp")


def simhash_dedup(docs: DataFrame, width: int = 5, distance: int = 4, blocks: int = 6) -> DataFrame:
    """One row of each group of docs, all columns: the smallest doc_id (null last), then the smallest text hash; equal rows are one."""
    groups = simhash_groups(docs, width, distance, blocks)
    # by root: an id may be null or stand in several components
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("__lf_first"))
    first = first.select("__lf_first.doc_id", "__lf_first.text_hash").toDF("__lf_id", "__lf_hash")
    hashed = docs.withColumn("__lf_text", F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(first, F.col("doc_id").eqNullSafe(F.col("__lf_id")) & (F.col("__lf_text") == F.col("__lf_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__lf_text"]).drop("__lf_text")
