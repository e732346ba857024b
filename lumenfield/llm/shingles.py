"""Near-duplicates by the Jaccard similarity of word shingles: SimHash by pigeonhole blocks, banded min-hashes for what it leaves apart, exact verification.

Texts are sets of the 64-bit hashes of their word shingles; texts of equal sets are one node. First
come op5's fingerprints of the same shingles: those within `distance` bits, found by pigeonhole
blocks, are closed to components, and a component's sets are compared with each other. Sets with
similarity 0.8 differ in about ten of a fingerprint's 64 bits, beyond what whole blocks can find, so
the rest is completed by min-hashes: `bands` bands of `rows` minima each, and sets that agree on a
whole band and that the fingerprints haven't joined yet are compared. A pair of similarity s is
missed by all bands with probability (1 - s^rows)^bands: 6e-5 at 0.8 and less above it. Whether
candidates are linked is settled by their whole shingle sets, not by an estimate.

A group (a component of fingerprints, or a band's key) gives a spanning forest of its links. A group
above max_group is dealt into chunks, each member once and in each band by another hash, and chunks
are linked first: over fingerprints and 32 bands that joins nearly all that belongs together. Then
each such group's members are told by the component that they are in by now. Those that aren't in
the group's largest one visit all its chunks and are compared with the members of other components.
So rows dealt are in proportion to the group, plus its chunks for each member that isn't linked to
the rest, and no pair of a group is left uncompared but those already joined. Only sets in groups of
several carry their shingles.

Most rows have no like: they are told where they stand by broadcast marks (perhaps_in), so that only
rows of keys that occur twice are shuffled: texts in groups of several, bands that sets share, and,
at the end, rows that aren't alone. The counts of band keys are shuffled, with nothing but the key.

Null and empty texts have the empty set and are copies of each other. Null ids come after all others
when the row that stays is chosen. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .util import components, cut, narrowed, perhaps_in

ROWS, BANDS = 6, 32
#: Stands in the place of a band's number for groups of fingerprints.
CLOSE = -1
ODD, SALT = np.random.default_rng(42).integers(0, 2**64, (2, ROWS * BANDS), np.uint64)
ODD |= np.uint64(1)


def shingle_set(raw: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct 64-bit hashes of a UTF-8 text's word shingles, sorted. A text of fewer words is one shingle."""
    return np.unique(simhash.shingle_hashes(raw, width, seed))


def node(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each band's minima."""
    low = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        low = np.minimum(low, ((shingles[at : at + 512, None] ^ SALT) * ODD).min(0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, text_hash, node, fp (SimHash, signed) and bands (array) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [simhash.shingle_hashes(t, width) for t in batch.column(2).to_pylist()]
            fps = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([node(s) for s in sets], pa.int64()), pa.array(fps), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "fp", "bands"],
            )

    return hashed(docs).mapInArrow(run, "doc_id long, text_hash long, node long, fp long, bands array<long>")


def hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Index pairs that span the links among sets: each set reached is compared with those not yet reached."""
    edges, size = [], np.fromiter(map(len, sets), np.int64, len(sets))
    rest, queue = np.arange(len(sets)), []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        i = queue.pop()
        able = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i])]
        if not len(able) or not size[i]:
            continue
        flat = np.concatenate([sets[j] for j in able.tolist()])
        found = sets[i][np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)] == flat
        both = np.add.reduceat(found.astype(np.int64), np.cumsum(size[able]) - size[able])
        near = able[both >= similarity * (size[i] + size[able] - both)]
        edges += [(i, j) for j in near.tolist()]
        queue += near.tolist()
        rest = np.setdiff1d(rest, near, assume_unique=True)
    return edges


def group_links(similarity: float):
    """A mapInArrow function: rows band, key, i, node, shingles sorted by the first three -> links (a, b)."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        got = forest(sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, sets = None, [], []
        for batch in batches:
            for *group, name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != held:
                    if len(nodes) > 1:
                        yield links(nodes, sets)
                    held, nodes, sets = group, [], []
                nodes.append(name)
                sets.append(np.frombuffer(raw, np.uint64))
        if len(nodes) > 1:
            yield links(nodes, sets)

    return run


def cross_links(residents: list[tuple], visitor: tuple, similarity: float, joined: dict[int, int]) -> list[tuple[int, int]]:
    """Links of a visitor (node, root, set) with the residents of other components, one a component; joined: what became of roots here."""

    def top(root: int) -> int:
        while joined.get(root, root) != root:
            root = joined[root]
        return root

    name, root, own = visitor
    out, n = [], len(own)
    able = [r for r in residents if top(r[1]) != top(root) and min(n, len(r[2])) >= similarity * max(n, len(r[2]))]
    if not n or not able:
        return out
    size = np.fromiter((len(r[2]) for r in able), np.int64, len(able))
    flat = np.concatenate([r[2] for r in able])
    found = own[np.minimum(np.searchsorted(own, flat), n - 1)] == flat
    both = np.add.reduceat(found.astype(np.int64), np.cumsum(size) - size)
    for i in np.flatnonzero(both >= similarity * (n + size - both)).tolist():
        if top(able[i][1]) != top(root):
            joined[top(able[i][1])] = top(root)
            out.append((name, able[i][0]))
    return out


def visit_links(similarity: float):
    """A mapInArrow function: rows band, key, i, visits, node, root, shingles sorted by the first four -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, residents, joined = None, [], {}
        for batch in batches:
            out = []
            for *group, visits, name, root, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != held:
                    held, residents, joined = group, [], {}
                one = (name, root, np.frombuffer(raw, np.uint64))
                if visits:
                    out += cross_links(residents, one, similarity, joined)
                else:
                    residents.append(one)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def visits_of(crowded: DataFrame, roots: DataFrame, max_group: int) -> DataFrame:
    """Of crowded groups' members (band, key, n, node, i) that aren't all in one component: each once in its chunk i, and those outside the group's largest component as visitors of all chunks."""
    at = ["band", "key"]
    marked = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = marked.groupBy(*at, "root").agg(F.count(F.lit(1)).alias("c"))
    largest = classes.groupBy(*at).agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    still = marked.join(largest.select(*at, "main"), at)
    stay = still.select(*at, "i", F.lit(False).alias("visits"), "node", "root")
    go = still.where("root <> main").select(*at, F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / max_group).cast("int") - 1)).alias("i"), F.lit(True).alias("visits"), "node", "root")
    return stay.unionByName(go)


def sets_of(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """node and shingles of the nodes of members (node, text_hash)."""
    wanted = members.select("text_hash", "node").distinct()
    # copies become one row before they meet: a node's members all name the same text
    texts = narrowed(hashed(docs).select("text_hash", "text"), wanted, "text_hash").dropDuplicates(["text_hash"]).join(wanted, "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, text_hash (the smallest) and bands of every node of rows (sketches); only rows of nodes of several rows are shuffled."""
    several = cut(rows.groupBy("node").count().where("count > 1"))
    told = perhaps_in(rows.select("node", "text_hash", "bands"), several, "node")
    rest = told.where("__lf_in").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"))
    return told.where("not __lf_in").drop("__lf_in").unionByName(rest)


def shared_bands(reps: DataFrame, roots: DataFrame) -> DataFrame:
    """node, text_hash, root, band and key of the bands that nodes share with others, and of some that they don't; root: that of roots (node, root), or the node."""
    banded = reps.select("node", "text_hash", F.posexplode("bands").alias("band", "key"))
    several = cut(banded.groupBy("key").count().where("count > 1"))
    shared = narrowed(banded, several, "key").join(roots, "node", "left")
    return shared.select("node", "text_hash", F.coalesce("root", "node").alias("root"), "band", "key")


def groups_of(keyed: DataFrame, *more) -> DataFrame:
    """band, key, n and members (a number that tells groups apart) of groups of several of keyed (node, band, key); more: further aggregates."""
    return keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), *more).where("n > 1")


def dealt_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect the similar sets of each chunk i of groups' members (band, key, i, node)."""
    dealt = members.select("band", "key", "i", "node").join(sets, "node").select("band", "key", "i", "node", "shingles")
    return dealt.repartition("band", "key", "i").sortWithinPartitions("band", "key", "i").mapInArrow(group_links(similarity), "a long, b long")


def close_groups(rows: DataFrame, reps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """node, text_hash, band (CLOSE) and key of every node: keys are the components of fingerprints that pigeonhole blocks link within distance."""
    roots = components(simhash.near_links(cut(rows.select("fp").distinct()), distance, blocks), "a", "b").toDF("fp", "root")
    own = rows.select("node", "fp").distinct().join(roots, "fp", "left")
    own = own.select("node", F.lit(CLOSE).alias("band"), F.coalesce("root", "fp").alias("key")).distinct()
    return own.join(reps.select("node", "text_hash"), "node").select("node", "text_hash", "band", "key")


def near_sets(docs: DataFrame, rows: DataFrame, width: int, similarity: float, max_group: int, distance: int = 4, blocks: int = 6) -> DataFrame:
    """Links (a, b) that connect the nodes of rows (sketches of docs) whose sets have the similarity and whose fingerprints are close, or that share a band."""
    chunk = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / max_group)).cast("int")
    reps = nodes_of(rows)
    keyed = cut(close_groups(rows, reps, distance, blocks))
    groups = cut(groups_of(keyed))
    close = cut(narrowed(keyed, groups, "key").join(groups.drop("members"), ["band", "key"]).withColumn("i", chunk))
    found = cut(dealt_links(close, sets_of(docs, close, width), similarity))
    roots = components(found, "a", "b").toDF("node", "root")

    keyed = cut(shared_bands(reps, roots))
    # what the fingerprints have joined or compared already isn't compared again, and groups of the same members are compared once
    shared = groups_of(keyed, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    shared = shared.join(groups.select("n", "members"), ["n", "members"], "left_anti")
    shared = cut(shared.groupBy("n", "members").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key", "n"))
    members = cut(narrowed(keyed.drop("root"), shared, "key").join(shared, ["band", "key"]).withColumn("i", chunk))
    links = found.unionByName(dealt_links(members, sets_of(docs, members, width), similarity))
    crowded = close.unionByName(members).where(F.col("n") > max_group)
    if not crowded.limit(1).count():
        return links
    links = cut(links)
    visits = visits_of(crowded, components(links, "a", "b").toDF("node", "root"), max_group)
    visits = visits.join(sets_of(docs, crowded, width), "node").select("band", "key", "i", "visits", "node", "root", "shingles")
    more = visits.repartition("band", "key", "i").sortWithinPartitions("band", "key", "i", "visits").mapInArrow(visit_links(similarity), "a long, b long")
    return links.unionByName(more)


def shingle_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_group: int = 2048) -> DataFrame:
    """doc_id, text_hash and root (one number for each set of rows that links join) of every row of docs."""
    rows = cut(sketches(docs, width))
    roots = components(near_sets(docs, rows, width, similarity, max_group), "a", "b").toDF("node", "root")
    return rows.drop("bands", "fp").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def shingle_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_group: int = 2048) -> DataFrame:
    """One row of each group of docs, all columns: the smallest doc_id, then the smallest text hash; equal rows are one."""
    groups, key = shingle_groups(docs, width, similarity, max_group), ["__lf_none", "__lf_id", "__lf_text"]
    doc_id = F.col("doc_id").cast("long")
    named = lambda d, text: d.withColumns({"__lf_none": doc_id.isNull(), "__lf_id": F.coalesce(doc_id, F.lit(0)), "__lf_text": text})
    rows = named(groups, F.col("text_hash")).groupBy(*key).agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("first.*", F.lit(True).alias("stays"))
    unsure = cut(rows.join(first, key, "left").where("n > 1 or stays is null").select(*key, "stays"))
    # most rows are alone in their group and stay without a shuffle; of the others those go that aren't their group's first
    told = perhaps_in(named(docs, F.xxhash64(F.col("text").cast("string"))), unsure, "__lf_text")
    kept = told.where("__lf_in").join(unsure.where("stays is null"), key, "left_anti").dropDuplicates(key)
    return told.where("not __lf_in").unionByName(kept).drop(*key, "__lf_in")
