"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors are one row with a multiplicity. Rows are dealt to shards by hash. Each shard's
vectors become one layered graph, written to the shared folder and opened by path; every vector then
queries the graph of every shard, in tasks of one graph and slot_rows queries. A search whose whole
beam lies above the threshold may have missed links and is repeated with a wider beam. From
4 * beam on, crowded queries that are near one of them (the pivot) are answered together: the beam
is unbounded in number then and bounded by angle, so a flood over the graph's links, followed both
ways, from the pivot gathers every node that could be within the threshold of any of the group, and
the group is compared with those in blocks. Nodes that pruning left without a way to them get a link
from the nearest node that has one.

Each task audits itself against its whole shard, on samples by hash: of the queries whose beam came
near the threshold, of those whose beam didn't, and of all queries, whatever way and whether at all
their links were found. Of the first two strata, the one whose links (those to themselves left out)
fall short of the recall asked for is searched again with wider beams: its sample tries doubled ones
until the audit passes or three doublings in a row find no more. The recall of all samples is
reported, or that of the third alone where it is lower. Every link is verified by cosine in double precision. A task keeps a count for each query and one label a
node, and returns counts and a forest; components join those. Shards are sized by bytes, so a task's
memory doesn't grow with the vectors' length.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors
of different lengths don't link. Repeated rows are vectors of their own and link with each other;
a null id is ignored for the smallest id of a component. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import components, cut, shared_file, shared_folder, spread_join



# ---- one graph -----------------------------------------------------------------------------------


def beam_search(links: np.ndarray, vecs: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Each query's best `width` nodes (ids, similarities, -1 and -inf where none) of one layer, from its entry nodes (rows of ids)."""
    n, width = len(queries), max(width, entry.shape[1])
    ids = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    k = entry.shape[1]
    ids[:, :k] = entry
    sims[:, :k] = np.einsum("qkd,qd->qk", vecs[entry], queries)
    done[:, :k] = False
    live = np.arange(n)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_sims, min(step, width) - 1, axis=1)[:, :step] if step < width else np.tile(np.arange(width), (len(live), 1))
        use = np.take_along_axis(open_sims, pick, 1) > -np.inf
        some = use.any(1)
        live, pick, use = live[some], pick[some], use[some]
        if not len(live):
            break
        at = np.where(use, np.take_along_axis(ids[live], pick, 1), -1)
        flags = done[live]
        np.put_along_axis(flags, pick, True, 1)
        done[live] = flags
        found = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
        found.sort(1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        known = np.sort(ids[live], 1)
        # a node already in the beam: look it up in the sorted beam, all rows at once
        base = np.arange(len(live))[:, None] * (len(vecs) + 1)
        flat = (known + 1 + base).ravel()
        spot = np.minimum(np.searchsorted(flat, (found + 1 + base).ravel()), len(flat) - 1)
        found[(flat[spot] == (found + 1 + base).ravel()).reshape(found.shape)] = -1
        near = np.full(found.shape, -np.inf, np.float32)
        worst = sims[live].min(1)
        r, c = np.nonzero(found >= 0)
        s = np.einsum("kd,kd->k", vecs[found[r, c]], queries[live[r]])
        good = s > worst[r]
        near[r[good], c[good]] = s[good]
        all_sims = np.concatenate([sims[live], near], 1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], found], 1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.isinf(near)], 1), best, 1)
    ids[np.isinf(sims)] = -1
    return ids, sims


def diverse(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, vecs: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, up to keep: first those nearer to the row's own vector than to any chosen one, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = ids.shape
    out = np.full((rows, keep), -1, np.int64)
    for at in range(0, rows, 512):
        part, own = ids[at : at + 512], sims[at : at + 512]
        v = vecs[np.maximum(part, 0)]
        between = v @ v.transpose(0, 2, 1)
        valid = (part >= 0) & (part != owner[at : at + 512, None])
        chosen = np.zeros(part.shape, bool)
        for j in range(width):
            nearer = (np.where(chosen[:, :j], between[:, j, :j], -np.inf).max(1, initial=-np.inf) < own[:, j]) if j else True
            chosen[:, j] = valid[:, j] & nearer & (chosen.sum(1) < keep)
        rank = np.where(chosen, 0, np.where(valid, 1, 2))
        take = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        got = np.where(np.take_along_axis(rank, take, 1) < 2, np.take_along_axis(part, take, 1), -1)
        out[at : at + 512, : got.shape[1]] = got
    return out


class Graph:
    """A layered graph over unit vectors. Nodes are ordered by falling level, so layer l holds the first sizes[l] nodes."""

    def __init__(self, vecs: np.ndarray, links: list[np.ndarray]) -> None:
        self.vecs, self.links = vecs, links
        self.back: tuple[np.ndarray, np.ndarray] | None = None  # sources of the lowest layer's links by target, and where each target's begin

    @classmethod
    def build(cls, vecs: np.ndarray, levels: np.ndarray, m: int = 12, beam: int = 48) -> tuple[Graph, np.ndarray]:
        order = np.argsort(-levels, kind="stable")
        g = cls(np.ascontiguousarray(vecs[order]), [])
        sizes = [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)]
        g.links = [np.full((n, 2 * m if level == 0 else m), -1, np.int64) for level, n in enumerate(sizes)]
        for level in range(len(sizes) - 1, -1, -1):
            g.fill(level, m, beam)
            g.connect(level)
        return g, order

    def fill(self, level: int, m: int, beam: int) -> None:
        links, n = self.links[level], len(self.links[level])
        at = 0
        while at < n:
            size = min(n - at, max(128, min(at, 1024)))
            new = np.arange(at, at + size)
            q = self.vecs[new]
            inside = q @ q.T
            np.fill_diagonal(inside, -np.inf)
            k = min(size - 1, beam // 2)
            near = np.argpartition(-inside, k - 1, axis=1)[:, :k] if 0 < k < size - 1 else np.tile(np.arange(size), (size, 1))[:, : max(size, 1)]
            ids, sims = new[near], np.take_along_axis(inside, near, 1)
            if at:
                found, fs = beam_search(links, self.vecs, q, self.entry(q, level), beam)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, fs], 1)
            chosen = diverse(new, np.where(np.isinf(sims), -1, ids), sims, self.vecs, m)
            links[new, :m] = chosen
            self.link_back(links, new, chosen)
            at += size

    def link_back(self, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """Link the chosen nodes to the new ones, and thin out where a node has more links than places."""
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sims = np.einsum("kd,kd->k", self.vecs[src], self.vecs[dst])
        order = np.lexsort((-sims, dst))
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        fits = place < links.shape[1]
        more = np.full((len(nodes), min(int(count.max(initial=0)), links.shape[1])), -1, np.int64)
        more[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = src[fits]
        both = np.concatenate([links[nodes], more], 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        for at in range(0, len(nodes), 1024):
            own, cand = nodes[at : at + 1024], both[at : at + 1024]
            s = np.where(cand >= 0, np.einsum("nkd,nd->nk", self.vecs[np.maximum(cand, 0)], self.vecs[own]), -np.inf)
            links[own] = diverse(own, cand, s, self.vecs, links.shape[1])

    def connect(self, level: int) -> None:
        """Give every node that no links lead to from node 0 a link from the nearest node that has them, one a node and round."""
        links = self.links[level]
        seen, front = np.zeros(len(links), bool), np.zeros(min(1, len(links)), np.int64)
        while True:
            while len(front):
                seen[front] = True
                front = np.unique(links[front])
                front = front[front >= 0]
                front = front[~seen[front]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            lost = lost[:4096]
            q = self.vecs[lost]
            host, near = (x[:, 0] for x in beam_search(links, self.vecs, q, self.entry(q, level), 1, 1))
            own = links[lost]  # a node's own links may lead nearer than a search does
            s = np.where((own >= 0) & seen[np.maximum(own, 0)], np.einsum("nkd,nd->nk", self.vecs[np.maximum(own, 0)], q), -np.inf)
            best = s.argmax(1)
            better = s.max(1) > near
            host = np.where(better, np.take_along_axis(own, best[:, None], 1)[:, 0], host)
            order = np.argsort(-np.maximum(near, s.max(1)), kind="stable")
            host, at = np.unique(host[order], return_index=True)
            front = lost[order[at]]
            if not (links[host] < 0).any(1).all():
                links = np.concatenate([links, np.full((len(links), 1), -1, np.int64)], 1)
            links[host, (links[host] < 0).argmax(1)] = front
        self.links[level] = links

    def entry(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The node that each query reaches greedily above the level, as rows of one."""
        at = np.zeros((len(queries), 1), np.int64)
        for above in range(len(self.links) - 1, level, -1):
            at = beam_search(self.links[above], self.vecs, queries, at, 1, 1)[0]
        return at

    def flood(self, start: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
        """The nodes at least `bound` similar to the query that links, followed both ways, join to the start nodes through such nodes."""
        if self.back is None:
            src, dst = np.nonzero(self.links[0] >= 0)[0], self.links[0][self.links[0] >= 0]
            order = np.argsort(dst, kind="stable")
            self.back = src[order], np.searchsorted(dst[order], np.arange(len(self.vecs) + 1))
        back, starts = self.back
        seen = np.zeros(len(self.vecs), bool)
        seen[start] = True
        front, out = start, [start]
        while len(front):
            count = starts[front + 1] - starts[front]
            own = np.repeat(starts[front] - np.cumsum(count) + count, count) + np.arange(count.sum())
            near = np.unique(np.concatenate([self.links[0][front].ravel(), back[own]]))
            near = near[near >= 0]
            near = near[~seen[near]]
            seen[near] = True
            front = near[self.vecs[near] @ query >= bound]
            out.append(front)
        return np.concatenate(out)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        out = [beam_search(self.links[0], self.vecs, q, self.entry(q, 0), width) for q in (queries[i : i + 2048] for i in range(0, len(queries), 2048))]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---- links of queries with one shard -------------------------------------------------------------


class Tally:
    """Links of some queries with a shard, as a weighted count for each query and a label for each row id."""

    def __init__(self, q_rids: np.ndarray, q: np.ndarray, v_rids: np.ndarray, v: np.ndarray, weight: np.ndarray, threshold: float) -> None:
        self.q, self.v, self.weight, self.threshold = q, v, weight, threshold
        self.q_norm, self.v_norm = (np.linalg.norm(x, axis=1) for x in (q, v))
        self.q_rids, self.v_rids = q_rids, v_rids
        self.rids, at = np.unique(np.concatenate([q_rids, v_rids]), return_inverse=True)
        self.q_at, self.v_at = at[: len(q_rids)], at[len(q_rids) :]
        self.clear()

    def clear(self) -> None:
        self.counts = np.zeros(len(self.q), np.int64)
        self.label = np.arange(len(self.rids))

    def true_counts(self, queries: np.ndarray, unit_q: np.ndarray, unit_v: np.ndarray) -> np.ndarray:
        """The number of links of some queries by comparing them with everything."""
        out = np.zeros(len(queries), np.int64)
        rows = max(1, (1 << 22) // max(1, len(unit_v)))
        for at in range(0, len(queries), rows):
            own = queries[at : at + rows]
            i, j = np.nonzero(unit_q[own] @ unit_v.T >= self.threshold - 1e-5)
            ok = self.real(own[i], j)
            out[at : at + rows] = np.bincount(i[ok], self.weight[j[ok]], len(own)).astype(np.int64)
        return out

    def cosine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = self.q[i], self.v[j]
        return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))

    def real(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are links."""
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            own = slice(at, at + (1 << 16))
            out[own] = (self.cosine(i[own], j[own]) >= self.threshold) & (self.q_rids[i[own]] != self.v_rids[j[own]])
        return out

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[self.q_at[i]], self.label[self.v_at[j]]
        if (a != b).any():
            a, b = np.divmod(np.unique(a * len(self.rids) + b), len(self.rids))
            node, root = span(a, b)
            to = np.arange(len(self.rids))
            to[node] = root
            self.label = to[self.label]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count distinct pairs that are links."""
        ok = self.real(i, j)
        self.counts += np.bincount(i[ok], self.weight[j[ok]], len(self.counts)).astype(np.int64)
        self.join(i[ok], j[ok])

    def add_block(self, group: np.ndarray, region: np.ndarray) -> None:
        """Compare all of a group of queries with all of some nodes, some millions of pairs at a time."""
        y = self.v[region]
        rows = max(1, (1 << 22) // max(1, len(region)))
        for at in range(0, len(group), rows):
            own = group[at : at + rows]
            s = self.q[own] @ y.T / self.q_norm[own][:, None] / self.v_norm[region]
            hit = s >= self.threshold
            i, j = np.nonzero(np.abs(s - self.threshold) < 1e-9)  # rounding could tell these otherwise than the plain formula
            hit[i, j] = self.cosine(own[i], region[j]) >= self.threshold
            hit &= self.q_rids[own][:, None] != self.v_rids[region]
            self.counts[own] += (hit @ self.weight[region].astype(np.float64)).astype(np.int64)
            if len(np.unique(np.concatenate([self.label[self.q_at[own]], self.label[self.v_at[region]]]))) > 1:
                i, j = np.nonzero(hit)
                self.join(own[i], region[j])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.rids[own], self.rids[self.label[own]]


def crowded_links(g: Graph, queries: np.ndarray, left: np.ndarray, threshold: float, tally: Tally) -> None:
    """Links of the queries left, group by group: a pivot, the queries within the threshold of it, and the flood of the nodes within twice its angle."""
    wide = math.cos(min(math.pi, 2 * math.acos(max(-1.0, threshold - 1e-5)))) - 1e-5
    while len(left):
        pivot = queries[left[0]]
        near = queries[left] @ pivot >= threshold
        near[0] = True
        found = g.search(pivot[None], 64)[0][0]
        tally.add_block(left[near], g.flood(found[found >= 0], pivot, wide))
        left = left[~near]


def hashed_first(rids: np.ndarray, most: int) -> np.ndarray:
    return np.argsort(rids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:most]


def beam_links(g: Graph, queries: np.ndarray, asked: np.ndarray, threshold: float, beam: int, tally: Tally) -> tuple[np.ndarray, np.ndarray]:
    """Put the links of the asked queries into tally, from beams that widen to 4 * beam. The best similarity each query met, and the queries left, whose widest beam lay above the threshold."""
    bound = threshold - 1e-5  # single precision; pairs are verified later
    tally.counts[asked] = 0
    best, left, width = np.full(len(queries), -np.inf), asked, beam
    while len(left):
        ids, sims = g.search(queries[left], width)
        own = np.where((ids >= 0) & (tally.v_rids[np.maximum(ids, 0)] != tally.q_rids[left][:, None]), sims, -np.inf)
        best[left] = own.max(1)
        full = (sims.min(1) >= bound) & (width < len(g.vecs))
        i, j = np.nonzero((sims >= bound) & ~full[:, None])
        tally.add(left[i], ids[i, j])
        left = left[full]
        if width >= 4 * beam:
            break
        width *= 2
    return best, left


def shard_links(g: Graph, queries: np.ndarray, threshold: float, beam: int, audit: int, recall: float, tally: Tally) -> tuple[float, int]:
    """Put all links of the queries into tally. The recall of the audited queries' links, and how many audited queries have links.

    Queries fall into strata: those whose beam came near the threshold, the other ones, and crowded
    ones, answered by flood. Of the first two, each has a hashed sample of its own. Where its audit
    fails, the sample is searched again with beams twice as wide, until it passes or three doublings
    in a row find no more of its links; then its stratum is searched again, once, with the first
    beam that found the most. What is told is the recall of a sample of all queries however
    answered, or of this and the strata's samples together where that is lower.
    """
    known: dict[int, int] = {}

    def true_counts(sample: np.ndarray) -> np.ndarray:
        new = np.array([k for k in sample.tolist() if k not in known], np.int64)
        known.update(zip(new.tolist(), tally.true_counts(new, queries, g.vecs).tolist(), strict=True))
        return np.array([known[k] for k in sample.tolist()], np.int64)

    def audited(sample: np.ndarray) -> tuple[float, int]:
        true = true_counts(sample)
        some = true > 0
        return (float((tally.counts[sample[some]] / true[some]).mean()) if some.any() else 1.0), int(some.sum())

    def again(asked: np.ndarray, width: int) -> None:
        crowded_links(g, queries, beam_links(g, queries, asked, threshold, width, tally)[1], threshold, tally)

    everyone = hashed_first(tally.q_rids, audit)
    best, left = beam_links(g, queries, np.arange(len(queries)), threshold, beam, tally)
    crowded_links(g, queries, left, threshold, tally)
    beamed = np.setdiff1d(np.arange(len(queries)), left)
    near = best[beamed] >= threshold - 0.05
    samples = [everyone]
    for stratum in (beamed[near], beamed[~near]):
        sample = stratum[hashed_first(tally.q_rids[stratum], audit)]
        # what the second stratum links with is all lost, so it is judged together with the linked queries of the first
        judged = sample if len(samples) == 1 else np.union1d(sample, np.intersect1d(everyone, beamed))
        got = audited(judged)[0]
        width, vain, chosen, reached = beam, 0, beam, got
        while got < recall and width < len(g.vecs) and vain < 3:
            width *= 2
            again(sample, width)
            got = audited(judged)[0]
            vain, chosen, reached = (0, width, got) if got > reached else (vain + 1, chosen, reached)
        if width > beam:  # the sample, too, is held to the width that its stratum gets
            again(stratum if chosen > beam else sample, chosen)
        samples.append(sample)
    reached, seen = audited(np.unique(np.concatenate(samples)))
    return min(reached, audited(everyone)[0]), seen


def span(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the links a - b, by lowest labels."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


# ---- the job -------------------------------------------------------------------------------------


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision, by a power of two each (which changes no digit), so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled vectors at length one, in single precision."""
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """rid (the smallest of its rows), times and embedding of every distinct vector that can link."""
    plain = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    return rows.where(plain).groupBy("embedding").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("times"))


GRAPHS = "shard int, dim int, rows long, path string"


def build_graphs(vectors: DataFrame, shards: int, m: int, beam: int, folder: str) -> DataFrame:
    """A graph for each shard and length of the vectors, as a file each: row ids, multiplicities, vectors, and links by layer."""

    def make(table: pa.Table) -> pa.Table:
        shard, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
        rids, times = (table[c].to_numpy() for c in ("rid", "times"))
        vecs = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.argsort(rids, kind="stable")
        rids, times, vecs = rids[order], times[order], vecs[order]
        coin = ((rids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) >> np.uint64(11)).astype(np.float64) / 2.0**53
        levels = np.floor(-np.log(np.maximum(coin, 1e-300)) / math.log(m)).astype(np.int64)
        g, order = Graph.build(unit(scaled(vecs)), levels, m, beam)
        held = io.BytesIO()
        np.savez(held, rids=rids[order], times=times[order], vecs=vecs[order], **{f"links{i}": x.astype(np.int32) for i, x in enumerate(g.links)})
        path = f"{folder}/{shard}-{dim}-{uuid.uuid4().hex}.npz"  # a task that is run again writes a file of its own
        with shared_file(path, "w") as f:
            f.write(held.getbuffer())
        return pa.table({"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "rows": pa.array([len(rids)], pa.int64()), "path": [path]})

    keyed = vectors.select("rid", "times", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"))
    return keyed.groupBy("shard", "dim").applyInArrow(make, GRAPHS)


def opened(path: str, queries: slice | None = None) -> tuple:
    """Row ids, multiplicities, vectors and graph of a file; only the first and third, of a slice of rows, for queries."""
    with shared_file(path, "r") as f, np.load(f) as z:
        if queries is not None:
            return z["rids"][queries], z["vecs"][queries]
        vecs = scaled(z["vecs"])
        links = [z[f"links{i}"].astype(np.int64) for i in range(len(z.files) - 3)]
        return z["rids"], z["times"], vecs, Graph(unit(vecs), links)


FOUND = "kind int, a long, b long"


def linked(vectors: DataFrame, n_bytes: int, threshold: float, shard_bytes: int, slot_rows: int, min_shards: int, m: int, beam: int, recall: float, audit: int) -> DataFrame:
    """Rows (kind, a, b): 0, a query and its number of links with a shard; 1, the ends of a forest's link; 2, audited queries of a task and their recall in millionths."""
    spark = vectors.sparkSession
    shards = max(min_shards, -(-n_bytes // shard_bytes))
    graphs = cut(build_graphs(vectors, shards, m, beam + beam // 2, shared_folder(spark, "graphs")))
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(slot_rows).cast("long"))).alias("at")
    asks = graphs.select("dim", F.col("path").alias("queries"), slots)
    tasks = graphs.select("dim", "path").join(asks, "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, other, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                v_rids, times, vecs, g = opened(path)
                q_rids, q = opened(other, slice(at, at + slot_rows))
                q = scaled(q)
                tally = Tally(q_rids, q, v_rids, vecs, times, threshold)
                reached, audited = shard_links(g, unit(q), threshold, beam, audit, recall, tally)
                some, ends = np.flatnonzero(tally.counts), tally.forest()
                kind = np.repeat(np.array([0, 1, 2], np.int32), [len(some), len(ends[0]), 1])
                a, b = [q_rids[some], ends[0], [audited]], [tally.counts[some], ends[1], [round(reached * 1e6)]]
                yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b))], names=["kind", "a", "b"])

    count = tasks.count()
    return cut(tasks.select("path", "queries", "at").repartition(max(1, min(count, 100_000)), "path", "queries", "at").mapInArrow(run, FOUND))


def near_vectors(
    embeddings: DataFrame, threshold: float = 0.9, shard_bytes: int = 128 << 20, slot_rows: int = 50_000, min_shards: int = 4,
    m: int = 12, beam: int = 32, recall: float = 0.999, audit: int = 512, report: dict | None = None,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings.

    shard_bytes: of a shard's vectors in single precision; a task holds some five times as much.
    report, if given, gets the number of audited queries with links, their mean recall, and that of
    the lowest task.
    """
    kind = "array<double>" if dict(embeddings.dtypes)["embedding"] == "array<double>" else "array<float>"
    rows = cut(embeddings.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")))
    vectors = cut(distinct_vectors(rows))
    n_bytes = vectors.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 4), F.lit(0))).first()[0]
    found = linked(vectors, n_bytes, threshold, shard_bytes, slot_rows, min_shards, m, beam, recall, audit)
    if report is not None:
        audited, reached, lowest = found.where("kind = 2").agg(F.sum("a"), F.sum(F.col("a") * F.col("b")) / F.greatest(F.sum("a"), F.lit(1)) / 1e6, F.min("b") / 1e6).first()
        report.update(audited=audited or 0, recall=reached, lowest=lowest)
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("linked"))
    roots = components(found.where("kind = 1"), "a", "b")
    reps = vectors.select("rid", "times", "embedding").join(counts, F.col("rid") == F.col("a"), "left").drop("a").join(roots, F.col("rid") == F.col("node"), "left")
    reps = reps.select("embedding", F.coalesce("root", "rid").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    # rows without a vector stand aside: as nulls of a join's key they would all meet in one task
    there = rows.where("embedding is not null").join(reps, "embedding", "left").select("rid", "vec_id", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = cut(there.union(rows.where("embedding is null").select("rid", "vec_id", F.lit(None).cast("long"), F.lit(0).cast("long"))))
    least = named.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    alone = named.where("root is null").select("vec_id", "n_links", F.col("vec_id").alias("component_id"))
    out = spread_join(named.where("root is not null"), least, "root", "rid").select("vec_id", "n_links", F.col("least").alias("component_id")).union(alone)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)))
