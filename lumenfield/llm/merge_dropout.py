"""SentencePiece encoding and decoding with seeded merge-dropout.

A merge-type vocabulary joins adjacent symbols whose concatenation is a piece, best score first,
leftmost first. With dropout, a candidate merge is passed over when a keyed hash falls below the
rate. The key is the seed, the document id, the word's place in the text, the candidate's start and
its piece, so every occurrence of a word is segmented on its own, the same seed gives the same
segmentation, and the rate 0 gives the plain one. Characters outside the vocabulary become byte
pieces, so every text decodes to itself.

How an occurrence is segmented depends only on which of its word's possible candidates (the pieces
that stand in it, at most 63) are dropped. So the hashes are worked out for all candidates of all
occurrences of a batch at once, as a bit mask an occurrence, and each distinct pair of word and mask
of the batch is merged once. A word's candidates stand in the order of the agenda, by rank and then
from the left, and the word's symbol boundaries are a bit set: a candidate can be merged when both
its ends are boundaries and one boundary lies between. Merging takes that boundary away, so only
candidates around the merged one can become possible; where one of them may rank before it, the
agenda starts again. All pairs go through their agendas in step. Words that are long or have more
candidates use a heap, occurrence by occurrence; both give the same pieces.

Null texts count as empty; an empty text has no pieces. A null id hashes as zero. Repeated rows get
equal pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1 << 40)
LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, on arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The tables of a merge-type model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.size = n
        text = {i: model.id_to_piece(i).replace("▁", " ") for i in plain}
        self.bytes = [b""] * n
        for i, s in text.items():
            self.bytes[i] = s.encode()
        self.byte_id = {}
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:-1], 16)
                self.byte_id[b] = i
                self.bytes[i] = bytes([b])
        ids = {s: i for i, s in text.items()}
        self.char_id = {s: i for s, i in ids.items() if len(s) == 1}
        self.long_id = {s: i for s, i in ids.items() if len(s) > 1}
        self.lengths = np.zeros(n, np.int64)
        for s, i in ids.items():
            self.lengths[i] = len(s)
        self.longest = max(map(len, ids))
        self.code_id = np.arange(n, n + 0x110000, dtype=np.int32)
        for c, i in self.char_id.items():
            self.code_id[ord(c)] = i
        # a tree of the pieces' prefixes: per length, (node of all but the last character, last character) -> node, piece or -1
        node: dict[str, int] = {}
        for x in self.long_id:
            for k in range(1, len(x) + 1):
                node.setdefault(x[:k], len(node))
        self.first = np.full(0x110000, -1, np.int64)
        self.levels = []
        for x, k in node.items():
            if len(x) == 1:
                self.first[ord(x)] = k
        for size in range(2, self.longest + 1):
            level = sorted((node[x[:-1]] << 21 | ord(x[-1]), k, self.long_id.get(x, -1)) for x, k in node.items() if len(x) == size)
            self.levels.append(tuple(np.array(c, np.int64) for c in zip(*level, strict=True)))
        self.forget()
        if any(re.search(r"[^ ] ", s) for s in ids):
            raise ValueError("pieces that go on after a space are not supported")
        self.lone_newline = not any("\n" in s and len(s) > 1 for s in ids)
        order = np.lexsort(([i for i in plain], [-model.get_score(i) for i in plain]))
        self.rank = np.full(n + 1, NONE, np.int64)
        self.rank[np.array(plain)[order]] = np.arange(len(plain))
        pairs = {}
        for s, i in ids.items():
            for at in range(1, len(s)):
                left, right = (ids.get(x, n + ord(x) if len(x) == 1 else None) for x in (s[:at], s[at:]))
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        # pieces that may become half of a piece that ranks before them
        self.rewinds = np.zeros(n + 1, bool)
        for k, i in pairs.items():
            for half in (k >> 32, k & 0xFFFFFFFF):
                if half < n and self.rank[half] > self.rank[i]:
                    self.rewinds[half] = True
        self.pairs = pairs
        self.words = re.compile(r"\n| *[^ \n]+| +" if self.lone_newline else r" *[^ ]+| +")

    def symbols(self, word: str) -> list[int]:
        get, n = self.char_id.get, self.size
        return [get(c) if c in self.char_id else n + ord(c) for c in word]

    @staticmethod
    def spot(start: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return mix((np.asarray(start, np.uint64) << np.uint64(32)) ^ np.asarray(piece, np.uint64))

    @staticmethod
    def limit(rate: float) -> np.uint64:
        return np.uint64(min(int(rate * 2.0**64), 2**64 - 1))

    def dropped(self, key: np.ndarray, start: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
        return mix(key ^ self.spot(start, piece)) < self.limit(rate)

    def candidates(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every piece of two characters or more that stands in the word."""
        ids, n = self.long_id, len(word)
        found = [(i, p) for i in range(n) for j in range(i + 2, min(n, i + self.longest) + 1) if (p := ids.get(word[i:j])) is not None]
        starts, pieces = zip(*found, strict=True) if found else ((), ())
        return np.array(starts, np.int64), np.array(pieces, np.int64)

    def all_candidates(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece) of every piece in every word, word by word in the agenda's order, and each word's number of them."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        owner, first, stop = (np.repeat(x, n) for x in (np.arange(len(words)), np.cumsum(n) - n, np.cumsum(n)))
        at, node = np.arange(len(codes)), self.first[codes]
        where, what = [at[:0]], [at[:0]]
        for size, (keys, nodes, ids) in enumerate(self.levels, 2):
            more = (node >= 0) & (at + size <= stop[at])
            at = at[more]
            if not len(at):
                break
            want = node[more] << 21 | codes[at + size - 1]
            spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[spot] == want
            at, spot = at[hit], spot[hit]
            node, piece = nodes[spot], ids[spot]
            where.append(at[piece >= 0])
            what.append(piece[piece >= 0])
        at, piece = np.concatenate(where), np.concatenate(what)
        start = (at - first[at]) if len(at) else at
        order = np.lexsort((start, self.rank[piece], owner[at]))
        return start[order], piece[order], np.bincount(owner[at], minlength=len(words))

    def agenda(self, word: str, key: int, rate: float) -> list[int]:
        """Merge one word with a heap of candidates."""
        out = set()
        if rate:
            start, piece = self.candidates(word)
            lost = self.dropped(np.full(len(start), key, np.uint64), start, piece, rate)
            out = set(zip(start[lost].tolist(), piece[lost].tolist(), strict=True))
        sym = self.symbols(word)
        nxt, prev = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        heap = []

        def propose(i: int) -> None:
            j = nxt[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and (piece := self.pairs.get(sym[i] << 32 | sym[j])) is not None and (i, piece) not in out:
                heapq.heappush(heap, (int(self.rank[piece]), i, j, sym[i], sym[j], piece))

        for i in range(len(sym)):
            propose(i)
        while heap:
            _, i, j, a, b, piece = heapq.heappop(heap)
            if sym[i] != a or nxt[i] != j or sym[j] != b:
                continue
            sym[i], sym[j] = piece, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            propose(prev[i])
            propose(i)
        return [s for s in sym if s >= 0]

    def in_step(self, word: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of numbered words under masks of drops, one word after another, and each word's number of pieces."""
        one = np.uint64(1)
        sym, n = self.letters.take(word)
        first = np.cumsum(n) - n
        bounds = (one << (n + 1).astype(np.uint64)) - one
        live = np.flatnonzero(self.agendas.sizes[word])
        origin = self.agendas.starts[word[live]]
        stop = origin + self.agendas.sizes[word[live]]
        state = [live, origin, origin.copy(), stop, bounds[live], mask[live], first[live]]
        while len(state[0]):
            live, origin, at, stop, have, drops, place = state
            for _ in range(4):
                spot = np.minimum(at, stop - 1)  # past its end, a word's last candidate is looked at again, in vain
                entry = self.agendas.flat[spot]
                start = entry >> 6 & 63
                left, right = one << start.astype(np.uint64), one << (entry & 63).astype(np.uint64)
                between = (right - one) & ~((left << one) - one)
                inside = have & between
                ok = ((have & (left | right)) == (left | right)) & (inside != 0) & (inside & (inside - one) == 0)
                ok &= drops >> (spot - origin).astype(np.uint64) & one == 0
                have = np.where(ok, have & ~between, have)
                sym[place[ok] + start[ok]] = entry[ok] >> 13
                at = np.where(ok & (entry >> 12 & 1 == 1), origin, at + 1)
            done = at >= stop
            bounds[live[done]] = have[done]
            state = [x[~done] for x in (live, origin, at, stop, have, drops, place)]
        inner = np.arange(len(sym)) - np.repeat(first, n)
        kept = np.repeat(bounds, n) >> inner.astype(np.uint64) & one == 1
        return sym[kept], np.add.reduceat(kept, first, dtype=np.int64) if len(word) else n

    def in_bytes(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become byte pieces."""
        outside = pieces >= self.size
        if not outside.any():
            return pieces, counts
        codes, place = np.unique(pieces[outside], return_inverse=True)
        table = [[self.byte_id[b] for b in chr(c - self.size).encode()] for c in codes.tolist()]
        width = np.ones(len(pieces), np.int64)
        width[outside] = np.array([len(t) for t in table])[place]
        out = np.repeat(pieces, width)
        out[np.repeat(outside, width)] = np.concatenate([table[p] for p in place.tolist()])
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(ends)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()[1:]

    def forget(self) -> None:
        """Empty the tables of words."""
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.letters = Rows(np.int32)  # each word's symbols; none if it goes by the heap
        self.spots = Rows(np.uint64)  # each word's candidates, hashed, in the agenda's order
        self.agendas = Rows(np.int64)  # and packed: piece, whether it rewinds, start, end

    def numbered(self, words: list[str]) -> np.ndarray:
        """Numbers of words; new ones get their candidates."""
        before = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = list(islice(self.number, before, None))
        for at in range(0, len(new), 20_000):
            some = [w if len(w) <= LONG else "" for w in new[at : at + 20_000]]
            start, piece, n = self.all_candidates(some)
            fits = n < 64
            some = [w if ok else "" for w, ok in zip(some, fits.tolist(), strict=True)]
            own = np.repeat(fits, n)
            start, piece, n = start[own], piece[own], np.where(fits, n, 0)
            self.spots.extend(self.spot(start, piece), n)
            self.agendas.extend(piece << 13 | self.rewinds[piece].astype(np.int64) << 12 | start << 6 | start + self.lengths[piece], n)
            codes = np.frombuffer("".join(some).encode("utf-32-le"), "<u4")
            self.letters.extend(self.code_id[codes], np.fromiter(map(len, some), np.int64, len(some)))
        return out

    def masks(self, words: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
        """Which candidates each occurrence drops, a bit each."""
        out = np.zeros(len(words), np.uint64)
        if not rate:
            return out
        flat, n = self.spots.take(words)
        upto = np.cumsum(n)
        lost = np.flatnonzero(mix(np.repeat(keys, n) ^ flat) < self.limit(rate))
        owner = np.searchsorted(upto, lost, "right")
        bits = np.uint64(1) << (lost - (upto - n)[owner]).astype(np.uint64)
        if len(lost):
            new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[new]] = np.bitwise_or.reduceat(bits, new)
        return out

    def encode(self, texts: list[str | None], doc_keys: np.ndarray, rate: float, seed: int, remembered: int = 300_000) -> list[np.ndarray]:
        """The pieces of each text."""
        if len(self.number) > remembered:
            self.forget()
        found = [self.words.findall(f" {t}") if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        every = list(chain.from_iterable(found))
        if not every:
            return [np.zeros(0, np.int32)] * len(texts)
        word = self.numbered(every)
        first = np.cumsum(sizes) - sizes
        place = (np.arange(len(word)) - np.repeat(first, sizes)).astype(np.uint64)
        keys = mix(mix(np.repeat(doc_keys, sizes) ^ np.uint64(seed % 2**64)) + place)
        mask = self.masks(word, keys, rate)
        by_heap = self.letters.sizes[word] == 0
        if rate:
            mask[by_heap] = keys[by_heap]
        order = np.lexsort((mask, word))
        w, m = word[order], mask[order]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (m[1:] != m[:-1])])
        pair = np.empty(len(word), np.int64)
        pair[order] = np.cumsum(new) - 1
        one = order[new]  # an occurrence of each distinct pair
        merged, number = Rows(np.int32), np.empty(len(one), np.int64)
        heaped = by_heap[one]
        steps = np.flatnonzero(~heaped)
        for at in range(0, len(steps), 50_000):
            some = one[steps[at : at + 50_000]]
            number[steps[at : at + 50_000]] = merged.extend(*self.in_bytes(*self.in_step(word[some], mask[some])))
        for i in np.flatnonzero(heaped).tolist():
            got = np.array(self.agenda(every[one[i]], int(keys[one[i]]), rate), np.int32)
            number[i] = merged.extend(*self.in_bytes(got, np.array([len(got)])))[0]
        flat, n = merged.take(number[pair])
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([first, [len(word)]])]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Rows:
    """Rows of different lengths in one array that grows."""

    def __init__(self, dtype: type) -> None:
        self.flat, self.used, self.starts, self.sizes, self.n = np.zeros(1024, dtype), 0, np.zeros(256, np.int64), np.zeros(256, np.int64), 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> range:
        """Add rows that stand one after another in values; their numbers."""
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(values)] = values
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(values), self.n + len(sizes)
        return range(self.n - len(sizes), self.n)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after another, and their sizes."""
        n = self.sizes[rows]
        upto = np.cumsum(n)
        return self.flat[np.repeat(self.starts[rows] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)], n


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def doc_keys(ids: list[int | None]) -> np.ndarray:
    return mix(np.array([(i or 0) % 2**64 for i in ids], np.uint64) + np.uint64(1))


def batches_encoded(model: str, rate: float, seed: int, rows: int = 1000):
    """mapInArrow helper: slices of each batch (id column first, text column second) with their pieces."""

    def run(batches: Iterator[pa.RecordBatch]):
        pieces = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                yield pieces, part, texts, pieces.encode(texts, doc_keys(ids), rate, seed)

    return run


def encode_docs(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, pieces (array of ids) and n_pieces of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, _, got in batches_encoded(model, rate, seed)(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int32())), pa.array([len(g) for g in got], pa.int64())], names=["doc_id", "pieces", "n_pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long")


def decode_docs(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with pieces. Null pieces give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if p is None else pieces.decode(np.array(p, np.int64)) for p in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (little-endian 32-bit ids) and lossless (they decode to the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, part, texts, got in batches_encoded(model, rate, seed)(batches):
            sha = [hashlib.sha256(g.astype("<i4").tobytes()).hexdigest() for g in got]
            same = [pieces.decode(g) == (t or "") for g, t in zip(got, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_pieces", "pieces_sha256", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, lossless boolean")
