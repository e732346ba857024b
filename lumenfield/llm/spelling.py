"""Spelling variants by deletion keys made with rolling hashes.

Words one code point apart agree once a code point is taken out: of both at the same place where one
is replaced, of the longer word only where one is inserted. So a word has a key for every place (the
hash of the rest, mixed with the place), one for every different rest (the hash alone; in a run of
equal letters all deletions leave the same rest, and only the run's first counts), and one for
itself. Two near words then share exactly one key of one kind. The hash of what is left without a
place is the polynomial hash of the prefix before it plus that of the suffix after it, moved down a
power, so all keys of a batch of words come out of one running sum over their code points, in 64-bit
integers.

Keys go to partitions by their leading bits and are sorted there; runs of equal keys that can hold
near words are candidates. Only then do the words' strings join, and the rests are compared as
strings, so colliding hashes link nothing. A group isn't spread into pairs: each member needs the
group's size and its most frequent word, or the second for that word itself.

A word's form is its most frequent near word, if that is twice as frequent. Forms at least double
the count, so chains are short, and pointers jump over them.

Null texts have no words, and a null id is written as nothing before the ":" of the deletion rule.
Repeated rows count each. Words and texts may be of any length: rows of keys carry a number and not
the word. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, save

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: Odd, so it has an inverse among 64-bit integers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Leading bits of a key that choose its partition.
RADIX = 12
#: Words counted in a task before the counts go on, and code points of words keyed at once.
HELD, BLOCK = 1 << 18, 1 << 20
#: Kinds of keys.
PLACE, REST, SELF = 0, 1, 2


def runs_of(text: str) -> Counter:
    """How often each run of letters, A-Z lower-cased, stands in a text."""
    text = text.encode().lower().decode()  # of bytes, only A-Z are lower-cased
    return Counter(RUNS.findall(text) if len(text) < BLOCK else map(itemgetter(0), RUNS.finditer(text)))


def misspelt(run: str, start: int, every: int) -> str:
    """The run, without one code point where its checksum, begun at start, is divided by every."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the words of all texts with at least `shortest` code points and `least` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (text := text.as_py()):
                    continue
                start = zlib.crc32(f"{key or ''}:".encode())
                for r, n in runs_of(text).items():
                    if len(r) >= shortest and len(word := misspelt(r, start, every)) >= shortest:
                        total[word] += n
                if len(total) >= HELD:
                    yield flushed()
        yield flushed()

    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit integers with all bits mixed, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, word's index, place and kind of all keys of the words."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum(length)])
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(points)) - first[word]
    powers = np.full(int(length.max(initial=0)) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    terms = mixed(points.astype(np.uint64) + np.uint64(1)) * powers[place]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    low, high = upto[first[:-1]], upto[first[1:]]
    prefix = upto[:-1] - low[word]
    suffix = (high[word] - upto[1:]) * np.uint64(INVERSE)
    rest = prefix + suffix
    new = np.ones(len(points), bool)  # the first of a run of equal letters
    new[1:] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
    key = [mixed(mixed(rest) + place.astype(np.uint64) + np.uint64(1)), mixed(rest[new]), mixed(high - low)]
    at = [word, word[new], np.arange(len(words))]
    where = [place, place[new], np.zeros(len(words), np.int64)]
    kind = [np.full(len(k), i, np.int8) for i, k in enumerate(key)]
    return np.concatenate(key).view(np.int64), np.concatenate(at), np.concatenate(where), np.concatenate(kind)


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (id, word) -> keys (key, radix, id, place, kind)."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= BLOCK):
                size += len(words[end])
                end += 1
            key, own, place, kind = deletion_keys(words[at:end])
            radix = (key.view(np.uint64) >> np.uint64(64 - RADIX)).astype(np.int32)
            for a in range(0, len(key), BLOCK):
                b = slice(a, a + BLOCK)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key[b], radix[b], ids[at:end][own[b]], place[b], kind[b].astype(np.int32)))], names=["key", "radix", "id", "place", "kind"])
            at = end


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: sorted keys -> those that several rows share and that can hold near words."""

    def chosen(table: pa.RecordBatch) -> pa.RecordBatch:
        key, kind = table.column("key").to_numpy(), table.column("kind").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        counts = [np.bincount(group[kind == k], minlength=len(start)) for k in (PLACE, REST, SELF)]
        keep = np.where(kind == PLACE, (counts[PLACE] > 1)[group], ((counts[REST] > 0) & (counts[SELF] > 0))[group])
        return table.filter(pa.array(keep)).select(["key", "id", "place", "kind"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column("key").to_numpy()
        last = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1  # the last key's rows may go on
        held = batch.slice(last)
        yield chosen(batch.slice(0, last))
    if held is not None:
        yield chosen(held)


def group_views(rows: list[tuple]) -> list[tuple]:
    """(id, near words, the best one's count, word and id) for each member of one key's rows (id, place, kind, word, n)."""
    out, groups = [], {}
    for own, place, kind, word, n in rows:
        rest = word if kind == SELF else word[:place] + word[place + 1 :]
        groups.setdefault((place, rest) if kind == PLACE else rest, ([], []))[kind == SELF].append((-n, word, own))
    for key, (cut_words, whole) in groups.items():
        if isinstance(key, tuple):
            if len(cut_words) > 1:
                top = sorted(cut_words)[:2]
                out += [(m[2], len(cut_words) - 1, *(top[1] if m == top[0] else top[0])) for m in cut_words]
        elif cut_words and whole:
            out.append((whole[0][2], len(cut_words), *min(cut_words)))
            out += [(m[2], 1, *whole[0]) for m in cut_words]
    return out


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: candidates sorted by key (key, id, place, kind, word, n) -> what each group tells its members."""
    names = ["id", "near", "less", "word", "other"]

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "word" else pa.int64()) for n, c in zip(names, columns)], names=names)

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    out = []
    for _, group in groupby(rows, itemgetter(0)):
        out += group_views([r[1:] for r in group])
        if len(out) >= 10_000:
            yield made(out)
            out = []
    yield made(out)


def near_words(words: DataFrame) -> DataFrame:
    """Of words (id, word, n; ids and words distinct) those that have near ones: id, near (their number), best (less: minus its count, word, other: its id)."""
    parts = words.sparkSession.conf.get("spark.sql.shuffle.partitions")
    keys = words.select("id", "word").mapInArrow(keyed, "key long, radix int, id long, place long, kind int")
    shared = keys.repartition(int(parts), "radix").sortWithinPartitions("key").mapInArrow(shared_keys, "key long, id long, place long, kind int")
    named = shared.join(words, "id").select("key", "id", "place", "kind", "word", "n")
    seen = named.repartition(int(parts), "key").sortWithinPartitions("key").mapInArrow(verified, "id long, near long, less long, word string, other long")
    return seen.groupBy("id").agg(F.sum("near").alias("near"), F.min(F.struct("less", "word", "other")).alias("best"))


def followed(links: DataFrame, ways: int = 16) -> DataFrame:
    """(id, up): the end of each chain of links (id, up: struct of id and word), by pointers that jump twice as far each round."""
    links = cut(links)
    while True:
        # many words may point to one: their rows are dealt over tasks, and that one's row is repeated
        left = links.withColumn("way", F.pmod(F.xxhash64("id"), F.lit(ways)).cast("int"))
        right = links.select(F.col("id").alias("at"), F.col("up").alias("on"), F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("way_on"))
        step = left.join(right, (F.col("up.id") == F.col("at")) & (F.col("way") == F.col("way_on")), "left")
        step = cut(step.select("id", F.coalesce("on", "up").alias("up"), F.col("on").isNotNull().alias("jumped")))
        jumped = step.where("jumped").limit(1).count()
        links = step.select("id", "up")
        if not jumped:
            return links


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n)."""
    words = save(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    own = words.join(near_words(words).withColumnRenamed("best", "b"), "id", "left")
    follows = -F.col("b.less") >= ratio * F.col("n")
    own = save(own.select("id", "word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.struct(F.col("b.other").alias("id"), F.col("b.word").alias("word"))).alias("up"), F.when(follows, -F.col("b.less")).alias("form_n")))
    ends = followed(own.where("up is not null").select("id", "up")).withColumnRenamed("up", "end")
    return own.join(ends, "id", "left").select("word", F.col("up.word").alias("form"), F.coalesce("end.word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of all texts with their near words, forms and roots."""
    return variant_groups(word_counts(docs))
