"""Spelling variants against plain counts and a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfield.llm import spelling as sp

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    form, out = {}, {}
    for w, n in words.items():
        others = [(-words[v], v) for v in words if near(w, v)]
        best = min(others, default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
        out[w] = [n, len(others)]
    rows = set()
    for w, (n, k) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, k, words[form[w]] if form[w] else None))
    return rows


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA).repartition(4)


def made(seed, letters, n):
    """Texts of words that are short edits of one another, with counts from one to many."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(12)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                j = rng.randrange(len(w))
                w[j : j + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 2))
            words.append("".join(w))
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "ABcdÿ×z"])
def test_equals_comparing_all_words(spark, letters):
    docs = made(len(letters), letters, 60)
    assert got(sp.spelling_variants(frame(spark, docs))) == plain(docs)


def test_chains_ties_and_odd_rows(spark):
    chain = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("bbbbb", 96), ("zzzzz", 4), ("zzzzy", 9), ("zzzzx", 9)]
    text = "\n".join(" ".join([w] * n) for w, n in chain)
    long = "q" * 5000
    docs = [(None, text), (None, None), (3, ""), (4, f"{long} {long}q {long[:2500]}r{long[2501:]} 1 " * 4), (4, f"{long} {long}q " * 2), (5, "Été-été ÉTÉ été x1y " + "Straße straße STRAßE Strasse " * 3)]
    want = plain(docs)
    assert got(sp.spelling_variants(frame(spark, docs))) == want
    roots = {r[0]: r[2] for r in want}
    assert roots["aaaaa"] == "bbbbb" and roots["zzzzz"] == "zzzzx"
    assert sp.spelling_variants(frame(spark, [(1, None)])).count() == 0


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(sp.spelling_variants(docs)) == plain(rows)


def test_keys_are_hashes_of_what_is_left():
    """Equal rests have equal keys, and keys of other rests differ."""
    words = ["banana", "bananas", "bandana", "aaaaa", "aaaa", "ÿéabc"]
    key, own, place, kind = sp.deletion_keys(words)
    seen = {}
    for k, w, p, t in zip(key.tolist(), own.tolist(), place.tolist(), kind.tolist()):
        rest = words[w] if t == sp.SELF else words[w][:p] + words[w][p + 1 :]
        seen.setdefault((p, rest) if t == sp.PLACE else rest, set()).add(k)
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)
    assert (kind == sp.REST).sum() == 6 + 7 + 7 + 1 + 1 + 5


def test_colliding_keys_link_nothing():
    rows = [(1, 0, sp.PLACE, "abcde", 5), (2, 0, sp.PLACE, "xbcdf", 9), (3, 0, sp.PLACE, "zbcde", 7), (4, 0, sp.SELF, "other", 9), (5, 1, sp.REST, "hello", 9)]
    assert sorted(sp.group_views(rows)) == [(1, 1, -7, "zbcde", 3), (3, 1, -5, "abcde", 1)]


def test_sorted_keys_are_matched_over_batch_bounds():
    import pyarrow as pa

    keys = [1, 2, 2, 2, 5, 6, 6, 7]
    kinds = [0, 0, 0, 0, 0, 1, 2, 2]
    table = pa.table({"key": keys, "radix": pa.array([0] * 8, pa.int32()), "id": list(range(8)), "place": [0] * 8, "kind": pa.array(kinds, pa.int32())})
    for size in range(1, 9):
        out = pa.Table.from_batches(list(sp.shared_keys(iter(table.to_batches(max_chunksize=size)))))
        assert out.column("id").to_pylist() == [1, 2, 3, 5, 6], size
    assert np.array_equal(sp.mixed(np.arange(3, dtype=np.uint64)) == 0, [True, False, False])
