"""SimHash, embeddings and lines against brute force, and their odd inputs."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lumenfield.llm import hnsw, line_dedup, simhash


def smallest_reachable(n, linked):
    """For each of n items the smallest index reachable by linked(i, j)."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


# ---- SimHash -------------------------------------------------------------------------------------


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, width, distance):
    fps = [brute_fingerprint(t, width) for _, t in rows]
    roots = smallest_reachable(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= distance)
    least = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return fps, [least[r] for r in roots]


def texts(seed=2, n=90):
    rng = random.Random(seed)
    out = [None, "", " \n", "one", "One", "a b c", "a b c d", "É a b c d", "x" * 50_000]
    for _ in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
            out.append("\n".join(words))
    return out


def test_simhash_groups_equal_brute_force(spark, sf_dir):
    rows = list(enumerate(texts())) + [(7, "one"), (7, "one"), (None, "a b c")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, choice string")
    for width in (4, 5):
        fps, component = brute_groups(rows, width, 4)
        want = sorted(zip(((-1 if i is None else i) for i, _ in rows), fps, component, strict=True), key=str)
        got = sorted(((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(df, width).collect()), key=str)
        assert got == want


def test_pigeonhole_links_with_small_chunks(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(20):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    want = smallest_reachable(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for chunk in (8192, 5):
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(df, max_group=chunk).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        at = {x: i for i, x in enumerate(fps)}
        pairs = {(at[a], at[b]) for a, b in links}
        assert smallest_reachable(len(fps), lambda i, j: (i, j) in pairs or (j, i) in pairs) == want  # noqa: B023


def test_simhash_dedup_keeps_one_of_each_group(spark):
    rows = list(enumerate(texts(3, 40))) + [(3, "one"), (3, "one")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, component_id int")
    _, component = brute_groups(rows, 5, 4)
    got = simhash.simhash_dedup(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(component))
    assert simhash.simhash_dedup(df.limit(0)).count() == simhash.simhash_groups(df.limit(0)).count() == 0


# ---- embeddings ----------------------------------------------------------------------------------


def brute_vectors(rows, threshold):
    v = [None if x is None or any(c is None for c in x) else np.array(x, float) for _, x in rows]
    ok = [x is not None and x.size and np.isfinite(x).all() and (x != 0).any() for x in v]
    near = lambda i, j: bool(ok[i] and ok[j] and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= threshold)
    n = len(rows)
    links = np.array([[i != j and near(i, j) for j in range(n)] for i in range(n)])
    roots = smallest_reachable(n, lambda i, j: links[i, j])
    return links.sum(1), [min(rows[k][0] for k in range(n) if roots[k] == r) for r in roots]


def test_vectors_equal_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(200).collect()]
    d = rows[0][1]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [None, *d[1:]]), (9005, [float("nan"), *d[1:]]), (9006, [float("inf"), *d[1:]]), (9007, d), (9007, d), (9008, [1.0, 0.0]), (9009, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "label", 3) for r in rows], "vec_id long, embedding array<float>, label string, rid int")
    counts, component = brute_vectors(rows, 0.9)
    want = sorted((i, int(c), k, i == k) for (i, _), c, k in zip(rows, counts, component, strict=True))
    assert sorted(map(tuple, hnsw.near_vectors(df).collect())) == want
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_double_precision(spark):
    """A cosine of exactly the threshold links, one a hair below doesn't; very large and small components; null ids."""
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.6, 0.8]), (4, [0.6 - 1e-9, 0.8]), (5, [3e200, 4e200]), (6, [6e-200, 8e-200]), (None, [3.0, 4.0]), (None, [0.0, -1.0])]
    got = {str(r.vec_id) + str(r.component_id): r.n_links for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.6).collect()}
    # 1, 2 link with each other, 3, 5, 6 and the first null one; 3 to 6 and the null one with one another
    assert got == {"11": 5, "21": 5, "31": 6, "41": 4, "51": 6, "61": 6, "None1": 6, "NoneNone": 0}


def test_a_crowded_cluster(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=48)
    v = np.concatenate([centre + rng.normal(scale=0.33, size=(1500, 48)), rng.normal(size=(1500, 48))]).astype(np.float32)
    v[2000:2600] = v[2000 + np.arange(600) % 300] + rng.normal(scale=0.1, size=(600, 48))
    v[10:20] = v[10]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    truth, report = (u @ u.T >= 0.9).sum(1) - 1, {}
    got = {r.vec_id: r.n_links for r in hnsw.near_vectors(df, min_shards=2, slot_rows=400, beam=8, report=report).collect()}
    n = np.array([got[i] for i in range(len(v))])
    assert (n <= truth).all() and n[:1500].sum() >= 0.99 * truth[:1500].sum() and n[1500:].sum() >= 0.99 * truth[1500:].sum() > 100
    assert report["audited"] > 100 and report["recall"] >= 0.999


def test_graph_search_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(400, 24))
    v = (centres[rng.integers(0, 400, 4000)] + rng.normal(scale=0.35, size=(4000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    truth = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in hnsw.near_vectors(df, min_shards=2, beam=16, audit=64).collect()}
    n = np.array([got[i] for i in range(len(v))])
    assert (n <= truth).all() and n.sum() >= 0.99 * truth.sum() > 4000


# ---- lines ---------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, distance, least):
    """Positions that go, by row of rows (ids are distinct)."""
    first = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                first.setdefault(line, []).append((i, p))
    lines = sorted(x for x in first if len(x) >= least)
    con = duckdb.connect()
    con.register("l", pa.table({"i": range(len(lines)), "n": [len(x) for x in lines], "line": lines}))
    # DuckDB counts edits of bytes, of which a character has four at most
    rough = con.execute(f"select a.i, b.i from l a join l b on a.i < b.i and abs(a.n - b.n) <= {distance} and levenshtein(a.line, b.line) <= {4 * distance}").fetchall()
    near = {(b, a) for a, b in rough if edit_distance(lines[a], lines[b]) <= distance}
    roots = smallest_reachable(len(lines), lambda a, b: (a, b) in near)
    own = {}
    for line, r in zip(lines, roots, strict=True):
        own.setdefault(r, []).extend(first[line])
    out = {}
    for at in [*own.values(), *(first[x] for x in first if len(x) < least)]:
        for i, p in sorted(at)[1:]:
            out.setdefault(i, []).append(p)
    return {i: sorted(p) for i, p in out.items()}


def edited(rng, line, times):
    for _ in range(times):
        at, kind = rng.randrange(len(line)), rng.randrange(3)
        line = line[:at] + ("", "é", line[at] + "z")[kind] + line[at + 1 :]
    return line


def line_rows():
    rng = random.Random(6)
    base = ["".join(rng.choice("abc de") for _ in range(rng.choice([19, 20, 21, 22, 40, 63]))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = [edited(rng, rng.choice(base), rng.randrange(4)) if rng.random() < 0.7 else "".join(rng.choice("fgh") for _ in range(30)) for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(own)))
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, base[0] * 30), (104, base[0] * 30 + "x"), (105, "short\nshort")]


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame([(*r, 2, "y") for r in rows], "doc_id long, text string, line int, pos string").repartition(3)
    for distance in (1, 2):
        want = brute_lines(rows, distance, 20)
        digest = {r.doc_id: r for r in line_dedup.line_digest(df, distance, 20).collect()}
        assert {i: digest[i].dropped for i, _ in rows} == {i: ",".join(map(str, want.get(i, []))) for i, _ in rows}
        assert all(digest[i].n_lines == (0 if t is None else t.count("\n") + 1) for i, t in rows)
        kept = {r.doc_id: r.text for r in line_dedup.line_dedup(df, distance, 20).collect()}
        for i, t in rows:
            left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want.get(i, []))
            assert kept[i] == left if i in kept else (i in want and not left.split())


def test_bit_parallel_distance(spark):
    rng = random.Random(11)
    pairs = [("", ""), ("", "ab"), ("a", "a"), ("😀b", "b😀"), ("😀" * 5, "😀" * 6)]
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 30)))
        b = edited(rng, a + "xyzzy", rng.randrange(5))
        pairs.append(tuple(sorted((a, b), key=len)))
    for k in (1, 2, 4):
        own = [(a, b, edit_distance(a, b)) for a, b in pairs if len(b) - len(a) <= k]
        df = spark.createDataFrame(own, "a string, b string, d int")
        for r in df.select("a", "b", "d", line_dedup.edit_distance(F.col("a"), F.col("b"), k).alias("got")).collect():
            assert r.got == r.d if r.d <= k else r.got > k, r


def numbered(df):
    return df.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("n"), line_dedup.signature(F.col("line")).alias("sig"))


def test_crowded_segments_are_refined(spark):
    """Lines that share a segment: the same links with and without refinement (which brute force checks elsewhere)."""
    rng = random.Random(12)
    for shared, n in (("the same first third of it all ", 600), ("nearly the whole of a long line of many words that all of them have, number ", 500)):
        lines = set()
        while len(lines) < n:
            tail = "".join(rng.choice("abcdefgh") for _ in range(60 if n == 600 else 5))
            lines |= {shared + tail, edited(rng, shared + tail, 1)} if rng.random() < 0.3 else {shared + tail}
        df = numbered(spark.createDataFrame([(x,) for x in sorted(lines)], "line string").coalesce(1)).cache()
        got = [{tuple(sorted((r.a, r.b))) for r in line_dedup.near_lines(df, 2, **options).collect()} for options in ({"max_key": 10**9}, {"max_key": 32}, {"max_key": 32, "levels": 1, "slice_rows": 40})]
        assert got[0] and got[1] == got[2] == got[0]


def test_joined_rows_grow_in_proportion(spark):
    rng, joined = random.Random(13), []
    for n in (1000, 4000):
        lines = [("the same first third of these lines " + "".join(rng.choice("abcdefghijklmnop") for _ in range(72)),) for _ in range(n)]
        df = numbered(spark.createDataFrame(lines, "line string"))
        a = df.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("line").alias("text"), "n", F.lit(0).cast("long").alias("base"))
        b = a.toDF("b", "sb", "text", "n", "base").withColumn("less", F.lit(None).cast("int"))
        hot = line_dedup.indexed(a, 2).groupBy("key").count().where("count > 256")
        finer = [line_dedup.indexed(a, 2, True).join(hot, "key", "left_semi"), line_dedup.probing(b, 2, True).join(hot, "key", "left_semi")]
        finer = [f.withColumnRenamed("key", "base") for f in finer]
        joined.append(line_dedup.indexed(finer[0], 2).join(line_dedup.probing(finer[1], 2), "key").count())
        assert line_dedup.candidates(df, 2).count() <= 2 * n
    assert joined[1] <= 6 * joined[0]


def test_lines_of_odd_tables(spark):
    line = "the same line that is long enough"
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_lines, r.dropped) for r in line_dedup.line_digest(df).collect()))
    assert got == [(0, 1, ""), (1, 1, "0"), (1, 1, "0"), (2, 0, "")]
    assert line_dedup.line_dedup(df.limit(0)).count() == line_dedup.line_digest(df.limit(0)).count() == 0
    assert line_dedup.line_dedup(df.withColumn("hash", F.lit(1))).columns == ["doc_id", "text", "hash"]


def with_common_mean(n, pairs, dim=64, seed=11):
    """Unit vectors that share a mean, as text embeddings do, the last ones near copies of the first."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) / np.sqrt(dim) + 0.9 * np.ones(dim) / np.sqrt(dim)
    v[n - pairs :] = v[:pairs] + rng.normal(size=(pairs, dim)) * 0.25 / np.sqrt(dim)
    return v.astype(np.float32)


def test_common_mean_and_planted_pairs(spark):
    n, pairs = 3000, 300
    v = with_common_mean(n, pairs)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(1)
    report = {}
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in hnsw.near_vectors(df, min_shards=1, report=report).collect()}
    have = np.array([got[i] for i in range(n)])
    assert want.sum() >= 2 * pairs and (have <= want).all()
    recall = float((have[want > 0] / want[want > 0]).mean())
    assert recall >= 0.97 and abs(report["recall"] - recall) <= 0.02 and report["audited"] > 100 and report["lowest"] <= report["recall"]


def test_floods_and_searches_reach_every_node():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=32) + rng.normal(scale=0.2, size=(150, 32)), rng.normal(size=(300, 32))])
    u = hnsw.unit(hnsw.scaled(v))
    g, order = hnsw.Graph.build(u, rng.geometric(0.9, len(v)) - 1, 4, 12)
    for links in g.links:
        seen, front = {0}, [0]
        while front:
            front = [j for j in {int(j) for i in front for j in links[i]} - seen if j >= 0]
            seen |= set(front)
        assert len(seen) == len(links)
    lonely = int(np.flatnonzero(order == 7)[0])
    start = int(np.flatnonzero(order == 8)[0])
    g.links[0][g.links[0] == lonely] = -1  # only its own links join it to its group now
    near = np.flatnonzero(g.vecs @ g.vecs[start] >= 0.5)
    assert lonely in near and set(near) <= set(g.flood(np.array([start]), g.vecs[start], 0.4).tolist())


def test_audit_sees_queries_that_lost_everything():
    v = with_common_mean(400, 60)
    g, order = hnsw.Graph.build(hnsw.unit(hnsw.scaled(v)), np.zeros(400, int), 12, 48)
    ids = np.arange(400)[order]
    q = hnsw.scaled(v[order])
    whole, found = g.search, []

    def blind(queries, width):
        out, sims = whole(queries, width)
        sims[:, :] = np.where(sims > 0.9999, sims, -1)  # all but the query itself
        found.append(width)
        return out, sims

    tally = hnsw.Tally(ids, q, ids, q, np.ones(400, int), 0.9)
    assert hnsw.shard_links(g, hnsw.unit(q), 0.9, 32, 400, 0.999, tally)[0] >= 0.97 and tally.counts.sum() >= 116
    g.search = blind
    reached, audited = hnsw.shard_links(g, hnsw.unit(q), 0.9, 32, 200, 0.999, hnsw.Tally(ids, q, ids, q, np.ones(400, int), 0.9))
    assert reached == 0.0 and audited > 10 and found  # told, though no beam came near


def test_filters_before_the_distance_lose_no_line(spark):
    """Signatures, kept segments and common ends allow every pair within the distance, long lines and other scripts too."""
    rng = random.Random(14)
    pairs = [("", ""), ("a", "a"), ("a" * 20, "a" * 22), ("é" * 130, "é" * 131)]
    for _ in range(400):
        a = "".join(rng.choice("etaoin é😀") for _ in range(rng.choice([6, 9, 20, 21, 40, 130, 510, 511, 512, 513, 514])))
        pairs.append(tuple(sorted((a, edited(rng, a, rng.randrange(6)) if rng.random() < 0.9 else a[::-1]), key=len)))
    for k in (1, 2, 4):
        own = [(a, b, edit_distance(a, b)) for a, b in pairs if len(b) - len(a) <= k]
        df = spark.createDataFrame(own, "a string, b string, d int")
        a, b = F.col("a"), F.col("b")
        df = df.withColumns({"near": line_dedup.may_be_near(line_dedup.signature(a), line_dedup.signature(b), k), "kept": line_dedup.keeps_segments(a, b, k), "x": a, "y": b})
        got = line_dedup.without_common_ends(df, "a", "b").collect()
        assert sum(r.d <= k for r in got) > 50
        assert all(r.near and r.kept for r in got if r.d <= k)
        for r in got:
            assert edit_distance(r.a, r.b) == r.d and (len(r.x) < 40 or r.d > 1 or len(r.a) < 8)
    long = spark.createDataFrame([("a" * 9000, "a" * 9001), ("b" * 5000 + "c", "d" + "b" * 5000)], "a string, b string")
    assert [len(r.b) < 16 for r in line_dedup.without_common_ends(long, "a", "b").collect()] == [True, False]
