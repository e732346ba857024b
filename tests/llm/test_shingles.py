"""Near-duplicates by shingle similarity, against brute force and planted pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lumenfield.llm import shingles, simhash
from lumenfield.llm.util import components, perhaps_in

from .test_near_duplicates import brute_fingerprint, smallest_reachable, texts


def jaccard(a, b):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def planted(seed=5):
    """Pairs of texts with similarities from 0.7 to 1, by changing words at the end."""
    rng = random.Random(seed)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 300))]
        drop = int(len(words) * rng.uniform(0.0, 0.17))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: len(words) - drop] + [f"v{rng.randrange(10**6)}" for _ in range(drop)]))]
    return rows


def test_stage_drops_planted_pairs_of_similarity_from_80_percent(spark):
    rows = planted()
    near = {b[0] for a, b in zip(rows[::2], rows[1::2]) if jaccard(a[1], b[1]) >= 0.8}
    assert 0.8 <= min(jaccard(rows[i - 1][1], rows[i][1]) for i in near) < 0.83 and 30 < len(near) < 150
    df = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == {i for i, _ in rows} - near


def test_shingle_groups_equal_brute_force(spark):
    rows = list(enumerate(texts(3, 60))) + [(500 + i, t) for i, t in planted(9)[:80]] + [(3, "one"), (3, "other"), (None, "null a"), (None, "null b")]
    rows += [(1000 + i, " ".join(f"c{k}" for k in range(100) if k != i)) for i in range(60)]
    roots = smallest_reachable(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    first = {}
    for (i, t), r in zip(rows, roots, strict=True):
        first.setdefault(r, []).append((i is None, i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (2048, 7):
        got = sorted((r.doc_id is None, r.doc_id) for r in shingles.shingle_dedup(df, max_group=most).collect())
        assert got == sorted((min(x) for x in first.values()), key=lambda x: (x[0], x[1] or 0))
    assert shingles.shingle_dedup(df.limit(0)).count() == 0


def near_copies(n, seed=2):
    """Texts of 200 words, each with one word of its own: every two are near, and none are equal."""
    rng = random.Random(seed)
    stem = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        words = list(stem)
        words[rng.randrange(200)] = f"own{i}"
        out.append((i, " ".join(words)))
    return out


def test_rows_dealt_grow_in_proportion_to_a_hot_group(spark, monkeypatch):
    """Members once in their chunk, and as visitors only those that the chunks of 32 bands left apart."""
    dealt = []
    plain = shingles.visits_of

    def counted(crowded, roots, max_group):
        out = plain(crowded, roots, max_group)
        dealt[-1] += crowded.count() + out.count()
        return out

    monkeypatch.setattr(shingles, "visits_of", counted)
    for n in (400, 800):
        dealt.append(0)
        df = spark.createDataFrame(near_copies(n), "doc_id long, text string")
        assert [r.doc_id for r in shingles.shingle_dedup(df, max_group=20).collect()] == [0]
    assert 0 < dealt[0] and dealt[1] <= 2.5 * dealt[0]


def test_apart_members_of_a_crowded_group_are_compared(spark):
    """Two families that share a band but not the similarity stay apart, and a late link between chunks is found."""
    sets = {i: shingles.shingle_set(t.encode(), 5) for i, t in near_copies(30)}
    residents = [(i, 1 if i < 20 else i, s) for i, s in sets.items() if i < 29]
    got = shingles.cross_links(residents, (29, 29, sets[29]), 0.8, {})
    assert len(got) == 10 and {b for _, b in got if b >= 20} == set(range(20, 29))  # one of the component, each of the others
    assert shingles.cross_links(residents, (99, 99, sets[29][:50]), 0.8, {}) == [] and shingles.cross_links([], (1, 1, sets[29]), 0.8, {}) == []


def test_fingerprints_find_close_texts_and_bands_the_rest(spark, monkeypatch):
    """The stage goes through SimHash's pigeonhole blocks; they alone connect similar texts within 4 bits, and nothing below the similarity is linked."""
    rows = planted(21) + [(1000 + i, t) for i, t in near_copies(40)]
    rows += [(2000, "a b c d"), (2001, "a b c d a b c d a b c d"), (2002, ""), (2003, None)]
    called, plain = [], simhash.near_links

    def spied(fps, distance=4, blocks=6, **options):
        called.append((distance, {r.fp for r in fps.collect()}))
        return plain(fps, distance, blocks, **options)

    monkeypatch.setattr(simhash, "near_links", spied)
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    fps = [brute_fingerprint(t, 5) for _, t in rows]
    assert called == [(4, {x - (x >> 63 << 64) for x in fps})]
    roots = smallest_reachable(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    assert kept == {rows[r][0] for r in roots}

    nodes = {r.doc_id: r.node for r in shingles.sketches(df).collect()}
    sketched = shingles.sketches(df).cache()
    reps = sketched.groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    close = shingles.close_groups(sketched, reps, 4, 6)
    key = {r.node: r.key for r in close.collect()}
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4 and nodes[rows[i][0]] != nodes[rows[j][0]]]
    assert len(near) > 100 and all(key[nodes[rows[i][0]]] == key[nodes[rows[j][0]]] for i, j in near)
    for most in (2048, 7):  # whole, and in chunks
        links = shingles.near_sets(df, sketched, 5, 0.8, most).collect()
        text = {nodes[i]: t for i, t in rows}
        assert links and all(jaccard(text[r.a], text[r.b]) >= 0.8 for r in links)


def shuffled(spark, run):
    """Bytes and files of shuffles that run() writes: map tasks of stages that write any."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        got = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s := got.apply(i)).stageId(): (s.shuffleWriteBytes(), s.numCompleteTasks()) for i in range(got.size())}

    before = set(stages())
    out = run()
    new = [x for k, x in stages().items() if k not in before and x[0]]
    return out, sum(x[0] for x in new), sum(x[1] for x in new)


def test_texts_without_a_like_are_not_shuffled(spark):
    """Few rows have a like, so what is shuffled is their texts and a short key for each band, not all texts."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))) for i in range(300)]
    rows += [(900, rows[0][1] + " more"), (901, rows[1][1]), (2, rows[2][1]), (None, rows[3][1]), (None, "null id"), (None, None), (902, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, written, _ = shuffled(spark, lambda: shingles.shingle_dedup(df).collect())
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, i) for i in range(300)] + [(False, 902), (True, None)]
    assert written < 0.2 * sum(len(t or "") for _, t in rows)


def test_perhaps_in_loses_no_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("__lf"))
    keys = spark.createDataFrame([(7 * i,) for i in range(1, 40)] + [(-5,), (7,)], "k long")
    for words, most in ((1 << 19, 45), (4, 600), (1, 3000)):
        got = perhaps_in(rows, keys, "k", words).collect()
        assert len(got) == 3000 and len([r for r in got if r.k is None]) == 1
        assert {7 * i for i in range(1, 40)} <= {r.k for r in got if r["__lf_in"]}
        assert sum(r["__lf_in"] for r in got) <= most
    assert not perhaps_in(rows, keys.limit(0), "k").where("__lf_in").count()


def test_components_of_few_links_write_few_files(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50], "a long, b long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, _, tasks = shuffled(spark, lambda: components(links, "a", "b").collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r.node: r.root for r in got} == {i: max(1, i - (i - 1) % 50) for i in range(1, 201)}
    assert tasks < 400
