"""Source mixing, and the pipeline's stages against plain versions of them."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfield.llm import cotrain, merge_dropout, mixing
from lumenfield.llm.queries import TOKENIZERS

from .test_near_duplicates import brute_lines, smallest_reachable


def five_word_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_mix_of_odd_sources(spark):
    rows = [(i, "big", "w " * (i % 7)) for i in range(3000)] + [(9000 + i, "a", "x y z") for i in range(20)] + [(None, "z", "null id")] * 2
    rows += [(9500 + i, None, "of no source") for i in range(30)] + [(9600, "empty", None), (9601, "empty", ""), (9602, "big", "long " * 5000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, size int, key string")
    got = mixing.mix_sizes(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, s, t in rows:
        size[s] += len((t or "").split())
    of = {i: s for i, s, _ in rows}
    taken, target = Counter(), {}
    for r in got:
        assert r.source_size == size[of[r.doc_id]] and 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    # a 5, big 2, empty 1, z 5, null 2; the small ones stop at three times their size
    assert target["a"] == 180 and target["empty"] == 0 and target["z"] == 12 and target[None] == 270
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 5000 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sizes(df.repartition(7)).collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect() if r.doc_id) == Counter({r.doc_id: r.taken // r.size for r in got if r.taken and r.doc_id})
    assert mixing.mix_sizes(df.limit(0)).count() == mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix_sizes(df.where("source = 'empty'")).count() == 2


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        got.write.parquet(str(tmp_path / name))
        if name != "pieces":
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
    good = {r.doc_id: r.text for r in out["quality"]}
    scored = cotrain.quality_scores(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))).collect()
    assert set(good) == {r.doc_id for r in scored if r.kept}

    lines = {r.doc_id: r.text for r in out["lines"]}
    gone = brute_lines(sorted(good.items()), 2, 20)
    for i, t in good.items():
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, []))
        assert lines[i] == left if i in lines else not left.split()
    assert all(r.n_chars == len(r.text) for r in out["lines"] if r.text is not None)

    ids = sorted(lines)
    sets = [five_word_shingles(lines[i]) for i in ids]
    roots = smallest_reachable(len(ids), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert sorted(r.doc_id for r in out["near_duplicates"]) == sorted({ids[r] for r in roots})

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/near_duplicates/*.parquet')")
    want = {i: t // n for i, n, t in con.execute(f"select doc_id, size, taken from ({mixing.MIX_SQL}) where taken > 0").fetchall()}
    assert Counter(r.doc_id for r in out["mix"]) == want

    pieces = merge_dropout.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    texts = {r.doc_id: r.text for r in out["mix"]}
    assert Counter(r.doc_id for r in out["pieces"]) == want
    assert all(b"".join(pieces.bytes[p] for p in r.pieces).decode()[1:] == texts[r.doc_id] and r.n_pieces == len(r.pieces) for r in out["pieces"])


def test_words_of_the_mix_are_counted_as_in_sql(spark):
    df = spark.createDataFrame([(1, "a b c d\x0be\x1cf")], "doc_id long, text string")
    assert df.select(mixing.text_size(df.text)).first()[0] == len(re.findall(r"[^\x20\x09-\x0D]+", "a b c d\x0be\x1cf"))


def test_run(spark, sf_dir):
    assert os.path.isdir(sf_dir) and corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "pieces", "n_pieces"]


def test_run_on_odd_tables(spark, sf_dir, tmp_path):
    """Nulls in every column, repeated rows, a very long text, columns with names that operators use, and no rows at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    good = " ".join(f"word{i}" for i in range(40))
    odd = [(None, None, None, None, None), (None, good + " a", None, None, 3), (None, good[::-1] + " b", "en", None, 3), (9001, "", "en", "s", 0), (9002, good, "en", "s", 5), (9002, good, "en", "s", 5), (9003, " long".join(map(str, range(40_000))), "en", "s", None)]
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    more = more.withColumns({"pos": F.lit(1), "x": F.lit("y"), "root": F.lit(2), "key": F.lit("k"), "__part": F.lit(0)})
    for name, df in (("some", more), ("none", more.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert got.columns == ["doc_id", "pieces", "n_pieces"]
        ids = [r.doc_id for r in got.collect()]
        assert not ids if name == "none" else len(ids) > 20
