import random

import pytest
from pyspark.sql import functions as F

from lumenfield.llm import host_rules


def brute_repeat(words, k=8):
    w = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    hit = {i + j for i, x in enumerate(w) if w.count(x) > 1 for j in range(k)}
    return len(hit)


def test_repeat_words_against_brute_force():
    rng = random.Random(5)
    for n in (0, 7, 8, 9, 30, 200):
        words = [rng.choice([b"a", b"b"]) for _ in range(n)]
        assert host_rules.repeat_words(words, 8) == brute_repeat(words)
    assert host_rules.repeat_words([b"x"] * 9, 8) == 9


def test_metrics_of_odd_texts():
    assert host_rules.text_metrics(None) == host_rules.text_metrics(b"") == (0, 0, 0, 0, 0)
    assert host_rules.text_metrics("é\x0b#a\n\n \n#a\né\n#a".encode()) == (5, 8, 3, 1, 0)


def test_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, "spam", bad) for i in range(90)] + [(100 + i, "spam", good) for i in range(10)] + [(200 + i, f"h{i % 5}", good) for i in range(200)]
    rows += [(999, None, good), (None, "h1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as kept", "2 as host")
    got = {r.doc_id: r for r in host_rules.host_rules(df).collect()}
    assert not any(got[i].kept for i in range(110) if i in got)
    assert all(got[200 + i].kept for i in range(200)) and got[999].kept and not got[None].kept
    assert got[0].host_rate == pytest.approx(0.9, abs=0.05)
    assert host_rules.host_rules(df.limit(0)).count() == 0


def test_prior_is_beta_binomial(spark):
    """Hosts that differ by chance alone are shrunk to the corpus rate; the rate at the limit is kept; repeated rows count."""
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(h * 100 + i, f"h{h}", bad if (i + h) % 5 == 0 else good) for h in range(40) for i in range(5)] * 2
    got = host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == 400 and all(r.host_rate == pytest.approx(0.2, abs=1e-4) for r in got)
    half = spark.createDataFrame([(i, "only", bad if i % 2 else good) for i in range(10)], "doc_id long, source string, text string")
    assert {(r.host_rate, r.kept) for r in host_rules.host_rules(half).collect()} == {(0.5, True), (0.5, False)}


def test_failures_of_a_very_large_host_do_not_overflow(spark):
    counts = spark.range(4).selectExpr("if(id < 2, 'a', 'b') as source", "id % 2 = 0 as base_failed").withColumn("n_words", F.lit(1))
    rates = host_rules.host_rates(counts).collect()
    assert {r.source: r.rate for r in rates} == {"a": 0.5, "b": 0.5}
    many = counts.groupBy("source").agg(F.lit(8_000_000_000).alias("n"), F.lit(4_000_000_000).alias("failed"))
    assert host_rules.with_rates(many).first().rate == pytest.approx(0.5)


def test_a_very_long_text():
    words = b" ".join(b"w%d" % (i % 50_000) for i in range(300_000))
    assert host_rules.text_metrics(words)[::4] == (300_000, 300_000)
