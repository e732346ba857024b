"""Quality rules with host verdicts.

Each text gets word, symbol, duplicate-line and repeated-window counts and a base verdict. Failures
are then summed by host, the hosts' failure rates are shrunk towards the corpus rate by a beta
prior fitted by beta-binomial moments (the spread of the hosts' rates beyond what chance alone
gives), and a host whose shrunk rate is above max_rate fails with all its documents.

Null or empty texts have no words and fail (fewer than min_words). A null host is a host of its own.
Repeated rows count each time. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, map_columns

#: The symbols of the contract.
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\r\x0b\f"
METRICS = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], window: int) -> int:
    """Number of words inside a window of that many words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = (key ^ h[i : i + n]) * MIX
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANK):
            seen.add(line)
    return n


def text_metrics(raw: bytes | None, window: int = 8) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    if not raw:
        return 0, 0, 0, 0, 0
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(by.sum() - by[0x80:0xC0].sum())
    words = raw.split()
    return len(words), chars - int(by[list(BLANK)].sum()), int(by[list(SYMBOLS)].sum()), dup_lines(raw), repeat_words(words, window)


def host_rates(metrics: DataFrame) -> DataFrame:
    """One row per host: n, failed, and rate, the posterior mean of its failure rate.

    The beta prior's weight comes from beta-binomial moments. With m the corpus rate, k hosts, N
    documents and s the sum of n (rate - m)^2 over the hosts, s / (m (1 - m)) is k - 1 for hosts
    that differ by chance alone, and r (N - sum n^2 / N - (k - 1)) more for hosts whose own rates
    correlate their documents by r. The weight is 1 / r - 1, held between 1 and a million.
    """
    return with_rates(metrics.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))


def with_rates(hosts: DataFrame) -> DataFrame:
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    k, total, failed, squares, sizes = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(f), F.sum(f * f / n), F.sum(n * n)).first()
    m = (failed or 0.0) / (total or 1.0)
    chance = k - 1
    room = (total or 0.0) - (sizes or 0.0) / (total or 1.0) - chance
    spread = ((squares or 0.0) - m * m * (total or 0.0)) / (m * (1 - m)) - chance if 0 < m < 1 else 0.0
    weight = min(max(room / spread - 1, 1.0), 1e6) if spread > 0 and room > 0 else 1e6
    return hosts.withColumn("rate", (F.col("failed") + F.lit(m * weight)) / (F.col("n") + F.lit(weight)))


def host_rules(docs: DataFrame, min_words: int = 20, max_repeat: int = 30, max_rate: float = 0.5) -> DataFrame:
    """doc_id, the five counts, base_failed, host_rate and kept, one row per row of docs."""

    def make(ids, sources, texts):
        return [ids, sources, *map(list, zip(*map(text_metrics, texts), strict=True))]

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"))
    m = map_columns(d, make, METRICS)
    m = cut(m.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))))
    hosts = host_rates(m).select(F.col("source").alias("host"), F.col("rate").alias("host_rate"))
    joined = m.join(hosts, m.source.eqNullSafe(hosts.host), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"))


HOST_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
q AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM c) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN u USING (r) LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
t AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) AS s, sum(n) AS total, count(*) - 1 AS chance, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM h),
e AS (SELECT *, CASE WHEN m > 0 AND m < 1 THEN (s - m * m * total) / (m * (1 - m)) - chance ELSE 0 END AS spread FROM t),
k AS (SELECT m, CASE WHEN spread > 0 AND room > 0 THEN least(greatest(room / spread - 1, 1), 1e6) ELSE 1e6 END AS weight FROM e),
v AS (SELECT source, (f + m * weight) / (n + weight) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
