"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share the total budget of
words; a target stops at max_repeats times its source's size and the excess goes to the others by
weight. Each source's documents are shuffled by a keyed hash and queued, max_repeats rounds of them;
a document's virtual finish time is the source's words up to and including it, divided by the
source's target. All documents are range-sorted by finish time and cut off at the budget.

Running sums are two-level: hash ranges inside a source, and ranges of finish time overall (words
are spread evenly over finish time by construction), so neither a hot source nor the whole table
meets in one task.

Null texts have size zero and add no words. Null sources are one source. Null ids are shuffled like
any id. Rows that tie in every sort column are taken or left together. An empty table gives an
empty result; if no source has a word, all targets are zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, cut

#: The weights of the contract.
WEIGHTS = (5, 2, 1)
#: Hash ranges inside a source, at least; ranges of finish time per unit, and into which the range with the edge is cut again.
RANGES, SLICES = 4096, 4096
#: So many rows are sorted by one task at most, where finish times tell them apart.
SORTED = 1_000_000


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with no, their place in code point order from 0, null last: ranges sorted apart, then offset."""
    parts = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parts.withColumn("row", F.row_number().over(inside) - 1).join(before, "part").select("source", "source_size", (F.col("before") + F.col("row")).alias("no"))


def with_targets(sources: DataFrame, max_repeats: int) -> DataFrame:
    """sources with weight and target: budget shared by weight, held at max_repeats times the size."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("no") % len(WEIGHTS) + 1).cast("int"))
    s = cut(ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * max_repeats))
    level, held = 0.0, -1
    while True:
        over = F.col("most") < F.col("weight") * F.lit(level)
        total, n, used, free = s.agg(F.sum("source_size"), F.count_if(over), F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == held or not free:
            break
        held, level = n, (total - used) / free
    share = F.col("weight") * F.lit(level)
    return s.withColumn("target", F.when(F.col("most") < share, F.col("most").cast("double")).otherwise(share))


def mixed(docs: DataFrame, max_repeats: int = 3, seed: int = 1) -> DataFrame:
    """doc_id, text_hash, size, source_size, target and times (how often the mix takes the row), for every row of docs."""
    text = F.col("text").cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), text_size(text).alias("size"), key.alias("key")))
    sources = with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats)
    named = sources.select(F.col("source").alias("name"), "no", "source_size", "target")
    queued = rows.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    digits = 3 + max(0, math.ceil(math.log(max(1, rows.count()) / (RANGES * SORTED), 16)))
    queued = queued.withColumn("range", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))

    sums = queued.groupBy("no", "range").agg(F.sum("size").alias("words"))
    before = sums.select("no", "range", (F.sum("words").over(Window.partitionBy("no").orderBy("range")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("no", "range").orderBy("key", "doc_id", "size")
    queued = queued.join(before, ["no", "range"]).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    finish = lambda e: (e * F.col("source_size") + F.col("upto")) / F.col("target")
    queued = cut(queued.select("doc_id", "text_hash", "size", "source_size", "target", "no", "key", "upto"))

    # what finishes after 2 can't be reached: all before 1 is the budget but for a document per source
    turns = queued.where("size > 0 and target > 0").select("no", "key", "size", "source_size", "target", "upto", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("round"))
    turns = turns.select(finish(F.col("round")).alias("finish"), "no", "key", "size", "round").where("finish < 2").withColumn("slice", F.floor(F.col("finish") * SLICES))
    slices = turns.groupBy("slice").agg(F.sum("size").alias("words"))
    slices = slices.select("slice", "words", F.sum("words").over(Window.orderBy("slice")).alias("upto"))
    budget = F.lit(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    edge = slices.where(F.col("upto") > budget).agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("words")).alias("before")), "slice")).first()[0]
    last = None
    if edge is not None:
        order = F.struct("finish", "no", "key", "size", "round")
        rest, before = turns.where(F.col("slice") == edge.slice), edge.before
        low, wide = edge.slice / SLICES, 1 / SLICES
        while rest.count() > SORTED and wide > 1e-13:
            # cut the range with the edge again, until one task can sort it; what finishes earlier goes before it
            wide /= SLICES
            finer = rest.withColumn("part", F.floor((F.col("finish") - F.lit(low)) / F.lit(wide)))
            parts = finer.groupBy("part").agg(F.sum("size").alias("words"))
            parts = parts.select("part", "words", (F.lit(before) + F.sum("words").over(Window.orderBy("part"))).alias("upto"))
            at = parts.where(F.col("upto") > budget).agg(F.min_by(F.struct("part", (F.col("upto") - F.col("words")).alias("before")), "part")).first()[0]
            earlier = finer.where(F.col("part") < at.part).agg(F.max(order)).first()[0]
            last = earlier if earlier is not None else last
            rest, before, low = finer.where(F.col("part") == at.part).drop("part"), at.before, low + at.part * wide
        inside = rest.withColumn("upto", F.lit(before) + F.sum("size").over(Window.orderBy("finish", "no", "key", "size", "round")))
        reached = inside.where(F.col("upto") <= budget).agg(F.max(order)).first()[0]
        last = reached if reached is not None else last

    def taken(e: int) -> Column:
        at = finish(F.lit(e))
        if edge is None:
            return (at < 2).cast("int")
        whole = (F.floor(at * SLICES) < edge.slice).cast("int")
        if last is None:
            return whole
        own = F.struct(at.alias("finish"), F.col("no"), F.col("key"), F.col("size"), F.lit(e).alias("round"))
        bound = F.struct(F.lit(last.finish).alias("finish"), F.lit(last.no).cast("long").alias("no"), F.lit(last.key).alias("key"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["round"]).alias("round"))
        return F.when(F.floor(at * SLICES) == edge.slice, (own <= bound).cast("int")).otherwise(whole)

    times = sum((taken(e) for e in range(1, max_repeats)), taken(0))
    return queued.select("doc_id", "text_hash", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0).alias("times"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words of the row that the mix takes, repeats counted."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, max_repeats: int = 3) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    times = mixed(docs, max_repeats).groupBy("doc_id", "text_hash").agg(F.max("times").alias("__lf_times")).where("__lf_times > 0")
    times = times.withColumnsRenamed({"doc_id": "__lf_id", "text_hash": "__lf_hash"})
    hashed = docs.withColumn("__lf_text", F.xxhash64(F.col("text").cast("string")))
    joined = hashed.join(times, F.col("doc_id").eqNullSafe(F.col("__lf_id")) & (F.col("__lf_text") == F.col("__lf_hash")))
    return joined.withColumn("__lf_turn", F.explode(F.sequence(F.lit(1), F.col("__lf_times")))).select(*(F.col(f"`{c}`") for c in docs.columns))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS most, [5, 2, 1][no % 3 + 1] AS weight FROM s),
k AS (SELECT *, sum(most) OVER o AS used, sum(weight) OVER o AS heavy, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
        lead(most / weight) OVER (ORDER BY most / weight, no) AS next FROM w
      WINDOW o AS (ORDER BY most / weight, no ROWS UNBOUNDED PRECEDING)),
f AS (SELECT total::DOUBLE / weights AS level, 0 AS held, min(most / weight) AS next FROM k GROUP BY ALL
      UNION ALL SELECT (total - used)::DOUBLE / (weights - heavy), row_number() OVER (ORDER BY most / weight, no), next FROM k WHERE weights > heavy),
g AS (SELECT arg_min(level, held) AS level FROM f WHERE level <= next OR next IS NULL),
t AS (SELECT source, no, source_size, least(most::DOUBLE, weight * level) AS target FROM w, g),
q AS (SELECT d.*, no, source_size, target, sum(size) OVER (PARTITION BY no ORDER BY key, doc_id, size) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (round * source_size + upto)::DOUBLE / target AS finish FROM (SELECT *, unnest([0, 1, 2]) AS round FROM q WHERE size > 0)),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, no, key, size, round) AS spent FROM e WHERE finish < 2),
n AS (SELECT doc_id, key, no, size, count(*) // count(DISTINCT round) AS copies, count(DISTINCT round) AS times FROM c WHERE spent <= (SELECT sum(source_size) FROM s) GROUP BY ALL)
SELECT q.doc_id, q.size, source_size::BIGINT AS source_size, target, (q.size * coalesce(times, 0))::BIGINT AS taken
FROM q LEFT JOIN n ON q.key = n.key AND q.no = n.no AND q.size = n.size AND q.doc_id IS NOT DISTINCT FROM n.doc_id
"""
