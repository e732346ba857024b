"""Queries over messages, requests, caches, queues and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import bands, records, text
from ..operators.prefix import running
from ..operators import caching
from ..sources import catalog, lines_stream, synthetic
from ..streaming import messages as ms
from ..streaming import letters, ordered, requests, telemetry, transitions
from ..streaming.telemetry import micros
from . import viewing
from .registry import query
from .standin import MSG, TEL, messages, table
from .standin import telemetry as tel

ACTIVE, BANDS = 1, (26, 16, 8)
KIND = """CASE WHEN protocol_version <> 1 THEN 'error' WHEN source_id > 0 AND source_id <> 1 THEN 'stale-source' WHEN type = 'stats_complete' THEN 'stats-complete'
WHEN type = 'tile_complete' THEN CASE WHEN bands IS NULL THEN 'tile-complete-malformed' WHEN bands <> [26, 16, 8] THEN 'tile-complete-stale-bands' WHEN tx IS NULL THEN 'tile-complete-malformed' ELSE 'tile-complete' END
WHEN type = 'spectrum_complete' THEN 'spectrum-complete' WHEN type = 'tile_error' THEN 'tile-error' ELSE 'error' END"""


# ---- messages ------------------------------------------------------------------------------------


@query("m04_message_kinds", f"WITH {MSG} SELECT seq, {KIND} AS kind FROM msg")
def m04(spark, d):
    return ms.classified(messages(spark, d), ACTIVE, BANDS).select("seq", "kind")


@query("m01_supported_versions", f"WITH {MSG} SELECT type, count(*) AS n FROM msg WHERE protocol_version = 1 GROUP BY type")
def m01(spark, d):
    return ms.supported(messages(spark, d))[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def sorted_letters(spark, d) -> tuple[str, StructType]:
    """The messages played in three batches into tables of the session's shared folder; the folder and their schema."""
    folder = ordered.play(messages(spark, d), 3)
    live = ordered.opened(spark, folder, 1).where("not closed").drop("closed")
    q = letters.routed(live, f"{folder}-out", f"{folder}-checkpoint")
    if not q.awaitTermination(600):
        q.stop()
        raise TimeoutError("the stream didn't end")
    return f"{folder}-out", live.schema


@query("m01_dead_letters", f"WITH {MSG} SELECT seq, type, protocol_version FROM msg WHERE protocol_version <> 1")
def m01_dead(spark, d):
    return letters.letters(spark, *sorted_letters(spark, d), dead=True).select("seq", "type", "protocol_version")


@query("m19_stream_progress", f"WITH {MSG}, w AS (SELECT *, least(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 3 / (greatest(1, max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()) + 1)), 2) AS batch FROM msg), b AS (SELECT batch, count(*) AS processed, count(*) FILTER (protocol_version <> 1) AS dead FROM w GROUP BY batch) SELECT batch::BIGINT AS batch, processed, dead, (sum(processed) OVER o)::BIGINT AS total, (sum(dead) OVER o)::BIGINT AS total_dead FROM b WINDOW o AS (ORDER BY batch)")
def m19_progress(spark, d):
    return letters.progress(spark, sorted_letters(spark, d)[0]).where("processed > 0")


@query("m07_late_messages", f"WITH {MSG}, c AS (SELECT *, {KIND} AS kind FROM msg) SELECT source_id, kind, count(*) AS n FROM c WHERE kind LIKE '%stale%' GROUP BY ALL")
def m07(spark, d):
    late = ms.classified(messages(spark, d), ACTIVE, BANDS).where(F.col("kind").isin("stale-source", "tile-complete-stale-bands"))
    return late.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("j09_p12_active_source", f"WITH {MSG} SELECT count(*) AS n, sum(seq)::BIGINT AS total FROM msg WHERE NOT (source_id > 0 AND source_id <> 1)")
def j09(spark, d):
    return messages(spark, d).where(~ms.stale_source(F.lit(ACTIVE))).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))


@query("m14_tile_reactions", f"""WITH {MSG} SELECT seq, NOT stored AS remove_tile, stored AND tr AND rest = 0 AS finalise, CASE WHEN stored AND (NOT tr OR rest = 0) THEN value END AS metric, stored AND NOT tr AS draw
FROM (SELECT seq, value, seq % 4 <> 0 AS stored, seq % 3 = 0 AS tr, seq % 2 AS rest FROM msg WHERE type = 'tile_complete')""")
def m14(spark, d):
    m = messages(spark, d).where("type = 'tile_complete'")
    n = F.col("seq")
    return m.select("seq", ms.tile_reaction(n % 4 != 0, n % 3 == 0, n % 2, F.col("value")).alias("r")).select("seq", "r.*")


@query("m14_tile_errors", f"""WITH {MSG} SELECT seq, coalesce(tile, 'unknown') AS tile, 'Worker failed to load tile (' || coalesce(tile, 'unknown') || ') : ' || CASE WHEN seq % 2 = 0 THEN 'Unknown error' ELSE 'boom' END AS log, seq % 3 = 0 AND seq % 5 = 0 AS finalise
FROM (SELECT *, tx || ',' || ty AS tile FROM msg WHERE type = 'tile_error')""")
def m14_errors(spark, d):
    m = messages(spark, d).where("type = 'tile_error'")
    n, tile = F.col("seq"), F.concat(F.col("tx").cast("string"), F.lit(","), F.col("ty").cast("string"))
    return m.select("seq", ms.tile_error_reaction(tile, F.when(n % 2 == 0, "").otherwise("boom"), n % 3 == 0, n % 5).alias("r")).select("seq", "r.*")


@query("m14_stats_reactions", f"WITH {MSG} SELECT seq, is_initial AS set_view, is_initial AS load_end, is_initial AS background, NOT is_initial AND seq % 2 = 0 AND seq % 3 = 0 AND seq % 5 <> 0 AS transition, NOT is_initial AND seq % 2 = 0 AND seq % 3 = 0 AND seq % 5 <> 0 AS stop_waiting FROM msg WHERE type = 'stats_complete'")
def m14_stats(spark, d):
    n = F.col("seq")
    m = messages(spark, d).where("type = 'stats_complete'")
    return m.select("seq", ms.stats_reaction(F.col("is_initial"), n % 2 != 0, n % 3 == 0, n % 5 != 0).alias("r")).select("seq", "r.*")


@query("m15_stats_to_cache", f"WITH {MSG}, s AS (SELECT seq, (seq % 64 + 1)::INT AS band, CASE WHEN seq % 3 <> 0 THEN value END AS min FROM msg) SELECT seq, band, min FROM s WHERE min IS NOT NULL AND band IN (8, 16, 26)")
def m15(spark, d):
    s = messages(spark, d).select("seq", (F.col("seq") % 64 + 1).cast("int").alias("band"), F.when(F.col("seq") % 3 != 0, F.col("value")).alias("min"))
    return ms.stats_to_cache(s, spark.createDataFrame([(8,), (16,), (26,), (8,)], "band int")).select("seq", "band", "min")


@query("m02_m03_f34_requests", f"""WITH {MSG} SELECT seq, 'tile:' || source_id || ':visible:' || tx || ',' || ty || ':26,16,8' AS tile_id, 'stats:' || source_id || CASE WHEN is_initial THEN ':initial:' ELSE ':background:' END || '26,16,8' AS stats_id,
'{{"protocolVersion":1,"type":"load_tile","sourceId":' || source_id || ',"requestId":"' || request_id || '","payload":{{"tx":' || tx || ',"ty":' || ty || '}}}}' AS envelope FROM msg WHERE tx IS NOT NULL""")
def m03(spark, d):
    b = F.array(*map(F.lit, BANDS))
    m = messages(spark, d).where("tx is not null")
    tile = text.tile_request_id(F.col("source_id"), F.lit("visible"), F.col("tx"), F.col("ty"), b)
    stat = text.stats_request_id(F.col("source_id"), b, F.col("is_initial"))
    return m.select("seq", tile.alias("tile_id"), stat.alias("stats_id"), ms.request("load_tile", F.col("source_id"), F.col("request_id"), F.struct("tx", "ty")).alias("envelope"))


@query("m03_request_builders", f"""WITH {MSG}, q AS (SELECT *, '"dataSource":{{"kind":"envi-http","headerUrl":"h' || source_id || '"}}' AS src, '{{"protocolVersion":1,"type":"' AS head, '","sourceId":' || source_id || ',"requestId":"' AS mid FROM msg WHERE tx IS NOT NULL AND bands IS NOT NULL)
SELECT seq, head || CASE seq % 4
 WHEN 0 THEN 'load_tile' || mid || 'tile:' || source_id || ':transition:' || tx || ',' || ty || ':' || array_to_string(bands, ',') || '","payload":{{' || src || ',"tile":{{"x":' || tx || ',"y":' || ty || '}},"bands":[' || array_to_string(bands, ',') || ']}}'
 WHEN 1 THEN 'calculate_stats' || mid || 'stats:' || source_id || CASE WHEN is_initial THEN ':initial:' ELSE ':background:' END || array_to_string(bands, ',') || '","payload":{{' || src || ',"bands":[' || array_to_string(bands, ',') || '],"isInitial":' || is_initial || '}}'
 WHEN 2 THEN 'get_spectrum' || mid || request_id || '","payload":{{' || src || ',"x":' || tx || ',"y":' || ty || '}}'
 ELSE 'cancel' || mid || request_id || '","payload":{{"reason":"superseded"}}' END || '}}' AS envelope FROM q""")
def m03_builders(spark, d):
    c, n = F.col, F.col("seq")
    load = F.struct(F.lit("envi-http").alias("kind"), F.concat(F.lit("h"), c("source_id").cast("string")).alias("headerUrl"))
    made = (
        F.when(n % 4 == 0, ms.tile_request(c("source_id"), F.lit("transition"), c("tx"), c("ty"), c("bands"), load)).when(n % 4 == 1, ms.stats_request(c("source_id"), c("bands"), c("is_initial"), load))
        .when(n % 4 == 2, ms.spectrum_request(c("source_id"), c("request_id"), c("tx"), c("ty"), load)).otherwise(ms.cancel_request(c("source_id"), c("request_id"), F.lit("superseded")))
    )
    return messages(spark, d).where("tx is not null and bands is not null").select("seq", made.alias("envelope"))


@query("f43_parsed_envelopes", f"WITH {MSG} SELECT seq, CASE WHEN seq % 10 <> 0 THEN 1 END::INT AS protocol_version, CASE WHEN seq % 10 <> 0 THEN type ELSE 'error' END AS type, CASE WHEN seq % 10 <> 0 THEN source_id ELSE 0 END AS source_id, CASE WHEN seq % 10 <> 0 THEN tx END AS tx FROM msg")
def f43(spark, d):
    e = F.to_json(F.struct(F.lit(1).alias("protocolVersion"), F.col("type"), F.col("source_id").alias("sourceId"), F.struct(F.struct(F.col("tx").alias("x"), F.col("ty").alias("y")).alias("tile")).alias("payload")))
    raw = messages(spark, d).select("seq", F.when(F.col("seq") % 10 != 0, e).otherwise("not json").alias("value"))
    return ms.parsed(raw).select("seq", "protocol_version", "type", "source_id", "tx")


# ---- requests ------------------------------------------------------------------------------------

ACTIONS = """a AS (SELECT user_id % 5 AS source_id, 'r' || (event_id % 50) AS request_id, event_id AS seq, ts, CASE WHEN event_type = 'purchase' AND value < 0.1 THEN 'invalidate' WHEN event_type IN ('view', 'click', 'purchase') THEN 'track' ELSE 'release' END AS action FROM events)"""


def actions(spark, d):
    a = F.when((F.col("event_type") == "purchase") & (F.col("value") < 0.1), "invalidate").when(F.col("event_type").isin("view", "click", "purchase"), "track").otherwise("release")
    return table(spark, d, "events").select((F.col("user_id") % 5).alias("source_id"), F.concat(F.lit("r"), (F.col("event_id") % 50).cast("string")).alias("request_id"), F.col("event_id").alias("seq"), "ts", a.alias("action"))


@query("m05_pending_requests", f"""WITH {ACTIONS}, l AS (SELECT source_id, request_id, arg_max(action, seq) AS last, max(seq) AS seq FROM a WHERE action <> 'invalidate' AND source_id > 0 GROUP BY ALL),
c AS (SELECT source_id, max(seq) AS cleared FROM a WHERE action = 'invalidate' GROUP BY source_id) SELECT source_id, request_id FROM l LEFT JOIN c USING (source_id) WHERE last = 'track' AND coalesce(cleared, -1) < seq""")
def m05(spark, d):
    return requests.pending(actions(spark, d))


@query("j08_answered_requests", f"""WITH {ACTIONS}, q AS (SELECT source_id, request_id, min(ts) AS ts FROM a WHERE action = 'track' GROUP BY ALL), r AS (SELECT source_id, request_id, min(ts) AS answered_at FROM a WHERE action = 'release' GROUP BY ALL)
SELECT source_id, request_id, epoch_us(answered_at) - epoch_us(ts) AS waited FROM q JOIN r USING (source_id, request_id) WHERE answered_at >= ts""")
def j08(spark, d):
    a = actions(spark, d)
    asked = a.where("action = 'track'").groupBy("source_id", "request_id").agg(F.min("ts").alias("ts"))
    got = requests.answered(asked, a.where("action = 'release'"))
    return got.select("source_id", "request_id", (micros("answered_at") - micros("ts")).alias("waited"))


@query("m06_not_cancelled", f"WITH {ACTIONS}, c AS (SELECT source_id, request_id, min(seq) AS cancelled FROM a WHERE action = 'release' GROUP BY ALL) SELECT source_id, request_id, seq FROM a LEFT JOIN c USING (source_id, request_id) WHERE action = 'track' AND (cancelled IS NULL OR cancelled > seq)")
def m06(spark, d):
    a = actions(spark, d)
    return requests.not_cancelled(a.where("action = 'track'"), a.where("action = 'release'")).select("source_id", "request_id", "seq")


def cancel_actions(spark, d):
    """Work and cancellations made of events: views and clicks of small value are work, signups cancel."""
    a = F.when(F.col("event_type") == "signup", "cancel").otherwise("work")
    return table(spark, d, "events").select((F.col("user_id") % 5).alias("source_id"), F.concat(F.lit("r"), (F.col("event_id") % 50).cast("string")).alias("request_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), a.alias("action"))


CANCEL_SQL = """c AS (SELECT user_id % 5 AS source_id, 'r' || (event_id % 50) AS request_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'cancel' ELSE 'work' END AS action FROM events WHERE user_id % 5 > 0),
l AS (SELECT *, lag(action) OVER w AS last, lag(ts) OVER w AS since FROM c WINDOW w AS (PARTITION BY source_id, request_id ORDER BY ts, seq))
SELECT source_id, request_id, seq, coalesce(last = 'cancel' AND epoch_us(ts) - epoch_us(since) <= 864000000000, false) AS cancelled FROM l WHERE action = 'work'"""


@query("m06_consumed_cancels", f"WITH {CANCEL_SQL}")
def m06_consumed(spark, d):
    return requests.consumed(cancel_actions(spark, d), 864_000)


@query("m06_cancel_stream", f"WITH {CANCEL_SQL}")
def m06_stream(spark, d):
    return ordered.played(cancel_actions(spark, d), lambda s: requests.cancelled_stream(s, 864_000), 2)


RESPONSE_SQL = f"""WITH {ACTIONS} SELECT q.source_id, q.request_id, q.seq, epoch_us(min(r.ts)) AS answered_us FROM a q LEFT JOIN a r ON r.action = 'release' AND r.source_id = q.source_id AND r.request_id = q.request_id AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 3 DAYS
WHERE q.action = 'track' GROUP BY q.source_id, q.request_id, q.seq"""


@query("j08_first_responses", RESPONSE_SQL)
def j08_first(spark, d):
    a = actions(spark, d)
    got = requests.first_responses(a.where("action = 'track'"), a.where("action = 'release'"), 259_200)
    return got.select("source_id", "request_id", "seq", F.unix_micros("answered_at").alias("answered_us"))


@query("j08_response_stream", RESPONSE_SQL)
def j08_stream(spark, d):
    rows = ordered.played(actions(spark, d), lambda s: requests.first_responses_stream(s, 259_200), 2)
    # a seq that came with several times is one request
    got = rows.groupBy("source_id", "request_id", "seq").agg(F.min("answered_at").alias("answered_at"))
    return got.select("source_id", "request_id", "seq", F.unix_micros("answered_at").alias("answered_us"))


@query("m08_source_switches", "SELECT user_id AS viewer, event_id AS seq, row_number() OVER w AS source_id, nullif(row_number() OVER w - 1, 0) AS cancels FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def m08(spark, d):
    loads = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("seq"))
    return requests.superseded(loads)


@query("m09_retries", f"WITH {ACTIONS} SELECT source_id, request_id, seq, row_number() OVER w AS attempt, row_number() OVER w < 2 AS retry FROM a WHERE action = 'release' WINDOW w AS (PARTITION BY source_id, request_id ORDER BY seq)")
def m09(spark, d):
    return requests.retries(actions(spark, d).where("action = 'release'").select("source_id", "request_id", "seq"))


@query("m16_a16_transition_tiles", f"WITH {MSG}, t AS (SELECT source_id, seq, greatest(40 - row_number() OVER (PARTITION BY source_id ORDER BY seq), 0) AS rest FROM msg WHERE type IN ('tile_complete', 'tile_error')) SELECT source_id, seq, rest, rest = 0 AS finalise FROM t")
def m16(spark, d):
    m = running(messages(spark, d).where("type in ('tile_complete', 'tile_error')"), "source_id", "seq", sums={"done": F.lit(1)})
    m = m.withColumn("rest", F.greatest(F.lit(40) - F.col("done"), F.lit(0)))
    return m.select("source_id", "seq", "rest", (F.col("rest") == 0).alias("finalise"))


def transition_actions(spark, d):
    """Band switches and done tiles made of events, by user."""
    k = F.get_json_object("props", "$.k").cast("int")
    begins = F.col("event_type").isin("signup", "purchase")
    return table(spark, d, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(begins, "begin").otherwise("tile").alias("action"),
        F.when(begins, k % 5).cast("int").alias("visible"), F.when(begins, 1 + k % 3).cast("int").alias("idle"),
    )


@query("m16_transition_stream", """WITH RECURSIVE a AS (SELECT user_id AS source_id, event_id AS seq, event_type IN ('signup', 'purchase') AS b, (props->>'k')::INT % 5 AS v, 1 + (props->>'k')::INT % 3 AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m AS (SELECT source_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS action, false AS started, 0 AS requeued, NULL::INT AS rest, 0 AS remaining, false AS finalise FROM (SELECT DISTINCT source_id FROM a)
UNION ALL SELECT a.source_id, a.n, a.seq, CASE WHEN b THEN 'begin' ELSE 'tile' END, b AND rest IS NULL AND v > 0, CASE WHEN b AND rest IS NULL AND v > 0 THEN greatest(0, v - i) ELSE 0 END,
CASE WHEN b THEN CASE WHEN rest IS NULL AND v > 0 THEN least(v, i) ELSE rest END WHEN rest > 1 THEN rest - 1 END, CASE WHEN b THEN CASE WHEN rest IS NULL AND v > 0 THEN least(v, i) ELSE coalesce(rest, 0) END ELSE greatest(coalesce(rest, 0) - 1, 0) END, NOT b AND rest IS NOT NULL AND rest <= 1
FROM m JOIN a ON a.source_id = m.source_id AND a.n = m.n + 1)
SELECT source_id, seq, action, started, requeued, remaining, finalise FROM m WHERE n > 0""")
def m16_stream(spark, d):
    return ordered.played(transition_actions(spark, d), transitions.transition_stream, 2)


# ---- caches and queues ---------------------------------------------------------------------------

TOUCH = "t AS (SELECT user_id % 6 AS source_id, 't' || (props->>'k') AS tile, event_id AS seq, (value * 100000)::BIGINT AS bytes FROM events)"


def touches(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select((F.col("user_id") % 6).alias("source_id"), F.concat(F.lit("t"), k).alias("tile"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100000).cast("long").alias("bytes"))


@query("w02_w03_lru_eviction", f"""WITH {TOUCH}, l AS (SELECT source_id, tile, max(seq) AS seq, arg_max(bytes, seq) AS bytes FROM t GROUP BY ALL),
w AS (SELECT *, sum(bytes) OVER o AS upto, row_number() OVER o AS n FROM l WINDOW o AS (PARTITION BY source_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING)) SELECT source_id, tile, seq, bytes FROM w WHERE upto <= 134217728 AND n <= 60""")
def w02(spark, d):
    return caching.kept(caching.last_touched(touches(spark, d)), tiles=60).select("source_id", "tile", "seq", "bytes")


@query("m22_cache_policies", """WITH c AS (SELECT user_id % 6 AS source_id, event_id AS seq, ['metadata', 'stats', 'raw-tiles', 'render-tiles'][event_id % 4 + 1] AS policy, event_id % 3 AS viewport, (value * 100000)::BIGINT AS bytes, CASE event_id % 700 WHEN 3 THEN 'source-switch' WHEN 4 THEN 'device-loss' WHEN 5 THEN 'viewport-eviction' WHEN 6 THEN 'budget-eviction' WHEN 7 THEN 'unload' END AS kind FROM events),
l AS (SELECT policy, unnest(clears) AS kind FROM (VALUES ('metadata', ['unload', 'source-switch', 'destroy']), ('stats', ['unload', 'source-switch', 'destroy']), ('raw-tiles', ['unload', 'source-switch', 'viewport-eviction', 'budget-eviction']), ('render-tiles', ['unload', 'source-switch', 'budget-eviction', 'device-loss', 'destroy'])) v(policy, clears)),
s AS (SELECT c.policy, c.source_id, c.viewport, c.seq, c.bytes, l2.cleared FROM c LEFT JOIN (SELECT l.policy, c.source_id, max(c.seq) AS cleared FROM c JOIN l ON c.kind = l.kind GROUP BY ALL) l2 ON l2.policy = c.policy AND l2.source_id = c.source_id WHERE c.kind IS NULL AND coalesce(l2.cleared, -1) < c.seq),
w AS (SELECT *, sum(bytes) OVER (PARTITION BY policy, source_id, CASE WHEN policy = 'raw-tiles' THEN viewport END ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY policy, source_id, CASE WHEN policy = 'raw-tiles' THEN viewport END ORDER BY seq DESC) AS n FROM s)
SELECT policy, source_id, seq FROM w WHERE policy = 'stats' OR policy = 'metadata' AND n <= 1 OR policy = 'raw-tiles' AND upto <= 67108864 OR policy = 'render-tiles' AND upto <= 134217728 AND n <= 512""")
def m22(spark, d):
    n = F.col("event_id")
    kind = F.try_element_at(F.create_map(*(F.lit(x) for p in {3: "source-switch", 4: "device-loss", 5: "viewport-eviction", 6: "budget-eviction", 7: "unload"}.items() for x in p)), (n % 700).cast("int"))
    policy = F.element_at(F.array(*map(F.lit, caching.POLICIES)), (n % 4 + 1).cast("int"))
    c = table(spark, d, "events").select((F.col("user_id") % 6).alias("source_id"), n.alias("seq"), policy.alias("policy"), (n % 3).alias("viewport"), F.round(F.col("value") * 100000).cast("long").alias("bytes"), kind.alias("kind"))
    live = caching.standing(c.where("kind is null").drop("kind"), c.where("kind is not null").select("source_id", "kind", "seq"))
    return caching.held(live).select("policy", "source_id", "seq")


@query("a07_u04_cache_usage", f"WITH {TOUCH} SELECT source_id, count(*) AS tiles, sum(bytes)::BIGINT AS bytes FROM (SELECT * FROM t WHERE seq % 2 = 0 UNION ALL SELECT * FROM t WHERE seq % 2 = 1) GROUP BY source_id")
def a07(spark, d):
    t = touches(spark, d)
    return caching.usage(t.where("seq % 2 = 0").unionByName(t.where("seq % 2 = 1")))


@query("u06_swapped_slots", f"WITH {TOUCH} SELECT source_id, count(*) AS n, 'active' AS slot FROM t WHERE seq % 3 <> 0 GROUP BY source_id")
def u06(spark, d):
    t = touches(spark, d).withColumn("slot", F.when(F.col("seq") % 3 == 0, "active").otherwise("transition"))
    return caching.swapped(t, "transition", "active").groupBy("source_id", "slot").agg(F.count(F.lit(1)).alias("n"))


@query("u03_j07_missing", f"WITH {TOUCH} SELECT DISTINCT source_id, tile FROM t EXCEPT SELECT source_id, tile FROM t WHERE bytes > 7000000")
def u03(spark, d):
    t = touches(spark, d)
    return caching.missing(t.select("source_id", "tile"), t.where("bytes > 7000000"), ["source_id", "tile"])


@query("t04_tile_queue", f"WITH {TOUCH} SELECT source_id, tile, min(seq) AS place, arg_max(bytes, seq) AS payload FROM t GROUP BY ALL")
def t04(spark, d):
    return viewing.queued(touches(spark, d).withColumnRenamed("bytes", "payload"), ["source_id", "tile"])


@query("t05_prepended_bands", "SELECT band, max(seq) AS put, row_number() OVER (ORDER BY max(seq) DESC)::INT AS place FROM (SELECT (props->>'k')::INT % 64 + 1 AS band, event_id AS seq FROM events) GROUP BY band")
def t05(spark, d):
    r = table(spark, d, "events").select((F.get_json_object("props", "$.k").cast("int") % 64 + 1).alias("band"), F.col("event_id").alias("seq"))
    return viewing.prepended(r).withColumn("place", F.row_number().over(Window.orderBy(F.desc("put"))))  # a row a band


@query("t08_served_queues", """WITH r AS (SELECT user_id AS source_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'recovery' WHEN 'view' THEN 'tile' WHEN 'click' THEN 'stats' ELSE 'preload' END AS queue FROM events)
SELECT source_id, seq, queue, CASE queue WHEN 'recovery' THEN 1 WHEN 'tile' THEN 2 WHEN 'stats' THEN 3 ELSE 4 END AS rank FROM r WHERE queue <> 'preload' OR source_id NOT IN (SELECT source_id FROM r WHERE queue = 'tile')""")
def t08(spark, d):
    q = F.when(F.col("event_type") == "error", "recovery").when(F.col("event_type") == "view", "tile").when(F.col("event_type") == "click", "stats").otherwise("preload")
    return viewing.served(table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), q.alias("queue")))


@query("t07_newest_log", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 80")
def t07(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(80).select("event_id", "event_type", "value")


@query("t09_random_bands", "SELECT DISTINCT (props->>'k')::INT % 64 + 1 AS band FROM events ORDER BY md5('7:' || band) LIMIT 3")
def t09(spark, d):
    b = table(spark, d, "events").select((F.get_json_object("props", "$.k").cast("int") % 64 + 1).alias("band")).distinct()
    return b.orderBy(F.md5(F.concat(F.lit("7:"), F.col("band").cast("string")))).limit(3)


@query("a15_duplicate_ids", "SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def a15(spark, d):
    return catalog.duplicate_ids(table(spark, d, "events").select(F.col("user_id").alias("id")))


@query("u02_u05_sets", f"WITH {TOUCH} SELECT source_id, count(DISTINCT tile) AS tiles, NOT bool_or(tile IN ('t1', 't2')) OR list_has_all(list(DISTINCT tile), ['t1', 't2']) AS whole FROM t GROUP BY source_id")
def u05(spark, d):
    want = F.array(F.lit("t1"), F.lit("t2"))
    g = touches(spark, d).select("source_id", "tile").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("tiles"), F.collect_set(F.when(F.col("tile").isin("t1", "t2"), F.col("tile"))).alias("s"))
    return g.select("source_id", "tiles", ((F.size("s") == 0) | (F.size(F.array_except(want, "s")) == 0)).alias("whole"))


# ---- telemetry -----------------------------------------------------------------------------------

BASE = """n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, seq) AS n, cpu < 20 AND NOT busy AS idle FROM tel),
look AS (SELECT n.source_id, n.n, n.ts AS t, n.seq AS own, n.idle, max({{'ts': c.ts, 'seq': c.seq, 'cpu': c.cpu, 'memory': c.memory, 'gpu': c.gpu, 'idle': c.idle}}) AS now FROM n JOIN n c ON c.source_id = n.source_id AND c.n <= 41 AND c.ts >= n.ts AND epoch_us(c.ts) <= epoch_us(n.ts) + {again}000 WHERE n.n <= 41 GROUP BY ALL),
cand AS (SELECT source_id, epoch_us(t) + {again}000 AS moment, 0 AS late, now.seq AS seq, now.cpu AS cpu, now.memory AS memory, now.gpu AS g FROM look WHERE idle AND n < 41 AND now.idle UNION ALL SELECT source_id, epoch_us(ts), 1, seq, cpu, memory, gpu FROM n WHERE n = 41),
b AS (SELECT source_id, seq, cpu, memory, {{'g': g}} AS g FROM cand QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY moment, late, seq) = 1)"""
BASELINE_SQL = "WITH " + TEL + ", " + BASE + " SELECT source_id, seq, cpu, memory, g.g AS gpu FROM b"


@query("a14_baseline", BASELINE_SQL.format(again=500))
def a14(spark, d):
    return telemetry.baseline(tel(spark, d))


@query("a14_slow_baseline", BASELINE_SQL.format(again=7_200_000))
def a14_slow(spark, d):
    """As a14, with a second look after two hours: the table's samples are minutes apart."""
    return telemetry.baseline(tel(spark, d), 7_200_000)


@query("a14_baseline_stream", BASELINE_SQL.format(again=7_200_000))
def a14_stream(spark, d):
    return ordered.played(tel(spark, d), lambda s: telemetry.baseline_stream(s, 7_200_000), 2)


@query("a13_w04_peaks", f"""WITH {TEL}, {BASE.format(again=500)}, s AS (SELECT tel.*, b.g.g AS gpu0 FROM tel JOIN b USING (source_id) WHERE tel.seq >= b.seq)
SELECT source_id, seq, max(cpu) OVER w AS peak_cpu, max(memory) OVER w AS peak_memory, CASE WHEN gpu0 IS NOT NULL THEN max(gpu) OVER w END AS peak_gpu FROM s WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def a13(spark, d):
    t = tel(spark, d)
    return telemetry.peaks(t, telemetry.baseline(t))


@query("s37_growing_lines", f"WITH {TEL} SELECT source_id, seq, epoch_us(ts) AS t, cpu, memory, gpu, busy FROM tel")
def s37(spark, d):
    """Samples as JSON lines in files, streamed from them by ranges."""
    s = tel(spark, d).select("source_id", "seq", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), F.col("cpu").alias("cpu_usage"), F.col("memory").alias("memory_usage"), F.col("gpu").alias("gpu_usage"), "busy")
    folder = synthetic.shared_folder(spark)
    s.select(F.to_json(F.struct(*s.columns)).alias("value")).write.text(f"{folder}/in")
    spark.dataSource.register(lines_stream.LineSource)
    live = spark.readStream.format("growing_lines").option("path", f"{folder}/in").option("range_bytes", 1 << 18).load()
    got = ordered.drained(spark, lines_stream.samples_of(live), f"{folder}/out")
    return got.select("source_id", "seq", F.unix_micros("ts").alias("t"), "cpu", "memory", "gpu", "busy")


@query("w05_history", f"WITH {TEL} SELECT source_id, seq, cpu FROM tel QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) <= 50")
def w05(spark, d):
    return telemetry.history(tel(spark, d)).select("source_id", "seq", "cpu")


@query("p19_time_range", f"WITH {TEL} SELECT source_id, count(*) AS n FROM tel WHERE ts >= (SELECT max(ts) FROM tel) - INTERVAL 86400 SECONDS GROUP BY source_id")
def p19(spark, d):
    return telemetry.within(tel(spark, d), 86400).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("p22_chart_nulls", f"WITH {TEL} SELECT source_id, count(*) AS n, max(gpu) AS most FROM tel WHERE gpu IS NOT NULL GROUP BY source_id")
def p22(spark, d):
    return tel(spark, d).where(F.col("gpu").isNotNull()).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("gpu").alias("most"))


@query("a09_initial_view", f"""WITH {TEL}, d AS (SELECT source_id, 't' || (seq % 4) AS tile, ts FROM tel), s AS (SELECT source_id, min(ts) AS started FROM tel GROUP BY source_id), f AS (SELECT source_id, tile, min(ts) AS ts FROM d GROUP BY ALL),
w AS (SELECT source_id, 't' || i AS tile FROM s, range(0, 4) r(i)) SELECT source_id, (epoch_us(max(f.ts)) - epoch_us(any_value(started))) / 1000 AS value FROM w LEFT JOIN f USING (source_id, tile) JOIN s USING (source_id) GROUP BY source_id HAVING count(*) = count(f.ts)""")
def a09(spark, d):
    t = tel(spark, d)
    started = t.groupBy("source_id").agg(F.min("ts").alias("started"))
    first = started.select("source_id", F.explode(F.array(*(F.lit(f"t{i}") for i in range(4)))).alias("tile"))
    return telemetry.initial_view(first, t.select("source_id", F.concat(F.lit("t"), (F.col("seq") % 4).cast("string")).alias("tile"), "ts"), started)


@query("a10_f44_switch_time", f"WITH {TEL}, w AS (SELECT source_id, seq, ts, lag(ts) OVER (PARTITION BY source_id ORDER BY seq) AS before FROM tel) SELECT source_id, seq, (epoch_us(ts) - epoch_us(before)) / 1000 AS ms FROM w WHERE before IS NOT NULL")
def a10(spark, d):
    return telemetry.switch_times(tel(spark, d))


@query("a12_first_metric", f"WITH {TEL} SELECT source_id, event_type AS name, arg_min(cpu, seq) AS value FROM tel GROUP BY ALL")
def a12(spark, d):
    return telemetry.first_metric(tel(spark, d).select("source_id", F.col("event_type").alias("name"), F.col("cpu").alias("value"), "seq"))


@query("w08_band_changes", "WITH s AS (SELECT user_id % 10 AS source_id, event_id AS seq, (props->>'k')::INT // 40 AS bands FROM events) SELECT source_id, seq, bands FROM s QUALIFY bands IS DISTINCT FROM lag(bands) OVER (PARTITION BY source_id ORDER BY seq)")
def w08(spark, d):
    s = table(spark, d, "events").select((F.col("user_id") % 10).alias("source_id"), F.col("event_id").alias("seq"), F.floor(F.get_json_object("props", "$.k").cast("int") / 40).alias("bands"))
    return telemetry.band_changes(s)


@query("ext_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windows(spark, d):
    return telemetry.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))


# ---- log lines, labels, catalogs -----------------------------------------------------------------

LINES = ("Worker failed to load", "Warning: slow", "timeToInitialView metric", "tile 3,4 ready", "Band statistics done", "header parsed", "WebGL context", "hello", "HTTP range request", "Renderer recovery failed: Failed to acquire WebGPU adapter")
LEVELS = ("ERROR/Runtime", "WARN/Runtime", "PERF/Renderer", "INFO/Tiles", "INFO/Stats", "INFO/Loader", "INFO/Renderer", "INFO/UI", "INFO/UI", "ERROR/Runtime")


def log_lines(spark, d):
    line = F.element_at(F.array(*map(F.lit, LINES)), (F.col("event_id") % len(LINES) + 1).cast("int"))
    m = table(spark, d, "events").select("event_id", line.alias("line"))
    return m.withColumn("entry", text.log_entry(F.col("line")))


@query("f31_log_entries", f"SELECT event_id, {list(LEVELS)}[event_id % 10 + 1] AS label FROM events")
def f31(spark, d):
    return log_lines(spark, d).select("event_id", F.concat_ws("/", "entry.level", "entry.source").alias("label"))


@query("p18_a08_log_counters", """WITH e AS (SELECT event_id % 10 AS k FROM events) SELECT count(*) AS total, count(*) FILTER (k = 8) AS network, count(*) FILTER (k = 3) AS tiles, count(*) FILTER (k IN (2, 4)) AS stats, count(*) FILTER (k <> 9) AS actionable FROM e""")
def p18(spark, d):
    e, m = F.col("entry"), F.col("line")
    passes = lambda name: F.count_if(text.in_console(e, m, name)).alias(name)
    return log_lines(spark, d).agg(F.count(F.lit(1)).alias("total"), passes("network"), passes("tiles"), passes("stats"), F.count_if(text.actionable(m)).alias("actionable"))


@query("f32_f33_status_lines", "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'webgl/initialized/true' WHEN 1 THEN 'webgpu/recovered/false' END AS status, CASE n_nationkey % 3 WHEN 2 THEN '完成' WHEN 0 THEN 'Renderer initialization completed (webgl, fallback mode).' ELSE 'Renderer recovered after device loss (webgpu).' END AS line FROM nation")
def f33(spark, d):
    n = F.col("n_nationkey")
    m = F.when(n % 3 == 0, "Renderer initialization completed (webgl, fallback mode).").when(n % 3 == 1, "Renderer recovered after device loss (webgpu).").otherwise("完成 / done")
    s = text.renderer_status(m)
    shown = F.when(s.isNotNull(), F.concat_ws("/", s["kind"], s["stage"], s["fallback"].cast("string")))
    return table(spark, d, "nation").select(n.alias("id"), shown.alias("status"), text.first_language(m).alias("line"))


@query("f23_formats", """SELECT event_id, printf('%.4f', value) AS number, printf('%.1f ms', value + CASE WHEN value % 1 IN (0.25, 0.75) THEN 1e-6 ELSE 0 END) AS ms, greatest(0, least(1, value / 100)) AS unit,
CASE WHEN b < 1024 THEN CASE WHEN b >= 100 THEN printf('%.0f B', b) ELSE printf('%.1f B', b) END WHEN b < 1048576 THEN CASE WHEN b / 1024 >= 100 THEN printf('%.0f KB', b / 1024) ELSE printf('%.1f KB', b / 1024) END ELSE CASE WHEN b / 1048576 >= 100 THEN printf('%.0f MB', b / 1048576) ELSE printf('%.1f MB', b / 1048576) END END AS size
FROM (SELECT event_id, value, (event_id * 997 % 99991 * 37 + 1)::DOUBLE + 0.3 AS b FROM events)""")
def f23(spark, d):
    b = (F.col("event_id") * 997 % 99991 * 37 + 1).cast("double") + 0.3
    v = F.col("value")
    return table(spark, d, "events").select("event_id", text.format_number(v).alias("number"), text.format_ms(v).alias("ms"), text.clamp_unit(v / 100).alias("unit"), text.format_bytes(b).alias("size"))


@query("s08_s09_s07_http_labels", """SELECT page_id, coalesce(nullif(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/'), lambda p: p <> '')[-1], ''), 'remote-source') AS name,
CASE WHEN page_id % 3 <> 0 THEN page_id + 10 END AS total, page_id % 2 = 0 AS has_headers FROM pages""")
def s08(spark, d):
    n = F.col("page_id")
    r = F.when(n % 3 == 0, F.concat(F.lit("bytes 0-9/*"))).otherwise(F.concat(F.lit("Bytes 0-9/"), (n + 10).cast("string")))
    h = F.create_map(F.lit("a"), F.when(n % 2 == 0, "1"), F.lit("b"), F.lit(None).cast("string"))
    return table(spark, d, "pages").select("page_id", text.name_of_url(F.col("url")).alias("name"), text.content_range_total(r).alias("total"), text.request_headers(h).isNotNull().alias("has_headers"))


@query("f35_axis_labels", "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'Wavelength (nm)' WHEN 1 THEN 'Wavelength (um)' WHEN 2 THEN 'Band' ELSE 'Wavelength (nm)' END AS axis FROM nation")
def f35(spark, d):
    n = F.col("n_nationkey")
    w = F.when(n % 4 == 1, F.array(F.lit(0.4), F.lit(0.5))).when(n % 4 == 2, F.array(F.lit(400.0))).otherwise(F.array(F.lit(400.0), F.lit(500.0)))
    u = F.when(n % 4 == 0, "Nanometers")
    return table(spark, d, "nation").select(n.alias("id"), text.spectral_axis(w, u, F.lit(2)).alias("axis"))


def samples(spark, d):
    """A catalog made of nations."""
    n = F.col("n_nationkey")
    s = F.struct(
        F.concat(F.lit("s"), n.cast("string")).alias("id"), F.col("n_name").alias("title"), F.when(n % 9 == 8, "tiff").otherwise("envi-http").alias("kind"), F.lit(None).cast("string").alias("availability"),
        F.when(n % 2 == 0, "public").alias("validationTier"), F.lit(" ").alias("description"), F.element_at(F.array(*map(F.lit, ("/a/b.hdr", "c.hdr", "//o.example/x.hdr", "../././up.hdr", "?v=2", "ftp://z.example/e.hdr"))), (n % 6 + 1).cast("int")).alias("headerUrl"), F.when(n % 7 != 6, "https://x.example/d.img").alias("dataUrl"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.lit("MIT").alias("license"),
    )
    return catalog.samples_of(table(spark, d, "nation").select(F.array(s).alias("samples")))


@query("s31_p20_catalog", """SELECT 's' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'public' ELSE 'local' END AS validation_tier, CASE WHEN n_nationkey % 9 = 8 THEN 'unsupported kind' WHEN n_nationkey % 7 = 6 THEN 'missing data_url' END AS problem,
CASE n_nationkey % 6 WHEN 0 THEN 'https://h.example/a/b.hdr' WHEN 1 THEN 'https://h.example/cat/c.hdr' WHEN 2 THEN 'https://o.example/x.hdr' WHEN 3 THEN 'https://h.example/up.hdr' WHEN 4 THEN 'https://h.example/cat/list.json?v=2' ELSE 'ftp://z.example/e.hdr' END AS header FROM nation""")
def s31(spark, d):
    return samples(spark, d).select("id", "validation_tier", "problem", catalog.resolved(F.col("header_url"), "https://h.example/cat/list.json").alias("header"))


@query("s32_load_sources", """SELECT 's' || n_nationkey AS id, CASE WHEN n_nationkey % 9 <> 8 AND n_nationkey % 7 <> 6 THEN CASE n_nationkey % 6 WHEN 0 THEN 'https://h.example/a/b.hdr' WHEN 1 THEN 'https://h.example/cat/c.hdr' WHEN 2 THEN 'https://o.example/x.hdr' WHEN 3 THEN 'https://h.example/up.hdr' WHEN 4 THEN 'https://h.example/cat/list.json?v=2' ELSE 'ftp://z.example/e.hdr' END END AS header,
CASE WHEN n_nationkey % 9 <> 8 AND n_nationkey % 7 <> 6 THEN 'https://x.example/d.img' END AS data FROM nation""")
def s32(spark, d):
    return samples(spark, d).select("id", catalog.load_source("https://h.example/cat/list.json").alias("l")).select("id", "l.header", "l.data")


@query("p20_catalog_tier", "SELECT 's' || n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0")
def p20(spark, d):
    return catalog.by_tier(samples(spark, d), "public").select("id")


@query("j12_sample_by_id", "SELECT 's7' AS id, n_name AS title FROM nation WHERE n_nationkey = 7")
def j12(spark, d):
    return catalog.sample(samples(spark, d), "s7").select("id", "title")


@query("s33_eligible", """SELECT page_id, page_id % 2 = 0 AS header_reachable, page_id % 3 <> 0 AS range_ok, page_id % 5 <> 4 AS cors_ok, page_id % 2 = 0 AND page_id % 3 <> 0 AND page_id % 5 <> 4 AS eligible FROM pages""")
def s33(spark, d):
    n, me = F.col("page_id"), F.lit("https://me.example")
    allow = F.when(n % 5 == 0, "*").when(n % 5 == 1, me)
    place = F.when(n % 5 >= 2, F.when(n % 5 == 4, "https://you.example/x").otherwise("https://ME.example/x")).otherwise("https://you.example/x")
    p = table(spark, d, "pages").select(
        "page_id", place.alias("header_url"), place.alias("data_url"), me.alias("origin"), F.when(n % 2 == 0, 200).otherwise(404).alias("header_status"), F.lit(206).alias("data_status"),
        allow.alias("header_allow"), allow.alias("data_allow"), F.when(n % 3 != 0, "bytes 0-15/99").alias("content_range"),
    )
    return catalog.eligible(p).select("page_id", "header_reachable", "range_ok", "cors_ok", "eligible")


@query("s13_s16_f01_headers", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey + 1 END::INT AS samples, CASE WHEN n_nationkey % 5 <> 4 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'u16' ELSE 'f32' END END AS data_type, CASE WHEN n_nationkey % 5 <> 4 THEN CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 4 END END::INT AS width, CASE WHEN n_nationkey % 5 <> 4 THEN 'a b' END AS note, n_nationkey % 5 = 4 AS failed FROM nation")
def s13(spark, d):
    from ..sources.header import parse_all

    n = F.col("n_nationkey")
    head = F.concat(
        F.lit("ENVI\n; a comment\nSamples = "), (n + 1).cast("string"), F.lit("\nlines = 4\n"), F.when(n % 5 == 4, "").otherwise("bands = 3\n"), F.lit("data type = "), F.when(n % 2 == 0, "12").otherwise("4"),
        F.lit("\ninterleave = BSQ\nmy note = {a\n  b}\nwavelength = {1, x}\n"),
    )
    h = parse_all(table(spark, d, "nation").select(n.alias("id"), head.alias("value")))
    return h.select("id", "header.samples", "header.data_type", F.col("header.bytes_per_pixel").alias("width"), F.col("header.custom_fields")["my note"].alias("note"), F.col("header.error").isNotNull().alias("failed"))


@query("s16_header_records", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 < 3 THEN n_nationkey + 1 END::BIGINT AS samples, CASE WHEN n_nationkey % 5 < 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'u16' ELSE 'f32' END END AS data_type, CASE WHEN n_nationkey % 5 < 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'lsb' ELSE 'msb' END END AS byte_order,
CASE WHEN n_nationkey % 5 < 3 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'nested ' || n_name ELSE 'top' END END AS map_info, CASE WHEN n_nationkey % 5 < 3 THEN '400.0,' || (401 + n_nationkey) || '.0' END AS wavelength, CASE WHEN n_nationkey % 5 < 3 THEN n_name END AS note,
CASE WHEN n_nationkey % 5 < 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN '1:red,2:-' ELSE '1:-,2:-' END END AS roles, CASE n_nationkey % 5 WHEN 3 THEN 'bands can''t be read' WHEN 4 THEN 'no header record' END AS error FROM nation""")
def s16(spark, d):
    n, null = F.col("n_nationkey"), F.lit(None).cast("string")
    rec = F.to_json(F.struct(
        (n + 1).cast("string").alias("samples"), F.lit(4).alias("lines"), F.when(n % 5 == 3, 0).otherwise(3).alias("bands"), F.lit("BSQ").alias("interleave"), F.when(n % 2 == 0, "uint16").otherwise("Float32").alias("dataType"),
        F.when(n % 2 == 0, "Little").otherwise("1").alias("byteOrder"), F.lit(0).alias("headerOffset"), F.lit(2).alias("bytesPerPixel"), F.lit("top").alias("mapInfo"), F.struct(F.when(n % 3 == 0, F.concat(F.lit("nested "), F.col("n_name"))).otherwise(null).alias("mapInfo")).alias("spatialReference"),
        F.array(F.lit(400), n + 401).alias("wavelength"), F.struct(F.col("n_name").alias("note")).alias("customFields"),
        F.array(F.struct(F.lit(1).alias("index"), F.when(n % 2 == 0, "RED").otherwise("pink").alias("displayRole")), F.struct(F.lit(2).alias("index"), null.alias("displayRole"))).alias("bandMetadata"),
    ))
    r = table(spark, d, "nation").select(n.alias("id"), records.record(F.when(n % 5 == 4, "[1, 2]").otherwise(rec)).alias("r"))
    roles = F.array_join(F.transform("r.band_metadata", lambda b: F.concat(b["index"].cast("string"), F.lit(":"), F.coalesce(b["display_role"], F.lit("-")))), ",")
    return r.select("id", "r.samples", "r.data_type", "r.byte_order", "r.map_info", F.array_join(F.col("r.wavelength").cast("array<string>"), ",").alias("wavelength"), F.col("r.custom_fields")["note"].alias("note"), roles.alias("roles"), "r.error")


@query("f37_f38_f42_numbers", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS finite, event_id % 3 <> 0 AS all_finite FROM events")
def f37(spark, d):
    from ..functions.geo import number

    t = F.array(F.lit("1"), F.when(F.col("event_id") % 3 == 0, "NaN").otherwise(F.col("value").cast("string")))
    n = F.transform(t, lambda v: number(v))
    return table(spark, d, "events").select("event_id", F.get(n, F.lit(1)).alias("finite"), F.forall(n, lambda v: v.isNotNull()).alias("all_finite"))


@query("f40_j11_custom_fields", "SELECT n_nationkey AS id, n_name AS value, NULL::VARCHAR AS other FROM nation")
def f40(spark, d):
    m = F.create_map(F.lit("  Data-Ignore__Value"), F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), bands.custom_field(m, "data ignore value").alias("value"), bands.custom_field(m, "x").alias("other"))
