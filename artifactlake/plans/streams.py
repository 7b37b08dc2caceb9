"""Bindings of the stream operators over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.windows import backfill_sequences
from ..registry import query
from ..session import scratch_dir
from ..streaming import events as op
from ..streaming.run import drain, table_stream
from .bindings import run_sql, table


def stream(spark, sf):
    schema = table(spark, sf, "events").schema
    live = table_stream(spark, sf, "events", schema)
    return live.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_dedupe_replays", "SELECT event_id, event_type, ts, 1 AS copy FROM events")
def t1(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts")
    # the replay comes first in the table and carries another payload
    later = rows.select("event_id", "event_type", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"), F.lit(2).alias("copy"))
    twice = later.unionByName(rows.withColumn("copy", F.lit(1)))
    return op.dedupe_replays(twice, ["event_id", "event_type"], "ts")


@query("t1_dedupe_replays_stream", "SELECT event_id, event_type FROM events")
def t1_stream(spark, sf):
    live = stream(spark, sf).select("event_id", "event_type", "ts")
    # every message arrives twice
    twice = live.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return drain(op.dedupe_replays(twice, ["event_id", "event_type"], "ts", "60 days").select("event_id", "event_type"))


@query(
    "t2_outbox_stream",
    """SELECT event_id, case_id, sequence FROM (SELECT event_id, user_id AS case_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events) WHERE sequence > 5""",
)
def t2(spark, sf):
    root = f"{scratch_dir(spark).rstrip('/')}/outbox-{uuid.uuid4().hex}"
    rows = run_sql(spark, sf, "SELECT event_id, user_id AS case_id, ts AS created_at FROM {events}")
    log = backfill_sequences(rows)
    log.write.parquet(f"{root}/log/part=a")
    log.write.parquet(f"{root}/log/part=b")
    live = (
        spark.readStream.schema(log.schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 8)
        .parquet(f"{root}/log")
    )
    # a second run with its own progress meets all events again
    for progress in ("first", "second"):
        op.outbox_stream(live, f"{root}/out", f"{root}/{progress}", after=5)
    out = spark.read.schema(log.schema).parquet(f"{root}/out")
    return out.select("event_id", "case_id", "sequence")


RULES = [
    ("view", True, False, None, False, 7200, None, None, "info", "Viewed {count}"),
    ("click", True, False, None, False, 0, "22:00", "06:30", "info", "Clicked"),
    ("purchase", True, True, 100, True, 0, "09:00", "12:00", "warning", "Bought {count} for {case_id}"),
    ("error", False, False, None, False, 0, None, None, "critical", "Failed"),
]


def rules(spark):
    return spark.createDataFrame(RULES, op.RULES_SCHEMA)


NOTIFY_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec, ts,
      hour(ts) * 60 + minute(ts) AS m, CAST(floor(value) AS INT) AS c FROM events),
    j AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'no_rule' WHEN event_type = 'error' THEN 'disabled'
      WHEN event_type = 'purchase' AND c < 100 THEN 'below_threshold'
      WHEN event_type = 'click' AND (m >= 1320 OR m < 390) THEN 'quiet_hours'
      WHEN event_type = 'purchase' AND m >= 540 AND m < 720 THEN 'quiet_hours' END AS why FROM e),
    f AS (SELECT user_id, min((ts, event_id)) AS first FROM j WHERE event_type = 'purchase' AND why IS NULL GROUP BY 1),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n FROM j WHERE event_type = 'view'),
    w AS (SELECT user_id, n, event_id, sec AS last, TRUE AS sent FROM v WHERE n = 1
      UNION ALL SELECT v.user_id, v.n, v.event_id, CASE WHEN v.sec - w.last >= 7200 THEN v.sec ELSE w.last END, v.sec - w.last >= 7200
      FROM w JOIN v ON v.user_id = w.user_id AND v.n = w.n + 1),
    d AS (SELECT j.event_id, CASE WHEN j.event_type = 'view' THEN CASE WHEN w.sent THEN 'matched' ELSE 'throttled' END
      WHEN j.event_type = 'purchase' AND coalesce(why, 'quiet_hours') = 'quiet_hours' AND (j.ts, j.event_id) > f.first THEN 'already_crossed_once'
      ELSE coalesce(why, 'matched') END AS reason
      FROM j LEFT JOIN w ON w.event_id = j.event_id LEFT JOIN f ON f.user_id = j.user_id)
    SELECT event_id, reason = 'matched' AS send, reason FROM d"""


def _events(df):
    return df.withColumn("count", F.floor("value").cast("int"))


@query("t3_notify", NOTIFY_SQL)
def t3(spark, sf):
    out = op.notify(_events(table(spark, sf, "events")), rules(spark), ["user_id"], "ts", "event_id")
    return out.select("event_id", "send", "reason")


# the way for keys too long for one task
@query("t3_notify_long_keys", NOTIFY_SQL)
def t3_long(spark, sf):
    out = op.notify(_events(table(spark, sf, "events")), rules(spark), ["user_id"], "ts", "event_id", limit=4)
    return out.select("event_id", "send", "reason")


def deliveries(spark, rows, part):
    """``rows`` as a stream, and what brings its three deliveries, ``part`` of each row telling which; most hold late rows.

    A delivery is one micro-batch, however many files it has.
    """
    root = f"{scratch_dir(spark).rstrip('/')}/deliveries-{uuid.uuid4().hex}"
    # a folder to read from before the first delivery
    spark.createDataFrame([], rows.schema).write.parquet(f"{root}/part=none")
    live = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(root)

    def bring(i):
        return lambda: rows.where(part == i).write.parquet(f"{root}/part={i}")

    return live, [bring(i) for i in range(3)]


def late_events(spark, sf):
    """Events in three deliveries; every other event comes up to a day late."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.least(F.floor((F.dayofmonth("ts") + F.col("event_id") % 2) / 11), F.lit(2))
    return deliveries(spark, rows, part)


#: whether the watermark, two days behind the latest event, has passed the second of an event
PASSED_SQL = "(sec + 1) * 1000 <= (SELECT epoch_ms(max(ts)) - 172800000 FROM events)"


@query(
    "t3_notify_stream",
    NOTIFY_SQL.replace("SELECT event_id, reason = 'matched' AS send, reason FROM d", f"""SELECT event_id, reason = 'matched' AS send, reason FROM d JOIN j USING (event_id)
    WHERE reason IN ('no_rule', 'disabled', 'below_threshold') OR {PASSED_SQL}"""),
)
def t3_stream(spark, sf):
    live, arrivals = late_events(spark, sf)
    out = op.notify_stream(_events(live), rules(spark), ["user_id"], "ts", "event_id", delay="2 days")
    return drain(out, arrivals=arrivals).select(F.col("event_ref").alias("event_id"), "send", "reason")


BEAT_SQL = """WITH RECURSIVE v AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
      row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
    w AS (SELECT user_id, n, event_id, sec AS last, TRUE AS sent FROM v WHERE n = 1
      UNION ALL SELECT v.user_id, v.n, v.event_id, CASE WHEN v.sec - w.last >= 86400 THEN v.sec ELSE w.last END, v.sec - w.last >= 86400
      FROM w JOIN v ON v.user_id = w.user_id AND v.n = w.n + 1)
    SELECT user_id, event_id FROM w WHERE sent"""


@query("t4_heartbeats", BEAT_SQL)
def t4(spark, sf):
    return op.heartbeats(table(spark, sf, "events"), ["user_id"], "ts", "event_id", 86400).select("user_id", "event_id")


@query(
    "t4_heartbeats_stream",
    BEAT_SQL.replace("SELECT user_id, event_id FROM w WHERE sent", f"""SELECT user_id, event_id, props FROM w JOIN v USING (user_id, event_id) JOIN events USING (user_id, event_id)
    WHERE sent AND {PASSED_SQL}"""),
)
def t4_stream(spark, sf):
    live, arrivals = late_events(spark, sf)
    out = drain(op.heartbeats_stream(live, ["user_id"], "ts", "event_id", 86400, ["props"], "2 days"), arrivals=arrivals)
    return out.select("user_id", F.col("event_ref").alias("event_id"), "props")


LIMIT_SQL = """WITH c AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type FROM events),
    n AS (SELECT event_id, sec, row_number() OVER (PARTITION BY event_type ORDER BY sec, event_id) - 1
      - count(*) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 60 PRECEDING) AS counter FROM c)
    SELECT event_id, counter, counter < 1 AS allowed, CASE WHEN counter < 1 THEN 0.0 ELSE 60.0 END AS wait_seconds FROM n"""


@query("t5_rate_limit", LIMIT_SQL)
def t5(spark, sf):
    out = op.rate_limit(table(spark, sf, "events"), "event_type", "ts", "event_id", per_minute=1)
    return out.select("event_id", "counter", "allowed", "wait_seconds")


# the way for keys too long for one task
@query("t5_rate_limit_long_keys", LIMIT_SQL)
def t5_long(spark, sf):
    out = op.rate_limit(table(spark, sf, "events"), "event_type", "ts", "event_id", per_minute=1, limit=100)
    return out.select("event_id", "counter", "allowed", "wait_seconds")


@query(
    "t5_rate_limit_stream",
    """SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS calls, least(count(*), 2) AS allowed_calls,
      count(*) >= 2 AS exhausted FROM events GROUP BY ALL""",
)
def t5_stream(spark, sf):
    live = stream(spark, sf)
    return drain(op.rate_limit_stream(live, "event_type", "ts", per_minute=2), "update", ["event_type", "minute"])


@query("t5_rate_limit_calls_stream", f"{LIMIT_SQL} WHERE {PASSED_SQL}")
def t5_calls_stream(spark, sf):
    live, arrivals = late_events(spark, sf)
    out = drain(op.rate_limit_calls_stream(live, "event_type", "ts", "event_id", 1, "2 days"), arrivals=arrivals)
    return out.select(F.col("event_ref").alias("event_id"), "counter", "allowed", "wait_seconds")


@query(
    "t6_stable_files_stream",
    """WITH o AS (SELECT 'f' || user_id || CASE WHEN user_id % 25 = 0 THEN '.done' ELSE '' END AS path, max(event_id % 3) AS size_bytes,
        max(event_id % 2) AS mtime, day(ts) AS scan FROM events GROUP BY user_id, day(ts)),
    p AS (SELECT *, lag(size_bytes) OVER w AS ps, lag(mtime) OVER w AS pm, lag(scan) OVER w AS pn FROM o WINDOW w AS (PARTITION BY path ORDER BY scan)),
    r AS (SELECT path, scan, size_bytes FROM p WHERE scan * 86400 + 1 <= (SELECT max(scan) * 86400 - 172800 FROM o) AND (path LIKE '%.done' OR (ps = size_bytes AND pm = mtime AND pn = scan - 1)))
    SELECT path, min(scan) AS ready_scan, arg_min(size_bytes, scan) AS size_bytes FROM r GROUP BY path""",
)
def t6(spark, sf):
    from .windows import OBSERVED

    seen = run_sql(spark, sf, OBSERVED.replace("{day}", "day(ts)").replace("{t}", "{events}"))
    seen = seen.withColumn("seen_at", F.timestamp_seconds(F.col("scan") * 86400))
    part = F.least(F.floor((F.col("scan") + F.pmod(F.xxhash64("path"), F.lit(2))) / 11), F.lit(2))
    live, arrivals = deliveries(spark, seen, part)
    return drain(op.stable_files_stream(live, "seen_at", delay="2 days"), arrivals=arrivals)


LEASE_SQL = """WITH n AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
      lead(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
    m AS (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) - {behind} AS now FROM events)
    SELECT user_id, event_id, make_timestamp((sec + 50000) * 1000000) AS expired_at FROM n, m
    WHERE least(coalesce(nx, now), now) - sec > 50000"""


@query("t7_expired_leases", LEASE_SQL.replace("{behind}", "0"))
def t7(spark, sf):
    beats = table(spark, sf, "events")
    latest = beats.agg(F.max(F.unix_timestamp("ts"))).first()[0]
    as_of = F.timestamp_seconds(F.lit(latest).cast("long"))
    return op.expired_leases(beats, ["user_id"], "ts", "event_id", 50000, as_of).select("user_id", "event_id", "expired_at")


@query("t7_expired_leases_stream", LEASE_SQL.replace("{behind}", "172800"))
def t7_stream(spark, sf):
    live, arrivals = late_events(spark, sf)
    out = drain(op.expired_leases_stream(live, ["user_id"], "ts", "event_id", 50000, "2 days"), arrivals=arrivals)
    return out.select(
        "user_id", F.col("event_ref").alias("event_id"), F.timestamp_seconds("expired_at").alias("expired_at")
    )


@query(
    "t8_live_counters",
    "SELECT user_id AS case_id, event_type, count(*) AS count FROM events GROUP BY ALL",
)
def t8(spark, sf):
    live = stream(spark, sf).withColumnRenamed("user_id", "case_id")
    keys = ["case_id", "event_type"]
    return drain(op.live_counters(live, keys), "update", keys)


@query(
    "t9_daily_histogram_stream",
    "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS count FROM events GROUP BY ALL",
)
def t9(spark, sf):
    live = stream(spark, sf)
    return drain(op.daily_histogram_stream(live, "ts"), "update", ["date"])


@query(
    "c29_render_messages",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'Viewed ' || CAST(floor(value) AS INT) || ' with [redacted]' WHEN 'click' THEN 'Clicked ?'
        WHEN 'purchase' THEN 'Bought for ' || user_id ELSE 'no tokens' END AS body,
      'http://ui/#/case/' || user_id AS local_ui_link FROM events WHERE event_type <> 'error'""",
)
def c29(spark, sf):
    from ..operators.records import render_messages

    templates = spark.createDataFrame(
        [
            ("view", "info", "Viewed {count} with {password}"),
            ("click", "info", "Clicked {state}"),
            ("purchase", "warning", "Bought for {case_id}"),
            ("signup", "info", "no tokens"),
        ],
        "event_type string, severity string, template string",
    )
    rows = run_sql(
        spark,
        sf,
        """SELECT event_id, event_type, CAST(user_id AS STRING) AS case_id,
             map('count', CAST(CAST(floor(value) AS INT) AS STRING), 'case_id', CAST(user_id AS STRING)) AS payload FROM {events}""",
    )
    return render_messages(rows, templates, "http://ui/").select("event_id", "body", "local_ui_link")


