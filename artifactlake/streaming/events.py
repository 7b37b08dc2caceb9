"""Stream operators over event logs, with their batch twins."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timing import minutes_of_day
from ..operators.aggs import daily_histogram  # noqa: F401  (batch twin of daily_histogram_stream)
from ..operators.grouped import GROUP_LIMIT, last_before, number_rows, with_neighbour
from ..operators.windows import stable_files  # noqa: F401  (batch twin of stable_files_stream)
from .ordered import AT, Decisions, decide_in_order
from .throttle import FOLD_LIMIT, greedy_throttle


def replay_key(payload: str = "payload") -> Column:
    """Scope part of a replay key: idempotency key, else batch id, else stage."""
    part = lambda n: F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit(""))
    return F.coalesce(part("idempotency_key"), part("batch_id"), part("stage"))


def dedupe_replays(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First message per replay key by ``ts``; on a stream the first to arrive, for ``delay`` of event time."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
    rank = F.struct(F.col(ts).isNull(), F.col(ts))
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), rank).alias("__first"))
    return first.select("__first.*")


def outbox_stream(stream: DataFrame, target: str, progress: str, after: int = 0) -> None:
    """Deliver events after a sequence number into ``target`` once each, in order inside a batch.

    A delivered (case, sequence) is never written again, however often the source repeats it and
    whichever progress folder the run has. Each batch has a folder of its own, named by the query id
    that the progress folder keeps and the batch number, so only a rerun of that batch overwrites it.
    Of what other batches delivered, the two key columns are read.
    """
    spark = stream.sparkSession
    keys = ["case_id", "sequence"]
    place = [T.StructField("delivery_run", T.StringType()), T.StructField("delivery_batch", T.LongType())]
    history = T.StructType([*[stream.schema[c] for c in keys], *place])
    # a target to read from before the first delivery
    empty = spark.createDataFrame([], stream.schema)
    empty.write.mode("overwrite").parquet(f"{target}/delivery_run=none/delivery_batch=0")
    started = threading.Event()

    def deliver(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        own = (F.col("delivery_run") == running.id) & (F.col("delivery_batch") == batch_id)
        done = spark.read.schema(history).parquet(target).where(~own).select(*keys)
        fresh = batch.where(F.col("sequence") > after).dropDuplicates(keys).join(done, keys, "left_anti")
        fresh.select(*batch.columns).sortWithinPartitions(*keys).write.mode("overwrite").parquet(
            f"{target}/delivery_run={running.id}/delivery_batch={batch_id}"
        )

    running = (
        stream.writeStream.option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(deliver)
        .start()
    )
    started.set()
    running.awaitTermination()


# --------------------------------------------------------------------------- notifications

COUNT_EVENTS = ("job.count", "job.high-value-sensitive-count")
RULES_SCHEMA = (
    "event_type string, enabled boolean, count_rule boolean, threshold int, threshold_once boolean,"
    " throttle_seconds int, quiet_start string, quiet_end string, severity string, template string"
)


#: hours and minutes of quiet hours
HHMM = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9])$"


def rule_warnings(
    rules: DataFrame, known_events: Sequence[str], safe_tokens: Sequence[str], ui_base: str | None = None
) -> DataFrame:
    """One row per problem of a rule table; without a ``ui_base`` for links, a row that names no event type."""
    tokens = F.regexp_extract_all("template", F.lit(r"\{([a-z_][a-z0-9_]*)\}"), F.lit(1))
    unsafe = F.filter(tokens, lambda t: ~t.isin(*safe_tokens))
    repeated = rules.groupBy("event_type").count().where("count > 1").select("event_type", F.lit(True).alias("__dup"))
    flags = [
        (F.coalesce("__dup", F.lit(False)), "duplicate_rule"),
        (~F.col("event_type").isin(*known_events), "unsupported_event_type"),
        (~F.col("severity").isin("info", "warning", "critical"), "unsupported_severity"),
        (F.col("throttle_seconds") < 0, "negative_throttle"),
        (F.col("quiet_start").isNull() != F.col("quiet_end").isNull(), "incomplete_quiet_hours"),
        (~F.col("quiet_start").rlike(HHMM) | ~F.col("quiet_end").rlike(HHMM), "invalid_quiet_hours"),
    ]
    found = F.concat(
        F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in flags])),
        F.transform(unsafe, lambda t: F.concat(F.lit("unsafe_template_token:"), t)),
    )
    warnings = (
        rules.join(repeated, "event_type", "left")
        .select("event_type", F.explode(found).alias("warning"))
        .distinct()
    )
    if ui_base:
        return warnings
    base = rules.sparkSession.createDataFrame([(None, "missing_local_ui_base")], warnings.schema)
    return warnings.unionByName(base)


def in_quiet_hours(ts: str) -> Column:
    """Whether the time lies in the rule's quiet hours; malformed or incomplete hours are never quiet."""

    def minutes(c: str) -> Column:
        part = lambda i: F.regexp_extract(c, HHMM, i).try_cast("int")
        return part(1) * 60 + part(2)

    now, start, end = minutes_of_day(ts), minutes("quiet_start"), minutes("quiet_end")
    quiet = F.when(start <= end, (now >= start) & (now < end)).when(start > end, (now >= start) | (now < end))
    return F.coalesce(quiet, F.lit(False))


def _judged(events: DataFrame, rules: DataFrame, ts: str, count: str) -> DataFrame:
    """Events with the reasons that need no memory; NULL means "may be sent"."""
    # one row per event type
    table = F.broadcast(rules.drop("severity", "template").withColumn("__rule", F.lit(True)))
    joined = events.join(table, "event_type", "left")
    low = F.col("count_rule") & F.col("threshold").isNotNull() & (F.col(count) < F.col("threshold"))
    return joined.withColumn(
        "__why",
        F.when(F.col("__rule").isNull(), "no_rule")
        .when(~F.col("enabled"), "disabled")
        .when(F.coalesce(low, F.lit(False)), "below_threshold")
        .when(in_quiet_hours(ts), "quiet_hours"),
    ).withColumn("__at", F.unix_timestamp(ts))


_RULE_COLS = (
    "enabled",
    "count_rule",
    "threshold",
    "threshold_once",
    "throttle_seconds",
    "quiet_start",
    "quiet_end",
    "__rule",
)


def notify(
    events: DataFrame,
    rules: DataFrame,
    keys: Sequence[str],
    ts: str,
    id_col: str,
    count: str = "count",
    limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Decision per event in time order: ``send`` and ``reason``.

    Everything that depends on the row alone is decided first; only the remaining candidates take
    part in the once rule (a minimum per key) and in the throttle since the last sent event.
    """
    group = [*keys, "event_type"]
    judged = _judged(events, rules, ts, count)
    # a once rule without a threshold has nothing to cross: it is throttled like the others
    once = F.coalesce(F.col("count_rule") & F.col("threshold_once"), F.lit(False)) & F.col("threshold").isNotNull()
    free = judged.where("__why IS NULL")
    first = (
        free.where(once)
        .groupBy(*group)
        .agg(F.min(F.struct(F.col(ts), F.col(id_col))).alias("__first"))
    )
    crossing = judged.where(once).join(first, group, "left")
    me = F.struct(F.col(ts), F.col(id_col))
    open_why = F.col("__why").isNull() | (F.col("__why") == "quiet_hours")
    crossed = crossing.withColumn(
        "reason",
        F.when(open_why & F.col("__first").isNotNull() & (me > F.col("__first")), "already_crossed_once")
        .when(F.col("__why").isNotNull(), F.col("__why"))
        .otherwise("matched"),
    ).drop("__first")
    others = judged.where(~once)
    decided = others.where("__why IS NOT NULL").withColumn("reason", F.col("__why"))
    open_rows = others.where("__why IS NULL")
    unthrottled = open_rows.where(F.coalesce(F.col("throttle_seconds"), F.lit(0)) <= 0).withColumn(
        "reason", F.lit("matched")
    )
    throttled = greedy_throttle(
        open_rows.where(F.col("throttle_seconds") > 0).withColumn("__sec", F.col("__at")),
        group,
        ["__sec", id_col],
        "__sec",
        "throttle_seconds",
        limit,
    ).withColumn("reason", F.when(F.col("kept"), "matched").otherwise("throttled"))
    parts = [crossed, decided, unthrottled, throttled.drop("kept", "__sec")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("send", F.col("reason") == "matched").drop(*_RULE_COLS, "__why", "__at")


NOTIFY_STATE = "last_sent long, crossed boolean, gap long"


def notify_stream(
    events: DataFrame, rules: DataFrame, keys: Sequence[str], ts: str, id_col: str, count: str = "count", delay: str = "1 hour"
) -> DataFrame:
    """The decisions of :func:`notify` on a stream, for all events that the watermark has passed.

    What a row decides alone comes out at once, past the state. The others wait until the watermark, ``delay`` behind the latest
    event, has passed their second, and are decided in the order of time, however they arrived. The state
    per key is the last sent time, which ends with the rule's throttle, and the crossed flag of once rules,
    which stays.
    """
    group = [*keys, "event_type"]
    judged = _judged(events, rules, ts, count).select(
        *group, F.col(id_col).alias("event_ref"), F.col(ts).alias("__ts"), F.col("__why").alias("why"), F.col("__at").alias("sec"),
        (F.col("count_rule") & F.col("threshold").isNotNull() & F.col("threshold_once")).alias("once"), F.col("throttle_seconds").cast("long").alias("gap"),
    )
    out = T.StructType(
        [judged.schema[c] for c in group]
        + [
            judged.schema["event_ref"],
            T.StructField("send", T.BooleanType()),
            T.StructField("reason", T.StringType()),
        ]
    )

    def step(memory: tuple, row) -> tuple[tuple, tuple]:
        last, crossed, _ = memory
        gap = row["gap"] or 0
        if row["once"] and crossed:
            reason = "already_crossed_once"
        elif row["why"] is not None:
            reason = row["why"]
        elif not row["once"] and last is not None and row["sec"] - last < gap:
            reason = "throttled"
        else:
            reason, last, crossed = "matched", row["sec"], crossed or bool(row["once"])
        return (last, crossed, gap), (row["event_ref"], reason == "matched", reason)

    decisions = Decisions(
        (None, False, 0),
        step,
        # a once rule looks at the exact time, a throttle at the second
        lambda row: (row["sec"], row[AT] if row["once"] else 0, row["event_ref"]),
        lambda memory: None if memory[1] else (memory[0] or 0) * 1000 + memory[2] * 1000,
    )
    alone = F.coalesce(F.col("why").isin("no_rule", "disabled", "below_threshold"), F.lit(False))
    told = judged.where(alone).select(*group, "event_ref", F.lit(False).alias("send"), F.col("why").alias("reason"))
    return told.unionByName(decide_in_order(judged, group, "__ts", delay, decisions, NOTIFY_STATE, out, ~alone))


def heartbeats(
    events: DataFrame, keys: Sequence[str], ts: str, id_col: str, seconds: int, limit: int = FOLD_LIMIT
) -> DataFrame:
    """Heartbeats to emit: the first of a key and each one ``seconds`` or more after the last emitted."""
    timed = events.withColumn("__sec", F.unix_timestamp(ts)).withColumn("__gap_s", F.lit(seconds))
    kept = greedy_throttle(timed, keys, ["__sec", id_col], "__sec", "__gap_s", limit)
    return kept.where("kept").drop("kept", "__sec", "__gap_s")


def heartbeats_stream(
    events: DataFrame, keys: Sequence[str], ts: str, id_col: str, seconds: int, payload: Sequence[str] = (), delay: str = "1 hour"
) -> DataFrame:
    """:func:`heartbeats` on a stream, for all events that the watermark has passed, with ``payload`` columns.

    The state per key is the time of the last emitted heartbeat; it ends when the next one would be due anyway.
    """
    rows = events.select(*keys, F.col(id_col).alias("event_ref"), F.unix_timestamp(ts).alias("at"), F.col(ts).alias("__ts"), *payload)
    told = ["event_ref", "at", *payload]
    out = T.StructType([rows.schema[c] for c in (*keys, *told)])

    def step(memory: tuple, row) -> tuple[tuple, tuple | None]:
        last = memory[0]
        if last is not None and row["at"] - last < seconds:
            return memory, None
        return (row["at"],), tuple(row[c] for c in told)

    decisions = Decisions(
        (None,), step, lambda row: (row["at"], row["event_ref"]), lambda memory: ((memory[0] or 0) + seconds) * 1000
    )
    return decide_in_order(rows, keys, "__ts", delay, decisions, "last long", out)


def rate_limit(
    calls: DataFrame, key: str, ts: str, id_col: str, per_minute: int = 60, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Calls with ``counter``, the calls of the last 60 seconds before them, whether they are allowed and how long to wait.

    The window slides: a call at second s counts the calls from second s - 59 on that come before it in the
    order of (second, id). Keys above ``limit`` calls are numbered in slices of time. Calls without a time are
    not counted and not allowed.
    """
    names = calls.columns
    timed = calls.withColumn("__sec", F.unix_timestamp(F.col(ts).cast("timestamp")))
    numbered = number_rows(timed.where("__sec IS NOT NULL"), [key], ["__sec", id_col], "__n", limit)
    # each call asks for the last one that is out of its window
    points = numbered.select(key, F.col("__sec").alias("__t"), F.lit(1).alias("__role"), "__n", F.col("__n").alias("__done"))
    asks = numbered.select(*names, (F.col("__sec") - 59).alias("__t"), F.lit(0).alias("__role"), "__n", F.lit(None).cast("long").alias("__done"))
    both = asks.unionByName(points, allowMissingColumns=True)
    found = last_before(both, [key], ["__t", "__role", "__n"], "__done", "__before", limit).where("__role = 0")
    counter = F.col("__n") - 1 - F.coalesce("__before", F.lit(0))
    counted = found.select(*names, counter.alias("counter"))
    untimed = timed.where("__sec IS NULL").select(*names, F.lit(None).cast("long").alias("counter"))
    return (
        counted.unionByName(untimed)
        .withColumn("allowed", F.coalesce(F.col("counter") < per_minute, F.lit(False)))
        .withColumn("wait_seconds", F.when(F.col("allowed"), 0.0).otherwise(60.0))
    )


def rate_limit_stream(
    calls: DataFrame, key: str, ts: str, per_minute: int = 60, delay: str = "5 minutes"
) -> DataFrame:
    """Calls per key and minute with the state of the limit at the end of the minute."""
    counted = (
        calls.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 minute").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("calls"))
    )
    return counted.select(
        key,
        F.col("w.start").alias("minute"),
        "calls",
        F.least(F.col("calls"), F.lit(per_minute)).alias("allowed_calls"),
        (F.col("calls") >= per_minute).alias("exhausted"),
    )


def rate_limit_calls_stream(
    calls: DataFrame, key: str, ts: str, id_col: str, per_minute: int = 60, delay: str = "5 minutes", slice_seconds: int = 900
) -> DataFrame:
    """:func:`rate_limit` on a stream, for all calls that the watermark, ``delay`` behind the latest, has passed.

    Keys are cut into slices of ``slice_seconds``, so no task holds all calls of a key; the calls of the 59 seconds
    before a slice are counted there too. State per key and slice: the number of calls in each of the last 60 seconds,
    which ends a minute after the last call.
    """
    rows = calls.select(key, F.col(id_col).alias("event_ref"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("sec"), F.col(ts).alias("__ts"))
    part = lambda sec: F.floor(sec / slice_seconds)
    # the second entry only counts: the call is told in its own slice
    places = F.array_distinct(F.array(part(F.col("sec")), part(F.col("sec") + 59)))
    rows = rows.withColumn("slice", F.explode(places)).withColumn("told", F.col("slice") == part(F.col("sec")))
    out = T.StructType(
        [
            rows.schema[key],
            rows.schema["slice"],
            rows.schema["event_ref"],
            T.StructField("counter", T.LongType()),
            T.StructField("allowed", T.BooleanType()),
            T.StructField("wait_seconds", T.DoubleType()),
        ]
    )

    def step(memory: tuple, row) -> tuple[tuple, tuple | None]:
        recent = {s: n for s, n in zip(*memory, strict=True) if s >= row["sec"] - 59}
        counter = sum(recent.values())
        recent[row["sec"]] = recent.get(row["sec"], 0) + 1
        allowed = counter < per_minute
        told = (row["event_ref"], counter, allowed, 0.0 if allowed else 60.0)
        return (list(recent), list(recent.values())), told if row["told"] else None

    decisions = Decisions(
        ([], []), step, lambda row: (row["sec"], row["event_ref"]), lambda memory: (max(memory[0], default=0) + 60) * 1000
    )
    decided = decide_in_order(rows, [key, "slice"], "__ts", delay, decisions, "seconds array<long>, calls array<long>", out)
    return decided.drop("slice")


def stable_files_stream(observations: DataFrame, ts: str, suffix: str = ".done", delay: str = "1 hour") -> DataFrame:
    """Files that became complete: finalized name, or same size and mtime as in the scan before.

    Observations of a path are taken in the order of their scans once the watermark on ``ts``, the time of the
    observation, has passed them. State per path: the last scan, its size and mtime, and whether the file
    was already reported; a path that is reported keeps only that flag.
    """
    out = T.StructType(
        [
            observations.schema["path"],
            T.StructField("ready_scan", T.LongType()),
            T.StructField("size_bytes", T.LongType()),
        ]
    )
    rows = observations.select(
        "path", F.col("scan").cast("long"), F.col("size_bytes").cast("long"), F.col("mtime").cast("long"), F.col(ts).alias("__ts"),
        F.col("path").endswith(suffix).alias("named"),
    )

    def step(memory: tuple, row) -> tuple[tuple, tuple | None]:
        scan, size, mtime, done = memory
        if done:
            return memory, None
        same = scan is not None and row["scan"] == scan + 1 and (row["size_bytes"], row["mtime"]) == (size, mtime)
        if row["named"] or same:
            return (None, None, None, True), (row["scan"], row["size_bytes"])
        return (row["scan"], row["size_bytes"], row["mtime"], False), None

    decisions = Decisions((None, None, None, False), step, lambda row: (row["scan"],))
    return decide_in_order(rows, ["path"], "__ts", delay, decisions, "scan long, size long, mtime long, done boolean", out)


def expired_leases(
    beats: DataFrame, keys: Sequence[str], ts: str, id_col: str, lease_seconds: int, as_of: Column | None = None
) -> DataFrame:
    """Heartbeats whose lease ran out before the next one and before ``as_of`` (now by default).

    The last heartbeat of a key is judged by ``as_of`` alone, so the lease of a dead worker is found. A
    beat exactly at expiry is in time. Rows without a time have no lease.
    """
    near = with_neighbour(beats, keys, [ts, id_col], {"at": F.col(ts)}, "__next", ahead=True)
    now, then = F.unix_timestamp(ts), F.unix_timestamp(F.col("__next.at"))
    end = F.unix_timestamp(F.current_timestamp() if as_of is None else as_of)
    # least() passes over nulls
    return (
        near.where(F.coalesce(F.least(then, end) - now > lease_seconds, F.lit(False)))
        .withColumn("expired_at", F.timestamp_seconds(now + lease_seconds))
        .drop("__next")
    )


def expired_leases_stream(
    beats: DataFrame, keys: Sequence[str], ts: str, id_col: str, lease_seconds: int, delay: str = "1 hour"
) -> DataFrame:
    """:func:`expired_leases` as of the watermark, which runs ``delay`` behind the latest heartbeat.

    State per key: the heartbeats that the watermark has not settled, in time order whatever order they
    arrived in. A beat leaves when the watermark is past it and its successor came in time, or past its
    lease; a timer reports keys that fall silent. Beats that arrive when the watermark has reached them are dropped.
    """
    timed = beats.withColumn("__time", F.col(ts).cast("timestamp")).withWatermark("__time", delay)
    # beats of one second are in order by their microseconds, as in the batch form
    rows = timed.select(*keys, F.col(id_col).alias("event_ref"), F.unix_micros("__time").alias("at"), "__time")
    fields = [rows.schema[c] for c in (*keys, "event_ref", "at")]
    out = T.StructType([*fields, T.StructField("expired_at", T.LongType())])
    held = T.StructType(
        [
            T.StructField("at", T.ArrayType(T.LongType())),
            T.StructField("ref", T.ArrayType(rows.schema["event_ref"].dataType)),
        ]
    )

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_beats = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for pdf in frames:
                open_beats.extend(zip(pdf["at"].tolist(), pdf["event_ref"].tolist(), strict=True))
        open_beats.sort()
        mark = state.getCurrentWatermarkMs() // 1000
        gone, left = [], []
        for i, (micros, ref) in enumerate(open_beats):
            at = micros // 1_000_000
            in_time = i + 1 < len(open_beats) and open_beats[i + 1][0] // 1_000_000 - at <= lease_seconds
            if not in_time and mark > at + lease_seconds:
                gone.append((*key, ref, at, at + lease_seconds))
            elif not in_time or mark <= at:
                left.append((micros, ref))
        if left:
            state.update(([micros for micros, _ in left], [ref for _, ref in left]))
            state.setTimeoutTimestamp((left[0][0] // 1_000_000 + lease_seconds + 1) * 1000 - 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(gone, columns=[f.name for f in out.fields])

    return rows.where("__time IS NOT NULL").groupBy(*keys).applyInPandasWithState(
        watch, out, held, "append", GroupStateTimeout.EventTimeTimeout
    )


def live_counters(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running counts per case and event type; on a stream use update mode."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def daily_histogram_stream(events: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Counts per day on a stream. Rows later than ``delay`` are counted as dropped in the progress."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "count")
