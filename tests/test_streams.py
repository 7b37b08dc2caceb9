"""Leases of silent workers, once rules without a threshold, and deliveries over several runs and batches."""

from pyspark.sql import functions as F

from artifactlake.streaming import events as op
from artifactlake.streaming.run import drain

BEATS = [("w1", 1, 0), ("w1", 2, 50), ("w1", 3, 400), ("w2", 4, 100), ("w3", 5, 390), ("w4", 6, 300), (None, 7, 5)]


def beats(spark, rows=BEATS):
    df = spark.createDataFrame(rows, "worker string, id int, sec long")
    return df.select("worker", "id", F.timestamp_seconds("sec").alias("ts"))


def leases_by_hand(rows, lease, as_of):
    out = set()
    for worker, ref, sec in rows:
        later = [s for w, r, s in rows if w == worker and (s, r) > (sec, ref)]
        if min([*later, as_of]) - sec > lease:
            out.add((worker, ref, sec + lease))
    return out


def test_silent_workers_lose_their_lease(spark):
    out = op.expired_leases(beats(spark), ["worker"], "ts", "id", 100, F.timestamp_seconds(F.lit(400)))
    got = {(r.worker, r.id, r.e) for r in out.select("worker", "id", F.unix_timestamp("expired_at").alias("e")).collect()}
    # w4's lease ends exactly at the time asked for, and is in time
    assert got == leases_by_hand(BEATS, 100, 400) == {("w1", 2, 150), ("w2", 4, 200), (None, 7, 105)}


def test_lease_stream_over_batches_out_of_order(spark, tmp_path):
    rows = [*BEATS, ("w1", 8, 130), ("w2", 9, 160), ("w9", 10, 900)]
    # the beats that save w1 and w2 for a while arrive after later ones
    for i, ids in enumerate([{1, 3, 4, 5}, {2, 6, 7, 8, 9}, {10}]):
        beats(spark, [r for r in rows if r[1] in ids]).coalesce(1).write.parquet(f"{tmp_path}/part={i}")
    live = (
        spark.readStream.schema("worker string, id int, ts timestamp")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path))
    )
    out = drain(op.expired_leases_stream(live, ["worker"], "ts", "id", 100, "410 seconds"))
    got = {(r.worker, r.event_ref, r.expired_at) for r in out.collect()}
    assert got == leases_by_hand(rows, 100, 490)


def test_rate_limit_slides_over_slices_and_batches(spark, tmp_path):
    # (id, second, file): calls a minute apart, ties in one second, calls that come late
    rows = [("k", i, s, f) for i, (s, f) in enumerate([(600, 0), (610, 0), (659, 1), (660, 1), (660, 2), (661, 0), (719, 2), (720, 1), (605, 2), (5000, 1)])]
    rows += [("other", 50, 660, 2), (None, 51, 661, 0), (None, 52, 662, 1)]
    def by_hand(i):
        key, ref, sec, _ = rows[i]
        return sum(1 for k, r, s, _ in rows if k == key and sec - 59 <= s and (s, r) < (sec, ref))
    want = {r[1]: by_hand(i) for i, r in enumerate(rows)}
    live = files_of(spark, tmp_path, [*rows, ("end", 99, 99_000, 3)], "who string, id int, sec long")
    calls = spark.createDataFrame([r[:3] for r in rows], "who string, id int, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    for limit in (1_000, 3):
        out = op.rate_limit(calls, "who", "ts", "id", 3, limit).collect()
        assert {r.id: r.counter for r in out} == want
        assert all(r.allowed == (r.counter < 3) and r.wait_seconds == (0.0 if r.allowed else 60.0) for r in out)
    untimed = op.rate_limit(calls.withColumn("ts", F.when(F.col("id") > 2, F.col("ts"))), "who", "ts", "id").where("id <= 2").collect()
    assert [(r.counter, r.allowed) for r in untimed] == [(None, False)] * 3
    got = drain(op.rate_limit_calls_stream(live, "who", "ts", "id", 3, "2 hours")).collect()
    assert {r.event_ref: (r.counter, r.allowed) for r in got} == {i: (n, n < 3) for i, n in want.items()}


def test_once_rule_without_threshold_is_throttled(spark):
    rule = [("job.count", True, True, None, True, 3600, None, None, "info", "x")]
    rows = spark.createDataFrame([("c", i, "job.count", 60 * i, i) for i in range(4)], "case_id string, id int, event_type string, sec long, count int")
    rows = rows.withColumn("ts", F.timestamp_seconds("sec"))
    out = op.notify(rows, spark.createDataFrame(rule, op.RULES_SCHEMA), ["case_id"], "ts", "id")
    assert [r.reason for r in out.orderBy("id").collect()] == ["matched", "throttled", "throttled", "throttled"]


def test_rule_warnings_name_malformed_quiet_hours_and_the_missing_link_base(spark):
    rows = [
        ("job.count", True, True, 5, True, 0, "22:00", "6:30", "info", "{count}"),
        ("job.done", True, False, None, False, 0, "24:00", "06:30", "info", "{secret}"),
        ("job.failed", True, False, None, False, 0, "22:00", None, "info", "x"),
        ("job.odd", True, False, None, False, 0, "noon", "one", "info", "x"),
    ]
    rules = spark.createDataFrame(rows, op.RULES_SCHEMA)
    known = [r[0] for r in rows]
    want = {
        ("job.done", "invalid_quiet_hours"), ("job.done", "unsafe_template_token:secret"),
        ("job.failed", "incomplete_quiet_hours"), ("job.odd", "invalid_quiet_hours"),
    }
    got = {tuple(r) for r in op.rule_warnings(rules, known, ["count"], "http://ui/").collect()}
    assert got == want
    bare = {tuple(r) for r in op.rule_warnings(rules, known, ["count"]).collect()}
    assert bare == want | {(None, "missing_local_ui_base")}
    events = spark.createDataFrame([("c", i, e, 82_800, 9) for i, e in enumerate(known)], "case_id string, id int, event_type string, sec long, count int")
    out = op.notify(events.withColumn("ts", F.timestamp_seconds("sec")), rules, ["case_id"], "ts", "id")
    assert [r.reason for r in out.orderBy("id").collect()] == ["quiet_hours", "matched", "matched", "matched"]


def test_outbox_delivers_once_over_runs(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 3).alias("case_id"), F.col("id").alias("sequence"))
    rows.repartition(4).write.parquet(f"{tmp_path}/log/a")
    rows.repartition(2).write.parquet(f"{tmp_path}/log/b")
    for run in ("one", "two"):
        live = (
            spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/log")
        )
        op.outbox_stream(live, f"{tmp_path}/out", f"{tmp_path}/{run}", after=4)
    got = [r.sequence for r in spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == list(range(5, 20))


def files_of(spark, tmp_path, rows, schema):
    """``rows`` with a file number at the end, as a stream of one file a batch."""
    for i in range(max(r[-1] for r in rows) + 1):
        part = spark.createDataFrame([r[:-1] for r in rows if r[-1] == i], schema)
        part.withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.parquet(f"{tmp_path}/part={i}")
    return (
        spark.readStream.schema(schema + ", ts timestamp")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path))
    )


def test_notify_and_heartbeat_streams_in_event_time(spark, tmp_path):
    """Four shuffled files decide as the batch forms do, and silent keys leave no state."""
    import random

    draw = random.Random(4)
    kinds = ["view", "count", "other", "off"]
    rows = [(f"c{draw.randrange(3)}", i, draw.choice(kinds), 100_000 + draw.randrange(4000) * 10 / 4, draw.randrange(9), draw.randrange(4)) for i in range(400)]
    rows += [(None, 900, "view", 100_500.0, 1, 2), (None, 901, "view", 100_400.0, 1, 3)]
    # the watermark reaches the end of all of them, and of the throttles after them
    rows += [("end", 999, "view", 900_000.0, 1, 4)]
    schema = "case_id string, id int, event_type string, sec double, count int"
    rules = spark.createDataFrame(
        [("view", True, False, None, False, 600, None, None, "info", "x"), ("count", True, True, 5, True, 0, None, None, "info", "x"),
         ("off", False, False, None, False, 0, None, None, "info", "x")],
        op.RULES_SCHEMA,
    )
    live = files_of(spark, tmp_path / "events", rows, schema)
    table = spark.read.option("recursiveFileLookup", "true").schema(schema + ", ts timestamp").parquet(str(tmp_path / "events")).where("id <> 999")
    want = {(r.id, r.reason) for r in op.notify(table, rules, ["case_id"], "ts", "id").collect()}
    assert {w[1] for w in want} == {"no_rule", "disabled", "below_threshold", "already_crossed_once", "throttled", "matched"}
    out = op.notify_stream(live, rules, ["case_id"], "ts", "id", delay="3 hours")
    assert {(r.event_ref, r.reason) for r in drain(out).collect()} == want
    beat = op.heartbeats_stream(live, ["case_id"], "ts", "id", 500, ["count", "event_type"], "3 hours")
    running = beat.writeStream.format("memory").queryName("beats_in_order").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = {(r.event_ref, r["count"], r.event_type) for r in spark.table("beats_in_order").collect()}
    assert got == {(r.id, r["count"], r.event_type) for r in op.heartbeats(table, ["case_id"], "ts", "id", 500).collect()}
    # left: the waiting row of the last key and its timer
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_stable_files_stream_takes_scans_in_order(spark, tmp_path):
    # (path, scan, size, mtime, second, file): the second scan comes last, the third is no repetition of the first
    rows = [("a", 1, 5, 1, 1000, 0), ("a", 3, 5, 1, 1200, 0), ("a", 2, 9, 1, 1100, 1), ("a", 4, 5, 1, 1300, 1), ("b", 2, 7, 7, 1100, 0), ("b", 1, 7, 7, 1000, 1),
            ("c.done", 2, 3, 3, 1100, 0), ("c.done", 1, 2, 2, 1000, 1), ("z", 1, 1, 1, 99_000, 2)]
    live = files_of(spark, tmp_path, [(*r[:4], r[4], r[5]) for r in rows], "path string, scan int, size_bytes int, mtime int, sec long")
    got = drain(op.stable_files_stream(live, "ts", delay="10 minutes")).collect()
    assert {(r.path, r.ready_scan, r.size_bytes) for r in got} == {("a", 4, 5), ("b", 2, 7), ("c.done", 1, 2)}
