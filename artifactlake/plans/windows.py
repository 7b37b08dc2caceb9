"""Bindings of the log and ordering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as op
from ..operators.paths import resolve_collisions
from ..registry import query
from .bindings import ctes, run_sql, table, view

HEADS = "SELECT c_custkey AS case_id, c_custkey % 40 AS head FROM "


@query(
    "w1_assign_sequences",
    f"""WITH {ctes("event_log")}, h AS ({HEADS} customer)
    SELECT event_id, e.case_id, row_number() OVER (PARTITION BY e.case_id ORDER BY created_at, event_id)
      + coalesce(head, 0) AS sequence FROM event_log e LEFT JOIN h ON h.case_id = e.case_id""",
)
def w1(spark, sf):
    heads = run_sql(spark, sf, HEADS + "{customer}")
    events, _ = op.assign_sequences(view(spark, sf, "event_log"), heads)
    return events.select("event_id", "case_id", "sequence")


@query(
    "w1_sequence_heads",
    f"""WITH h AS ({HEADS} customer), n AS (SELECT user_id AS case_id, count(*) AS c FROM events GROUP BY 1)
    SELECT coalesce(h.case_id, n.case_id) AS case_id, coalesce(head, 0) + coalesce(c, 0) AS head
    FROM h FULL JOIN n ON h.case_id = n.case_id""",
)
def w1_heads(spark, sf):
    heads = run_sql(spark, sf, HEADS + "{customer}")
    return op.assign_sequences(view(spark, sf, "event_log"), heads)[1]


@query(
    "w2_backfill_sequences",
    """SELECT event_id, row_number() OVER (PARTITION BY coalesce('c' || CASE WHEN user_id % 10 = 0 THEN NULL
      ELSE user_id END, 'e' || event_id) ORDER BY ts, event_id) AS sequence FROM events""",
)
def w2(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS case_id,
             ts AS created_at FROM {events}""",
    )
    return op.backfill_sequences(rows).select("event_id", "sequence")


# the hot-group way of the same operator: the limit is below every group's size, nothing is dropped
@query(
    "w2_backfill_sequences_split",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence
    FROM events""",
)
def w2_split(spark, sf):
    rows = run_sql(spark, sf, "SELECT event_id, user_id AS case_id, ts AS created_at FROM {events}")
    return op.backfill_sequences(rows, limit=10).select("event_id", "sequence")


CHECKPOINTS = """SELECT 'cp' || lpad(CAST(event_id AS STRING), 8, '0') AS checkpoint_id, user_id AS job_id,
    event_type AS stage, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS checkpoint_version,
    'fp' || CAST(user_id AS STRING) AS source_fingerprint, 'scan' AS tool_name,
    CASE WHEN event_id % 13 = 0 THEN '2' ELSE '1' END AS tool_version, props AS cursor_json,
    '{}' AS counters_json, event_id % 9 = 0 AS tampered, ts AS created_at,
    CASE WHEN event_id % 5 = 0 THEN 'x' END AS superseded_by_checkpoint_id FROM """


@query(
    "w3_latest_checkpoints",
    f"""WITH c AS ({CHECKPOINTS} events), n AS (SELECT job_id, stage, arg_max(checkpoint_id, created_at) AS id
      FROM c WHERE superseded_by_checkpoint_id IS NULL GROUP BY ALL)
    SELECT c.job_id, c.stage, c.checkpoint_id, CASE WHEN checkpoint_version <> 1 THEN 'unsupported_version'
      WHEN c.job_id % 8 = 0 THEN 'fingerprint_mismatch' WHEN tool_version <> '1' THEN 'tool_mismatch'
      WHEN tampered THEN 'integrity_mismatch' END AS reason, TRUE AS hashed
    FROM c JOIN n ON n.id = c.checkpoint_id""",
)
def w3(spark, sf):
    rows = run_sql(spark, sf, CHECKPOINTS + "{events}")
    rows = rows.withColumn("blob", F.col("cursor_json").cast("binary"))
    digest = op.integrity_digest()
    rows = rows.withColumn(
        "integrity_sha256", F.when(F.col("tampered"), F.reverse(digest)).otherwise(digest)
    )
    want = rows.groupBy("job_id").agg(
        F.concat(
            F.lit("fp"),
            F.when(F.col("job_id") % 8 == 0, F.lit("other")).otherwise(F.col("job_id").cast("string")),
        ).alias("source_fingerprint"),
        F.lit("scan").alias("tool_name"),
        F.lit("1").alias("tool_version"),
    )
    out = op.latest_checkpoints(rows, want)
    hashed = F.length("integrity_sha256") == 64
    return out.select("job_id", "stage", "checkpoint_id", "reason", hashed.alias("hashed"))


@query(
    "w4_supersede_chain",
    """SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def w4(spark, sf):
    out = op.supersede_chain(
        table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey"
    )
    return out.select("o_orderkey", "o_custkey", "supersedes", "superseded_by")


@query(
    "w4_supersede_chain_split",
    """SELECT o_orderkey, o_orderstatus, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""",
)
def w4_split(spark, sf):
    out = op.supersede_chain(
        table(spark, sf, "orders"),
        ["o_orderstatus"],
        ["o_orderdate", "o_orderkey"],
        "o_orderkey",
        limit=100,
    )
    return out.select("o_orderkey", "o_orderstatus", "supersedes", "superseded_by")


AUDIT = """SELECT user_id, event_type, props, event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM """


def audit_log(spark, sf):
    """Audit lines over the events: logs of four chained records, some edited, some cut.

    A chain is written record after record, so the chain is built inside the four records of a log.
    """
    rows = run_sql(spark, sf, "SELECT user_id AS case_id, event_type, props, event_id, ts AS created_at FROM {events}")
    numbered = op.backfill_sequences(rows).withColumn("n", F.col("sequence") - 1)
    logs = numbered.groupBy(
        F.concat_ws("-", "case_id", F.floor(F.col("n") / 4)).alias("log_id"), "case_id"
    ).agg(
        F.array_sort(
            F.collect_list(F.struct((F.col("n") % 4 + 1).alias("seq"), "event_type", "props"))
        ).alias("records")
    )
    head = """concat('{"event":"', r.event_type, '","payload":', r.props, ',"previous_hash":"', s.prev, '",')"""
    tail = """concat('"schema_version":1,"sequence":', r.seq, '}')"""
    digest = f"sha2(concat({head}, {tail}), 256)"
    chained = f"""aggregate(records,
        named_struct('prev', repeat('0', 64), 'lines', CAST(array() AS ARRAY<STRING>)),
        (s, r) -> named_struct('prev', {digest}, 'lines', array_append(s.lines,
          concat({head}, '"record_hash":"', {digest}, '",', {tail})))).lines"""
    lines = logs.select("log_id", "case_id", F.posexplode(F.expr(chained)).alias("i", "line"))
    # tampering: a changed payload, a removed line (later lines move up)
    edited = F.when(
        (F.col("case_id") % 5 == 0) & (F.col("i") == 1),
        F.regexp_replace("line", '"k": ', '"k": 9'),
    ).otherwise(F.col("line"))
    cut = (F.col("case_id") % 7 == 0) & (F.col("i") == 2)
    moved = F.when((F.col("case_id") % 7 == 0) & (F.col("i") > 2), F.col("i")).otherwise(F.col("i") + 1)
    return lines.where(~cut).select("log_id", moved.cast("long").alias("line_no"), edited.alias("line"))


CHAIN_SQL = f"""a AS ({AUDIT} events), l AS (SELECT user_id, CAST(user_id AS VARCHAR) || '-' || (n // 4) AS log_id,
      n % 4 AS i FROM a),
    c AS (SELECT log_id, CASE WHEN user_id % 7 = 0 AND i > 2 THEN i ELSE i + 1 END AS line_no,
      CASE WHEN user_id % 7 = 0 AND i > 2 THEN 'sequence_gap_or_reorder'
           WHEN user_id % 5 = 0 AND i = 1 THEN 'record_hash_mismatch' END AS problem
      FROM l WHERE NOT (user_id % 7 = 0 AND i = 2))"""


@query("w5_verify_chain", f"WITH {CHAIN_SQL} SELECT log_id, line_no, problem FROM c")
def w5(spark, sf):
    return op.verify_chain(audit_log(spark, sf))


@query(
    "w5_chain_verdict",
    f"""WITH {CHAIN_SQL} SELECT log_id, count(*) AS lines, min(line_no) FILTER (problem IS NOT NULL) AS first_bad_line,
      arg_min(problem, line_no) FILTER (problem IS NOT NULL) AS problem FROM c GROUP BY log_id""",
)
def w5_verdict(spark, sf):
    return op.chain_verdict(op.verify_chain(audit_log(spark, sf)))


@query(
    "w6_pick_canonical",
    """WITH m AS (SELECT doc_id, sha256(text) AS g, n_chars, source,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'prev' END AS pv, doc_id % 3 <> 0 AS hp FROM documents),
    r AS (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY NOT hp, -n_chars,
        CASE WHEN hp THEN 'p/' || source ELSE '' END, doc_id) AS a,
      row_number() OVER (PARTITION BY g ORDER BY pv IS NULL, -n_chars,
        CASE WHEN hp THEN 'p/' || source ELSE '' END, doc_id) AS b, count(*) OVER (PARTITION BY g) AS n FROM m)
    SELECT g, max(doc_id) FILTER (a = 1) AS canonical_id, max(doc_id) FILTER (b = 1) AS distance_ref_id,
      max(n) AS members FROM r GROUP BY g""",
)
def w6(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT doc_id AS finding_id, sha2(text, 256) AS g, n_chars AS size_bytes,
             CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'prev' END AS preview_uri,
             CASE WHEN doc_id % 3 <> 0 THEN array('z/' || source, 'p/' || source)
                  ELSE CAST(array() AS ARRAY<STRING>) END AS source_paths FROM {documents}""",
    )
    return op.pick_canonical(rows, "g")


RANGES_SPARK = """SELECT source_id, slot, allocated, start, start + o_custkey % 30 AS end,
    CASE WHEN slot % 20 = 0 THEN 5 ELSE o_custkey % 30 + 1 END AS sector_count FROM (
    SELECT o_custkey % 97 AS source_id, o_orderkey AS slot, o_orderstatus <> 'P' AS allocated, o_custkey,
      CAST(datediff(o_orderdate, DATE'1995-01-01') AS BIGINT) * 40 + o_custkey % 7 AS start FROM {orders})"""


@query(
    "w7_has_overlap",
    """WITH r0 AS (SELECT o_custkey % 97 AS source_id, o_orderkey AS slot, o_orderstatus <> 'P' AS allocated, o_custkey,
        date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 40 + o_custkey % 7 AS s FROM orders),
    r AS (SELECT *, s + o_custkey % 30 AS e, CASE WHEN slot % 20 = 0 THEN 5 ELSE o_custkey % 30 + 1 END AS n FROM r0),
    p AS (SELECT source_id, s, lag(e) OVER (PARTITION BY source_id ORDER BY s, e, slot) AS pe FROM r WHERE allocated)
    SELECT source_id, count(*) AS ranges, count(*) FILTER (n <> greatest(0, e - s + 1)) AS length_mismatches,
      coalesce((SELECT bool_or(p.s <= p.pe) FROM p WHERE p.source_id = r.source_id), FALSE) AS overlapping
    FROM r GROUP BY source_id""",
)
def w7(spark, sf):
    return op.has_overlap(run_sql(spark, sf, RANGES_SPARK))


@query(
    "w8_duplicate_siblings",
    """WITH e AS (SELECT page_id, split_part(url, '/', 3) AS parent, nullif(split_part(url, '/', 4), 'de') AS name FROM pages)
    SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY parent, name ORDER BY page_id) AS n FROM e)
    WHERE n > 1""",
)
def w8(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT page_id, page_id AS ord, split_part(url, '/', 3) AS parent_id,
             nullif(split_part(url, '/', 4), 'de') AS name FROM {pages}""",
    )
    return op.duplicate_siblings(rows).select("page_id")


NAMED = """SELECT p_partkey AS ord, p_name || CASE WHEN p_size % 10 = 0 THEN '__1' WHEN p_size % 10 = 1 THEN '__2'
    WHEN p_size % 10 = 2 THEN '__1__1' ELSE '' END AS path FROM """


@query(
    "w9_resolve_collisions",
    f"""WITH RECURSIVE i AS ({NAMED} part),
    fam AS (SELECT regexp_replace(path, '(__[0-9]+)+$', '') AS base, list(path ORDER BY ord) AS paths,
      list(ord ORDER BY ord) AS ords FROM i GROUP BY 1),
    r AS (SELECT base, paths, ords, 0 AS i, CAST([] AS VARCHAR[]) AS used, '' AS final FROM fam
      UNION ALL SELECT base, paths, ords, i + 1, list_append(used, f), f FROM (
        SELECT *, CASE WHEN NOT list_contains(used, paths[i + 1]) THEN paths[i + 1]
          ELSE paths[i + 1] || '__' || list_min(list_filter(range(1, i + 2), lambda k:
            NOT list_contains(used, paths[i + 1] || '__' || k))) END AS f FROM r WHERE i < len(paths)))
    SELECT ords[i] AS ord, paths[i] AS path, final FROM r WHERE i > 0""",
)
def w9(spark, sf):
    return resolve_collisions(run_sql(spark, sf, NAMED + "{part}"), "path", "ord")


@query(
    "w9_resolve_collisions_plain",
    """SELECT p_partkey AS ord, p_type || CASE WHEN row_number() OVER w = 1 THEN ''
      ELSE '__' || (row_number() OVER w - 1) END AS final FROM part
    WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)""",
)
def w9_plain(spark, sf):
    rows = run_sql(spark, sf, "SELECT p_partkey AS ord, p_type AS path FROM {part}")
    return resolve_collisions(rows, "path", "ord").select("ord", "final")


@query(
    "w10_schedule_cap",
    """WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 128)
    SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM e) AS schedule_scan FROM orders""",
)
def w10(spark, sf):
    out = op.schedule_cap(table(spark, sf, "orders"), F.col("o_orderstatus") == "P", "o_orderkey", n=128)
    return out.select("o_orderkey", "schedule_scan")


OBSERVED = """SELECT 'f' || CAST(user_id AS STRING) || CASE WHEN user_id % 25 = 0 THEN '.done' ELSE '' END AS path,
    max(event_id % 3) AS size_bytes, max(event_id % 2) AS mtime, {day} AS scan FROM {t} GROUP BY user_id, {day}"""


@query(
    "w11_stable_files",
    f"""WITH o AS ({OBSERVED.replace("{day}", "day(ts)").replace("{t}", "events")}),
    p AS (SELECT *, lag(size_bytes) OVER w AS ps, lag(mtime) OVER w AS pm, lag(scan) OVER w AS pn FROM o
      WINDOW w AS (PARTITION BY path ORDER BY scan)),
    r AS (SELECT path, scan, size_bytes FROM p WHERE path LIKE '%.done' OR (ps = size_bytes AND pm = mtime AND pn = scan - 1))
    SELECT path, min(scan) AS ready_scan, arg_min(size_bytes, scan) AS size_bytes FROM r
    WHERE path NOT IN (SELECT 'f' || c_custkey FROM customer WHERE c_nationkey = 4) GROUP BY path""",
)
def w11(spark, sf):
    seen = run_sql(
        spark, sf, "SELECT 'f' || CAST(c_custkey AS STRING) AS path FROM {customer} WHERE c_nationkey = 4"
    )
    sql = OBSERVED.replace("{day}", "day(ts)").replace("{t}", "{events}")
    return op.stable_files(run_sql(spark, sf, sql), seen)


MEDIA = """SELECT o_custkey AS reader_id, o_orderdate AS seen_at, o_orderkey AS n,
    'id' || CAST(o_orderkey % 3 AS STRING) AS identity_key, o_orderkey % 2 AS capacity_bytes,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'f' || CAST(o_orderkey % 4 AS STRING) END AS fingerprint,
    o_orderstatus AS toc_sessions, o_orderpriority AS geometry, o_orderkey % 5 AS generation FROM """


@query(
    "w13_resume_eligibility",
    f"""WITH m AS ({MEDIA} orders), p AS (SELECT *, lag(identity_key) OVER w AS pi, lag(capacity_bytes) OVER w AS pc,
      lag(fingerprint) OVER w AS pf, lag(toc_sessions) OVER w AS pt, lag(geometry) OVER w AS pg,
      lag(generation) OVER w AS pn, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY reader_id ORDER BY seen_at, n))
    SELECT reader_id, seen_at, n, rn > 1 AND pi = identity_key AS eligible,
      CASE WHEN rn = 1 THEN 'no_previous_medium' WHEN pi = identity_key THEN NULL
        WHEN pc <> capacity_bytes THEN 'capacity_changed'
        WHEN pf IS NULL OR fingerprint IS NULL THEN 'unreadable_sample_identity_weak'
        WHEN pf <> fingerprint THEN 'fingerprint_changed' WHEN pt <> toc_sessions THEN 'toc_sessions_changed'
        WHEN pg <> geometry THEN 'geometry_changed' WHEN pn <> generation THEN 'media_replaced'
        ELSE 'medium_identity_changed' END AS reason FROM p""",
)
def w13(spark, sf):
    return op.resume_eligibility(run_sql(spark, sf, MEDIA + "{orders}"), ["reader_id"], ["seen_at", "n"])
