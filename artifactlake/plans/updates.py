"""Bindings of the set-based updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import JOB_TRANSITIONS
from ..operators import updates as op
from ..operators.filters import filter_findings
from ..registry import query
from .aggs import QUEUE
from .bindings import ctes, run_sql, view

VISITED = """SELECT 'prof-' || CAST(user_id AS STRING) AS profile_id, 'visit' AS artifact_kind,
    'e' || CAST(event_id AS STRING) AS artifact_id, props AS title FROM """
TABS = """SELECT 'conv-' || CAST(conv_id AS STRING) AS profile_id, 'session_tab' AS artifact_kind,
    'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS artifact_id, role AS container FROM """


@query(
    "m1_all_artifacts",
    f"""SELECT profile_id, artifact_kind, artifact_id, title, NULL AS container, NULL AS url FROM ({VISITED} events)
    UNION ALL SELECT profile_id, artifact_kind, artifact_id, NULL, container, NULL FROM ({TABS} conversations)
    UNION ALL SELECT 'pages', 'cache_entry', 'p' || page_id, NULL, NULL, url FROM pages""",
)
def m1(spark, sf):
    pages = run_sql(
        spark,
        sf,
        """SELECT 'pages' AS profile_id, 'cache_entry' AS artifact_kind,
             'p' || CAST(page_id AS STRING) AS artifact_id, url FROM {pages}""",
    )
    return op.all_artifacts(
        run_sql(spark, sf, VISITED + "{events}"), run_sql(spark, sf, TABS + "{conversations}"), pages
    )


PICKED = "severity = 'critical' AND title LIKE '%order 1%'"


def _review(spark, sf):
    findings = view(spark, sf, "findings")
    picked = filter_findings(findings, severity="critical", q="order 1", include_system_noise=True)
    return op.apply_review(findings, "dismiss", "ana", "review_1", selected=picked, note="bulk")


@query(
    "m2_apply_review",
    f"""WITH {ctes("findings")} SELECT finding_id, case_id, CASE WHEN severity = 'critical' AND
      lower(title) LIKE '%order 1%' THEN 'dismissed' ELSE status END AS status FROM findings""",
)
def m2(spark, sf):
    return _review(spark, sf)[0].select("finding_id", "case_id", "status")


@query(
    "m2_review_log",
    f"""WITH {ctes("findings")} SELECT 'review_1_' || finding_id AS review_action_id, 'review_1' AS group_id,
      finding_id, 'dismiss' AS action, 'ana' AS actor, 'bulk' AS operator_note, status AS previous_status,
      'dismissed' AS target_status, status <> 'dismissed' AS changed, FALSE AS undone
    FROM findings WHERE severity = 'critical' AND lower(title) LIKE '%order 1%'""",
)
def m2_log(spark, sf):
    return _review(spark, sf)[1]


@query(
    "m2_unknown_targets",
    """SELECT 'f' || lpad(CAST(c_custkey * 11 AS STRING), 12, '0') AS finding_id FROM customer
    WHERE c_custkey * 11 NOT IN (SELECT o_orderkey FROM orders)""",
)
def m2_unknown(spark, sf):
    ids = run_sql(
        spark, sf, "SELECT 'f' || lpad(CAST(c_custkey * 11 AS STRING), 12, '0') AS finding_id FROM {customer}"
    )
    return op.apply_review(view(spark, sf, "findings"), "restore", "ana", "r2", targets=ids)[2]


@query(
    "m3_undo_review",
    f"""WITH {ctes("findings")} SELECT finding_id, status FROM findings""",
)
def m3(spark, sf):
    changed, log, _ = _review(spark, sf)
    return op.undo_review(changed, log, "review_1", "ben")[0].select("finding_id", "status")


@query(
    "m4_mark_published",
    f"""WITH {ctes("event_log")} SELECT event_id, coalesce(published_at, CASE WHEN event_type = 'error'
      THEN TIMESTAMP '2024-03-01 00:00:00' END) AS published_at FROM event_log""",
)
def m4(spark, sf):
    events = view(spark, sf, "event_log")
    return op.mark_published(events, events.where("event_type = 'error'"), "2024-03-01 00:00:00").select(
        "event_id", "published_at"
    )


@query(
    "m5_compact",
    f"""WITH {ctes("event_log")}, gone AS (SELECT event_id FROM event_log WHERE published_at IS NOT NULL
      AND created_at < TIMESTAMP '2024-01-20' ORDER BY created_at, event_id LIMIT 1000)
    SELECT event_id, case_id FROM event_log WHERE event_id NOT IN (SELECT event_id FROM gone)""",
)
def m5(spark, sf):
    return op.compact(view(spark, sf, "event_log"), "2024-01-20 00:00:00", 1000).select(
        "event_id", "case_id"
    )


@query(
    "m5_compact_whole",
    f"""WITH {ctes("event_log")} SELECT event_id, case_id FROM event_log
      WHERE published_at IS NULL OR created_at >= TIMESTAMP '2024-01-20'""",
)
def m5_whole(spark, sf):
    return op.compact(view(spark, sf, "event_log"), "2024-01-20 00:00:00").select("event_id", "case_id")


@query(
    "m6_step_export_queue",
    f"""WITH q AS ({QUEUE} orders),
    f AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'A') AS rd, bool_or(l_linestatus = 'F' AND l_discount > 0.05) AS done,
      bool_or(l_tax > 0.07) AS gone FROM lineitem GROUP BY 1),
    j AS (SELECT q.*, coalesce(rd, FALSE) AS rd, coalesce(done, FALSE) AS done, coalesce(gone, FALSE) AS gone
      FROM q LEFT JOIN f ON f.id = q.export_item_id),
    s AS (SELECT *, CASE WHEN state NOT IN ('waiting', 'ready') THEN state WHEN gone THEN 'skipped'
        WHEN state = 'waiting' THEN CASE WHEN rd THEN 'ready' WHEN attempts + 1 > 5 THEN 'failed' ELSE 'waiting' END
        ELSE CASE WHEN done THEN 'exported' WHEN attempts >= 5 THEN 'failed' ELSE 'ready' END END AS after,
      CASE WHEN state NOT IN ('waiting', 'ready') OR gone THEN NULL
        WHEN state = 'waiting' AND NOT rd AND attempts + 1 <= 5 THEN least(2.0 * pow(2, attempts), 60)
        WHEN state = 'ready' AND NOT done AND attempts < 5 THEN least(2.0 * pow(2, attempts), 60) END AS delay,
      CASE WHEN state NOT IN ('waiting', 'ready') THEN error WHEN gone THEN NULL
        WHEN state = 'waiting' THEN CASE WHEN rd THEN NULL WHEN attempts + 1 > 5 THEN 'extraction_timeout' ELSE error END
        ELSE CASE WHEN done THEN NULL WHEN attempts >= 5 THEN 'export_failed' ELSE error END END AS err,
      CASE WHEN state NOT IN ('waiting', 'ready') OR gone THEN attempts WHEN state = 'waiting' THEN attempts + 1
        WHEN NOT done AND attempts < 5 THEN attempts + 1 ELSE attempts END AS tries FROM j),
    st AS (SELECT *, state IN ('waiting', 'ready') AND (gone OR after <> state OR delay IS NOT NULL
        OR err IS DISTINCT FROM error) AS stepped FROM s)
    SELECT export_item_id, state AS before, after AS state, CASE WHEN stepped THEN tries ELSE attempts END AS attempts,
      CASE WHEN stepped THEN err ELSE error END AS error,
      CASE WHEN stepped AND after <> 'exported' THEN NULL ELSE destination_path END AS destination_path,
      CASE WHEN stepped THEN after = 'exported' ELSE verified END AS verified, delay AS delay_seconds, stepped FROM st""",
)
def m6(spark, sf):
    def flags(cond: str):
        return run_sql(
            spark, sf, f"SELECT l_orderkey AS export_item_id, {cond} AS flag FROM {{lineitem}}"
        )

    return op.step_export_queue(
        run_sql(spark, sf, QUEUE + "{orders}"),
        flags("l_returnflag = 'A'"),
        flags("l_linestatus = 'F' AND l_discount > 0.05"),
        flags("l_tax > 0.07"),
    )


SUBS = """SELECT 'j' || lpad(CAST(event_id AS STRING), 8, '0') AS job_id, event_type AS job_type,
    user_id AS case_id, props AS input_json, ts AS at,
    'key-' || CAST(user_id AS STRING) || '-' || CAST(event_id % 7 AS STRING) AS idempotency_key FROM """
STORED = """SELECT 's' || CAST(c_custkey AS STRING) AS job_id, 'view' AS job_type, c_custkey AS case_id,
    '{"k": 1}' AS input_json, 'key-' || CAST(c_custkey AS STRING) || '-3' AS idempotency_key FROM """
OWNER_SQL = f"""s AS ({SUBS} events), x AS ({STORED} customer),
    o AS (SELECT idempotency_key, min(job_id) AS first_id FROM s GROUP BY 1),
    w AS (SELECT o.idempotency_key, coalesce(x.job_id, s.job_id) AS job_id, x.job_id IS NOT NULL AS already_stored,
      coalesce(x.input_json, s.input_json) AS input_json, coalesce(x.job_type, s.job_type) AS job_type,
      coalesce(x.case_id, s.case_id) AS case_id
      FROM o JOIN s ON s.job_id = o.first_id LEFT JOIN x ON x.idempotency_key = o.idempotency_key)"""


def _jobs(spark, sf):
    return op.idempotent_jobs(
        run_sql(spark, sf, SUBS + "{events}"), run_sql(spark, sf, STORED + "{customer}"), ["at", "job_id"]
    )


@query(
    "m7_accepted_jobs",
    f"WITH {OWNER_SQL} SELECT job_id, idempotency_key, already_stored, input_json FROM w",
)
def m7(spark, sf):
    return _jobs(spark, sf)[0]


@query(
    "m7_job_conflicts",
    f"""WITH {OWNER_SQL} SELECT s.job_id, s.idempotency_key, w.job_id AS owner_job_id FROM s
    JOIN w USING (idempotency_key) WHERE s.input_json <> w.input_json OR s.job_type <> w.job_type
      OR s.case_id <> w.case_id""",
)
def m7_conflicts(spark, sf):
    return _jobs(spark, sf)[1]


JOB_LOG = """SELECT user_id AS job_id, event_id AS seq, ts AS changed_at, 30 AS max_attempts,
    CASE event_type WHEN 'view' THEN 'leased' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'pending'
         WHEN 'purchase' THEN 'completed' ELSE 'running' END AS to_state,
    CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'permanent' WHEN 1 THEN 'transient'
         ELSE 'process-death' END END AS error_class FROM """


@query(
    "m8_job_states",
    f"""WITH l AS ({JOB_LOG} events), g AS (SELECT job_id, arg_max(to_state, seq) AS st,
      arg_max(struct_pack(e := error_class), seq).e AS er, max(changed_at) AS changed_at, count(*) FILTER (to_state = 'leased') AS attempts,
      max(max_attempts) AS ma FROM l GROUP BY job_id),
    r AS (SELECT *, er IS NOT NULL AND er IN ('transient', 'process-death') AND attempts < ma AS retryable FROM g),
    n AS (SELECT *, CASE WHEN retryable THEN 'retrying' WHEN er IS NOT NULL THEN 'failed' ELSE st END AS state FROM r)
    SELECT job_id, state, attempts, CASE WHEN retryable AND er = 'transient' THEN date_trunc('second', changed_at) +
        to_seconds(CAST(least(30 * pow(2, greatest(attempts, 1) - 1), 300) AS BIGINT)) END AS retry_after_at,
      retryable, state IN ('completed', 'completed-warning', 'failed', 'cancelled') AS closed FROM n""",
)
def m8(spark, sf):
    return op.job_states(run_sql(spark, sf, JOB_LOG + "{events}"))


PAIRS_SQL = ", ".join(f"('{a}>{b}')" for a, t in JOB_TRANSITIONS.items() for b in t)


@query(
    "w12_invalid_transitions",
    f"""WITH l AS ({JOB_LOG} events), p AS (SELECT *, lag(to_state) OVER (PARTITION BY job_id ORDER BY changed_at, seq)
      AS from_state FROM l), ok(m) AS (VALUES {PAIRS_SQL})
    SELECT job_id, seq, from_state, to_state, CASE WHEN from_state IN ('completed', 'failed', 'cancelled',
      'completed-warning') THEN 'terminal_state' ELSE 'invalid_transition' END AS reason
    FROM p WHERE from_state IS NOT NULL AND from_state || '>' || to_state NOT IN (SELECT m FROM ok)""",
)
def w12(spark, sf):
    bad = op.job_transition_checks(
        run_sql(spark, sf, JOB_LOG + "{events}"), ["job_id"], ["changed_at", "seq"]
    )
    return bad.select("job_id", "seq", "from_state", "to_state", "reason")


@query(
    "c31_retry_delay",
    """SELECT DISTINCT l_linenumber AS attempt, least(30 * pow(2, l_linenumber - 1), 300) AS job_delay,
      least(2 * pow(2, l_linenumber - 1), 60) AS queue_delay, 0.25 * pow(2, l_linenumber - 1) AS read_delay
    FROM lineitem""",
)
def c31(spark, sf):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").alias("attempt")).distinct()
    return n.select(
        "attempt",
        op.retry_delay("attempt", 30.0, 300.0).alias("job_delay"),
        op.retry_delay("attempt", 2.0, 60.0).alias("queue_delay"),
        op.retry_delay("attempt", 0.25).alias("read_delay"),
    )
