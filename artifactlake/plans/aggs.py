"""Bindings of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import stage_weights
from ..operators import aggs as op
from ..operators.filters import FilterState
from ..registry import query
from .bindings import ctes, run_sql, view
from .filters import STATE, STATE_SQL
from .paging import PERCENT_SQL, STAGES_SQL, WEIGHTS_SQL, stages


@query(
    "a1_facets",
    f"""WITH {ctes("findings")}
    SELECT 'finding_type' AS facet, finding_type AS value, count(*) AS count FROM findings GROUP BY ALL
    UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY ALL
    UNION ALL SELECT 'status', status, count(*) FROM findings GROUP BY ALL
    UNION ALL SELECT 'content_id', content_id, count(*) FROM findings GROUP BY ALL""",
)
def a1(spark, sf):
    return op.facets(
        view(spark, sf, "findings"), ["finding_type", "severity", "status", "content_id"]
    )


@query(
    "a2_artifact_facets",
    f"""WITH {ctes("artifacts")}, d AS (SELECT coalesce(
        json_extract_string(artifact_json, '$.url_normalization.registrable_domain'),
        json_extract_string(artifact_json, '$.source_url_normalization.registrable_domain')) AS domain
        FROM artifacts)
    SELECT 'browser_family' AS facet, browser_family AS value, count(*) AS count FROM artifacts GROUP BY ALL
    UNION ALL SELECT 'profile_id', profile_id, count(*) FROM artifacts GROUP BY ALL
    UNION ALL SELECT 'artifact_kind', artifact_kind, count(*) FROM artifacts GROUP BY ALL
    UNION ALL SELECT 'domain', domain, count(*) FROM d
              WHERE domain IS NOT NULL AND domain <> '' GROUP BY ALL""",
)
def a2(spark, sf):
    return op.artifact_facets(view(spark, sf, "artifacts"))


def _facet_sql(facet: str, expr: str) -> str:
    return f"SELECT '{facet}' AS facet, {expr} AS value, count(*) AS count FROM kept GROUP BY ALL"


@query(
    "a3_facet_counts",
    f"""WITH {ctes("entry_rows")}, kept AS (SELECT * FROM entry_rows WHERE {STATE_SQL})
    {" UNION ALL ".join([
        _facet_sql("user", "coalesce(nullif(owner_id, ''), 'unknown')"),
        _facet_sql("volume", "coalesce(nullif(volume_id, ''), 'unknown')"),
        _facet_sql("category", "coalesce(nullif(category, ''), 'unknown')"),
        _facet_sql("allocation", "coalesce(nullif(allocation, ''), 'unknown')"),
        _facet_sql("encrypted", "CASE WHEN coalesce(encrypted, FALSE) THEN 'true' ELSE 'false' END"),
        _facet_sql("corrupt", "CASE WHEN coalesce(corrupt, FALSE) THEN 'true' ELSE 'false' END"),
        _facet_sql("duplicates", "CASE WHEN coalesce(duplicate, FALSE) THEN 'true' ELSE 'false' END"),
    ])}""",
)
def a3(spark, sf):
    return op.facet_counts(view(spark, sf, "entry_rows"), FilterState.of(STATE))


@query(
    "a4_summary",
    f"""WITH {ctes("artifacts")} SELECT count(*) AS total, min(first_observed_at) AS first_observed_at,
      max(first_observed_at) AS last_observed_at FROM artifacts""",
)
def a4(spark, sf):
    return op.summary(view(spark, sf, "artifacts"))


@query(
    "a5_daily_histogram",
    f"""WITH {ctes("artifacts")} SELECT strftime(coalesce(first_observed_at, created_at), '%Y-%m-%d') AS date,
      count(*) AS count FROM artifacts GROUP BY ALL""",
)
def a5(spark, sf):
    return op.daily_histogram(view(spark, sf, "artifacts"))


@query(
    "a9_usage_metrics",
    """WITH c AS (SELECT 'prov' || (l_suppkey % 5) || '/m' || l_linenumber AS key,
         CAST(l_quantity AS BIGINT) AS calls, l_partkey AS tokens_in, l_suppkey AS tokens_out,
         CAST(l_returnflag = 'A' AS BIGINT) AS cache_hits, CAST(l_linestatus = 'F' AS BIGINT) AS failures
       FROM lineitem)
    SELECT key, sum(calls)::BIGINT AS calls, sum(tokens_in)::BIGINT AS tokens_in,
      sum(tokens_out)::BIGINT AS tokens_out, sum(cache_hits)::BIGINT AS cache_hits,
      sum(failures)::BIGINT AS failures FROM c GROUP BY key
    UNION ALL SELECT 'total', sum(calls)::BIGINT, sum(tokens_in)::BIGINT, sum(tokens_out)::BIGINT,
      sum(cache_hits)::BIGINT, sum(failures)::BIGINT FROM c""",
)
def a9(spark, sf):
    calls = run_sql(
        spark,
        sf,
        """SELECT 'prov' || (l_suppkey % 5) AS provider, 'm' || l_linenumber AS model,
             CAST(l_quantity AS BIGINT) AS calls, l_partkey AS tokens_in, l_suppkey AS tokens_out,
             CAST(l_returnflag = 'A' AS BIGINT) AS cache_hits,
             CAST(l_linestatus = 'F' AS BIGINT) AS failures FROM {lineitem}""",
    )
    return op.usage_metrics(calls)


QUEUE = """SELECT o_orderkey AS export_item_id, o_orderkey % 8 AS attempts,
    CASE WHEN o_orderkey % 97 = 0 THEN 'lost' WHEN o_orderstatus = 'P' THEN 'waiting'
         WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderkey % 3 = 0 THEN 'exported'
         WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'skipped' END AS state,
    CASE WHEN o_orderkey % 5 = 0 THEN 'io_error' END AS error,
    'out/' || CAST(o_orderkey AS STRING) AS destination_path, FALSE AS verified FROM """


@query(
    "a10_completion_report",
    f"""WITH q AS ({QUEUE} orders)
    SELECT count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'exported') AS exported,
      count(*) FILTER (state = 'waiting') AS waiting, count(*) FILTER (state = 'failed') AS failed,
      count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'lost') AS unknown_state,
      count(*) FILTER (state <> 'lost') AS total FROM q""",
)
def a10(spark, sf):
    return op.completion_report(run_sql(spark, sf, QUEUE + "{orders}"))


@query(
    "a11_progress",
    f"WITH {STAGES_SQL}, {WEIGHTS_SQL}, {PERCENT_SQL} SELECT case_id, mode, percent FROM prog",
)
def a11(spark, sf):
    return op.progress(stages(spark, sf), stage_weights(spark), ["case_id"])


@query(
    "a11_stage_percent_eta",
    f"""WITH {STAGES_SQL} SELECT case_id, stage,
      CASE WHEN denominator > 0 THEN CAST(round_even(
        greatest(0.0, least(1.0, done / denominator)) * 100, 0) AS BIGINT) END AS percent,
      CASE WHEN coalesce(denominator, 0) = 0 OR done <= 0 THEN NULL WHEN denominator <= done THEN 0
        ELSE greatest(1, CAST(round_even((denominator - done) / (done / 600), 0) AS BIGINT)) END
        AS eta_seconds FROM stages""",
)
def a11_eta(spark, sf):
    df = stages(spark, sf).withColumn("elapsed_seconds", F.lit(600))
    return df.select(
        "case_id", "stage", op.stage_percent().alias("percent"), op.stage_eta().alias("eta_seconds")
    )


@query(
    "a12_completion_summary",
    """WITH s AS (SELECT o_custkey AS case_id, 'stage' || (o_orderkey % 7) AS stage,
        CASE WHEN o_orderkey % 23 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'skipped'
             ELSE 'completed' END AS status, o_totalprice > 480000 AS warning FROM orders)
    SELECT case_id,
      coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage) FILTER (status = 'failed'), '') AS failed_stages,
      coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage) FILTER (status = 'skipped'), '') AS skipped_stages,
      CASE WHEN bool_or(status = 'failed') THEN 'failed'
           WHEN bool_or(status = 'skipped') OR bool_or(warning) THEN 'completed-warning'
           ELSE 'completed' END AS state
    FROM s GROUP BY case_id""",
)
def a12(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT o_custkey AS case_id, 'stage' || (o_orderkey % 7) AS stage,
             CASE WHEN o_orderkey % 23 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'skipped'
                  ELSE 'completed' END AS status, o_totalprice > 480000 AS warning FROM {orders}""",
    )
    done = op.completion_summary(rows, ["case_id"])
    return done.select(
        "case_id",
        F.array_join("failed_stages", ",").alias("failed_stages"),
        F.array_join("skipped_stages", ",").alias("skipped_stages"),
        "state",
    )


@query(
    "a13_compare_parser_versions",
    """SELECT p_type AS kind, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS parser_versions,
      sum(p_size)::BIGINT AS total_entries, count(*) AS distinct_sources FROM part GROUP BY p_type""",
)
def a13(spark, sf):
    rows = run_sql(
        spark,
        sf,
        "SELECT p_type AS kind, p_brand AS parser_version, p_size AS entry_count FROM {part}",
    )
    return op.compare_parser_versions(rows).withColumn(
        "parser_versions", F.array_join("parser_versions", ",")
    )


@query(
    "a14_group_items",
    """SELECT coalesce(nullif(CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END, ''),
        'ungrouped') AS key, event_id AS entry_id,
      row_number() OVER (PARTITION BY coalesce(nullif(CASE WHEN event_id % 10 = 0 THEN ''
        ELSE strftime(ts, '%Y-%m-%d') END, ''), 'ungrouped') ORDER BY event_id) AS position
    FROM events""",
)
def a14(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT event_id AS entry_id, event_id AS ord, CASE WHEN event_id % 10 = 0 THEN ''
             ELSE date_format(ts, 'yyyy-MM-dd') END AS date FROM {events}""",
    )
    return op.group_items(rows, "date")


READS = """SELECT user_id AS range_id, 4096 AS requested, ts,
    CASE WHEN event_type = 'error' THEN 'eio' WHEN event_type = 'signup' THEN 'timeout'
         ELSE 'ok' END AS outcome,
    CASE WHEN event_type IN ('error', 'signup') THEN 0 WHEN event_type = 'view' THEN 512
         ELSE 4096 END AS received,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS attempt,
    CAST(CAST(ts AS DATE) AS STRING) AS day FROM """

READS_SQL = f"""r AS ({READS} events), c AS (
    SELECT range_id, day, count(*) AS attempted_reads,
      count(*) FILTER (outcome = 'ok' AND received = requested) AS successful_reads,
      count(*) FILTER (attempt > 1) AS retry_reads, count(*) FILTER (outcome = 'timeout') AS timeouts,
      count(*) FILTER (outcome = 'ok' AND received < requested) AS short_reads,
      coalesce(bool_or(outcome = 'ok' AND received = requested AND attempt > 1), FALSE) AS recovered,
      count(*) FILTER (outcome = 'ok' AND received = requested) = 0 AS gap,
      CASE WHEN count(*) FILTER (outcome = 'ok' AND received = requested) = 0 THEN
        arg_max(CASE WHEN outcome = 'ok' AND received < requested THEN 'short_read' ELSE outcome END,
                attempt) END AS gap_code,
      CASE WHEN count(*) FILTER (outcome = 'ok' AND received = requested) = 0 THEN max(requested)
           ELSE 0 END AS skipped_bytes
    FROM r GROUP BY ALL)"""


@query("a15_read_counters", f"WITH {READS_SQL} SELECT * FROM c")
def a15(spark, sf):
    return op.read_counters(run_sql(spark, sf, READS + "{events}"), ["range_id", "day"])


@query(
    "a15_read_verdict",
    f"""WITH {READS_SQL} SELECT sum(attempted_reads)::BIGINT AS attempted_reads,
      sum(successful_reads)::BIGINT AS successful_reads, sum(retry_reads)::BIGINT AS retry_reads,
      sum(timeouts)::BIGINT AS timeouts, sum(short_reads)::BIGINT AS short_reads,
      sum(skipped_bytes)::BIGINT AS skipped_bytes, count(*) FILTER (recovered) AS recovered_after_retry,
      count(*) FILTER (gap) AS failed_reads,
      CASE WHEN count(*) FILTER (gap) >= 16 THEN 'read error threshold reached'
           WHEN count(*) FILTER (gap) >= 1024 THEN 'maximum read error ranges reached' END AS pause_reason
    FROM c""",
)
def a15_verdict(spark, sf):
    counters = op.read_counters(run_sql(spark, sf, READS + "{events}"), ["range_id", "day"])
    return op.read_verdict(counters, 16, 1024)


LISTS = """SELECT source || '-' || CAST(n_chars % 40 AS STRING) AS name, lang AS language,
    doc_id % 3 <> 0 AS enabled, n_chars AS size_bytes, sha256(text) AS sha256,
    CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 9 = 0 THEN 'ftp://' || source
         ELSE 'HTTPS://' || source END AS source FROM """


@query(
    "a16_inventory_summary",
    f"""WITH l AS ({LISTS} documents), n AS (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM l),
    ok AS (SELECT * FROM n WHERE k = 1 AND source LIKE 'HTTPS:%')
    SELECT count(*) AS lists, count(*) FILTER (enabled) AS enabled,
      coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes, count(DISTINCT language) AS languages,
      (SELECT count(*) FROM n WHERE k > 1) AS duplicate_names,
      (SELECT count(*) FROM n WHERE k = 1 AND source NOT LIKE 'HTTPS:%') AS bad_sources FROM ok""",
)
def a16(spark, sf):
    rows = run_sql(spark, sf, LISTS.replace("sha256(text)", "sha2(text, 256)") + "{documents}")
    valid, rejects = op.inventory_checks(rows)
    counts = rejects.agg(
        F.count_if(F.col("reason") == "duplicate_dictionary").alias("duplicate_names"),
        F.count_if(F.col("reason") == "unsafe_source").alias("bad_sources"),
    )
    # two one-row reports side by side
    report = op.inventory_summary(valid).withColumn("one", F.lit(1))
    return report.join(counts.withColumn("one", F.lit(1)), "one").drop("one")


@query(
    "a17_identity_collisions",
    """SELECT 'id-' || (c_custkey % 1400) AS stable_identity, count(DISTINCT c_name) AS devices
    FROM customer GROUP BY 1 HAVING count(DISTINCT c_name) > 1""",
)
def a17(spark, sf):
    rows = run_sql(
        spark, sf, "SELECT 'id-' || (c_custkey % 1400) AS stable_identity, c_name FROM {customer}"
    )
    return op.identity_collisions(rows, "stable_identity", "c_name")


@query(
    "a20_coverage",
    """WITH want AS (SELECT DISTINCT CASE WHEN r_regionkey = 0 THEN 'click' WHEN r_regionkey = 1 THEN 'view'
        WHEN r_regionkey = 2 THEN 'share' WHEN r_regionkey = 3 THEN 'error' ELSE 'refund' END AS event_type
        FROM region), seen AS (SELECT DISTINCT event_type FROM events)
    SELECT 'missing' AS issue, event_type FROM want WHERE event_type NOT IN (SELECT event_type FROM seen)
    UNION ALL SELECT 'unexpected', event_type FROM seen
    WHERE event_type NOT IN (SELECT event_type FROM want)""",
)
def a20(spark, sf):
    want = run_sql(
        spark,
        sf,
        """SELECT CASE WHEN r_regionkey = 0 THEN 'click' WHEN r_regionkey = 1 THEN 'view'
             WHEN r_regionkey = 2 THEN 'share' WHEN r_regionkey = 3 THEN 'error' ELSE 'refund' END
             AS event_type FROM {region}""",
    )
    return op.coverage(spark.read.parquet(f"{sf}/events.parquet"), want, "event_type")
