"""Bindings of the paging operators. Every LIMIT here is the page size the operator is about."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paging as op
from ..operators.aggs import progress
from ..operators.filters import filter_artifacts, filter_findings
from ..operators.windows import backfill_sequences
from ..registry import query
from .bindings import ctes, view
from .filters import NOISY

MID = {"created_at": "1998-03-05 00:00:00", "finding_id": "f000000007000"}


@query(
    "k1_page_findings",
    f"""WITH {ctes("findings", "evidence")}, {NOISY}
    SELECT finding_id, status, created_at FROM findings f
    WHERE status = 'reviewed' AND NOT EXISTS (SELECT 1 FROM noisy n WHERE n.finding_id = f.finding_id)
      AND (created_at > TIMESTAMP '1998-03-05' OR
           (created_at = TIMESTAMP '1998-03-05' AND finding_id > 'f000000007000'))
    ORDER BY created_at, finding_id LIMIT 501""",
)
def k1(spark, sf):
    found = filter_findings(
        view(spark, sf, "findings"), status="reviewed", evidence=view(spark, sf, "evidence")
    )
    return op.page_findings(found, op.encode_cursor(MID), 501).select(
        "finding_id", "status", "created_at"
    )


@query(
    "k2_page",
    f"""WITH {ctes("table_rows")}
    SELECT entry_id, interest_score, path FROM table_rows
    WHERE interest_score > 905.3 OR (interest_score = 905.3 AND entry_id > 'e000000053')
    ORDER BY interest_score NULLS FIRST, entry_id LIMIT 100""",
)
def k2(spark, sf):
    cursor = op.encode_cursor({"sort": "interest_score", "key": "e000000053", "value": 905.3})
    return op.page(view(spark, sf, "table_rows"), "interest_score", cursor, 100).select(
        "entry_id", "interest_score", "path"
    )


@query(
    "k3_page_artifacts",
    f"""WITH {ctes("artifacts")}
    SELECT browser_artifact_id, created_at FROM artifacts
    WHERE browser_family = 'firefox' AND artifact_kind = 'visit'
      AND created_at > TIMESTAMP '2024-01-10 00:00:00'
    ORDER BY created_at, browser_artifact_id LIMIT 201""",
)
def k3(spark, sf):
    kept = filter_artifacts(
        view(spark, sf, "artifacts"), browser_family="firefox", artifact_kind="visit"
    )
    cursor = op.encode_cursor({"created_at": "2024-01-10 00:00:00", "browser_artifact_id": "z"})
    return op.page_artifacts(kept, cursor, 201).select("browser_artifact_id", "created_at")


SEQUENCED = f"""{ctes("event_log")}, seqd AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at, event_id) AS sequence
  FROM event_log)"""


def sequenced(spark, sf):
    return backfill_sequences(view(spark, sf, "event_log"))


@query(
    "k4_events_after",
    f"""WITH {SEQUENCED}
    SELECT event_id, case_id, sequence, event_type FROM seqd
    WHERE case_id = 8 AND sequence > 10 ORDER BY sequence LIMIT 50""",
)
def k4(spark, sf):
    return op.events_after(sequenced(spark, sf), 8, 10, 50).select(
        "event_id", "case_id", "sequence", "event_type"
    )


@query(
    "k5_compaction_candidates",
    f"""WITH {ctes("event_log")}
    SELECT event_id, case_id FROM event_log
    WHERE published_at IS NOT NULL AND created_at < TIMESTAMP '2024-01-20 00:00:00'
    ORDER BY created_at, event_id LIMIT 1000""",
)
def k5(spark, sf):
    return op.compaction_candidates(view(spark, sf, "event_log"), "2024-01-20 00:00:00", 1000).select(
        "event_id", "case_id"
    )


STAGES_SQL = """stages AS (
  SELECT user_id AS case_id,
         CASE event_type WHEN 'signup' THEN 'validation' WHEN 'view' THEN 'volumes'
              WHEN 'click' THEN 'enumeration' WHEN 'purchase' THEN 'artifacts'
              ELSE 'carving' END AS stage,
         count(*) AS done, CASE WHEN user_id % 9 = 0 AND event_type = 'error' THEN NULL
                                ELSE CAST(count(*) * 2 + user_id % 5 AS BIGINT) END AS denominator
  FROM events GROUP BY user_id, event_type)"""
WEIGHTS_SQL = """weights(stage, weight) AS (VALUES ('validation', 0.05::DOUBLE), ('volumes', 0.10),
  ('enumeration', 0.30), ('artifacts', 0.15), ('enrichment', 0.15), ('carving', 0.20),
  ('finalization', 0.05))"""


def stages(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.col("event_type")
    stage = (
        F.when(kind == "signup", "validation")
        .when(kind == "view", "volumes")
        .when(kind == "click", "enumeration")
        .when(kind == "purchase", "artifacts")
        .otherwise("carving")
    )
    grouped = events.groupBy(F.col("user_id").alias("case_id"), kind, stage.alias("stage")).agg(
        F.count(F.lit(1)).alias("done")
    )
    blind = (F.col("case_id") % 9 == 0) & (kind == "error")
    return grouped.select(
        "case_id",
        "stage",
        "done",
        F.when(~blind, F.col("done") * 2 + F.col("case_id") % 5).alias("denominator"),
        F.when((F.col("case_id") % 4 == 0) & (kind == "signup"), "completed")
        .otherwise("running")
        .alias("status"),
    )


PERCENT_SQL = """pct AS (
  SELECT s.case_id,
    CASE WHEN s.case_id % 4 = 0 AND s.stage = 'validation' THEN 1.0
         WHEN coalesce(denominator, 0) = 0 THEN NULL
         ELSE round_even(100.0 * greatest(0.0, least(1.0, done / denominator)), 0) / 100.0 END AS share,
    weight FROM stages s JOIN weights w ON s.stage = w.stage),
  prog AS (
  SELECT case_id, CASE WHEN bool_or(share IS NULL) THEN 'activity_only' ELSE 'weighted' END AS mode,
    CASE WHEN bool_or(share IS NULL) THEN NULL ELSE
      CAST(round_even(round(sum(weight * share) / sum(weight) * 100, 9), 0) AS BIGINT) END AS percent
  FROM pct GROUP BY case_id)"""


@query(
    "k6_live_samples",
    f"""WITH {STAGES_SQL}, {WEIGHTS_SQL}, {PERCENT_SQL}, ranked AS (
      SELECT user_id AS case_id, event_id, event_type,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events)
    SELECT r.case_id, r.position, r.event_id, r.event_type, p.mode, p.percent
    FROM ranked r JOIN prog p ON p.case_id = r.case_id WHERE r.position <= 5""",
)
def k6(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("user_id", "case_id")
    sample = op.live_samples(events, ["case_id"], ["ts", "event_id"], 5)
    from ..functions.rules import stage_weights

    overall = progress(stages(spark, sf), stage_weights(spark), ["case_id"])
    return sample.join(overall, "case_id").select(
        "case_id", "position", "event_id", "event_type", "mode", "percent"
    )


@query(
    "k7_gallery_page",
    f"""WITH {ctes("table_rows")}, dup AS (SELECT DISTINCT entry_id FROM table_rows WHERE size_bytes > 30),
    pg AS (SELECT * FROM table_rows ORDER BY path, entry_id LIMIT 60)
    SELECT pg.entry_id, nullif(thumbnail_ref, '') AS thumbnail_ref, 300 AS placeholder_width,
      CASE WHEN nullif(thumbnail_ref, '') IS NULL THEN 225 ELSE greatest(1, CAST(round_even(300.0 /
        CASE WHEN thumb_width > 0 AND thumb_height > 0 THEN thumb_width / thumb_height
             ELSE 4.0 / 3.0 END, 0) AS INT)) END AS placeholder_height,
      nullif(thumbnail_ref, '') IS NULL AS missing_thumbnail,
      dup.entry_id IS NOT NULL AS duplicate, 'media finding ' || pg.entry_id AS aria_label
    FROM pg LEFT JOIN dup ON dup.entry_id = pg.entry_id""",
)
def k7(spark, sf):
    rows = view(spark, sf, "table_rows")
    return op.gallery_page(rows, rows.where("size_bytes > 30"), limit=60)


@query(
    "c32_table_columns",
    f"""WITH {ctes("table_rows")}
    SELECT path, entry_type AS type, size_bytes, modified_at, state, interest_score, confidence,
      category, export_state AS export, 'http://ui/case/' || case_id || '/finding/' || entry_id
        AS detail_link FROM table_rows""",
)
def c32(spark, sf):
    return op.table_columns(view(spark, sf, "table_rows"), "http://ui")


@query(
    "c32_gallery_columns",
    f"""WITH {ctes("table_rows")}
    SELECT entry_id, nullif(thumbnail_ref, '') AS thumbnail_ref, 300 AS placeholder_width,
      CASE WHEN nullif(thumbnail_ref, '') IS NULL THEN 225 ELSE greatest(1, CAST(round_even(300.0 /
        CASE WHEN thumb_width > 0 AND thumb_height > 0 THEN thumb_width / thumb_height
             ELSE 4.0 / 3.0 END, 0) AS INT)) END AS placeholder_height,
      nullif(thumbnail_ref, '') IS NULL AS missing_thumbnail, size_bytes > 30 IS TRUE AS duplicate,
      'media finding ' || entry_id AS aria_label FROM table_rows""",
)
def c32_gallery(spark, sf):
    rows = view(spark, sf, "table_rows")
    return op.gallery_columns(rows.withColumn("duplicate", F.col("size_bytes") > 30))
