"""Bindings of the filters."""

from __future__ import annotations

from ..operators import filters as op
from ..operators import joins
from ..registry import query
from .bindings import ctes, view

ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

NOISY = """noisy AS (
  SELECT DISTINCT finding_id FROM evidence WHERE evidence_kind = 'metadata'
    AND json_type(data_json, '$.system_noise') <> 'VARCHAR'
    AND json_extract_string(data_json, '$.system_noise') IN ('true', '1', '1.0'))"""

FINDING_COLS = "finding_id, case_id, finding_type, severity, title, status, created_at"


@query(
    "f1_filter_findings",
    f"""WITH {ctes("findings", "evidence")}, {NOISY}
    SELECT {FINDING_COLS} FROM findings f
    WHERE severity = 'high' AND status = 'new' AND translate(title, {ASCII}) LIKE '%order 1%'
      AND NOT EXISTS (SELECT 1 FROM noisy n WHERE n.finding_id = f.finding_id)""",
)
def f1(spark, sf):
    found = op.filter_findings(
        view(spark, sf, "findings"),
        severity="high",
        status="new",
        q="ORDER 1",
        evidence=view(spark, sf, "evidence"),
    )
    return found.select(*FINDING_COLS.split(", "))


@query(
    "f2_text_match",
    f"""SELECT doc_id, lang FROM documents
    WHERE contains(translate(text, {ASCII}), 'the ') OR contains(translate(source, {ASCII}), 'rc1')""",
)
def f2(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.where(op.text_match(["text", "source"], "THE ") | op.text_match(["source"], "rC1")).select(
        "doc_id", "lang"
    )


@query(
    "f3_filter_artifacts",
    f"""WITH {ctes("artifacts")}
    SELECT browser_artifact_id, artifact_kind, created_at FROM artifacts
    WHERE (json_extract_string(artifact_json, '$.url_normalization.registrable_domain') = 'd3.org'
        OR json_extract_string(artifact_json, '$.source_url_normalization.registrable_domain') = 'd3.org')
      AND coalesce(first_observed_at, created_at) >= TIMESTAMP '2024-01-03 00:00:00'
      AND coalesce(first_observed_at, created_at) <= TIMESTAMP '2024-01-25 00:00:00'
      AND (contains(translate(json_extract_string(artifact_json, '$.url'), {ASCII}), 'a_b')
        OR contains(translate(json_extract_string(artifact_json, '$.source_url'), {ASCII}), 'a_b')
        OR contains(translate(json_extract_string(artifact_json, '$.title'), {ASCII}), 'a_b')
        OR contains(translate(json_extract_string(artifact_json, '$.query'), {ASCII}), 'a_b'))""",
)
def f3(spark, sf):
    kept = op.filter_artifacts(
        view(spark, sf, "artifacts"),
        domain="d3.org",
        date_from="2024-01-03 00:00:00",
        date_to="2024-01-25 00:00:00",
        q="A_B",
    )
    return kept.select("browser_artifact_id", "artifact_kind", "created_at")


STATE = {
    "text": "  Report   1",
    "users": ["u1", "u2", "u3", "u4"],
    "date_from": "1996-01-01",
    "max_size": 40000,
    "allocations": ["allocated"],
    "encrypted": False,
    "min_interest": 5.0,
}
STATE_SQL = """contains(lower(coalesce(display_path, '') || ' ' || coalesce(display_name, '')), 'report 1')
      AND coalesce(owner_id, '') IN ('u1', 'u2', 'u3', 'u4') AND modified_at >= '1996-01-01'
      AND (size_bytes IS NULL OR size_bytes <= 40000) AND allocation = 'allocated'
      AND coalesce(encrypted, FALSE) = FALSE AND coalesce(interest_score >= 5.0, FALSE)
      AND coalesce(system_noise, '') NOT IN ('noise', 'system')
      AND coalesce(export_state, '') <> 'exported' AND NOT coalesce(dismissed, FALSE)"""


@query(
    "f4_apply_filter_state",
    f"""WITH {ctes("entry_rows")}
    SELECT entry_id, display_path, size_bytes FROM entry_rows WHERE {STATE_SQL}""",
)
def f4(spark, sf):
    rows = op.apply_filter_state(view(spark, sf, "entry_rows"), op.FilterState.of(STATE))
    return rows.select("entry_id", "display_path", "size_bytes")


@query(
    "f5_saved_view",
    f"""WITH {ctes("entry_rows")}
    SELECT entry_id, volume_id FROM entry_rows
    WHERE volume_id IN ('vol-1', 'vol-2') AND corrupt = FALSE
      AND (size_bytes IS NULL OR size_bytes >= 10000)""",
)
def f5(spark, sf):
    state = op.FilterState.of(
        {
            "volumes": ["vol-1", "vol-2"],
            "corrupt": False,
            "min_size": 10000,
            "include_noise": True,
            "include_exported": True,
            "include_dismissed": True,
        }
    )
    views = op.views_from_json(op.views_as_json(op.saved_view(spark, "v1", "large files", state)))
    rows = op.apply_filter_state(view(spark, sf, "entry_rows"), op.load_view(views, "v1"))
    return rows.select("entry_id", "volume_id")


@query(
    "f6_export_snapshot",
    f"""WITH {ctes("entry_rows")}
    SELECT entry_id AS export_item_id, sha256(entry_id) AS id_digest,
           'filter-state-v1' AS snapshot_version FROM entry_rows WHERE {STATE_SQL}""",
)
def f6(spark, sf):
    snap = op.export_snapshot(view(spark, sf, "entry_rows"), op.FilterState.of(STATE), "entry_id")
    return snap.drop("filter_state")


@query(
    "j1_exclude_noise",
    f"""WITH {ctes("findings", "evidence")}, {NOISY}
    SELECT f.finding_id, f.status FROM findings f
    WHERE NOT EXISTS (SELECT 1 FROM noisy n WHERE n.finding_id = f.finding_id)""",
)
def j1(spark, sf):
    return joins.exclude_noise(view(spark, sf, "findings"), view(spark, sf, "evidence")).select(
        "finding_id", "status"
    )
