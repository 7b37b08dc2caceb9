"""Typed catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: columns of the catalog tables
CATALOG = {
    "sources": "source_id string, stable_identity string, media_kind string, label string, size_bytes long,"
    " sector_size long, fingerprint_sha256 string, status string, created_at timestamp, updated_at timestamp",
    "scan_cases": "case_id string, source_id string, state string, policy_json string, created_at timestamp,"
    " updated_at timestamp",
    "volumes": "volume_id string, source_id string, parent_volume_id string, volume_kind string, ordinal long,"
    " offset_bytes long, length_bytes long, filesystem string, metadata_json string",
    "contents": "content_id string, source_id string, content_sha256 string, size_bytes long, storage_uri string,"
    " status string, created_at timestamp",
    "entries": "entry_id string, case_id string, volume_id string, content_id string, parent_entry_id string,"
    " entry_kind string, path_bytes binary, display_path string, name_bytes binary, size_bytes long,"
    " mtime timestamp, metadata_json string, discovered_at timestamp",
    "findings": "finding_id string, case_id string, entry_id string, content_id string, finding_type string,"
    " severity string, title string, summary string, status string, confidence double, created_at timestamp",
    "evidence": "evidence_id string, finding_id string, evidence_kind string, content_id string, data_json string,"
    " created_at timestamp",
    "jobs": "job_id string, case_id string, job_type string, state string, input_json string,"
    " idempotency_key string, attempts int, max_attempts int, lease_owner string, lease_expires_at timestamp,"
    " retry_after_at timestamp, error_json string, created_at timestamp, updated_at timestamp",
    "checkpoints": "checkpoint_id string, job_id string, case_id string, source_fingerprint string,"
    " medium_identity_json string, stage string, checkpoint_version int, tool_name string, tool_version string,"
    " cursor_json string, counters_json string, blob binary, integrity_sha256 string,"
    " supersedes_checkpoint_id string, superseded_by_checkpoint_id string, created_at timestamp",
    "source_devices": "device_id string, reader_id string, device_type string, transport string,"
    " kernel_name string, read_only_verified boolean, created_at timestamp, updated_at timestamp",
    "source_media": "media_id string, source_id string, reader_id string, medium_identity_json string,"
    " fingerprint_sha256 string, capacity_bytes long, geometry_json string, toc_sessions_json string,"
    " media_change_generation long, status string, inserted_at timestamp, replaced_at timestamp",
    "events": "event_id string, case_id string, sequence long, job_id string, event_type string,"
    " payload_json string, published_at timestamp, created_at timestamp",
    "review_actions": "review_action_id string, finding_id string, action string, actor string, note string,"
    " created_at timestamp",
    "artifacts": "artifact_id string, case_id string, content_id string, artifact_kind string,"
    " storage_uri string, size_bytes long, created_at timestamp",
    "derivatives": "derivative_id string, content_id string, derivative_kind string, storage_uri string,"
    " mime_type string, size_bytes long, created_at timestamp",
    "browser_artifacts": "browser_artifact_id string, case_id string, entry_id string, content_id string,"
    " profile_id string, artifact_kind string, browser_family string, raw_provenance_json string,"
    " artifact_json string, recovery_confidence double, first_observed_at timestamp, created_at timestamp",
    "exports": "export_id string, case_id string, destination_kind string, state string, manifest_json string,"
    " created_at timestamp, updated_at timestamp",
    "audit_references": "audit_reference_id string, case_id string, source_id string, audit_hash string,"
    " audit_uri string, created_at timestamp",
}
PARTITIONED = ("findings", "browser_artifacts", "events", "entries")


def catalog_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One catalog table with its fixed schema (no inference, no file listing for types)."""
    return spark.read.schema(CATALOG[name]).parquet(f"{root.rstrip('/')}/{name}")


def write_catalog(df: DataFrame, root: str, name: str, order: tuple[str, ...] = ()) -> None:
    """Write a catalog table: big tables by case, rows sorted so that paging predicates prune."""
    out = df.select(*[c.strip().split(" ")[0] for c in CATALOG[name].split(",")])
    if order:
        out = out.sortWithinPartitions(*order)
    writer = out.write.mode("overwrite")
    if name in PARTITIONED:
        writer = writer.partitionBy("case_id")
    writer.parquet(f"{root.rstrip('/')}/{name}")


def supplied_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Single-file table read with an explicit schema."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
