"""Objects, message lines and tool listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouped import keep_where


def load_objects(spark: SparkSession, glob: str, sample_limit: int | None = None) -> DataFrame:
    """path, size, mtime and content of every object below ``glob``, or its first ``sample_limit`` bytes."""
    sample = F.col("content") if sample_limit is None else F.substring("content", 1, sample_limit)
    files = spark.read.format("binaryFile").load(glob)
    return files.select(
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        sample.alias("sample"),
    )


# fixed values: message types with the payload fields they need, and the limits of a line
MESSAGE_FIELDS = {
    "hello": ("worker_id", "scanner_version"),
    "capabilities": ("capabilities",),
    "stage_start": ("stage", "idempotency_key"),
    "finding_batch": ("stage", "batch_id", "findings"),
    "progress": ("stage", "completed", "total"),
    "checkpoint": ("stage", "checkpoint_id"),
    "warning": ("stage", "code", "message"),
    "error": ("stage", "code", "message", "retryable"),
    "pause_ack": ("stage", "reason"),
    "complete": ("stage", "status"),
}
MAX_LINE_BYTES = 16_384
MAX_FIELD_CHARS = 4_096
MAX_BATCH_FINDINGS = 256


def _line_problem(raw: Column, doc: Column, body: Column) -> Column:
    text = raw.cast("string")
    kind = F.try_variant_get(doc, "$.type", "string")
    kind_of = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    payload = F.try_variant_get(doc, "$.payload", "map<string,variant>")
    needed = F.element_at(
        F.create_map(
            *[
                x
                for name, fields in MESSAGE_FIELDS.items()
                for x in (F.lit(name), F.array(*[F.lit(f) for f in fields]))
            ]
        ),
        kind,
    )
    # escapes count as one character; doubled backslashes are taken out before control marks are sought
    bare = F.regexp_replace(body, r"\\\\", "__")
    flat = F.regexp_replace(bare, r'\\u[0-9a-fA-F]{4}|\\.', "_")
    findings = F.try_variant_get(doc, "$.payload.findings", "array<variant>")
    return (
        F.when(~F.endswith(raw, F.lit("\n").cast("binary")), "truncated")
        .when(F.octet_length(raw) > MAX_LINE_BYTES, "oversized")
        .when(~F.is_valid_utf8(text), "invalid_utf8")
        .when(doc.isNull(), "invalid_json")
        .when(~F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), "not_an_object")
        .when(
            ~F.coalesce(
                (kind_of("$.protocol_version") == "BIGINT")
                & (F.try_variant_get(doc, "$.protocol_version", "int") == 1),
                F.lit(False),
            ),
            "unsupported_version",
        )
        .when(~F.coalesce(kind.isin(*MESSAGE_FIELDS), F.lit(False)), "unknown_type")
        .when(
            ~F.coalesce(
                (kind_of("$.sequence") == "BIGINT") & (F.try_variant_get(doc, "$.sequence", "long") >= 0),
                F.lit(False),
            ),
            "invalid_sequence",
        )
        .when(payload.isNull(), "invalid_payload")
        .when(F.size(F.array_except(needed, F.map_keys(payload))) > 0, "missing_fields")
        .when(flat.rlike(f'"[^"]{{{MAX_FIELD_CHARS + 1},}}"'), "field_too_long")
        .when(bare.rlike(r"\\n|\\r|\\u0000"), "control_characters")
        .when(
            (kind == "finding_batch") & (findings.isNull() | (F.size(findings) > MAX_BATCH_FINDINGS)),
            "invalid_batch",
        )
    )


def read_messages(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects with reason)`` of JSON message lines (binary, newline included).

    Works on batch and streaming frames alike. ``replay_key`` parts are lifted out for dedupe.
    """
    text = F.col(col).cast("string")
    # parsed once per line: the later steps only read the parsed value
    parsed = lines.withColumn("__doc", F.try_parse_json(text)).withColumn(
        "__body", F.to_json(F.try_variant_get("__doc", "$.payload", "variant"))
    )
    problem = _line_problem(F.col(col), F.col("__doc"), F.col("__body"))
    judged = parsed.withColumn("reason", problem).drop("__doc", "__body")
    valid = keep_where(judged, F.col("reason").isNull()).drop("reason")
    valid = valid.select(
        *lines.columns,
        F.get_json_object(text, "$.type").alias("type"),
        F.get_json_object(text, "$.sequence").cast("long").alias("sequence"),
        F.get_json_object(text, "$.payload").alias("payload"),
    )
    return valid, keep_where(judged, F.col("reason").isNotNull())


_LISTING = r"^([drlv-])/([*\-])\s+(\d+(?:-\d+)*)\s*:\s*(.*)$"


def parse_inventory_lines(lines: DataFrame, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """``(entries, unparsed lines)`` of a filesystem listing; ``volume_id`` and ``ord`` pass through."""
    line = F.trim(F.col(col))
    filled = lines.where(line != "")
    part = lambda i: F.regexp_extract(line, _LISTING, i)
    clean = F.regexp_replace(F.trim(F.replace(part(4), F.lit("\\"), F.lit("/"))), "^/+|/+$", "")
    kind = part(1)
    entries = filled.where(line.rlike(_LISTING)).select(
        *[c for c in lines.columns if c != col],
        part(3).alias("object_id"),
        F.when(clean == "", ".").otherwise(clean).alias("path"),
        F.when(kind == "d", "directory")
        .when(kind == "r", "file")
        .when(kind == "l", "symlink")
        .when(kind == "v", "virtual")
        .otherwise("unknown")
        .alias("entry_type"),
        (part(2) == "-").alias("allocated"),
    )
    return entries, filled.where(~line.rlike(_LISTING)).withColumn("warning", F.lit("unparsed_line"))


_PARTITION = r"^\s*(\d{3}:)\s+(Meta|-----)\s+(\d+)\s+(\d+)\s+(\d+)\s+(.+?)\s*$"


def parse_partition_lines(lines: DataFrame, sector_size: int, col: str = "line") -> DataFrame:
    """Partition rows of a partition listing (other lines carry no partition)."""
    part = lambda i: F.regexp_extract(F.col(col), _PARTITION, i)
    start, end, count = (part(i).try_cast("long") for i in (3, 4, 5))
    label = part(6)
    table = F.contains(label, F.lit("Primary Table")) | F.contains(label, F.lit("Unallocated"))
    return lines.where(F.col(col).rlike(_PARTITION)).select(
        *[c for c in lines.columns if c != col],
        part(1).alias("slot"),
        start.alias("start"),
        end.alias("end"),
        count.alias("sector_count"),
        (start * sector_size).alias("offset_bytes"),
        (count * sector_size).alias("length_bytes"),
        label.alias("description"),
        ((part(2) == "Meta") & ~table).alias("allocated"),
        (count != F.greatest(F.lit(0), end - start + 1)).alias("length_mismatch"),
    )
