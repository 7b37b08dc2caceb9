"""Contract checks and normalization of parser result rows.

Nothing is dropped silently: a row, member or field that breaks its contract comes back as a reject
or as a warning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redact import redact_secrets
from ..functions.rules import (
    ACCESS_KEYS,
    COMMON_FIELDS,
    KIND_FIELDS,
    OUTPUT_SECRET_PATTERNS,
    PROVENANCE_FIELDS,
    REDACTED,
    TOKEN_WORDS,
    lookup,
)
from ..functions.text import present
from .grouped import keep_where


def _none() -> Column:
    return F.array().cast("array<string>")


def _prefixed(prefix: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(prefix), x))


# --------------------------------------------------------------------------- artifact contract


def validate_artifacts(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)`` of artifact records in JSON; both keep a ``warnings`` array."""
    work = df.withColumn("__f", F.try_variant_get(F.try_parse_json(F.col(json_col)), "$", "map<string,variant>"))
    work = work.withColumn("__k", F.array_sort(F.map_keys("__f"))).withColumn(
        "__kind", F.get_json_object(json_col, "$.artifact_kind")
    )
    keys, kind = F.col("__k"), F.col("__kind")
    required = F.element_at(
        F.create_map(
            *[
                x
                for name, own in KIND_FIELDS.items()
                for x in (F.lit(name), F.array(*[F.lit(f) for f in (*COMMON_FIELDS, *own)]))
            ]
        ),
        kind,
    )
    tokens = F.array(*[F.lit(t) for t in sorted(TOKEN_WORDS)])

    def fields_of(value: Column) -> Column:
        return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))

    def time_notes(key: Column) -> Column:
        inner = fields_of(F.element_at("__f", key))
        plain = inner.isNull()
        raw = F.array_contains(inner, "raw_value") | F.array_contains(inner, "raw_epoch")
        return F.array_compact(
            F.array(
                F.when(plain, F.concat(F.lit("invalid_timestamp:"), key)),
                F.when(~plain & ~raw, F.concat(F.lit("missing_raw_timestamp:"), key)),
                F.when(
                    ~plain & ~F.array_contains(inner, "normalized_utc"),
                    F.concat(F.lit("missing_normalized_timestamp:"), key),
                ),
                F.when(
                    ~plain & ~F.array_contains(inner, "display_timezone"),
                    F.concat(F.lit("missing_display_timezone:"), key),
                ),
            )
        )

    times = F.filter(keys, lambda k: k.endswith("_time"))
    inner = fields_of(F.element_at("__f", F.lit("raw_provenance")))
    wanted = F.array(*[F.lit(f) for f in PROVENANCE_FIELDS])
    provenance = F.when(inner.isNull(), F.array(F.lit("invalid_raw_provenance"))).otherwise(
        _prefixed("missing_provenance:", F.array_except(wanted, inner))
    )
    value = F.element_at("__f", F.lit("recovery_confidence"))
    number = F.try_variant_get(value, "$", "double")
    numeric = F.coalesce(F.schema_of_variant(value) != "STRING", F.lit(False))
    in_range = F.coalesce(numeric & (number >= 0) & (number <= 1), F.lit(False))
    known = F.coalesce(kind.isin(*KIND_FIELDS), F.lit(False))
    warnings = F.when(~known, F.array(F.lit("unknown_artifact_kind"))).otherwise(
        F.concat(
            _prefixed("missing:", F.array_except(required, keys)),
            _prefixed("forbidden_token_field:", F.array_intersect(tokens, keys)),
            F.flatten(F.transform(times, time_notes)),
            provenance,
            F.when(~in_range, F.array(F.lit("invalid_recovery_confidence"))).otherwise(_none()),
        )
    )
    judged = work.withColumn("warnings", warnings).drop("__f", "__k", "__kind")
    return keep_where(judged, F.size("warnings") == 0), keep_where(judged, F.size("warnings") > 0)


# --------------------------------------------------------------------------- archives and parsers


def archive_members(
    df: DataFrame, id_col: str, members: str = "members", max_members: int | None = None, max_ratio: float = 100.0
) -> tuple[DataFrame, DataFrame]:
    """``(members, rejects)``: one row per archive member with its warnings and allowed flag.

    With ``max_members``, members past it are not lost: they are rejects like the invalid ones.
    """
    m = df.select(id_col, F.posexplode(members).alias("position", "m"))
    kind = F.coalesce(F.nullif(F.col("m.kind"), F.lit("")), F.lit("file"))
    valid = (
        (F.coalesce("m.path", F.lit("")) != "")
        & kind.isin("file", "directory", "symlink", "device")
        & F.coalesce(F.col("m.size_bytes") >= 0, F.lit(False))
    )
    reason = F.when(F.lit(False) if max_members is None else F.col("position") >= max_members, "archive_member_limit_applied").when(
        ~valid, "invalid_archive_member"
    )
    path = F.replace(F.col("m.path"), F.lit("\\"), F.lit("/"))
    unsafe = F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")
    packed = F.col("m.compressed_size_bytes")
    ratio = F.coalesce((packed > 0) & (F.col("m.size_bytes") / packed > max_ratio), F.lit(False))
    warnings = F.concat(
        F.coalesce("m.warnings", _none()),
        present(
            (unsafe, "unsafe_member_path"),
            (kind.isin("symlink", "device"), F.concat(F.lit("unsafe_member_kind:"), kind)),
            (ratio, "compression_ratio_limit"),
        ),
    )
    judged = m.withColumn("reason", reason)
    rows = judged.where("reason IS NULL").select(
        id_col,
        "position",
        F.col("m.path").alias("path"),
        kind.alias("kind"),
        F.col("m.size_bytes").alias("size_bytes"),
        F.coalesce("m.encrypted", F.lit(False)).alias("encrypted"),
        F.array_distinct(warnings).alias("warnings"),
    )
    allowed = (F.size("warnings") == 0) & ~F.col("encrypted")
    return rows.withColumn("allowed", allowed), judged.where("reason IS NOT NULL").select(
        id_col, "position", "reason"
    )


def _capped_text(max_chars: int | None) -> tuple[Column, Column]:
    text = F.coalesce("text", F.lit(""))
    if max_chars is None:
        return text, F.lit(False)
    return F.substring(text, 1, max_chars), F.length(text) > max_chars


def _unit(value: Column) -> Column:
    """A confidence in [0, 1], else NULL."""
    return F.when((value >= 0) & (value <= 1), value)


def normalize_regions(
    df: DataFrame, max_text_chars: int | None = None, max_regions: int | None = None, low: float = 0.55
) -> DataFrame:
    """Recognized pages: text, confidence and the regions that are complete and in range.

    ``max_text_chars`` None keeps whole texts. A region limit that was applied leaves a warning.
    """
    text, cut = _capped_text(max_text_chars)
    given = F.col("regions") if max_regions is None else F.slice("regions", 1, max_regions)

    def complete(r: Column) -> Column:
        box = reduce(lambda a, b: a & b, [F.coalesce(r["bbox"][k] > 0, F.lit(False)) for k in ("x", "y", "width", "height")])
        return (
            (F.coalesce(r["text"], F.lit("")) != "")
            & _unit(r["confidence"]).isNotNull()
            & F.coalesce(r["page_number"] > 0, F.lit(False))
            & box
        )

    confidence = _unit(F.col("mean_confidence"))
    limited = F.lit(False) if max_regions is None else F.coalesce(F.size("regions") > max_regions, F.lit(False))
    uri = F.col("derivative_uri")
    bad_uri = uri.isNotNull() & ~F.startswith(uri, F.lit("scratch://sha256/"))
    return df.select(
        *[c for c in df.columns if c not in ("text", "mean_confidence", "regions", "derivative_uri")],
        text.alias("text"),
        cut.alias("truncated"),
        confidence.alias("mean_confidence"),
        F.coalesce(F.filter(given, complete), F.filter(F.col("regions"), lambda r: F.lit(False))).alias("regions"),
        F.when(~bad_uri, uri).alias("derivative_uri"),
        present(
            (cut, "ocr_text_truncated"),
            (F.coalesce(confidence < low, F.lit(False)), "low_confidence_ocr"),
            (limited, "ocr_region_limit_applied"),
            (bad_uri, "invalid_ocr_derivative_storage"),
        ).alias("warnings"),
    )


def normalize_segments(
    df: DataFrame,
    languages: Sequence[str] = ("en", "es", "unknown"),
    max_text_chars: int | None = None,
    max_segments: int | None = None,
) -> DataFrame:
    """Transcripts: text, language, usable segments and the merged checkpoint map."""
    text, cut = _capped_text(max_text_chars)
    spoken = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("unknown"))
    known = spoken.isin(*languages)
    given = F.col("segments") if max_segments is None else F.slice("segments", 1, max_segments)

    def usable(s: Column) -> Column:
        order = (s["start_seconds"] >= 0) & (s["end_seconds"] >= s["start_seconds"])
        return F.coalesce(order, F.lit(False)) & (F.coalesce(s["text"], F.lit("")) != "")

    def clean(s: Column) -> Column:
        lang = F.coalesce(s["language"], F.lit("unknown"))
        return F.struct(
            s["start_seconds"].alias("start_seconds"),
            s["end_seconds"].alias("end_seconds"),
            s["text"].alias("text"),
            _unit(s["confidence"]).alias("confidence"),
            F.when(lang.isin(*languages), lang).otherwise("unknown").alias("language"),
        )

    fresh = F.map_filter("checkpoint", lambda k, v: k.isin("next_offset_seconds", "chunk_index", "complete"))
    older = F.map_filter("previous_checkpoint", lambda k, v: ~F.map_contains_key(F.coalesce(fresh, F.col("previous_checkpoint")), k) | fresh.isNull())
    limited = F.lit(False) if max_segments is None else F.coalesce(F.size("segments") > max_segments, F.lit(False))
    dropped = ("text", "language", "segments", "confidence", "checkpoint", "previous_checkpoint")
    return df.select(
        *[c for c in df.columns if c not in dropped],
        text.alias("text"),
        cut.alias("truncated"),
        F.when(known, spoken).otherwise("unknown").alias("language"),
        _unit(F.col("confidence")).alias("confidence"),
        F.transform(F.filter(given, usable), clean).alias("segments"),
        F.map_concat(older, F.coalesce(fresh, F.map_filter("previous_checkpoint", lambda k, v: F.lit(False)))).alias(
            "checkpoint"
        ),
        present(
            (cut, "transcript_truncated"),
            (~known, F.concat(F.lit("unsupported_detected_language:"), spoken)),
            (F.trim(text) == "", "silence_or_no_speech"),
            (limited, "transcript_segment_limit_applied"),
        ).alias("warnings"),
    )


def ordered_map(m: str | Column, fields: int | None = None) -> Column:
    """Pairs of a map in key order, keys and values whole; with ``fields`` only the first ones."""
    pairs = F.array_sort(F.map_entries(m))
    return F.map_from_entries(pairs if fields is None else F.slice(pairs, 1, fields))


def normalize_media(df: DataFrame, max_fields: int | None = None) -> DataFrame:
    """Media facts in range: dimensions, duration, place and metadata maps, whole unless ``max_fields`` is given."""
    lat, lon = F.col("latitude"), F.col("longitude")
    placed = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    dropped = ("width", "height", "duration_seconds", "latitude", "longitude", "device", "raw_metadata", "malformed")
    return df.select(
        *[c for c in df.columns if c not in dropped],
        F.when(F.col("width") > 0, F.col("width")).alias("width"),
        F.when(F.col("height") > 0, F.col("height")).alias("height"),
        F.when(F.col("duration_seconds") >= 0, F.col("duration_seconds")).alias("duration_seconds"),
        F.when(placed, lat).alias("latitude"),
        F.when(placed, lon).alias("longitude"),
        ordered_map("device").alias("device"),
        ordered_map("raw_metadata", max_fields).alias("raw_metadata"),
        present((F.coalesce("malformed", F.lit(False)), "malformed_media")).alias("warnings"),
    )


# fixed values: longest edge per thumbnail tier
TIERS = {"embedded": 256, "small": 512, "large": 1600}
THUMBNAIL_PARSER = "image-thumbnails-v1"


def accept_derivatives(
    df: DataFrame, objects: DataFrame, output_limit: int, tiers: dict[str, int] = TIERS, version: str = THUMBNAIL_PARSER
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, warnings)`` of thumbnail records: the first valid one per object and tier.

    Records of one ``ord`` follow each other by storage_uri, mime_type, width, height and size_bytes.

    ``df`` has (content_sha256, ord, tier, mime_type, width, height, size_bytes, storage_uri),
    ``objects`` the objects that should have every tier.
    """
    limit = lookup({k: str(v) for k, v in tiers.items()}, F.col("tier")).cast("int")
    sizes = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("size_bytes") > 0)
    problem = (
        F.when(~F.coalesce(F.col("mime_type").isin("image/webp", "image/png"), F.lit(False)), "unsafe_thumbnail_mime")
        .when(~F.coalesce(sizes, F.lit(False)), "invalid_thumbnail_dimensions")
        .when((F.col("width") > limit) | (F.col("height") > limit), "thumbnail_dimension_limit")
        .when(F.col("size_bytes") > output_limit, "thumbnail_output_limit")
        .when(
            ~F.startswith(F.coalesce("storage_uri", F.lit("")), F.lit("scratch://sha256/")),
            "invalid_thumbnail_storage",
        )
    )
    known = df.where(F.col("tier").isin(*tiers)).withColumn("__problem", problem)
    good = known.where("__problem IS NULL").drop("__problem")
    cols = [c for c in good.columns if c not in ("content_sha256", "tier")]
    rank = F.struct(F.col("ord").isNull(), "ord", "storage_uri", "mime_type", "width", "height", "size_bytes")
    # first by order, as an aggregate: one row per (object, tier) leaves each task
    accepted = (
        good.groupBy("content_sha256", "tier")
        .agg(F.min_by(F.struct(*cols), rank).alias("r"))
        .select("content_sha256", "tier", "r.*")
        .withColumn("cache_key", F.sha2(F.concat_ws("\0", F.lit(version), "content_sha256", "tier"), 256))
    )
    # once a tier is accepted, later records of it are not looked at
    first = accepted.select("content_sha256", "tier", F.col("ord").alias("__ok"))
    failed = (
        known.where("__problem IS NOT NULL")
        .join(first, ["content_sha256", "tier"], "left")
        .where(F.col("__ok").isNull() | (F.col("ord") < F.col("__ok")))
        .select("content_sha256", F.concat_ws(":", "__problem", "tier").alias("warning"))
    )
    wanted = objects.select("content_sha256").distinct().withColumn(
        "tier", F.explode(F.array(*[F.lit(t) for t in tiers]))
    )
    missing = wanted.join(first, ["content_sha256", "tier"], "left_anti").select(
        "content_sha256", F.concat(F.lit("missing_thumbnail_tier:"), "tier").alias("warning")
    )
    return accepted, failed.distinct().unionByName(missing)


# --------------------------------------------------------------------------- model outputs

# fixed values: output contract per task as (texts, arrays with their bound, choices, label field)
OUTPUT_TASKS: dict[str, dict] = {
    "classification": {"arrays": {"labels": 8}, "labels": "labels"},
    "tags": {"arrays": {"tags": 20}, "labels": "tags"},
    "summary": {"texts": ("summary",)},
    "relevance": {"texts": ("explanation",), "choices": {"relevance": ("high", "medium", "low", "none")}},
    "translation": {"texts": ("translation", "language")},
    "description": {"texts": ("description",), "choices": {"modality": ("image", "audio", "video")}},
    "artifact_hints": {"arrays": {"hints": 12, "artifact_kinds": 12}, "labels": "hints"},
}


def validate_model_output(df: DataFrame, json_col: str, task: str) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects with code)`` of model results for one task; the first broken rule names it.

    Valid rows carry the rounded confidence, the evidence references and the redacted text.
    """
    spec = OUTPUT_TASKS[task]
    arrays = {**spec.get("arrays", {}), "evidence": None}
    texts, choices = spec.get("texts", ()), spec.get("choices", {})
    fields = [*spec.get("arrays", {}), *texts, *choices, "confidence", "evidence"]
    doc = F.try_parse_json(F.col(json_col))
    work = df.withColumn("__d", doc).withColumn("__f", F.try_variant_get(F.col("__d"), "$", "map<string,variant>"))
    keys = F.map_keys("__f")

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.element_at("__f", F.lit(name))), F.lit("VOID"))

    def starts(name: str, prefix: str) -> Column:
        return F.startswith(kind(name), F.lit(prefix))

    def items(name: str) -> Column:
        return F.try_variant_get("__d", f"$.{name}", "array<string>")

    def either(conds: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, conds, F.lit(False))

    numeric = ~kind("confidence").isin("STRING", "VOID", "BOOLEAN") & ~starts("confidence", "ARRAY") & ~starts(
        "confidence", "OBJECT"
    )
    confidence = F.try_variant_get("__d", "$.confidence", "double")
    bad_field = either(
        [~numeric | (confidence < 0) | (confidence > 1)]
        + [~starts(a, "ARRAY") for a in arrays]
        + [F.coalesce(F.size(items(a)) > n, F.lit(False)) for a, n in arrays.items() if n]
        + [kind(t) != "STRING" for t in texts]
        + [~F.coalesce(F.try_variant_get("__d", f"$.{c}", "string").isin(*v), F.lit(False)) for c, v in choices.items()]
    )
    evidence = F.array_distinct(F.filter(items("evidence"), lambda e: e.rlike("^[a-z_]+:[0-9a-z_-]{6,}$")))
    code = (
        F.when(F.col("__d").isNull(), "malformed_json")
        .when(F.col("__f").isNull(), "malformed_output")
        .when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ACCESS_KEYS])), "provider_requested_access")
        .when(F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), keys)) > 0, "missing_field")
        .when(F.coalesce(bad_field, F.lit(True)), "invalid_field")
    )
    label = spec.get("labels")
    if label:
        bad = F.exists(items(label), lambda x: x.isNull() | (x == "") | (F.length(x) > 120))
        code = code.when(bad, "invalid_label").when(F.size(items(label)) == 0, "missing_labels")
    code = code.when(F.size(evidence) == 0, "missing_evidence")
    judged = work.withColumn("code", code)
    content = redact_secrets(
        keep_where(judged, F.col("code").isNull()).withColumn("__text", F.col(json_col)),
        "__text",
        OUTPUT_SECRET_PATTERNS,
        "content",
        "redactions",
    )
    valid = content.select(
        *df.columns,
        F.lit(task).alias("task"),
        F.bround(confidence, 4).alias("confidence"),
        evidence.alias("evidence"),
        "content",
        (F.size("redactions") > 0).alias("was_redacted"),
    )
    return valid, keep_where(judged, F.col("code").isNotNull()).select(*df.columns, "code")


# --------------------------------------------------------------------------- devices

# fixed values: attributes that point to a failing disk
FAILURE_ATTRIBUTES = {
    "Reallocated_Sector_Ct": "reallocated_sectors",
    "Current_Pending_Sector": "pending_sectors",
    "Offline_Uncorrectable": "uncorrectable_sectors",
}


def health_status(df: DataFrame) -> DataFrame:
    """Status and reasons of device health rows.

    Columns: passed (boolean), attributes (array of name and raw text), critical_warning (int),
    messages (array of text).
    """

    def raw(item: Column) -> Column:
        digits = F.regexp_replace(item["raw"], "[^0-9]", "")
        return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))

    hits = F.filter("attributes", lambda a: a["name"].isin(*FAILURE_ATTRIBUTES) & (raw(a) > 0))
    attribute = F.coalesce(F.size(hits) > 0, F.lit(False))
    nvme = F.coalesce(F.col("critical_warning") > 0, F.lit(False))
    limits = F.filter(
        F.transform("messages", lambda m: F.lower(m)),
        lambda m: F.contains(m, F.lit("unsupported"))
        | F.contains(m, F.lit("unknown usb bridge"))
        | F.contains(m, F.lit("unavailable")),
    )
    failed = F.coalesce(~F.col("passed"), F.lit(False))
    limited = F.coalesce(F.size(limits) > 0, F.lit(False))
    unknown = F.col("passed").isNull() & ~attribute & ~nvme
    status = (
        F.when(failed, "failed")
        .when(attribute | nvme, "warning")
        .when(F.col("passed"), "passed")
        .when(unknown & limited, "unavailable")
        .otherwise("unknown")
    )
    return (
        df.withColumn("status", status)
        .withColumn(
            "reasons",
            present(
                (failed, "smart_health_failed"),
                (~failed & attribute, "ata_attribute_warning"),
                (~failed & nvme, "nvme_critical_warning"),
                (unknown & limited, "bridge_or_device_limitation"),
            ),
        )
        .withColumn("acknowledgment_required", F.col("status").isin("failed", "warning"))
    )


SIGNALS = (
    "capacity_bytes",
    "geometry",
    "logical_block_size",
    "media_change_generation",
    "physical_block_size",
    "sampled_fingerprint_sha256",
    "toc_sessions",
)


def media_identity(df: DataFrame) -> DataFrame:
    """Identity key, plausibility and evidence warnings of medium rows.

    Needs reader_id, removable, device_type, identity_strength and the signal columns; geometry and
    toc_sessions are structs or arrays. The key hashes the canonical JSON with sorted fields.
    """
    fp = F.trim(F.col("sampled_fingerprint_sha256"))
    good = F.when(F.coalesce(fp.rlike("^[0-9a-f]{64}$"), F.lit(False)), fp)
    generation = F.when(F.col("media_change_generation") >= 0, F.col("media_change_generation")).otherwise(0)
    signals = F.struct(
        *[
            (
                good
                if s == "sampled_fingerprint_sha256"
                else generation
                if s == "media_change_generation"
                else F.col(s)
            ).alias(s)
            for s in SIGNALS
        ]
    )
    plausible = F.coalesce(F.col("capacity_bytes") > 0, F.lit(False)) | good.isNotNull()
    canonical = F.to_json(
        F.struct(signals.alias("medium_signals"), F.col("reader_id")), {"ignoreNullFields": "false"}
    )
    reader_ok = F.coalesce(F.startswith("reader_id", F.lit("reader_")), F.lit(False))
    strength_ok = F.coalesce(
        F.col("identity_strength").isin("by-id", "serial-facts", "weak-facts", "reader-plus-medium", "reader-facts"),
        F.lit(False),
    )
    shaped = F.col("device_type").isin("optical", "floppy")
    bare = F.col("toc_sessions").isNull() & F.col("geometry").isNull()
    removable = F.coalesce("removable", F.lit(False))
    return (
        df.withColumn("has_medium", plausible)
        .withColumn("identity_key", F.when(plausible & reader_ok & strength_ok, F.sha2(canonical, 256)))
        .withColumn(
            "warnings",
            present(
                (~reader_ok, "invalid_reader_id"),
                (~strength_ok, "unknown_identity_strength"),
                (removable & ~plausible, "no_medium_present"),
                (removable & good.isNull(), "missing_sampled_fingerprint"),
                (removable & shaped & bare, "missing_toc_or_geometry"),
            ),
        )
    )


# --------------------------------------------------------------------------- endpoints

# fixed values: address ranges that are not public, as (first, last, class, reason)
_RANGES = (
    ("127.0.0.0", "127.255.255.255", "local", "loopback"),
    ("0.0.0.0", "0.255.255.255", "lan", "private_or_link_local"),
    ("10.0.0.0", "10.255.255.255", "lan", "private_or_link_local"),
    ("169.254.0.0", "169.254.255.255", "lan", "private_or_link_local"),
    ("172.16.0.0", "172.31.255.255", "lan", "private_or_link_local"),
    ("192.0.2.0", "192.0.2.255", "lan", "private_or_link_local"),
    ("192.168.0.0", "192.168.255.255", "lan", "private_or_link_local"),
    ("198.18.0.0", "198.19.255.255", "lan", "private_or_link_local"),
    ("198.51.100.0", "198.51.100.255", "lan", "private_or_link_local"),
    ("203.0.113.0", "203.0.113.255", "lan", "private_or_link_local"),
    ("240.0.0.0", "255.255.255.255", "lan", "private_or_link_local"),
)
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata")


def _ip_number(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def classify_endpoint(endpoint: Column) -> Column:
    """Struct (host, endpoint_class, reason) of an endpoint URL or host."""
    rest = F.regexp_replace(endpoint, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", ""))
    ipv4 = host.rlike(r"^(\d{1,3})(\.\d{1,3}){3}$")
    parts = F.split(host, r"\.")
    number = reduce(lambda a, b: a * 256 + b, [F.element_at(parts, i).try_cast("long") for i in range(1, 5)])

    def of(cls: str, reason: str) -> Column:
        return F.struct(host.alias("host"), F.lit(cls).alias("endpoint_class"), F.lit(reason).alias("reason"))

    chain = (
        F.when(host.isin(*METADATA_HOSTS), of("remote", "cloud_metadata_endpoint"))
        .when((host == "localhost") | host.endswith(".localhost"), of("local", "localhost"))
        .when(host == "::1", of("local", "loopback"))
        .when(host.rlike("^(f[cd]|fe[89ab])[0-9a-f]*:"), of("lan", "private_or_link_local"))
    )
    for first, last, cls, reason in _RANGES:
        chain = chain.when(
            ipv4 & F.coalesce(number.between(_ip_number(first), _ip_number(last)), F.lit(False)), of(cls, reason)
        )
    return chain.when(ipv4 | F.contains(host, F.lit(":")), of("remote", "public_ip")).otherwise(
        of("remote", "unknown_public")
    )


def gate_requests(
    df: DataFrame,
    acknowledgments: DataFrame,
    deny: Sequence[str],
    allow: Sequence[str],
    max_payload_bytes: int,
) -> DataFrame:
    """Decision per request: endpoint class, deny reasons and the redirect check.

    ``df`` has provider, endpoint, final_endpoint (may be NULL), categories, payload_bytes;
    ``acknowledgments`` one row per provider.
    """
    acks = acknowledgments.select(
        "provider",
        "accepted_endpoint",
        F.col("endpoint_class").alias("ack_class"),
        F.col("state").alias("ack_state"),
    )
    work = (
        df.withColumn("__e", classify_endpoint(F.col("endpoint")))
        .withColumn("__r", F.when(F.col("final_endpoint").isNotNull(), classify_endpoint(F.col("final_endpoint"))))
        .join(acks, "provider", "left")
    )
    cls = F.col("__e.endpoint_class")
    denied = F.array_except(
        F.array_intersect(F.coalesce("categories", _none()), F.array(*[F.lit(d) for d in deny])),
        F.array(*[F.lit(a) for a in allow]) if allow else _none(),
    )
    remote = cls == "remote"
    acknowledged = F.coalesce(F.col("ack_state") == "acknowledged", F.lit(False))
    promoted = acknowledged & (F.col("ack_class") != "remote")
    trim = lambda c: F.regexp_replace(F.col(c), "/+$", "")
    mismatch = acknowledged & ~promoted & (trim("accepted_endpoint") != trim("provider"))
    reasons = present(
        (F.size(denied) > 0, "category_denied"),
        (F.col("payload_bytes") > max_payload_bytes, "payload_too_large"),
        (remote & ~acknowledged, "remote_not_acknowledged"),
        (remote & promoted, "endpoint_class_promoted_requires_reacknowledgment"),
        (remote & mismatch, "provider_acknowledgment_mismatch"),
        (remote & (F.col("__r.endpoint_class") != "remote"), "redirect_to_private"),
    )
    return (
        work.withColumn("host", F.col("__e.host"))
        .withColumn("endpoint_class", cls)
        .withColumn("endpoint_reason", F.col("__e.reason"))
        .withColumn("reasons", reasons)
        .withColumn("allowed", F.size("reasons") == 0)
        .drop("__e", "__r", "accepted_endpoint", "ack_class", "ack_state")
    )


# --------------------------------------------------------------------------- activity and trash

# fixed values: category of each activity source
ACTIVITY_CATEGORIES = {
    "registry": "registry_activity",
    "lnk": "shortcut_activity",
    "jumplist": "recent_application_activity",
    "recent_documents": "recent_documents",
    "shell_bags": "folder_navigation",
    "timeline": "activity_timeline",
    "prefetch": "program_execution",
    "event_log": "event_log_activity",
}
TIMESTAMP_CAVEAT = "a timestamp in this artifact indicates system activity, not proven human action"


def parse_kv_lines(df: DataFrame, id_col: str, kind: str = "kind", text: str = "text") -> DataFrame:
    """One row per ``key=value|key=value`` line; blanks and ``#`` comments are skipped."""
    lines = df.select(id_col, kind, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("line_no", "line"))
    line = F.trim(F.col("line"))
    kept = lines.withColumn("line", line).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    pairs = F.transform(
        F.filter(F.split("line", r"\|"), lambda t: F.contains(t, F.lit("="))),
        lambda t: F.struct(
            F.trim(F.substring_index(t, "=", 1)).alias("key"),
            F.trim(F.regexp_extract(t, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    work = kept.withColumn("fields", pairs)

    def last(name: str) -> Column:
        hits = F.filter("fields", lambda p: p["key"] == name)
        return F.try_element_at(hits, F.lit(-1))["value"]

    made = F.concat(F.col(kind), F.lit("-"), F.substring(F.sha2("line", 256), 1, 10))
    return work.select(
        id_col,
        kind,
        "line_no",
        F.coalesce(last("entry_id"), made).alias("entry_id"),
        F.coalesce(F.nullif(last("user"), F.lit("")), F.lit("unknown")).alias("user"),
        F.coalesce(last("source_path"), F.lit("")).alias("source_path"),
        F.coalesce(last("target_path"), F.lit("")).alias("target_path"),
        lookup(ACTIVITY_CATEGORIES, F.col(kind)).alias("category"),
        F.lit(TIMESTAMP_CAVEAT).alias("timestamp_caveat"),
        "fields",
    )


def little_endian(data: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer at a byte offset."""
    total = None
    for i in range(size):
        byte = F.conv(F.hex(F.substring(data, offset + 1 + i, 1)), 16, 10).cast("decimal(20,0)")
        part = byte * F.lit(256**i).cast("decimal(20,0)")
        total = part if total is None else total + part
    return total



def parse_trash_metadata(df: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """Original path, size and version of ``$I`` metadata bytes; NULL path where they are malformed.

    A version 2 path is as long as stated; a length beyond the bytes is malformed.
    """
    b = F.col(content)
    n = F.octet_length(b)
    version = little_endian(b, 0, 4)
    stated = little_endian(b, 16, 4)
    fits = stated <= n - 20
    raw = F.when(version == 1, F.substring(b, 9, 520)).when(
        (version == 2) & fits, F.substring(b, F.lit(21), F.when(fits, stated).cast("int"))
    )
    size = F.when(version == 1, little_endian(b, 4, 4)).when(version == 2, little_endian(b, 8, 8))
    even = F.substring(raw, F.lit(1), F.floor(F.octet_length(raw) / 2).cast("int") * 2)
    # an unpaired surrogate cannot be decoded
    sound = F.hex(even).rlike(r"^(?:..(?:[0-9A-C].|D[0-7]|[EF].)|..D[89AB]..D[C-F])*$")
    path = F.regexp_replace(F.when(sound, F.decode(even, "UTF-16LE")), "\0+$", "")
    fine = (n >= 24) & version.isin(1, 2) & (path != "")
    ok = F.coalesce(fine, F.lit(False))
    return df.select(
        id_col,
        F.when(ok, path).alias("original_path"),
        F.when(ok, size.cast("decimal(20,0)")).alias("size_bytes"),
        F.when(ok, version.cast("int")).alias("meta_version"),
    )


def parse_trash_info(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Original path, deletion time and warnings of ``.trashinfo`` texts."""
    from ..functions.urls import percent_decoded

    lines = F.transform(F.split(F.col(text), "\r\n|\n|\r"), lambda x: F.trim(x))
    fields = F.filter(lines, lambda x: F.contains(x, F.lit("=")) & (x != "[Trash Info]"))

    def values(key: str) -> Column:
        own = F.filter(fields, lambda x: F.trim(F.substring_index(x, "=", 1)) == key)
        return F.transform(own, lambda x: F.trim(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)))

    work = df.withColumn("__p", F.transform(values("Path"), percent_decoded)).withColumn("__d", values("DeletionDate"))
    stamp = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
    unsafe = F.exists(
        "__p", lambda p: F.contains(p, F.lit("\0")) | F.array_contains(F.split(p, "/"), "..")
    )
    uncertain = F.exists("__d", lambda d: ~d.rlike(stamp))
    return work.select(
        id_col,
        F.try_element_at("__p", F.lit(-1)).alias("original_path"),
        F.try_element_at(F.filter("__d", lambda d: d.rlike(stamp)), F.lit(-1)).alias("deletion_time"),
        present(
            (~F.startswith(F.col(text), F.lit("[Trash Info]")), "missing_trash_info_header"),
            (unsafe, "unsafe_original_path"),
            (uncertain, "uncertain_deletion_time"),
            (F.size("__p") == 0, "missing_original_path"),
        ).alias("warnings"),
    )


# --------------------------------------------------------------------------- messages

SAFE_TOKENS = (
    "case_id",
    "job_id",
    "state",
    "percent",
    "count",
    "high_value_count",
    "sensitive_count",
    "health",
)
_TOKEN = r"\{([a-z_][a-z0-9_]*)\}"


def render_messages(events: DataFrame, templates: DataFrame, ui_base: str) -> DataFrame:
    """Title, body and link per event with a template.

    Safe tokens take the payload value or ``?``, any other token is redacted; the body then goes
    through the secret patterns. Each token is replaced once, so a value cannot smuggle in a token.
    """
    # one row per event type
    joined = events.join(F.broadcast(templates), "event_type")
    tokens = F.regexp_extract_all("template", F.lit(_TOKEN), F.lit(1))
    literals = F.split("template", r"\{[a-z_][a-z0-9_]*\}")

    def filled(literal: Column, token: Column) -> Column:
        value = F.try_element_at("payload", token)
        text = (
            F.when(token.isNull(), "")
            .when(~token.isin(*SAFE_TOKENS), REDACTED)
            .otherwise(F.coalesce(value, F.lit("?")))
        )
        return F.concat(literal, text)

    body = F.array_join(F.zip_with(literals, tokens, filled), "")
    safe = redact_secrets(joined.withColumn("__body", body), "__body", out="body", codes="redactions")
    base = ui_base.rstrip("/")
    return safe.withColumn("title", F.col("template")).withColumn(
        "local_ui_link",
        F.when(F.coalesce("case_id", F.lit("")) != "", F.concat(F.lit(f"{base}/#/case/"), "case_id")).otherwise(
            F.lit(base)
        ),
    ).drop("__body", "template")
