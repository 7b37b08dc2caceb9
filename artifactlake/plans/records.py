"""Bindings of the parser result operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as op
from ..registry import query
from .bindings import run_sql

TIME = """'{"raw_epoch":1,"normalized_utc":"x","display_timezone":"UTC"}'"""
PROV = """'{"entry_id":"e","source_artifact":"s","parser":"p","row_reference":"r"}'"""
ARTIFACT = f"""SELECT event_id, CASE event_id % 7
    WHEN 0 THEN '{{"artifact_id":"a","artifact_kind":"visit","browser_family":"x","profile_id":"p","raw_provenance":' || {PROV} || ',"recovery_confidence":1,"url":"u","title":"t","visit_time":' || {TIME} || '}}'
    WHEN 1 THEN '{{"artifact_kind":"search","browser_family":"x","profile_id":"p","raw_provenance":"text","recovery_confidence":1.5,"query":"q","search_time":5}}'
    WHEN 2 THEN '{{"artifact_kind":"other"}}'
    WHEN 3 THEN '{{"artifact_id":"a","artifact_kind":"cookie_metadata","browser_family":"x","profile_id":"p","raw_provenance":{{"entry_id":"e"}},"recovery_confidence":"1","host":"h","name":"n","created_time":{{"raw_value":1}},"value":"v","token":1}}'
    WHEN 4 THEN 'broken'
    WHEN 5 THEN '{{"artifact_id":"a","artifact_kind":"bookmark","browser_family":"x","profile_id":"p","raw_provenance":' || {PROV} || ',"recovery_confidence":' || (user_id / 1000.0) || ',"url":"u","title":"t","created_time":' || {TIME} || '}}'
    ELSE '{{"artifact_id":"a","artifact_kind":"extension","browser_family":"x","profile_id":"p","raw_provenance":' || {PROV} || ',"recovery_confidence":0.5,"extension_id":"' || user_id || '"}}' END AS doc FROM """


def _artifacts(spark, sf):
    return op.validate_artifacts(run_sql(spark, sf, ARTIFACT + "{events}"), "doc")


# bookmarks have the user's thousandth as confidence, which is valid from 0 to 1
VALID_SQL = "(event_id % 7 = 0 OR (event_id % 7 = 5 AND user_id BETWEEN 0 AND 1000))"


@query("c13_validate_artifacts", f"SELECT event_id FROM events WHERE {VALID_SQL}")
def c13(spark, sf):
    return _artifacts(spark, sf)[0].select("event_id")


@query(
    "c13_artifact_rejects",
    f"""SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'missing:artifact_id|invalid_timestamp:search_time|invalid_raw_provenance|invalid_recovery_confidence'
      WHEN 3 THEN 'forbidden_token_field:token|forbidden_token_field:value|missing_normalized_timestamp:created_time|missing_display_timezone:created_time|'
        || 'missing_provenance:source_artifact|missing_provenance:parser|missing_provenance:row_reference|invalid_recovery_confidence'
      WHEN 5 THEN 'invalid_recovery_confidence'
      WHEN 6 THEN 'missing:name|missing:install_path' ELSE 'unknown_artifact_kind' END AS warnings FROM events WHERE NOT {VALID_SQL}""",
)
def c13_rejects(spark, sf):
    return _artifacts(spark, sf)[1].select("event_id", F.array_join("warnings", "|").alias("warnings"))


MEMBERS = """SELECT o_orderkey, array(
    named_struct('path', CASE WHEN o_orderkey % 5 = 0 THEN '/abs' WHEN o_orderkey % 5 = 1 THEN 'a/../b' ELSE 'a/' || o_orderkey END, 'kind', CASE WHEN o_orderkey % 6 = 0 THEN 'symlink' ELSE 'file' END,
      'size_bytes', o_custkey * 300, 'compressed_size_bytes', CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE o_custkey * 300 + 1 END, 'encrypted', o_orderkey % 9 = 0, 'warnings', CAST(NULL AS ARRAY<STRING>)),
    named_struct('path', '', 'kind', 'file', 'size_bytes', 1L, 'compressed_size_bytes', 1L, 'encrypted', FALSE, 'warnings', NULL),
    named_struct('path', 'late', 'kind', 'file', 'size_bytes', 1L, 'compressed_size_bytes', 1L, 'encrypted', FALSE, 'warnings', NULL)) AS members FROM {orders}"""


@query(
    "c18_archive_members",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '/abs' WHEN o_orderkey % 5 = 1 THEN 'a/../b' ELSE 'a/' || o_orderkey END AS path,
        CASE WHEN o_orderkey % 6 = 0 THEN 'symlink' ELSE 'file' END AS kind, o_custkey * 300 AS size_bytes, o_orderkey % 9 = 0 AS encrypted,
        concat_ws('|', CASE WHEN o_orderkey % 5 < 2 THEN 'unsafe_member_path' END, CASE WHEN o_orderkey % 6 = 0 THEN 'unsafe_member_kind:symlink' END,
          CASE WHEN o_orderkey % 4 = 0 AND o_custkey * 300 > 10000 THEN 'compression_ratio_limit' END) AS warnings FROM orders)
    SELECT *, warnings = '' AND NOT encrypted AS allowed FROM t""",
)
def c18(spark, sf):
    rows = op.archive_members(run_sql(spark, sf, MEMBERS), "o_orderkey", max_members=2)[0]
    return rows.drop("position").withColumn("warnings", F.array_join("warnings", "|"))


@query(
    "c18_member_rejects",
    """SELECT o_orderkey, 1 AS position, 'invalid_archive_member' AS reason FROM orders
    UNION ALL SELECT o_orderkey, 2, 'archive_member_limit_applied' FROM orders""",
)
def c18_rejects(spark, sf):
    return op.archive_members(run_sql(spark, sf, MEMBERS), "o_orderkey", max_members=2)[1]


REGIONS = """SELECT conv_id, turn, text, CAST(turn AS DOUBLE) / 4 AS mean_confidence,
    CASE WHEN role = 'user' THEN 'scratch://sha256/x' WHEN role = 'system' THEN 'file:///x' END AS derivative_uri,
    array(named_struct('page_number', CAST(turn AS INT), 'text', role, 'confidence', 0.9D, 'bbox', named_struct('x', 1, 'y', 1, 'width', CAST(conv_id % 3 AS INT), 'height', 1)),
      named_struct('page_number', 1, 'text', '', 'confidence', 0.9D, 'bbox', named_struct('x', 1, 'y', 1, 'width', 1, 'height', 1)),
      named_struct('page_number', 1, 'text', 'ok', 'confidence', CAST(conv_id % 2 AS DOUBLE) * 2, 'bbox', named_struct('x', 1, 'y', 1, 'width', 1, 'height', 1))) AS regions FROM {conversations}"""


@query(
    "c19_normalize_regions",
    """SELECT conv_id, turn, text, CASE WHEN turn <= 4 THEN turn / 4 END AS mean_confidence,
      (CASE WHEN turn > 0 AND conv_id % 3 > 0 THEN 1 ELSE 0 END) + (CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END) AS regions,
      CASE WHEN role = 'user' THEN 'scratch://sha256/x' END AS derivative_uri,
      concat_ws('|', CASE WHEN turn / 4 < 0.55 THEN 'low_confidence_ocr' END, CASE WHEN role = 'system' THEN 'invalid_ocr_derivative_storage' END) AS warnings
    FROM conversations""",
)
def c19(spark, sf):
    out = op.normalize_regions(run_sql(spark, sf, REGIONS))
    return out.drop("truncated").withColumn("regions", F.size("regions")).withColumn(
        "warnings", F.array_join("warnings", "|")
    )


SEGMENTS = """SELECT conv_id, turn, text, CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'es' END AS language, CAST(turn AS DOUBLE) / 2 AS confidence,
    array(named_struct('start_seconds', 0D, 'end_seconds', CAST(turn AS DOUBLE) - 1, 'text', role, 'confidence', 0.5D, 'language', 'de'),
      named_struct('start_seconds', 1D, 'end_seconds', 2D, 'text', 'x', 'confidence', 7D, 'language', 'en')) AS segments,
    map('chunk_index', CAST(turn AS STRING), 'other', 'no') AS checkpoint, map('chunk_index', 'old', 'next_offset_seconds', '5') AS previous_checkpoint FROM {conversations}"""


@query(
    "c20_normalize_segments",
    """SELECT conv_id, turn, text, CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 2 THEN 'es' ELSE 'unknown' END AS language, CASE WHEN turn <= 2 THEN turn / 2 END AS confidence,
      CASE WHEN turn >= 1 THEN 2 ELSE 1 END AS segments, CAST(turn AS VARCHAR) AS chunk, '5' AS next_offset,
      concat_ws('|', CASE conv_id % 4 WHEN 1 THEN 'unsupported_detected_language:fr' END, CASE WHEN trim(text) = '' THEN 'silence_or_no_speech' END) AS warnings FROM conversations""",
)
def c20(spark, sf):
    out = op.normalize_segments(run_sql(spark, sf, SEGMENTS))
    return out.select(
        "conv_id",
        "turn",
        "text",
        "language",
        "confidence",
        F.size("segments").alias("segments"),
        F.col("checkpoint")["chunk_index"].alias("chunk"),
        F.col("checkpoint")["next_offset_seconds"].alias("next_offset"),
        F.array_join("warnings", "|").alias("warnings"),
    )


@query(
    "c21_normalize_media",
    """SELECT p_partkey, nullif(p_size % 5, 0) AS width, CASE WHEN p_size % 7 - 2 > 0 THEN p_size % 7 - 2 END AS height,
      CASE WHEN p_retailprice >= 1000 THEN p_retailprice - 1000 END AS duration_seconds, CASE WHEN p_size * 3 - 40 <= 90 THEN p_size * 3 - 40 END AS latitude,
      CASE WHEN p_size * 3 - 40 <= 90 THEN p_size * 1.0 END AS longitude, p_brand AS model, 'a,b' AS keys, CASE WHEN p_type = 'PROMO' THEN 'malformed_media' ELSE '' END AS warnings FROM part""",
)
def c21(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT p_partkey, p_size % 5 AS width, p_size % 7 - 2 AS height, p_retailprice - 1000 AS duration_seconds, CAST(p_size * 3 - 40 AS DOUBLE) AS latitude,
             CAST(p_size AS DOUBLE) AS longitude, map('model', p_brand) AS device, map('c', p_name, 'a', p_type, 'b', p_brand) AS raw_metadata, p_type = 'PROMO' AS malformed FROM {part}""",
    )
    out = op.normalize_media(rows, max_fields=2)
    return out.select(
        "p_partkey",
        "width",
        "height",
        "duration_seconds",
        "latitude",
        "longitude",
        F.col("device")["model"].alias("model"),
        F.array_join(F.map_keys("raw_metadata"), ",").alias("keys"),
        F.array_join("warnings", "|").alias("warnings"),
    )


THUMBS = """SELECT CAST(l_partkey AS STRING) AS content_sha256, l_orderkey * 100000 + l_suppkey * 100 + l_linenumber AS ord,
    CASE l_linenumber WHEN 1 THEN 'embedded' WHEN 2 THEN 'small' WHEN 3 THEN 'large' WHEN 4 THEN 'small' ELSE 'tiny' END AS tier,
    CASE WHEN l_returnflag = 'R' THEN 'image/bmp' ELSE 'image/png' END AS mime_type, CAST(floor(l_quantity) AS INT) * 20 AS width, CAST(floor(l_quantity) AS INT) * 10 AS height,
    CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, CASE WHEN l_linestatus = 'F' THEN 'scratch://sha256/' ELSE 'scratch://sha256/x' END || l_suppkey AS storage_uri FROM """
THUMB_SQL = f"""t AS ({THUMBS} lineitem), k AS (SELECT *, CASE tier WHEN 'embedded' THEN 256 WHEN 'small' THEN 512 ELSE 1600 END AS lim FROM t WHERE tier <> 'tiny'),
    p AS (SELECT *, CASE WHEN mime_type = 'image/bmp' THEN 'unsafe_thumbnail_mime'
      WHEN NOT coalesce(width > 0 AND height > 0 AND size_bytes > 0, FALSE) THEN 'invalid_thumbnail_dimensions' WHEN width > lim OR height > lim THEN 'thumbnail_dimension_limit'
      WHEN size_bytes > 40000 THEN 'thumbnail_output_limit' END AS problem FROM k),
    g AS (SELECT *, row_number() OVER (PARTITION BY content_sha256, tier ORDER BY ord NULLS LAST, storage_uri, mime_type, width, height, size_bytes) AS n
      FROM p WHERE problem IS NULL),
    f AS (SELECT content_sha256, tier, ord AS ok, width FROM g WHERE n = 1)"""


def _thumbs(spark, sf):
    rows = run_sql(spark, sf, THUMBS + "{lineitem}")
    objects = run_sql(spark, sf, "SELECT CAST(p_partkey AS STRING) AS content_sha256 FROM {part}")
    return op.accept_derivatives(rows, objects, 40000)


@query(
    "c22_accept_derivatives",
    f"""WITH {THUMB_SQL} SELECT content_sha256, tier, ok AS ord, width,
      sha256('image-thumbnails-v1' || chr(0) || content_sha256 || chr(0) || tier) AS cache_key FROM f""",
)
def c22(spark, sf):
    return _thumbs(spark, sf)[0].select("content_sha256", "tier", "ord", "width", "cache_key")


@query(
    "c22_derivative_warnings",
    f"""WITH {THUMB_SQL} SELECT DISTINCT p.content_sha256, problem || ':' || p.tier AS warning FROM p LEFT JOIN f USING (content_sha256, tier)
      WHERE problem IS NOT NULL AND (ok IS NULL OR ord < ok)
    UNION ALL SELECT DISTINCT CAST(p_partkey AS VARCHAR), 'missing_thumbnail_tier:' || tier FROM part, (VALUES ('embedded'), ('small'), ('large')) v(tier)
      WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.content_sha256 = CAST(p_partkey AS VARCHAR) AND f.tier = v.tier)""",
)
def c22_warnings(spark, sf):
    return _thumbs(spark, sf)[1]


OUTPUTS = """SELECT event_id, CASE event_id % 12
    WHEN 0 THEN '{"labels":["' || event_type || '"],"confidence":0.' || (user_id % 9 + 1) || ',"evidence":["finding:abc' || (100000 + event_id) || '","bad"]}'
    WHEN 1 THEN '{"labels":["x"],"confidence":0.5}'
    WHEN 2 THEN 'oops'
    WHEN 3 THEN '[1]'
    WHEN 4 THEN '{"labels":["x"],"confidence":2,"evidence":["finding:abcdef"]}'
    WHEN 5 THEN '{"labels":["1","2","3","4","5","6","7","8","9"],"confidence":1,"evidence":["finding:abcdef"]}'
    WHEN 6 THEN '{"labels":[""],"confidence":1,"evidence":["finding:abcdef"]}'
    WHEN 7 THEN '{"labels":[],"confidence":1,"evidence":["finding:abcdef"]}'
    WHEN 8 THEN '{"labels":["x"],"confidence":1,"evidence":["nope"]}'
    WHEN 9 THEN '{"labels":["x"],"confidence":1,"evidence":["finding:abcdef"],"shell":"ls"}'
    WHEN 10 THEN '{"labels":"x","confidence":1,"evidence":["finding:abcdef"]}'
    ELSE '{"labels":["password: hunter' || user_id || 'xyz"],"confidence":0.25,"evidence":["entry:zzz_' || (100000 + event_id) || '"]}' END AS doc FROM """


def _outputs(spark, sf):
    return op.validate_model_output(run_sql(spark, sf, OUTPUTS + "{events}"), "doc", "classification")


@query(
    "c23_validate_model_output",
    """SELECT event_id, CASE WHEN event_id % 12 = 0 THEN (user_id % 9 + 1) / 10 ELSE 0.25 END AS confidence,
      CASE WHEN event_id % 12 = 0 THEN 'finding:abc' ELSE 'entry:zzz_' END || (100000 + event_id) AS evidence, event_id % 12 = 11 AS was_redacted
    FROM events WHERE event_id % 12 IN (0, 11)""",
)
def c23(spark, sf):
    return _outputs(spark, sf)[0].select(
        "event_id", "confidence", F.array_join("evidence", "|").alias("evidence"), "was_redacted"
    )


@query(
    "c23_model_output_rejects",
    """SELECT event_id, ['missing_field', 'malformed_json', 'malformed_output', 'invalid_field', 'invalid_field', 'invalid_label', 'missing_labels',
      'missing_evidence', 'provider_requested_access', 'invalid_field'][event_id % 12] AS code FROM events WHERE event_id % 12 BETWEEN 1 AND 10""",
)
def c23_rejects(spark, sf):
    return _outputs(spark, sf)[1].select("event_id", "code")


@query(
    "c24_health_status",
    """WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS passed, s_suppkey % 5 = 0 AS att, s_suppkey % 7 = 0 AS nv, s_suppkey % 3 = 0 AS lim FROM supplier),
    s AS (SELECT *, CASE WHEN passed = FALSE THEN 'failed' WHEN att OR nv THEN 'warning' WHEN passed THEN 'passed' WHEN lim THEN 'unavailable' ELSE 'unknown' END AS status FROM t)
    SELECT s_suppkey, status, status IN ('failed', 'warning') AS acknowledgment_required, CASE WHEN status = 'failed' THEN 'smart_health_failed' WHEN status = 'unavailable' THEN 'bridge_or_device_limitation'
      ELSE concat_ws('|', CASE WHEN att THEN 'ata_attribute_warning' END, CASE WHEN nv THEN 'nvme_critical_warning' END) END AS reasons FROM s""",
)
def c24(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS passed,
             array(named_struct('name', 'Reallocated_Sector_Ct', 'raw', CASE WHEN s_suppkey % 5 = 0 THEN '3 (x)' ELSE '0' END), named_struct('name', 'Other', 'raw', '9')) AS attributes,
             CASE WHEN s_suppkey % 7 = 0 THEN 4 ELSE 0 END AS critical_warning, CASE WHEN s_suppkey % 3 = 0 THEN array('Device Unsupported') ELSE array('fine') END AS messages FROM {supplier}""",
    )
    out = op.health_status(rows)
    return out.select("s_suppkey", "status", "acknowledgment_required", F.array_join("reasons", "|").alias("reasons"))


REQUESTS = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'http://127.0.0.1:8080/x' WHEN 1 THEN 'http://192.168.1.' || (page_id % 250) || '/' WHEN 2 THEN 'http://8.8.8.' || (page_id % 250)
      WHEN 3 THEN 'http://169.254.169.254/latest' WHEN 4 THEN 'http://api.localhost/' WHEN 5 THEN 'http://u:p@172.20.0.1/' ELSE url END AS endpoint,
    CASE WHEN page_id % 6 = 0 THEN 'http://10.1.2.3/' END AS final_endpoint, 'prov' || (page_id % 30) AS provider, length(html) AS payload_bytes FROM """
ACKS = """SELECT 'prov' || n_nationkey AS provider, CASE n_nationkey WHEN 3 THEN 'elsewhere' ELSE 'prov' || n_nationkey || '/' END AS accepted_endpoint,
    CASE n_nationkey WHEN 2 THEN 'lan' ELSE 'remote' END AS endpoint_class, CASE n_nationkey WHEN 1 THEN 'revoked' ELSE 'acknowledged' END AS state FROM {t}"""


@query(
    "c25_gate_requests",
    f"""WITH r AS ({REQUESTS} pages), c AS (SELECT *, CASE page_id % 8 WHEN 0 THEN 'local' WHEN 1 THEN 'lan' WHEN 4 THEN 'local' WHEN 5 THEN 'lan' ELSE 'remote' END AS cls FROM r),
    d AS (SELECT page_id, cls, concat_ws('|', CASE WHEN page_id % 3 = 0 THEN 'category_denied' END, CASE WHEN payload_bytes > 6000 THEN 'payload_too_large' END,
      CASE WHEN cls = 'remote' THEN CASE CASE WHEN page_id % 30 >= 25 THEN 1 ELSE page_id % 30 END WHEN 1 THEN 'remote_not_acknowledged' WHEN 2 THEN 'endpoint_class_promoted_requires_reacknowledgment'
        WHEN 3 THEN 'provider_acknowledgment_mismatch' END END, CASE WHEN cls = 'remote' AND page_id % 6 = 0 THEN 'redirect_to_private' END) AS reasons FROM c)
    SELECT page_id, cls AS endpoint_class, reasons, reasons = '' AS allowed FROM d""",
)
def c25(spark, sf):
    rows = run_sql(spark, sf, REQUESTS + "{pages}").withColumn(
        "categories", F.when(F.col("page_id") % 3 == 0, F.array(F.lit("wallets"), F.lit("ok"))).otherwise(F.array(F.lit("media")))
    )
    out = op.gate_requests(rows, run_sql(spark, sf, ACKS.replace("{t}", "{nation}")), ["wallets", "media"], ["media"], 6000)
    return out.select("page_id", "endpoint_class", F.array_join("reasons", "|").alias("reasons"), "allowed")


@query(
    "c26_parse_kv_lines",
    """SELECT event_id, 'id-' || event_id AS entry_id, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'unknown' END AS "user", 'C:/x=' || event_type AS target_path, 'shortcut_activity' AS category FROM events
    UNION ALL SELECT event_id, 'lnk-' || substr(sha256('note|k=' || event_id), 1, 10), 'unknown', '', 'shortcut_activity' FROM events""",
)
def c26(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT event_id, 'lnk' AS kind, '# head' || chr(10) || ' entry_id = id-' || event_id || '|user=' || CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE '' END
             || '|target_path=C:/x=' || event_type || chr(10) || chr(10) || '  note|k=' || event_id || ' ' AS text FROM {events}""",
    )
    return op.parse_kv_lines(rows, "event_id").select("event_id", "entry_id", "user", "target_path", "category")


def _utf16(text):
    return F.encode(text, "UTF-16LE")


@query(
    "c27_trash_metadata",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'C:' || chr(92) || p_name || chr(92) || 'é' END AS original_path,
      CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size * 1000 END AS size_bytes, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 3 THEN NULL ELSE 2 END AS meta_version FROM part""",
)
def c27(spark, sf):
    df = run_sql(spark, sf, "SELECT p_partkey, 'C:' || chr(92) || p_name || chr(92) || 'é' AS path, CAST(p_size AS BIGINT) * 1000 AS size FROM {part}")

    def le(value, size):
        hexed = F.lpad(F.hex(value.cast("long")), size * 2, "0")
        return F.unhex(F.concat(*[F.substring(hexed, size * 2 - 1 - 2 * i, 2) for i in range(size)]))

    raw = _utf16(F.col("path"))
    v1 = F.concat(le(F.lit(1), 4), le(F.col("size"), 4), raw, F.unhex(F.lit("00" * 20)))
    v2 = F.concat(le(F.lit(2), 4), le(F.lit(0), 4), le(F.col("size"), 8), le(F.octet_length(raw), 4), raw, F.unhex(F.lit("FF" * 4)))
    pick = F.when(F.col("p_partkey") % 4 == 0, v1).when(F.col("p_partkey") % 4 == 3, F.concat(le(F.lit(7), 4), raw)).otherwise(v2)
    return op.parse_trash_metadata(df.withColumn("content", pick), "p_partkey")


@query(
    "c27_trash_info",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 1 THEN '/home/../' || p_name ELSE '/home/' || p_name END AS original_path,
      CASE WHEN p_partkey % 3 = 0 THEN '2024-01-02T03:04:05' END AS deletion_time, concat_ws('|', CASE WHEN p_partkey % 5 = 0 THEN 'missing_trash_info_header' END,
        CASE p_partkey % 4 WHEN 1 THEN 'unsafe_original_path' END, CASE WHEN p_partkey % 3 <> 0 THEN 'uncertain_deletion_time' END,
        CASE p_partkey % 4 WHEN 2 THEN 'missing_original_path' END) AS warnings FROM part""",
)
def c27_info(spark, sf):
    df = run_sql(
        spark,
        sf,
        """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '[Trash Info]' || chr(10) END || CASE p_partkey % 4 WHEN 2 THEN '' WHEN 1 THEN 'Path=/home/../' || replace(p_name, ' ', '%20')
             ELSE ' Path = /home/' || replace(p_name, ' ', '%20') END || chr(10) || 'DeletionDate=' || CASE WHEN p_partkey % 3 = 0 THEN '2024-01-02T03:04:05' ELSE 'yesterday' END AS text FROM {part}""",
    )
    return op.parse_trash_info(df, "p_partkey").withColumn("warnings", F.array_join("warnings", "|"))


@query(
    "c28_media_identity",
    """WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'x' ELSE 'reader_' || s_suppkey END AS r, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey * 512 END AS cap,
        CASE WHEN s_suppkey % 3 = 0 THEN sha256(s_name) END AS fp, s_nationkey AS gen FROM supplier)
    SELECT s_suppkey, cap IS NOT NULL AND cap > 0 OR fp IS NOT NULL AS has_medium, CASE WHEN (coalesce(cap, 0) > 0 OR fp IS NOT NULL) AND r <> 'x' THEN sha256('{"medium_signals":{"capacity_bytes":' || coalesce(CAST(cap AS VARCHAR), 'null')
      || ',"geometry":null,"logical_block_size":512,"media_change_generation":' || gen || ',"physical_block_size":4096,"sampled_fingerprint_sha256":' || coalesce('"' || fp || '"', 'null')
      || ',"toc_sessions":null},"reader_id":"' || r || '"}') END AS identity_key,
      concat_ws('|', CASE WHEN r = 'x' THEN 'invalid_reader_id' END, CASE WHEN coalesce(cap, 0) <= 0 AND fp IS NULL THEN 'no_medium_present' END, CASE WHEN fp IS NULL THEN 'missing_sampled_fingerprint' END,
        CASE WHEN s_suppkey % 2 = 0 THEN 'missing_toc_or_geometry' END) AS warnings FROM t""",
)
def c28(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'x' ELSE 'reader_' || s_suppkey END AS reader_id, TRUE AS removable,
             CASE WHEN s_suppkey % 2 = 0 THEN 'optical' ELSE 'usb_storage' END AS device_type, 'by-id' AS identity_strength, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey * 512 END AS capacity_bytes,
             CAST(NULL AS STRING) AS geometry, 512 AS logical_block_size, s_nationkey AS media_change_generation, 4096 AS physical_block_size,
             CASE WHEN s_suppkey % 3 = 0 THEN sha2(s_name, 256) WHEN s_suppkey % 3 = 1 THEN 'short' END AS sampled_fingerprint_sha256, CAST(NULL AS STRING) AS toc_sessions FROM {supplier}""",
    )
    out = op.media_identity(rows)
    return out.select("s_suppkey", "has_medium", "identity_key", F.array_join("warnings", "|").alias("warnings"))


