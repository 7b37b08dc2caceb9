"""Bindings of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.windows import backfill_sequences
from ..registry import query
from ..session import scratch_dir
from ..sources import catalog, exports as op, readers
from .bindings import ctes, run_sql, table, view


@query(
    "s1_catalog_table",
    f"""WITH {ctes("findings")} SELECT finding_id, case_id, severity, confidence, created_at FROM findings""",
)
def s1(spark, sf):
    root = f"{scratch_dir(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    catalog.write_catalog(view(spark, sf, "findings"), root, "findings", ("created_at", "finding_id"))
    return catalog.catalog_table(spark, root, "findings").select(
        "finding_id", "case_id", "severity", "confidence", "created_at"
    )


@query(
    "s2_load_objects",
    """SELECT split_part(url, '/', 4) AS folder, sum(octet_length(encode(html)) + 1)::BIGINT AS size_bytes, TRUE AS sampled FROM pages GROUP BY 1""",
)
def s2(spark, sf):
    # pages written as text objects into one folder per language, then read back as objects
    root = f"{scratch_dir(spark).rstrip('/')}/objects-{uuid.uuid4().hex}"
    pages = run_sql(spark, sf, "SELECT split_part(url, '/', 4) AS folder, html AS value FROM {pages}")
    pages.write.partitionBy("folder").text(root)
    objects = readers.load_objects(spark, f"{root}/folder=*/*.txt")
    sampled = F.octet_length("sample") == F.col("size_bytes")
    return objects.groupBy(F.regexp_extract("path", r"folder=([^/]*)/", 1).alias("folder")).agg(
        F.sum("size_bytes").alias("size_bytes"), F.bool_and(sampled).alias("sampled")
    )


# events wrapped as message lines; every kind of damage occurs
LINES = """SELECT event_id, CASE event_id % 16
    WHEN 0 THEN '{"protocol_version":1,"type":"progress","sequence":' || event_id || ',"payload":{"stage":"s","completed":1,"total":2}}'
    WHEN 1 THEN '{"protocol_version":2,"type":"hello","sequence":1,"payload":{"worker_id":"w","scanner_version":"1"}}' || chr(10)
    WHEN 2 THEN '{"protocol_version":1,"type":"nope","sequence":1,"payload":{}}' || chr(10)
    WHEN 3 THEN '{"protocol_version":1,"type":"hello","sequence":-1,"payload":{"worker_id":"w","scanner_version":"1"}}' || chr(10)
    WHEN 4 THEN '{"protocol_version":1,"type":"warning","sequence":1,"payload":{"stage":"s","code":"c"}}' || chr(10)
    WHEN 5 THEN '{"protocol_version":1,"type":"complete","sequence":1,"payload":"x"}' || chr(10)
    WHEN 6 THEN '{"protocol_version":1,"type":"pause_ack","sequence":1,"payload":{"stage":"s","reason":"a' || chr(92) || 'nb"}}' || chr(10)
    WHEN 7 THEN '{"protocol_version":1,"type":"pause_ack","sequence":1,"payload":{"stage":"s","reason":"' || repeat('x', 4097) || '"}}' || chr(10)
    WHEN 8 THEN 'not json' || chr(10)
    WHEN 9 THEN '[1,2]' || chr(10)
    WHEN 10 THEN '{"protocol_version":1,"type":"finding_batch","sequence":1,"payload":{"stage":"s","batch_id":"b","findings":[' || repeat('1,', 256) || '1]}}' || chr(10)
    WHEN 11 THEN '{"protocol_version":1,"type":"hello","sequence":1,"payload":{"worker_id":"' || repeat('y', 16400) || '"}}' || chr(10)
    WHEN 12 THEN '{"protocol_version":1,"type":"hello","sequence":1.5,"payload":{"worker_id":"w","scanner_version":"1"}}' || chr(10)
    ELSE '{"protocol_version":1,"type":"checkpoint","sequence":' || event_id || ',"payload":{"stage":"s","checkpoint_id":"' || user_id || '","p":' || props || '}}' || chr(10)
    END AS line FROM """


def _lines(spark, sf):
    rows = run_sql(spark, sf, LINES + "{events}")
    return rows.withColumn("value", F.col("line").cast("binary")).drop("line")


@query(
    "s3_read_messages",
    """SELECT event_id, 'checkpoint' AS type, event_id AS sequence FROM events WHERE event_id % 16 > 12""",
)
def s3(spark, sf):
    return readers.read_messages(_lines(spark, sf))[0].select("event_id", "type", "sequence")


@query(
    "s3_message_rejects",
    """SELECT event_id, ['truncated', 'unsupported_version', 'unknown_type', 'invalid_sequence', 'missing_fields', 'invalid_payload',
      'control_characters', 'field_too_long', 'invalid_json', 'not_an_object', 'invalid_batch', 'oversized', 'invalid_sequence'][event_id % 16 + 1] AS reason
    FROM events WHERE event_id % 16 <= 12""",
)
def s3_rejects(spark, sf):
    return readers.read_messages(_lines(spark, sf))[1].select("event_id", "reason")


LISTING = """SELECT p_partkey AS ord, 'vol' || p_size AS volume_id, CASE p_partkey % 7 WHEN 0 THEN 'garbage ' || p_name WHEN 1 THEN '   '
    ELSE CASE p_size % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'r' WHEN 2 THEN 'l' WHEN 3 THEN 'v' ELSE '-' END || '/' || CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE '-' END
      || ' ' || p_partkey || '-128-1:  /' || p_type || '/' || p_name || '/' END AS line FROM """


@query(
    "s4_parse_inventory_lines",
    f"""WITH l AS ({LISTING} part) SELECT ord, volume_id, ord || '-128-1' AS object_id, trim(split_part(line, ':  ', 2), '/') AS path,
      CASE line[1] WHEN 'd' THEN 'directory' WHEN 'r' THEN 'file' WHEN 'l' THEN 'symlink' WHEN 'v' THEN 'virtual' ELSE 'unknown' END AS entry_type,
      line[3] = '-' AS allocated FROM l WHERE ord % 7 > 1""",
)
def s4(spark, sf):
    return readers.parse_inventory_lines(run_sql(spark, sf, LISTING + "{part}"))[0]


@query("s4_unparsed_lines", "SELECT p_partkey AS ord, 'unparsed_line' AS warning FROM part WHERE p_partkey % 7 = 0")
def s4_rejects(spark, sf):
    return readers.parse_inventory_lines(run_sql(spark, sf, LISTING + "{part}"))[1].select("ord", "warning")


@query(
    "s4_partition_lines",
    """SELECT o_orderkey AS ord, '001:' AS slot, o_custkey AS start, o_custkey + 9 AS "end", 10 + o_orderkey % 2 AS sector_count,
      o_custkey * 512 AS offset_bytes, (10 + o_orderkey % 2) * 512 AS length_bytes, CASE o_orderstatus WHEN 'P' THEN 'Unallocated' ELSE 'NTFS (0x07)' END AS description,
      o_orderstatus = 'F' AS allocated, o_orderkey % 2 = 1 AS length_mismatch FROM orders""",
)
def s4_partitions(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT o_orderkey AS ord, '001:  ' || CASE WHEN o_orderstatus = 'O' THEN '-----' ELSE 'Meta' END || '   ' || lpad(CAST(o_custkey AS STRING), 10, '0') || ' '
             || (o_custkey + 9) || '  ' || (10 + o_orderkey % 2) || '  ' || CASE o_orderstatus WHEN 'P' THEN 'Unallocated' ELSE 'NTFS (0x07)' END || '  ' AS line FROM {orders}""",
    )
    return readers.parse_partition_lines(rows, 512)


CELLS = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '=' || text WHEN 1 THEN '-' || lang WHEN 2 THEN '@' || source WHEN 3 THEN chr(9) || lang
    WHEN 4 THEN NULL ELSE text END AS cell, source FROM """


@query(
    "s5_csv_safe_cells",
    f"""WITH c AS ({CELLS} documents) SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 6 < 4 THEN chr(39) || cell
      WHEN doc_id % 6 = 4 THEN '' WHEN regexp_matches(cell, '^[=+@\\t\\r-]') THEN chr(39) || cell ELSE cell END AS cell, source FROM c""",
)
def s5(spark, sf):
    return op.safe_cells(run_sql(spark, sf, CELLS + "{documents}"))


@query(
    "s5_write_csv_safe",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, chr(39) || '=' || p_name AS name, CAST(p_size AS VARCHAR) AS p_size FROM part",
)
def s5_csv(spark, sf):
    path = f"{scratch_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    op.write_csv_safe(run_sql(spark, sf, "SELECT p_partkey, '=' || p_name AS name, p_size FROM {part}"), path)
    return spark.read.option("header", True).csv(path)


@query(
    "s6_export_records",
    """SELECT event_id AS entry_id, event_type AS artifact_kind, '' AS browser_family, '' AS "user", '' AS display_url, '' AS title, ts AS visited_at,
      'UTC only' AS timezone_notes, '' AS provenance, '' AS recovery_confidence, '' AS "domain" FROM events""",
)
def s6(spark, sf):
    rows = run_sql(
        spark,
        sf,
        "SELECT event_id AS entry_id, event_type AS artifact_kind, ts AS visited_at, value, props AS session_token FROM {events}",
    )
    return op.export_records(rows, timezone_notes="UTC only")


def _manifest(spark, sf):
    plans = run_sql(
        spark,
        sf,
        """SELECT o_orderkey AS export_item_id, 'src/' || o_orderkey AS source_display_path, 'out/' || o_orderkey AS destination_path,
             'allocated' AS provenance FROM {orders}""",
    )
    sums = run_sql(
        spark,
        sf,
        """SELECT l_orderkey AS export_item_id, sha2(CAST(l_orderkey AS STRING), 256) AS sha256,
             CAST(sum(l_quantity) AS BIGINT) AS size_bytes, CASE WHEN max(l_linenumber) > 3 THEN 'exported' ELSE 'failed' END AS status
           FROM {lineitem} GROUP BY l_orderkey""",
    )
    return op.export_manifest(plans, sums, sums, sums)


MANIFEST_SQL = """s AS (SELECT l_orderkey AS k, sha256(CAST(l_orderkey AS VARCHAR)) AS sha, CAST(sum(l_quantity) AS BIGINT) AS n,
      CASE WHEN max(l_linenumber) > 3 THEN 'exported' ELSE 'failed' END AS st FROM lineitem GROUP BY 1),
    m AS (SELECT o_orderkey AS export_item_id, 'src/' || o_orderkey AS source_display_path, 'out/' || o_orderkey AS destination_path, 'allocated' AS provenance,
      coalesce(sha, '') AS sha256, coalesce(n, 0) AS size_bytes, coalesce(st, 'unknown') AS status FROM orders LEFT JOIN s ON k = o_orderkey),
    d AS (SELECT *, sha256('{"destination_path":"' || destination_path || '","export_item_id":' || export_item_id || ',"provenance":"allocated","sha256":"' || sha256
      || '","size_bytes":' || size_bytes || ',"source_display_path":"' || source_display_path || '","status":"' || status || '"}') AS row_digest FROM m)"""


@query("s7_export_manifest", f"WITH {MANIFEST_SQL} SELECT * FROM d")
def s7(spark, sf):
    return _manifest(spark, sf)


@query(
    "s7_manifest_digest",
    f"""WITH {MANIFEST_SQL}, p AS (SELECT *, (row_number() OVER (ORDER BY export_item_id) - 1) // 50000 AS part FROM d),
    c AS (SELECT part, sha256(string_agg(row_digest, '' ORDER BY export_item_id)) AS x, count(*) AS n FROM p GROUP BY part)
    SELECT sha256(string_agg(x, '' ORDER BY part)) AS manifest_sha256, sum(n)::BIGINT AS items FROM c""",
)
def s7_digest(spark, sf):
    return op.ordered_digest(_manifest(spark, sf), "row_digest", ["export_item_id"])


STORE = """SELECT CAST(text AS BINARY) AS content, named_struct('doc', doc_id) AS provenance, doc_id,
    CASE WHEN lang = 'de' THEN sha2(source, 256) END AS expected_sha256,
    CASE WHEN lang = 'es' THEN CAST(n_chars AS BIGINT) END AS expected_size FROM {documents}"""


@query(
    "s8_content_store",
    """WITH k AS (SELECT sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM documents
      WHERE lang <> 'de' AND (lang <> 'es' OR n_chars = octet_length(encode(text))))
    SELECT 'content-' || substr(sha256, 1, 32) AS content_id, sha256, any_value(size_bytes) AS size_bytes, 'scratch://sha256/' || sha256 AS storage_uri, count(*) AS ref_count
    FROM k GROUP BY sha256""",
)
def s8(spark, sf):
    return op.content_store(run_sql(spark, sf, STORE))[0]


@query(
    "s8_store_references",
    """SELECT doc_id, 'content-' || substr(sha256(text), 1, 32) AS content_id FROM documents
    WHERE lang <> 'de' AND (lang <> 'es' OR n_chars = octet_length(encode(text)))""",
)
def s8_refs(spark, sf):
    return op.content_store(run_sql(spark, sf, STORE))[1].select("content_id", "provenance.doc")\
        .withColumnRenamed("doc", "doc_id")


@query(
    "s8_store_rejects",
    """SELECT doc_id, CASE lang WHEN 'de' THEN 'hash_mismatch' ELSE 'size_mismatch' END AS reason FROM documents
    WHERE lang = 'de' OR (lang = 'es' AND n_chars <> octet_length(encode(text)))""",
)
def s8_rejects(spark, sf):
    return op.content_store(run_sql(spark, sf, STORE))[2].select("doc_id", "reason")


@query(
    "s9_event_frames",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT user_id AS case_id, n AS sequence, 'id: ' || n || chr(10) || 'event: ' || event_type || chr(10) || 'data: {"case_id":"' || user_id || '","created_at":"'
      || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","event_id":"' || event_id || '","payload":' || props || ',"sequence":' || n || ',"type":"' || event_type || '"}'
      || chr(10) || chr(10) AS frame FROM s""",
)
def s9(spark, sf):
    log = backfill_sequences(view(spark, sf, "event_log"))
    stamped = log.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return op.event_frames(stamped)


COPY = """SELECT doc_id, CASE WHEN lang = 'fr' AND source = 'src1' THEN n_chars + 1 ELSE n_chars END AS size_bytes,
    {sha} AS sha256 FROM {t} WHERE source <> 'src2' UNION ALL SELECT -1 - doc_id, n_chars, '' FROM {t} WHERE source = 'src3'"""


@query(
    "s10_verify_copies",
    """SELECT doc_id, CASE WHEN source = 'src2' THEN 'missing_copy' WHEN lang = 'fr' AND source = 'src1' THEN 'size_mismatch'
        WHEN source = 'src4' THEN 'digest_mismatch' ELSE 'verified' END AS status FROM documents
    UNION ALL SELECT -1 - doc_id, 'unexpected_copy' FROM documents WHERE source = 'src3'""",
)
def s10(spark, sf):
    source = run_sql(spark, sf, "SELECT doc_id, n_chars AS size_bytes, sha2(text, 256) AS sha256 FROM {documents}")
    sha = "CASE WHEN source = 'src4' THEN sha2(lang, 256) ELSE sha2(text, 256) END"
    copied = run_sql(spark, sf, COPY.replace("{sha}", sha).replace("{t}", "{documents}"))
    return op.verify_copies(source, copied, "doc_id")
