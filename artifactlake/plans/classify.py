"""Bindings of the classification rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as fn
from ..functions.rules import NOISE_RULES
from ..registry import query
from .bindings import ctes, run_sql, view

ENTRIES = ctes("entries")


def entries(spark, sf):
    df = view(spark, sf, "entries")
    marks = fn.present((F.col("mismatch"), "extension_mismatch"))
    return df.withColumn(
        "signature",
        F.when(
            F.col("sig").isNotNull(),
            F.struct(
                F.col("sig").alias("signature"),
                "mime_type",
                F.col("sig_confidence").cast("double").alias("confidence"),
                marks.alias("evidence"),
            ),
        ),
    )


def scored(spark, sf):
    """Entries with noise decision, score and categories."""
    df = entries(spark, sf)
    profile = F.when(F.col("ord") % 6 == 0, F.concat(F.lit("p"), F.col("volume_id")))
    df = df.withColumn("profile_id", profile).withColumn(
        "state", F.when(F.col("allocated"), "allocated").otherwise("deleted")
    )
    df = fn.noise_rules(df, "display_path", "mime_type", "sig", "profile_id")
    df = df.withColumn("version", F.when(F.col("ord") % 9 == 0, "v0").otherwise("interest-score-v1"))
    df = fn.interest_score(df, "display_path", "signature", "noise", "profile_id", "state", version="version")
    return fn.core_categories(
        df, "display_path", "signature", "state", F.col("noise.visibility"), F.col("score.noise_score")
    )


@query(
    "c2_classify_provenance",
    f"""WITH {ENTRIES} SELECT entry_id, CASE WHEN NOT allocated THEN 'deleted'
      WHEN lower(display_path) LIKE '%.trash%' OR contains(lower(display_path), '$recycle.bin')
        OR contains(lower(display_path), 'found.000') THEN 'trashed'
      WHEN list_last(string_split(display_path, '/')) LIKE '.%' OR ord % 17 = 0 THEN 'hidden'
      WHEN ord % 19 = 0 THEN 'carved' ELSE 'allocated' END AS kind FROM entries""",
)
def c2(spark, sf):
    df = view(spark, sf, "entries")
    attrs = F.when(F.col("ord") % 17 == 0, F.array(F.lit("hidden"))).otherwise(fn.no_strings())
    kind = F.when(F.col("ord") % 19 == 0, "carved").otherwise(F.col("entry_type"))
    got = fn.provenance(F.col("display_path"), F.col("allocated"), kind, attrs)
    return df.select("entry_id", got["kind"].alias("kind"))


@query(
    "c3_content_boost",
    f"""WITH {ENTRIES} SELECT entry_id, CASE WHEN regexp_matches(lower(display_path), '/dcim/|/dcim_|100ncdng|dcim/')
        THEN 'dcim_camera_content' WHEN regexp_matches(lower(display_path), '/backup|backup/|portable_backup')
        THEN 'portable_backup_content' ELSE 'no_boost' END AS reason,
      regexp_matches(lower(display_path), '/dcim/|/dcim_|100ncdng|dcim/|/backup|backup/|portable_backup') AS boost
    FROM entries""",
)
def c3(spark, sf):
    df = view(spark, sf, "entries")
    return df.select("entry_id", F.inline(F.array(fn.content_boost(F.col("display_path")))))


_LOW = "lower(replace(display_path, '\\', '/'))"


def _rule_sql(fragments) -> str:
    return "(" + " OR ".join(f"contains({_LOW}, '{f}')" for f in fragments) + ")"


RULE_IDS = "list_filter([" + ", ".join(
    f"CASE WHEN {_rule_sql(fr)} THEN '{rid}' END" for rid, fr in NOISE_RULES
) + "], lambda x: x IS NOT NULL)"
PERSONAL = "coalesce(mime_type LIKE 'image/%' OR mime_type LIKE 'application/pdf%' OR sig = 'docx', FALSE)"
NOISE_SQL = f"""nz AS (SELECT *, {RULE_IDS} AS ids, {PERSONAL} AS personal,
      CASE WHEN ord % 6 = 0 THEN 'p' || volume_id END AS profile_id FROM entries),
    nv AS (SELECT *, CASE WHEN len(ids) = 0 THEN 'normal' WHEN personal THEN 'review' ELSE 'lower' END AS visibility FROM nz)"""


@query(
    "c4_noise_rules",
    f"""WITH {ENTRIES}, {NOISE_SQL} SELECT entry_id, visibility, array_to_string(ids, '|') AS rule_ids,
      concat_ws('|', 'profile:' || profile_id, CASE WHEN personal THEN 'personal_content_signature' END,
        CASE WHEN visibility = 'review' THEN 'noise_rule_conflict' END) AS evidence FROM nv""",
)
def c4(spark, sf):
    return scored(spark, sf).select(
        "entry_id",
        "noise.visibility",
        F.array_join("noise.rule_ids", "|").alias("rule_ids"),
        F.array_join("noise.evidence", "|").alias("evidence"),
    )


def _exact_round_sql(x: str) -> str:
    """Half-even rounding of the exact binary value to two digits."""
    v = f"(CAST({x} * 576460752303423488.0 AS HUGEINT) * 100)"
    one = "576460752303423488::HUGEINT"
    return (
        f"(({v} // {one}) + CASE WHEN ({v} % {one}) * 2 > {one} OR (({v} % {one}) * 2 = {one} AND "
        f"({v} // {one}) % 2 = 1) THEN 1 ELSE 0 END) / 100.0"
    )


_CONF = """((((CASE WHEN sig IS NOT NULL THEN 0.5::DOUBLE + least(sig_confidence::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE
      ELSE 0.5::DOUBLE - 0.15::DOUBLE END) - CASE WHEN sig IS NOT NULL AND mismatch THEN 0.1::DOUBLE ELSE 0.0 END)
      + CASE WHEN profile_id IS NOT NULL THEN 0.1::DOUBLE ELSE 0.0 END)
      + CASE WHEN visibility = 'lower' THEN 0.1::DOUBLE ELSE 0.0 END)"""
SCORE_SQL = f"""{NOISE_SQL}, sc AS (SELECT *,
      greatest(0, least(100, 10 + CASE WHEN mime_type LIKE 'image/%' OR mime_type = 'application/pdf' THEN 30
        WHEN sig = 'docx' THEN 25 WHEN sig IN ('zip', 'random', 'unknown') THEN 5 ELSE 0 END
      + CASE WHEN sig IS NOT NULL AND mismatch THEN 8 ELSE 0 END
      + CASE WHEN regexp_matches({_LOW}, '/documents/|/desktop/|/downloads/|/pictures/') THEN 20 ELSE 0 END
      + CASE WHEN profile_id IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN NOT allocated THEN 10 ELSE 0 END
      + CASE WHEN visibility = 'review' THEN 5 ELSE 0 END)) AS interest_score,
      CASE visibility WHEN 'lower' THEN 60 WHEN 'review' THEN 25 ELSE 0 END AS noise_score,
      {_exact_round_sql(_CONF)} AS conf FROM nv)"""


@query(
    "c5_interest_score",
    f"""WITH {ENTRIES}, {SCORE_SQL} SELECT entry_id, interest_score, noise_score,
      CASE WHEN ord % 9 = 0 THEN greatest(0.0, round(conf - 0.05, 2)) ELSE conf END AS confidence,
      concat_ws('|', 'scoring_version:interest-score-v1', CASE WHEN sig IS NULL THEN 'missing_signature' END,
        'signature:' || sig, CASE WHEN mime_type LIKE 'image/%' OR mime_type = 'application/pdf' THEN 'personal_mime_signal'
          WHEN sig = 'docx' THEN 'document_signal' END,
        CASE WHEN sig IS NOT NULL AND mismatch THEN 'contradictory_type_evidence' END,
        CASE WHEN regexp_matches({_LOW}, '/documents/|/desktop/|/downloads/|/pictures/') THEN 'well_known_user_path' END,
        'profile:' || profile_id, CASE WHEN NOT allocated THEN 'state:deleted' END, 'noise_ruleset:windows-noise-v1',
        CASE WHEN visibility = 'lower' THEN array_to_string(list_transform(ids, lambda x: 'noise_rule:' || x), '|')
          WHEN visibility = 'review' THEN 'noise_conflict_review' END,
        CASE WHEN ord % 9 = 0 THEN 'migrated_from:v0' END) AS evidence FROM sc""",
)
def c5(spark, sf):
    return scored(spark, sf).select(
        "entry_id",
        "score.interest_score",
        "score.noise_score",
        "score.confidence",
        F.array_join("score.evidence", "|").alias("evidence"),
    )


def _any(col: str, *frs: str) -> str:
    return "(" + " OR ".join(f"contains({col}, '{f}')" for f in frs) + ")"


CATEGORY_SQL = f"""{SCORE_SQL}, px AS (SELECT *, lower(trim(replace(display_path, '\\', '/'), '/')) AS p FROM sc),
    x AS (SELECT *, regexp_extract(list_last(string_split(p, '/')), '^.+(\\.[^.]+)$', 1) AS x FROM px),
    raw AS (
      SELECT entry_id, 'unknown' AS category, 'missing_signature' AS reason FROM x WHERE sig IS NULL
      UNION ALL SELECT entry_id, 'media', 'mime:' || mime_type FROM x WHERE mime_type LIKE 'image/%'
      UNION ALL SELECT entry_id, 'documents', 'document_signal:' || coalesce(mime_type, x) FROM x WHERE sig IS NOT NULL
        AND (mime_type = 'application/pdf' OR sig = 'docx' OR x IN ('.txt', '.rtf', '.odt'))
      UNION ALL SELECT entry_id, 'archives', 'archive_signal:' || sig FROM x
        WHERE mime_type = 'application/zip' OR sig = 'zip' OR (sig IS NOT NULL AND x IN ('.7z', '.rar', '.tar', '.gz'))
      UNION ALL SELECT entry_id, 'unknown', 'signature:' || sig FROM x WHERE sig IN ('unknown', 'empty')
      UNION ALL SELECT entry_id, 'corrupted', 'contradictory_type_evidence' FROM x WHERE sig IS NOT NULL AND mismatch
      UNION ALL SELECT entry_id, 'messages/email', 'path_or_extension:' || coalesce(nullif(x, ''), 'mail_path') FROM x
        WHERE x IN ('.eml', '.msg', '.mbox', '.pst', '.ost') OR {_any("p", "mail", "outlook")}
      UNION ALL SELECT entry_id, 'browser', 'browser_path' FROM x
        WHERE {_any("p", "browser", "chrome/user data", "firefox/profiles", "edge/user data")}
      UNION ALL SELECT entry_id, 'backups/mobile', 'backup_signal:' || coalesce(nullif(x, ''), 'path') FROM x
        WHERE {_any("p", "backup", "filehistory", "time machine", "mobilebackup")}
          OR x IN ('.bkf', '.bak', '.vhd', '.vhdx', '.vmdk', '.qcow2', '.ipa', '.ab')
      UNION ALL SELECT entry_id, 'wallets/vaults/keys', 'sensitive_artifact_signal:' || coalesce(nullif(x, ''), 'path') FROM x
        WHERE {_any("p", "wallet", "keystore", "vault", "private key", ".ssh")} OR x IN ('.key', '.pem', '.p12', '.pfx', '.kdbx')
      UNION ALL SELECT entry_id, 'software/code/databases', 'software_code_db_signal:' || coalesce(sig, x) FROM x
        WHERE x IN ('.exe', '.dll', '.sys', '.py', '.js', '.ts', '.json', '.db', '.sqlite', '.sqlite3', '.mdb')
      UNION ALL SELECT entry_id, 'deleted/carved', 'state:deleted' FROM x WHERE NOT allocated
      UNION ALL SELECT entry_id, 'system/noise', 'noise_visibility:' || visibility FROM x WHERE visibility IN ('lower', 'review')),
    cats AS (SELECT entry_id, category, reason FROM raw UNION ALL
      SELECT entry_id, 'unknown', 'no_category_signal' FROM x WHERE entry_id NOT IN (SELECT entry_id FROM raw))"""


@query(
    "c6_core_categories",
    f"""WITH {ENTRIES}, {CATEGORY_SQL} SELECT entry_id, category, count(DISTINCT reason) AS reasons,
      string_agg(DISTINCT reason, '|' ORDER BY reason) AS evidence,
      least(0.95, round(0.55 + 0.1 * count(DISTINCT reason), 2)) AS confidence FROM cats GROUP BY ALL""",
)
def c6(spark, sf):
    one = scored(spark, sf).select("entry_id", F.inline_outer("categories"))
    return one.select(
        "entry_id",
        "category",
        F.size("evidence").alias("reasons"),
        F.array_join(F.array_sort("evidence"), "|").alias("evidence"),
        "confidence",
    )


PROTECTED = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'v/' || p_name || '.kdbx' WHEN 1 THEN 'm/' || p_name || '.GPG'
      WHEN 2 THEN 'c/Wallet.dat' WHEN 3 THEN 'k/UTC--2019/' || p_name ELSE 'd/' || p_name || '.bin' END AS path,
    CASE p_size % 5 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'application/msword'
      WHEN 3 THEN 'application/vnd.rar' ELSE 'text/plain' END AS mime,
    CASE WHEN p_size % 7 = 0 THEN '' ELSE 'sig' END AS sig,
    p_retailprice / 300.0 AS entropy, p_size % 13 = 0 AS corrupt, p_size % 11 = 0 AS unsupported,
    p_brand IN ('Brand#2', 'Brand#7', 'Brand#11', 'Brand#19') AS encrypted, p_type = 'PROMO' AS password,
    p_type = 'LARGE' AS whole, CASE WHEN p_type = 'SMALL' THEN 'x.doc' END AS original,
    CASE WHEN p_size % 6 = 0 THEN repeat(p_name, 20) || '-format' END AS given FROM """


@query(
    "c7_protected_kind",
    f"""WITH t AS ({PROTECTED} part), s AS (SELECT *, lower(path) AS low, regexp_extract(list_last(string_split(lower(path), '/')),
        '^.+(\\.[^.]+)$', 1) AS x FROM t),
    k AS (SELECT *, CASE WHEN corrupt THEN 'unknown' WHEN unsupported THEN 'unsupported'
      WHEN encrypted OR password THEN CASE WHEN mime IN ('application/zip', 'application/vnd.rar') THEN 'encrypted-archive'
        WHEN mime = 'application/pdf' THEN 'encrypted-pdf' WHEN mime = 'application/msword' THEN 'encrypted-office-document'
        ELSE 'encrypted-artifact' END
      WHEN x = '.kdbx' THEN 'password-vault' WHEN x = '.gpg' THEN 'encrypted-message'
      WHEN {_any("low", "wallet.dat", "keystore", "utc--", "electrum")} THEN 'wallet-or-keystore'
      WHEN whole THEN 'whole-volume-encryption' WHEN entropy >= 7.5 THEN 'weak' ELSE 'none' END AS kind FROM s)
    SELECT p_partkey, CASE kind WHEN 'weak' THEN 'unknown' ELSE kind END AS protection_kind,
      kind NOT IN ('unknown', 'unsupported', 'weak', 'none') AS protected,
      CASE kind WHEN 'encrypted-archive' THEN 0.95 WHEN 'encrypted-pdf' THEN 0.95 WHEN 'encrypted-office-document' THEN 0.92
        WHEN 'encrypted-artifact' THEN 0.75 WHEN 'password-vault' THEN 0.82 WHEN 'encrypted-message' THEN 0.82
        WHEN 'wallet-or-keystore' THEN 0.78 WHEN 'whole-volume-encryption' THEN 0.9 WHEN 'weak' THEN 0.2 ELSE 0.0 END AS confidence,
      CASE WHEN corrupt THEN 'corrupt_protection_header' WHEN kind = 'unsupported' THEN 'unsupported_encryption_format'
        WHEN kind = 'weak' THEN 'high_entropy_weak_evidence_only'
        WHEN kind = 'none' AND original IS NOT NULL AND x <> '.doc' THEN 'renamed_format_evidence' ELSE '' END AS warnings,
      CASE WHEN given IS NOT NULL THEN given WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime = 'application/zip' THEN 'zip' WHEN x <> '' THEN substr(x, 2)
        ELSE coalesce(nullif(sig, ''), 'unknown') END AS format_name FROM k""",
)
def c7(spark, sf):
    df = run_sql(spark, sf, PROTECTED + "{part}")
    meta = F.struct(
        F.col("corrupt"),
        F.col("unsupported").alias("unsupported_encryption"),
        F.col("encrypted"),
        F.col("password").alias("password_required"),
        F.lit(None).cast("string").alias("wallet_family"),
        F.col("whole").alias("whole_volume"),
        F.col("given").alias("format"),
        F.col("original").alias("original_name"),
        F.lit(None).cast("array<string>").alias("warnings"),
    )
    out = fn.protected_kind(df.withColumn("meta", meta), "path", "mime", "sig", "meta", "entropy")
    return out.select(
        "p_partkey",
        "protection.protection_kind",
        "protection.protected",
        "protection.confidence",
        F.array_join("protection.warnings", "|").alias("warnings"),
        F.col("protection_format").alias("format_name"),
    )


FLAGS = """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '$MFT' ELSE p_name END AS display_name,
    CASE WHEN p_partkey % 20 = 0 THEN '$Recycle.Bin/S-1/$R' || CAST(p_partkey AS STRING) ELSE 'd/' || p_name END AS display_path,
    CASE WHEN p_size % 9 = 0 THEN 'ads' END AS alternate_stream,
    p_size % 2 = 0 AS resident, p_size % 3 = 0 AS compressed, CASE WHEN p_size % 5 = 0 THEN TRUE END AS sparse,
    p_size % 7 = 0 AS hidden, p_size % 11 = 0 AS is_links, CASE WHEN p_size % 13 = 0 THEN '0xA' END AS reparse_tag,
    CASE WHEN p_size % 4 = 0 THEN 'DOS~1' END AS dos_name FROM """


@query(
    "c16_ntfs_flags",
    f"""WITH t AS ({FLAGS} part) SELECT p_partkey, concat_ws('|', 'archive', CASE WHEN resident THEN 'ntfs_resident' END,
      CASE WHEN compressed THEN 'ntfs_compressed' END, CASE WHEN sparse THEN 'ntfs_sparse' END, CASE WHEN hidden THEN 'hidden' END,
      CASE WHEN alternate_stream IS NOT NULL THEN 'ntfs_alternate_data_stream' END, CASE WHEN is_links THEN 'ntfs_hard_link' END,
      CASE WHEN display_name = '$MFT' THEN 'ntfs_metadata_file' END, CASE WHEN dos_name IS NOT NULL THEN 'ntfs_dos_name' END,
      CASE WHEN display_path LIKE '$Recycle.Bin/%' THEN 'ntfs_recycle_bin_record' END) AS attributes,
      concat_ws('|', CASE WHEN is_links THEN 'host_link_not_followed' END,
      CASE WHEN reparse_tag IS NOT NULL THEN 'reparse_point_not_followed' END) AS warnings FROM t""",
)
def c16(spark, sf):
    df = run_sql(spark, sf, FLAGS + "{part}")
    facts = F.struct(
        "resident",
        "compressed",
        "sparse",
        F.lit(None).cast("boolean").alias("reparse_point"),
        "hidden",
        F.lit(False).alias("system"),
        "reparse_tag",
        F.when(F.col("is_links"), F.array(F.lit("other"))).alias("hard_links"),
        "dos_name",
        F.lit(False).alias("metadata_file"),
        F.lit(None).cast("string").alias("recycle_bin_original_path"),
    )
    df = df.withColumn("facts", facts).withColumn("attributes", F.array(F.lit("archive")))
    out = fn.ntfs_flags(df.withColumn("warnings", fn.no_strings()))
    return out.select(
        "p_partkey",
        F.array_join("attributes", "|").alias("attributes"),
        F.array_join("warnings", "|").alias("warnings"),
    )


@query(
    "c16_fat_flags",
    """SELECT p_partkey, concat_ws('|', 'fat32', CASE WHEN p_size % 3 = 0 THEN 'deleted_entry' END,
        CASE WHEN p_brand <> p_name THEN 'fat_long_name' END, CASE WHEN p_size % 4 = 0 THEN 'fat_short_name' END,
        CASE WHEN p_size % 25 = 0 THEN 'volume_label' END, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'cluster_chain:complete'
          WHEN 2 THEN 'cluster_chain:corrupt' WHEN 3 THEN 'cluster_chain:corrupt' WHEN 4 THEN 'cluster_chain:truncated'
          ELSE 'cluster_chain:complete' END) AS attributes,
      concat_ws('|', CASE p_size % 6 WHEN 2 THEN 'fat_bad_cluster' WHEN 3 THEN 'fat_cluster_loop_bounded'
          WHEN 4 THEN 'fat_cluster_chain_bounded' END, CASE WHEN p_size % 2 = 0 THEN 'fat_timestamp_timezone_ambiguous' END) AS warnings,
      CASE p_size % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 2 END AS clusters,
      CASE WHEN p_size % 25 = 0 THEN 'virtual' ELSE 'file' END AS entry_type FROM part""",
)
def c16_fat(spark, sf):
    df = run_sql(
        spark,
        sf,
        """SELECT p_partkey, p_name AS display_name, p_size % 3 <> 0 AS allocated, 'file' AS entry_type,
             CAST(array() AS ARRAY<STRING>) AS attributes, CAST(array() AS ARRAY<STRING>) AS warnings,
             named_struct('filesystem', 'fat32', 'long_name', p_brand,
               'short_name', CASE WHEN p_size % 4 = 0 THEN 'S~1' END,
               'volume_label', CASE WHEN p_size % 25 = 0 THEN 'LABEL' END,
               'has_timestamps', p_size % 2 = 0,
               'cluster_chain', transform(CASE p_size % 6 WHEN 0 THEN CAST(array() AS ARRAY<BIGINT>)
                 WHEN 1 THEN array(5L, 6L, 7L, 4294967295L) WHEN 2 THEN array(5L, 1L, 9L) WHEN 3 THEN array(5L, 6L, 5L)
                 WHEN 4 THEN array(2L, 3L, 4L, 5L, 6L, 7L) ELSE array(p_partkey + 2, p_partkey + 3) END, x -> x)) AS facts
           FROM {part}""",
    )
    out = fn.fat_flags(df, max_clusters=4)
    return out.select(
        "p_partkey",
        F.array_join("attributes", "|").alias("attributes"),
        F.array_join("warnings", "|").alias("warnings"),
        F.size("chain.clusters").alias("clusters"),
        "entry_type",
    )


@query(
    "c17_extraction_state",
    """WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag <> 'R' AS alloc,
        CASE l_linenumber WHEN 7 THEN 'directory' WHEN 6 THEN 'deleted' ELSE 'file' END AS kind,
        CASE WHEN l_partkey % 10 = 0 THEN 0 WHEN l_partkey % 10 = 1 THEN NULL ELSE l_partkey * 10 END AS size,
        CASE WHEN l_suppkey % 8 = 0 THEN 0 ELSE l_partkey * 9 + l_suppkey END AS ext, l_suppkey % 8 = 0 AS no_ext,
        l_partkey * 9 AS got FROM lineitem),
      c AS (SELECT *, coalesce(size, ext) AS want FROM t),
      s AS (SELECT *, CASE WHEN size = 0 THEN 'complete' WHEN no_ext THEN 'skipped:metadata_only' WHEN want > 15000 THEN 'skipped:size_limit_exceeded'
        WHEN got < want THEN 'partial:short_read' ELSE 'complete' END AS content FROM c)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
      CASE WHEN NOT alloc THEN 'skipped:not_allocated' WHEN kind = 'directory' THEN 'skipped:metadata_only' ELSE content END AS extraction,
      CASE WHEN alloc THEN 'allocated_not_deleted' WHEN kind = 'directory' THEN 'metadata_only' WHEN no_ext THEN 'unrecoverable'
        WHEN content = 'complete' THEN 'intact' WHEN content LIKE 'partial%' THEN 'partial' ELSE 'deferred_size_limit' END AS recovery FROM s""",
)
def c17(spark, sf):
    df = run_sql(
        spark,
        sf,
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag <> 'R' AS allocated,
             CASE l_linenumber WHEN 7 THEN 'directory' WHEN 6 THEN 'deleted' ELSE 'file' END AS entry_type,
             CASE WHEN l_partkey % 10 = 0 THEN 0 WHEN l_partkey % 10 = 1 THEN NULL ELSE l_partkey * 10 END AS size_bytes,
             CASE WHEN l_suppkey % 8 = 0 THEN CAST(array() AS ARRAY<STRUCT<length_bytes: BIGINT>>)
               ELSE array(named_struct('length_bytes', l_partkey * 9), named_struct('length_bytes', l_suppkey)) END AS extents
           FROM {lineitem}""",
    )
    extraction, recovery = fn.extraction_state(15000, F.col("l_partkey") * 9)
    return df.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.concat_ws(":", extraction["state"], extraction["reason"]).alias("extraction"),
        recovery["state"].alias("recovery"),
    )
