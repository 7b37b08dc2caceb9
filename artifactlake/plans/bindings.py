"""Catalog-shaped views of the supplied tables.

Each view is one portable SELECT. Queries run it through Spark; the check SQL prepends the same
text as a CTE, so both sides start from equal rows and only the operator itself is compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

VIEWS = {
    # orders as findings, lineitem as their evidence
    "findings": """
        SELECT 'f' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS finding_id,
               'case-' || CAST(o_custkey % 50 AS STRING) AS case_id,
               'e' || CAST(o_orderkey AS STRING) AS entry_id,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE 'p' || CAST(o_orderkey % 2000 AS STRING) END AS content_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'document' WHEN '2' THEN 'photo'
                    WHEN '3' THEN 'video' WHEN '4' THEN 'archive' ELSE 'other' END AS finding_type,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high'
                    WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
               'Order ' || CAST(o_orderkey AS STRING) || ' ' || o_orderpriority AS title,
               'customer_' || CAST(o_custkey AS STRING) || ' 100% ' || o_orderstatus AS summary,
               CASE o_orderstatus WHEN 'P' THEN 'new' WHEN 'F' THEN 'reviewed'
                    ELSE 'dismissed' END AS status,
               o_totalprice / 600000.0 AS confidence,
               o_orderdate AS created_at
        FROM {orders}""",
    "evidence": """
        SELECT 'f' || lpad(CAST(l_orderkey AS STRING), 12, '0') AS finding_id,
               'v' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
                   || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS evidence_id,
               CASE l_returnflag WHEN 'R' THEN 'metadata' WHEN 'A' THEN 'signature'
                    ELSE 'hash' END AS evidence_kind,
               CASE WHEN l_partkey % 5 = 0 THEN NULL
                    ELSE 'p' || CAST(l_partkey AS STRING) END AS content_id,
               CASE l_linenumber WHEN 1 THEN '{"system_noise":true}'
                    WHEN 2 THEN '{"system_noise":1}' WHEN 3 THEN '{"system_noise":"1"}'
                    WHEN 4 THEN '{"system_noise":1.0}' WHEN 5 THEN '{"system_noise":false}'
                    ELSE '{"note":"none"}' END AS data_json,
               l_shipdate AS created_at
        FROM {lineitem}""",
    # events as browser artifacts: several JSON shapes, some without an observation time
    "artifacts": """
        SELECT 'a' || lpad(CAST(event_id AS STRING), 10, '0') AS browser_artifact_id,
               'case-' || CAST(user_id % 20 AS STRING) AS case_id,
               CASE WHEN event_id % 4 = 0 THEN NULL
                    ELSE 'p' || CAST(event_id % 2000 AS STRING) END AS content_id,
               'profile-' || CAST(user_id AS STRING) AS profile_id,
               CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'bookmark'
                    WHEN 'purchase' THEN 'download' WHEN 'signup' THEN 'search'
                    ELSE 'session_tab' END AS artifact_kind,
               CASE event_id % 3 WHEN 0 THEN 'chromium' WHEN 1 THEN 'firefox'
                    ELSE 'safari' END AS browser_family,
               CASE event_id % 4
                    WHEN 0 THEN '{"url":"https://Host' || CAST(event_id % 97 AS STRING) ||
                        '.example.org/a_b","url_normalization":{"registrable_domain":"d'
                        || CAST(event_id % 13 AS STRING) || '.org"},"os_user_id":"u'
                        || CAST(user_id % 5 AS STRING) || '"}'
                    WHEN 1 THEN '{"source_url":"http://x.example.com/100%","title":"Title '
                        || CAST(event_id AS STRING)
                        || '","source_url_normalization":{"registrable_domain":"d'
                        || CAST(event_id % 11 AS STRING)
                        || '.org"},"raw_provenance":{"os_user_id":"u'
                        || CAST(user_id % 5 AS STRING) || '"}}'
                    WHEN 2 THEN '{"query":"Find ' || event_type
                        || '","url_normalization":{"registrable_domain":""}}'
                    ELSE '{"title":"no domain"}' END AS artifact_json,
               value / 500.0 AS recovery_confidence,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts END AS first_observed_at,
               ts + INTERVAL '1' DAY AS created_at
        FROM {events}""",
    # lineitem as filesystem entry rows
    "entry_rows": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
                   || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS entry_id,
               'case-' || CAST(l_suppkey % 10 AS STRING) AS case_id,
               'vol-' || CAST(l_suppkey % 9 AS STRING) AS volume_id,
               CASE WHEN l_partkey % 3 = 0 THEN '/Users/U' || CAST(l_suppkey AS STRING)
                        || '/Documents/Report ' || CAST(l_orderkey AS STRING) || '.pdf'
                    ELSE '/Windows/System32/lib' || CAST(l_partkey AS STRING) || '.dll' END
                   AS display_path,
               'n' || CAST(l_partkey AS STRING) AS display_name,
               CASE WHEN l_partkey % 3 = 0 THEN 'documents' WHEN l_partkey % 11 = 0 THEN NULL
                    ELSE 'software' END AS category,
               CASE WHEN l_linenumber = 7 THEN NULL
                    ELSE 'u' || CAST(l_suppkey % 7 AS STRING) END AS owner_id,
               CASE WHEN l_partkey % 13 = 0 THEN NULL
                    ELSE CAST(l_quantity AS BIGINT) * 1000 END AS size_bytes,
               CAST(CAST(l_shipdate AS DATE) AS STRING) AS modified_at,
               CASE l_linestatus WHEN 'O' THEN 'allocated' ELSE 'deleted' END AS allocation,
               CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount > 0.05 END AS encrypted,
               l_tax > 0.06 AS corrupt,
               l_returnflag = 'A' AS duplicate,
               CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice / 1000.0 END
                   AS interest_score,
               CASE WHEN l_partkey % 10 = 1 THEN 'noise' WHEN l_partkey % 10 = 2 THEN 'system'
                    WHEN l_partkey % 10 = 3 THEN NULL ELSE 'normal' END AS system_noise,
               CASE WHEN l_suppkey % 6 = 0 THEN 'exported' ELSE 'pending' END AS export_state,
               CASE WHEN l_suppkey % 8 = 0 THEN TRUE WHEN l_suppkey % 8 = 1 THEN NULL
                    ELSE FALSE END AS dismissed
        FROM {lineitem}""",
    # part as rows of the findings table and tiles of the gallery
    "table_rows": """
        SELECT 'e' || lpad(CAST(p_partkey AS STRING), 9, '0') AS entry_id,
               'case-' || CAST(p_size % 4 AS STRING) AS case_id,
               p_type || '/' || p_brand || '/' || p_name AS path,
               CASE WHEN p_partkey % 9 = 0 THEN 'directory' ELSE 'file' END AS entry_type,
               CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS size_bytes,
               '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0') AS modified_at,
               CASE WHEN p_partkey % 3 = 0 THEN 'deleted' ELSE 'allocated' END AS state,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END AS interest_score,
               p_retailprice / 4000.0 AS confidence,
               lower(p_type) AS category,
               CASE WHEN p_size > 25 THEN 'exported' ELSE 'pending' END AS export_state,
               CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN ''
                    ELSE 'thumb/' || CAST(p_partkey AS STRING) END AS thumbnail_ref,
               CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size * 7 END AS thumb_width,
               CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_partkey % 90 + 1 END AS thumb_height
        FROM {part}""",
    # pages as filesystem entries: host, language and number of the URL inside typical paths
    "entries": """
        SELECT page_id AS ord, 'e' || CAST(page_id AS STRING) AS entry_id,
               'vol-' || CAST(page_id % 3 AS STRING) AS volume_id,
               CASE page_id % 20
                 WHEN 0 THEN 'Windows/System32/drivers/' || split_part(url, '/', 3) || '.sys'
                 WHEN 1 THEN 'Users/' || split_part(url, '/', 4) || '/Documents/r' || CAST(page_id AS STRING) || '.PDF'
                 WHEN 2 THEN replace('Users|' || split_part(url, '/', 4) || '|AppData|Local|Temp|'
                     || CAST(page_id AS STRING) || '.tmp', '|', chr(92))
                 WHEN 3 THEN '$Recycle.Bin/S-1-5/$R' || CAST(page_id AS STRING) || '.doc'
                 WHEN 4 THEN 'DCIM/100NCDNG/IMG' || CAST(page_id AS STRING) || '.JPG'
                 WHEN 5 THEN 'data/Backup/phone' || CAST(page_id AS STRING) || '.ab'
                 WHEN 6 THEN 'Users/' || split_part(url, '/', 4) || '/AppData/Local/Google/Chrome/User Data/Default/'
                     || CASE WHEN page_id % 3 = 0 THEN 'History' ELSE 'Cookies' END
                 WHEN 7 THEN 'Users/' || split_part(url, '/', 4) || '/AppData/Roaming/Mozilla/Firefox/Profiles/p'
                     || CAST(page_id % 4 AS STRING) || '.default/places.sqlite'
                 WHEN 8 THEN 'home/' || split_part(url, '/', 4) || '/.ssh/id_rsa'
                 WHEN 9 THEN 'Users/' || split_part(url, '/', 4) || '/Bitcoin/wallets/wallet.dat'
                 WHEN 10 THEN 'Users/' || split_part(url, '/', 4) || '/MobileSync/Backup/'
                     || CASE WHEN page_id % 7 < 3 THEN '0123456789abcdef0123456789abcdef01234567' ELSE 'moved' END
                     || CASE page_id % 3 WHEN 0 THEN '/Manifest.plist' WHEN 1 THEN '/Manifest.db' ELSE '/Status.plist' END
                 WHEN 11 THEN 'Program Files/App' || CAST(page_id % 9 AS STRING) || '/run' || CAST(page_id AS STRING) || '.exe'
                 WHEN 12 THEN 'Program Files/WindowsApps/Pkg' || CAST(page_id % 5 AS STRING) || '_1.' || CAST(page_id % 3 AS STRING) || '_x64/a.exe'
                 WHEN 13 THEN 'mail/box' || CAST(page_id AS STRING) || '.pst'
                 WHEN 14 THEN 'images/d' || CAST(page_id AS STRING) || '.vhdx/inner/f.zip/x.bak'
                 WHEN 15 THEN 'Users/' || split_part(url, '/', 4) || '/Desktop/keys/' || CAST(page_id AS STRING) || '.kdbx'
                 WHEN 16 THEN 'Windows/System32/config/SOFTWARE'
                 WHEN 17 THEN 'sdcard/Android/dev' || CAST(page_id % 4 AS STRING) || '/manifest.json'
                 WHEN 18 THEN 'Users/' || split_part(url, '/', 4) || '/fake wallet ' || CAST(page_id AS STRING) || '.txt'
                 ELSE substr(url, 8) END AS display_path,
               CASE WHEN page_id % 11 = 0 THEN 'deleted' WHEN page_id % 13 = 0 THEN 'symlink' ELSE 'file' END AS entry_type,
               page_id % 11 <> 0 AS allocated,
               CASE WHEN page_id % 4 = 0 THEN 'S-1-5-21-' || CAST(page_id % 5 AS STRING) END AS owner_id,
               CASE page_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/zip'
                 WHEN 3 THEN 'text/plain' WHEN 4 THEN 'application/octet-stream' WHEN 5 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
                 END AS mime_type,
               CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'zip' WHEN 3 THEN 'text'
                 WHEN 4 THEN 'unknown' WHEN 5 THEN 'docx' END AS sig,
               CASE page_id % 7 WHEN 0 THEN 0.98 WHEN 1 THEN 0.98 WHEN 2 THEN 0.9 WHEN 3 THEN 0.8 WHEN 4 THEN 0.2
                 WHEN 5 THEN 0.92 END AS sig_confidence,
               page_id % 5 = 0 AS mismatch
        FROM {pages}""",
    # events as the per-case event log; user_id plays the case
    "event_log": """
        SELECT event_id, user_id AS case_id, event_type, props AS payload_json, ts AS created_at,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL '1' HOUR END AS published_at
        FROM {events}""",
}

_HOLE = re.compile(r"\{([a-z]+)\}")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Catalog-shaped view as a DataFrame."""
    return run_sql(spark, sf, VIEWS[name])


def run_sql(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    used = {n: table(spark, sf, n) for n in sorted(set(_HOLE.findall(sql)) & set(TABLES))}
    # braces of JSON literals are doubled, {table} parameters stay
    held = _HOLE.sub(lambda m: f"\x01{m[1]}\x02" if m[1] in TABLES else m[0], sql)
    text = held.replace("{", "{{").replace("}", "}}").replace("\x01", "{").replace("\x02", "}")
    return spark.sql(text, **used)


def ctes(*names: str) -> str:
    """``WITH`` list of views for check SQL (without the WITH keyword)."""
    return ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in names)


def plain(sql: str) -> str:
    return _HOLE.sub(lambda m: m.group(1) if m.group(1) in TABLES else m.group(0), sql)
