"""Bindings of the content, text and URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as fn
from ..functions.language import detect_language
from ..functions.redact import redact_fields, redact_json_keys, redact_secrets
from ..functions.rules import LANGUAGE_ACCENTS, LANGUAGE_MARKERS, SECRET_PATTERNS
from ..functions.times import epoch_to_utc
from ..functions.urls import normalize_urls, visit_collapse_key
from ..operators.entries import normalize_entries
from ..operators.paths import safe_paths
from ..registry import query
from .bindings import run_sql, table

# leading bytes put before each document, so that the magic numbers are met
HEADS = (
    ("", None, None, None),
    ("4D5A", "pe-executable", "application/x-msdownload", 0.98),
    ("FFD8FF", "jpeg", "image/jpeg", 0.98),
    ("255044462D", "pdf", "application/pdf", 0.98),
    ("89504E470D0A1A0A", "png", "image/png", 0.98),
    ("474946383961", "gif", "image/gif", 0.95),
    ("49492A00", "tiff", "image/tiff", 0.95),
    ("52415700", "raw", "image/x-dcraw", 0.8),
    ("000000206674797068656963", "heic", "image/heic", 0.92),
    ("000000206674797071742020", "quicktime", "video/quicktime", 0.92),
    ("00000020667479706D703432", "mp4", "video/mp4", 0.9),
    ("494433", "mp3", "audio/mpeg", 0.9),
    ("524946460000000057415645", "wav", "audio/wav", 0.92),
    ("504B0304776F72642F", "docx", fn._DOCX, 0.92),
    ("504B0304", "zip", "application/zip", 0.9),
    ("377ABCAF271C", "7z", "application/x-7z-compressed", 0.95),
    ("526172211A07", "rar", "application/vnd.rar", 0.95),
    ("1F8B", "gzip", "application/gzip", 0.9),
    ("7B5C727466", "rtf", "application/rtf", 0.9),
    ("46726F6D3A20610A5375626A6563743A20620A", "email", "message/rfc822", 0.86),
)
_N = len(HEADS)
_HEAD_HEX = "CASE doc_id % {n} {whens} END".format(
    n=_N, whens=" ".join(f"WHEN {i} THEN '{h[0]}'" for i, h in enumerate(HEADS))
)
NAME = "CASE doc_id % 4 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.JPG' WHEN 2 THEN 'c.txt' ELSE 'noext' END"


def _pick(index: int, quote: bool) -> str:
    q = "'" if quote else ""
    return f"CASE doc_id % {_N} " + " ".join(
        f"WHEN {i} THEN {q}{h[index]}{q}" for i, h in enumerate(HEADS) if h[0]
    )


# what a text shows that has no head before it, and a zip whose text holds an office name
OWN_KIND = """CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN starts_with(text, 'MZ') THEN 'pe-executable' WHEN starts_with(text, '%PDF-') THEN 'pdf'
      WHEN starts_with(text, 'GIF87a') OR starts_with(text, 'GIF89a') THEN 'gif' WHEN starts_with(text, 'ID3') THEN 'mp3'
      WHEN starts_with(text, '{' || chr(92) || 'rtf') THEN 'rtf' WHEN octet_length(encode(text)) < 4 THEN 'unknown' ELSE 'text' END"""
ZIP_KIND = "CASE WHEN contains(text, 'word/') THEN 'docx' WHEN contains(text, 'xl/') THEN 'xlsx' WHEN contains(text, 'ppt/') THEN 'pptx' ELSE 'zip' END"
KINDS = {h[1]: h[2:] for h in HEADS if h[0]} | {
    "text": ("text/plain", 0.8), "empty": ("application/x-empty", 1.0), "unknown": ("application/octet-stream", 0.2),
    "xlsx": (fn._XLSX, 0.92), "pptx": (fn._PPTX, 0.92),
}
_MIME = "CASE signature " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in KINDS.items()) + " END"
_BASE = "CASE signature " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in KINDS.items()) + " END"


@query(
    "c1_content_signature",
    f"""WITH t AS (SELECT doc_id, text, {_HEAD_HEX} AS head, {NAME} AS name,
        from_hex({_HEAD_HEX}) || encode(text) AS b FROM documents),
    k AS (SELECT *, CASE WHEN head = '' THEN {OWN_KIND} WHEN head = '504B0304' THEN {ZIP_KIND} ELSE {_pick(1, True)} END END AS signature FROM t),
    m AS (SELECT *, {_MIME} AS mime_type, {_BASE} AS base,
      CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/plain' END AS extension_mime,
      (CASE WHEN contains(text, 'MZ') OR head = '4D5A' THEN 1 ELSE 0 END
       + CASE WHEN contains(text, '%PDF-') OR head = '255044462D' THEN 1 ELSE 0 END
       + CASE WHEN contains(text, 'PK' || chr(3) || chr(4)) OR head LIKE '504B0304%' THEN 1 ELSE 0 END + CASE WHEN head = 'FFD8FF' THEN 1 ELSE 0 END
       + CASE WHEN head = '89504E470D0A1A0A' THEN 1 ELSE 0 END) > 1 AS poly FROM k)
    SELECT doc_id, signature, mime_type, CASE WHEN poly THEN least(base, 0.65) ELSE base END AS confidence, extension_mime,
      signature NOT IN ('pe-executable', 'unknown', 'empty') AND NOT poly AND coalesce(extension_mime = mime_type, TRUE) AS parser_safe,
      concat_ws('|', CASE WHEN signature = 'empty' THEN 'empty_content' END, 'extension:' || extension_mime, CASE WHEN extension_mime <> mime_type THEN 'extension_mismatch' END,
        CASE WHEN poly THEN 'polyglot_signature' END,
        CASE WHEN signature = 'unknown' THEN 'unknown_magic' END) AS evidence,
      sha256(b) AS sample_sha256, octet_length(b) AS sample_size FROM m""",
)
def c1(spark, sf):
    df = run_sql(
        spark, sf, f"SELECT doc_id, concat(unhex({_HEAD_HEX}), CAST(text AS BINARY)) AS b, {NAME} AS name FROM {{documents}}"
    )
    out = fn.content_signature(df, "b", "name", sample_limit=None)
    return out.select("doc_id", "signature.*").withColumn("evidence", F.array_join("evidence", "|"))


@query(
    "c1_page_signature",
    """SELECT page_id, 'text' AS signature, sha256(html) AS sample_sha256, octet_length(encode(html)) AS sample_size FROM pages""",
)
def c1_pages(spark, sf):
    df = table(spark, sf, "pages").select("page_id", "url", F.col("html").cast("binary").alias("b"))
    out = fn.content_signature(df, "b", "url", sample_limit=None)
    return out.select(
        "page_id", "signature.signature", "signature.sample_sha256", "signature.sample_size"
    )


_MARKS = sorted({w for ws in LANGUAGE_MARKERS.values() for w in ws.split()})


def _lang_sql(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in sorted(set(LANGUAGE_MARKERS[lang].split())))
    bonus = (
        f"CASE WHEN regexp_matches(joined, '[{LANGUAGE_ACCENTS[lang]}]') THEN 1 ELSE 0 END"
        if lang in LANGUAGE_ACCENTS
        else "0"
    )
    return (
        f"round_even(least(1.0, (len(list_filter(tok, lambda t: t IN ({words}))) + {bonus}) / base), 2) AS s_{lang}"
    )


_LANGS = sorted(LANGUAGE_MARKERS)
LANG_SQL = f"""t AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ'']+'),
        lambda w: trim(lower(w), '''')), lambda w: length(w) > 1) AS tok FROM documents),
    u AS (SELECT *, array_to_string(tok, ' ') AS joined, greatest(4, least(len(tok), 20)) AS base,
      length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS alpha, length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) AS digits,
      length(regexp_replace(text, '[\\s\\x0b\\x{{85}}\\x{{a0}}\\p{{Z}}]', '', 'g')) AS visible,
      length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s\\x0b\\x{{85}}\\x{{a0}}\\p{{Z}}]', '', 'g')) AS punct FROM t),
    s AS (SELECT *, {", ".join(_lang_sql(lang) for lang in _LANGS)} FROM u),
    r AS (SELECT *, list_sort([{", ".join(f"{{'r': -s_{lang}, 'l': '{lang}'}}" for lang in _LANGS)}]) AS ranked FROM s),
    w AS (SELECT *, -ranked[1].r AS best, ranked[1].l AS l1, -ranked[2].r AS second, ranked[2].l AS l2,
      CASE WHEN visible = 0 OR digits > alpha OR punct > alpha * 2 THEN 'low_language_signal'
        WHEN alpha < 20 OR len(tok) < 4 THEN 'short_text' WHEN -ranked[1].r < 0.35 THEN 'low_confidence_language' END AS why FROM r)"""


@query(
    "c8_detect_language",
    f"""WITH {LANG_SQL} SELECT doc_id, CASE WHEN why IS NULL THEN 'complete' ELSE 'unknown' END AS status,
      CASE WHEN why IS NOT NULL THEN 'unknown' WHEN second >= best * 0.55 THEN 'mixed' ELSE l1 END AS primary_language,
      CASE WHEN why IS NULL THEN best ELSE 0.0 END AS confidence, alpha AS sample_size,
      CASE WHEN why IS NOT NULL THEN why ELSE concat_ws('|', CASE WHEN second >= best * 0.55 THEN 'mixed_language:' || l1 || '+' || l2 END,
        CASE WHEN contains(lower(text), 'ocr') OR contains(lower(text), 'confidence') THEN 'ocr_noise_tolerated' END) END AS warnings FROM w""",
)
def c8(spark, sf):
    out = detect_language(table(spark, sf, "documents"), "text")
    return out.select(
        "doc_id",
        "language.status",
        "language.primary_language",
        "language.confidence",
        "language.sample_size",
        F.array_join("language.warnings", "|").alias("warnings"),
    )


def _redact_sql(base: str) -> tuple[str, str]:
    """Chain of CTEs that applies the patterns in order; RE2 has the same syntax for all of them."""
    steps, prev = [], base
    for i, p in enumerate(SECRET_PATTERNS):
        q = p.replace("'", "''")
        steps.append(
            f"r{i} AS (SELECT * REPLACE (regexp_replace(body, '{q}', '[redacted]', 'g') AS body), "
            f"regexp_matches(body, '{q}') AS p{i} FROM {prev})"
        )
        prev = f"r{i}"
    return ", ".join(steps), prev


_STEPS, _LAST = _redact_sql("d")


@query(
    "c9_redact_secrets",
    f"""WITH d AS (SELECT doc_id, text AS body FROM documents), {_STEPS}
    SELECT doc_id, body AS redacted, concat_ws('|', {", ".join(f"CASE WHEN p{i} THEN 'pattern:{i}' END" for i in range(len(SECRET_PATTERNS)))}) AS redactions FROM {_LAST}""",
)
def c9(spark, sf):
    out = redact_secrets(table(spark, sf, "documents"), "text")
    return out.select("doc_id", "redacted", F.array_join("redactions", "|").alias("redactions"))


@query(
    "c10_redact_keys",
    """SELECT event_id, CASE event_type WHEN 'view' THEN '{"Password":"[redacted]","inner":' || props || '}'
      WHEN 'click' THEN '{"a":{"api_token": "[redacted]"},"keep":"x"}' WHEN 'signup' THEN '{"my_secret":"[redacted]","u":' || user_id || '}'
      ELSE props END AS payload FROM events""",
)
def c10(spark, sf):
    df = run_sql(
        spark,
        sf,
        """SELECT event_id, CASE event_type WHEN 'view' THEN '{"Password":"p w,:' || CAST(event_id AS STRING) || '","inner":' || props || '}'
             WHEN 'click' THEN '{"a":{"api_token": 12' || CAST(user_id AS STRING) || '},"keep":"x"}'
             WHEN 'signup' THEN '{"my_secret":null,"u":' || CAST(user_id AS STRING) || '}' ELSE props END AS payload FROM {events}""",
    )
    return df.select("event_id", redact_json_keys("payload").alias("payload"))


@query(
    "c10_redact_fields",
    """SELECT event_id, '[redacted]' AS session_token, event_type AS kind, '[redacted]' AS d_password, repeat(event_type, 200) || 'x' AS d_note,
      '[redacted]' AS m_seed, repeat(props, 60) AS m_keep FROM events""",
)
def c10_fields(spark, sf):
    df = run_sql(
        spark,
        sf,
        """SELECT event_id, props AS session_token, event_type || chr(0) AS kind,
             named_struct('password', props, 'note', repeat(event_type, 200) || chr(0) || 'x') AS detail,
             map('seed_words', props, 'keep', repeat(props, 60)) AS m FROM {events}""",
    )
    return redact_fields(df).select(
        "event_id",
        "session_token",
        "kind",
        F.col("detail.password").alias("d_password"),
        F.col("detail.note").alias("d_note"),
        F.col("m")["seed_words"].alias("m_seed"),
        F.col("m")["keep"].alias("m_keep"),
    )


URLS = """SELECT page_id, CASE page_id % 10 WHEN 1 THEN replace(url, 'example.', 'Example.co.') WHEN 2 THEN replace(url, '.example.com/', '.example.com:443/')
      WHEN 3 THEN replace(url, '.example.net', '.example.NET.:8080') WHEN 4 THEN upper(substr(url, 1, 5)) || substr(url, 6)
      WHEN 5 THEN 'http://10.0.0.' || CAST(page_id % 250 AS STRING) || '/x' WHEN 6 THEN replace(url, 'example.org', 'example.co.uk')
      WHEN 7 THEN replace(url, '?', '?a=1&b=&') ELSE url END AS url FROM """
URL_SQL = f"""WITH t AS ({URLS} pages), p AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
        regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS auth FROM t),
    h AS (SELECT *, rtrim(lower(regexp_extract(auth, '^([^:]*)', 1)), '.') AS host, TRY_CAST(nullif(regexp_extract(auth, ':([0-9]+)$', 1), '') AS INT) AS port FROM p),
    n AS (SELECT *, string_split(host, '.') AS parts, CASE WHEN port IS NULL OR (scheme = 'http' AND port = 80)
      OR (scheme = 'https' AND port = 443) THEN host ELSE host || ':' || port END AS netloc,
      regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q, contains(url, '#') AS frag FROM h)"""


@query(
    "c11_normalize_urls",
    f"""{URL_SQL} SELECT page_id, scheme, host, CASE WHEN regexp_matches(host, '^[0-9.]+$') OR len(parts) <= 2 THEN host
        WHEN length(parts[-1]) = 2 AND parts[-2] IN ('co', 'com', 'edu', 'gov', 'net', 'org') THEN array_to_string(parts[-3:], '.')
        ELSE array_to_string(parts[-2:], '.') END AS registrable_domain,
      scheme || '://' || netloc AS origin, scheme || '://' || netloc || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url,
      frag AS fragment_present, CASE WHEN q = '' THEN '' ELSE array_to_string(list_transform(string_split(q, '&'),
        lambda x: split_part(x, '=', 1)), '|') END AS query_keys,
      CASE WHEN frag THEN 'fragment_omitted_from_canonical_url' ELSE '' END AS warnings FROM n""",
)
def c11(spark, sf):
    out = normalize_urls(run_sql(spark, sf, URLS + "{pages}"), "url")
    u = "url_normalization."
    return out.select(
        "page_id",
        *[u + c for c in ("scheme", "host", "registrable_domain", "origin", "canonical_url", "fragment_present")],
        F.array_join(u + "query_keys", "|").alias("query_keys"),
        F.array_join(u + "warnings", "|").alias("warnings"),
    )


@query(
    "c12_epoch_to_utc",
    """SELECT event_id, epoch_us(ts) + 11644473600000000 AS raw_chromium, epoch_us(ts) AS raw_firefox, date_trunc('second', ts) AS chromium,
      date_trunc('second', ts) AS firefox, date_trunc('milliseconds', ts) AS millis, TIMESTAMP '1970-01-01 00:00:00' AS bad FROM events""",
)
def c12(spark, sf):
    df = run_sql(
        spark,
        sf,
        "SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) + 11644473600000000 AS raw_chromium, unix_micros(CAST(ts AS TIMESTAMP)) AS raw_firefox FROM {events}",
    )
    return df.select(
        "event_id",
        "raw_chromium",
        "raw_firefox",
        F.date_trunc("second", epoch_to_utc("raw_chromium", "1601us")).alias("chromium"),
        F.date_trunc("second", epoch_to_utc("raw_firefox", "1970us")).alias("firefox"),
        epoch_to_utc(F.floor(F.col("raw_firefox") / 1000), "1970ms").alias("millis"),
        epoch_to_utc(F.lit("not a number"), "1970us").alias("bad"),
    )


@query(
    "c14_visit_collapse",
    """WITH v AS (SELECT user_id, regexp_replace(url, '#.*', '') AS canonical, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS utc
      FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages))
    SELECT 'browser-visit-collapse-' || substr(sha256(user_id || chr(0) || canonical || chr(0) || utc), 1, 32) AS visit_collapse_key,
      count(*) AS visits FROM v GROUP BY 1""",
)
def c14(spark, sf):
    pages = normalize_urls(table(spark, sf, "pages"), "url").select(
        "page_id", F.col("url_normalization.canonical_url").alias("canonical")
    )
    n_pages = pages.count()
    events = table(spark, sf, "events").withColumn("page_id", F.col("event_id") % n_pages)
    utc = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = visit_collapse_key("user_id", F.col("canonical"), utc)
    return (
        events.join(pages, "page_id")
        .groupBy(key.alias("visit_collapse_key"))
        .agg(F.count(F.lit(1)).alias("visits"))
    )


RAW_ENTRIES = """SELECT page_id AS ord, 'v' || CAST(page_id % 3 AS STRING) AS volume_id, 'o' || CAST(page_id AS STRING) AS object_id,
    CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '/../up' WHEN 2 THEN url || chr(0) || 'x' ELSE url END AS path,
    CASE page_id % 4 WHEN 0 THEN 'file.txt:stream' WHEN 1 THEN ':lead' ELSE 'name' END AS name,
    CASE page_id % 6 WHEN 0 THEN 'directory' WHEN 1 THEN 'virtual' ELSE 'file' END AS entry_type, page_id % 7 <> 0 AS allocated FROM """


@query(
    "c15_normalize_entries",
    f"""WITH t AS ({RAW_ENTRIES} pages) SELECT ord, 'entry-' || substr(sha256(volume_id || chr(0) || object_id || chr(0) || path), 1, 32) AS entry_id,
      replace(path, chr(0), '\\0') AS display_path, CASE ord % 4 WHEN 0 THEN 'stream' END AS alternate_stream,
      CASE WHEN allocated OR entry_type = 'virtual' THEN entry_type ELSE 'deleted' END AS entry_type,
      concat_ws('|', CASE WHEN ord % 5 = 2 THEN 'nul_byte' END, CASE WHEN ord % 5 = 1 THEN 'path_traversal_segment' END,
        CASE WHEN ord % 4 = 0 THEN 'alternate_stream' END) AS warnings FROM t""",
)
def c15(spark, sf):
    out = normalize_entries(run_sql(spark, sf, RAW_ENTRIES + "{pages}"))
    return out.select(
        "ord",
        "entry_id",
        "display_path",
        "alternate_stream",
        "entry_type",
        F.array_join("warnings", "|").alias("warnings"),
    )


SAFE = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN url || '/../con.txt' WHEN 2 THEN 'a/./b//' || url
      WHEN 3 THEN url || '/x' || chr(7) || 'y' WHEN 4 THEN 'dir. ./' || url || '/...' WHEN 5 THEN replace(url, '/', chr(92))
      WHEN 6 THEN repeat('é/', 700) || url ELSE 'same/same/' || url END AS path FROM """


@query(
    "c30_safe_paths",
    f"""WITH t AS ({SAFE} pages), s AS (SELECT page_id, list_filter(regexp_split_to_array(path, '[/\\\\]+'), lambda x: x NOT IN ('', '.')) AS raw FROM t),
    c AS (SELECT page_id, list_contains(raw, '..') AS up, list_filter(raw, lambda x: x <> '..') AS raw FROM s),
    n AS (SELECT *, list_transform(raw, lambda x: regexp_replace(trim(regexp_replace(x, '[\\x00-\\x1f\\x7f]', '�', 'g')), '\\.+$', '')) AS bare FROM c),
    f AS (SELECT *, list_transform(bare, lambda x: CASE WHEN x = '' THEN 'unnamed' WHEN upper(split_part(x, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL')
      THEN '_' || x ELSE x END) AS names FROM n),
    j AS (SELECT *, array_to_string(names, '/') AS joined FROM f)
    SELECT page_id, CASE WHEN strlen(joined) <= 1024 THEN joined
      ELSE concat_ws('/', nullif(regexp_extract(left(joined, list_max(list_filter(range(1, 961), lambda i: strlen(left(joined, i)) <= 959))), '(?s)^(.*)/', 1), ''),
        sha256(joined)) END AS destination_path,
      array_to_string(list_sort(list_filter([CASE WHEN up THEN 'path_traversal' END,
        CASE WHEN len(list_filter(raw, lambda x: regexp_matches(x, '[\\x00-\\x1f]'))) > 0 THEN 'control_character' END,
        CASE WHEN list_contains(bare, '') THEN 'empty_name' END,
        CASE WHEN len(list_filter(bare, lambda x: upper(split_part(x, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL'))) > 0 THEN 'reserved_name' END,
        CASE WHEN len(list_distinct(names)) < len(names) THEN 'duplicate_component' END,
        CASE WHEN octet_length(encode(joined)) > 1024 THEN 'long_path_truncated' END], lambda x: x IS NOT NULL)), '|') AS deviations FROM j""",
)
def c30(spark, sf):
    out = safe_paths(run_sql(spark, sf, SAFE + "{pages}"), "path", destination_kind="remote")
    return out.select(
        "page_id",
        "destination_path",
        F.array_join(F.array_sort("deviations"), "|").alias("deviations"),
    )
