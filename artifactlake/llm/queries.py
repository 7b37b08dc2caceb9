"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, middles, mixing, ordermin, pages, phrases, quality, rules, simhash, suffixes, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept away from training: crc32 of the id as text, modulo 3, is 1."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


@query("op1_repeated_phrases")
def op1(spark, sf_dir):
    return phrases.remove_phrases(table(spark, sf_dir, "documents"), digests=True)


@query("op2_mix_sources")
def op2(spark, sf_dir):
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


@query("op3_bpe_tokens")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], digests=True)


@query("op4_order_minhash")
def op4(spark, sf_dir):
    return ordermin.fingerprints_with_edit(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    named = langid.identify(docs, model, keep=["doc_id"])
    return named.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


@query("op7_simhash_groups")
def op7(spark, sf_dir):
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_quality_scores")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.score(docs, machine, keep=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query("op9_url_verdicts")
def op9(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(links, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op10_quality_rules")
def op10(spark, sf_dir):
    book = rules.ledger(rules.measure(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes("base")).alias("base_failed"), rules.passes("v1").alias("kept"), "n_lines", "failed_bits",
    )


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


@query("op12_fill_in_middle")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    moved = middles.restore(middles.fill_in_middle(docs))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


@query("op13_html_extraction")
def op13(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op1_repeated_phrases"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS phrase FROM w),
r AS (SELECT phrase FROM g GROUP BY phrase HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM g SEMI JOIN r USING (phrase))),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d) ANTI JOIN c USING (doc_id, j)
  GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES["op9_url_verdicts"] = f"""
WITH r(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM b
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
  arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
  coalesce(arg_max(r_verdict, length(r_host || r_path)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
GROUP BY page_id
"""

ORACLES["op10_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS ws, coalesce(text, '') AS t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS gram FROM w),
r AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g SEMI JOIN r USING (doc_id, gram))
  GROUP BY doc_id
),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM d LEFT JOIN c USING (doc_id)
),
b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  failed_bits = 0 AS kept, n_lines, failed_bits
FROM b
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
k AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4
  FROM d
),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
),
p AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

#: for pages that mark their article, with the character references of such pages
ORACLES["op13_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS part FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(part, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS bare FROM a),
c AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(bare, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&#x27;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS plain
  FROM b
),
t AS (SELECT page_id, url, trim(regexp_replace(plain, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
