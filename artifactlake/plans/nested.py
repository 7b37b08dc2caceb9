"""Bindings of the array and text-shaping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested as op
from ..registry import query
from .bindings import run_sql, table


@query(
    "x1_chunk_text",
    """WITH c AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1
        ELSE CAST(ceil((length(text) - 50) / 450.0) AS BIGINT) END)) AS chunk FROM documents WHERE length(text) > 0)
    SELECT doc_id, chunk, substr(text, CAST(chunk * 450 + 1 AS BIGINT), 500) AS chunk_text FROM c""",
)
def x1(spark, sf):
    return op.chunk_text(table(spark, sf, "documents"), "text", 500, 50).select("doc_id", "chunk", "chunk_text")


def _pack_sql(key: str) -> str:
    """Sequential packing as a recursive walk, one step per row of the longest queue."""
    return f"""WITH RECURSIVE s AS (SELECT doc_id, {key} AS queue, octet_length(encode(text)) AS b FROM documents),
      o AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY doc_id) AS pos FROM s WHERE b <= 20000),
      r AS (SELECT doc_id, queue, pos, 1::BIGINT AS batch, 1 AS n, b AS size FROM o WHERE pos = 1
        UNION ALL SELECT o.doc_id, o.queue, o.pos, CASE WHEN r.n >= 6 OR r.size + o.b > 20000 THEN r.batch + 1 ELSE r.batch END,
          CASE WHEN r.n >= 6 OR r.size + o.b > 20000 THEN 1 ELSE r.n + 1 END,
          CASE WHEN r.n >= 6 OR r.size + o.b > 20000 THEN o.b ELSE r.size + o.b END
        FROM r JOIN o ON o.queue = r.queue AND o.pos = r.pos + 1)
      SELECT doc_id, queue, batch FROM r"""


def _packed(spark, sf, key: str, limit: int):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(key).alias("queue"), F.octet_length("text").alias("n"))
    return op.pack_batches(docs, ["queue"], ["doc_id"], F.col("n"), 6, 20000, limit)


@query("x2_pack_batches", _pack_sql("source"))
def x2(spark, sf):
    return _packed(spark, sf, "source", 100_000)[0].select("doc_id", "queue", "batch")


# the way for queues too long for one task
@query("x2_pack_batches_long", _pack_sql("lang"))
def x2_long(spark, sf):
    return _packed(spark, sf, "lang", 100)[0].select("doc_id", "queue", "batch")


@query("x2_oversized", "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 20000")
def x2_oversized(spark, sf):
    return _packed(spark, sf, "source", 100_000)[1].select("doc_id")


@query(
    "x3_flatten_tree",
    """SELECT n_regionkey AS tree_id, 'N ' || n_name AS name, 'http://n/' || n_nationkey AS url,
      CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 4 END AS depth FROM nation
    UNION ALL SELECT r_regionkey, 'R ' || r_name, 'http://r/' || r_regionkey, 2 FROM region""",
)
def x3(spark, sf):
    # region folder > url, plain folder of even nations, folder in folder of odd nations
    leaf = """concat('{"type":"url","name":"N ', n_name, '","url":"http://n/', CAST(n_nationkey AS STRING), '"}')"""
    trees = run_sql(
        spark,
        sf,
        f"""SELECT r_regionkey, concat('{{"roots":{{"bar":{{"type":"folder","children":[{{"type":"url","name":"R ', r_name,
              '","url":"http://r/', CAST(r_regionkey AS STRING), '"}},{{"type":"folder","children":[', coalesce(even, ''), ']}},{{"type":"folder","children":[{{"type":"folder","children":[',
              coalesce(odd, ''), ']}}]}}]}},"other":{{"type":"url"}}}}}}') AS doc
            FROM {{region}} LEFT JOIN (SELECT n_regionkey,
              array_join(array_sort(collect_list(CASE WHEN n_nationkey % 2 = 0 THEN {leaf} END)), ',') AS even,
              array_join(array_sort(collect_list(CASE WHEN n_nationkey % 2 = 1 THEN {leaf} END)), ',') AS odd
              FROM {{nation}} GROUP BY n_regionkey) n ON n.n_regionkey = r_regionkey""",
    )
    out = op.flatten_tree(trees, "r_regionkey", "doc")
    return out.select("tree_id", "name", "url", F.size("path").alias("depth"))


@query(
    "x3_tree_rejects",
    """SELECT c_custkey AS tree_id, CASE c_custkey % 6 WHEN 1 THEN 'unparsable' WHEN 2 THEN 'no_text'
      WHEN 3 THEN 'no_roots' WHEN 5 THEN 'unparsable' END AS reason FROM customer WHERE c_custkey % 6 IN (1, 2, 3, 5)""",
)
def x3_rejects(spark, sf):
    # whole, cut off, missing, without roots, with empty roots, too deep
    trees = run_sql(
        spark,
        sf,
        """SELECT c_custkey, CASE c_custkey % 6
             WHEN 0 THEN concat('{"roots":{"bar":{"type":"url","name":"', c_name, '"}}}')
             WHEN 1 THEN concat('{"roots":{"bar":{"type":"url","name":"', c_name)
             WHEN 3 THEN concat('{"name":"', c_name, '"}') WHEN 4 THEN '{"roots":{}}'
             WHEN 5 THEN concat('{"roots":{"bar":', repeat('[', 1200), repeat(']', 1200), '}}') END AS doc
           FROM {customer}""",
    )
    return op.tree_rejects(trees, "c_custkey", "doc")


@query(
    "x4_flatten_tabs",
    """WITH t AS (SELECT conv_id, turn // 3 AS w, turn % 3 AS p, role, text, turn, count(*) OVER (PARTITION BY conv_id, turn // 3) AS n FROM conversations),
    c AS (SELECT conv_id, w, greatest(1, least(CAST(conv_id % 5 AS BIGINT), max(n))) AS at FROM t GROUP BY conv_id, w)
    SELECT t.conv_id, t.w + 1 AS window, 1 AS tab, 'http://c/' || t.turn AS url, t.role AS title FROM t JOIN c ON c.conv_id = t.conv_id AND c.w = t.w AND t.p + 1 = c.at""",
)
def x4(spark, sf):
    turns = table(spark, sf, "conversations")
    entry = F.struct(
        "turn", F.concat(F.lit("http://c/"), F.col("turn").cast("string")).alias("url"), F.col("role").alias("title")
    )
    # a window holds three turns, a conversation a handful of windows
    tabs = turns.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("w")).agg(
        F.array(
            F.struct(
                (F.col("conv_id") % 5).cast("int").alias("index"), F.array_sort(F.collect_list(entry)).alias("entries")
            )
        ).alias("tabs")
    )
    sessions = tabs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("w", "tabs"))).alias("windows"))
    return op.flatten_tabs(sessions, "conv_id")


@query(
    "x5_flatten_entries",
    """SELECT event_id, ordinal, CASE ordinal WHEN 1 THEN 'http://e/' || event_id ELSE '' END AS url,
      CASE ordinal WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'http://e/' || event_id ELSE event_type END ELSE 'k' || user_id END AS cache_key
    FROM events, (VALUES (1), (2)) v(ordinal)""",
)
def x5(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT event_id, array(named_struct('url', 'http://e/' || event_id, 'key', CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END),
             named_struct('url', NULL, 'key', 'k' || user_id)) AS entries FROM {events}""",
    )
    return op.flatten_entries(rows, "event_id")


@query(
    "x6_flatten_extensions",
    """SELECT event_id, 'ext' || user_id AS extension_id, event_type AS name, '1.' || (event_id % 4) AS version, '' AS install_path,
        event_id % 3 = 1 AS enabled FROM events
    UNION ALL SELECT event_id, 'other', 'other', '', '/x', FALSE FROM events""",
)
def x6(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT event_id, concat('{"ext', user_id, '":{"name":"', event_type, '","version":"1.', event_id % 4, '","state":', event_id % 3,
             '},"other":{"name":"","path":"/x"}}') AS doc FROM {events}""",
    )
    return op.flatten_extensions(rows, "event_id", "doc")


@query(
    "x7_child_volumes",
    """WITH i AS (SELECT o_orderkey, 'img-' || o_orderkey AS source_id, CASE WHEN o_custkey % 2 = 0 THEN 'img-' || o_custkey END AS parent_id,
        CASE o_orderstatus WHEN 'P' THEN NULL ELSE lower(o_orderstatus) END AS kind, o_orderkey % 3 AS depth FROM orders)
    SELECT source_id, parent_id, coalesce(kind, 'raw') AS kind, depth, NULL AS filesystem, 'container_image' AS finding_type FROM i
    UNION ALL SELECT source_id || '-v' || v, source_id, 'child_volume', depth + 1, CASE WHEN v = 2 THEN 'unknown' ELSE 'ntfs' END, 'child_volume'
    FROM i, (VALUES (1), (2)) x(v) WHERE o_orderkey % 4 <> 0""",
)
def x7(spark, sf):
    rows = run_sql(
        spark,
        sf,
        """SELECT 'img-' || o_orderkey AS source_id, CASE WHEN o_custkey % 2 = 0 THEN 'img-' || o_custkey END AS parent_id,
             CASE o_orderstatus WHEN 'P' THEN NULL ELSE lower(o_orderstatus) END AS kind, CAST(o_orderkey % 3 AS INT) AS depth,
             CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE array(named_struct('filesystem', 'ntfs'), named_struct('filesystem', NULL)) END AS volumes
           FROM {orders}""",
    )
    return op.child_volumes(rows)
