"""Bindings of the ancestor, closure and constraint operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, graphs as op
from ..registry import query
from .bindings import ctes, run_sql, table, view

ENTRIES = ctes("entries")
# profile folders as owners; nested roots and an order that is not the path order
ROOTS = """SELECT DISTINCT 'Users/' || split_part(url, '/', 4) AS root_path, 'own-' || split_part(url, '/', 4) AS owner_id,
    'vol-' || CAST(page_id % 3 AS STRING) AS volume_id, CAST(1000 - ascii(split_part(url, '/', 4)) AS BIGINT) AS ord FROM {t}
  UNION ALL SELECT 'users', 'all', 'vol-1', 995"""
ROOTS_SQL = "r AS (" + ROOTS.replace("{t}", "pages") + ")"
KEYED = "lower(trim(replace({c}, '\\', '/'), '/'))"


def roots(spark, sf):
    return run_sql(spark, sf, ROOTS.replace("{t}", "{pages}"))


def _owner_sql(volume: bool) -> str:
    extra = "AND e.volume_id = r.volume_id" if volume else ""
    return f"""WITH {ENTRIES}, {ROOTS_SQL} SELECT entry_id, arg_min(r.owner_id, (r.ord, r.owner_id)) AS owner_id FROM entries e
      JOIN r ON starts_with({KEYED.replace("{c}", "e.display_path")}, {KEYED.replace("{c}", "root_path")} || '/') {extra}
      GROUP BY entry_id"""


@query("j8_owner_by_prefix", _owner_sql(False))
def j8(spark, sf):
    return op.owner_by_prefix(view(spark, sf, "entries"), _strict(spark, sf), match_volume=False)


def _strict(spark, sf):
    """Roots with a unique order, as the operator asks for."""
    return roots(spark, sf).withColumn("ord", F.struct("ord", "owner_id"))


@query("j8_owner_by_prefix_volume", _owner_sql(True))
def j8_volume(spark, sf):
    return op.owner_by_prefix(view(spark, sf, "entries"), _strict(spark, sf), match_volume=True)


@query("j8_owner_by_prefix_shuffled", _owner_sql(False))
def j8_shuffled(spark, sf):
    return op.owner_by_prefix(
        view(spark, sf, "entries"), _strict(spark, sf), match_volume=False, broadcast_rows=1
    )


MOUNTS = """SELECT '/' || split_part(url, '/', 3) || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' || split_part(url, '/', 4) END AS mount_point,
    CASE WHEN page_id % 9 = 0 THEN 'bad' ELSE '8:' || CAST(page_id % 5 AS STRING) END AS major_minor,
    CASE WHEN page_id % 4 = 0 THEN 'nfs' ELSE 'ext4' END AS fstype, page_id AS ord FROM {t}"""
PATHS = "SELECT page_id, '/' || split_part(split_part(substr(url, 9), '#', 1), '?', 1) AS path FROM "


@query(
    "j14_longest_prefix_mount",
    f"""WITH p AS ({PATHS} pages), m AS ({MOUNTS.replace("{t}", "pages")}),
    g AS (SELECT * FROM m WHERE regexp_matches(major_minor, '^[0-9]+:[0-9]+$')),
    f AS (SELECT mount_point, arg_min(major_minor, ord) AS major_minor, arg_min(fstype, ord) AS fstype FROM g GROUP BY 1),
    b AS (SELECT page_id, arg_max(struct_pack(mp := mount_point, mm := major_minor, fs := fstype), length(mount_point)) AS x
      FROM p JOIN f ON rtrim(path, '/') = mount_point OR starts_with(path, mount_point || '/') GROUP BY page_id)
    SELECT p.page_id, x.mp AS mount_point, x.mm AS major_minor, x.fs AS fstype FROM p LEFT JOIN b USING (page_id)""",
)
def j14(spark, sf):
    out = op.longest_prefix_mount(
        run_sql(spark, sf, PATHS + "{pages}"), run_sql(spark, sf, MOUNTS.replace("{t}", "{pages}"))
    )
    return out.drop("path")


@query(
    "j14_destination_separation",
    f"""WITH p AS ({PATHS} pages), m AS ({MOUNTS.replace("{t}", "pages")}),
    g AS (SELECT * FROM m WHERE regexp_matches(major_minor, '^[0-9]+:[0-9]+$')),
    f AS (SELECT mount_point, arg_min(major_minor, ord) AS major_minor, arg_min(fstype, ord) AS fstype FROM g GROUP BY 1),
    b AS (SELECT page_id, arg_max(struct_pack(mm := major_minor, fs := fstype), length(mount_point)) AS x
      FROM p JOIN f ON rtrim(path, '/') = mount_point OR starts_with(path, mount_point || '/') GROUP BY page_id)
    SELECT page_id, CASE WHEN x IS NULL THEN 'destination_not_mounted' WHEN x.fs <> 'nfs' AND x.mm IN ('8:1', '8:2')
        THEN 'destination_shares_source_physical_disk' END AS blocker,
      x IS NOT NULL AND (x.fs = 'nfs' OR x.mm NOT IN ('8:1', '8:2')) AS separate,
      CASE WHEN x.fs = 'nfs' THEN 'network_filesystem_physical_separation_not_locally_provable' END AS warning
    FROM p LEFT JOIN b USING (page_id)""",
)
def j14_separation(spark, sf):
    # devices 8:1 and 8:2 sit on disk 9:0, which is the source
    edges = run_sql(
        spark,
        sf,
        """SELECT DISTINCT CASE WHEN r_regionkey IN (1, 2) THEN '9:0' ELSE '9:1' END AS parent,
             '8:' || CAST(r_regionkey AS STRING) AS child FROM {region}""",
    )
    source = edges.where("child = '8:1'").select(F.col("parent").alias("node"))
    out = op.destination_separation(
        run_sql(spark, sf, PATHS + "{pages}"),
        run_sql(spark, sf, MOUNTS.replace("{t}", "{pages}")),
        edges,
        source,
    )
    return out.select("page_id", "blocker", "separate", "warning")


# turns as a chain, nations under regions, suppliers under nations, and one cycle
EDGES = """SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn - 1 AS STRING) AS parent,
    'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS child FROM {conversations} WHERE turn > 0
  UNION ALL SELECT 'r' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING) FROM {nation}
  UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), 's' || CAST(s_suppkey AS STRING) FROM {supplier}
  UNION ALL SELECT 's' || CAST(min(s_suppkey) AS STRING), 'r' || CAST(s_nationkey % 5 AS STRING) FROM {supplier} GROUP BY s_nationkey % 5"""
from .bindings import plain  # noqa: E402

EDGES_SQL = f"e AS ({plain(EDGES)})"


@query(
    "j15_ancestry",
    f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT child AS node, parent AS reached FROM e
      UNION SELECT r.node, e.parent FROM r JOIN e ON e.child = r.reached) SELECT node, reached FROM r""",
)
def j15(spark, sf):
    return op.ancestry(run_sql(spark, sf, EDGES))


@query(
    "j15_descendants",
    f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT parent AS node, child AS reached FROM e WHERE parent LIKE 'r%'
      UNION SELECT r.node, e.child FROM r JOIN e ON e.parent = r.reached) SELECT node, reached FROM r""",
)
def j15_down(spark, sf):
    seeds = run_sql(spark, sf, "SELECT 'r' || CAST(r_regionkey AS STRING) AS node FROM {region}")
    return op.descendants(run_sql(spark, sf, EDGES), seeds)


@query(
    "j15_shared_ancestors",
    f"""WITH RECURSIVE {EDGES_SQL}, s AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal < 200),
    r AS (SELECT node AS reached FROM s UNION SELECT e.parent FROM r JOIN e ON e.child = r.reached),
    l AS (SELECT c_custkey AS item, 'n' || c_nationkey AS node FROM customer
      UNION SELECT c_custkey, 's' || c_custkey % 100 FROM customer)
    SELECT item, bool_or(reached IS NOT NULL) AS denied,
      coalesce(string_agg(node, '|' ORDER BY node) FILTER (reached IS NOT NULL), '') AS overlap
    FROM l LEFT JOIN r ON r.reached = l.node GROUP BY item""",
)
def j15_shared(spark, sf):
    right = run_sql(spark, sf, "SELECT 's' || s_suppkey AS node FROM {supplier} WHERE s_acctbal < 200")
    left = run_sql(
        spark,
        sf,
        """SELECT c_custkey AS item, 'n' || c_nationkey AS node FROM {customer}
           UNION SELECT c_custkey, 's' || c_custkey % 100 FROM {customer}""",
    )
    out = op.shared_ancestors(left, right, run_sql(spark, sf, EDGES))
    return out.withColumn("overlap", F.array_join("overlap", "|"))


# hosts and host/language folders repeat, so parents come before and after their children
LISTED = """SELECT page_id * 2 AS ord, 'o' || CAST(page_id * 2 AS STRING) AS object_id,
    split_part(url, '/', 3) || '/' || split_part(url, '/', 4) AS path FROM {t}
  UNION ALL SELECT page_id * 2 + 1, 'o' || CAST(page_id * 2 + 1 AS STRING), CASE WHEN page_id % 3 = 0 THEN split_part(url, '/', 3)
    ELSE split_part(url, '/', 3) || '/' || split_part(url, '/', 4) || '/f' || CAST(page_id AS STRING) END FROM {t}"""


def _parents_sql() -> str:
    return f"""WITH l AS ({LISTED.replace("{t}", "pages")}), c AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS up FROM l WHERE contains(path, '/')),
    m AS (SELECT c.ord, arg_max(p.object_id, p.ord) AS parent_id FROM c JOIN l p ON p.path = c.up AND p.ord < c.ord GROUP BY c.ord)
    SELECT l.ord, parent_id, contains(path, '/') AND parent_id IS NULL AS orphan FROM l LEFT JOIN m USING (ord)"""


@query("j16_resolve_parents", _parents_sql())
def j16(spark, sf):
    return op.resolve_parents(run_sql(spark, sf, LISTED.replace("{t}", "{pages}"))).select(
        "ord", "parent_id", "orphan"
    )


@query("j16_resolve_parents_split", _parents_sql())
def j16_split(spark, sf):
    rows = run_sql(spark, sf, LISTED.replace("{t}", "{pages}"))
    return op.resolve_parents(rows, limit=2).select("ord", "parent_id", "orphan")


MEMBERS = """SELECT l_orderkey AS archive_id, l_discount < 0.095 AND l_tax < 0.075 AS allowed FROM """
ARCHIVES = """SELECT o_orderkey AS archive_id, o_orderstatus <> 'P' AS requested, o_orderpriority = '5-LOW' AS password_required,
    o_orderkey % 5 AS depth FROM """


@query(
    "a18_extraction_plan",
    f"""WITH m AS ({MEMBERS} lineitem), a AS ({ARCHIVES} orders), f AS (SELECT archive_id, count(*) AS n, bool_and(allowed) AS ok FROM m GROUP BY 1),
    r AS (SELECT a.archive_id, coalesce(n, 0) AS members, CASE WHEN NOT requested THEN 'extraction_not_requested'
      WHEN password_required THEN 'password_required' WHEN depth > 3 THEN 'nested_depth_blocked'
      WHEN NOT coalesce(ok, TRUE) THEN 'unsafe_members_blocked' ELSE 'bounded_scratch_extraction' END AS reason
      FROM a LEFT JOIN f USING (archive_id))
    SELECT *, reason = 'bounded_scratch_extraction' AS allowed FROM r""",
)
def a18(spark, sf):
    return aggs.extraction_plan(
        run_sql(spark, sf, MEMBERS + "{lineitem}"), run_sql(spark, sf, ARCHIVES + "{orders}")
    )


RULES = {
    "orders": op.TableRules(
        not_null=("o_orderkey", "o_orderdate"),
        checks={
            "o_orderstatus": "o_orderstatus IN ('F', 'O')",
            "o_totalprice": "o_totalprice >= 2000 AND o_totalprice <= 490000",
        },
        unique=(("o_orderkey",), ("o_custkey", "o_orderdate")),
        foreign=(("o_custkey", "customer", "c_custkey"),),
    ),
    "lineitem": op.TableRules(
        not_null=("l_orderkey",),
        checks={"l_quantity": "l_quantity > 1", "l_returnflag": "l_returnflag IN ('A', 'N', 'R')"},
        unique=(("l_orderkey", "l_linenumber"),),
        foreign=(("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey")),
    ),
    "events": op.TableRules(
        not_null=("user_id",),
        checks={"props": "props LIKE '{\"k\": %}'", "event_type": "length(event_type) <= 6"},
        unique=(("event_id",),),
    ),
    "documents": op.TableRules(
        checks={"lang": "lang IN ('en', 'fr')", "n_chars": "n_chars = length(text)"}, unique=(("text",),)
    ),
    "labels": op.TableRules(
        checks={"quality": "quality IN (0, 1)"}, foreign=(("doc_id", "documents", "doc_id"),)
    ),
    "supplier": op.TableRules(foreign=(("s_nationkey", "nation", "n_nationkey"),)),
    "nation": op.TableRules(foreign=(("n_regionkey", "region", "r_regionkey"),)),
    "customer": op.TableRules(unique=(("c_name",),), foreign=(("c_nationkey", "nation", "n_nationkey"),)),
}


def _constraint_sql() -> str:
    parts = []
    for t, r in RULES.items():
        head = f"SELECT '{t}' AS \"table\", "
        parts += [f"{head}'not_null:{c}' AS \"constraint\", count(*) FILTER ({c} IS NULL) AS violations FROM {t}" for c in r.not_null]
        parts += [f"{head}'check:{k}', count(*) FILTER (NOT ({v})) FROM {t}" for k, v in r.checks.items()]
        parts += [
            f"{head}'unique:{','.join(u)}', count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(u)} HAVING count(*) > 1)"
            for u in r.unique
        ]
        parts += [
            f"{head}'foreign:{c}->{o}.{oc}', count(*) FROM {t} WHERE {c} NOT IN (SELECT {oc} FROM {o})"
            for c, o, oc in r.foreign
        ]
    return " UNION ALL ".join(parts)


@query("a19_constraint_report", _constraint_sql())
def a19(spark, sf):
    names = set(RULES) | {f[1] for r in RULES.values() for f in r.foreign}
    return op.constraint_report({n: table(spark, sf, n) for n in names}, RULES)
