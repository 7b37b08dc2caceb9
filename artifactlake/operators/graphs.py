"""Ancestor, prefix and closure joins; constraint checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .grouped import GROUP_LIMIT, last_before
from .joins import path_key

SMALL_TABLE = 50_000


def ancestors(path: Column, itself: bool = False) -> Column:
    """All ancestor paths of a slash path, nearest last."""
    parts = F.split(path, "/")
    top = F.size(parts) if itself else F.size(parts) - 1
    return F.when(
        top >= 1,
        F.transform(F.sequence(F.lit(1), top), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def on_ancestors(
    paths: DataFrame, table: DataFrame, key: Sequence[str], broadcast_rows: int = SMALL_TABLE
) -> DataFrame:
    """Join exploded ancestors with a table of roots.

    Roots up to ``broadcast_rows`` (checked) are broadcast: the exploded rows are then never
    shuffled, and an ancestor that most paths share does no harm. More roots take an equi-join,
    whose skewed partitions adaptive execution splits.
    """
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table = F.broadcast(table)
    return paths.join(table, list(key))


def owner_by_prefix(
    entries: DataFrame,
    roots: DataFrame,
    match_volume: bool,
    path_col: str = "display_path",
    id_col: str = "entry_id",
    broadcast_rows: int = SMALL_TABLE,
) -> DataFrame:
    """(entry, owner): the first root, by ``ord``, whose path is an ancestor of the entry.

    ``roots`` has root_path, owner_id, ord (and volume_id). Entries without an owner are left out.
    """
    keys = ["__root", "volume_id"] if match_volume else ["__root"]
    held = entries.select(
        id_col,
        *(["volume_id"] if match_volume else []),
        F.explode(ancestors(path_key(path_col))).alias("__root"),
    )
    table = roots.select(
        path_key("root_path").alias("__root"),
        *(["volume_id"] if match_volume else []),
        "owner_id",
        "ord",
    )
    # one row per root before the join
    first = table.groupBy(*keys).agg(
        F.min_by("owner_id", "ord").alias("owner_id"), F.min("ord").alias("ord")
    )
    return (
        on_ancestors(held, first, keys, broadcast_rows)
        .groupBy(id_col)
        .agg(F.min_by("owner_id", "ord").alias("owner_id"))
    )


# fixed values: filesystems whose disks cannot be seen from here
NETWORK_FILESYSTEMS = ("nfs", "nfs4", "cifs", "smb3", "sshfs", "fuse.sshfs")


def longest_prefix_mount(
    paths: DataFrame, mounts: DataFrame, path_col: str = "path", broadcast_rows: int = SMALL_TABLE
) -> DataFrame:
    """Deepest mount at or above each path; NULL mount columns where there is none.

    ``mounts`` has mount_point, major_minor, fstype, ord; malformed mounts are ignored.
    """
    trimmed = F.regexp_replace(F.col("mount_point"), "/+$", "")
    good = mounts.where(
        F.startswith("mount_point", F.lit("/")) & F.col("major_minor").rlike("^[0-9]+:[0-9]+$")
    ).select(
        trimmed.alias("__at"),
        F.struct(F.col("mount_point"), F.col("major_minor"), F.col("fstype")).alias("__m"),
        F.size(F.split(trimmed, "/")).alias("__depth"),
        "ord",
    )
    # of equal mount points the first one counts
    first = good.groupBy("__at", "__depth").agg(F.min_by("__m", "ord").alias("__m"))
    keyed = paths.select(path_col).distinct()
    held = keyed.select(
        path_col,
        F.explode(ancestors(F.regexp_replace(F.col(path_col), "/+$", ""), itself=True)).alias("__at"),
    )
    best = (
        on_ancestors(held, first, ["__at"], broadcast_rows)
        .groupBy(path_col)
        .agg(F.max_by("__m", "__depth").alias("mount"))
    )
    return paths.join(best, path_col, "left").select(*paths.columns, "mount.*")


def closure(
    edges: DataFrame, seeds: DataFrame | None = None, parent: str = "parent", child: str = "child"
) -> DataFrame:
    """(node, reached): everything each seed node reaches from child to parent, cycles included.

    A frontier loop: each round joins only the newly reached pairs with the edges and drops pairs
    already seen, so a cycle ends by itself. Rounds are written to the checkpoint folder.
    """
    steps = settle(edges.select(F.col(child).alias("__from"), F.col(parent).alias("__to")).distinct())
    start = steps if seeds is None else steps.join(seeds.select(F.col("node").alias("__from")).distinct(), "__from")
    frontier = settle(start.select(F.col("__from").alias("node"), F.col("__to").alias("reached")))
    seen = frontier
    rounds = 0
    while not frontier.isEmpty():
        frontier = settle(
            frontier.join(steps, F.col("reached") == F.col("__from"))
            .select("node", F.col("__to").alias("reached"))
            .distinct()
            .join(seen, ["node", "reached"], "left_anti")
        )
        seen = seen.unionByName(frontier)
        rounds += 1
        if rounds % 8 == 0:
            seen = settle(seen)
    return seen


def reachable(edges: DataFrame, seeds: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node): the seed nodes and everything reached from them from child to parent, cycles included.

    Only the fact of being reached travels, never (node, reached) pairs. Nodes with one way out form
    chains, whose pointers double: each chain shrinks to a step onto its end, a frontier loop runs over the
    nodes with several ways, and the chains that were entered are walked by the doubled pointers. A chain
    of n nodes takes log2(n) rounds. Null ends of edges are no nodes.
    """
    steps = edges.select(F.col(child).alias("node"), F.col(parent).alias("to")).where("node IS NOT NULL AND to IS NOT NULL")
    out = settle(steps.where("node <> to").groupBy("node").agg(F.min("to").alias("to"), (F.min("to") < F.max("to")).alias("many")))
    single = settle(out.where("NOT many").select("node", "to"))
    bound = single.count()
    jumps = [single]
    # the n-th table jumps 2**n nodes ahead, at most to the end of the chain; nodes of a cycle have no end
    while 1 << (len(jumps) - 1) < bound:
        ahead = jumps[-1].select(F.col("node").alias("to"), F.col("to").alias("__next"))
        joined = settle(jumps[-1].join(ahead, "to", "left"))
        if joined.where("__next IS NOT NULL").isEmpty():
            break
        jumps.append(joined.select("node", F.coalesce("__next", "to").alias("to")))
    ends = jumps[-1].select(F.col("node").alias("entry"), F.col("to").alias("end"))
    forks = out.where("many").select("node")
    ways = (
        steps.distinct().join(forks, "node", "left_semi").select("node", F.col("to").alias("entry")).join(ends, "entry", "left")
    )
    ways = settle(ways.select("node", "entry", F.coalesce("end", "entry").alias("end")))
    starts = seeds.select(F.col("node").alias("entry")).where("entry IS NOT NULL").distinct()
    landed = starts.join(ends, "entry", "left").select(F.coalesce("end", "entry").alias("node"))
    frontier = settle(landed.join(forks, "node", "left_semi").distinct())
    passed = frontier
    rounds = 0
    while not frontier.isEmpty():
        onward = ways.join(frontier, "node", "left_semi").select(F.col("end").alias("node"))
        frontier = settle(onward.join(forks, "node", "left_semi").distinct().join(passed, "node", "left_anti"))
        passed = passed.unionByName(frontier)
        rounds += 1
        if rounds % 8 == 0:
            passed = settle(passed)
    entered = ways.join(passed, "node", "left_semi").select(F.col("entry").alias("node"))
    reached = settle(starts.select(F.col("entry").alias("node")).unionByName(entered).distinct())
    for jump in reversed(jumps):
        moved = jump.join(reached, "node", "left_semi").select(F.col("to").alias("node"))
        reached = settle(reached.unionByName(moved).distinct())
    return reached


def ancestry(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    return closure(edges, seeds)


def descendants(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    return closure(edges, seeds, parent="child", child="parent")


def shared_ancestors(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, denied, overlap): nodes of ``left`` items that a ``right`` node or its ancestors hold.

    ``left`` has (item, node): what must stay separate. ``right`` has (node).
    """
    held = reachable(edges, right)
    hit = left.join(held.withColumn("__hit", F.lit(True)), "node", "left")
    return hit.groupBy("item").agg(
        F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("denied"),
        F.array_sort(F.collect_set(F.when(F.col("__hit"), F.col("node")))).alias("overlap"),
    )


def destination_separation(
    paths: DataFrame, mounts: DataFrame, edges: DataFrame, source: DataFrame, path_col: str = "path"
) -> DataFrame:
    """Verdict per destination path: does its mount share a disk with ``source`` (node)?

    A network mount cannot be proven separate from here and only carries a warning.
    """
    placed = longest_prefix_mount(paths, mounts, path_col)
    devices = placed.where(F.col("major_minor").isNotNull()).select(
        F.col("major_minor").alias("node")
    ).distinct()
    # what lies on the source, down from it, and not all that each device lies on
    on_source = reachable(edges, source, parent="child", child="parent")
    shared = devices.join(on_source, "node", "left_semi").select(
        F.col("node").alias("major_minor"), F.lit(True).alias("__shared")
    )
    network = F.col("fstype").isin(*NETWORK_FILESYSTEMS)
    blocker = F.when(F.col("major_minor").isNull(), "destination_not_mounted").when(
        ~network & F.coalesce("__shared", F.lit(False)), "destination_shares_source_physical_disk"
    )
    return (
        placed.join(shared, "major_minor", "left")
        .withColumn("blocker", blocker)
        .withColumn("separate", F.col("blocker").isNull())
        .withColumn(
            "warning",
            F.when(network, "network_filesystem_physical_separation_not_locally_provable"),
        )
        .drop("__shared")
    )


def resolve_parents(
    entries: DataFrame,
    path_col: str = "path",
    id_col: str = "object_id",
    ord_col: str = "ord",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Parent of every entry: the nearest preceding entry whose path is the parent path.

    Both roles of an entry (as a parent, as a child) meet under the parent path in input order and
    the last parent before each child is carried forward, so no child is paired with all candidates.
    """
    has_dir = F.contains(path_col, F.lit("/"))
    parent_path = F.regexp_replace(F.col(path_col), "/[^/]*$", "")
    as_parent = entries.select(
        F.col(path_col).alias("__key"),
        F.col(ord_col).alias("__ord"),
        F.lit(0).alias("__role"),
        F.col(id_col).alias("__parent"),
    )
    as_child = entries.where(has_dir).select(
        parent_path.alias("__key"),
        F.col(ord_col).alias("__ord"),
        F.lit(1).alias("__role"),
        F.lit(None).cast(entries.schema[id_col].dataType).alias("__parent"),
    )
    # only paths that some child asks for
    wanted = as_child.select("__key").distinct()
    line = as_parent.join(wanted, "__key", "left_semi").unionByName(as_child)
    found = last_before(line, ["__key"], ["__ord", "__role"], "__parent", "__last", limit)
    parents = found.where("__role = 1").select(
        F.col("__ord").alias(ord_col), F.col("__last").alias("parent_id")
    )
    return entries.join(parents, ord_col, "left").withColumn(
        "orphan", has_dir & F.col("parent_id").isNull()
    )


# --------------------------------------------------------------------------- constraints


@dataclass(frozen=True)
class TableRules:
    """Constraints of one table. Conditions are SQL texts that hold on good rows."""

    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[tuple[str, str, str], ...] = ()


def constraint_report(tables: dict[str, DataFrame], rules: dict[str, TableRules]) -> DataFrame:
    """(table, constraint, violations) of every rule.

    NOT NULL and CHECK rules of a table share one aggregation pass; each UNIQUE rule groups by its
    columns, each foreign key is an anti join of its distinct values. As in SQL, a check whose value
    is NULL is not violated.
    """
    parts: list[DataFrame] = []
    for name, rule in rules.items():
        df = tables[name]
        counts = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in rule.not_null}
        counts |= {
            f"check:{label}": F.count_if(F.coalesce(~F.expr(cond), F.lit(False)))
            for label, cond in rule.checks.items()
        }
        if counts:
            pairs = F.array(
                *[
                    F.struct(F.lit(label).alias("constraint"), agg.alias("violations"))
                    for label, agg in counts.items()
                ]
            )
            parts.append(
                df.agg(pairs.alias("p")).select(F.lit(name).alias("table"), F.inline("p"))
            )
        for cols in rule.unique:
            full = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            parts.append(
                full.agg(
                    F.lit(name).alias("table"),
                    F.lit("unique:" + ",".join(cols)).alias("constraint"),
                    F.count_if(F.col("n") > 1).alias("violations"),
                )
            )
        for col, other, other_col in rule.foreign:
            values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(
                F.count(F.lit(1)).alias("n")
            )
            known = tables[other].select(F.col(other_col).alias("v"))
            parts.append(
                values.join(known, "v", "left_anti").agg(
                    F.lit(name).alias("table"),
                    F.lit(f"foreign:{col}->{other}.{other_col}").alias("constraint"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("violations"),
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


