"""Safe destination paths and collision-free names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import MAX_LOCAL_PATH_BYTES, MAX_REMOTE_PATH_BYTES, RESERVED_NAMES
from ..session import settle
from .grouped import GROUP_LIMIT, number_rows

_CONTROL = r"[\x00-\x1f]"
_REPLACED = "�"


def _component(part: Column) -> Column:
    """Struct (name, warnings) of one path component."""
    swapped = F.regexp_replace(part, r"[\x00-\x1f\x7f]", _REPLACED)
    bare = F.regexp_replace(F.regexp_replace(swapped, r"(?U)^\s+|\s+$", ""), r"\.+$", "")
    named = F.when(bare == "", F.lit("unnamed")).otherwise(bare)
    reserved = F.upper(F.element_at(F.split(named, r"\."), 1)).isin(*RESERVED_NAMES)
    return F.struct(
        F.when(reserved, F.concat(F.lit("_"), named)).otherwise(named).alias("name"),
        F.array_compact(
            F.array(
                F.when(part.rlike(_CONTROL), "control_character"),
                F.when(bare == "", "empty_name"),
                F.when(reserved, "reserved_name"),
            )
        ).alias("warnings"),
    )


def cut_bytes(text: Column, limit: int) -> Column:
    """Longest whole-character start of ``text`` below ``limit`` UTF-8 bytes."""
    whole = F.substring(text.cast("binary"), 1, limit - 1)
    # a cut inside a character leaves stray bytes at the end, which read as U+FFFD
    return F.regexp_replace(F.make_valid_utf8(whole.cast("string")), _REPLACED + "+$", "")


def safe_paths(
    df: DataFrame,
    path: str,
    destination_kind: str = "local",
    case_insensitive: bool = False,
    out: str = "destination_path",
) -> DataFrame:
    """Destination-relative path of every source path with the deviations it needed.

    A path beyond the limit keeps its leading folders and ends in the SHA-256 of the whole path, so
    sources with a long common start stay apart.
    """
    limit = MAX_LOCAL_PATH_BYTES if destination_kind == "local" else MAX_REMOTE_PATH_BYTES
    raw = F.filter(F.split(F.col(path), r"[/\\]+"), lambda p: ~p.isin("", "."))
    parts = F.transform(
        raw,
        lambda p: F.when(
            p == "..",
            F.struct(
                F.lit(None).cast("string").alias("name"),
                F.array(F.lit("path_traversal")).alias("warnings"),
            ),
        ).otherwise(_component(p)),
    )
    fold = (lambda c: F.upper(c)) if case_insensitive else (lambda c: c)
    names = F.transform(F.col("__parts"), lambda p: fold(p["name"]))
    notes = F.flatten(
        F.transform(
            F.col("__parts"),
            lambda p, i: F.when(
                p["name"].isNotNull()
                & F.coalesce(
                    F.array_contains(
                        F.slice(F.col("__names"), F.lit(1), i), F.coalesce(fold(p["name"]), F.lit(""))
                    ),
                    F.lit(False),
                ),
                F.concat(p["warnings"], F.array(F.lit("duplicate_component"))),
            ).otherwise(p["warnings"]),
        )
    )
    joined = F.array_join(F.transform(F.col("__parts"), lambda p: p["name"]), "/")
    long = F.octet_length("__joined") > limit
    # whole components only, and room for "/" and 64 hex digits
    head = F.nullif(F.regexp_extract(cut_bytes(F.col("__joined"), limit - 65), r"(?s)^(.*)/", 1), F.lit(""))
    short = F.concat_ws("/", head, F.sha2(F.col("__joined"), 256))
    return (
        df.withColumn("__parts", parts)
        .withColumn("__names", names)
        .withColumn("__joined", joined)
        .withColumn(
            out, F.when(long, short).otherwise(F.col("__joined"))
        )
        .withColumn(
            "deviations",
            F.array_distinct(
                F.concat(
                    notes,
                    F.when(long, F.array(F.lit("long_path_truncated"))).otherwise(
                        F.array().cast("array<string>")
                    ),
                )
            ),
        )
        .drop("__parts", "__names", "__joined")
    )


def _nth_free(n: Column, skips: Column) -> Column:
    """The n-th positive counter that is not in ``skips``."""
    start = n.cast("long")
    return F.aggregate(
        F.array_sort(skips), start, lambda k, s: F.when(s <= k, k + 1).otherwise(k)
    )


def resolve_collisions(
    df: DataFrame,
    path: str,
    ord_col: str,
    case_insensitive: bool = False,
    out: str = "final",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Unique name per row: repeats take ``__1``, ``__2``, ... in input order.

    A counter name may already be used by a row that carries it from the start (``a``, ``a``,
    ``a__1``). Such ties are settled on distinct names, level by level (``a`` before ``a__1`` before
    ``a__1__1``); rows only need their number within their own name, so a name that a third of the
    rows share never meets in one task. ``ord_col`` must be unique.
    """
    key = F.upper(path) if case_insensitive else F.col(path)
    rows = df.withColumn("__key", key)
    names = rows.groupBy("__key").agg(F.min(ord_col).alias("__first"))
    shape = r"^(.*)__([1-9][0-9]{0,17})$"
    child = names.where(F.col("__key").rlike(shape)).select(
        F.col("__key").alias("child"),
        F.regexp_extract("__key", shape, 1).alias("__key"),
        F.regexp_extract("__key", shape, 2).cast("long").alias("k"),
        F.col("__first").alias("at"),
    )
    links = child.join(names.select("__key"), "__key")
    numbered = number_rows(rows, ["__key"], [ord_col], "__n", limit)
    if links.isEmpty():
        return numbered.withColumn(out, _final(path, F.col("__n") - 1, None)).drop("__key", "__n")

    links = settle(_rows_before(rows, links, ord_col, limit))
    verdicts = _settle_levels(links)
    placed = numbered.join(verdicts, "__key", "left")
    taken = F.coalesce(F.col("consumed"), F.lit(False)).cast("int")
    return placed.withColumn(out, _final(path, F.col("__n") - 1 + taken, F.col("skips"))).drop(
        "__key", "__n", "consumed", "skips"
    )


def _final(path: str, repeats: Column, skips: Column | None) -> Column:
    n = repeats
    if skips is not None:
        n = _nth_free(repeats, F.coalesce(skips, F.array().cast("array<bigint>")))
    return F.when(repeats == 0, F.col(path)).otherwise(
        F.concat(F.col(path), F.lit("__"), n.cast("string"))
    )


def _rows_before(rows: DataFrame, links: DataFrame, ord_col: str, limit: int) -> DataFrame:
    """Per child name: how many rows of the parent name come before the child's first row."""
    parents = links.select("__key").distinct()
    own = rows.join(parents, "__key", "left_semi").select(
        "__key", F.col(ord_col).alias("at"), F.lit(None).cast("string").alias("child")
    )
    marks = links.select("__key", "at", "child")
    spots = number_rows(own.unionByName(marks), ["__key"], ["at"], "__spot", limit)
    ranks = number_rows(marks, ["__key"], ["at"], "__rank", limit)
    before = (
        spots.where("child IS NOT NULL")
        .join(ranks.select("child", "__rank"), "child")
        .select("child", (F.col("__spot") - F.col("__rank")).alias("before"))
    )
    return links.join(before, "child")


def _settle_levels(links: DataFrame) -> DataFrame:
    """(name, consumed, skips) for every name that is a parent or a child of another name."""
    per_parent = links.groupBy("__key").agg(
        F.array_sort(F.collect_list(F.struct("at", "k", "before", "child"))).alias("children")
    )
    roots = per_parent.join(
        links.select(F.col("child").alias("__key")), "__key", "left_anti"
    ).select("__key", F.lit(False).alias("consumed"))
    empty = F.array().cast("array<bigint>")
    verdicts = roots.select("__key", "consumed", empty.alias("skips")).limit(0)
    level = settle(roots)
    while not level.isEmpty():

        def step(state: Column, c: Column) -> Column:
            own = F.when(F.col("consumed"), F.lit(0)).otherwise(F.lit(1))
            repeats = F.greatest(c["before"] - own, F.lit(0).cast("long"))
            reach = _nth_free(repeats, state["skips"])
            used = (repeats > 0) & (c["k"] <= reach)
            return F.struct(
                F.when(used, state["skips"])
                .otherwise(F.array_append(state["skips"], c["k"]))
                .alias("skips"),
                F.when(used, F.array_append(state["used"], c["child"]))
                .otherwise(state["used"])
                .alias("used"),
            )

        start = F.struct(empty.alias("skips"), F.array().cast("array<string>").alias("used"))
        folded = settle(
            level.join(per_parent, "__key", "left")
            .withColumn(
                "state",
                F.aggregate(
                    F.coalesce(
                        "children",
                        F.array().cast(
                            per_parent.schema["children"].dataType
                        ),
                    ),
                    start,
                    step,
                ),
            )
        )
        verdicts = verdicts.unionByName(
            folded.select("__key", "consumed", F.col("state.skips").alias("skips"))
        )
        level = settle(
            folded.select(
                F.explode("children").alias("c"), F.col("state.used").alias("used")
            ).select(
                F.col("c.child").alias("__key"),
                F.array_contains("used", F.col("c.child")).alias("consumed"),
            )
        )
    return settle(verdicts)
