"""Arrays, trees and text shaping."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import scratch_dir, settle
from .grouped import fold_sorted, follow_chain, last_before, number_rows

FOLD_LIMIT = 100_000
SLICE = 1_000_000


def chunk_text(df: DataFrame, text_col: str, max_chars: int, overlap: int) -> DataFrame:
    """Overlapping chunks of the whole text, one row per chunk.

    Chunk ``i`` starts at ``i * (max_chars - overlap)``; the last one ends with the text.
    """
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("chunk limits are invalid")
    step = max_chars - overlap
    n = F.length(text_col)
    count = (
        F.when(n == 0, 0)
        .when(n <= max_chars, 1)
        .otherwise(F.ceil((n - overlap) / F.lit(step)))
        .cast("int")
    )
    numbered = df.where(n > 0).withColumn(
        "chunk", F.explode_outer(F.sequence(F.lit(0), count - 1))
    )
    return numbered.withColumn(
        "chunk_text", F.substring(F.col(text_col), F.col("chunk") * step + 1, F.lit(max_chars))
    )


def _fold(rows: DataFrame, keys: Sequence[str], max_items: int, max_bytes: int) -> DataFrame:
    def step(state: tuple[int, int, int], row: tuple) -> tuple[tuple[int, int, int], int]:
        batch, items, size = state
        (b,) = row
        if items and (items >= max_items or size + b > max_bytes):
            batch, items, size = batch + 1, 0, 0
        return (batch, items + 1, size + b), batch

    return fold_sorted(rows, keys, "__pos", ["__bytes"], "batch", T.LongType(), lambda: (1, 0, 0), step)


def pack_batches(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: Column,
    max_items: int = 32,
    max_bytes: int = 1_048_576,
    limit: int = FOLD_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """``(rows with batch number, oversized rows)``: greedy packing in order, per queue.

    Queues up to ``limit`` rows are folded one by one. In longer queues every row only looks at its
    next ``max_items`` rows to find where a batch starting there would end; the real batch starts
    are then the walk along these pointers, so a huge queue is spread over the cluster.
    """
    sized = df.withColumn("__bytes", size.cast("long"))
    oversized = sized.where(F.col("__bytes") > max_bytes).drop("__bytes")
    rows = number_rows(sized.where(F.col("__bytes") <= max_bytes), keys, order, "__pos")
    lengths = rows.groupBy(*keys).agg(F.max("__pos").alias("__n"))
    long_ones = lengths.where(F.col("__n") > limit).select(*keys)
    if long_ones.isEmpty():
        packed = _fold(rows, keys, max_items, max_bytes)
        return packed.drop("__pos", "__bytes"), oversized
    short = rows.join(long_ones, list(keys), "left_anti")
    packed = _fold(short, keys, max_items, max_bytes)
    rest = _pack_long(rows.join(long_ones, list(keys), "left_semi"), keys, max_items, max_bytes)
    return packed.unionByName(rest).drop("__pos", "__bytes"), oversized


def _pack_long(
    rows: DataFrame, keys: Sequence[str], max_items: int, max_bytes: int, slice_rows: int = SLICE
) -> DataFrame:
    rows = settle(rows)
    at = F.col("__pos") - 1
    # each slice also sees the rows a batch begun at its end may reach
    halo = F.when((at % slice_rows < max_items) & (at >= slice_rows), F.array(F.lit(0), F.lit(-1)))
    seen = rows.select(
        *keys, "__pos", "__bytes", F.explode(F.coalesce(halo, F.array(F.lit(0)))).alias("__shift")
    ).withColumn("__slice", F.floor((F.col("__pos") - 1) / slice_rows) + F.col("__shift"))
    win = W.partitionBy(*keys, "__slice").orderBy("__pos").rowsBetween(0, max_items)
    ahead = F.collect_list("__bytes").over(win)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b"), F.lit(False).alias("full"))

    def step(s: Column, b: Column) -> Column:
        full = s["full"] | (s["n"] >= max_items) | ((s["n"] > 0) & (s["b"] + b > max_bytes))
        return F.struct(
            F.when(full, s["n"]).otherwise(s["n"] + 1).alias("n"),
            F.when(full, s["b"]).otherwise(s["b"] + b).alias("b"),
            full.alias("full"),
        )

    jump = (
        seen.withColumn("__ahead", ahead)
        .where("__shift = 0")
        .withColumn("__s", F.aggregate("__ahead", start, step))
        .select(
            *keys,
            "__pos",
            F.when(F.col("__s.full"), F.col("__pos") + F.col("__s.n")).alias("__next"),
        )
    )
    first = rows.where("__pos = 1").select(*keys, "__pos")
    starts = number_rows(follow_chain(jump, first, keys, "__pos", "__next"), keys, ["__pos"], "__b")
    marked = rows.join(starts, [*keys, "__pos"], "left")
    carried = last_before(marked, keys, ["__pos"], "__b", "__prev")
    return carried.withColumn("batch", F.coalesce("__b", "__prev")).drop("__b", "__prev")


def flatten_tree(df: DataFrame, id_col: str, json_col: str, roots: str = "$.roots") -> DataFrame:
    """URL nodes of bookmark trees in depth-first order: (id, position path, name, url).

    Each round opens one level of folders and writes it, until no folder is left; the number of rounds is
    the depth of the deepest tree. ``path`` orders the nodes of a tree; it holds the child positions from
    the root down. A text that Spark cannot parse (more than 1,000 brackets deep, too) gives no rows here;
    ``tree_rejects`` names it.
    """
    spark = df.sparkSession
    tree = F.try_parse_json(F.col(json_col))
    level = df.select(F.col(id_col).alias("tree_id"), F.try_variant_get(tree, roots, "map<string,variant>").alias("m"))
    # object order is the order of its keys
    nodes = level.select(
        "tree_id",
        F.posexplode(F.array_sort(F.map_keys("m"))).alias("pos", "k"),
        "m",
    ).select("tree_id", F.array("pos").alias("path"), F.element_at("m", F.col("k")).alias("node"))
    folder = f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex}"
    below = F.try_variant_get("node", "$.children", "array<variant>")
    levels: list[str] = []
    while True:
        # children go as JSON text: variants cannot be checkpointed by value
        made = nodes.select(
            "tree_id",
            "path",
            F.try_variant_get("node", "$.type", "string").alias("type"),
            F.try_variant_get("node", "$.url", "string").alias("url"),
            F.try_variant_get("node", "$.name", "string").alias("name"),
            F.when(F.size(below) > 0, F.to_json(F.try_variant_get("node", "$.children", "variant"))).alias("children"),
        )
        levels.append(f"{folder}/{len(levels)}")
        made.write.parquet(levels[-1])
        done = spark.read.schema(made.schema).parquet(levels[-1])
        deeper = done.where("children IS NOT NULL")
        if deeper.isEmpty():
            break
        opened = F.try_variant_get(F.parse_json("children"), "$", "array<variant>")
        nodes = deeper.select("tree_id", "path", F.posexplode(opened).alias("pos", "node")).select(
            "tree_id", F.array_append("path", F.col("pos")).alias("path"), "node"
        )
    found = spark.read.schema(made.schema).parquet(*levels)
    return found.where((F.col("type") == "url") & F.col("url").isNotNull()).select("tree_id", "path", "name", "url")


def tree_rejects(df: DataFrame, id_col: str, json_col: str, roots: str = "$.roots") -> DataFrame:
    """(tree_id, reason) of the rows whose text ``flatten_tree`` cannot open.

    ``no_text``: null; ``unparsable``: no JSON, or more than 1,000 brackets deep; ``no_roots``: no object at
    ``roots``. An empty object of roots is a tree without nodes and no reject.
    """
    tree = F.try_parse_json(F.col(json_col))
    reason = (
        F.when(F.col(json_col).isNull(), "no_text")
        .when(tree.isNull(), "unparsable")
        .when(F.try_variant_get(tree, roots, "map<string,variant>").isNull(), "no_roots")
    )
    return df.select(F.col(id_col).alias("tree_id"), reason.alias("reason")).where("reason IS NOT NULL")


def flatten_tabs(df: DataFrame, id_col: str, windows: str = "windows") -> DataFrame:
    """Chosen entry of every tab: ``index - 1`` clamped to the last entry.

    ``windows`` is array<struct<tabs: array<struct<index, entries: array<struct<url, title>>>>>>.
    """
    w = df.select(id_col, F.posexplode(windows).alias("window", "w"))
    t = w.select(id_col, "window", F.posexplode("w.tabs").alias("tab", "t"))
    entries = F.col("t.entries")
    at = F.greatest(F.lit(1), F.least(F.coalesce("t.index", F.size(entries)), F.size(entries)))
    return (
        t.where(F.size(entries) > 0)
        .withColumn("entry", F.try_element_at(entries, at))
        .select(
            id_col,
            (F.col("window") + 1).alias("window"),
            (F.col("tab") + 1).alias("tab"),
            F.coalesce("entry.url", F.lit("")).alias("url"),
            F.coalesce("entry.title", F.lit("")).alias("title"),
        )
    )


def flatten_entries(df: DataFrame, id_col: str, entries: str = "entries") -> DataFrame:
    """Cache index rows with a 1-based ordinal; the key falls back to the URL."""
    e = df.select(id_col, F.posexplode(entries).alias("pos", "e"))
    url = F.coalesce("e.url", F.lit(""))
    return e.select(
        id_col,
        (F.col("pos") + 1).alias("ordinal"),
        url.alias("url"),
        F.coalesce(F.nullif(F.col("e.key"), F.lit("")), url).alias("cache_key"),
    )


EXTENSION_DETAILS = "map<string, struct<name: string, version: string, path: string, state: int>>"


def flatten_extensions(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One row per extension id with name and version fallbacks."""
    parsed = F.from_json(F.col(json_col), T._parse_datatype_string(EXTENSION_DETAILS))
    one = df.select(id_col, F.explode(parsed).alias("extension_id", "d"))
    return one.select(
        id_col,
        "extension_id",
        F.coalesce(F.nullif(F.col("d.name"), F.lit("")), F.col("extension_id")).alias("name"),
        F.coalesce("d.version", F.lit("")).alias("version"),
        F.coalesce("d.path", F.lit("")).alias("install_path"),
        F.coalesce(F.col("d.state") == 1, F.lit(False)).alias("enabled"),
    )


def child_volumes(images: DataFrame) -> DataFrame:
    """One row per container image and one per child volume, a level deeper."""
    own = images.select(
        "source_id",
        "parent_id",
        F.coalesce("kind", F.lit("raw")).alias("kind"),
        F.greatest(F.coalesce("depth", F.lit(0)), F.lit(0)).alias("depth"),
        F.lit(None).cast("string").alias("filesystem"),
        F.lit("container_image").alias("finding_type"),
    )
    kids = images.select(
        "source_id", "depth", F.posexplode("volumes").alias("pos", "v")
    ).select(
        F.concat(F.col("source_id"), F.lit("-v"), (F.col("pos") + 1).cast("string")).alias("source_id"),
        F.col("source_id").alias("parent_id"),
        F.lit("child_volume").alias("kind"),
        (F.greatest(F.coalesce("depth", F.lit(0)), F.lit(0)) + 1).alias("depth"),
        F.coalesce("v.filesystem", F.lit("unknown")).alias("filesystem"),
        F.lit("child_volume").alias("finding_type"),
    )
    return own.unionByName(kids)
