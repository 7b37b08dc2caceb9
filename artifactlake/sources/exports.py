"""Export projections, manifests, content store and copy checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.rules import EXPORT_FIELDS, TOKEN_WORDS
from ..session import settle

DIGEST_CHUNK = 50_000


def formula_safe(cell: Column) -> Column:
    """Cell text that a spreadsheet does not take for a formula."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_cells(df: DataFrame) -> DataFrame:
    return df.select(*[formula_safe(F.col(c)).alias(c) for c in df.columns])


def write_csv_safe(df: DataFrame, path: str) -> None:
    """Formula-safe CSV part files with a header; written in parallel, never collected."""
    safe_cells(df).write.mode("errorifexists").option("header", True).option("lineSep", "\n").option(
        "escape", '"'
    ).csv(path)


def is_token_field(name: str) -> bool:
    return any(word in name.lower() for word in TOKEN_WORDS)


def export_records(df: DataFrame, include_tokens: bool = False, timezone_notes: str | None = None) -> DataFrame:
    """Fixed export columns; missing ones are '', token fields are dropped unless asked for."""
    kept = [c for c in df.columns if include_tokens or not is_token_field(c)]
    cols = []
    for name in EXPORT_FIELDS:
        if name == "timezone_notes" and timezone_notes:
            cols.append(F.lit(timezone_notes).alias(name))
        else:
            cols.append((F.col(name) if name in kept else F.lit("")).alias(name))
    if include_tokens:
        cols += [F.col(c) for c in df.columns if is_token_field(c) and c not in EXPORT_FIELDS]
    return df.select(*cols)


MANIFEST_FIELDS = (
    "destination_path",
    "export_item_id",
    "provenance",
    "sha256",
    "size_bytes",
    "source_display_path",
    "status",
)


def export_manifest(plans: DataFrame, hashes: DataFrame, sizes: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row per planned item with defaults for what is not known yet, and a digest of the row."""
    key = "export_item_id"
    if hashes is sizes and sizes is statuses:
        joined = plans.join(hashes.select(key, "sha256", "size_bytes", "status"), key, "left")
    else:
        joined = (
            plans.join(hashes.select(key, "sha256"), key, "left")
            .join(sizes.select(key, "size_bytes"), key, "left")
            .join(statuses.select(key, "status"), key, "left")
        )
    full = joined.select(
        *plans.columns,
        F.coalesce("sha256", F.lit("")).alias("sha256"),
        F.coalesce("size_bytes", F.lit(0).cast("long")).alias("size_bytes"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
    )
    canonical = F.to_json(F.struct(*MANIFEST_FIELDS), {"ignoreNullFields": "false"})
    return full.withColumn("row_digest", F.sha2(canonical, 256))


def ordered_digest(df: DataFrame, digest: str, order: Sequence[str], chunk: int = DIGEST_CHUNK) -> DataFrame:
    """One digest over row digests in a fixed order: a tree of digests with ``chunk`` children a node at most.

    The lowest nodes hash ``chunk`` rows each, and levels follow until one node can take what is left, so no
    node ever gathers more than ``chunk`` digests. No rows: the digest of the empty text, and null items.

    Only the order and the digest travel: once into ranges, which are written in their order, and once to the nodes.
    """
    if chunk < 2:
        raise ValueError("a node needs room for two digests")
    by = [F.col(c) for c in order]
    ranged = df.select(*dict.fromkeys([*order, digest])).repartitionByRange(*by).sortWithinPartitions(*by)
    # the id has the number of the range above bit 33 and the row's place in it below
    ranged = settle(ranged.select(F.col(digest).alias("d"), F.monotonically_increasing_id().alias("__id")))
    ranged = ranged.select("d", F.shiftright("__id", 33).alias("__range"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    numbered = ranged.join(F.broadcast(before), "__range")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda s: s["d"]), "")

    def above(nodes: DataFrame) -> DataFrame:
        parent = nodes.groupBy(F.floor(F.col("part") / chunk).alias("__p")).agg(F.sha2(joined, 256).alias("d"), F.sum("n").alias("n"))
        return settle(parent.withColumnRenamed("__p", "part"))

    nodes = above(numbered.select((F.col("__at") + F.col("__before")).alias("part"), "d", F.lit(1).cast("long").alias("n")))
    while nodes.count() > chunk:
        nodes = above(nodes)
    return nodes.agg(F.sha2(joined, 256).alias("manifest_sha256"), F.sum("n").alias("items"))


def content_store(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(contents, references, rejects)`` of objects with content bytes.

    ``contents`` has one row per digest with its size and reference count, ``references`` one row
    per object (its provenance), ``rejects`` the objects whose expected digest or size is wrong.
    """
    sized = objects.withColumn("sha256", F.sha2("content", 256)).withColumn(
        "size_bytes", F.octet_length("content").cast("long")
    )
    reason = F.when(
        F.col("expected_sha256").isNotNull() & (F.col("expected_sha256") != F.col("sha256")), "hash_mismatch"
    ).when(
        F.col("expected_size").isNotNull() & (F.col("expected_size") != F.col("size_bytes")), "size_mismatch"
    )
    judged = sized.drop("content").withColumn("reason", reason)
    kept = judged.where("reason IS NULL")
    content_id = F.concat(F.lit("content-"), F.substring("sha256", 1, 32))
    contents = kept.groupBy("sha256").agg(
        F.first("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("ref_count")
    )
    contents = contents.select(
        content_id.alias("content_id"),
        "sha256",
        "size_bytes",
        F.concat(F.lit("scratch://sha256/"), "sha256").alias("storage_uri"),
        "ref_count",
    )
    references = kept.select(content_id.alias("content_id"), "provenance")
    return contents, references, judged.where("reason IS NOT NULL")


def event_frames(events: DataFrame) -> DataFrame:
    """Text frame (id, event, data) of every event; the payload is JSON text already."""
    # a one-field object without its wrapping is the quoted value
    quoted = lambda c: F.expr(f"substring(to_json(named_struct('v', CAST({c} AS STRING))), 6, length(to_json(named_struct('v', CAST({c} AS STRING)))) - 6)")
    data = F.concat(
        F.lit('{"case_id":'),
        quoted("case_id"),
        F.lit(',"created_at":'),
        quoted("created_at"),
        F.lit(',"event_id":'),
        quoted("event_id"),
        F.lit(',"payload":'),
        F.col("payload_json"),
        F.lit(',"sequence":'),
        F.col("sequence").cast("string"),
        F.lit(',"type":'),
        quoted("event_type"),
        F.lit("}"),
    )
    frame = F.concat(
        F.lit("id: "),
        F.col("sequence").cast("string"),
        F.lit("\nevent: "),
        F.col("event_type"),
        F.lit("\ndata: "),
        data,
        F.lit("\n\n"),
    )
    return events.select("case_id", "sequence", frame.alias("frame"))


def verify_copies(source: DataFrame, copied: DataFrame, key: str) -> DataFrame:
    """Status of every object between a source table and its copy (key, size_bytes, sha256)."""
    s = source.select(key, F.col("size_bytes").alias("s_size"), F.col("sha256").alias("s_sha"), F.lit(1).alias("s"))
    c = copied.select(key, F.col("size_bytes").alias("c_size"), F.col("sha256").alias("c_sha"), F.lit(1).alias("c"))
    status = (
        F.when(F.col("c").isNull(), "missing_copy")
        .when(F.col("s").isNull(), "unexpected_copy")
        .when(~F.col("s_size").eqNullSafe(F.col("c_size")), "size_mismatch")
        .when(~F.col("s_sha").eqNullSafe(F.col("c_sha")), "digest_mismatch")
        .otherwise("verified")
    )
    return s.join(c, key, "full_outer").select(key, status.alias("status"))


