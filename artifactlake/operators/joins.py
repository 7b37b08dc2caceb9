"""Equi, anti, outer and lookup joins between catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_is_one, stable_id
from ..functions.times import epoch_parts
from .grouped import GROUP_LIMIT, join_groups, max_before


def _or_blank(*names: str) -> Column:
    """First non-empty text among ``names``, else ''."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names], F.lit(""))


def exclude_noise(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings without metadata evidence that marks them as system noise."""
    noisy = evidence.where(
        (F.col("evidence_kind") == "metadata") & json_is_one("data_json", "$.system_noise")
    ).select("finding_id")
    return findings.join(noisy, "finding_id", "left_anti")


def finding_detail(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per (finding, evidence); findings without evidence stay.

    Rows rather than an array per finding: a finding may own any amount of evidence. Rows come in no
    order: the page that is read sorts by ``evidence_created_at`` and ``evidence_id``.
    """
    detail = evidence.select(
        "finding_id",
        "evidence_id",
        "evidence_kind",
        F.col("content_id").alias("evidence_content_id"),
        "data_json",
        F.col("created_at").alias("evidence_created_at"),
    )
    return findings.join(detail, "finding_id", "left")


def related_findings(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings that share an artifact's content; a NULL content id relates to nothing."""
    left = artifacts.where(F.col("content_id").isNotNull()).select(
        "browser_artifact_id", "content_id"
    )
    return left.join(findings, "content_id")


def content_links(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """:func:`related_findings` without the pairs: (side, id, content_id, severity, links).

    One row per artifact and finding whose content is on both sides. Each artifact of a ``content_id`` relates to each
    finding of it, so the id with ``links``, the number of partners, tells the same as the pairs.
    """
    sides = {
        "artifact": artifacts.select(F.col("browser_artifact_id").alias("id"), "content_id", F.lit(None).cast("string").alias("severity")),
        "finding": findings.select(F.col("finding_id").alias("id"), "content_id", "severity"),
    }
    rows = [df.select(F.lit(side).alias("side"), "*") for side, df in sides.items()]
    both = rows[0].unionByName(rows[1]).where("content_id IS NOT NULL")
    counts = both.groupBy("content_id").agg(
        F.count_if(F.col("side") == "artifact").alias("__a"),
        F.count_if(F.col("side") == "finding").alias("__f"),
        F.count(F.lit(1)).alias("__n"),
    )
    met = join_groups(both, counts.where("__a > 0 AND __f > 0"), ["content_id"], "__n")
    links = F.when(F.col("side") == "artifact", F.col("__f")).otherwise(F.col("__a"))
    return met.select("side", "id", "content_id", "severity", links.alias("links"))


def _artifact(
    df: DataFrame,
    kind: str,
    family: str,
    source: str,
    table: str,
    row: Column,
    parser: str,
    fields: dict[str, Column],
) -> DataFrame:
    reference = F.concat(F.lit(f"{table}:"), row.cast("string"))
    return df.select(
        stable_id(
            "browser-artifact-", ["profile_id", F.lit(kind), F.lit(source), reference], 32
        ).alias("artifact_id"),
        F.lit(kind).alias("artifact_kind"),
        F.lit(family).alias("browser_family"),
        "profile_id",
        F.struct(
            F.coalesce(F.col("entry_id"), F.lit("unknown")).alias("entry_id")
            if "entry_id" in df.columns
            else F.lit("unknown").alias("entry_id"),
            F.lit(source).alias("source_artifact"),
            F.lit(parser).alias("parser"),
            reference.alias("row_reference"),
        ).alias("raw_provenance"),
        F.lit(1.0).alias("recovery_confidence"),
        *[expr.alias(name) for name, expr in fields.items()],
    )


CHROMIUM = ("chromium", "History", "chromium-artifacts-v1")
FIREFOX = ("firefox", "places.sqlite", "firefox-artifacts-v1")


def chromium_visits(visits: DataFrame, urls: DataFrame) -> DataFrame:
    """Visit rows with their URL; a visit of an unknown URL is dropped (inner join)."""
    u = urls.select(
        "profile_id",
        F.col("id").alias("url_id"),
        F.col("url").alias("url_text"),
        "title",
        "visit_count",
        "typed_count",
    )
    joined = visits.withColumnRenamed("url", "url_id").join(u, ["profile_id", "url_id"])
    family, source, parser = CHROMIUM
    return _artifact(
        joined,
        "visit",
        family,
        source,
        "visits",
        F.col("id"),
        parser,
        {
            "url": _or_blank("url_text"),
            "title": _or_blank("title"),
            "visit_time": epoch_parts("visit_time", "1601us"),
            "visit_count": F.col("visit_count"),
            "typed_count": F.col("typed_count"),
            "transition": F.col("transition"),
            "from_visit": F.col("from_visit"),
        },
    )


def firefox_bookmarks(bookmarks: DataFrame, places: DataFrame) -> DataFrame:
    """Bookmarks of type 1 with their place; title falls back to the page title."""
    marks = bookmarks.where(F.col("type") == 1).select(
        "profile_id", "id", "fk", F.col("title").alias("mark_title"), "date_added"
    )
    p = places.select(
        "profile_id", F.col("id").alias("fk"), "url", F.col("title").alias("page_title")
    )
    family, source, parser = FIREFOX
    return _artifact(
        marks.join(p, ["profile_id", "fk"]),
        "bookmark",
        family,
        source,
        "moz_bookmarks",
        F.col("id"),
        parser,
        {
            "url": _or_blank("url"),
            "title": _or_blank("mark_title", "page_title"),
            "created_time": epoch_parts("date_added", "1970us"),
        },
    )


def chromium_searches(terms: DataFrame, urls: DataFrame) -> DataFrame:
    """Search terms with the last visit time of their URL (left join, missing time = 0)."""
    u = urls.select("profile_id", F.col("id").alias("url_id"), "last_visit_time")
    family, source, parser = CHROMIUM
    return _artifact(
        terms.join(u, ["profile_id", "url_id"], "left"),
        "search",
        family,
        source,
        "keyword_search_terms",
        F.col("row_id"),
        parser,
        {"query": _or_blank("term"), "search_time": epoch_parts("last_visit_time", "1601us")},
    )


def chromium_downloads(downloads: DataFrame, chains: DataFrame) -> DataFrame:
    """Downloads with the first URL of their chain and the target path fallback."""
    first = chains.where(F.col("chain_index") == 0).select(
        "profile_id", "id", F.col("url").alias("chain_url")
    )
    family, source, parser = CHROMIUM
    return _artifact(
        downloads.join(first, ["profile_id", "id"], "left"),
        "download",
        family,
        source,
        "downloads",
        F.col("id"),
        parser,
        {
            "source_url": _or_blank("chain_url"),
            "target_path": _or_blank("target_path", "current_path"),
            "start_time": epoch_parts("start_time", "1601us"),
            "end_time": epoch_parts("end_time", "1601us"),
            "received_bytes": F.coalesce("received_bytes", F.lit(0)),
            "total_bytes": F.coalesce("total_bytes", F.lit(0)),
        },
    )


def base_name(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.element_at(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), -1))


def link_by_basename(
    activity: DataFrame, trash: DataFrame, salts: int = 16, hot_rows: int = 100_000
) -> DataFrame:
    """Pairs of an activity row and a trash row that carry the same file name, any case.

    Names that occur on very many trash rows are spread over ``salts`` sub-keys: each trash row
    gets one, each activity row of such a name is repeated for all of them.
    """
    a = activity.select(
        "entry_id", "target_path", base_name(F.coalesce("target_path", F.lit(""))).alias("__name")
    ).where(F.col("__name") != "")
    t = trash.select(
        F.col("entry_id").alias("recycle_entry_id"),
        F.col("original_path").alias("evidence_path"),
        base_name(F.coalesce("original_path", F.lit(""))).alias("__name"),
    ).where(F.col("__name") != "")
    hot = (
        t.groupBy("__name").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    ).select("__name", F.lit(True).alias("__hot"))
    # at most rows / hot_rows names are hot: broadcast when few, so that their rows stay where they are
    if hot.limit(10_001).count() <= 10_000:
        hot = F.broadcast(hot)
    a = a.join(hot, "__name", "left").withColumn(
        "__salt",
        F.explode(
            F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    t = t.join(hot, "__name", "left").withColumn(
        "__salt",
        F.when(
            F.col("__hot"), F.pmod(F.xxhash64("recycle_entry_id"), F.lit(salts)).cast("int")
        ).otherwise(F.lit(0)),
    )
    return a.drop("__hot").join(t.drop("__hot"), ["__name", "__salt"]).select(
        "entry_id", "recycle_entry_id", "target_path", "evidence_path"
    )


def pair_trash(names: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metadata (``$I``) and payload (``$R``) names of one base as one row with its state.

    One aggregation instead of a full outer join. When a name repeats, the greatest ``ord`` wins.
    """
    base = F.substring("name", 3, 1_000_000)
    kind = F.substring("name", 1, 2)
    rows = names.where(kind.isin("$I", "$R") & (F.length("name") > 2)).select(
        *keys, base.alias("base_name"), kind.alias("__kind"), "name", "ord"
    )
    last = lambda k: F.max_by(
        F.when(F.col("__kind") == k, F.col("name")),
        F.when(F.col("__kind") == k, F.col("ord")),
    )
    paired = rows.groupBy(*keys, "base_name").agg(
        last("$I").alias("metadata_ref"), last("$R").alias("payload_ref")
    )
    return paired.withColumn(
        "recovery_state",
        F.when(F.col("metadata_ref").isNotNull() & F.col("payload_ref").isNotNull(), "present")
        .when(F.col("metadata_ref").isNotNull(), "deleted")
        .otherwise("carved"),
    )


def golden_diff(
    actual: DataFrame, expected: DataFrame, key: str, fields: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``(differences, verdict)`` between two tables with one row per key.

    ``differences`` lists missing keys, unexpected keys and every differing field (NULL-safe);
    ``verdict`` is one row with the counts and ``pass`` or ``fail``.
    """
    a = actual.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("__a"))
    e = expected.select(key, *[F.col(f).alias(f"e_{f}") for f in fields], F.lit(1).alias("__e"))
    both = a.join(e, key, "full_outer")
    mismatch = [
        F.when(
            ~F.col(f"a_{f}").eqNullSafe(F.col(f"e_{f}")),
            F.struct(
                F.lit("mismatch").alias("kind"),
                F.lit(f).alias("field"),
                F.col(f"e_{f}").cast("string").alias("expected"),
                F.col(f"a_{f}").cast("string").alias("actual"),
            ),
        )
        for f in sorted(fields)
    ]
    blank = F.lit(None).cast("string")

    def only(kind: str) -> Column:
        return F.array(
            F.struct(
                F.lit(kind).alias("kind"),
                blank.alias("field"),
                blank.alias("expected"),
                blank.alias("actual"),
            )
        )

    found = both.withColumn(
        "__diff",
        F.when(F.col("__a").isNull(), only("missing"))
        .when(F.col("__e").isNull(), only("unexpected"))
        .otherwise(F.array_compact(F.array(*mismatch))),
    )
    differences = found.select(key, F.inline("__diff"))
    kind_of = F.col("__diff")[0]["kind"]
    verdict = (
        found.select(
            F.when(F.size("__diff") > 0, kind_of).alias("__k"), F.size("__diff").alias("__n")
        )
        .agg(
            F.count_if(F.col("__k").isNull()).alias("matched_count"),
            F.count_if(F.col("__k") == "missing").alias("missing"),
            F.count_if(F.col("__k") == "unexpected").alias("unexpected"),
            F.coalesce(F.sum(F.when(F.col("__k") == "mismatch", F.col("__n"))), F.lit(0)).alias(
                "mismatches"
            ),
        )
        .withColumn(
            "status",
            F.when(F.expr("missing + unexpected + mismatches = 0"), "pass").otherwise("fail"),
        )
    )
    return differences, verdict


def recover_deleted(candidates: DataFrame, live_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)``: rows without a key are rejected, copies of live rows are flagged."""
    missing = F.coalesce(F.col("validation_key"), F.lit("")) == ""
    rejects = candidates.where(missing).select(
        "row_reference",
        F.concat(
            F.lit("deleted_sqlite_row_rejected:"), "row_reference", F.lit(":missing_key")
        ).alias("warning"),
    )
    live = live_keys.select("validation_key").distinct().withColumn("__live", F.lit(True))
    records = (
        candidates.where(~missing)
        .join(live, "validation_key", "left")
        .withColumn(
            "duplicate_of_live_row", F.when(F.col("__live"), F.col("validation_key"))
        )
        .withColumn("recovery_confidence", F.lit(0.55))
        .withColumn("sqlite_recovery_state", F.lit("validated_deleted_row"))
        .drop("__live")
    )
    return records, rejects


CACHE_PARTS = ("content_hash", "input_refs", "model", "prompt_version", "provider", "schema_version")


def cache_key(parts: Sequence[str] = CACHE_PARTS) -> Column:
    """Digest of the canonical JSON of the request parts (keys in sorted order)."""
    items = [
        (F.array_sort(p) if p == "input_refs" else F.col(p)).alias(p) for p in sorted(parts)
    ]
    return F.sha2(F.to_json(F.struct(*items), {"ignoreNullFields": "false"}), 256)


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits with value, misses)`` of requests that carry ``cache_key``."""
    return requests.join(cache, "cache_key"), requests.join(cache, "cache_key", "left_anti")


def cache_merge(primary: DataFrame, persisted: DataFrame) -> DataFrame:
    """Both caches in one; a key that is already in ``primary`` keeps its value."""
    return primary.unionByName(persisted.join(primary, "cache_key", "left_anti"))


def mark_carved_duplicates(trash: DataFrame, contents: DataFrame) -> DataFrame:
    """Append ``carved_duplicate:<content>`` where a carved payload equals a stored content."""
    known = contents.groupBy("content_sha256").agg(F.min("content_id").alias("__content"))
    hit = (F.col("recovery_state") == "carved") & F.col("__content").isNotNull()
    return (
        trash.join(known, "content_sha256", "left")
        .withColumn(
            "warnings",
            F.when(
                hit,
                F.array_union(
                    "warnings", F.array(F.concat(F.lit("carved_duplicate:"), "__content"))
                ),
            ).otherwise(F.col("warnings")),
        )
        .drop("__content")
    )


def estimate_costs(targets: DataFrame, budgets: DataFrame, kdf: DataFrame) -> DataFrame:
    """CPU seconds, memory and tier per target; a format without a budget is not costed.

    ``budgets`` and ``kdf`` are the fixed rule tables of :mod:`artifactlake.functions.rules`.
    """
    cpu = F.floor(F.col("cpu_budget") * F.coalesce("multiplier", F.lit(1.0))).cast("long")
    return (
        targets.join(F.broadcast(budgets), "format_name")
        .join(F.broadcast(kdf), "kdf", "left")
        .withColumn("cpu_seconds", cpu)
        .withColumn(
            "tier",
            F.when(F.col("cpu_seconds") <= 120, "low")
            .when(F.col("cpu_seconds") <= 480, "medium")
            .otherwise("high"),
        )
        .drop("cpu_budget", "multiplier")
    )


def snapshot_diff(
    previous: DataFrame,
    current: DataFrame,
    key: str,
    fingerprint: str,
    signals: Sequence[str],
    proven: str,
) -> DataFrame:
    """Change of each medium between two snapshots, with the names of the changed signals."""
    cols = [fingerprint, proven, *signals]
    p = previous.select(key, *[F.col(c).alias(f"p_{c}") for c in cols], F.lit(1).alias("__p"))
    c = current.select(key, *cols, F.lit(1).alias("__c"))
    changed = F.array_compact(
        F.array(
            *[
                F.when(~F.col(s).eqNullSafe(F.col(f"p_{s}")), F.lit(f"{s}_changed"))
                for s in signals
            ]
        )
    )
    fp, old = F.col(fingerprint), F.col(f"p_{fingerprint}")
    status = (
        F.when(F.col("__p").isNull(), "new")
        .when(F.col("__c").isNull(), "emptied")
        .when(~F.col(f"p_{proven}") | ~F.col(proven), "unproven")
        .when(fp.isNull(), "unproven")
        .when(old.isNotNull() & (fp != old), "replaced_medium")
        .when(F.size(changed) > 0, "changed_signals")
        .otherwise("same_medium")
    )
    none = F.array().cast("array<string>")
    reasons = (
        F.when(F.col("__p").isNull() | F.col("__c").isNull(), none)
        .when(~F.col(f"p_{proven}") | ~F.col(proven), F.array(F.lit("no_proven_medium_identity")))
        .when(fp.isNull(), F.array(F.lit("missing_fingerprint")))
        .when(old.isNotNull() & (fp != old), F.array(F.lit("fingerprint_mismatch")))
        .otherwise(changed)
    )
    return c.join(p, key, "full_outer").select(
        key, status.alias("status"), reasons.alias("reasons")
    )


def presence_change(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """populated / emptied / swapped / unchanged per reader, from presence and generation."""
    p = previous.select(
        key, F.col("present").alias("__was"), F.col("generation").alias("__gen")
    ).withColumn("__p", F.lit(True))
    was, now = F.col("__was"), F.col("present")
    kind = (
        F.when(F.col("__p").isNull(), "unchanged")
        .when(~was & now, "populated")
        .when(was & ~now, "emptied")
        .when(was & now & (F.col("generation") > F.col("__gen")), "swapped")
        .otherwise("unchanged")
    )
    return current.join(p, key, "left").select(
        key, kind.alias("kind"), F.col("generation"), (kind != "unchanged").alias("changed")
    )


def path_key(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.trim(F.replace(p, F.lit("\\"), F.lit("/")), F.lit("/")))


def enrich_by_path(
    entries: DataFrame, lookups: dict[str, DataFrame], path_col: str = "display_path"
) -> DataFrame:
    """Left-join lookup tables on the normalized path.

    Each lookup has ``path``, ``ord`` and ``value``; of equal paths the greatest ``ord`` wins.
    The value arrives in a column named like the lookup.
    """
    out = entries.withColumn("__path", path_key(path_col))
    for name, table in lookups.items():
        last = (
            table.withColumn("__path", path_key("path"))
            .groupBy("__path")
            .agg(F.max_by("value", "ord").alias(name))
        )
        out = out.join(last, "__path", "left")
    return out.drop("__path")


def inside_any(
    points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """The distinct ``at`` values that some range ``[start, end)`` holds; a sweep over starts and points.

    Starts and points are put in one order; a point is inside a range if the greatest end among the starts up
    to it lies beyond it. A range costs one row, whatever its length, and long sweeps are cut by range with one
    carried maximum per cut. Null points and ranges with a null or empty extent hold nothing.
    """
    none = F.lit(None).cast("long")
    starts = ranges.where(F.col(end) > F.col(start)).select(F.col(start).cast("long").alias("__at"), F.lit(0).alias("__role"), F.col(end).cast("long").alias("__end"))
    asked = points.where(F.col(at).isNotNull()).select(F.col(at).cast("long").alias("__at")).distinct()
    both = starts.unionByName(asked.select("__at", F.lit(1).alias("__role"), none.alias("__end"))).withColumn("__all", F.lit(0))
    swept = max_before(both, ["__all"], ["__at", "__role"], "__end", "__reach", limit)
    kind = points.schema[at].dataType
    return swept.where((F.col("__role") == 1) & (F.col("__reach") > F.col("__at"))).select(F.col("__at").cast(kind).alias(at))


def overlaps(
    offsets: DataFrame,
    ranges: DataFrame,
    at: str,
    start: str,
    end: str,
    width: int,
    broadcast_rows: int = 10_000,
) -> DataFrame:
    """Rows of ``offsets`` with each range that holds them (``start <= at < end``).

    Both sides meet on bins of ``width`` by an equi-join, so no pair outside a common bin is ever
    compared. Binned ranges up to ``broadcast_rows`` (checked) are broadcast, which spares the large
    side its shuffle.
    """
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    low = F.floor(F.col(start) / width)
    high = F.floor((F.col(end) - 1) / width)
    binned = ranges.where(F.col(end) > F.col(start)).withColumn(
        "__bin", F.explode(F.sequence(low, high))
    )
    if binned.limit(broadcast_rows + 1).count() <= broadcast_rows:
        binned = F.broadcast(binned)
    return (
        offsets.withColumn("__bin", F.floor(F.col(at) / width))
        .join(binned, "__bin")
        .where(inside)
        .drop("__bin")
    )
