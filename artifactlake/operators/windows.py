"""Log and ordering operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import AUDIT_TRANSITIONS
from ..session import settle
from .grouped import GROUP_LIMIT, number_rows, with_neighbour
from .updates import transition_checks


def assign_sequences(
    new_events: DataFrame,
    head: DataFrame,
    key: str = "case_id",
    order: Sequence[str] = ("created_at", "event_id"),
    limit: int = GROUP_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """``(events with sequence, new head table)``: numbers continue after each case's head.

    The head is a table of its own (key, head), so numbering does not restart when old events are
    compacted away.
    """
    numbered = number_rows(new_events, [key], list(order), "__n", limit)
    heads = head.select(key, F.col("head").alias("__head"))
    events = (
        numbered.join(heads, key, "left")
        .withColumn("sequence", F.col("__n") + F.coalesce("__head", F.lit(0)))
        .drop("__n", "__head")
    )
    grown = new_events.groupBy(key).agg(F.count(F.lit(1)).alias("__new"))
    new_head = heads.join(grown, key, "full_outer").select(
        key, (F.coalesce("__head", F.lit(0)) + F.coalesce("__new", F.lit(0))).alias("head")
    )
    return events, new_head


def backfill_sequences(
    events: DataFrame, order: Sequence[str] = ("created_at", "event_id"), limit: int = GROUP_LIMIT
) -> DataFrame:
    """Number the events of each case; an event without a case is a sequence of its own."""
    # prefixes keep a case id from meeting an equal event id
    group = F.coalesce(
        F.concat(F.lit("c:"), F.col("case_id").cast("string")),
        F.concat(F.lit("e:"), F.col("event_id").cast("string")),
    )
    keyed = events.withColumn("__group", group)
    return number_rows(keyed, ["__group"], list(order), "sequence", limit).drop("__group")


def length_prefixed(*parts: Column) -> Column:
    """Parts as bytes, each behind its length as eight big-endian bytes."""
    pieces = []
    for p in parts:
        raw = p.cast("binary")
        pieces.append(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")))
        pieces.append(raw)
    return F.concat(*pieces)


CHECKPOINT_PARTS = (
    "source_fingerprint",
    "stage",
    "checkpoint_version",
    "tool_name",
    "tool_version",
    "cursor_json",
    "counters_json",
)


def integrity_digest() -> Column:
    texts = [F.col(c).cast("string") for c in CHECKPOINT_PARTS]
    return F.sha2(length_prefixed(*texts, F.col("blob")), 256)


def latest_checkpoints(df: DataFrame, expected: DataFrame, version: int = 1) -> DataFrame:
    """Newest un-superseded checkpoint per (job, stage) with the reason it may not be used.

    ``expected`` has per job the fingerprint and tool to resume with. ``reason`` is NULL on usable
    rows. The newest row is found by ``max_by``, which aggregates before the shuffle.
    """
    cols = [c for c in df.columns if c not in ("job_id", "stage")]
    newest = (
        df.where(F.col("superseded_by_checkpoint_id").isNull())
        .groupBy("job_id", "stage")
        .agg(F.max_by(F.struct(*cols), F.struct("created_at", "checkpoint_id")).alias("__row"))
        .select("job_id", "stage", "__row.*")
    )
    want = expected.select(
        "job_id",
        F.col("source_fingerprint").alias("__fp"),
        F.col("tool_name").alias("__tool"),
        F.col("tool_version").alias("__tv"),
    )
    reason = (
        F.when(F.col("checkpoint_version") != version, "unsupported_version")
        .when(~F.col("source_fingerprint").eqNullSafe(F.col("__fp")), "fingerprint_mismatch")
        .when(
            ~F.col("tool_name").eqNullSafe(F.col("__tool"))
            | ~F.col("tool_version").eqNullSafe(F.col("__tv")),
            "tool_mismatch",
        )
        .when(integrity_digest() != F.col("integrity_sha256"), "integrity_mismatch")
    )
    return (
        newest.join(want, "job_id", "left")
        .withColumn("reason", reason)
        .drop("__fp", "__tool", "__tv")
    )


def supersede_chain(
    df: DataFrame,
    keys: Sequence[str] = ("job_id", "stage"),
    order: Sequence[str] = ("created_at", "checkpoint_id"),
    id_col: str = "checkpoint_id",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Link every checkpoint to the one before and after it in its stage."""
    this = {"id": F.col(id_col)}
    back = with_neighbour(df, keys, order, this, "__prev", limit=limit)
    both = with_neighbour(back, keys, order, this, "__next", ahead=True, limit=limit)
    return both.select(
        *df.columns,
        F.col("__prev.id").alias("supersedes"),
        F.col("__next.id").alias("superseded_by"),
    )


GENESIS = "0" * 64
_HASH_MEMBER = r'"record_hash":"[0-9a-f]{64}",(?="schema_version")'


def verify_chain(log: DataFrame, version: int = 1, limit: int = GROUP_LIMIT) -> DataFrame:
    """Every line of an audit log with the first problem it has (NULL when it is sound).

    ``log`` has (log_id, line_no, line) with one canonical JSON record per line. A record's hash is
    taken over its text without the hash member itself, so a re-formatted line counts as changed.
    """
    parsed = log.select(
        "log_id",
        "line_no",
        "line",
        F.from_json(
            "line",
            "schema_version int, sequence long, previous_hash string, record_hash string",
        ).alias("r"),
        F.sha2(F.regexp_replace("line", _HASH_MEMBER, ""), 256).alias("own_hash"),
    )
    near = with_neighbour(
        parsed,
        ["log_id"],
        ["line_no"],
        {"hash": F.col("r.record_hash"), "line_no": F.col("line_no")},
        "__prev",
        limit=limit,
    )
    base = F.min("line_no")
    first = log.groupBy("log_id").agg(base.alias("__first"))
    joined = near.join(first, "log_id")
    problem = (
        F.when(F.trim("line") == "", "blank_record")
        .when(F.col("r").isNull() | F.col("r.sequence").isNull(), "invalid_json")
        .when(~F.col("r.schema_version").eqNullSafe(F.lit(version)), "incompatible_version")
        .when(
            F.col("r.sequence") != F.col("line_no") - F.col("__first") + 1,
            "sequence_gap_or_reorder",
        )
        .when(
            ~F.coalesce(F.col("__prev.hash"), F.lit(GENESIS)).eqNullSafe(
                F.col("r.previous_hash")
            ),
            "previous_hash_mismatch",
        )
        .when(~F.col("own_hash").eqNullSafe(F.col("r.record_hash")), "record_hash_mismatch")
    )
    return joined.select("log_id", "line_no", problem.alias("problem"))


def chain_verdict(checked: DataFrame) -> DataFrame:
    """Per log: lines, first bad line and its problem."""
    bad = F.col("problem").isNotNull()
    return checked.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min(F.when(bad, F.col("line_no"))).alias("first_bad_line"),
        F.min_by("problem", F.when(bad, F.col("line_no"))).alias("problem"),
    )


def pick_canonical(members: DataFrame, group: str) -> DataFrame:
    """Best member of each group, two ways.

    ``canonical_id`` prefers members with any source path, ``distance_ref_id`` members with a
    preview; both then take the larger size, the smaller first path and the smaller id.
    """
    size = -F.coalesce("size_bytes", F.lit(0))
    path = F.coalesce(F.array_min("source_paths"), F.lit(""))
    has_paths = F.coalesce(F.size("source_paths") > 0, F.lit(False))
    return members.groupBy(group).agg(
        F.min_by("finding_id", F.struct(~has_paths, size, path, "finding_id")).alias("canonical_id"),
        F.min_by(
            "finding_id", F.struct(F.col("preview_uri").isNull(), size, path, "finding_id")
        ).alias("distance_ref_id"),
        F.count(F.lit(1)).alias("members"),
    )


def has_overlap(
    ranges: DataFrame, key: str = "source_id", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Per source: whether an allocated range starts at or before the end of the one before it,
    and how many ranges have a length that does not fit their bounds."""
    live = ranges.where("allocated")
    near = with_neighbour(
        live, [key], ["start", "end", "slot"], {"end": F.col("end")}, "__prev", limit=limit
    )
    hit = near.groupBy(key).agg(
        F.coalesce(F.bool_or(F.col("start") <= F.col("__prev.end")), F.lit(False)).alias("__hit")
    )
    expected = F.greatest(F.lit(0), F.col("end") - F.col("start") + 1)
    counts = ranges.groupBy(key).agg(
        F.count(F.lit(1)).alias("ranges"),
        F.count_if(F.col("sector_count") != expected).alias("length_mismatches"),
    )
    return counts.join(hit, key, "left").select(
        key, "ranges", "length_mismatches", F.coalesce("__hit", F.lit(False)).alias("overlapping")
    )


def duplicate_siblings(
    entries: DataFrame, keys: Sequence[str] = ("parent_id", "name"), ord_col: str = "ord"
) -> DataFrame:
    """Second and later entries of one name under one parent.

    Only the first position per name is needed, so a map-side ``min`` replaces a window.
    """
    from .grouped import join_null_safe

    first = entries.groupBy(*keys).agg(
        F.min(ord_col).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    repeated = first.where("__n > 1").drop("__n")
    return (
        join_null_safe(entries, repeated, list(keys), "inner")
        .where(F.col(ord_col) > F.col("__first"))
        .drop("__first")
    )


def schedule_cap(
    candidates: DataFrame, eligible: Column, ord_col: str = "ord", n: int | None = None
) -> DataFrame:
    """Mark eligible rows as scheduled: all, or the first ``n`` in input order (top-n, no global window).

    Rows with the same ``ord_col`` are told apart, so no more than ``n`` are marked.
    """
    if n is None:
        return candidates.withColumn("schedule_scan", F.coalesce(eligible, F.lit(False)))
    # written once, so that a row has one number
    rows = settle(candidates.withColumn("__row", F.monotonically_increasing_id()))
    chosen = (
        rows.where(eligible)
        .orderBy(ord_col, "__row")
        .limit(n)
        .select("__row", F.lit(True).alias("__chosen"))
    )
    # the caller's n bounds this side, but not its size: Spark picks the join
    return (
        rows.join(chosen, "__row", "left")
        .withColumn("schedule_scan", F.coalesce("__chosen", F.lit(False)))
        .drop("__chosen", "__row")
    )


def stable_files(
    observations: DataFrame,
    ingested: DataFrame,
    suffix: str = ".done",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """First scan at which each file is complete: finalized name, or unchanged since the last scan.

    ``observations`` has (path, scan, size_bytes, mtime); files in ``ingested`` are left out.
    """
    # the previous observation only counts when it comes from the scan right before
    near = with_neighbour(
        observations,
        ["path"],
        ["scan"],
        {"size": F.col("size_bytes"), "mtime": F.col("mtime"), "scan": F.col("scan")},
        "__prev",
        limit=limit,
    )
    same = (
        (F.col("__prev.size") == F.col("size_bytes"))
        & (F.col("__prev.mtime") == F.col("mtime"))
        & (F.col("__prev.scan") == F.col("scan") - 1)
    )
    done = F.col("path").endswith(suffix)
    return (
        near.where(done | F.coalesce(same, F.lit(False)))
        .groupBy("path")
        .agg(F.min("scan").alias("ready_scan"), F.min_by("size_bytes", "scan").alias("size_bytes"))
        .join(ingested.select("path"), "path", "left_anti")
    )


def audit_transition_checks(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return transition_checks(log, keys, order, "to_state", AUDIT_TRANSITIONS)


def resume_eligibility(
    snapshots: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Whether each medium may resume from the reader's previous snapshot, and why not.

    Snapshot columns: identity_key, capacity_bytes, fingerprint, toc_sessions, geometry, generation.
    """
    fields = (
        "identity_key",
        "capacity_bytes",
        "fingerprint",
        "toc_sessions",
        "geometry",
        "generation",
    )
    near = with_neighbour(
        snapshots, keys, order, {f: F.col(f) for f in fields}, "__prev", limit=limit
    )

    def differs(name: str) -> Column:
        return ~F.col(name).eqNullSafe(F.col(f"__prev.{name}"))

    eligible = F.col("__prev").isNotNull() & ~differs("identity_key")
    reason = (
        F.when(F.col("__prev").isNull(), "no_previous_medium")
        .when(~differs("identity_key"), None)
        .when(differs("capacity_bytes"), "capacity_changed")
        .when(
            F.col("fingerprint").isNull() | F.col("__prev.fingerprint").isNull(),
            "unreadable_sample_identity_weak",
        )
        .when(differs("fingerprint"), "fingerprint_changed")
        .when(differs("toc_sessions"), "toc_sessions_changed")
        .when(differs("geometry"), "geometry_changed")
        .when(differs("generation"), "media_replaced")
        .otherwise("medium_identity_changed")
    )
    return near.select(
        *keys, *order, eligible.alias("eligible"), reason.alias("reason")
    )
