"""Aggregations: facets, summaries, reports and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import FilterState, artifact_domain, observed_at, state_predicate
from .grouped import GROUP_LIMIT, number_rows


def facets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count per value for several columns in one pass; NULL is a value of its own.

    Each row is fanned out to (facet, value) before the partially aggregated count, so the input
    is read once and the shuffle carries distinct values only.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))
            for c in cols
        ]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("facet", "value")
    )


def artifact_facets(df: DataFrame) -> DataFrame:
    """Facets of browser artifacts, with the domain facet free of empty values."""
    with_domain = df.withColumn("domain", F.coalesce(*artifact_domain()))
    counted = facets(with_domain, ["browser_family", "profile_id", "artifact_kind", "domain"])
    empty = (F.col("facet") == "domain") & (F.coalesce("value", F.lit("")) == "")
    return counted.where(~empty)


FACET_SOURCES = {
    "user": "owner_id",
    "volume": "volume_id",
    "category": "category",
    "allocation": "allocation",
    "encrypted": "encrypted",
    "corrupt": "corrupt",
    "duplicates": "duplicate",
}
FLAG_FACETS = ("encrypted", "corrupt", "duplicates")


def _facet_text(key: str) -> Column:
    source = F.col(FACET_SOURCES[key])
    if key in FLAG_FACETS:
        return F.when(F.coalesce(source, F.lit(False)), "true").otherwise("false")
    return F.coalesce(F.nullif(source.cast("string"), F.lit("")), F.lit("unknown"))


def facet_counts(df: DataFrame, state: FilterState, keys: Sequence[str] | None = None) -> DataFrame:
    """Count per option of each facet inside the filtered set, all facets in one pass."""
    keys = tuple(keys or FACET_SOURCES)
    unknown = [k for k in keys if k not in FACET_SOURCES]
    if unknown:
        raise ValueError(f"facets {unknown} are not supported")
    kept = df.where(state_predicate(state))
    return facets(kept.select(*[_facet_text(k).alias(k) for k in keys]), keys)


def summary(df: DataFrame, time_col: str = "first_observed_at") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.min(time_col).alias("first_observed_at"),
        F.max(time_col).alias("last_observed_at"),
    )


def daily_histogram(df: DataFrame) -> DataFrame:
    day = F.date_format(observed_at(), "yyyy-MM-dd")
    return df.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("count")).orderBy("date")


USAGE_FIELDS = ("calls", "tokens_in", "tokens_out", "cache_hits", "failures")


def usage_metrics(calls: DataFrame) -> DataFrame:
    """Sums per provider/model plus one grand total row (``key`` = ``total``)."""
    keyed = calls.select(F.concat_ws("/", "provider", "model").alias("key"), *USAGE_FIELDS)
    sums = [F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in USAGE_FIELDS]
    return (
        keyed.rollup("key")
        .agg(F.grouping("key").alias("__total"), *sums)
        .withColumn("key", F.when(F.col("__total") == 1, "total").otherwise(F.col("key")))
        .drop("__total")
    )


QUEUE_STATES = ("ready", "exported", "waiting", "failed", "skipped")


def completion_report(items: DataFrame) -> DataFrame:
    """Counts of the five queue states, how many rows hold another state, and the total."""
    known = F.coalesce(F.col("state").isin(*QUEUE_STATES), F.lit(False))
    return items.agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in QUEUE_STATES],
        F.count_if(~known).alias("unknown_state"),
        F.count_if(known).alias("total"),
    )


def stage_percent() -> Column:
    """Percent of one stage (half-even), NULL while the denominator is unknown."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("done") / F.col("denominator")))
    return F.when(F.col("denominator") > 0, F.bround(share * 100).cast("long"))


def stage_eta() -> Column:
    """Remaining seconds of one stage from its own rate."""
    left = F.col("denominator") - F.col("done")
    rate = F.col("done") / F.col("elapsed_seconds")
    return (
        F.when((F.coalesce("denominator", F.lit(0)) == 0) | (F.col("done") <= 0), None)
        .when(left <= 0, F.lit(0))
        .when(F.col("elapsed_seconds") <= 0, None)
        .otherwise(F.greatest(F.lit(1), F.bround(left / rate).cast("long")))
        .cast("long")
    )


def progress(stages: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted percent per key; only activity is known while any denominator is missing.

    ``stages`` has (keys, stage, status, done, denominator); ``weights`` is the fixed table of
    stage weights (seven rows).
    """
    done = F.col("status") == "completed"
    percent = F.when(done, F.lit(1.0)).otherwise(stage_percent() / 100.0)
    unknown = ~done & percent.isNull()
    joined = stages.join(F.broadcast(weights), "stage").select(
        *keys,
        F.when(percent.isNotNull(), F.col("weight")).alias("__w"),
        (F.col("weight") * percent).alias("__wp"),
        unknown.alias("__unknown"),
    )
    grouped = joined.groupBy(*keys).agg(
        F.sum("__w").alias("__w"), F.sum("__wp").alias("__wp"), F.bool_or("__unknown").alias("__u")
    )
    blind = F.col("__u") | F.coalesce(F.col("__w") <= 0, F.lit(True))
    return grouped.select(
        *keys,
        F.when(blind, "activity_only").otherwise("weighted").alias("mode"),
        # the sum order of doubles must not decide a tie
        F.when(~blind, F.bround(F.round(F.col("__wp") / F.col("__w") * 100, 9)).cast("long")).alias(
            "percent"
        ),
    )


def completion_summary(stages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failed and skipped stages per key and the resulting state.

    The lists hold distinct stage names, of which there are seven.
    """
    listed = lambda s: F.array_sort(
        F.collect_set(F.when(F.col("status") == s, F.col("stage")))
    )
    failed, skipped = F.col("failed_stages"), F.col("skipped_stages")
    return (
        stages.groupBy(*keys)
        .agg(
            listed("failed").alias("failed_stages"),
            listed("skipped").alias("skipped_stages"),
            F.coalesce(F.bool_or(F.col("warning")), F.lit(False)).alias("__warned"),
        )
        .withColumn(
            "state",
            F.when(F.size(failed) > 0, "failed")
            .when((F.size(skipped) > 0) | F.col("__warned"), "completed-warning")
            .otherwise("completed"),
        )
        .drop("__warned")
    )


def compare_parser_versions(df: DataFrame) -> DataFrame:
    """Per kind: distinct parser versions, entries and sources (one input row = one source)."""
    return df.groupBy("kind").agg(
        F.array_sort(F.collect_set("parser_version")).alias("parser_versions"),
        F.sum("entry_count").alias("total_entries"),
        F.count(F.lit(1)).alias("distinct_sources"),
    )


def read_counters(attempts: DataFrame, keys: Sequence[str] = ("range_id",)) -> DataFrame:
    """Per range: what a log of read attempts says about it.

    ``attempts`` has (keys, attempt, outcome, requested, received); outcome is ``ok``, ``eio`` or
    ``timeout``. An ``ok`` attempt that received less than requested is a short read.
    """
    full = (F.col("outcome") == "ok") & (F.col("received") == F.col("requested"))
    short = (F.col("outcome") == "ok") & (F.col("received") < F.col("requested"))
    code = F.when(short, "short_read").otherwise(F.col("outcome"))
    return (
        attempts.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("attempted_reads"),
            F.count_if(full).alias("successful_reads"),
            F.count_if(F.col("attempt") > 1).alias("retry_reads"),
            F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
            F.count_if(short).alias("short_reads"),
            F.coalesce(F.bool_or(full & (F.col("attempt") > 1)), F.lit(False)).alias("recovered"),
            F.max("requested").alias("__length"),
            F.max_by(code, "attempt").alias("__last"),
        )
        .withColumn("gap", F.col("successful_reads") == 0)
        .withColumn("gap_code", F.when(F.col("gap"), F.col("__last")))
        .withColumn("skipped_bytes", F.when(F.col("gap"), F.col("__length")).otherwise(F.lit(0)))
        .drop("__length", "__last")
    )


def read_verdict(counters: DataFrame, pause_after: int, max_gaps: int) -> DataFrame:
    """Totals over all ranges and the reason to pause, if any."""
    sums = ("attempted_reads", "successful_reads", "retry_reads", "timeouts", "short_reads")
    return counters.agg(
        *[F.sum(c).alias(c) for c in (*sums, "skipped_bytes")],
        F.count_if("recovered").alias("recovered_after_retry"),
        F.count_if("gap").alias("failed_reads"),
    ).withColumn(
        "pause_reason",
        F.when(F.col("failed_reads") >= pause_after, "read error threshold reached").when(
            F.col("failed_reads") >= max_gaps, "maximum read error ranges reached"
        ),
    )


def identity_collisions(df: DataFrame, identity: str, device: str) -> DataFrame:
    """Stable identities that more than one device claims."""
    return (
        df.select(identity, device)
        .distinct()
        .groupBy(identity)
        .agg(F.count(F.lit(1)).alias("devices"))
        .where(F.col("devices") > 1)
    )


def coverage(df: DataFrame, expected: DataFrame, col: str) -> DataFrame:
    """Expected values that are missing and present values that are not expected."""
    seen = df.select(col).where(F.col(col).isNotNull()).distinct()
    want = expected.select(col).distinct()
    return want.join(seen, col, "left_anti").select(F.lit("missing").alias("issue"), col).unionByName(
        seen.join(want, col, "left_anti").select(F.lit("unexpected").alias("issue"), col)
    )


def group_items(df: DataFrame, by: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Entries of each group key with their position in input order (``ord``).

    Rows, not one list per key: a single date or device may own most of the gallery.
    """
    keyed = df.select(
        F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit("ungrouped")).alias("key"),
        "entry_id",
        "ord",
    )
    return number_rows(keyed, ["key"], ["ord"], "position", limit).drop("ord")


def inventory_checks(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects with reason)`` of word lists: unique name, SHA-256 and source."""
    repeated = (
        lists.groupBy("name")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select("name", F.lit(True).alias("__dup"))
    )
    scheme = F.lower(F.regexp_extract(F.coalesce("source", F.lit("")), "^([^:]*):", 1))
    digest = F.lower(F.coalesce("sha256", F.lit("")))
    reason = (
        F.when(F.col("__dup"), "duplicate_dictionary")
        .when(~scheme.isin("https", "scratch"), "unsafe_source")
        .when(~digest.rlike("^[0-9a-f]{64}$"), "invalid_hash")
        .when(~F.coalesce(F.col("size_bytes") > 0, F.lit(False)), "invalid_size")
    )
    checked = lists.join(repeated, "name", "left").withColumn("reason", reason).drop("__dup")
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def inventory_summary(valid: DataFrame) -> DataFrame:
    return valid.agg(
        F.count(F.lit(1)).alias("lists"),
        F.count_if("enabled").alias("enabled"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.count_distinct("language").alias("languages"),
    )


def extraction_plan(members: DataFrame, archives: DataFrame, max_depth: int = 3) -> DataFrame:
    """Per archive: extraction is allowed only if it was asked for, needs no password, is not nested
    too deep and every member is allowed; else the first reason in that order.

    ``archives`` has (archive_id, requested, password_required, depth); ``members`` (archive_id,
    allowed).
    """
    facts = members.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("members"), F.bool_and("allowed").alias("__all")
    )
    joined = archives.join(facts, "archive_id", "left")
    reason = (
        F.when(~F.col("requested"), "extraction_not_requested")
        .when(F.col("password_required"), "password_required")
        .when(F.col("depth") > max_depth, "nested_depth_blocked")
        .when(~F.coalesce("__all", F.lit(True)), "unsafe_members_blocked")
        .otherwise("bounded_scratch_extraction")
    )
    return joined.select(
        "archive_id",
        F.coalesce("members", F.lit(0)).alias("members"),
        (reason == "bounded_scratch_extraction").alias("allowed"),
        reason.alias("reason"),
    )
