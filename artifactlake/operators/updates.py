"""Set-based updates: every change is a join that returns the new table and its log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CLOSED_JOB_STATES, JOB_TRANSITIONS
from ..functions.timing import retry_delay
from .grouped import with_neighbour
from .paging import compaction_candidates


def all_artifacts(*frames: DataFrame) -> DataFrame:
    """Union of artifact tables of different kinds; columns a kind lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class UpdateError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


REVIEW_TARGETS = {"mark-reviewed": "reviewed", "dismiss": "dismissed", "restore": "new"}


def apply_review(
    findings: DataFrame,
    action: str,
    actor: str,
    group_id: str,
    targets: DataFrame | None = None,
    selected: DataFrame | None = None,
    note: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(findings', action_log, unknown)`` for explicit target ids or a saved selection.

    An id that is not in ``findings`` is listed in ``unknown``; callers reject the request when that
    frame is not empty. The log keeps the previous status of each target and whether it changed.
    """
    if (targets is None) == (selected is None):
        raise UpdateError("invalid_targets", "give either target ids or a selection")
    chosen = (targets if targets is not None else selected).select("finding_id").distinct()
    status = REVIEW_TARGETS[action]
    unknown = chosen.join(findings, "finding_id", "left_anti")
    marked = findings.join(chosen.withColumn("__hit", F.lit(True)), "finding_id", "left")
    updated = marked.withColumn(
        "status", F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status"))
    ).drop("__hit")
    log = marked.where("__hit").select(
        F.concat_ws("_", F.lit(group_id), "finding_id").alias("review_action_id"),
        F.lit(group_id).alias("group_id"),
        "finding_id",
        F.lit(action).alias("action"),
        F.lit(actor).alias("actor"),
        F.lit(note).cast("string").alias("operator_note"),
        F.col("status").alias("previous_status"),
        F.lit(status).alias("target_status"),
        (F.col("status") != status).alias("changed"),
        F.lit(False).alias("undone"),
    )
    return updated, log, unknown


def undo_review(
    findings: DataFrame, log: DataFrame, group_id: str, actor: str
) -> tuple[DataFrame, DataFrame]:
    """``(findings', log')`` with the previous status restored once and the group marked undone."""
    mine = F.col("group_id") == group_id
    fresh = log.where(mine & ~F.col("undone")).select("finding_id", "previous_status")
    restored = (
        findings.join(fresh, "finding_id", "left")
        .withColumn("status", F.coalesce("previous_status", "status"))
        .drop("previous_status")
    )
    marked = log.withColumn(
        "undo_actor", F.when(mine & ~F.col("undone"), F.lit(actor))
    ).withColumn("undone", F.col("undone") | mine)
    return restored, marked


def mark_published(events: DataFrame, ids: DataFrame, at: Any) -> DataFrame:
    """Publish time of the delivered events; the first publish time stays."""
    hit = ids.select("event_id").distinct().withColumn("__hit", F.lit(True))
    stamp = F.lit(at).cast(events.schema["published_at"].dataType)
    return (
        events.join(hit, "event_id", "left")
        .withColumn("published_at", F.coalesce("published_at", F.when(F.col("__hit"), stamp)))
        .drop("__hit")
    )


def compact(events: DataFrame, before: Any, limit: int | None = None) -> DataFrame:
    """Events without the published ones created before a time; unpublished events always stay.

    With ``limit`` only so many of the oldest go (10,000 at most), and the rest is left to later calls.
    """
    if limit is None:
        gone = F.col("published_at").isNotNull() & (F.col("created_at") < F.lit(before))
        return events.where(~F.coalesce(gone, F.lit(False)))
    gone = compaction_candidates(events, before, limit).select("event_id")
    # gone holds at most 10,000 ids
    return events.join(F.broadcast(gone), "event_id", "left_anti")


MAX_WAIT_RETRIES = 5


def step_export_queue(
    items: DataFrame, readiness: DataFrame, results: DataFrame, dismissed: DataFrame
) -> DataFrame:
    """One tick of the export queue for all rows.

    The three inputs carry (export_item_id, flag). Output keeps the item columns with their new
    values plus ``before``, ``delay_seconds`` and ``stepped`` (true for rows that made a step).
    """
    j = items
    for name, side in (("__ready", readiness), ("__done", results), ("__gone", dismissed)):
        flags = side.groupBy("export_item_id").agg(F.bool_or("flag").alias(name))
        j = j.join(flags, "export_item_id", "left")
    flag = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("__ready", "__done", "__gone")}
    state, tries = F.col("state"), F.col("attempts")
    live = state.isin("waiting", "ready")
    gone = live & flag["__gone"]
    waiting, ready = live & (state == "waiting"), live & (state == "ready")
    after = (
        F.when(gone, "skipped")
        .when(waiting & flag["__ready"], "ready")
        .when(waiting & (tries + 1 > MAX_WAIT_RETRIES), "failed")
        .when(waiting, "waiting")
        .when(ready & flag["__done"], "exported")
        .when(ready & (tries >= MAX_WAIT_RETRIES), "failed")
        .otherwise(state)
    )
    copy_retry = ready & ~flag["__done"] & (tries < MAX_WAIT_RETRIES)
    next_tries = F.when(gone, tries).when(waiting | copy_retry, tries + 1).otherwise(tries)
    wait_retry = waiting & ~flag["__ready"] & (tries + 1 <= MAX_WAIT_RETRIES)
    delay = F.when(~gone & (wait_retry | copy_retry), retry_delay(tries + 1, 2.0, 60.0))
    error = (
        F.when(gone, None)
        .when(waiting & flag["__ready"], None)
        .when(waiting & (tries + 1 > MAX_WAIT_RETRIES), "extraction_timeout")
        .when(ready & flag["__done"], None)
        .when(ready & (tries >= MAX_WAIT_RETRIES), "export_failed")
        .otherwise(F.col("error"))
    )
    stepped = gone | (
        live & ((after != state) | delay.isNotNull() | ~error.eqNullSafe(F.col("error")))
    )
    done = after == "exported"
    return j.select(
        "export_item_id",
        state.alias("before"),
        after.alias("state"),
        F.when(stepped, next_tries).otherwise(tries).alias("attempts"),
        F.when(stepped, error).otherwise(F.col("error")).alias("error"),
        F.when(stepped & ~done, F.lit(None))
        .otherwise(F.col("destination_path"))
        .alias("destination_path"),
        F.when(stepped, done).otherwise(F.col("verified")).alias("verified"),
        delay.alias("delay_seconds"),
        stepped.alias("stepped"),
    )


def idempotent_jobs(
    submissions: DataFrame, existing: DataFrame, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, conflicts)`` of job submissions.

    The first submission of a key (or the stored job) decides its payload; repeats with the same
    payload are the same job, repeats with another payload are conflicts.
    """
    payload = F.struct("job_type", "case_id", "input_json")
    first = submissions.groupBy("idempotency_key").agg(
        F.min_by(F.struct("job_id", "job_type", "case_id", "input_json"), F.struct(*order)).alias(
            "__first"
        )
    )
    stored = existing.select(
        "idempotency_key",
        F.struct("job_id", "job_type", "case_id", "input_json").alias("__stored"),
    )
    owner = first.join(stored, "idempotency_key", "left").select(
        "idempotency_key",
        F.coalesce("__stored", "__first").alias("__owner"),
        F.col("__stored").isNotNull().alias("already_stored"),
    )
    accepted = owner.select(
        F.col("__owner.job_id").alias("job_id"), "idempotency_key", "already_stored",
        F.col("__owner.input_json").alias("input_json"),
    )
    same = payload.eqNullSafe(
        F.struct(F.col("__owner.job_type"), F.col("__owner.case_id"), F.col("__owner.input_json"))
    )
    conflicts = submissions.join(owner, "idempotency_key").where(~same).select(
        "job_id", "idempotency_key", F.col("__owner.job_id").alias("owner_job_id")
    )
    return accepted, conflicts


def transition_checks(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str,
    allowed: dict[str, tuple[str, ...]],
    start: str | None = None,
) -> DataFrame:
    """State changes that the transition table does not allow.

    ``start`` is the state before the first row; without it the first row is always fine. The table
    is a constant of a few dozen pairs, so it is tested in the row, not joined.
    """
    pairs = [f"{a}>{b}" for a, targets in allowed.items() for b in targets]
    with_prev = with_neighbour(log, keys, order, {"state": F.col(state)}, "__prev")
    before = F.coalesce(F.col("__prev.state"), F.lit(start))
    move = F.concat(before, F.lit(">"), F.col(state))
    closed = [s for s, targets in allowed.items() if not targets]
    return (
        with_prev.withColumn("from_state", before)
        .where(before.isNotNull() & ~F.coalesce(move.isin(*pairs), F.lit(False)))
        .withColumn("to_state", F.col(state))
        .withColumn(
            "reason",
            F.when(~F.col(state).isin(*allowed), "unknown_state")
            .when(F.col("from_state").isin(*closed), "terminal_state")
            .otherwise("invalid_transition"),
        )
        .drop("__prev", *([state] if state != "to_state" else []))
    )


def job_states(
    log: DataFrame, keys: Sequence[str] = ("job_id",), base: int = 30, cap: int = 300
) -> DataFrame:
    """Current state of every job from its log of (keys, seq, to_state, error_class, changed_at).

    ``attempts`` counts leases. A failed attempt is retried when its error is transient (or the
    process died) and attempts are left; its retry time follows the capped exponential delay.
    """
    last = log.groupBy(*keys).agg(
        F.max_by(F.struct("to_state", "error_class", "changed_at"), "seq").alias("__last"),
        F.count_if(F.col("to_state") == "leased").alias("attempts"),
        F.max("max_attempts").alias("max_attempts"),
    )
    state, error = F.col("__last.to_state"), F.col("__last.error_class")
    left = F.col("attempts") < F.col("max_attempts")
    failed = error.isNotNull()
    retryable = failed & error.isin("transient", "process-death") & left
    now = F.when(retryable, "retrying").when(failed, "failed").otherwise(state)
    delay = retry_delay(F.greatest(F.col("attempts"), F.lit(1)), float(base), float(cap))
    return last.select(
        *keys,
        now.alias("state"),
        "attempts",
        F.when(
            retryable & (error == "transient"),
            F.timestamp_seconds(F.unix_timestamp(F.col("__last.changed_at")) + delay.cast("long")),
        ).alias("retry_after_at"),
        F.coalesce(retryable, F.lit(False)).alias("retryable"),
        now.isin(*CLOSED_JOB_STATES).alias("closed"),
    )


def job_transition_checks(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return transition_checks(log, keys, order, "to_state", JOB_TRANSITIONS)


