"""Greedy time throttling per key: keep a row only if enough time passed since the last kept one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grouped import fold_sorted, follow_chain, last_before, number_rows
from ..session import settle

FOLD_LIMIT = 100_000


def _step(last: int | None, row: tuple) -> tuple[int | None, bool]:
    at, gap = row
    take = last is None or at - last >= gap
    return (at if take else last), take


def _fold(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fold_sorted(
        rows, keys, "__thr_pos", ["__thr_at", "__thr_gap"], "kept", T.BooleanType(), lambda: None, _step
    )


def greedy_throttle(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    at: str,
    gap: str,
    limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Add ``kept``. ``at`` is in whole seconds and the first order column, ``gap`` per key constant.

    Keys up to ``limit`` rows are folded in time order. For longer keys every row points to the first
    row at least ``gap`` later, and the kept rows are the walk along these pointers from the first
    row: log2(rows) joins instead of one task per key.
    """
    rows = number_rows(df.withColumn("__thr_at", F.col(at)).withColumn("__thr_gap", F.col(gap)), keys, order, "__thr_pos")
    narrow = rows.select(*keys, "__thr_pos", "__thr_at", "__thr_gap")
    sizes = narrow.groupBy(*keys).agg(F.max("__thr_pos").alias("__n"))
    long_keys = sizes.where(F.col("__n") > limit).select(*keys)
    if long_keys.isEmpty():
        # whole rows go through the fold: no join back
        return _fold(rows, keys).drop("__thr_pos", "__thr_at", "__thr_gap")
    rows = settle(rows)
    narrow = rows.select(*keys, "__thr_pos", "__thr_at", "__thr_gap")
    short = _fold(narrow.join(long_keys, list(keys), "left_anti"), keys)
    walked = _walk(narrow.join(long_keys, list(keys), "left_semi"), keys)
    kept = short.where("kept").select(*keys, "__thr_pos").unionByName(walked)
    return (
        rows.join(kept.withColumn("kept", F.lit(True)), [*keys, "__thr_pos"], "left")
        .withColumn("kept", F.coalesce("kept", F.lit(False)))
        .drop("__thr_pos", "__thr_at", "__thr_gap")
    )


def _walk(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    # read backwards in time, "the next row at or after t" is the last row before it
    none = F.lit(None).cast("long")
    points = rows.select(
        *keys, (-F.col("__thr_at")).alias("__t"), F.lit(0).alias("__role"), (-F.col("__thr_pos")).alias("__o"), F.col("__thr_pos").alias("__to")
    )
    asks = rows.select(
        *keys,
        (-(F.col("__thr_at") + F.col("__thr_gap"))).alias("__t"),
        F.lit(1).alias("__role"),
        (-F.col("__thr_pos")).alias("__o"),
        none.alias("__to"),
    )
    found = last_before(points.unionByName(asks), keys, ["__t", "__role", "__o"], "__to", "__next")
    jump = found.where("__role = 1").select(*keys, (-F.col("__o")).alias("__thr_pos"), "__next")
    return follow_chain(jump, rows.where("__thr_pos = 1").select(*keys, "__thr_pos"), keys, "__thr_pos", "__next")
