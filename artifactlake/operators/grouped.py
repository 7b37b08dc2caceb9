"""Ordered work inside groups that stays parallel when one group is huge.

``Window.partitionBy(key)`` sends a whole key to one task. The helpers here ask first how large
the largest group is; above ``limit`` they cut the data by range over (key, order), work inside each
slice, and carry one row per (key, slice) across the cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import settle

GROUP_LIMIT = 2_000_000


def peak_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group (one partially aggregated pass over the key columns)."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(top[0] or 0)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi join on ``keys`` where NULL equals NULL; right key columns are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return settle(ranged.withColumn("__slice", F.spark_partition_id()))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """1-based position of each row inside its group, ordered ascending by ``order``."""
    if peak_group(df, keys) <= limit:
        win = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(win).cast("long"))
    sliced = _sliced(df, keys, order)
    local = W.partitionBy("__slice", *keys).orderBy(*order)
    earlier = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        *keys, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    rows = sliced.withColumn("__at", F.row_number().over(local))
    joined = join_null_safe(rows, before, [*keys, "__slice"])
    return joined.withColumn(out, (F.col("__at") + F.col("__before")).cast("long")).drop(
        "__slice", "__at", "__before"
    )


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    out: str,
    ahead: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add ``out``: a struct of ``values`` taken from the previous (or next) row of the group.

    ``out`` is NULL on the group's first (or last) row.
    """
    packed = F.struct(*[expr.alias(name) for name, expr in values.items()])
    pick = F.lead if ahead else F.lag
    if peak_group(df, keys) <= limit:
        return df.withColumn(out, pick(packed).over(W.partitionBy(*keys).orderBy(*order)))
    sliced = _sliced(df.withColumn("__packed", packed), keys, order)
    local = W.partitionBy("__slice", *keys).orderBy(*order)
    rank = F.struct(*order)
    edge = F.min_by("__packed", rank) if ahead else F.max_by("__packed", rank)
    across = W.partitionBy(*keys).orderBy("__slice")
    carried = (
        sliced.groupBy(*keys, "__slice")
        .agg(edge.alias("__edge"))
        .select(*keys, "__slice", pick("__edge").over(across).alias("__carried"))
    )
    rows = sliced.withColumn("__near", pick("__packed").over(local))
    joined = join_null_safe(rows, carried, [*keys, "__slice"])
    return joined.withColumn(out, F.coalesce("__near", "__carried")).drop(
        "__slice", "__packed", "__near", "__carried"
    )


def follow_chain(
    pointers: DataFrame, starts: DataFrame, keys: Sequence[str], at: str, to: str
) -> DataFrame:
    """Positions reached from ``starts`` through ``at -> to`` pointers, by pointer doubling.

    A greedy scan ("take this row, skip to the next row allowed after it") is a walk along such
    pointers. Doubling needs log2(longest walk) joins and never puts a group into one task.
    ``pointers`` has one row per (keys, at) with ``to`` > ``at``; a NULL ``to`` ends the walk.
    """
    step = settle(pointers.where(F.col(to).isNotNull()).select(*keys, at, to))
    reached = starts.select(*keys, at)
    while not step.isEmpty():
        moved = reached.join(step, [*keys, at]).select(*keys, F.col(to).alias(at))
        reached = settle(reached.unionByName(moved))
        second = step.select(*keys, F.col(at).alias(to), F.col(to).alias("__far"))
        step = settle(step.join(second, [*keys, to]).select(*keys, at, F.col("__far").alias(to)))
    return reached


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add ``out``: the last non-NULL ``value`` among the rows before this one in its group."""
    upto = lambda win: win.rowsBetween(W.unboundedPreceding, -1)
    if peak_group(df, keys) <= limit:
        win = upto(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, F.last(value, ignorenulls=True).over(win))
    sliced = _sliced(df, keys, order)
    local = upto(W.partitionBy("__slice", *keys).orderBy(*order))
    across = upto(W.partitionBy(*keys).orderBy("__slice"))
    rank = F.when(F.col(value).isNotNull(), F.struct(*order))
    carried = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.max_by(value, rank).alias("__last"))
        .select(
            *keys, "__slice", F.last("__last", ignorenulls=True).over(across).alias("__carried")
        )
    )
    rows = sliced.withColumn("__near", F.last(value, ignorenulls=True).over(local))
    joined = join_null_safe(rows, carried, [*keys, "__slice"])
    return joined.withColumn(out, F.coalesce("__near", "__carried")).drop(
        "__slice", "__near", "__carried"
    )


def max_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add ``out``: the greatest ``value`` among the rows before this one in its group."""
    upto = lambda win: win.rowsBetween(W.unboundedPreceding, -1)
    if peak_group(df, keys) <= limit:
        return df.withColumn(out, F.max(value).over(upto(W.partitionBy(*keys).orderBy(*order))))
    sliced = _sliced(df, keys, order)
    local = upto(W.partitionBy("__slice", *keys).orderBy(*order))
    across = upto(W.partitionBy(*keys).orderBy("__slice"))
    tops = sliced.groupBy(*keys, "__slice").agg(F.max(value).alias("__top"))
    carried = tops.select(*keys, "__slice", F.max("__top").over(across).alias("__carried"))
    joined = join_null_safe(sliced.withColumn("__near", F.max(value).over(local)), carried, [*keys, "__slice"])
    # greatest() passes over nulls
    return joined.withColumn(out, F.greatest("__near", "__carried")).drop("__slice", "__near", "__carried")


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, hot_rows: int = 1_000_000
) -> DataFrame:
    """Inner join of rows with one row per group that carries the group's size.

    Groups above ``hot_rows`` rows are few (their number is at most rows / hot_rows and is checked):
    they are broadcast, so their rows never meet in one task. The others take a plain join.
    """
    hot = groups.where(F.col(size) > hot_rows)
    few = hot.limit(10_001).count()
    if few == 0 or few > 10_000:
        # too many for a broadcast: adaptive execution splits the skewed partitions instead
        return rows.join(groups, list(keys))
    warm = groups.where(F.col(size) <= hot_rows)
    return rows.join(F.broadcast(hot), list(keys)).unionByName(rows.join(warm, list(keys)))


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on costly derived columns without copying their expressions.

    Catalyst pushes a filter below the projection that makes its columns and repeats their
    expressions there, once per use. A projection with a random column is not crossed, so the columns
    are made once and then filtered. (Plain filters should be pushed down; use this on derived ones.)
    """
    return df.withColumn("__held", F.rand(0)).where((F.col("__held") >= 0) & cond).drop("__held")


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Sequence[str],
    out: str,
    out_type: T.DataType,
    start: Callable[[], Any],
    step: Callable[[Any, tuple], tuple[Any, Any]],
) -> DataFrame:
    """Add ``out`` by a fold over each key's rows in order of ``pos``.

    Rows are shuffled by key and sorted inside their partition; one Arrow stream per task carries only
    the fold state from row to row, so no group is ever held in memory.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, out_type)])
    key_names, value_names = list(keys), list(values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            made = []
            key_rows = zip(*[pdf[k].tolist() for k in key_names], strict=True)
            value_rows = zip(*[pdf[v].tolist() for v in value_names], strict=True)
            for key, row in zip(key_rows, value_rows, strict=True):
                if key != current:
                    current, state = key, start()
                state, result = step(state, row)
                made.append(result)
            yield pdf.assign(**{out: made})

    ready = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, pos)
    return ready.mapInPandas(run, schema)
