"""Connected components of the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouped import join_groups
from ..session import settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) with the smallest node of each component as its label.

    Alternates large-star and small-star steps until the edges stop changing; each step is an
    aggregate and an equi-join, written to the checkpoint folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = settle(
        both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _fingerprint(now)
    while True:
        now = settle(_small_star(_large_star(now)))
        after = _fingerprint(now)
        if after == mark:
            break
        mark = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = stars.select(F.col("label").alias("node"), "label").distinct()
    return stars.unionByName(roots)


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 65_537)).first()
    return tuple(row)


def _with_min(pairs: DataFrame, low: Column) -> DataFrame:
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n"))
    smallest = smallest.withColumn("m", low)
    return join_groups(pairs, smallest, ["u"], "__n")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_min(both, F.least("u", "m")).where("v > u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    near = _with_min(down, F.col("m"))
    others = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = near.select("u", F.col("m").alias("v"))
    return others.unionByName(own).where("u <> v").distinct()
