"""Mixing sources to target weights by pivotal rounding.

Every source has a target size; each of its documents gets the same expected number of copies,
``target / source size``. The whole part is taken outright. The fractional parts are rounded by pivotal
steps: two documents meet, probability moves from one to the other at random until one of them is 0 or
1, and the other goes on. Each step keeps every expectation and the sum, so exactly the right number of
documents (up to one) is taken. Documents meet neighbours of like size, so the words taken stay near
the target as well. Groups of bounded size are worked off in parallel; each leaves at most one open
document per source, and the open ones meet again in a tree of ever larger groups.

Documents that are large against their source's target are rounded first, class by class. What was really
taken then sets the share of the smaller ones, which fill the target up or give way; a document left open
at the end of a class is taken only where the smaller ones could not fill its place.

All random choices are hashes of the row, and groups follow from hashes too: a rerun gives the same mix,
however the rows are partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import settle
from .common import annotate, word_bounds

#: documents of a leaf group, and groups that meet in the next level
LEAF, FAN = 4096, 64
#: a document's size class is the number of these shares of its source's target that it does not exceed
CLASSES = (1 / 4, 1 / 16, 1 / 64)


def sizes(docs: DataFrame, text: str = "text", keep=None) -> DataFrame:
    """``keep`` columns and ``size``: the words of the text (null: 0)."""

    def make(raw, at):
        return [np.diff(word_bounds(raw, at)[2]).astype(np.int64)]

    return annotate(docs, T.StructType([T.StructField("size", T.LongType())]), make, text, keep)


def targets(rows: DataFrame, weights=(5, 2, 1), cap: int = 3, source: str = "source") -> DataFrame:
    """(source, source_size, n_rows, target) per source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A
    target stops at ``cap`` times its source's size; what is over goes to the others by weight, until no
    target is above. Only sums over sources reach the driver, once per round.
    """
    by = settle(rows.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    # position of a source: sources before its slice, and those before it in the slice
    sliced = settle(
        by.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select("*", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("at"))
    )
    per = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    # one row per slice: no more than the shuffle has partitions
    earlier = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = per.select("slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = settle(sliced.join(F.broadcast(before), "slice").select("source", "source_size", "n_rows", weight.alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * cap
    rate = 0.0
    while True:
        full = limit <= F.col("weight") * rate
        row = ranked.agg(
            F.sum(F.when(full, limit).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = (total - row["capped"]) / row["open"]
        if new <= rate:
            break
        rate = new
    target = F.least(limit.cast("double"), F.col("weight") * rate)
    return ranked.select("source", "source_size", "n_rows", target.alias("target"))


def pivotal(prob: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities in order; returns them with at most one still open, and its place (-1: none).

    ``uniform`` holds one random number in [0, 1) per step.
    """
    out = prob.copy()
    held = -1
    for i in range(len(out)):
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], out[i]
        total = a + b
        if total < 1.0:
            # one of the two drops to 0, the other takes all
            stays = held if uniform[i] * total < a else i
            out[held], out[i] = 0.0, 0.0
            out[stays] = total
            held = stays
        else:
            # one of the two is taken, the other keeps the rest
            rest = total - 1.0
            taken = held if uniform[i] * (2.0 - total) < 1.0 - b else i
            other = i if taken == held else held
            out[taken], out[other] = 1.0, rest
            held = other
        if out[held] < 1e-9 or out[held] > 1 - 1e-9:
            out[held] = round(out[held])
            held = -1
    return out, held


STEP = T.StructType(
    [
        T.StructField("group", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("prob", T.DoubleType()),
    ]
)


def _round_groups(rows: DataFrame, level: int) -> DataFrame:
    """One tree level: pivotal steps inside each (source, group)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], kind="stable").reset_index(drop=True)
        key = pdf["key"].to_numpy().view(np.uint64)
        seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
        x = key ^ seed
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        uniform = ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        pdf["prob"], _ = pivotal(pdf["prob"].to_numpy(), uniform)
        return pdf

    return rows.groupBy("source", "group").applyInPandas(one, STEP)


def mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, id_col: str = "doc_id", text: str = "text", source: str = "source", leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(id, digest, nth, size, source, source_size, target, copies) of each row of ``docs``.

    ``copies`` is the number of times the mix takes the row, at most ``cap``; ``digest`` is the hash of
    its text and ``nth`` numbers rows equal in id, text and source. A null text has size 0; rows without
    words are never taken. A null source is a source of its own, the last. The words taken of a source
    come near its target: large documents are rounded first, smaller ones make up for them.
    """
    measured = sizes(
        docs.select(
            F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col(text),
            F.xxhash64(text).alias("digest"),
        ),
        text, ["id", "source", "digest"],
    )
    # equal rows are counted, not listed: a repeated row can't make a group large
    rows = settle(measured.groupBy("id", "source", "digest", "size").agg(F.count("*").alias("times")))
    numbered = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).drop("times")
    by = settle(targets(numbered, weights, cap))
    named = by.select(F.col("source").alias("__source"), "source_size", "target")
    joined = numbered.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    key = F.xxhash64("id", "digest", "nth", "source")
    large = [(F.col("size") <= F.col("target") * share).cast("int") for share in CLASSES]
    ready = settle(joined.select("*", key.alias("key"), sum(large[1:], large[0]).alias("class")))
    # words that a source still has to take, and words of its documents that are not decided
    left = by.select(F.col("source").alias("__source"), F.col("target").alias("left"), F.col("source_size").alias("undecided"))
    done = None
    for number in [r[0] for r in ready.where("size > 0").select("class").distinct().orderBy("class").collect()]:
        decided, left = _mix_class(ready.where((F.col("size") > 0) & (F.col("class") == number)), left, cap, leaf, fan)
        done = decided if done is None else done.unionByName(decided)
    copies = F.lit(0)
    if done is not None:
        ready = ready.join(done, "key", "left")
        copies = F.coalesce("copies", F.lit(0))
    return ready.select("id", "digest", "nth", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _mix_class(rows: DataFrame, left: DataFrame, cap: int, leaf: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(key, copies) of the rows of one size class, and what is left to take per source."""
    ratio = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.col("left") / F.col("undecided")))
    shares = left.where("undecided > 0").select("__source", ratio.alias("ratio"))
    whole = F.floor("ratio")
    part = F.col("ratio") - whole
    # near-integers are integers: the sums behind them are exact, the division is not
    whole = F.when(part > 1 - 1e-9, whole + 1).otherwise(whole)
    part = F.when((part < 1e-9) | (part > 1 - 1e-9), 0.0).otherwise(part)
    shared = rows.join(shares, F.col("source").eqNullSafe(F.col("__source")))
    shared = settle(shared.select("source", "key", "size", whole.cast("long").alias("whole"), part.alias("prob")))
    taken, opened = _round_tree(shared.where("prob > 0").select("source", "key", "size", "prob"), leaf, fan)
    sure = shared.join(taken.withColumn("extra", F.lit(1)), "key", "left")
    sure = settle(sure.select("source", "key", "size", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")))
    sums = sure.groupBy(F.col("source").alias("__s")).agg(F.sum("size").alias("own"), F.sum(F.col("size") * F.col("copies")).alias("got"))
    after = left.join(sums, F.col("__source").eqNullSafe(F.col("__s")), "left").select(
        "__source", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"), (F.col("undecided") - F.coalesce("own", F.lit(0))).alias("undecided")
    )
    # at most one open document a source
    last = opened.select(F.col("source").alias("__s"), F.col("key").alias("__key"), F.col("size").alias("__size"))
    needed = F.col("left") - F.col("undecided") * cap > F.col("__size") / 2
    after = settle(
        after.join(last, F.col("__source").eqNullSafe(F.col("__s")), "left").select(
            "__source", "undecided", F.when(needed, F.col("left") - F.col("__size")).otherwise(F.col("left")).alias("left"),
            F.when(needed, F.col("__key")).alias("__key"),
        )
    )
    more = after.where("__key IS NOT NULL").select(F.col("__key").alias("key"), F.lit(1).alias("more"))
    decided = sure.join(more, "key", "left").select("key", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))
    return decided, after.drop("__key")


def _round_tree(opened: DataFrame, leaf: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(key) of the rows that pivotal rounding takes, and the row that each source is left with, if any."""
    # groups of like sizes: a quarter of a doubling, cut by hash where it has too many rows
    band = F.floor(F.log2(F.col("size").cast("double")) * 4).cast("long")
    opened = opened.select("*", band.alias("band"))
    cuts = F.greatest(F.lit(1), F.ceil(F.count("*") / leaf)).cast("long").alias("cuts")
    bands = opened.groupBy(F.col("source").alias("__source"), F.col("band").alias("__band")).agg(cuts)
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("band") == F.col("__band"))
    state = opened.join(bands, same).select(
        "source", "key", "size", "prob", "band", F.pmod("key", "cuts").alias("cut"), "cuts"
    )
    done = opened.select("key").limit(0)
    level = 0
    while True:
        state = settle(state)
        most, top = state.agg(F.max("cuts"), F.max("band")).first()
        if most is None:
            return done, opened.limit(0)
        work = state.select(F.xxhash64("band", "cut").alias("group"), "source", "key", "size", "prob")
        rounded = settle(_round_groups(work, level))
        over = F.col("prob").isin(0.0, 1.0)
        done = done.unionByName(rounded.where(F.col("prob") == 1.0).select("key"))
        if most == 1 and top == -1:
            return done, rounded.where(~over)
        rest = rounded.where(~over).join(state.select("key", "band", "cut", "cuts"), "key")
        if most > 1:
            fewer = F.ceil(F.col("cuts") / fan).cast("long")
            state = rest.select("source", "key", "size", "prob", "band", (F.col("cut") % fewer).alias("cut"), fewer.alias("cuts"))
        else:
            state = rest.select("source", "key", "size", "prob", F.lit(-1).cast("long").alias("band"), F.lit(0).cast("long").alias("cut"), F.lit(1).cast("long").alias("cuts"))
        level += 1


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or repeated."""
    taken = mix(docs, id_col=id_col, text=text, source=source, **options).where("copies > 0")
    # rows equal in id, text and source share their copies
    counts = taken.groupBy("id", "digest", "source").agg(F.sum("copies").alias("__copies"), F.max("nth").alias("__nth"))
    counts = settle(counts.withColumnsRenamed({"id": "__id", "digest": "__d", "source": "__s"}))
    rows = docs.withColumn("__digest", F.xxhash64(text))
    on = (F.col("__digest") == F.col("__d")) & F.col(id_col).eqNullSafe(F.col("__id"))
    joined = rows.join(counts, on & F.col(source).cast("string").eqNullSafe(F.col("__s")))
    several = joined.where("__nth > 1").dropDuplicates(["__digest", "__id", "__s"])
    out = joined.where("__nth = 1").unionByName(several)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
