"""Queries and check SQL on rows that the small tables lack."""

import os
import random

import pytest
from pyspark.sql import functions as F

from artifactlake.operators import dedupe, joins
from artifactlake.plans.bindings import TABLES
from artifactlake.registry import load_all

from .oracle import compare

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """``tables(name=DataFrame)`` gives a folder with these tables and the small ones for the rest."""

    def make(**own):
        for name in TABLES:
            target = f"{tmp_path}/{name}.parquet"
            if name in own:
                own[name].toPandas().to_parquet(target, row_group_size=200, coerce_timestamps="us", allow_truncated_timestamps=True)
            else:
                os.symlink(f"{SF}/{name}.parquet", target)
        return str(tmp_path)

    return make


@pytest.mark.parametrize("name", ["c13_validate_artifacts", "c13_artifact_rejects"])
def test_confidence_above_one_is_rejected(spark, tables, name):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("event_id") * 20)
    ok, message = compare(spark, tables(events=events), name)
    assert ok, message


@pytest.mark.parametrize("name", ["c22_accept_derivatives", "c22_derivative_warnings"])
def test_thumbnails_with_ties_and_fractions(spark, tables, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    # supplier 1,000 of an order has the ord of supplier 0 of the next one
    ties = lines.limit(200).withColumns(
        {"l_partkey": F.lit(7).cast("long"), "l_linenumber": F.lit(3), "l_returnflag": F.lit("N"), "l_extendedprice": F.lit(100.0)}
    )
    twice = ties.withColumns({"l_suppkey": F.lit(0).cast("long"), "l_orderkey": F.lit(5).cast("long")}).unionByName(
        ties.withColumns({"l_suppkey": F.lit(1000).cast("long"), "l_orderkey": F.lit(4).cast("long")})
    )
    near = lines.withColumn("l_extendedprice", F.element_at(F.array(F.lit(40000.6), F.lit(40001.0), F.lit(0.4)), (F.col("l_orderkey") % 3 + 1).cast("int")))
    ok, message = compare(spark, tables(lineitem=twice.unionByName(near)), name)
    assert ok, message


def test_leases_of_one_second_in_several_files(spark, tables):
    """Beats of one second are in the order of their microseconds; a delivery of many files loses none."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    # the same events again, half a second earlier, by larger ids
    again = events.withColumns({"event_id": F.col("event_id") + 5000, "ts": F.date_trunc("second", "ts")})
    folder = tables(events=events.withColumn("ts", F.date_trunc("second", "ts") + F.expr("INTERVAL 500 MILLISECONDS")).unionByName(again))
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    spark.conf.set(size, "8k")
    spark.conf.set(cost, "0")
    try:
        ok, message = compare(spark, folder, "t7_expired_leases_stream")
    finally:
        spark.conf.unset(size)
        spark.conf.unset(cost)
    assert ok, message


def test_rows_decided_alone_move_the_watermark(spark, tables):
    events = spark.read.parquet(f"{SF}/events.parquet")
    # the latest event has no rule; others end hours before it
    last = events.orderBy(F.col("ts").desc()).limit(1).withColumns(
        {"event_id": F.lit(99_999).cast("long"), "event_type": F.lit("signup"), "ts": F.col("ts") + F.expr("INTERVAL 20 HOURS")}
    )
    ok, message = compare(spark, tables(events=events.unionByName(last)), "t3_notify_stream")
    assert ok, message


@pytest.mark.parametrize("tile", [7, 1000])
def test_near_counts_equal_brute_force(spark, tile):
    rng = random.Random(5)
    some = [rng.getrandbits(64) for _ in range(20)]
    hashes = {h ^ sum(1 << rng.randrange(64) for _ in range(4)) & (2**64 - 1) for h in some for _ in range(10)}
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    df = spark.createDataFrame([(h,) for h in signed * 2] + [(None,)], "h long")
    got = {r["hash"]: r["links"] for r in dedupe.near_counts(df, "h", 8, tile).collect()}
    want = {h: sum(((h ^ g) & (2**64 - 1)).bit_count() <= 8 for g in signed) - 1 for h in signed}
    assert got == want


def test_related_contents_are_not_listed_in_pairs(spark):
    left = spark.range(20_000).selectExpr("concat('a', id) AS browser_artifact_id", "if(id = 0, NULL, if(id = 1, 'alone', 'c')) AS content_id")
    right = spark.range(30_000).selectExpr("concat('f', id) AS finding_id", "'c' AS content_id", "'low' AS severity")
    got = joins.content_links(left, right).groupBy("side", "severity", "links").count().collect()
    assert sorted(map(tuple, got), key=str) == [("artifact", None, 30_000, 19_998), ("finding", "low", 19_998, 30_000)]


@pytest.mark.parametrize("tile", [7, 1000])
def test_tile_links_equal_brute_force(spark, tile):
    rng = random.Random(6)
    some = [rng.getrandbits(63) for _ in range(20)]
    hashes = sorted({h ^ sum(1 << rng.randrange(63) for _ in range(2)) for h in some for _ in range(8)})
    named = [(h - 2**62, f"l{i % 50}") for i, h in enumerate(hashes)]
    nodes = spark.createDataFrame(named, "h long, label string").select(F.array("h").alias("h"), "label")
    got = sorted(map(tuple, dedupe.tile_links(nodes, 3, tile).collect()))
    near = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= 3
    assert got == sorted({(a, b) for x, a in named for y, b in named if a < b and near(x, y)})
    assert got


def test_signatures_of_short_texts_and_archives(spark, tables):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = ["", "abc", "MZ12", "%PDF-1 MZ", "GIF89a", "ID3 x", "{\\rtf1", "a xl/ b", "a ppt/ b", "a word/ b", "plain"]
    own = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.floor(F.col("doc_id") / 2) % len(texts) + 1).cast("int"))
    folder = tables(documents=docs.withColumns({"doc_id": F.col("doc_id") * 2, "text": own}))
    ok, message = compare(spark, folder, "c1_content_signature")
    assert ok, message
