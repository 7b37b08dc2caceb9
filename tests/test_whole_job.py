"""Rows beyond the limits that operators once had come out whole."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from artifactlake.functions.classify import cluster_chain
from artifactlake.operators import nested, paging, paths, records, updates


def test_compact_removes_all_published(spark):
    events = spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.when(F.col("id") >= 5, F.lit("2024-01-02")).cast("timestamp").alias("published_at"),
    )
    left = updates.compact(events, "2024-01-20 00:00:00")
    assert sorted(r["event_id"] for r in left.collect()) == [0, 1, 2, 3, 4]
    assert updates.compact(events, "2024-01-01 00:00:00").count() == 3000
    for limit in (0, 10_001):
        with pytest.raises(paging.PagingError):
            paging.compaction_candidates(events, "2024-01-20 00:00:00", limit)
    for limit in (0, 501):
        with pytest.raises(paging.PagingError):
            paging.events_after(events, 1, 0, limit)


@pytest.mark.parametrize(("kind", "limit"), [("remote", 1024), ("local", 4096)])
def test_long_paths_stay_apart(spark, kind, limit):
    start = "/".join(f"folder{i}" for i in range(limit // 8))
    names = [f"{start}/a.txt", f"{start}/b.txt", "é" * limit + "a", "é" * limit + "b"]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r["path"]: r for r in paths.safe_paths(rows, "path", kind).collect()}
    assert len({r["destination_path"] for r in got.values()}) == 4
    for name, r in got.items():
        assert len(r["destination_path"].encode()) < limit
        assert r["destination_path"].split("/")[-1] == hashlib.sha256(name.encode()).hexdigest()
        assert "long_path_truncated" in r["deviations"]
    assert got[names[0]]["destination_path"].startswith("folder0/folder1/")


def test_long_media_metadata_stays_whole(spark):
    long = {f"{'k' * 300}{i}": "v" * 5000 + str(i) for i in range(300)}
    schema = "width int, height int, duration_seconds double, latitude double, longitude double, device map<string,string>, raw_metadata map<string,string>, malformed boolean"
    rows = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0, long, long, False)], schema)
    got = records.normalize_media(rows).first()
    assert got["device"] == long and got["raw_metadata"] == long


def test_long_cluster_chain_stays_whole(spark):
    rows = spark.range(1).select(F.sequence(F.lit(2), F.lit(5001)).cast("array<bigint>").alias("c"))
    got = rows.select(cluster_chain(F.col("c")).alias("c")).first()["c"]
    assert list(got["clusters"]) == list(range(2, 5002)) and got["status"] == "complete"


def test_long_trash_path_stays_whole(spark):
    path = "C:\\" + "x" * 400
    raw = path.encode("utf-16-le")

    def content(stated):
        return bytearray((2).to_bytes(4, "little") + bytes(4) + (7).to_bytes(8, "little") + stated.to_bytes(4, "little") + raw)

    rows = spark.createDataFrame([(1, content(len(raw))), (2, content(len(raw) + 2)), (3, content(2**32 - 1))], "id int, content binary")
    got = {r["id"]: r["original_path"] for r in records.parse_trash_metadata(rows, "id").collect()}
    assert got == {1: path, 2: None, 3: None}


def test_deep_tree_is_opened_to_its_end(spark):
    node = {"type": "url", "name": "deep", "url": "http://deep/"}
    for _ in range(70):
        node = {"type": "folder", "children": [node, {"type": "folder", "children": []}]}
    doc = json.dumps({"roots": {"bar": node}})
    got = nested.flatten_tree(spark.createDataFrame([(1, doc)], "id int, doc string"), "id", "doc").collect()
    assert [tuple(r) for r in got] == [(1, [0] * 71, "deep", "http://deep/")]


def test_trees_that_cannot_be_opened_are_named(spark):
    docs = [(1, '{"roots":{"a":{"type":"url"}}}'), (2, None), (3, ""), (4, "[" * 1001 + "]" * 1001), (5, '{"roots":[1]}'), (6, '{"roots":{}}')]
    rows = nested.tree_rejects(spark.createDataFrame(docs, "id int, doc string"), "id", "doc").collect()
    assert {tuple(r) for r in rows} == {(2, "no_text"), (3, "unparsable"), (4, "unparsable"), (5, "no_roots")}
    assert len(rows) == 4
