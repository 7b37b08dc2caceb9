"""Sweeps over ranges and trees of digests, with limits that small data crosses."""

import hashlib
import random

import pytest

from artifactlake.operators.joins import inside_any
from artifactlake.sources.exports import ordered_digest


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_inside_any(spark, limit):
    draw = random.Random(2)
    ranges = [(s, s + draw.choice([0, 1, 7, 60])) for s in (draw.randrange(2000) for _ in range(60))]
    ranges += [(100, 90), (None, 50), (60, None), (1 << 44, (1 << 44) + (20 << 40))]
    points = [draw.randrange(2200) for _ in range(400)] + [(1 << 44) + (19 << 40), (1 << 44) - 1, None]
    want = {p for p in points if p is not None and any(s is not None and t is not None and s <= p < t for s, t in ranges)}
    got = inside_any(
        spark.createDataFrame([(p,) for p in points], "at long"), spark.createDataFrame(ranges, "s long, t long"), "at", "s", "t", limit
    ).collect()
    assert len(got) == len(want) and {r.at for r in got} == want


@pytest.mark.parametrize("n, chunk", [(0, 3), (1, 3), (3, 3), (4, 3), (9, 3), (10, 3), (100, 3), (100, 50_000)])
def test_ordered_digest_is_a_tree(spark, n, chunk):
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    level = [f"d{i}" for i in range(n)]
    level = [sha(level[i : i + chunk]) for i in range(0, n, chunk)]
    while len(level) > chunk:
        level = [sha(level[i : i + chunk]) for i in range(0, len(level), chunk)]
    rows = spark.createDataFrame([(i, f"d{i}") for i in range(n)], "id int, d string").repartition(3)
    out = ordered_digest(rows, "d", ["id"], chunk).first()
    assert (out.manifest_sha256, out["items"]) == (sha(level), n or None)
