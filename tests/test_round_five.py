"""Queries that list pairs list all of them."""

import random
from itertools import combinations

from artifactlake.operators import dedupe
from artifactlake.plans.bindings import run_sql
from artifactlake.plans.dedupe import HASHED
from artifactlake.registry import QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"


def test_related_findings_lists_every_pair(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority").collect()
    words = {"1": "critical", "2": "high", "3": "medium", "4": "low"}
    found = {}
    for r in orders:
        if r.o_orderkey % 7:
            found.setdefault(r.o_orderkey % 2000, []).append((f"f{r.o_orderkey:012d}", words.get(r.o_orderpriority[0], "info")))
    want = [(f"a{e.event_id:010d}", *f) for e in events if e.event_id % 4 for f in found.get(e.event_id % 2000, [])]
    got = QUERIES["j3_related_findings"](spark, SF)
    assert got.columns == ["browser_artifact_id", "finding_id", "severity"]
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_near_pairs_of_crowded_hashes_are_compared_in_blocks(spark):
    rng = random.Random(9)
    some = [rng.getrandbits(64) for _ in range(6)]
    hashes = {h ^ sum(1 << rng.randrange(64) for _ in range(4)) & (2**64 - 1) for h in some for _ in range(60)}
    signed = sorted(h - 2**64 if h >= 2**63 else h for h in hashes)
    df = spark.createDataFrame([([h],) for h in signed * 2] + [(None,)], "h array<long>")
    apart = {(a, b): ((a ^ b) & (2**64 - 1)).bit_count() for a, b in combinations(signed, 2)}
    want = sorted((a, b, d) for (a, b), d in apart.items() if d <= 8)
    got = dedupe.near_pairs(df, "h", 8)
    # bands list candidates for a join; here they would be more than all pairs
    assert "Join" not in got._jdf.queryExecution().toString()
    assert want and sorted((r.left_hash[0], r.right_hash[0], r.distance) for r in got.collect()) == want
    for tile in (7, 50, 1000):
        blocks = dedupe.tile_pairs(df.where("h IS NOT NULL").distinct(), 8, tile)
        assert sorted((r.left_hash[0], r.right_hash[0], r.distance) for r in blocks.collect()) == want


def test_near_duplicates_lists_every_pair_of_hashes(spark):
    bits = [r.bits for r in run_sql(spark, SF, HASHED.replace("{t}", "{documents}")).select("bits").distinct().collect()]
    apart = {(a, b): (int(a, 2) ^ int(b, 2)).bit_count() for a, b in combinations(sorted(bits), 2)}
    got = QUERIES["j17_near_duplicates"](spark, SF)
    assert got.columns == ["left_bits", "right_bits", "distance"]
    assert sorted(map(tuple, got.collect())) == sorted((a, b, d) for (a, b), d in apart.items() if d <= 8)


def test_videos_with_many_near_frames_meet_in_blocks(spark, monkeypatch):
    """Frames that are near nearly all others give no list of near frames or owners, and the same clusters."""
    rng = random.Random(31)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    middle = [rng.getrandbits(64) for _ in range(4)]

    def frame(k):
        return signed(middle[k] ^ sum(1 << b for b in rng.sample(range(64), 5)))

    # videos of two centres each, of one centre, and strangers
    videos = [(f"v{i:03d}", [frame(i % 2), frame(2 + i % 2)][:: 1 if i % 3 else -1]) for i in range(150)]
    videos += [(f"w{i:03d}", [signed(rng.getrandbits(64)), frame(0)]) for i in range(40)]
    videos += [(f"x{i:03d}", [frame(3)] * 30) for i in range(3)]
    listed = []
    for name in ("_near_apart", "meet_apart"):
        old = getattr(dedupe, name)

        def counted(*args, old=old):
            found = old(*args)
            listed.append(found.count())
            return found

        monkeypatch.setattr(dedupe, name, counted)
    monkeypatch.setattr(dedupe, "PAIRS_HELD", 500)
    sequence = dict(videos)

    def two(left, right):
        used = set()
        for x in left:
            near = [j for j, y in enumerate(right) if j not in used and ((x ^ y) & (2**64 - 1)).bit_count() <= 10]
            used |= set(near[:1])
        return len(used) >= 2

    label = {v: v for v in sequence}
    for a, b in combinations(sorted(sequence), 2):
        if label[a] != label[b] and two(sequence[a], sequence[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {v: new if x == old else x for v, x in label.items()}
    df = spark.createDataFrame(videos, "finding_id string, seq array<long>")
    for tile in (dedupe.TILE, 60):
        monkeypatch.setattr(dedupe._by_two_frames, "__defaults__", (tile,))
        edges, _ = dedupe.video_edges(df, 10, 2)
        got = {v: v for v in sequence} | {r.b: r.a for r in edges.collect()}
        assert got == label
    # a row a frame at most
    assert sum(listed) <= sum(map(len, sequence.values()))
