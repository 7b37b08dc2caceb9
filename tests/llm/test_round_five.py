"""Steps of the near-duplicate stage that grew faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from artifactlake.llm import common, simhash


def _sums(rng, n):
    return rng.integers(-60, 60, (n, simhash.CODE_WORDS * simhash.WIDTH)) * 2


def test_strangers_rarely_share_a_key():
    rng = np.random.default_rng(3)
    keys = simhash.strong_keys(_sums(rng, 6000))
    assert keys.shape == (6000, simhash.KEYS) and keys.min() >= 0 and keys.max() < 1 << 28
    # 18 million pairs: 80 meetings in 2**28 pairs and key are 5; segments of 20 bits met 288 times, with their balls 6,000
    met = sum(int((np.unique(k, return_counts=True)[1] - 1).sum()) for k in keys.T)
    assert met <= 30


def test_keys_are_exact_and_find_similar_sets():
    rng = np.random.default_rng(4)
    sums = _sums(rng, 50)
    keys = simhash.strong_keys(sums)
    wide = np.vstack([sums, np.full((1, sums.shape[1]), 1 << 20)])
    assert np.array_equal(simhash.strong_keys(wide)[:50], keys)
    assert np.array_equal(np.vstack([simhash.strong_keys(s[None]) for s in sums]), keys)
    assert simhash.strong_keys(sums[:0]).shape == (0, simhash.KEYS)
    found = 0
    for _ in range(300):
        base, other = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (200, 22))
        near = np.concatenate([base[:178], other])  # similarity 0.80
        a, b = (simhash.strong_keys(simhash.set_sums(x)[None]) for x in (base, near))
        found += bool((a == b).any())
    assert found >= 270


def test_similar_groups_meet_by_whole_keys(spark, monkeypatch):
    """Unlike texts propose next to no pairs, however the search is written."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 1 << 30, 40))) for i in range(3000)]
    pairs = []
    near = simhash._near
    monkeypatch.setattr(simhash, "_near", lambda p, nodes: pairs.append(p.count()) or near(p, nodes))
    entries = []
    balls = simhash._balls

    def counted(shelf, nodes, *rest):
        keys = simhash._entries(nodes)
        entries.append(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").count())
        return balls(shelf, nodes, *rest)

    monkeypatch.setattr(simhash, "_balls", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.similar_groups(docs).collect()
    assert {r["doc_id"] for r in got} == {r["component_id"] for r in got} == set(range(3000))
    assert sum(pairs) <= 2 and entries and max(entries) <= 40


def test_equal_values_meet_as_balls_of_radius_zero(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 6, (80, 3))
    check = [int(c) for c in rng.integers(0, 1 << 12, 80)]
    rows = [(i, v.tolist(), check[i], i % 50) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(rows, "set long, values array<int>, check long, label long").repartition(3)
    near = lambda a, b: (check[a] ^ check[b]).bit_count() <= simhash.CHECK_BITS
    want = {(a, b) for b in range(80) for a in range(b) if (values[a] == values[b]).any() and near(a, b) and a % 50 != b % 50}
    got = [tuple(r) for r in simhash._balls(common.Shelf(spark), nodes, 0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = [tuple(r) for r in simhash._leaders(nodes, 0).collect()]
    assert 0 < len(first) <= 80 and all((values[a] == values[b]).any() for a, b in first)
