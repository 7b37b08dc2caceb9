"""Crowds of texts that are like each other, but not enough, in the near-duplicate stage."""

from itertools import combinations

import numpy as np
import pytest
import zstandard

from artifactlake.llm import common, simhash


def _similarity(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_texts_with_a_common_passage_propose_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join(passage + [f"w{k}" for k in rng.integers(0, 1 << 30, 20)])) for i in range(300)]
    # near copies of a text with up to seven words of their own, from a small store of words
    base = [f"b{i}" for i in range(150)]
    for i in range(300, 600):
        text = list(base)
        for at in rng.integers(0, 150, i % 8):
            text[at] = f"own{rng.integers(0, 300)}"
        rows.append((i, " ".join(text)))
    met, balls = [], simhash._balls

    def counted(*args):
        found = balls(*args)
        met.append(found.count())
        return found

    monkeypatch.setattr(simhash, "_balls", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # all pairs of the first 300 would be 44,850; one key in common is enough for several thousand of them
    assert met and max(met) <= 600
    sets = [simhash.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for _, t in rows]
    label = list(range(600))
    for a, b in combinations(range(600), 2):
        if label[a] != label[b] and _similarity(sets[a], sets[b]) >= simhash.SIMILAR:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    assert len(set(label)) > 300
    # linked by brute force only: a pair that has no key in common, which is rare
    assert all(label[k] == label[v] for k, v in got.items())
    assert sum(label[i] == got[i] for i in range(600)) >= 590


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_rare_meetings_lose_no_pair(spark, least):
    rng = np.random.default_rng(12)
    texts = ["", "one", "one two", "one two three four five", "one two three four five six"]
    for g in range(12):
        stem = [f"g{g}w{k}" for k in rng.integers(0, 200, int(rng.integers(4, 120)))]
        for _ in range(12):
            text = [w for w in stem if rng.random() > 0.01]
            for at in rng.integers(0, len(text), int(rng.integers(0, 4))):
                text[at] = f"x{rng.integers(0, 40)}"
            texts.append(" ".join([*text, *stem[: int(rng.integers(0, 9))]]))
    texts = sorted(set(texts))
    pack = zstandard.ZstdCompressor().compress
    rows = spark.createDataFrame([(i, i, pack(t.encode())) for i, t in enumerate(texts)], "set long, rid long, z binary").repartition(3)
    labels = [int(x) for x in rng.integers(0, len(texts) // 2, len(texts))]
    apart = spark.createDataFrame(list(enumerate(labels)), "set long, label long").repartition(3)
    shelf = common.Shelf(spark)
    got = [tuple(r) for r in simhash._rare_meetings(shelf, apart, rows, 5, least).collect()]
    sets = [simhash.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if labels[a] != labels[b]]
    want = {(a, b) for a, b in pairs if len(sets[a]) and len(sets[b]) and _similarity(sets[a], sets[b]) >= least}
    assert len(want) > 40 and want <= set(got)
    assert len(got) == len(set(got)) and set(got) <= set(pairs) and len(got) < len(pairs) / 5
    shelf.clear()


def test_nodes_that_meet_by_chance_do_not_go_on(spark):
    rng = np.random.default_rng(13)
    check = rng.integers(-(1 << 62), 1 << 62, 120, dtype=np.int64)
    # buckets of three strangers, one of three with the same last word, and one of thirty strangers
    value = [i // 3 for i in range(90)] + [99] * 30
    check[3:6] = check[3]
    rows = [(i, [value[i]], int(check[i]), i) for i in range(120)]
    nodes = spark.createDataFrame(rows, "set long, values array<int>, check long, label long").repartition(3)
    shelf = common.Shelf(spark)
    apart = simhash._balls(shelf, nodes, 0, lambda them: them)
    near = {i for i in range(90) for j in range(i // 3 * 3, i // 3 * 3 + 3) if i != j and (int(check[i]) ^ int(check[j])).bit_count() <= simhash.CHECK_BITS}
    assert {r["set"] for r in apart.collect()} == near | set(range(90, 120)) and {3, 4, 5} <= near and len(near) < 30
    shelf.clear()
