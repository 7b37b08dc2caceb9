"""Similar texts whose SimHashes have no key in common."""

import numpy as np
import pytest

from artifactlake.llm import common, simhash


def _set(text):
    return simhash.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]


def _similarity(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_similar_texts_without_a_common_key_are_found(spark):
    rng = np.random.default_rng(21)
    rows, near = [], []
    for g in range(400):
        words = [f"p{g}q{k}" for k in range(204)]
        # 22 shingles of either text go
        at = int(rng.integers(0, 186))
        other = [*words[:at], *[f"n{g}m{k}" for k in range(18)], *words[at + 18 :]]
        texts = [" ".join(words), " ".join(other)]
        rows += [(2 * g + i, t) for i, t in enumerate(texts)]
        if _similarity(*map(_set, texts)) >= simhash.SIMILAR:
            near.append(g)
    keys = [simhash.strong_keys(np.array([simhash.set_sums(_set(t))])) for _, t in rows]
    lone = [g for g in near if not (keys[2 * g] == keys[2 * g + 1]).any()]
    assert len(near) > 300 and len(lone) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert all(got[2 * g + 1] == 2 * g for g in near)
    assert sum(got[i] == i for i in got) == len(rows) - len(near)


@pytest.mark.parametrize("least", [0.8, 0.5, 0.9])
def test_similar_sets_share_a_part_that_is_not_spare(least):
    rng = np.random.default_rng(22)
    for _ in range(600):
        n = int(rng.integers(1, rng.choice([6, 20, 100, 600])))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        cut = base[: max(1, n - int(rng.integers(0, int(n * (1 - least)) + 2)))]
        more = rng.integers(0, 1 << 63, int(rng.integers(0, int(n * (1 - least) / least) + 2)), dtype=np.uint64)
        pair = [np.unique(base), np.unique(np.concatenate([cut, more]))]
        if _similarity(*pair) < least:
            continue
        keys, rows, marks = simhash.part_keys(pair, least)
        spare = {(r, tag): g for r, tag, g in marks.tolist()}
        found = False
        for tag in {tag for r, tag in spare if (1 - r, tag) in spare}:
            held = [{k for k in keys[rows == r].tolist() if k & 7 == tag} for r in (0, 1)]
            # in the worst order the parts of one alone stand before the common ones
            found |= bool(held[0] & held[1]) and all(len(held[r] - held[1 - r]) < len(held[r]) - spare[r, tag] for r in (0, 1))
        assert found


def test_rare_parts_hold_every_similar_pair(spark):
    rng = np.random.default_rng(23)
    texts = ["", "one", "one two", "one two three four five", "one two three four five six"]
    for g in range(12):
        stem = [f"g{g}w{k}" for k in rng.integers(0, 200, int(rng.integers(4, 120)))]
        for _ in range(12):
            text = [w for w in stem if rng.random() > 0.01]
            for at in rng.integers(0, len(text), int(rng.integers(0, 4))):
                text[at] = f"x{rng.integers(0, 40)}"
            texts.append(" ".join([*text, *stem[: int(rng.integers(0, 9))]]))
    passage = " ".join(f"p{k}" for k in range(40))
    texts = sorted(set(texts)) + [f"{passage} " + " ".join(f"r{i}s{k}" for k in range(80)) for i in range(40)]
    sets = [_set(t) for t in texts]
    pack = simhash.zstandard.ZstdCompressor().compress
    rows = [(i, pack(t.encode())) for i, t in enumerate(texts)]
    label = [int(x) for x in rng.integers(0, len(texts) // 2, len(texts))]
    labelled = spark.createDataFrame(list(enumerate(label)), "set long, label long")
    shelf = common.Shelf(spark)
    # copies count once
    z = spark.createDataFrame(rows + rows[::3], "set long, z binary").repartition(3)
    got = {r["set"]: r["label"] for r in simhash._rare_parts(shelf, labelled, z, 5, 0.8).collect()}
    want = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if label[i] != label[j] and len(a) and len(b) and _similarity(a, b) >= 0.8}
    assert len(want) > 25 and want <= set(got) and all(label[i] == x for i, x in got.items())
    # texts that share a passage only do not go on
    assert not set(got) & set(range(len(texts) - 40, len(texts)))
    shelf.clear()
    assert simhash._rare_parts(shelf, labelled, z.limit(0), 5, 0.8).count() == 0
    shelf.clear()
