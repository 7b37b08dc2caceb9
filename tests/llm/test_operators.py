"""Training-data operators against brute force, on rows with nulls, repeats, ties and clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from artifactlake.llm import bpe, common, langid, mixing, ordermin, phrases, quality, rules, simhash, suffixes, urls
from artifactlake.llm.common import text_bytes
from artifactlake.llm.windows import sliding_min

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, own string, z int, size int, rule string, copies int, kept string, simhash string"
LONG = " ".join(f"w{i * i % 977}" for i in range(3000))
SHARED = " ".join(f"shared{i}" for i in range(60))


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", 1, 2, "r", 3, "k", "s")


ROWS = [
    _row(1, LONG), _row(2, LONG + " tail"), _row(3, f"one two {SHARED} three"), _row(4, f"été {SHARED} ñandú\u3000wide", "es", "b"),
    _row(4, f"été {SHARED} ñandú\u3000wide", "es", "b"), _row(5, None), _row(6, "", None, None), _row(7, " \t\n", "en", None),
    _row(None, "no id here", None, "c"), _row(8, "be " * 200, "en", "c"), _row(9, "1234 5678 !!", "en", "b"),
    _row(10, "<|endoftext|> Don't STOP 日本語 \u0130", "en", "b"), _row(11, "no id here", "en", "b"), (12, *[None] * 12),
    *[_row(100 + i, f"el perro número {i} come en la casa grande de la señora", "es", "a") for i in range(6)],
    *[_row(200 + i, f"the dog number {i} eats in the big house of the lady", "en", "c") for i in range(6)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return text or ""


def test_phrases(docs, none):
    words = [(r[0], WORD.findall(plain(r[1]))) for r in ROWS]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = [tuple(r) for r in phrases.remove_phrases(docs, shard_bytes=8000).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert phrases.remove_phrases(none).collect() == []


def test_phrases_spread_copies(spark):
    copy = " ".join(f"c{i}" for i in range(40))
    rows = [(i, copy if i < 60 else None if i < 120 else "") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = phrases.remove_phrases(docs, shard_bytes=500).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:4] for r in got) == [(i, 40, 40, "") if i < 60 else (i, 0, 0, "") for i in range(180)]
    for kind in (range(60), range(60, 180)):
        assert len({r["part"] for r in got if r["doc_id"] in kind}) > 2


def test_suffixes(docs, none):
    texts = [(r[0], plain(r[1]).encode()) for r in ROWS]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    got = [(*tuple(r)[:4], bytes(r[4])) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffixes.remove_repeats(none).collect() == []
    cleaned = suffixes.cleaned_documents(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert len(got) == len(ROWS)
    key = lambda r: (str(r["id"]), r["digest"], r["nth"], str(r["source"]))
    assert sorted((key(r), r["copies"]) for r in got) == sorted((key(r), r["copies"]) for r in again)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(plain(r[1])))
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3 and (r["size"] > 0 or r["copies"] == 0)
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def test_pivotal_keeps_the_sum():
    rng = np.random.default_rng(3)
    prob = rng.random(500)
    out, held = mixing.pivotal(prob, rng.random(500))
    assert abs(out.sum() - prob.sum()) < 1e-6
    assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != held)
    mean = np.mean([mixing.pivotal(np.array([0.3, 0.5, 0.9]), rng.random(3))[0] for _ in range(4000)], axis=0)
    assert np.allclose(mean, [0.3, 0.5, 0.9], atol=0.05)


def test_bpe_round_trip(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = bpe.tokenizer(path)
    want = []
    for r in ROWS:
        ids = t.encode(plain(r[1]), add_special_tokens=False).ids
        want.append((r[0], r[5], len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], r["score"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"]).decode()) for r in bpe.encode(docs, path, ["doc_id", "score"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode(none, path, ["doc_id"]).collect() == []


def test_order_minhash(docs, none, spark):
    got = ordermin.fingerprints_with_edit(docs, buckets=4).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [plain(r[1]) for r in order]
    want = {}
    for i, r in enumerate(order):
        text, after = texts[i], texts[(i + 1) % len(order)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (ordermin.sketch(x.encode()) for x in (text, edited, after))
        want.setdefault(r[0], []).append((len(text), hashlib.sha256(edited.encode()).hexdigest(), ordermin.shown(a), ordermin.shown(b), ordermin.likeness(a, b), ordermin.likeness(a, c)))
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r)[1:] in want[r["doc_id"]]
    assert ordermin.fingerprints_with_edit(none).collect() == []
    alone = ordermin.fingerprints_with_edit(docs.where("doc_id = 1")).first()
    assert alone["near_next"] == 1.0
    one, two = b"abcdefgh ijklmnop qrstuvwx " * 3 + b"END", b"qrstuvwx ijklmnop abcdefgh " * 3 + b"END"
    assert ordermin.likeness(ordermin.sketch(one), ordermin.sketch(two)) < 0.5


def test_order_minhash_blocks_agree():
    text = bytes(np.random.default_rng(1).integers(97, 123, 40_000, dtype=np.uint8))
    code = ordermin.numbered_grams(text)
    ranks = code[None] * ordermin._ODD[:4, None]
    least = np.sort(np.argsort(ranks, axis=1)[:, :2], axis=1)
    out = np.arange(1, 5, dtype=np.uint64)
    from artifactlake.llm.common import mix

    for i in range(2):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + code[least][:, i])
    assert (ordermin.sketch(text, sketches=4) == (out >> np.uint64(32)).astype(np.uint32)).all()


def test_language(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = langid.train(docs.where("doc_id % 2 = 0 OR doc_id < 100"), path)
    assert model.langs == ["en", "es"] and np.allclose(model.prob.sum(axis=0), 1)
    got = {r["doc_id"]: r for r in langid.identify(docs, model, keep=["doc_id", "text"]).collect()}
    for i in (5, 6, 7, 9, 12):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0
    assert all(got[100 + i]["lang_pred"] == "es" and got[200 + i]["lang_pred"] == "en" for i in range(6))
    assert langid.identify(docs, model).columns[-2:] == ["lang_pred", "score"]
    assert langid.with_language(docs, model).columns == docs.columns
    empty = langid.train(none, path)
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(none, model).collect() == []


def _piece_model():
    keys, lengths = langid.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    prob = np.random.default_rng(2).random((len(keys), 2))
    return langid.PieceModel(["a", "b"], keys, lengths, prob / prob.sum(axis=0))


def _place(data, model):
    h = common.Spans(common.BYTE_CODES[np.frombuffer(data, np.uint8)]).of(np.array([0]), np.array([len(data)]))[0]
    at = np.searchsorted(model.keys, h)
    return at if at < len(model.keys) and model.keys[at] == h else None


WORDS = [b"the", b"a", "señora".encode(), b"abcdefghijklmnopqrstuvwxyzabcdefghijkl", b"responsibilities", b"telecommunications", b"-" * 150, b"ab", b"the"]


@pytest.mark.parametrize("places", [1 << 20, 40])
def test_forward_sums_all_segmentations(monkeypatch, places):
    monkeypatch.setattr(langid, "PLACES", places)
    model = _piece_model()
    assert model.sizes[-1] > 16

    def brute(data, lang):
        ways = [1.0] + [0.0] * len(data)
        for j in range(1, len(data) + 1):
            for i in range(j):
                at = _place(data[i:j], model)
                if at is not None:
                    ways[j] += ways[i] * model.prob[at, lang]
        return np.log(ways[-1])

    got = langid.word_scores(WORDS[:5] + WORDS[6:8], model)
    assert np.allclose(got, [[brute(b" " + w, k) for k in (0, 1)] for w in WORDS[:5] + WORDS[6:8]])
    assert langid.word_scores([], model).shape == (0, 2)


@pytest.mark.parametrize("places", [1 << 20, 40])
def test_expected_counts_weigh_all_segmentations(monkeypatch, places):
    monkeypatch.setattr(langid, "PLACES", places)
    model = _piece_model()

    def cuts(data):
        if not data:
            yield []
        for i in range(1, len(data) + 1):
            at = _place(data[:i], model)
            if at is not None:
                yield from ([at, *rest] for rest in cuts(data[i:]))

    words, lang, times = [b"the", b"a", b"house", b"the"], [0, 1, 1, 1], [2.0, 1.0, 3.0, 5.0]
    want = np.zeros(model.prob.shape)
    for w, k, n in zip(words, lang, times, strict=True):
        ways = list(cuts(b" " + w))
        p = np.array([model.prob[c, k].prod() for c in ways])
        for c, share in zip(ways, p / p.sum(), strict=True):
            np.add.at(want, (c, k), n * share)
    assert np.allclose(langid.expected_counts(words, np.array(lang), np.array(times), model), want)


def test_long_words_train():
    model = _piece_model()
    long = "日本語の長い文章".encode() * 700
    got = langid.expected_counts([long, b"x"], np.array([0, 1]), np.array([1.0, 1.0]), model)
    assert np.isfinite(got).all()
    assert got[:, 0].sum() > len(long) / model.sizes[-1] and got[:, 1].sum() >= 1


@pytest.mark.parametrize("shards", [8, 480])
def test_suffix_shards_are_even(shards):
    # anchors are minima of many hashes
    low = np.random.default_rng(3).integers(0, 1 << 63, (200_000, 20), np.int64).min(axis=1).astype(np.uint64)
    sizes = np.bincount(suffixes._shard(low, shards), minlength=shards)
    assert sizes.max() < 2 * sizes.mean() and sizes.min() > 0


def _groups(rows):
    def code(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        if not words:
            return 0
        made = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in made) > len(made))

    codes = [code(plain(r[1])) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in label}
    return [(r[0], codes[i], low[label[i]]) for i, r in enumerate(rows)]


def test_simhash(docs, none):
    got = [(r["doc_id"], r["simhash"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(_groups(ROWS), key=repr)
    assert simhash.near_groups(none).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for _, _, g in _groups(ROWS)})
    assert simhash.keep_one(none).collect() == []


def test_pipeline_removes_planted_near_copies(spark):
    rng = np.random.default_rng(8)
    rows, kept = [], set()
    for g in range(30):
        words = [f"t{g}x{k}" for k in rng.integers(0, 5000, 120)]
        rows.append((10 * g, " ".join(words)))
        kept.add(10 * g)
        # one or two words changed: similarity 0.92 and about 0.84
        for k, places in enumerate(([60], [20, 90]), 1):
            rows.append((10 * g + k, " ".join("changed" if i in places else w for i, w in enumerate(words))))
        # seven words changed: similarity about 0.54, another document
        rows.append((10 * g + 5, " ".join("other" if i % 16 == 8 else w for i, w in enumerate(words))))
        kept.add(10 * g + 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(kept)
    assert len(set(got) ^ {r["doc_id"] for r in simhash.keep_one(docs).collect()}) > 0


def test_balls_find_every_near_segment(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (25, simhash.CODE_WORDS), dtype=np.uint64)
    codes = [row.copy() for row in base]
    for row in base:
        for flips in (16, 80, 160, 200):
            new = row.copy()
            for k in rng.choice(64 * simhash.CODE_WORDS, flips, replace=False):
                new[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
            codes.append(new)
    codes = np.array(codes)
    values = simhash.segment_values(codes)
    assert values.max() < 1 << simhash.SEGMENT_BITS and len({tuple(v) for v in values.tolist()}) == len(codes)
    rows = [(i, v.tolist(), c.view(np.int64).tolist(), int(c.view(np.int64)[-1]), i % 60) for i, (v, c) in enumerate(zip(values, codes, strict=True))]
    nodes = spark.createDataFrame(rows, "set long, values array<int>, code array<long>, check long, label long").repartition(3)
    apart = np.bitwise_count(values[:, None].astype(np.uint64) ^ values[None].astype(np.uint64)).min(2)
    check = np.bitwise_count(codes[:, None, -1] ^ codes[None, :, -1])
    near = lambda a, b: check[a, b] <= simhash.CHECK_BITS
    want = {(a, b) for b in range(len(codes)) for a in range(b) if apart[a, b] <= 1 and near(a, b) and a % 60 != b % 60}
    got = [tuple(r) for r in simhash._balls(common.Shelf(spark), nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    places = [[(seg, v) for seg, v in enumerate(row)] for row in values.tolist()]
    size = {}
    for place in sum(places, []):
        size[place] = size.get(place, 0) + 1
    degree = [sum(size[x] for x in row if size[x] > 1) for row in places]
    head = {x: max((i for i, row in enumerate(places) if x in row), key=lambda i: (degree[i], -i)) for x in size if size[x] > 1}
    first = set()
    for i, row in enumerate(places):
        seen = {h for (seg, v), h in head.items() if h != i and (v ^ row[seg][1]).bit_count() <= 1 and near(h, i)}
        if seen:
            best = max(seen, key=lambda h: (degree[h], -h))
            first.add((min(i, best), max(i, best)))
    assert first and {tuple(r) for r in simhash._leaders(nodes).collect()} == first
    whole = np.bitwise_count(codes[:, None] ^ codes[None]).sum(2)
    pairs = spark.createDataFrame([(a, b) for b in range(len(codes)) for a in range(b)], "a long, b long")
    kept = {tuple(r) for r in simhash._near(pairs, nodes).collect()}
    assert kept == {(a, b) for b in range(len(codes)) for a in range(b) if whole[a, b] <= simhash.CODE_BITS}


def test_similar_groups_recall(spark):
    """Planted pairs of similarity 0.80 to 0.85, on both sides of them closer and farther ones."""
    rng = np.random.default_rng(12)
    rows, near, far = [], [], []
    for g in range(400):
        words = [f"p{g}q{k}" for k in range(204)]  # 200 shingles
        changes = int(rng.integers(2, 9))
        places = rng.choice(40, changes, replace=False) * 5 + 2
        other = [f"new{g}" if i in places else w for i, w in enumerate(words)]
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other)]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        (near if alike >= 0.8 else far).append((2 * g, alike))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    border = [i for i, alike in near if alike < 0.85]
    assert len(border) > 50 and len(far) > 50
    assert sum(got[i + 1] == i for i in border) >= 0.9 * len(border)
    assert sum(got[i + 1] == i for i, _ in near) >= 0.95 * len(near)
    assert all(got[i + 1] == i + 1 for i, _ in far)


def test_similar_groups_names(spark, none):
    kept = ["size", "set", "code", "z", "rid", "own"]
    rows = [(i, t, 7, "s", "c", "z", 5, "o") for i, t in enumerate(["a b c d e f", "A  B c d e f", None, "", " \n", "a b", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, set string, code string, z string, rid int, own string").repartition(2)
    got = simhash.similar_groups(docs, keep=kept)
    assert got.columns == ["doc_id", "size", "own", "set", "component_id"]
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5, 6: 2}
    assert simhash.similar_groups(none).collect() == []
    left = simhash.keep_one_similar(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 2, 5]


def test_no_language_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.keep_known_languages(spark, docs, "").count() == 2


def test_powers():
    for n in (0, 1, 10, common.KEPT, common.KEPT + 1, 3 * common.KEPT + 17):
        full = np.full(n, common.BASE, np.uint64)
        full[:1] = 1
        assert np.array_equal(common.powers(common.BASE, n), np.multiply.accumulate(full))


def test_near_fingerprints_find_every_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = {int(b) for b in base} | {int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4, 5)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(c),) for c in codes], "simhash long")
    for bits in (0, 1, 3, 5):
        got = {frozenset(r) for r in simhash.near_fingerprints(table, bits).collect()}
        want = {frozenset((signed(a), signed(b))) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= bits}
        assert got == want


def test_quality(spark, none):
    rows = [(i, "good plain words here " + " ".join(f"x{i * j % 53}" for j in range(60)), None) if i % 2 else (i, "BAD!! " * 40, 5) for i in range(80)]
    rows += [(500, None, None), (None, "", 3)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_chars long, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(61, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    machine = quality.train(docs, labels)
    got = quality.score(docs, machine, keep=["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    untrained = quality.train(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, untrained).collect()} == {0.5}
    assert quality.score(none, machine).collect() == []


def test_square_identity():
    rng = np.random.default_rng(5)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)))
    number, value = rng.integers(0, quality.SIZE, 7), rng.random(7)
    pairs = sum(m.factor[number[i]] @ m.factor[number[j]] * value[i] * value[j] for i in range(7) for j in range(i))
    want = m.bias + m.weight[number] @ value + pairs
    assert np.isclose(quality.margins(m, np.array([0, 7]), number, value)[0], want)


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1?x", "http://a.b.example.org/en/12#t", "http://badexample.org/en/1",
    "ftp://x.com/de/", "http://x.com/fr/a/../", "http://x.com?q=/fr/", "http://org", "http://org/", "http://.org/", "a://b://c.com/de/",
    "http://x.com/DE/", "http://x.com/\n/de/", "http://é.com/fr/ü", "http://example.org/en/12#t",
]


def _judge(url, table):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    from artifactlake.llm.queries import URL_RULES

    rows = [(i, u, "h", "p") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id int, url string, host string, rule string")
    for table in (URL_RULES, [*URL_RULES, ("x.com", "/f", "block"), ("com", "", "block"), ("x.com", "/f", "allow")]):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, table).collect()}
        assert got == {i: _judge(u, table) for i, u, _, _ in rows}
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), URL_RULES).collect() == []


def test_rules(docs, none):
    lines = "a b c\n\na b c\n  \nx y z\na b c\n"
    extra = docs.sparkSession.createDataFrame([_row(900, lines), _row(901, "# $ " * 60), _row(902, lines)], SCHEMA)
    book = rules.ledger(rules.measure(docs.unionByName(extra), keep=["doc_id", "text"]))
    for r in book.collect():
        text = plain(r["text"])
        words = WORD.findall(text)
        filled = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(filled), len(filled) - len(set(filled)), len(again))
        assert tuple(r[m] for m in rules.MEASURES) == want
    passing = book.where(rules.passes("v1")).count()
    lost = rules.ablations(book, "v1").collect()
    total = book.count()
    for r in lost:
        i = [x.name for x in rules.RULES].index(r["rule"])
        bits = [x["failed_bits"] for x in book.collect()]
        assert r["n_failed"] == sum(b >> i & 1 for b in bits) and r["n_alone"] == sum(b == 1 << i for b in bits)
    assert passing == total - sum(1 for x in book.collect() if x["failed_bits"])
    assert rules.ledger(rules.measure(none)).collect() == []


def test_helpers():
    import pyarrow as pa

    raw, at = text_bytes(pa.array(["ab", None, "", "é"])[1:])
    assert raw.tobytes() == "é".encode() and at.tolist() == [0, 0, 0, 2]
    x = np.random.default_rng(6).integers(0, 1000, 57).astype(np.uint64)
    for w in (1, 5, 57, 58):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_pipeline(docs, none, spark, tmp_path):
    for name, source in (("rows", docs), ("none", none)):
        rows = source.withColumn("n_chars", F.col("n_chars"))
        for i, (stage, fn) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{i}")
            fn(spark, rows, "").write.parquet(path)
            after = spark.read.parquet(path)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert after.columns == docs.columns, stage
            rows = after
        assert (rows.count() > 0) == (name == "rows")
