"""The ways taken for huge groups give the same rows as the plain ways and as brute force."""

import random

import pytest
from pyspark.sql import functions as F

from artifactlake.functions.classify import exact_round
from artifactlake.functions.language import detect_language
from artifactlake.operators import dedupe, grouped, joins, nested
from artifactlake.operators.paths import resolve_collisions
from artifactlake.streaming.throttle import greedy_throttle


def as_set(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    data = [(None if i % 11 == 0 else ("hot" if i % 3 else f"k{i % 5}"), rng.randrange(40), i, rng.choice([None, i])) for i in range(400)]
    return spark.createDataFrame(data, "k string, t int, id int, v int")


def test_number_rows_split(skewed):
    plain = grouped.number_rows(skewed, ["k"], ["t", "id"], "n")
    split = grouped.number_rows(skewed, ["k"], ["t", "id"], "n", limit=3)
    assert as_set(plain) == as_set(split)


@pytest.mark.parametrize("ahead", [False, True])
def test_with_neighbour_split(skewed, ahead):
    args = (skewed, ["k"], ["t", "id"], {"id": F.col("id")}, "near", ahead)
    flat = lambda df: as_set(df.withColumn("near", F.col("near.id")))
    assert flat(grouped.with_neighbour(*args)) == flat(grouped.with_neighbour(*args, limit=3))


def test_last_before_split(skewed):
    args = (skewed, ["k"], ["t", "id"], "v", "last")
    assert as_set(grouped.last_before(*args)) == as_set(grouped.last_before(*args, limit=3))


def test_join_groups_broadcasts_hot_groups_only(skewed):
    rows = skewed.where("k IS NOT NULL")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert as_set(rows.join(sizes, "k")) == as_set(grouped.join_groups(rows, sizes, ["k"], "n", hot_rows=50))


def test_group_ids_of_small_groups_do_not_depend_on_the_chunk(spark):
    data = [("a", f"f{i:03d}") for i in range(7)] + [("b", f"g{i:03d}") for i in range(40)]
    df = spark.createDataFrame(data, "g string, finding_id string")
    plain = dict(as_set(dedupe.group_ids(df, "g", "kind", "alg").select("g", "group_id")))
    both = dedupe.group_ids(df, "g", "kind", "alg", chunk=10).select("g", "group_id").collect()
    chunked = {r.g: r.group_id for r in both}
    plain = {g: i for g, i in ((r.g, r.group_id) for r in dedupe.group_ids(df, "g", "kind", "alg").collect())}
    assert chunked["a"] == plain["a"] and set(chunked) == {"a", "b"} and chunked["b"].startswith("dup-")


def hashes(count, words, rng):
    base = [[rng.getrandbits(64) for _ in range(words)] for _ in range(count // 6)]
    out = []
    for i in range(count):
        h = list(rng.choice(base))
        for _ in range(rng.randrange(8)):
            h[rng.randrange(words)] ^= 1 << rng.randrange(64)
        out.append(tuple(h))
    return sorted(set(out))


@pytest.mark.parametrize("words,per_word,threshold", [(1, 2, 5), (1, 3, 8), (1, 4, 8), (2, 3, 10), (1, None, 8)])
def test_near_pairs_have_full_recall(spark, words, per_word, threshold):
    pool = hashes(150, words, random.Random(words * 10 + threshold))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([([signed(w) for w in h],) for h in pool], "h array<long>")
    got = {
        frozenset((tuple(r.left_hash), tuple(r.right_hash))): r.distance
        for r in dedupe.near_pairs(df, "h", threshold, words, per_word).collect()
    }
    want = {}
    for i, a in enumerate(pool):
        for b in pool[i + 1 :]:
            d = sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
            if d <= threshold:
                want[frozenset((tuple(map(signed, a)), tuple(map(signed, b))))] = d
    assert want and got == want


def clusters(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            for n in (a, b):
                if label[n] != low:
                    label[n], changed = low, True
    return label


@pytest.mark.parametrize("one_task", [0, 1000])
def test_connected_components(spark, one_task):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(90):02d}", f"n{rng.randrange(90):02d}") for _ in range(60)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(70)]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.label for r in dedupe.connected_components(df, one_task=one_task).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    want = clusters(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want


def greedy(left, right, threshold):
    used, n = set(), 0
    for a in left:
        for i, b in enumerate(right):
            if i not in used and (a ^ b).bit_count() <= threshold:
                used.add(i)
                n += 1
                break
    return n


@pytest.mark.parametrize("min_match", [1, 2])
def test_video_edges_give_the_clusters_of_all_pairs(spark, min_match):
    rng = random.Random(min_match)
    frames = [rng.getrandbits(60) for _ in range(40)]

    def frame():
        f = rng.choice(frames)
        for _ in range(rng.choice([0, 0, 3, 7])):
            f ^= 1 << rng.randrange(60)
        return f

    videos = [(f"v{i:03d}", [frame() for _ in range(rng.randrange(1, 5))]) for i in range(60)]
    videos.append(("v900", list(videos[0][1])))
    df = spark.createDataFrame(videos, "finding_id string, seq array<long>")
    edges, seqs = dedupe.video_edges(df, 10, min_match)
    got_edges = [(r.a, r.b) for r in edges.collect()]
    reps = {tuple(r.seq): r.vid for r in seqs.collect()}
    nodes = sorted(reps.values())
    sequence = {v: s for s, v in reps.items()}
    want_edges = [
        (a, b)
        for i, a in enumerate(nodes)
        for b in nodes[i + 1 :]
        if greedy(sequence[a], sequence[b], 10) >= min_match
    ]
    assert clusters(nodes, got_edges) == clusters(nodes, want_edges)


@pytest.mark.parametrize("min_match", [1, 2])
def test_video_edges_with_hot_frames_and_shared_bands(spark, min_match):
    """Frames of one band that are far apart, frames that many videos own, repeats inside a video."""
    rng = random.Random(20 + min_match)
    hot = [rng.getrandbits(64) - 2**63 for _ in range(3)]
    band = rng.getrandbits(48) << 16

    def signed(x):
        x &= 2**64 - 1
        return x - 2**64 if x >= 2**63 else x

    def frame():
        kind = rng.random()
        f = rng.choice(hot) if kind < 0.4 else band ^ rng.getrandbits(40) if kind < 0.7 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 4, 9])):
            f ^= 1 << rng.randrange(64)
        return signed(f)

    videos = []
    for i in range(80):
        frames = [frame() for _ in range(rng.randrange(1, 6))]
        videos.append((f"v{i:03d}", frames + frames[:1] if i % 7 == 0 else frames))
    for i in range(20):  # each near a video that no star reaches
        f = [signed(x ^ (1 << rng.randrange(64))) for x in videos[i][1]]
        videos.append((f"w{i:03d}", f[::-1]))
    df = spark.createDataFrame(videos, "finding_id string, seq array<long>")
    edges, _ = dedupe.video_edges(df, 10, min_match)
    nodes = [v for v, _ in videos]
    masked = {v: [x & (2**64 - 1) for x in s] for v, s in videos}
    want = [
        (a, b)
        for i, a in enumerate(nodes)
        for b in nodes[i + 1 :]
        if greedy(masked[a], masked[b], 10) >= min_match
    ]
    assert clusters(nodes, [(r.a, r.b) for r in edges.collect()]) == clusters(nodes, want)


def test_near_clusters_of_a_dense_ball_and_chains(spark):
    rng = random.Random(5)
    middle = rng.getrandbits(60)
    ball = {middle ^ sum(1 << b for b in rng.sample(range(60), 4)) for _ in range(400)}
    chain, h = [], rng.getrandbits(60)
    for _ in range(30):
        h ^= sum(1 << b for b in rng.sample(range(60), 8))
        chain.append(h)
    hashes = sorted(ball | set(chain) | {rng.getrandbits(60) for _ in range(100)})
    df = spark.createDataFrame([(f"n{i:04d}", [x]) for i, x in enumerate(hashes)], "node string, h array<long>")
    got = {r.node: r.label for r in dedupe.near_clusters(df, 8).collect()}
    pairs = [
        (f"n{i:04d}", f"n{j:04d}")
        for i, a in enumerate(hashes)
        for j, b in enumerate(hashes[:i])
        if (a ^ b).bit_count() <= 8
    ]
    assert got == clusters([f"n{i:04d}" for i in range(len(hashes))], pairs)


def test_meet_apart_gives_all_pairs_of_different_labels(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), rng.choice("aaaab")) for i in range(60)]
    posts = spark.createDataFrame(rows, "id int, k int, label string")
    probes = posts.select(F.col("id").alias("p"), "k", F.col("label").alias("pl"))
    got = sorted((r.p, r.id) for r in dedupe.meet_apart(probes, posts, ["k"]).collect())
    assert got == sorted((p, i) for p, k, a in rows for i, m, b in rows if k == m and a != b)


def test_matching_frames_of_long_videos(spark):
    """A video of 3,000 frames against its reverse: every frame is taken once."""
    rng = random.Random(8)
    left = [rng.getrandbits(60) for _ in range(3000)]
    df = spark.createDataFrame([(left, left[::-1]), ([1, 1, 2], [1, 1]), ([], [1]), ([1], [])], "l array<long>, r array<long>")
    got = [r[0] for r in df.select(dedupe.matching_frames(F.col("l"), F.col("r"), 1)).collect()]
    assert got == [3000, 2, 0, 0]


@pytest.mark.parametrize("fold", [False, True])
def test_resolve_collisions_follow_input_order(spark, fold):
    rng = random.Random(3)
    stems = ["a", "A", "b__1", "c"]
    tails = ["", "", "__1", "__2", "__1__1", "__01", "__3"]
    names = [rng.choice(stems) + rng.choice(tails) for _ in range(160)]
    used, want = set(), []
    key = str.upper if fold else str
    for name in names:
        candidate, k = name, 0
        while key(candidate) in used:
            k += 1
            candidate = f"{name}__{k}"
        used.add(key(candidate))
        want.append(candidate)
    df = spark.createDataFrame(list(enumerate(names)), "ord int, path string")
    for limit in (1000, 5):
        got = resolve_collisions(df, "path", "ord", case_insensitive=fold, limit=limit)
        assert [r.final for r in got.orderBy("ord").collect()] == want


def test_pack_batches_long_queue(spark):
    rng = random.Random(2)
    data = [("q" if i % 4 else "r", i, rng.randrange(1, 60)) for i in range(300)]
    df = spark.createDataFrame(data, "q string, ord int, n int")
    one = nested.pack_batches(df, ["q"], ["ord"], F.col("n"), 5, 100)[0]
    two = nested.pack_batches(df, ["q"], ["ord"], F.col("n"), 5, 100, limit=10)[0]
    assert as_set(one) == as_set(two)
    rows = nested.pack_batches(df, ["q"], ["ord"], F.col("n"), 5, 50)
    assert rows[0].count() + rows[1].count() == 300 and rows[1].where("n <= 50").count() == 0


def test_throttle_long_keys(spark):
    rng = random.Random(4)
    data = [("k" if i % 5 else None, rng.randrange(500), i, 30) for i in range(250)]
    df = spark.createDataFrame([(k or "x", t, i, g) for k, t, i, g in data], "k string, t long, id int, gap int")
    plain = greedy_throttle(df, ["k"], ["t", "id"], "t", "gap")
    split = greedy_throttle(df, ["k"], ["t", "id"], "t", "gap", limit=5)
    assert as_set(plain) == as_set(split)


def test_link_by_basename_salts_hot_names(spark):
    a = spark.createDataFrame([(i, f"C:\\x\\{'Hot' if i % 2 else i}.TXT") for i in range(20)], "entry_id int, target_path string")
    t = spark.createDataFrame([(i, f"/t/{'hot' if i % 3 else i}.txt") for i in range(30)], "entry_id int, original_path string")
    plain = joins.link_by_basename(a, t)
    salted = joins.link_by_basename(a, t, salts=4, hot_rows=5)
    assert as_set(plain) == as_set(salted) and plain.count() > 100


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (7, 6), (50, 10)])
def test_chunks(spark, size, overlap):
    texts = ["", "x" * size, "é" * (size + 1), "abcdefghij" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in nested.chunk_text(df, "t", size, overlap).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.chunk_text)
    for i, text in enumerate(texts):
        want, start = [], 0
        while start < len(text):
            end = min(start + size, len(text))
            want.append(text[start:end])
            if end >= len(text):
                break
            start = max(start + 1, end - overlap)
        assert got.get(i, []) == want


def test_exact_round_is_python_round(spark):
    values = [0.0] + [i / 1000 for i in range(10, 2000, 5)] + [0.5 + c * 0.25 for c in (0.98, 0.95, 0.92, 0.9, 0.86, 0.8, 0.4, 0.2)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", exact_round(F.col("x")).alias("r")).collect():
        assert row.r == round(row.x, 2), row.x


def test_language_of_plain_sentences(spark):
    texts = [
        ("en", "The document and this image are from the world with confidence"),
        ("es", "El documento que esta en la imagen es para el mundo, hola con una confianza"),
        ("fr", "Bonjour le monde, la récupération des images avec une langue pour les que"),
        ("de", "Der Hund und die Katze sind mit das Bild für die Welt und ist das Dokument"),
        ("unknown", "1234 5678 9012"),
        ("unknown", "short"),
        ("unknown", "zxq wvb prt klm nbv qwr tyu plk mnb zxc"),
    ]
    df = spark.createDataFrame(texts, "want string, text string")
    got = detect_language(df, "text").select("want", "language.primary_language").collect()
    assert [r.primary_language for r in got] == [w for w, _ in texts]


def test_range_join_bins_equal_broadcast(spark):
    points = spark.range(0, 3000, 7).withColumnRenamed("id", "at")
    ranges = spark.range(60).selectExpr("id", "id * 37 AS s", "id * 37 + (id % 9) * 40 AS e")
    small = joins.overlaps(points, ranges, "at", "s", "e", 64)
    large = joins.overlaps(points, ranges, "at", "s", "e", 64, broadcast_rows=5)
    assert as_set(small) == as_set(large) and small.count() > 0


def test_limits_are_off_by_default(spark):
    from artifactlake.operators import records, windows

    members = spark.createDataFrame([(1, 10_001)], "id int, n int").selectExpr(
        "id", "transform(sequence(1, n), i -> named_struct('path', 'f' || i, 'kind', 'file', 'size_bytes', 1L, 'compressed_size_bytes', 1L, 'encrypted', false, 'warnings', CAST(array() AS array<string>))) AS members"
    )
    kept, rejected = records.archive_members(members, "id")
    assert kept.count() == 10_001 and rejected.count() == 0
    rows = spark.range(300).selectExpr("id % 2 AS ord", "id")
    assert windows.schedule_cap(rows, F.lit(True)).where("schedule_scan").count() == 300
    assert windows.schedule_cap(rows, F.lit(True), n=7).where("schedule_scan").count() == 7


def test_first_message_wins(spark):
    from artifactlake.streaming.events import dedupe_replays

    rows = spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (2, None, "none"), (None, 1, "null key")], "k int, ts int, v string")
    got = {r["k"]: r["v"] for r in dedupe_replays(rows, ["k"], "ts").collect()}
    assert got == {1: "first", 2: "none", None: "null key"}


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from artifactlake.session import scratch_dir

    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: conf)
    with pytest.raises(RuntimeError):
        scratch_dir(SimpleNamespace(sparkContext=sc))
