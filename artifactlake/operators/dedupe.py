"""Exact and near duplicate groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .grouped import GROUP_LIMIT, join_groups, number_rows
from .windows import pick_canonical

ID_CHUNK = 50_000
HOT_NODE = 1_000_000
ONE_TASK_EDGES = 200_000
TILE = 16_384
#: pairs of hashes that a task compares at once
PAIRS_HELD = 1 << 20
#: pairs of hashes compared in a block in the time of one row of a join
PAIRS_A_MEETING = 50


def valid_digest(col: str) -> Column:
    return F.coalesce(F.lower(F.col(col)).rlike("^[0-9a-f]{64}$"), F.lit(False))


def exact_duplicates(df: DataFrame, hot_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """``(members, warnings)`` of groups of two or more rows with one SHA-256 and one size.

    ``df`` has finding_id, content_sha256, size_bytes. Digests whose rows differ in size form no
    group but a warning; so do malformed digests. Group facts are aggregated before the shuffle.
    """
    valid = df.where(valid_digest("content_sha256"))
    facts = valid.groupBy("content_sha256").agg(
        F.count(F.lit(1)).alias("members"),
        F.count("size_bytes").alias("__sized"),
        F.min("size_bytes").alias("__min"),
        F.max("size_bytes").alias("__max"),
    )
    several = facts.where("members >= 2")
    one_size = (F.col("__sized") == 0) | (
        (F.col("__sized") == F.col("members")) & (F.col("__min") == F.col("__max"))
    )
    groups = several.where(one_size).select("content_sha256", "members")
    members = join_groups(valid, groups, ["content_sha256"], "members", hot_rows)
    warnings = (
        df.where(F.col("content_sha256").isNotNull() & ~valid_digest("content_sha256"))
        .select(F.concat(F.lit("invalid_content_sha256:"), F.col("finding_id").cast("string")).alias("warning"))
        .unionByName(
            several.where(~one_size).select(
                F.concat(F.lit("sha256_size_mismatch:"), "content_sha256").alias("warning")
            )
        )
    )
    return members, warnings


def group_ids(
    members: DataFrame, group: str, kind: str, algorithm: str, chunk: int = ID_CHUNK
) -> DataFrame:
    """(group, group_id): ``dup-`` and a digest over kind, algorithm and the sorted member ids.

    The ids of a group beyond ``chunk`` members are hashed chunk by chunk in their order, then the
    chunk digests are hashed, so no task ever holds a whole huge group.
    """
    head = f"{kind}\0{algorithm}\0"
    ids = members.select(group, F.col("finding_id").cast("string").alias("finding_id"))
    sizes = ids.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))

    def digest(col: str) -> Column:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*col.split()))), lambda s: s[col.split()[-1]]), "\0")
        return F.sha2(F.concat(F.lit(head), joined), 256)

    def named(hexed: Column) -> Column:
        return F.concat(F.lit("dup-"), F.substring(hexed, 1, 24)).alias("group_id")

    if sizes.where(F.col("__n") > chunk).isEmpty():
        return ids.groupBy(group).agg(named(digest("finding_id")))
    small = join_groups(ids, sizes.where(F.col("__n") <= chunk), [group], "__n").drop("__n")
    large = join_groups(ids, sizes.where(F.col("__n") > chunk), [group], "__n", chunk).drop("__n")
    cut = number_rows(large, [group], ["finding_id"], "__at").withColumn(
        "__chunk", F.floor((F.col("__at") - 1) / chunk)
    )
    parts = cut.groupBy(group, "__chunk").agg(digest("finding_id").alias("part"))
    return (
        small.groupBy(group)
        .agg(named(digest("finding_id")))
        .unionByName(parts.groupBy(group).agg(named(digest("__chunk part"))))
    )


# --------------------------------------------------------------------------- near duplicates


def hash_words(hexed: str | Column, width: int = 16) -> Column:
    """Hex hash as an array of 64-bit words, left-padded to ``width`` digits; NULL if malformed."""
    text = F.lower(F.trim(F.col(hexed) if isinstance(hexed, str) else hexed))
    good = text.rlike("^([0-9a-f]{2})+$") & (F.length(text) <= width)
    full = F.lpad(text, width, "0")
    words = [
        F.conv(F.substring(full, 16 * i + 1, 16), 16, -10).cast("long") for i in range(width // 16)
    ]
    return F.when(good, F.array(*words))


def hamming(a: Column, b: Column, words: int) -> Column:
    bits = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(words)]
    total = bits[0]
    for b_ in bits[1:]:
        total = total + b_
    return total


def _bands(words: int, per_word: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of every band."""
    out = []
    for w in range(words):
        at = 0
        for b in range(per_word):
            size = (64 - at) // (per_word - b)
            out.append((w, at, size))
            at += size
    return out


def _masks(width: int, weight: int) -> list[int]:
    return [sum(1 << b for b in bits) for w in range(weight + 1) for bits in combinations(range(width), w)]


def near_pairs(
    hashes: DataFrame, hash_col: str, threshold: int, words: int = 1, per_word: int | None = None
) -> DataFrame:
    """(left_hash, right_hash, distance) of all distinct hashes at most ``threshold`` bits apart.

    Two hashes within t bits differ in at most floor(t/bands) bits of some band, so one side probes
    each band with every mask of that weight: full recall without comparing all pairs. The band
    count follows the number of distinct hashes, which keeps the equi-join buckets small. A pair is
    kept only in the first band that could find it, so no distinct is needed. Where bands would compare
    more than all pairs of 64-bit hashes, these are compared block by block.
    """
    distinct = settle(hashes.select(F.col(hash_col).alias("h")).where("h IS NOT NULL").distinct())
    plan = _Bands(words, per_word or _per_word(distinct), threshold)
    if words == 1 and _crowded(distinct.select("h", F.col("h")[0].alias("label")), plan):
        return tile_pairs(distinct, threshold)
    rows = distinct.select(F.col("h").alias("right_hash"), plan.rows("h"))
    probes = distinct.select(F.col("h").alias("left_hash"), plan.probes("h"))
    left, right = F.col("left_hash"), F.col("right_hash")
    distance = hamming(left, right, words)
    return (
        probes.join(rows, ["band", "value"])
        .where((left < right) & (distance <= threshold) & ~plan.met_earlier(left, right))
        .select("left_hash", "right_hash", distance.alias("distance"))
    )


def tile_pairs(distinct: DataFrame, threshold: int, tile: int = TILE) -> DataFrame:
    """:func:`near_pairs` of ``distinct`` (h, one word each), all pairs compared block by block as in :func:`near_counts`.

    A group gives its pairs a few rows of the block at a time, so no task holds them; they go into no shuffle.
    """
    blocks = max(1, math.ceil(distinct.count() / tile))
    dealt = distinct.select(F.col("h")[0].alias("h"))
    packed = dealt.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block")).agg(F.collect_list("h").alias("hs"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches(batches)
        sides = [np.array(x.values, dtype=np.int64) for x in met.column("hs")]
        left, right = sides[0], sides[-1]
        one = met.column("i")[0] == met.column("j")[0]
        if len(sides) == 1 and not one:
            # the other block is empty
            return
        step = max(1, PAIRS_HELD // len(right))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            apart = np.bitwise_count((part[:, None] ^ right[None, :]).view(np.uint64))
            x, y = np.nonzero(apart <= threshold)
            if one:
                x, y = x[y > at + x], y[y > at + x]
            a, b = part[x], right[y]
            found = [np.minimum(a, b), np.maximum(a, b), apart[x, y].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "distance"])

    found = _each_two(packed, blocks).groupBy("i", "j").applyInArrow(pairs, "a long, b long, distance int")
    return found.select(F.array("a").alias("left_hash"), F.array("b").alias("right_hash"), "distance")


def near_counts(hashes: DataFrame, hash_col: str, threshold: int, tile: int = TILE) -> DataFrame:
    """(hash, links): every distinct 64-bit hash and how many others are at most ``threshold`` bits away.

    All pairs are compared, none is listed: the hashes are dealt into blocks of about ``tile``, each two blocks meet
    in one group, and a group gives one count a hash. Time grows with the square of the number of different hashes,
    the data moved with that square over ``tile``.
    """
    distinct = settle(hashes.select(F.col(hash_col).alias("h")).where("h IS NOT NULL").distinct())
    blocks = max(1, math.ceil(distinct.count() / tile))
    packed = distinct.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block")).agg(F.collect_list("h").alias("hs"))
    met = _each_two(packed, blocks)

    def count(table: pa.Table) -> pa.Table:
        sides = [np.array(x.values, dtype=np.int64) for x in table.column("hs")]
        left, right = sides[0], sides[-1]
        own, theirs = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for at in range(0, len(left), 256):
            near = np.bitwise_count((left[at : at + 256, None] ^ right[None, :]).view(np.uint64)) <= threshold
            own[at : at + 256] = near.sum(axis=1)
            theirs += near.sum(axis=0)
        if len(sides) == 1:
            if table.column("i")[0] == table.column("j")[0]:
                # a hash is no link of itself
                return pa.table({"hash": left, "links": own - 1})
            # the other block is empty
            return pa.table({"hash": left, "links": np.zeros(len(left), np.int64)})
        return pa.table({"hash": np.concatenate(sides), "links": np.concatenate([own, theirs])})

    counted = met.groupBy("i", "j").applyInArrow(count, "hash long, links long")
    return counted.groupBy("hash").agg(F.sum("links").alias("links"))


def _per_word(distinct: DataFrame) -> int:
    n = max(distinct.count(), 2)
    return max(2, min(4, round(64 / math.log2(n) - 0.5)))


class _Bands:
    """Bands of a hash of ``words`` 64-bit words, and the masks that ``threshold`` bits leave to each."""

    def __init__(self, words: int, per_word: int, threshold: int):
        self.bands = _bands(words, per_word)
        self.weight = threshold // len(self.bands)

    def value(self, h: Column, i: int) -> Column:
        word, shift, size = self.bands[i]
        return F.shiftrightunsigned(h[word], shift).bitwiseAND(F.lit((1 << size) - 1))

    def _entry(self, i: int, value: Column) -> Column:
        return F.struct(F.lit(i).alias("band"), value.cast("long").alias("value"))

    def rows(self, col: str) -> Column:
        """One row (band, value) a band."""
        h = F.col(col)
        return F.inline(F.array(*[self._entry(i, self.value(h, i)) for i in range(len(self.bands))]))

    def probes(self, col: str) -> Column:
        """One row (band, value) for each value of a band that a hash in reach can have."""

        def around(i: int) -> Column:
            masks = F.array(*[F.lit(m).cast("long") for m in _masks(self.bands[i][2], self.weight)])
            return F.transform(masks, lambda m: self._entry(i, self.value(F.col(col), i).bitwiseXOR(m)))

        return F.inline(F.concat(*[around(i) for i in range(len(self.bands))]))

    def met_earlier(self, left: Column, right: Column) -> Column:
        """Whether a band before the row's own finds the pair too."""
        found = F.lit(False)
        for i in range(len(self.bands) - 1):
            close = F.bit_count(self.value(left, i).bitwiseXOR(self.value(right, i))) <= self.weight
            found = found | (close & (F.col("band") > i))
        return found


def meet_apart(probes: DataFrame, posts: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join of probes and posts on ``keys`` without most pairs that carry the same label.

    ``probes`` has ``pl`` and ``posts`` has ``label``, both never null. The commonest label of a key
    is its main one: posts of other labels are listed for everyone, posts of the main label only for
    probes of other labels. A key whose rows all have one label costs one row each and meets nobody,
    however hot it is. All pairs of different labels are in the result.
    """
    marks = posts.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    mains = settle(
        marks.groupBy(*keys).agg(
            F.max_by("label", F.struct("n", "label")).alias("main"),
            F.sum("n").alias("__n"),
            F.count(F.lit(1)).alias("__labels"),
        )
    )
    sides = F.when(F.col("label") == F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    listed = join_groups(posts, mains, keys, "__n").withColumn("side", F.explode(sides))
    side = F.when(F.col("pl") == F.col("main"), 1).otherwise(0)
    asked = join_groups(probes, mains, keys, "__n").withColumn("side", side).where("side = 0 OR __labels > 1")
    helpers = ("main", "__n", "__labels")
    return (
        asked.drop(*helpers)
        .join(listed.drop(*helpers), [*keys, "side"])
        .where("pl <> label")
        .drop("side")
    )


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the labels that ``links`` (a, b) connect have become one."""
    merged = connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("__to"))
    joined = labels.join(merged, "label", "left")
    return settle(joined.select("node", F.coalesce("__to", "label").alias("label")))


def band_stars(nodes: DataFrame, plan: _Bands, reach: int, words: int = 1) -> DataFrame:
    """(node, centre) where ``centre`` is the smallest node of one of the node's bands, at most ``reach`` bits away."""
    rows = nodes.select("node", "h", plan.rows("h"))
    centres = rows.groupBy("band", "value").agg(
        F.min(F.struct("node", "h")).alias("centre"), F.count(F.lit(1)).alias("__n")
    )
    near = hamming(F.col("h"), F.col("centre.h"), words) <= reach
    met = join_groups(rows, settle(centres), ["band", "value"], "__n").where(near)
    return met.select("node", F.col("centre.node").alias("centre"))


def near_clusters(nodes: DataFrame, threshold: int, words: int = 1, per_word: int | None = None) -> DataFrame:
    """(node, label): components of hashes at most ``threshold`` bits apart, label the smallest node.

    ``nodes`` has (node, h), one row for each different hash. Pairs are never listed: each band links
    its hashes to its smallest one first, which joins dense clusters by one row a hash and band; then
    only hashes whose labels still differ are compared, and each pair of labels gives one link.
    """
    plan = _Bands(words, per_word or _per_word(nodes), threshold)
    stars = band_stars(nodes, plan, threshold, words).where("node <> centre")
    alone = nodes.select("node", F.col("node").alias("label"))
    labels = relabel(alone, stars.select(F.col("centre").alias("a"), F.col("node").alias("b")))
    return relabel(labels, _label_links(nodes.join(labels, "node"), plan, threshold, words))


def _near_apart(nodes: DataFrame, plan: _Bands, threshold: int, words: int) -> DataFrame:
    """Near pairs (p, ph, pl, node, h, label, band) of ``nodes`` (node, h, label) whose labels differ."""
    posts = nodes.select("node", "h", "label", plan.rows("h"))
    probes = nodes.select(
        F.col("node").alias("p"), F.col("h").alias("ph"), F.col("label").alias("pl"), plan.probes("h")
    )
    met = meet_apart(probes, posts, ["band", "value"])
    return met.where(hamming(F.col("h"), F.col("ph"), words) <= threshold)


def _label_links(nodes: DataFrame, plan: _Bands, threshold: int, words: int) -> DataFrame:
    """Pairs (a, b) of labels with near nodes, by bands, or by all pairs of 64-bit hashes where bands would compare more."""
    nodes = settle(nodes)
    if words == 1 and _crowded(nodes, plan):
        return tile_links(nodes, threshold)
    near = _near_apart(nodes, plan, threshold, words)
    return near.select(F.least("label", "pl").alias("a"), F.greatest("label", "pl").alias("b")).distinct()


def _crowded(nodes: DataFrame, plan: _Bands) -> bool:
    """Whether the meetings in bands take longer than all pairs, of which a task compares ``PAIRS_A_MEETING`` times as many."""
    at = nodes.select("label", plan.rows("h")).groupBy("band", "value", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    of = at.groupBy("band", "value").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("met"))
    met = of.agg(F.sum("met")).first()[0] or 0.0
    masks = len(_masks(plan.bands[0][2], plan.weight))
    return nodes.count() ** 2 / 2 < PAIRS_A_MEETING * masks * met


def tile_links(nodes: DataFrame, threshold: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of different labels of ``nodes`` (h, label) with hashes at most ``threshold`` bits apart.

    All pairs are compared block by block as in :func:`near_counts`; a group gives each pair of labels once.
    """
    blocks = max(1, math.ceil(nodes.count() / tile))
    dealt = nodes.select(F.col("h")[0].alias("h"), "label")
    packed = dealt.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("h", "label")).alias("r")
    )
    packed = packed.select("block", F.col("r.h").alias("hs"), F.col("r.label").alias("labels"))
    met = _each_two(packed, blocks)

    def link(table: pa.Table) -> pa.Table:
        sides = [np.array(x.values, dtype=np.int64) for x in table.column("hs")]
        names = pa.concat_arrays([x.values for x in table.column("labels")]).dictionary_encode()
        codes = names.indices.to_numpy().astype(np.int64)
        left, right = sides[0], sides[-1]
        mine, theirs, k = codes[: len(left)], codes[len(codes) - len(right) :], len(names.dictionary)
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(left), 256):
            x, y = np.nonzero(np.bitwise_count((left[at : at + 256, None] ^ right[None, :]).view(np.uint64)) <= threshold)
            p, q = mine[at + x], theirs[y]
            p, q = np.minimum(p, q)[p != q], np.maximum(p, q)[p != q]
            found.append(np.unique(p * k + q))
        pairs = np.unique(np.concatenate(found))
        return pa.table({"a": names.dictionary.take(pa.array(pairs // k)), "b": names.dictionary.take(pa.array(pairs % k))})

    kind = nodes.schema["label"].dataType.simpleString()
    links = met.groupBy("i", "j").applyInArrow(link, f"a {kind}, b {kind}")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _each_two(packed: DataFrame, blocks: int) -> DataFrame:
    """Each row of ``packed`` (block, ...) once for every two blocks (i, j) that it is one of."""
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    rest = [c for c in packed.columns if c != "block"]
    return met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, label) with the smallest node of each component as its label.

    Alternates large-star and small-star steps until the edges stop changing; each step is an
    aggregate and an equi-join, written to the checkpoint folder. At most ``one_task`` edges are walked
    by one task instead, with the same labels.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = settle(
        both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _fingerprint(now)
    if mark[0] <= one_task:
        kind = now.schema["u"].dataType.simpleString()
        return now.repartition(1).mapInArrow(_walk_components, f"node {kind}, label {kind}")
    while True:
        # a node has at most as many rows as both directions of all edges: few edges, no hot node
        few = 2 * mark[0] <= HOT_NODE
        now = settle(_small_star(_large_star(now, few), few))
        after = _fingerprint(now)
        if after == mark:
            break
        mark = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = stars.select(F.col("label").alias("node"), "label").distinct()
    return stars.unionByName(roots)


def _walk_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of one task: each root points to a smaller one until it is the smallest."""
    up: dict = {}

    def root(node):
        while up.setdefault(node, node) != node:
            up[node] = up[up[node]]
            node = up[node]
        return node

    kind = None
    for batch in batches:
        kind = batch.schema.types[0]
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(u), root(v)))
            up[high] = low
    nodes = list(up)
    if nodes:
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, kind), pa.array([root(n) for n in nodes], kind)], names=["node", "label"]
        )


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 65_537)).first()
    return tuple(row)


def _with_min(pairs: DataFrame, low: Column, few: bool) -> DataFrame:
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n"))
    smallest = smallest.withColumn("m", low)
    return pairs.join(smallest, "u") if few else join_groups(pairs, smallest, ["u"], "__n", HOT_NODE)


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_min(both, F.least("u", "m"), few).where("v > u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    near = _with_min(down, F.col("m"), few)
    others = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = near.select("u", F.col("m").alias("v"))
    return others.unionByName(own).where("u <> v").distinct()


def _linked(items: DataFrame, labels: DataFrame) -> DataFrame:
    return items.join(labels.select(F.col("node").alias("finding_id"), F.col("label").alias("cluster")), "finding_id")


def content_facts(df: DataFrame) -> list[Column]:
    """content_id and content_sha256 of the candidates, null where the table has no such column."""
    names = ("content_id", "content_sha256")
    return [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]


def image_groups(df: DataFrame, threshold: int = 8, width: int = 16) -> tuple[DataFrame, DataFrame]:
    """``(members, warnings)`` of near-duplicate images by perceptual hash.

    Equal hashes are linked to one representative first; only distinct hashes are compared.
    """
    words = width // 16
    images = df.where(F.col("media_kind").isin("image", "photo") & F.col("perceptual_hash").isNotNull())
    # read several times below: written once, with the narrow columns only
    hashed = settle(
        images.select(
            "finding_id",
            "size_bytes",
            "source_paths",
            "preview_uri",
            *content_facts(df),
            hash_words("perceptual_hash", width).alias("h"),
        )
    )
    warnings = hashed.where("h IS NULL").select(
        F.concat(F.lit("invalid_perceptual_hash:"), F.col("finding_id").cast("string")).alias("warning")
    )
    items = hashed.where("h IS NOT NULL")
    reps = settle(items.groupBy("h").agg(F.min("finding_id").alias("node"), F.count(F.lit(1)).alias("n")))
    labels = near_clusters(reps.select("node", "h"), threshold, words)
    # cluster of each distinct hash; a hash of its own forms a group when several items share it
    clusters = reps.join(labels, "node").select("h", "n", F.col("label").alias("cluster"))
    totals = clusters.groupBy("cluster").agg(F.sum("n").alias("members")).where("members > 1")
    members = settle(join_groups(items, clusters.join(totals, "cluster"), ["h"], "n").drop("n"))
    named = _with_reference(members, "h")
    return named.withColumn("distance", hamming(F.col("h"), F.col("__ref"), words)).drop("__ref"), warnings


def _with_reference(members: DataFrame, hash_col: str) -> DataFrame:
    """Members with their cluster's canonical ids and ``__ref``, the hash that distances refer to.

    The cluster's size goes along, so the rows of a huge cluster do not meet in one task.
    """
    best = pick_canonical(members, "cluster").withColumnRenamed("members", "__n")
    ref = members.select(F.col("finding_id").alias("distance_ref_id"), F.col(hash_col).alias("__ref"))
    return join_groups(members, settle(best.join(ref, "distance_ref_id")), ["cluster"], "__n").drop("__n")


def matching_frames(left: Column, right: Column, threshold: int, enough: int | None = None) -> Column:
    """Greedy one-to-one frame matches: each left frame takes the first free right frame.

    The free right frames are carried along and shrink; counting ends at ``enough`` matches.
    """
    start = F.struct(right.alias("rest"), F.lit(0).alias("n"))

    def step(s: Column, frame: Column) -> Column:
        rest = s["rest"]
        near = F.filter(rest, lambda r: F.bit_count(r.bitwiseXOR(frame)) <= threshold)

        def without(at: Column) -> Column:
            at = at.cast("int")
            return F.concat(F.slice(rest, F.lit(1), at - 1), F.slice(rest, at + 1, F.size(rest)))

        def take(first: Column) -> Column:
            # an equal frame further left would be near too, so the first equal one is the first near one
            left_over = F.transform(F.array(F.array_position(rest, first)), without)[0]
            taken = F.struct(left_over.alias("rest"), (s["n"] + 1).alias("n"))
            return F.when(first.isNull(), s).otherwise(taken)

        after = F.transform(F.array(F.try_element_at(near, F.lit(1))), take)[0]
        return after if enough is None else F.when(s["n"] >= enough, s).otherwise(after)

    return F.when(F.size(right) > 0, F.aggregate(left, start, step, lambda s: s["n"])).otherwise(F.lit(0))


def video_edges(
    df: DataFrame, frame_threshold: int = 10, min_match: int = 2
) -> tuple[DataFrame, DataFrame]:
    """``(edges, sequences)`` that connect exactly the videos the frame rule would connect.

    ``df`` has (seq, finding_id) with ``seq`` an array of 64-bit frame hashes; equal sequences are one.
    An edge links a video to the smallest one of its component. Neither the pairs of a video's frames
    nor the owners of a frame are listed in pairs.
    """
    if min_match not in (1, 2):
        raise ValueError("min_match must be 1 or 2")
    seqs = settle(df.groupBy("seq").agg(F.min("finding_id").alias("vid")))
    if min_match == 1:
        labels = _by_any_frame(seqs, frame_threshold)
    else:
        labels = _by_two_frames(seqs, frame_threshold)
    edges = labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
    return edges, seqs


def _by_any_frame(seqs: DataFrame, threshold: int) -> DataFrame:
    """Components of videos where one near frame is enough: those of their frames' clusters."""
    postings = settle(seqs.select("vid", F.explode("seq").alias("f")).distinct())
    frames = settle(postings.select(F.col("f").alias("node"), F.array("f").alias("h")).distinct())
    clusters = near_clusters(frames, threshold).select(F.col("node").alias("f"), F.col("label").alias("key"))
    owners = postings.join(clusters, "f").select("vid", "key").distinct()
    alone = seqs.select(F.col("vid").alias("node"), F.col("vid").alias("label"))
    return relabel(alone, _to_least_owner(owners, ["key"]))


def _to_least_owner(owners: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) of each owner ``vid`` of a key to the key's smallest owner."""
    least = owners.groupBy(*keys).agg(F.min("vid").alias("a"), F.count(F.lit(1)).alias("__n"))
    linked = join_groups(owners, settle(least.where("__n > 1")), keys, "__n")
    return linked.where("a <> vid").select("a", F.col("vid").alias("b")).distinct()


def _by_two_frames(seqs: DataFrame, threshold: int, tile: int = TILE) -> DataFrame:
    """Components of videos where two frames must match one to one.

    Neither near frames nor pairs of videos are listed. The videos are dealt into blocks of about ``tile`` frames. The
    videos of a block are joined among themselves first; then each two blocks meet, and only videos whose labels still
    differ are compared. A group gives one link a label at most. Time grows with the square of the frames where few videos
    are alike, the data moved with that square over ``tile``.
    """
    frames = seqs.agg(F.sum(F.size("seq"))).first()[0] or 0
    blocks = max(1, math.ceil(frames / tile))
    block = F.pmod(F.xxhash64("vid"), F.lit(blocks)).alias("block")
    labels = settle(seqs.select(F.col("vid").alias("node"), F.col("vid").alias("label")))
    kind = labels.schema["label"].dataType.simpleString()

    def packed() -> DataFrame:
        named = seqs.join(labels.withColumnRenamed("node", "vid"), "vid")
        rows = named.groupBy(block).agg(F.collect_list(F.struct("seq", "label")).alias("r"))
        sizes = F.transform("r", lambda v: F.size(v["seq"])).alias("sizes")
        return rows.select("block", F.flatten("r.seq").alias("hs"), sizes, F.col("r.label").alias("labels"))

    def link(table: pa.Table) -> pa.Table:
        hashes = [np.array(x.values, dtype=np.int64) for x in table.column("hs")]
        sizes = [np.array(x.values, dtype=np.int64) for x in table.column("sizes")]
        names = pa.concat_arrays([x.values for x in table.column("labels")]).dictionary_encode()
        codes = names.indices.to_numpy().astype(np.int64)
        met = len(hashes) > 1 or table.column("i")[0] == table.column("j")[0]
        up = _join_alike(hashes, sizes, [codes[: len(sizes[0])], codes[len(codes) - len(sizes[-1]) :]], len(names.dictionary), threshold) if met else np.arange(0)
        moved = np.flatnonzero(up != np.arange(len(up)))
        return pa.table({"a": names.dictionary.take(pa.array(up[moved])), "b": names.dictionary.take(pa.array(moved))})

    def links(met: DataFrame) -> DataFrame:
        return met.groupBy("i", "j").applyInArrow(link, f"a {kind}, b {kind}")

    alone = packed()
    labels = relabel(labels, links(alone.select(F.col("block").alias("i"), F.col("block").alias("j"), *alone.columns[1:])))
    return relabel(labels, links(_each_two(packed(), blocks).where("i <> j"))) if blocks > 1 else labels


def _join_alike(hashes: list, sizes: list, codes: list, labels: int, threshold: int) -> np.ndarray:
    """The least label that each label is joined with, of the videos of one block or two (frames, lengths, labels of each).

    Two greedy matches: a left frame after the first one that is near any takes another right frame than that one's first.
    """
    up = np.arange(labels)
    # left videos of one label stand together, so most of the other side is passed over
    order = np.argsort(codes[0], kind="stable")
    starts = np.cumsum(sizes[0]) - sizes[0]
    long = sizes[0][order]
    at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(starts[order], long)
    left, left_of, mine = hashes[0][at], np.repeat(np.arange(len(order)), long), codes[0][order]
    right, right_of, theirs = hashes[-1], np.repeat(np.arange(len(sizes[-1])), sizes[-1]), codes[-1]
    step = max(1, PAIRS_HELD // max(1, len(right)))
    open_of, first_of = -1, np.zeros(0, np.int64)
    for at in range(0, len(left), step):
        of = left_of[at : at + step]
        here = np.unique(mine[of])
        asked = np.flatnonzero(theirs[right_of] != here[0]) if len(here) == 1 else np.arange(len(right))
        apart = np.bitwise_count((left[at : at + step, None] ^ right[asked][None, :]).view(np.uint64))
        x, y = np.nonzero(apart <= threshold)
        y = asked[y]
        other = mine[of[x]] != theirs[right_of[y]]
        x, y = x[other], y[other]
        pair = of[x] * len(theirs) + right_of[y]
        pairs, begins, which = np.unique(pair, return_index=True, return_inverse=True)
        row, col = x[begins], y[begins]
        if of[0] == open_of:
            # a video that began in an earlier piece
            known = first_of[pairs % len(theirs)]
            known[pairs // len(theirs) != open_of] = -1
            row, col = np.where(known >= 0, -1, row), np.where(known >= 0, known, col)
        hit = np.unique(pair[(x != row[which]) & (y != col[which])])
        if at + step < len(left) and left_of[at + step] == of[-1]:
            if of[-1] != open_of:
                open_of, first_of = of[-1], np.full(len(theirs), -1)
            last = pairs // len(theirs) == open_of
            first_of[pairs[last] % len(theirs)] = col[last]
        found = np.unique(mine[hit // len(theirs)] * labels + theirs[hit % len(theirs)])
        for a, b in zip((found // labels).tolist(), (found % labels).tolist()):
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        while len(found) and (up[up] != up).any():
            up = up[up]
        mine, theirs = up[mine], up[theirs]
    return up


def video_groups(
    df: DataFrame,
    frame_threshold: int = 10,
    min_match: int = 2,
    max_frames: int | None = None,
    width: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """``(members, warnings)`` of near-duplicate videos by all, or the first ``max_frames``, key frame hashes."""
    if width != 16:
        raise ValueError("frame hashes have 64 bits")
    videos = df.where((F.col("media_kind") == "video") & (F.size("video_keyframe_hashes") > 0))
    seen = F.col("video_keyframe_hashes") if max_frames is None else F.slice("video_keyframe_hashes", 1, max_frames)
    frames = F.transform(seen, lambda f: hash_words(f, 16)[0])
    hashed = settle(
        videos.select("finding_id", "size_bytes", "source_paths", "preview_uri", *content_facts(df), frames.alias("seq"))
    )
    broken = F.exists("seq", lambda f: f.isNull())
    warnings = hashed.where(broken).select(
        F.concat(F.lit("invalid_video_keyframe_hash:"), F.col("finding_id").cast("string")).alias("warning")
    )
    items = hashed.where(~broken)
    edges, seqs = video_edges(items, frame_threshold, min_match)
    labels = connected_components(edges)
    clusters = seqs.join(labels.withColumnRenamed("node", "vid"), "vid", "left").select(
        "seq", F.coalesce("label", "vid").alias("cluster"), F.col("label").isNotNull().alias("__linked")
    )
    # copies of one sequence match each other when it has enough frames of its own
    enough = F.size("seq") >= min_match
    own = items.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    sized = own.join(clusters, "seq").where(F.col("__linked") | ((F.col("n") > 1) & enough)).drop("__linked")
    members = settle(join_groups(items, sized, ["seq"], "n").drop("n"))
    matched = _with_reference(members, "seq").withColumn(
        "matching_frames", matching_frames(F.col("seq"), F.col("__ref"), frame_threshold)
    )
    return matched.drop("__ref"), warnings


GROUP_COLS = (
    "group_id",
    "group_kind",
    "algorithm",
    "threshold",
    "canonical_id",
    "canonical_preview_uri",
    "warnings",
    "finding_id",
    "content_id",
    "source_paths",
    "content_sha256",
    "size_bytes",
    "distance",
    "matching_frames",
)


def _named(
    members: DataFrame, group: str, kind: str, algorithm: str, threshold: int | None, warnings: tuple[str, ...] = ()
) -> DataFrame:
    """Long rows of groups: facts of the group (its canonical member's first path too), then of the member."""
    sizes = members.groupBy(group).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max(
            F.when(F.col("finding_id") == F.col("canonical_id"), F.try_element_at("source_paths", F.lit(1)))
        ).alias("canonical_preview_uri"),
    )
    sized = settle(group_ids(members, group, kind, algorithm).join(sizes, group))
    out = join_groups(members, sized, [group], "__n")
    for name in ("distance", "matching_frames"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("int"))
    facts = {
        "group_kind": F.lit(kind),
        "algorithm": F.lit(algorithm),
        "threshold": F.lit(threshold).cast("int"),
        "warnings": F.array(*[F.lit(w) for w in warnings]).cast("array<string>"),
    }
    return out.withColumns(facts).select(*GROUP_COLS)


def build_duplicate_groups(
    df: DataFrame,
    image_threshold: int = 8,
    frame_threshold: int = 10,
    min_match: int = 2,
    max_frames: int | None = None,
    limit: int = GROUP_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """``(groups, warnings)``: exact, image and video groups in one long table, one row per member.

    Each row has the group's id, kind, algorithm, threshold, canonical member, that member's first path
    as preview (null without paths) and warnings, then the member's own facts.
    """
    exact, w1 = exact_duplicates(df, limit)
    exact = settle(exact.select("finding_id", "size_bytes", "source_paths", "preview_uri", *content_facts(exact)))
    best = settle(
        pick_canonical(exact, "content_sha256").select("content_sha256", "canonical_id", F.col("members").alias("__n"))
    )
    exact = join_groups(exact, best, ["content_sha256"], "__n").drop("__n")
    images, w2 = image_groups(df, image_threshold)
    videos, w3 = video_groups(df, frame_threshold, min_match, max_frames)
    groups = (
        _named(exact, "content_sha256", "exact-sha256", "sha256-size-v1", None)
        .unionByName(_named(images, "cluster", "image-perceptual", "hex-hamming-v1", image_threshold))
        .unionByName(
            _named(
                videos,
                "cluster",
                "video-keyframe",
                "bounded-keyframe-hamming-v1",
                frame_threshold,
                (f"video_min_matching_frames:{min_match}",),
            )
        )
    )
    return groups, w1.unionByName(w2).unionByName(w3).distinct()
