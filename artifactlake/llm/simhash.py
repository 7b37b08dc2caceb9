"""SimHash fingerprints, and groups of fingerprints that differ in a few bits (multi-index hashing).

A fingerprint is cut into ``bits // 2 + 1`` segments (two at least). If two fingerprints differ in at most ``bits`` bits,
they differ in at most ``bits // segments`` of some segment, so every fingerprint looks up the small
Hamming ball around each of its segments in the table of segments and compares the whole fingerprint
with what it finds. No pair within the distance is lost. Equal fingerprints count once before the
search, so copies make no pairs.

``similar_groups`` asks for similar texts instead of near fingerprints. Its SimHashes have 1,024 bits, and the sums behind
the bits give 80 keys of 28 bits: the sums are turned 20 times, each time the place and sign of the largest of 64 give
7 bits, and four such make a key. Sets of similarity 0.8 differ in about 15 % of the bits; one of the keys agrees in 95 of
100 cases. Texts with nothing in common share a key once in 2**28 / 80 pairs, so meetings by chance stay few. Texts with
a common key are compared with the most central of them by 64 bits; complete distances and then the shingle sets
decide. That joins most copies cheaply. What it leaves apart is found without keys: similar sets share a rare part
(``_rare_parts``), and all that do so with a text of another group meet by their rarest shingles (``_rare_meetings``). Neither
loses a similar pair: texts that share a long passage, or have a common origin but differ too much, are many, but each
has shingles of its own.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import settle
from .common import Shelf, Spans, annotate, column, give_back, mix, release, unpack, word_bounds, word_codes
from .components import connected_components

WIDTH = 64
#: shingles whose bits are counted at once
BLOCK = 1 << 15


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the ``words``-word shingles of a text (ASCII letters lowered); 0 without a word."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    take = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(WIDTH, np.int64)
    for a in range(0, take, BLOCK):
        pairs = zip(starts[a : a + BLOCK].tolist(), last[a : a + BLOCK].tolist(), strict=False)
        codes = np.array([digest(joined[i:j], seed) for i, j in pairs if j > i], np.uint64)
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > take, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text", keep=None) -> DataFrame:
    """``keep`` columns and ``simhash`` (long) of each row; null and wordless texts get 0."""

    def make(raw, at):
        data = raw.tobytes()
        codes = [fingerprint(data[a:b], words, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [pa.array(np.array(codes, np.uint64).view(np.int64))]

    return annotate(docs, T.StructType([T.StructField("simhash", T.LongType())]), make, text, keep)


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments that a search within ``bits`` bits uses."""
    n = max(2, bits // 2 + 1)
    edges = [round(i * WIDTH / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in ones) for r in range(radius + 1) for ones in combinations(range(width), r)]


def _segment(h: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(h, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def near_fingerprints(codes: DataFrame, bits: int = 3, code: str = "simhash") -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in 1 to ``bits`` bits; each pair once."""
    parts = segments(bits)
    radius = bits // len(parts)
    distinct = codes.select(F.col(code).alias("a")).where("a IS NOT NULL").distinct()
    a, b = F.col("a"), F.col("b")

    def entry(i: int, value: Column) -> Column:
        return F.struct(F.lit(i).alias("segment"), value.cast("long").alias("value"))

    def around(i: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in ball(parts[i][1], radius)])
        return F.transform(masks, lambda m: entry(i, _segment(a, parts[i]).bitwiseXOR(m)))

    table = distinct.select(
        a.alias("b"), F.inline(F.array(*[entry(i, _segment(a, p)) for i, p in enumerate(parts)]))
    )
    probes = distinct.select("a", F.inline(F.concat(*[around(i) for i in range(len(parts))])))
    # a pair that an earlier segment finds as well is left to that segment
    earlier = F.lit(False)
    for i, p in enumerate(parts[:-1]):
        close = F.bit_count(_segment(a, p).bitwiseXOR(_segment(b, p))) <= radius
        earlier = earlier | (close & (F.col("segment") > i))
    return (
        probes.join(table, ["segment", "value"])
        .where((a < b) & (F.bit_count(a.bitwiseXOR(b)) <= bits) & ~earlier)
        .select("a", "b")
    )


def near_groups(docs: DataFrame, bits: int = 3, words: int = 3, seed: int = 42, id_col: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """``keep`` columns (the id at least), ``simhash`` and ``component_id`` of each row.

    ``component_id`` is the smallest id that is reachable over links of at most ``bits`` bits; rows whose
    id is null take part and get the smallest id of their group (null if it has none). Rows with the
    same fingerprint are always together. Repeated rows stay. An empty table gives no rows.
    """
    keep = [id_col, *[c for c in keep or [] if c != id_col]]
    rows = settle(fingerprints(docs, words, seed, text, keep))
    nodes = settle(rows.groupBy("simhash").agg(F.min(id_col).alias("low")))
    edges = settle(near_fingerprints(nodes, bits))
    release(docs.sparkSession)
    labels = connected_components(edges)
    grouped = nodes.join(labels, F.col("simhash") == F.col("node"), "left").select(
        "simhash", "low", F.coalesce("label", "simhash").alias("label")
    )
    lowest = grouped.groupBy("label").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "label").select("simhash", "component_id")
    return rows.join(named, "simhash").select(*keep, "simhash", "component_id")


#: shingles and similarity of ``similar_groups``
SIMILAR_WORDS, SIMILAR = 5, 0.8
#: its SimHashes: segments, their width, words of 64 bits (the last for the comparison), bits that may differ in the last word and in all
SEGMENTS, SEGMENT_BITS, CODE_WORDS, CHECK_BITS, CODE_BITS = 16, 20, 16, 20, 180
#: keys: turns of the sums, sums of which one is the largest, places of a key; rows whose sums are held at once
TURNS, STRONG, KEY_PLACES, SUM_ROWS = 20, 64, 4, 256
KEYS = TURNS * CODE_WORDS * WIDTH // (STRONG * KEY_PLACES)
#: rows of a bucket whose nodes are compared with each other before the search by rare shingles
FEW = 8
#: classes of size in each power of e, for the meetings by rare shingles
SIZE_CLASSES = 20
#: bytes of shingle sets that a task of the exact comparison keeps
KEPT_SETS = 16 << 20
#: parts: growth of a class of size, levels of finer parts, packed bytes of text for each bucket of their keys
PART_CLASS, FINER, PART_BYTES = 1.5, (1, 4, 0), 2 << 20


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int = SIMILAR_WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each row's distinct shingles (ASCII letters lowered); a shorter text is one shingle."""
    low = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
    starts, ends, rows = word_bounds(low, at)
    spans = Spans(word_codes(low, starts, ends))
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        first = np.arange(a, max(b - words, a) + 1 if b > a else a)
        out.append(np.unique(spans.of(first, np.minimum(first + words, b))))
    return out


def set_sums(codes: np.ndarray, n: int = CODE_WORDS) -> np.ndarray:
    """For each of ``n * 64`` bits, how many more hashes of a set have it than have it not."""
    turns = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(n * WIDTH, np.int64)
    step = BLOCK // n
    for a in range(0, len(codes), step):
        wide = mix(codes[a : a + step, None] + turns)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones - len(codes)


def set_code(codes: np.ndarray, n: int = CODE_WORDS) -> np.ndarray:
    """SimHash of a set of shingle hashes in ``n`` words of 64 bits; zeros of the empty set."""
    return np.packbits(set_sums(codes, n) > 0, bitorder="little").view(np.uint64)


@lru_cache(maxsize=1)
def _rotation() -> tuple[np.ndarray, np.ndarray]:
    """A Hadamard matrix, and random signs for each turn."""
    side = int((CODE_WORDS * WIDTH) ** 0.5)
    matrix = np.ones((1, 1))
    while len(matrix) < side:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    bits = mix(np.arange(1, TURNS * side * side + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(63)
    return matrix, (1.0 - 2.0 * bits).reshape(TURNS, side, side)


def strong_keys(sums: np.ndarray) -> np.ndarray:
    """Keys of sums (one set a row): places and signs of the largest sums after random turns.

    A turn keeps angles, so sets whose SimHashes are near have near sums after it; strong ones change last.
    """
    matrix, signs = _rotation()
    # all values are whole numbers below this total: exact in either width, so keys do not depend on the machine
    exact = np.float32 if not len(sums) or np.abs(sums).sum(axis=1).max() < 1 << 24 else np.float64
    grid, matrix = sums.astype(exact).reshape(-1, *matrix.shape), matrix.astype(exact)
    weights = (2 * STRONG) ** np.arange(KEY_PLACES)
    out = []
    for sign in signs.astype(exact):
        turned = (matrix @ (grid * sign) @ matrix).reshape(-1, STRONG)
        at = np.abs(turned).argmax(axis=1)
        place = 2 * at + (turned[np.arange(len(at)), at] > 0)
        out.append(place.reshape(len(sums), KEYS // TURNS, KEY_PLACES) @ weights)
    return np.concatenate(out, axis=1)


def _lists(table: np.ndarray) -> pa.Array:
    """The rows of a table as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1], np.int32)), pa.array(table.ravel()))


def segment_values(code: np.ndarray) -> np.ndarray:
    """The segments of codes (one a row), each as a number of ``SEGMENT_BITS`` bits: values for a search with balls."""
    bits = np.unpackbits(np.ascontiguousarray(code).view(np.uint8), axis=1, bitorder="little")[:, : SEGMENTS * SEGMENT_BITS]
    return bits.reshape(len(code), SEGMENTS, SEGMENT_BITS).astype(np.int64) @ (1 << np.arange(SEGMENT_BITS, dtype=np.int64))


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _entries(nodes: DataFrame) -> DataFrame:
    """A row (key, set, check, label) for each node and value; the key is the value's place and the value."""
    keys = F.transform("values", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long")))
    return nodes.select(F.explode(keys).alias("key"), "set", "check", "label")


def _leaders(nodes: DataFrame, ball: int = SEGMENT_BITS) -> DataFrame:
    """Pairs (a, b), a < b: each node with the most central near node that it meets, one pair a node at most.

    A node is central that shares its values with many. The most central node of each value shared by two
    or more looks through the ball around it (one of ``ball`` bits may differ; 0: equal values only), so the copies
    of one text meet that text and not each other.
    """
    table = _entries(nodes)
    shared = table.join(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    if not ball:
        # few rows, and all that can meet
        table = shared = settle(shared)
    degree = shared.groupBy("set").agg(F.sum("n").alias("degree"))
    rank = F.struct("degree", -F.col("set"))
    head = F.struct(F.col("set").alias("a"), F.col("check").alias("check_a"), "degree")
    probes = shared.join(degree, "set").groupBy("key").agg(F.max_by(head, rank).alias("m")).select("key", "m.*")
    if ball:
        masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(ball)])
        probes = probes.select(F.explode(F.transform(masks, lambda m: F.col("key").bitwiseXOR(m))).alias("key"), "a", "check_a", "degree")
    near = F.bit_count(F.col("check").bitwiseXOR(F.col("check_a"))) <= CHECK_BITS
    met = table.join(probes, "key").where(near & (F.col("set") != F.col("a")))
    best = met.groupBy("set").agg(F.max_by("a", F.struct("degree", -F.col("a"))).alias("a"))
    return best.select(F.least("set", "a").alias("a"), F.greatest("set", "a").alias("b")).distinct()


def _across(shelf: Shelf, asked: DataFrame, theirs: DataFrame, cond: Column) -> DataFrame:
    """Pairs (a, b), a < b, of nodes with a common key and different labels that fulfil ``cond``.

    Labels meet before their nodes do, so nodes of one label are never paired, however many share a key.
    """
    labels = asked.select("key", "label").distinct().join(theirs.select("key", "label_b").distinct(), "key").where("label <> label_b")
    met = asked.join(shelf.put(labels), ["key", "label"]).join(theirs, ["key", "label_b"]).where(cond)
    return met.select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b")).distinct()


def _apart(shelf: Shelf, table: DataFrame) -> DataFrame:
    """Nodes (set, label) that have a key in common with a node of another label.

    Those that meet by chance stand in buckets of a few rows. There the last words are compared, so that the nodes that go on
    stay in proportion to the input; of larger buckets all go on.
    """
    key = W.partitionBy("key")
    told = {"low": F.min("label").over(key), "high": F.max("label").over(key), "n": F.count(F.lit(1)).over(key)}
    shared = shelf.put(table.withColumns(told).where("low <> high").select("key", "set", "check", "label", "n"))
    # the window's shuffle and the entries are the largest tables of the search
    release(shelf.spark)
    many, few = shared.where(F.col("n") > FEW), shared.where(F.col("n") <= FEW)
    theirs = few.select("key", F.col("check").alias("check_b"), F.col("label").alias("label_b"))
    near = F.bit_count(F.col("check").bitwiseXOR(F.col("check_b"))) <= CHECK_BITS
    met = few.select("key", "set", "check", "label").join(theirs, "key").where(near & (F.col("label") != F.col("label_b")))
    return many.select("set", "label").unionByName(met.select("set", "label")).distinct()


def _balls(shelf: Shelf, nodes: DataFrame, ball: int = SEGMENT_BITS, search=None) -> DataFrame:
    """All pairs of nodes with different labels that have values within one of ``ball`` bits (0: equal values), and near last words.

    Of two values that differ in one bit the one without it asks for the other; of two equal ones the lesser node
    asks. A probe goes on where its bucket holds another label. With ``search`` (equal values only) the pairs are those
    that it finds among the nodes that ``_apart`` gives.
    """
    table = shelf.put(_entries(nodes))
    kinds = table.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    if ball:
        masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(ball)])
        free = F.filter(masks, lambda m: F.col("key").bitwiseAND(m) == 0)
        probes = table.select(F.explode(free).alias("mask"), "key", "set", "check", "label").select(
            F.col("key").bitwiseOR(F.col("mask")).alias("key"), (F.col("mask") == 0).alias("same"), "set", "check", "label"
        )
        asked = shelf.put(probes.join(kinds, "key").where("label <> low OR label <> high").drop("low", "high", "n"))
        theirs = table.join(asked.select("key").distinct(), "key")
    else:
        if search is not None:
            return search(_apart(shelf, table))
        probes = table.join(kinds.where("low <> high"), "key", "left_semi")
        theirs = asked = shelf.put(probes.withColumn("same", F.lit(True)))
    theirs = shelf.put(theirs.select("key", F.col("set").alias("b"), F.col("check").alias("check_b"), F.col("label").alias("label_b")))
    near = F.bit_count(F.col("check").bitwiseXOR(F.col("check_b"))) <= CHECK_BITS
    return _across(shelf, asked, theirs, near & (~F.col("same") | (F.col("set") < F.col("b"))))


def _texts(shelf: Shelf, rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One packed text (set, z) for each of the nodes ``asked``, and the table behind it."""
    # one row stands for all of its node
    first = shelf.put(rows.join(asked, "set", "left_semi").groupBy("set").agg(F.min("rid").alias("rid")))
    return shelf.put(rows.join(first.select("rid"), "rid").select("set", "z")), first


def _shingle_rows(texts: DataFrame, words: int) -> DataFrame:
    """A row (set, n, shingle) for each shingle of each text; n is their number in the text."""

    def run(batches):
        for batch in batches:
            nodes = column(batch, "set").to_numpy()
            for first, last, raw, at in unpack(column(batch, "z")):
                sets = shingle_sets(raw, at, words)
                n = np.array([len(x) for x in sets], np.int64)
                parts = [np.repeat(nodes[first:last], n), np.repeat(n, n), np.concatenate(sets).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["set", "n", "shingle"])
            give_back()

    return texts.mapInArrow(run, "set long, n long, shingle long")


def _rare_meetings(shelf: Shelf, apart: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """Pairs of the nodes ``apart`` (set, label) with different labels whose shingle sets can have a similarity of ``least``.

    Sets of n and m shingles are that similar if they share ``least / (1 + least) * (n + m)`` of them, so with all shingles
    in one order, rare ones first, they share one within the first few; how few follows from the sizes.
    Every node is found by the few that hold for an equal size, and asks for smaller ones by classes of
    size. Where the first common shingle stands says how many can follow. No pair is lost.
    """
    texts, first = _texts(shelf, rows, apart)
    all_rows = shelf.put(_shingle_rows(texts, words))
    common = all_rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # a node's own shingles come first and meet nobody
    node = W.partitionBy("set")
    own = F.col("n") - F.count(F.lit(1)).over(node)
    place = own + F.row_number().over(node.orderBy("f", "shingle"))
    n, pos = F.col("n"), F.col("pos")

    def need(sizes: Column) -> Column:
        return F.ceil(sizes * (least / (1 + least)) - 1e-6)

    smallest = F.ceil(n * least - 1e-6)
    placed = all_rows.join(common, "shingle").withColumn("pos", place).where(pos <= n - need(n + smallest) + 1)
    entries = shelf.put(placed.join(apart, "set").select("set", "label", "n", "shingle", "pos"))
    shelf.drop(first, texts, all_rows)

    def size_class(size: Column) -> Column:
        return F.floor(F.log(size) * SIZE_CLASSES)

    theirs = entries.where(pos <= n - need(2 * n) + 1).select(
        F.xxhash64("shingle", size_class(n)).alias("key"), F.col("set").alias("b"), F.col("label").alias("label_b"), n.alias("n_b"), pos.alias("pos_b")
    )
    least_of = F.greatest(smallest, F.floor(F.exp(F.col("size") / SIZE_CLASSES) * (1 - 1e-9)))
    asked = entries.withColumn("size", F.explode(F.sequence(size_class(smallest), size_class(n)))).where(pos <= n - need(n + least_of) + 1)
    asked = asked.select(F.xxhash64("shingle", "size").alias("key"), "set", "label", "n", "pos")
    n_b = F.col("n_b")
    follow = F.least(n - pos, n_b - F.col("pos_b")) + 1
    smaller = (n_b < n) | ((n_b == n) & (F.col("b") < F.col("set")))
    # from the written entries on, a few rows a node
    asked, theirs = shelf.put(asked), shelf.put(theirs)
    return _across(shelf, asked, theirs, smaller & (n_b >= smallest) & (follow >= need(n + n_b)))


def _size_classes(most: int, least: float) -> np.ndarray:
    """First sizes of the classes up to two beyond the size ``most``; similar sets are in one class or in neighbouring ones."""
    first, growth = [1], max(PART_CLASS, 1 / least)
    while len(first) < 3 or first[-3] <= most:
        first.append(int(np.ceil(first[-1] * growth)) + (growth * first[-1] < first[-1] + 1))
    return np.array(first, np.int64)


def part_keys(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their rows, marks) of the parts of sorted sets; a mark is (row, tag, spare parts).

    A pair follows the scheme of its larger set's class: the range of hashes is cut into equal parts, and a key stands for
    all that a set holds of one part. Where two sets differ in d shingles, all parts but d are the same, so of the parts
    that are not empty a set can miss as many as exceed d and one: its spare parts. Where a set has too few parts for any
    partner, they are cut finer, at last into single shingles. Keys end in three bits of their tag (level and scheme).
    """
    n = np.array([len(x) for x in sets], np.int64)
    codes, row = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(n)), n)
    first = _size_classes(int(n.max(initial=0)), least)
    own = np.searchsorted(first, n, "right") - 1
    widest = np.floor(n / least + 1e-6).astype(np.int64)
    keys, rows, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    for up in (0, 1):
        scheme = own + up
        takes = (n > 0) & ((up == 0) | (widest >= first[np.minimum(scheme, len(first) - 1)]))
        # as many shingles can differ between the set and its largest partner
        partner = widest if up else np.minimum(widest, first[np.minimum(own + 1, len(first) - 1)] - 1)
        differ = np.floor((n + partner) * ((1 - least) / (1 + least)) + 1e-6).astype(np.int64)
        wide = np.maximum(1, np.ceil(first[np.minimum(scheme + 1, len(first) - 1)] * ((1 - least) / least))).astype(np.uint64)
        for level, finer in enumerate(FINER):
            at = np.flatnonzero(takes[row])
            if not len(at):
                break
            of, held = row[at], codes[at]
            if finer:
                part = ((held >> np.uint64(32)) * (wide[of] * np.uint64(finer))) >> np.uint64(32)
                allowed = differ
            else:
                # a shingle alone: only those that the partner lacks are lost
                part, allowed = np.arange(len(at), dtype=np.uint64), np.floor(n * (1 - least) + 1e-6).astype(np.int64)
            begins = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (part[1:] != part[:-1]))))
            owner = of[begins]
            tag = (level << 1) | (scheme & 1)
            total = np.add.reduceat(mix(held), begins)
            where = part[begins] if finer else np.zeros(len(begins), np.uint64)
            salt = mix((scheme[owner] * 8 + level + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            made = mix(total + salt + where * np.uint64(0xC2B2AE3D27D4EB4F))
            keys.append((made & ~np.uint64(7)) | tag[owner].astype(np.uint64))
            rows.append(owner)
            count = np.bincount(owner, minlength=len(n))
            who = np.flatnonzero(takes)
            free = np.maximum(count - allowed - 1, 0)
            marks.append(np.stack([who, tag[who], free[who]], axis=1))
            takes = takes & (count <= allowed)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(marks)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    """The numbers of a column of packed arrays."""
    return np.frombuffer(b"".join(x.as_buffer() for x in table.column(name)), kind)


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """One row for each bucket with its numbers of each column, packed."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket)) if len(cuts) else cuts
    packed = [[c[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)] for c in (x[order] for x in columns)]
    return [pa.array(bucket[cuts]), *[pa.array(p, pa.binary()) for p in packed]]


def _rare_parts(shelf: Shelf, labelled: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """Nodes (set, label) of ``labelled`` that share one of their rare parts with a node of another label.

    Two sets of similarity ``least`` share one of the parts (``part_keys``) that are left when each puts its spare
    ones aside, whatever the order; here the commonest are put aside. Parts of one owner come first and meet nobody. Of
    each similar pair with different labels both nodes are in the result, with or without a key of SimHashes in common.
    Keys travel packed, a row for each batch and bucket.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("z"))).first()[0] or 0
    buckets = max(-(-size // PART_BYTES), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def of_set(sets: np.ndarray) -> np.ndarray:
        return (mix(sets.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def deal(batches):
        for batch in batches:
            nodes = column(batch, "set").to_numpy()
            # copies in one batch count once
            once = np.sort(np.unique(nodes, return_index=True)[1])
            nodes = nodes[once]
            for first, last, raw, at in unpack(column(batch, "z").take(pa.array(once))):
                keys, owner, marks = part_keys(shingle_sets(raw, at, words), least)
                sets = nodes[first:last]
                for parts in (
                    _dealt((keys >> np.uint64(3)).astype(np.int64) % buckets, keys.view(np.int64), sets[owner]),
                    # marks go to the buckets of sets, past the counting
                    _dealt(-1 - of_set(sets[marks[:, 0]]), marks[:, 2] << 3 | marks[:, 1], sets[marks[:, 0]], np.full(len(marks), -1)),
                ):
                    if len(parts) == 3:
                        parts.append(pa.nulls(len(parts[0]), pa.binary()))
                    yield pa.RecordBatch.from_arrays(parts, names=["bucket", "keys", "sets", "owners"])
            give_back()

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table.set_column(0, "bucket", pa.array(np.full(len(table), -1 - bucket)))
        keys, sets = _joined(table, "keys", np.uint64), _joined(table, "sets", np.int64)
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])))
        keys, sets = keys[fresh], sets[fresh]
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        owners = np.repeat(np.diff(np.append(begins, len(keys))), np.diff(np.append(begins, len(keys))))
        keys, sets, owners = (x[owners > 1] for x in (keys, sets, owners))
        return pa.table(_dealt(of_set(sets), keys, sets, owners), names=["bucket", "keys", "sets", "owners"])

    def rare(table: pa.Table) -> pa.Table:
        keys, sets, owners = (_joined(table, c, np.int64) for c in ("keys", "sets", "owners"))
        order = np.lexsort((keys.view(np.uint64), owners, keys & 7, sets))
        keys, sets, owners = keys[order], sets[order], owners[order]
        # several copies bring the same mark
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1]) | (owners[1:] != owners[:-1])))
        keys, sets, owners = keys[fresh], sets[fresh], owners[fresh]
        begins = np.flatnonzero(owners < 0)
        long = np.diff(np.append(begins, len(keys)))
        group = np.repeat(np.arange(len(begins)), long)
        place = np.arange(len(keys)) - begins[group]
        kept = (place > 0) & (place < long[group] - (keys[begins] >> 3)[group])
        return pa.table({"key": keys[kept], "set": sets[kept]})

    packed = "bucket long, keys binary, sets binary, owners binary"
    # not named: what a name holds stays on disk
    entries = shelf.put(
        rows.select("set", "z").mapInArrow(deal, packed).groupBy("bucket").applyInArrow(count, packed)
        .groupBy("bucket").applyInArrow(rare, "key long, set long")
    )
    release(spark)
    key = W.partitionBy("key")
    low, high = F.min("label").over(key).alias("low"), F.max("label").over(key).alias("high")
    found = shelf.put(entries.join(labelled, "set").select("set", "label", low, high).where("low <> high").select("set", "label").distinct())
    shelf.drop(entries)
    return found


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose complete codes differ in ``CODE_BITS`` bits at most."""
    code = nodes.select("set", "code")
    both = pairs.join(code.select(F.col("set").alias("a"), F.col("code").alias("code_a")), "a")
    both = both.join(code.select(F.col("set").alias("b"), F.col("code").alias("code_b")), "b")
    apart = sum((F.bit_count(F.col("code_a")[i].bitwiseXOR(F.col("code_b")[i])) for i in range(CODE_WORDS)), F.lit(0))
    return both.where(apart <= CODE_BITS).select("a", "b")


def _confirmed(shelf: Shelf, pairs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs of nodes whose shingle sets have a Jaccard similarity of ``least`` or more."""
    asked = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    texts, first = _texts(shelf, rows, asked)
    both = pairs.join(texts.select(F.col("set").alias("b"), F.col("z").alias("zb")), "b")
    both = both.join(texts.select(F.col("set").alias("a"), F.col("z").alias("za")), "a").select("a", "b", "za", "zb")

    def run(batches):
        plain = zstandard.ZstdDecompressor()
        held: dict[int, np.ndarray] = {}
        size = 0

        def shingles(node, z):
            nonlocal size
            if node not in held:
                raw = np.frombuffer(plain.decompress(z.as_buffer()), np.uint8)
                new = shingle_sets(raw, np.array([0, len(raw)]), words)[0]
                if size + new.nbytes > KEPT_SETS:
                    held.clear()
                    size = 0
                held[node] = new
                size += new.nbytes
            return held[node]

        for batch in batches:
            a, b, za, zb = (column(batch, c) for c in ("a", "b", "za", "zb"))
            alike = []
            for i, (m, n) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                x, y = shingles(m, za[i]), shingles(n, zb[i])
                most = min(len(x), len(y))
                common = len(np.intersect1d(x, y, assume_unique=True)) if most >= least * max(len(x), len(y)) else 0
                alike.append(common >= least * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([a, b], names=PAIR.names).filter(pa.array(alike, pa.bool_()))
            give_back()

    found = shelf.put(both.mapInArrow(run, PAIR))
    shelf.drop(first, texts)
    return found


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILAR, id_col: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """``keep`` columns (the id at least), ``set`` and ``component_id`` of each row.

    Links join all texts whose ``words``-word shingle sets have a Jaccard similarity of ``least`` or more. Texts with the same set are always together, so are all texts
    without a word (null and empty ones too). Rows without an id are as in ``near_groups``; ``set`` is the least
    set of a group without any id. A kept column with the name of a result column is replaced by the result.

    First every set is compared with the most central one in reach, then, of sets that share a key or a rare part and are
    not together by then, all that can be similar. All tables stay in Spark.
    """
    spark = docs.sparkSession
    made = ["code", "values", "set", "z", "rid", "component_id"]
    keep = [id_col, *[c for c in keep or [] if c != id_col]]
    # the kept columns travel in one struct, away from names of their own
    own = F.struct(*[F.col(c) for c in keep if c not in made or c == id_col]).alias("own")
    narrow = docs.select(own, F.col(id_col).alias("low"), F.col(text).cast("string").alias("text"))
    shelf = Shelf(spark)
    fields = [T.StructField("code", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.IntegerType())), T.StructField("set", T.LongType()), T.StructField("z", T.BinaryType())]

    def make(raw, at):
        small = zstandard.ZstdCompressor(level=3)
        sets = shingle_sets(raw, at, words)
        codes, values = [np.zeros((0, CODE_WORDS), np.uint64)], [np.zeros((0, KEYS), np.int64)]
        for a in range(0, len(sets), SUM_ROWS):
            sums = np.array([set_sums(x) for x in sets[a : a + SUM_ROWS]])
            codes.append(np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64))
            values.append(strong_keys(sums))
        names = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
        z = [small.compress(raw[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        rows = [_lists(np.concatenate(codes).view(np.int64)), _lists(np.concatenate(values).astype(np.int32))]
        return [*rows, pa.array(names.view(np.int64)), pa.array(z, pa.binary())]

    try:
        rows = shelf.put(annotate(narrow, T.StructType(fields), make, "text", ["own", "low"]).withColumn("rid", F.monotonically_increasing_id()))
        first = F.min_by(F.struct("code", "values"), "rid").alias("m")
        nodes = shelf.put(rows.groupBy("set").agg(F.min("low").alias("low"), first).select("set", "low", "m.*"))
        nodes = nodes.withColumn("check", F.col("code")[CODE_WORDS - 1])
        edges = _confirmed(shelf, shelf.put(_near(_leaders(nodes.withColumn("label", F.col("set")), 0), nodes)), rows, words, least)
        merged = connected_components(edges)
        named = nodes.join(merged, F.col("set") == F.col("node"), "left").select("set", "values", "check", F.coalesce("label", "set").alias("label"))
        named = shelf.put(named)
        parts = _rare_parts(shelf, named.select("set", "label"), rows, words, least)
        more = _balls(shelf, named, 0, lambda apart: _rare_meetings(shelf, shelf.put(apart.union(parts).distinct()), rows, words, least))
        more = _confirmed(shelf, shelf.put(more), rows, words, least)
        labels = connected_components(edges.unionByName(more))
        grouped = nodes.join(labels, F.col("set") == F.col("node"), "left").select("set", "low", F.coalesce("label", "set").alias("label"))
        lowest = grouped.groupBy("label").agg(F.min("low").alias("component_id"))
        named = grouped.join(lowest, "label").select("set", "component_id", "label")
        return settle(rows.join(named, "set").select("own.*", F.col("label").alias("set"), "component_id"))
    finally:
        shelf.clear()


def keep_one(docs: DataFrame, bits: int = 3, words: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Ties (a repeated id) go to the smallest text hash, and one of rows equal in both stays. Rows without
    an id are kept only where their group has no id at all.
    """
    narrow = docs.select(F.col(id_col), F.col(text), F.xxhash64(text).alias("__digest"))
    groups = near_groups(narrow, bits, words, id_col=id_col, text=text, keep=[id_col, "__digest"])
    return _smallest(docs, groups, "simhash", id_col, text)


def keep_one_similar(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILAR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each of ``similar_groups``, chosen as in ``keep_one``."""
    narrow = docs.select(F.col(id_col), F.col(text), F.xxhash64(text).alias("__digest"))
    groups = similar_groups(narrow, words, least, id_col, text, [id_col, "__digest"])
    return _smallest(docs, groups, "set", id_col, text)


def _smallest(docs: DataFrame, groups: DataFrame, own: str, id_col: str, text: str) -> DataFrame:
    digest = F.xxhash64(text)
    # groups without any id have a null component: each value of ``own`` stands for itself
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col(own)))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col), F.col("__digest"))
    rows_of = groups.groupBy(group.alias("g"), key.alias("k")).agg(F.count("*").alias("n"))
    kept = rows_of.groupBy("g").agg(F.min(F.struct("k", "n")).alias("m"))
    kept = kept.select(
        F.col(f"m.k.{id_col}").alias("__id"), F.col("m.k.__digest").alias("__kept"), F.col("m.n").alias("__n")
    )
    kept = settle(kept)
    same = (F.col("__digest") == F.col("__kept")) & F.col(id_col).eqNullSafe(F.col("__id"))
    # hashed, not sorted: only the narrow side is held, texts pass by
    joined = docs.withColumn("__digest", digest).join(kept.hint("shuffle_hash"), same)
    repeated = joined.where("__n > 1").dropDuplicates(["__digest", "__id"])
    return joined.where("__n = 1").unionByName(repeated).select(*docs.columns)
