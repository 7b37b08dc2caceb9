"""Windows of fixed length that occur again: sparse anchors, and exact counts where anchors differ.

A window of ``width`` units (words or bytes) picks its least ``gram``-unit stretch as anchor, so equal
windows pick the same anchor at the same place. Consecutive windows with one anchor form a run; the
units a run covers are its piece. Only one row per run leaves the task that reads the text (one for
``(width - gram) / 2`` windows). Anchors met once end there. Where all runs of an anchor have the same
piece, all their windows recur. Only in groups with different pieces (edges of copies, edits) the
windows are counted one by one, by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import BYTE_CODES, Shelf, Spans, chunks, column, mix, signed, text_bytes, word_bounds, word_codes

#: windows handled at once; longer documents are walked in overlapping stretches
STRETCH = 1 << 21
#: bytes of text whose windows are looked at together; their arrays stay near the processor
NEAR = 1 << 18
_LOW = np.uint64((1 << 24) - 1)


def stretches(offsets: np.ndarray, width: int, limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Unit ranges to handle at once: all rows together, or overlapping parts of one long row."""
    n = int(offsets[-1])
    if n <= limit:
        if n:
            yield 0, n
        return
    for a in range(0, n, limit):
        yield a, min(n, a + limit + width - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive numbers (of spans that double in length)."""
    if len(x) < w:
        return x[:0]
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - w + size], x[w - size :])


def runs(codes: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor.

    ``row`` and ``start`` (unit of the row where the first window starts), ``n`` windows, ``lead`` (units
    from ``start`` to the anchor), ``anchor`` and ``piece`` hashes.
    """
    found = [_runs(codes[a:b], offsets, a, width, gram) for a, b in stretches(offsets, width)]
    names = ("row", "start", "n", "lead", "anchor", "piece")
    empty = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return {
        name: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
        for i, (name, kind) in enumerate(zip(names, empty, strict=True))
    }


def _runs(codes, offsets, base, width, gram):
    if len(codes) < width:
        return (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2)
    spans = Spans(codes)
    grams = spans.every(gram)
    least = grams & ~_LOW
    least |= np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(least, width - gram + 1) & _LOW
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[offsets[(offsets >= base) & (offsets < base + len(new))] - base] = True
    starts = np.flatnonzero(new)
    row = np.searchsorted(offsets, starts + base, side="right") - 1
    # the last window of the row; those after it reach into the next
    last = offsets[row + 1] - width - base
    whole = starts <= last
    starts, row, last = starts[whole], row[whole], last[whole]
    # a run ends before the next run's start or at the first window that leaves its row
    count = np.minimum(np.append(starts[1:], len(least)), last + 1) - starts
    anchors = least[starts].astype(np.int64)
    piece = spans.of(starts, starts + count - 1 + width)
    piece = mix(piece + (anchors - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + count.astype(np.uint64))
    return row, starts + base - offsets[row], count, anchors - starts, grams[anchors], piece


@dataclass(frozen=True)
class Unit:
    """What windows are made of: ``codes(bytes, offsets)`` gives one code per unit and the rows' offsets."""

    codes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    width: int
    gram: int


def byte_units(raw, at):
    return BYTE_CODES[raw], at


def word_units(raw, at):
    starts, ends, words = word_bounds(raw, at)
    return word_codes(raw, starts, ends), words


#: windows of one cell: neighbours on the same side of an anchor that are first tested together
CELL = 16
KEY = ("k1", "k2")


def keyed(docs: DataFrame, id_col: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(k1, k2, own, text): ``own`` holds the columns to ``keep`` (the id alone by default). The key is a 128-bit hash of id and text, so it is the same on every read.

    Rows equal in both share a key; they are counted as often as they come, and end up alike.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000"))
    return docs.select(
        F.xxhash64(name).alias("k1"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k2"),
        F.struct(*(keep or [id_col])).alias("own"), F.col(text).cast("string").alias("text"),
    )


def shard_of(shards: int) -> Column:
    """Shard of a keyed row, by id and text: copies of one text are spread."""
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(shards))


RUN = T.StructType(
    [
        T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
        T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("lead", T.IntegerType()),
        T.StructField("anchor", T.LongType()), T.StructField("piece", T.LongType()),
    ]
)


def run_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """All runs of the keyed documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(column(batch, "text"))
            k1, k2 = column(batch, "k1").to_numpy(), column(batch, "k2").to_numpy()
            for a, _, r, o in chunks(raw, at, NEAR):
                got = runs(*unit.codes(r, o), unit.width, unit.gram)
                row = got["row"] + a
                cols = [pa.array(k1[row]), pa.array(k2[row]), *[pa.array(got[c].astype(np.int32)) for c in ("start", "n", "lead")], signed(got["anchor"]), signed(got["piece"])]
                yield pa.RecordBatch.from_arrays(cols, names=RUN.names)

    return docs.select("k1", "k2", "text").mapInArrow(make, RUN)


def with_texts(parts: DataFrame, docs: DataFrame, group: list[str], order: list[Column], shard: dict[str, Column] | None = None, n: int | None = None) -> DataFrame:
    """Rows of ``parts`` followed by the documents (compressed ``z``) of the same ``group``, in one place.

    A shuffle and a sort inside its partitions; the reader takes them as a stream.
    """
    extra = [f for f in parts.schema if f.name not in (*KEY, *group)]
    fields = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), docs.schema["own"], T.StructField("z", T.BinaryType())]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array([small.compress(t.as_buffer() if t.is_valid else b"") for t in column(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "k1"), column(batch, "k2"), column(batch, "own"), z], names=["k1", "k2", "own", "z"])

    packed = docs.select("k1", "k2", "own", "text").mapInArrow(squeeze, T.StructType(fields))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in extra]
    given = [c for c in group if c not in KEY]
    right = packed.withColumns(shard or {}).select(*KEY, *given, *missing, "own", "z")
    left = parts.withColumns(shard or {}).select(*KEY, *given, *[f.name for f in extra], F.lit(None).cast(docs.schema["own"].dataType).alias("own"), F.lit(None).cast("binary").alias("z"))
    both = left.unionByName(right)
    dealt = both.repartition(*[F.col(c) for c in group]) if n is None else both.repartition(n, *[F.col(c) for c in group])
    return dealt.sortWithinPartitions(*order)


def recurring_anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """Anchors that occur at least twice."""
    return run_rows(docs, unit).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")


CELL_ROW = T.StructType(
    [
        *[f for f in RUN.fields if f.name in ("k1", "k2", "start", "n", "anchor")],
        T.StructField("c", T.LongType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("core", T.LongType()),
        T.StructField("outer", T.LongType()),
        T.StructField("low", T.IntegerType()),
    ]
)
WINDOW_ROW = T.StructType(
    [
        *[f for f in RUN.fields if f.name in ("k1", "k2", "start", "anchor")],
        T.StructField("c", T.LongType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("h", T.LongType()),
    ]
)


def _per_document(parts: DataFrame, docs: DataFrame, unit: Unit, names: tuple[str, ...], out: T.StructType, make) -> DataFrame:
    """``make(hashes, marks...)`` for each document that ``parts`` names; its columns follow the key."""
    rows = with_texts(parts, docs, list(KEY), [F.col("k1"), F.col("k2"), F.col("z").isNotNull()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for row, data, marks in keyed_stream(batches, names, False):
            # a repeated document is asked once
            if row[:2] == last:
                continue
            last = row[:2]
            codes, _ = unit.codes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            cols = make(Spans(codes), *marks)
            keys = [pa.array(np.full(len(cols[0]), k, np.int64)) for k in last]
            yield pa.RecordBatch.from_arrays([*keys, *cols], names=out.names)

    return rows.mapInArrow(gathered(run), out)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _cells(parts: DataFrame, docs: DataFrame, unit: Unit) -> DataFrame:
    """The cells of open pieces: hashes of what all windows of a cell share, and of what they cover."""

    def make(spans, start, n, lead, anchor, c):
        # cell j holds the windows that start CELL * j .. CELL * j + CELL - 1 units before the anchor
        first, last = (lead - n + 1) // CELL, lead // CELL
        count = last - first + 1
        of = np.repeat(np.arange(len(start)), count)
        cell = np.repeat(first, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = (start + lead)[of]
        lo = np.maximum(start[of], at - (CELL * cell + CELL - 1))
        hi = np.minimum((start + n - 1)[of], at - CELL * cell)
        size = hi - lo + 1
        # common to all windows that the cell can hold, whichever of them this run has
        core = spans.of(at - CELL * cell, at - CELL * cell - (CELL - 1) + unit.width)
        outer = mix(spans.of(lo, hi + unit.width) + (at - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + size.astype(np.uint64))
        return [_ints(lo), _ints(size), pa.array(anchor[of]), pa.array(c[of]), _ints(cell), signed(core), signed(outer), _ints(at - lo)]

    return _per_document(parts, docs, unit, ("start", "n", "lead", "anchor", "c"), CELL_ROW, make)


def _single_windows(parts: DataFrame, docs: DataFrame, unit: Unit) -> DataFrame:
    """Each window of the given cells with its hash and its distance to the anchor."""

    def make(spans, start, n, low, anchor, c):
        of = np.repeat(np.arange(len(start)), n)
        i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at = start[of] + i
        return [_ints(at), pa.array(anchor[of]), pa.array(c[of]), _ints(low[of] - i), signed(spans.of(at, at + unit.width))]

    return _per_document(parts, docs, unit, ("start", "n", "low", "anchor", "c"), WINDOW_ROW, make)


def keyed_stream(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], unmarked: bool = True):
    """((k1, k2, own), text, marks) of each document of a ``with_texts`` stream sorted by key.

    ``marks`` holds an array per name, of the rows with the document's key. Documents without any come if ``unmarked``.
    """
    plain = zstandard.ZstdDecompressor()
    held: list[list[np.ndarray]] = []
    key = None
    for batch in batches:
        z = column(batch, "z")
        k1, k2 = column(batch, "k1").to_numpy(), column(batch, "k2").to_numpy()
        own = column(batch, "own")
        cols = [column(batch, c).fill_null(0).to_numpy() for c in names]
        is_doc = z.is_valid().to_numpy(zero_copy_only=False)
        change = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(k1)], strict=True):
            if a == b:
                continue
            if key != (k1[a], k2[a]):
                key, held = (k1[a], k2[a]), []
            first_doc = a + int(np.argmax(is_doc[a:b])) if is_doc[a:b].any() else b
            if first_doc > a:
                held.append([c[a:first_doc] for c in cols])
            if first_doc < b and (held or unmarked):
                marks = [np.concatenate([h[i] for h in held]) for i in range(len(names))] if held else [c[:0] for c in cols]
                for i in range(first_doc, b):
                    yield (k1[i], k2[i], own[i]), plain.decompress(z[i].as_buffer()), marks


def gathered(make, rows: int = 20_000):
    """Join the small record batches that ``make`` yields into larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for out in make(batches):
            held.append(out)
            n += out.num_rows
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    return run


def confirmed(docs: DataFrame, unit: Unit, recurring: DataFrame, shards: int | None = None) -> DataFrame:
    """(k1, k2, start, n): windows (``n`` from ``start`` on) whose units stand somewhere else as well.

    ``recurring`` holds the anchors that occur at least twice. With ``shards``, of equal pieces in one shard
    only one is named: whoever looks for the text itself finds the others.

    Tables of keys are written before they are joined: a join right above two shuffles is one that adaptive
    execution can split where a key is hot.
    """
    shelf = Shelf(docs.sparkSession)
    recurring = shelf.put(recurring)
    found = shelf.put(run_rows(docs, unit).join(recurring, "anchor"))
    shelf.drop(recurring)
    rep = F.min(F.struct("k1", "k2", "start", "n", "lead")).alias("rep")
    pieces = shelf.put(found.groupBy("anchor", "piece").agg(F.count("*").alias("c"), rep))
    twice = pieces.where("c > 1").select("anchor", "piece")
    named = found
    if shards is not None:
        named = found.groupBy(shard_of(shards).alias("shard"), "anchor", "piece").agg(rep).select("rep.*", "anchor", "piece")
    sure_runs = shelf.put(named.join(twice, ["anchor", "piece"]).select(*KEY, "start", "n"))
    shelf.drop(found)
    groups = pieces.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least"))
    mixed = shelf.put(groups.where("kinds > 1 AND least = 1").select("anchor"))
    cells = shelf.put(_cells(pieces.join(mixed, "anchor").select("rep.*", "anchor", "c"), docs, unit))
    shelf.drop(pieces)
    same = ["anchor", "cell", "core", "outer"]
    first = F.min(F.struct("k1", "k2", "start", "n", "low")).alias("rep")
    whole = shelf.put(cells.groupBy(*same).agg(F.sum("c").alias("c"), first))
    sure_cells = shelf.put(cells.where("c = 1").join(whole.where("c > 1").select(*same), same).select(*KEY, "start", "n"))
    shelf.drop(cells)
    # a shared core with different surroundings: some windows of the cell may recur, others not
    doubt = whole.groupBy("anchor", "cell", "core").agg(F.count("*").alias("kinds"), F.min("c").alias("least"))
    doubt = shelf.put(doubt.where("kinds > 1 AND least = 1").select("anchor", "cell", "core"))
    asked = whole.join(doubt, ["anchor", "cell", "core"]).select("rep.*", "anchor", "c")
    each = shelf.put(_single_windows(asked, docs, unit))
    shelf.drop(whole)
    again = each.groupBy("anchor", "offset", "h").agg(F.sum("c").alias("t"))
    again = shelf.put(again.where("t > 1").select("anchor", "offset", "h"))
    alone = each.where("c = 1").join(again, ["anchor", "offset", "h"]).select(*KEY, "start", F.lit(1).alias("n"))
    marks = settle(sure_runs.unionByName(sure_cells).unionByName(alone))
    shelf.clear()
    return marks
