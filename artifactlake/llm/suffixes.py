"""Removal of byte strings that stand somewhere else, with a logarithmic family of suffix indexes.

An index level is a sparse suffix array: the suffixes that start at anchors (see ``windows``), held as sorted
arrays of the codes of their first ``gram`` bytes, cut by mixed bits of the code into even shards. A batch of documents
gets its own array, which is merged (scanned side by side) with every existing level: a suffix met in
both, or twice in the batch, may start a long match. Then the batch joins the family, and levels of equal
rank merge into one of the next rank, so a family of n batches has log2(n) levels and each suffix is
rewritten log2(n) times. The long matches themselves are confirmed on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import chunks, column, mix, release, text_bytes
from .windows import KEY, NEAR, Unit, byte_units, confirmed, keyed, keyed_stream, runs, with_texts

WIDTH, GRAM = 200, 40
#: batches of a one-off run over a whole table; bytes of text per index shard
BATCHES, SHARD_BYTES = 4, 64 << 20
LEVEL = "shard int, suffixes binary, repeats binary"


def _codes(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint64)


def _row(shard: int, suffixes: np.ndarray, repeats: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "suffixes": pa.array([suffixes.tobytes()], pa.binary()), "repeats": pa.array([repeats.tobytes()], pa.binary())})


def suffix_array(docs: DataFrame, unit: Unit, shards: int) -> DataFrame:
    """One level from a batch of keyed documents: a row per shard, sorted ``suffixes`` and those met twice."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        for batch in batches:
            raw, at = text_bytes(column(batch, "text"))
            held += [runs(*unit.codes(r, o), unit.width, unit.gram)["anchor"] for _, _, r, o in chunks(raw, at, NEAR)]
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        shard = _shard(keys, shards)
        # stable: the codes of a shard stay sorted
        order = np.argsort(shard, kind="stable")
        keys, times = keys[order], times[order]
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[i], edges[i + 1])
            yield from _row(i, keys[part], keys[part][times[part] > 1]).to_batches()

    return docs.select("text").mapInArrow(split, LEVEL).groupBy("shard").applyInArrow(_joined, LEVEL)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each code, by its mixed bits: anchors are minima, so ranges of the code itself would be uneven."""
    return ((mix(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _joined(rows: pa.Table) -> pa.Table:
    keys, times = np.unique(np.concatenate([_codes(x) for x in rows["suffixes"].to_pylist()]), return_counts=True)
    repeats = np.unique(np.concatenate([keys[times > 1], *[_codes(x) for x in rows["repeats"].to_pylist()]]))
    return _row(rows["shard"][0].as_py(), keys, repeats)


def merge_levels(a: DataFrame, b: DataFrame) -> DataFrame:
    """One level of the suffixes of two."""
    return settle(a.unionByName(b).groupBy("shard").applyInArrow(_joined, LEVEL))


def merge_scan(new: DataFrame, level: DataFrame) -> DataFrame:
    """(shard, suffixes, repeats): suffixes that stand in both."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = (left["shard"] if left.num_rows else right["other"])[0].as_py()
        if not (left.num_rows and right.num_rows):
            return _row(shard, _codes(None), _codes(None))
        # one row a side: both arrays are sorted and without repeats
        met = np.intersect1d(_codes(left["suffixes"][0].as_py()), _codes(right["suffixes"][0].as_py()), assume_unique=True)
        return _row(shard, met, met[:0])

    other = level.select(F.col("shard").alias("other"), "suffixes", "repeats")
    return new.groupBy("shard").cogroup(other.groupBy("other")).applyInArrow(scan, LEVEL)


class SuffixFamily:
    """Levels of ranks that fall from first to last, like the digits of a binary number."""

    def __init__(self, unit: Unit, shards: int):
        self.unit, self.shards = unit, shards
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Insert a batch; returns (shard, suffixes) of what it repeats, in itself or in the family."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, b), (_, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, merge_levels(a, b)))
        new = settle(suffix_array(docs, self.unit, self.shards))
        met = new.select("shard", F.col("repeats").alias("suffixes"))
        for _, level in self.levels:
            met = met.unionByName(merge_scan(new, level).select("shard", "suffixes"))
        self.levels.append((0, new))
        return settle(met)


def recurring_suffixes(docs: DataFrame, unit: Unit, batches: int, shards: int) -> DataFrame:
    """(anchor) of all suffixes that occur at least twice, batch after batch."""
    family = SuffixFamily(unit, shards)
    met = None
    for b in range(batches):
        part = family.add(docs.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(batches)) == b))
        met = part if met is None else met.unionByName(part)
        release(docs.sparkSession)

    def spread(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for x in column(batch, "suffixes").to_pylist():
                keys = _codes(x)
                for a in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64))], names=["anchor"])

    return met.mapInArrow(spread, "anchor long").distinct()


OUT = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, digests: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each row: bytes covered by a repeated ``width``-byte string go.

    Strings are judged on the input, the same document included; all their places go. ``kept`` is binary
    (a cut may fall inside a character); with ``digests`` it is ``kept_sha256`` in hex. A null text is
    empty. Repeated rows stay, and repeat each other.
    """
    out = _cut(docs, id_col, text, [id_col], width, gram, batches, digests)
    return out.select(f"own.{id_col}", *[c for c in out.columns if c != "own"])


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the kept bytes as text; the rest of a character that a cut went through is dropped."""
    out = _cut(docs, id_col, text, [c for c in docs.columns if c != text], width, gram, batches, False, True)
    columns = [F.col("kept").alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns]
    return out.select(*columns)


def _cut(docs, id_col, text, keep, width, gram, batches, digests, as_text=False) -> DataFrame:
    unit = Unit(byte_units, width, gram)
    rows = keyed(docs, id_col, text, keep)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, size // SHARD_BYTES)
    marks = confirmed(rows, unit, recurring_suffixes(rows, unit, batches, shards))
    last = T.StructField("kept_sha256" if digests else "kept", T.StringType() if digests or as_text else T.BinaryType())
    last_type = pa.string() if digests or as_text else pa.binary()
    schema = T.StructType([rows.schema["own"], *OUT, last])
    stream = with_texts(marks, rows, list(KEY), [F.col("k1"), F.col("k2"), F.col("z").isNotNull()])
    own_type = _arrow_type(rows.schema["own"])

    kinds = [own_type, pa.int64(), pa.int64(), pa.int64(), last_type]

    def cut(stream_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for (_, _, own), data, (start, n) in keyed_stream(stream_batches, ("start", "n")):
            removed, spans, kept = 0, 0, data
            if len(start):
                raw = np.frombuffer(data, np.uint8)
                gone = covered(len(raw), start, n, width)
                removed = int(gone.sum())
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                kept = raw[~gone].tobytes()
            if digests:
                kept = hashlib.sha256(kept).hexdigest()
            elif as_text:
                kept = kept.decode(errors="ignore")
            made.append((own.as_py(), len(data), removed, spans, kept))
            if len(made) >= 200:
                yield _batch(made, kinds, schema.names)
                made = []
        if made:
            yield _batch(made, kinds, schema.names)

    return stream.mapInArrow(cut, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _arrow_type(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def covered(size: int, start: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which units windows cover, ``n`` windows from each ``start``."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + n - 1 + width, -1)
    return np.cumsum(step[:-1]) > 0
