"""Small array helpers shared by the operators of this subpackage.

Texts arrive as Arrow batches. A batch is walked in chunks of whole documents of about ``CHUNK``
bytes, so the numpy arrays of a task stay small whatever the batch holds; a longer document is a chunk
of its own. Words are ``[^\\x20\\x09-\\x0D]+`` everywhere, found on the UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir, settle

CHUNK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)
BASE_2_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
ZERO = np.uint64(0)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(wide)
    if col.null_count:
        col = col.fill_null(b"" if wide == pa.large_binary() else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``size`` bytes."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: powers kept by a worker, per base; longer tables are made from them for the call
KEPT = 1 << 16


@lru_cache(maxsize=8)
def _powers(base: int) -> np.ndarray:
    out = np.full(KEPT + 1, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    low = _powers(int(base))
    if n <= KEPT:
        return low[:n]
    high = np.full(-(-n // KEPT), low[KEPT], np.uint64)
    high[0] = 1
    return (np.multiply.accumulate(high)[:, None] * low[None, :KEPT]).ravel()[:n]


#: a random 64-bit number for each byte value
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Spans:
    """Hashes of any stretch of a sequence of 64-bit codes, from prefix sums modulo 2**64.

    The sum of ``code[i] * base**i`` over a stretch, times ``base**-start``, does not depend on where
    the stretch lies. Codes are random 64-bit numbers, so two different stretches agree by chance only.
    """

    def __init__(self, codes: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = BASE_INV):
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(base, len(codes)), out=self.total[1:])
        self.back = powers(inverse, len(codes) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start] + np.uint64(0x632BE59BD9B4E019))

    def every(self, width: int) -> np.ndarray:
        """``of`` for all stretches of ``width`` codes."""
        out = self.total[width:] - self.total[:-width]
        out *= self.back[: len(out)]
        out += np.uint64(0x632BE59BD9B4E019)
        return mix(out)


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the rows."""
    n = len(raw)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    inside = solid[1:-1]
    begins = inside & ~solid[:-2]
    stops = inside & ~solid[2:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begins[cut] = inside[cut]
    stops[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at)


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return Spans(BYTE_CODES[raw]).of(starts, ends)


def spare(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no column in ``taken`` has it; case does not count."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each item, from the rows' item offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Return freed memory to the system, where its C library can.

    Workers wait for their next task with all pages that they ever used, beside an executor of a fixed size.
    """
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


PACKED = T.StructType([T.StructField("rid", T.LongType()), T.StructField("z", T.BinaryType())])


def pack_texts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, a row number ``rid`` and the compressed text ``z``, written to the shared folder.

    Operators that read the texts more than once need the same row numbers each time, also after an
    executor is lost; the written copy gives that and is smaller than the texts. Null stays null.
    """
    rows = docs.select(*keep, F.col(text).cast("string").alias("z"), F.monotonically_increasing_id().alias("rid"))
    schema = T.StructType([*[docs.schema[k] for k in keep], *PACKED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = column(batch, "z")
            z = pa.array([small.compress(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, k) for k in keep], column(batch, "rid"), z], names=[*keep, "rid", "z"]
            )

    return settle(rows.mapInArrow(run, schema))


def unpack(z: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of the packed texts, as ``chunks`` gives them."""
    plain = zstandard.ZstdDecompressor()
    first, parts, held = 0, [], 0
    for i, item in enumerate(z):
        part = plain.decompress(item.as_buffer()) if item.is_valid else b""
        parts.append(part)
        held += len(part)
        if held >= size:
            yield first, i + 1, *_joined(parts)
            first, parts, held = i + 1, [], 0
    if parts:
        yield first, first + len(parts), *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.frombuffer(b"".join(parts), np.uint8), at


def annotate(docs: DataFrame, fields: T.StructType, make, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add columns computed from the text in one pass; the other columns pass through untouched.

    ``make(bytes, offsets)`` gets a chunk of whole rows and returns one array per field. A column of
    ``docs`` with the name of a new field is replaced.
    """
    names = [f.name for f in fields]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    # a text that is kept anyway is sent once
    shared = text in keep and isinstance(docs.schema[text].dataType, T.StringType)
    where = keep.index(text) if shared else len(keep)
    source = docs.select(*keep) if shared else docs.select(*keep, F.col(text).cast("string").alias(spare(keep, "text")))
    schema = T.StructType([*[docs.schema[c] for c in keep], *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(where))
            parts = [make(r, o) for _, _, r, o in chunks(raw, at)]
            made = [pa.concat_arrays([pa.array(p[i]) if not isinstance(p[i], pa.Array) else p[i] for p in parts]) for i in range(len(names))] if parts else [pa.array([], pa.null())] * len(names)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *names])
            del batch, raw, parts, made
            give_back()

    return source.mapInArrow(run, schema)


def small_batches(spark, size: int = 8 << 20) -> None:
    """Let the session's Arrow batches hold at most ``size`` bytes, so a batch of whole texts stays small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(str(spark.conf.get(name)).rstrip("bB"))
    if held <= 0 or held > size:
        spark.conf.set(name, f"{size}b")


def release(spark) -> None:
    """Let the driver forget finished DataFrames now, so that their shuffle and checkpoint files go.

    Spark deletes these files when the driver's garbage collector meets the objects; a chain of large
    steps would otherwise keep all of them on disk at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Shelf:
    """Tables written to the shared folder for the length of one operator.

    Parquet keeps repeated keys and small numbers far smaller than a checkpoint does. ``drop`` deletes a
    table once no later step reads it.
    """

    def __init__(self, spark):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/shelf-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            drop_folder(self.spark, path)
        release(self.spark)

    def clear(self) -> None:
        self.drop(*[table for table, _ in self.paths.values()])
