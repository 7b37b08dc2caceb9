"""Document fingerprints by order MinHash.

A text is the multiset of its k-byte stretches, each with its occurrence number. Each of ``sketches`` random
orders picks the ``tuple_size`` least of them; these, in the order in which they stand in the text, are
hashed to one number. Two texts share a number only where they share stretches in the same order, so
the share of equal numbers follows the edit distance, not only the common vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODES, Spans, column, mix

GRAM, SKETCHES, TUPLE_SIZE = 12, 32, 2
#: stretches whose orders are computed at once
BLOCK = 1 << 14
_ODD = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_LARGEST = np.iinfo(np.uint64).max


def numbered_grams(text: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash for each k-byte stretch and its occurrence number, in text order (the whole of a shorter text)."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    at = np.arange(max(1, len(raw) - gram + 1))
    code = Spans(BYTE_CODES[raw]).of(at, np.minimum(at + gram, len(raw)))
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    new = np.ones(len(code), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    again = nth > 0
    if again.any():
        code[order[again]] = mix(ranked[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return code


def sketch(text: bytes, gram: int = GRAM, sketches: int = SKETCHES, tuple_size: int = TUPLE_SIZE) -> np.ndarray:
    """``sketches`` 32-bit numbers; all 0 for an empty text."""
    code = numbered_grams(text, gram)
    if not len(code):
        return np.zeros(sketches, np.uint32)
    take = min(tuple_size, len(code))
    odd = _ODD[:sketches, None]
    best = np.full((sketches, 0), 0, np.int64)
    rows = np.arange(sketches)[:, None]
    for a in range(0, len(code), BLOCK):
        ranks = code[None, a : a + BLOCK] * odd
        picks = []
        for _ in range(min(take, ranks.shape[1])):
            i = ranks.argmin(axis=1)
            picks.append(i[:, None] + a)
            ranks[rows[:, 0], i] = _LARGEST
        best = np.concatenate([best, *picks], axis=1)
        if best.shape[1] > take:
            least = np.argsort(code[best] * odd, axis=1, kind="stable")[:, :take]
            best = np.take_along_axis(best, least, axis=1)
    chosen = code[np.sort(best, axis=1)]
    out = np.arange(1, sketches + 1, dtype=np.uint64)
    for i in range(take):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(numbers: np.ndarray) -> str:
    return numbers.astype(">u4").tobytes().hex()


EDITED = [
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
]


def in_order(docs: DataFrame, id_col: str, text: str, buckets: int) -> DataFrame:
    """(bucket, guest, id, digest, text) with every row next to its successor in descending id order.

    Buckets are ranges of the id; each also holds the first row of the bucket after it, as a guest. Only
    the bucket borders and each bucket's first row (id and hash) come to the driver. Null ids are last,
    rows with one id go by the hash of their text.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("digest"))
    share = [i / buckets for i in range(1, buckets)]
    borders = sorted({int(b) for b in narrow.where("id IS NOT NULL").approxQuantile("id", share, 1 / (4 * buckets))}) if share else []
    above = F.array(*[F.lit(b).cast("long") for b in borders]) if borders else F.array().cast("array<long>")
    bucket = F.when(F.col("id").isNull(), F.lit(len(borders) + 1)).otherwise(F.size(F.filter(above, lambda b: b > F.col("id"))))
    top = F.struct(F.col("id").isNotNull().alias("some"), F.col("id").alias("id"), F.col("digest").alias("digest"))
    heads = narrow.groupBy(bucket.alias("bucket")).agg(F.max(top).alias("t")).orderBy("bucket").collect()
    pairs = [(heads[i - 1]["bucket"], r["t"]["id"], r["t"]["digest"]) for i, r in enumerate(heads)]
    guests = F.broadcast(docs.sparkSession.createDataFrame(pairs, "host int, h_id long, h_digest long"))
    rows = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("digest"), F.col(text).cast("string").alias("text"))
    met = rows.join(guests, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("digest") == F.col("h_digest")), "left")
    places = F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest")))
    spread = met.select("own", "id", "digest", "text", F.inline(F.filter(places, lambda p: p["bucket"].isNotNull())))
    return spread.repartition(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), F.col("digest").desc())


def fingerprints_with_edit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, sketches: int = SKETCHES, tuple_size: int = TUPLE_SIZE, buckets: int | None = None) -> DataFrame:
    """Fingerprint of each row, of its edited text, and the likeness to it and to the next row.

    The edited text replaces the last third (rounded down, in code points) by as many of the next row's
    first code points, in descending id order, the first row following the last; a single row follows
    itself. A null text is empty; empty texts are alike. Repeated rows stay.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs, id_col, text, buckets)
    schema = T.StructType([docs.schema[id_col], *EDITED])

    def pair(row, after):
        own, data, numbers = row
        plain, other = data.decode(), after[1].decode()
        cut = len(plain) // 3
        edited = (plain[: len(plain) - cut] + other[:cut]).encode()
        changed = sketch(edited, gram, sketches, tuple_size)
        return (
            own, len(plain), hashlib.sha256(edited).hexdigest(), shown(numbers), shown(changed),
            likeness(numbers, changed), likeness(numbers, after[2]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, None
        for batch in batches:
            out = []
            own, buckets_, guest = column(batch, "own"), column(batch, "bucket").to_pylist(), column(batch, "guest").to_pylist()
            for i, value in enumerate(column(batch, "text")):
                if guest[i] and (held is None or place != buckets_[i]):
                    continue
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                row = (own[i].as_py(), data, sketch(data, gram, sketches, tuple_size))
                if held is not None:
                    out.append(pair(held, row))
                held, place = (None, None) if guest[i] else (row, buckets_[i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=[f.name for f in schema])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema]
    return rows.mapInArrow(run, schema)
