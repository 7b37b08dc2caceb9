"""BPE encoding and decoding through a table of distinct words.

Texts are split once, block by block: a block is a run of documents of some megabytes, held as the list of
its distinct words and, per document, positions in that list. The lists are dealt by the hash of the
word, so that all blocks' copies of a word meet in one part of the word table, where it is encoded once;
each block gets the ids of its words back in the order of its list, and the documents' ids follow from
their positions. Decoding joins the ids of a block's words with the id-to-piece table, which is as large
as the vocabulary and therefore broadcast.

White space separates words in the tokenizer as well, so a word's ids do not depend on its neighbours.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, give_back, mix, text_bytes, word_codes

#: text of a block, text for each part of the word table, words encoded at once
BLOCK_BYTES, PART_BYTES, TOGETHER = 16 << 20, 8 << 20, 4_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def id_pieces(path: str) -> list[bytes]:
    """The piece of each id of a tokenizer file: its vocabulary and added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [pieces.get(i, "").encode() for i in range(max(pieces) + 1)]


def split_blocks(docs: DataFrame, keep: list[str], parts: int, lists: bool, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Either the ``words`` of each block for each ``part`` (``lists``), or each document's positions ``at``.

    A block's list is in order of the parts. Words hold no white space, so a newline separates them.
    Texts are split once for each kind: splitting is cheaper than writing the positions twice. ``check``
    is a hash of the block's list, by which the reader sees that both kinds come from the same rows.
    """
    source = docs.select(*keep, F.col(text).cast("string").alias("__text"), F.spark_partition_id().alias("__part"))
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("check", T.LongType()),
            *([T.StructField("part", T.IntegerType()), T.StructField("words", T.BinaryType())] if lists else [T.StructField("at", T.BinaryType())]),
            *([] if lists else [T.StructField(f"k{i}", docs.schema[k].dataType) for i, k in enumerate(keep)]),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        serial = 0
        for batch in batches:
            texts = column(batch, "__text")
            held, first, spans = 0, 0, []
            for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                held += n
                if held >= block_bytes:
                    spans.append((first, i + 1))
                    first, held = i + 1, 0
            if first < batch.num_rows:
                spans.append((first, batch.num_rows))
            for a, b in spans:
                block = (column(batch, "__part")[0].as_py() << 31) + serial
                serial += 1
                split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(a, b - a), ""))
                coded = split.flatten().dictionary_encode()
                ends = split.offsets.to_numpy() - split.offsets[0].as_py()
                listed = coded.dictionary
                raw, edges = text_bytes(listed)
                codes = word_codes(raw, edges[:-1], edges[1:])
                part = (codes % np.uint64(parts)).astype(np.int64)
                # splitting leaves empty strings at the edges: no word, no part
                part[np.diff(edges) == 0] = parts
                order = np.argsort(part, kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                total = int(mix(codes[order] + np.arange(len(order), dtype=np.uint64)).sum().view(np.int64)) if len(order) else 0
                if lists:
                    sorted_words = listed.take(pa.array(order))
                    cuts = np.searchsorted(part[order], np.arange(parts + 1))
                    used = np.flatnonzero(np.diff(cuts)).tolist()
                    made = ["\n".join(sorted_words.slice(cuts[p], cuts[p + 1] - cuts[p]).to_pylist()).encode() for p in used]
                    n, rest = len(used), [pa.array(used, pa.int32()), pa.array(made, pa.binary())]
                else:
                    at = rank[coded.indices.to_numpy()]
                    solid = part[order[at]] < parts
                    made = [small.compress(at[s:e][solid[s:e]].tobytes()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                    n, rest = b - a, [pa.array(made, pa.binary()), *[column(batch, k).slice(a, b - a) for k in keep]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([total] * n, pa.int64()), *rest], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def encode_lists(lists: DataFrame, path: str) -> DataFrame:
    """(of, checked, part, sizes, ids): the ids of each block's words of a part; a word is encoded once per part.

    A part is the share of the word table that a hash of the word gives it; all blocks meet there.
    """

    def run(rows: pa.Table) -> pa.Table:
        give_back()
        words = [x.decode().split("\n") for x in rows["words"].to_pylist()]
        place: dict[str, int] = {}
        for listed in words:
            for w in listed:
                place.setdefault(w, len(place))
        distinct, t, coded = list(place), tokenizer(path), []
        for a in range(0, len(distinct), TOGETHER):
            coded += [np.array(c.ids, np.uint32) for c in t.encode_batch(distinct[a : a + TOGETHER], add_special_tokens=False)]
        size = np.array([len(c) for c in coded], np.uint32)
        small = zstandard.ZstdCompressor(level=3)
        sizes, ids = [], []
        for listed in words:
            at = [place[w] for w in listed]
            sizes.append(small.compress(size[at].tobytes()))
            ids.append(small.compress(np.concatenate([coded[i] for i in at]).tobytes()))
        return pa.table({"of": rows["block"], "checked": rows["check"], "part": rows["part"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return lists.groupBy("part").applyInArrow(run, "of long, checked long, part int, sizes binary, ids binary")


ENCODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", digests: bool = False) -> DataFrame:
    """``keep`` columns, the number of tokens, and ids and decoded text of each row.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` is UTF-8 (pieces joined by a space, as
    the tokenizer without a decoder does); with ``digests`` their SHA-256 in hex instead. A null or
    blank text has no tokens and decodes to the empty text. Repeated rows stay. The texts are read twice
    and must come in the same order both times, as from files; otherwise the job fails.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = int(max(1, size // PART_BYTES))
    back = encode_lists(split_blocks(docs, keep, parts, True, text), path)
    rows = split_blocks(docs, keep, parts, False, text)
    pieces = spark.sparkContext.broadcast(id_pieces(path))
    kind = DIGESTS if digests else ENCODED
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*[T.StructField(k, docs.schema[k].dataType) for k in keep], *kind.fields])
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        plain = zstandard.ZstdDecompressor()
        order = np.argsort(right["part"].to_numpy()).tolist() if right.num_rows else []

        def unpacked(name):
            held = right[name].to_pylist() if order else []
            return np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(plain.decompress(held[i]), np.uint32) for i in order]])

        if order and left.num_rows and set(right["checked"].to_pylist()) != set(left["check"].to_pylist()):
            raise RuntimeError("the documents came in another order when read again; write them to a table first")
        flat, n_of = unpacked("ids"), unpacked("sizes").astype(np.int64)
        stop = np.cumsum(n_of)
        begin = stop - n_of
        # the join of ids with pieces, once per distinct word of the block
        spelled = list(map(pieces.value.__getitem__, flat.tolist()))
        piece_of = [b" ".join(spelled[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        made = []
        for z in left["at"]:
            at = np.frombuffer(plain.decompress(z.as_buffer()), np.uint32)
            n = n_of[at]
            total = int(n.sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            ids = flat[np.repeat(begin[at], n) + step].tobytes() if total else b""
            # a word without tokens leaves no piece
            decoded = b" ".join([p for p in map(piece_of.__getitem__, at.tolist()) if p])
            if digests:
                made.append((total, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            else:
                made.append((total, ids, decoded))
        kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.int64(), pa.binary(), pa.binary())
        cols = [pa.array([m[i] for m in made], kinds[i]) for i in range(3)]
        given = [left[k] for k in names] if left.num_rows else [pa.array([], _arrow(f)) for f in schema.fields[: len(names)]]
        return pa.Table.from_arrays([*given, *cols], names=[f.name for f in schema])

    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, schema)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
