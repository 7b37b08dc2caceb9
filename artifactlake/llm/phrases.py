"""Removal of word windows that stand somewhere else, by repeated-phrase automata.

Recurring passages are confirmed first (see ``windows``). Documents are dealt into shards of a few megabytes.
A shard gets one sighting of each passage that occurs in it, cuts it into tiles of half a window and
compiles the tiles into an Aho-Corasick automaton; then all documents of the shard are streamed through it. Any
window of a passage holds a whole tile, so every occurrence shows itself; it is grown to both sides,
word by word, and counts if it reaches a window. Shards are independent, so a passage that a third of all
documents share costs each shard one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, word_bounds, word_codes
from .suffixes import _arrow_type, covered
from .windows import Unit, confirmed, keyed, recurring_anchors, shard_of, with_texts, word_units

WIDTH, GRAM = 35, 10
#: text bytes of a shard, and letters of one automaton (a larger shard compiles several, one after another)
SHARD_BYTES, AUTOMATON_LETTERS = 8 << 20, 2_000_000
#: words of a shard that are held split; texts beyond them are split anew each time
HELD_WORDS = 2_000_000
#: rows and text bytes of one output batch
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def letters(codes: np.ndarray) -> str:
    """Two letters per word, from 16 bits of its code: few branches per node, and short tiles."""
    return (codes >> np.uint64(48)).astype(">u2").tobytes().decode("latin-1")


def compile_tiles(passages: list[np.ndarray], tile: int, limit: int = AUTOMATON_LETTERS):
    """Automata of the tiles of the passages; the value of a tile lists (passage, word) places."""
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = {}
    size = 0

    def made():
        automaton = ahocorasick.Automaton()
        for key, value in places.items():
            automaton.add_word(key, value)
        automaton.make_automaton()
        return automaton

    for p, codes in enumerate(passages):
        shown = letters(codes)
        for t in range(0, len(codes) - tile + 1, tile):
            key = shown[2 * t : 2 * (t + tile)]
            if key not in places:
                size += len(key)
            places.setdefault(key, []).append((p, t))
        if size >= limit:
            yield made()
            places, size = {}, 0
    if places:
        yield made()


def locate(codes: np.ndarray, shown: str, automaton, passages: list[np.ndarray], tile: int, width: int, gone: np.ndarray) -> None:
    """Mark in ``gone`` the words of every stretch of ``width`` or more words that is part of a passage."""
    n = len(codes)
    reach = width - tile
    tried: dict[tuple[int, int], int] = {}
    # the stretch marked last, with those that touch it
    low = high = 0
    for end, places in automaton.iter(shown):
        if end % 2 == 0:
            continue
        q = (end + 1) // 2 - tile
        for p, t in places:
            # all words of all windows around this tile are known already
            first, last = max(0, q - reach), min(n, q + width)
            if low <= first and last <= high or gone[first:last].all():
                break
            if tried.get((p, q - t), -1) >= q:
                continue
            passage = passages[p]
            back = min(q, t)
            same = codes[q - back : q][::-1] == passage[t - back : t][::-1]
            left = back if same.all() else int(np.argmin(same))
            ahead = min(n - q, len(passage) - t)
            same = codes[q : q + ahead] == passage[t : t + ahead]
            right = ahead if same.all() else int(np.argmin(same))
            tried[(p, q - t)] = q + right - tile
            if right >= tile and left + right >= width:
                gone[q - left : q + right] = True
                if q - left <= high and q + right >= low:
                    low, high = min(low, q - left), max(high, q + right)
                else:
                    low, high = q - left, q + right


OUT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, digests: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row: words covered by a repeated window of ``width`` words go.

    Windows are judged on the input, the same document included; all their places go. ``kept`` is the
    kept words joined by a space; with ``digests`` it is ``kept_sha256`` in hex. A null text has no
    words. Repeated rows stay, and repeat each other.
    """
    unit = Unit(word_units, width, gram)
    tile = (width + 1) // 2
    rows = keyed(docs, id_col, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, size // shard_bytes)
    marks = confirmed(rows, unit, recurring_anchors(rows, unit), int(shards))
    last = T.StructField("kept_sha256" if digests else "kept", T.StringType())
    schema = T.StructType([rows.schema["own"], *OUT, last])
    shard = {"shard": shard_of(int(shards))}
    order = [F.col("shard"), F.col("z").isNotNull(), F.col("k1"), F.col("k2")]
    stream = with_texts(marks, rows, ["shard"], order, shard, n=int(max(1, shards)))
    own_type = _arrow_type(rows.schema["own"])

    def clean(texts, marked):
        """Output rows of one shard; ``texts`` are (k1, k2, z, owners), ``marked`` maps a key to its sightings."""
        plain = zstandard.ZstdDecompressor()
        held: dict[int, tuple] = {}
        free = HELD_WORDS

        def words(i):
            nonlocal free
            if i in held:
                return held[i]
            found = _words(plain.decompress(texts[i][2]))
            if len(found[0]) <= free:
                free -= len(found[0])
                held[i] = found
            return found

        passages: list[np.ndarray] = []
        for i, (k1, k2, _, _) in enumerate(texts):
            if (k1, k2) in marked:
                codes = words(i)[0]
                start, n = (np.array(x) for x in marked[(k1, k2)])
                inside = covered(len(codes), start, n, 1)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
                passages += [codes[a : b - 1 + width] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        gone = [None] * len(texts)
        for automaton in compile_tiles(passages, tile):
            for i in range(len(texts)):
                codes = words(i)[0]
                if gone[i] is None:
                    gone[i] = np.zeros(len(codes), bool)
                locate(codes, letters(codes), automaton, passages, tile, width, gone[i])
        for i, (_, _, _, owners) in enumerate(texts):
            codes, data, starts, ends = words(i)
            held.pop(i, None)
            out = gone[i] if gone[i] is not None else np.zeros(len(codes), bool)
            keep = np.flatnonzero(~out)
            kept = b" ".join([data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
            value = hashlib.sha256(kept).hexdigest() if digests else kept.decode()
            for own in owners:
                yield own, len(codes), int(out.sum()), value

    def batch_of(made):
        kinds = [own_type, pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=schema.names)

    nothing = hashlib.sha256(b"").hexdigest() if digests else ""

    def cleaned(batches: Iterator[pa.RecordBatch]):
        place, texts, marked = None, [], {}
        for batch in batches:
            shards_of, z = column(batch, "shard").to_pylist(), column(batch, "z")
            k1, k2 = column(batch, "k1").to_pylist(), column(batch, "k2").to_pylist()
            start, n = column(batch, "start").to_pylist(), column(batch, "n").to_pylist()
            own, is_text = column(batch, "own"), z.is_valid().to_pylist()
            for i in range(batch.num_rows):
                if shards_of[i] != place:
                    yield from clean(texts, marked)
                    place, texts, marked = shards_of[i], [], {}
                key = (k1[i], k2[i])
                if not is_text[i]:
                    places = marked.setdefault(key, ([], []))
                    places[0].append(start[i])
                    places[1].append(n[i])
                elif zstandard.frame_content_size(z[i].as_buffer()) == 0:
                    # a null or empty text has no words to look at, and does not wait for its shard
                    yield own[i].as_py(), 0, 0, nothing
                elif texts and texts[-1][:2] == key:
                    texts[-1][3].append(own[i].as_py())
                else:
                    texts.append((*key, z[i].as_buffer().to_pybytes(), [own[i].as_py()]))
        yield from clean(texts, marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for row in cleaned(batches):
            made.append(row)
            size += len(row[3])
            if len(made) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch_of(made)
                made, size = [], 0
        if made:
            yield batch_of(made)

    out = stream.mapInArrow(run, schema)
    return out.select(f"own.{id_col}", *[c for c in out.columns if c != "own"])


def _words(data: bytes):
    raw = np.frombuffer(data, np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    codes = word_codes(raw, starts, ends)
    # places are kept beside their words: half as wide where they fit
    return (codes, data, starts, ends) if len(raw) >> 31 else (codes, data, starts.astype(np.int32), ends.astype(np.int32))
