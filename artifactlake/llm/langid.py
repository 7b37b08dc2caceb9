"""Language identification by unigram piece models, marginalised over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary of byte pieces. A word's
probability is the sum over all ways to cut it into pieces, from a forward pass over its bytes; a text is
the product over its words (a word carries its leading space). Single bytes are pieces, so every text
has a probability. The piece probabilities are fitted by expectation maximisation on the word counts of
a bounded sample of texts with a known language. Sums are kept as logarithms: pieces and words may have
any length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import BYTE_CODES, Spans, annotate, column

#: words that go through the lattice together, and pieces' places looked up at once
GROUP, PLACES = 4096, 1 << 17
#: bits of a hash below those that are tried first
LEAD = np.uint64(44)
#: distinct words whose scores a task remembers
MEMORY = 400_000


@dataclass
class PieceModel:
    """Sorted piece hashes, the lengths that pieces have, and the probability of each piece in each language."""

    langs: list[str]
    keys: np.ndarray
    sizes: np.ndarray
    prob: np.ndarray

    @cached_property
    def leading(self) -> np.ndarray:
        """Which leading bits some piece has."""
        out = np.zeros(1 << (64 - int(LEAD)), bool)
        out[self.keys >> LEAD] = True
        return out


def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all pieces of a rank file (base64 piece and rank per line), and their distinct lengths."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    pieces = sorted({*pieces, *[bytes([b]) for b in range(256)]})
    at = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    codes = BYTE_CODES[np.frombuffer(b"".join(pieces), np.uint8)]
    return np.unique(Spans(codes).of(at[:-1], at[1:])), np.unique(np.diff(at))


def _by_length(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Spans]:
    """Order (longest first), byte offsets and lengths in that order, and the hasher of all bytes."""
    order = np.argsort([-len(w) for w in words], kind="stable")
    spaced = [b" " + words[i] for i in order.tolist()]
    length = np.array([len(w) for w in spaced], np.int64)
    codes = BYTE_CODES[np.frombuffer(b"".join(spaced), np.uint8)]
    return order, np.cumsum(length) - length, length, Spans(codes)


def _groups(words: list[bytes], places: int) -> Iterator[list[int]]:
    """Words of like length together, as many as ``places`` bytes hold, at most ``GROUP`` and at least one."""
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    a = 0
    while a < len(order):
        n = min(GROUP, max(1, places // (len(words[order[a]]) + 2)))
        yield order[a : a + n]
        a += n


def _lattice(model: PieceModel, spans: Spans, offset: np.ndarray, length: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, word, size, piece) of all pieces that end ``first`` to ``last`` bytes into a word, by end and word.

    Words are sorted longest first.
    """
    live = int(np.searchsorted(-length, -first, side="right"))
    each = np.minimum(length[:live], last) - first + 1
    word = np.repeat(np.arange(live), each)
    end = first + np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each)
    found = []
    for size in model.sizes.tolist():
        if size > first:
            fits = end >= size
            word, end = word[fits], end[fits]
        if not len(end):
            break
        stop = offset[word] + end
        h = spans.of(stop - size, stop)
        # most stretches are no piece: leading bits tell, the rest is looked up
        maybe = np.flatnonzero(model.leading[h >> LEAD])
        at = np.minimum(np.searchsorted(model.keys, h[maybe]), len(model.keys) - 1)
        real = model.keys[at] == h[maybe]
        hit = maybe[real]
        found.append((end[hit], word[hit], np.full(len(hit), size), at[real]))
    ends, words, sizes, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((words, ends))
    return ends[order], words[order], sizes[order], pieces[order]


def _blocks(length: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ends whose places in all words stay near ``PLACES``."""
    step = max(1, PLACES // len(length))
    return [(a, min(a + step - 1, int(length[0]))) for a in range(1, int(length[0]) + 1, step)]


def _log_sums(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Logarithm of the summed exponentials of the stretches of rows that start at ``heads``."""
    top = np.maximum.reduceat(x, heads)
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(heads, len(x))), axis=0)), heads))


def word_scores(words: list[bytes], model: PieceModel) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations."""
    k = len(model.langs)
    out = np.zeros((len(words), k))
    logs = np.log(model.prob)
    for group in _groups(words, PLACES):
        order, offset, length, spans = _by_length([words[i] for i in group])
        group = np.array(group)[order]
        n = len(group)
        # log probabilities of the last places: as many as the longest piece has bytes
        slots = int(min(model.sizes[-1], length[0])) + 1
        ring = np.zeros((slots, n, k))
        for first, last in _blocks(length):
            end, word, size, piece = _lattice(model, spans, offset, length, first, last)
            new = np.flatnonzero(np.append(True, (end[1:] != end[:-1]) | (word[1:] != word[:-1])))
            edges = np.searchsorted(end, np.arange(first, last + 2))
            heads = np.searchsorted(new, edges)
            for j in range(first, last + 1):
                a, b = edges[j - first], edges[j - first + 1]
                x = ring[(j - size[a:b]) % slots, word[a:b]] + logs[piece[a:b]]
                ring[j % slots, : heads[j - first + 1] - heads[j - first]] = _log_sums(x, new[heads[j - first] : heads[j - first + 1]] - a)
                done = slice(int(np.searchsorted(-length, -j, side="left")), int(np.searchsorted(-length, -j, side="right")))
                out[group[done]] = ring[j % slots, done]
    return out


def expected_counts(words: list[bytes], lang: np.ndarray, times: np.ndarray, model: PieceModel) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations of the words."""
    total = np.zeros(model.prob.shape)
    logs = np.log(model.prob)
    for group in _groups(words, PLACES):
        order, offset, length, spans = _by_length([words[i] for i in group])
        group = np.array(group)[order]
        own, n, top = lang[group], len(group), int(length[0])
        ahead = np.full((top + 1, n), -np.inf)
        ahead[0] = 0.0
        behind = np.full((top + 1, n), -np.inf)
        behind[length, np.arange(n)] = 0.0
        blocks = _blocks(length)
        for first, last in blocks:
            end, word, size, piece = _lattice(model, spans, offset, length, first, last)
            new = np.flatnonzero(np.append(True, (end[1:] != end[:-1]) | (word[1:] != word[:-1])))
            edges = np.searchsorted(end, np.arange(first, last + 2))
            heads = np.searchsorted(new, edges)
            for j in range(first, last + 1):
                a, b = edges[j - first], edges[j - first + 1]
                x = ahead[j - size[a:b], word[a:b]] + logs[piece[a:b], own[word[a:b]]]
                ahead[j, : heads[j - first + 1] - heads[j - first]] = _log_sums(x, new[heads[j - first] : heads[j - first + 1]] - a)
        whole = ahead[length, np.arange(n)]
        for first, last in reversed(blocks):
            # the last block's lattice is still at hand
            if last < blocks[-1][1]:
                end, word, size, piece = _lattice(model, spans, offset, length, first, last)
            edges = np.searchsorted(end, np.arange(first, last + 2))
            p = logs[piece, own[word]]
            for j in range(last, first - 1, -1):
                part = slice(edges[j - first], edges[j - first + 1])
                # a word has one piece of each size at each end: no place twice
                place = (j - size[part], word[part])
                behind[place] = np.logaddexp(behind[place], p[part] + behind[j, word[part]])
            uses = np.exp(ahead[end - size, word] + p + behind[end, word] - whole[word])
            np.add.at(total, (piece, own[word]), times[group][word] * uses)
    return total


def train(docs: DataFrame, path: str, lang: str = "lang", text: str = "text", id_col: str = "doc_id", per_language: int = 2000, rounds: int = 3, smooth: float = 0.05) -> PieceModel:
    """Fit the piece probabilities of every non-null language of ``docs``.

    About ``per_language`` texts of each language are used, drawn by a hash of the id (all, where there are
    fewer): that bound is what keeps training at one cost for every table size. Word counts and expected
    piece counts are Spark aggregations; one number per piece and language (the vocabulary's size) comes
    back to the driver in each round.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs = sorted(counts)
    keys, lengths = vocabulary(path)
    prob = np.full((len(keys), len(langs)), 1.0 / len(keys))
    model = PieceModel(langs, keys, lengths, prob)
    if not langs:
        return model
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)) < share[F.col(lang)] * float(1 << 30)
    number = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])
    sample = known.where(drawn).select(number[F.col(lang)].alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.ascii_split_whitespace(column(batch, "text"))
            table = pa.table({"word": parts.flatten(), "lang": column(batch, "lang").take(pc.list_parent_indices(parts))})
            table = table.group_by(["lang", "word"]).aggregate([([], "count_all")]).select(["lang", "word", "count_all"])
            yield from table.rename_columns(["lang", "word", "n"]).to_batches()

    words = sample.mapInArrow(count, "lang int, word string, n long").where("word <> ''")
    words = settle(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        held = sc.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = held.value
            total = np.zeros(m.prob.shape)
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    total += expected_counts(
                        [w.encode() for w in column(part, "word").to_pylist()],
                        column(part, "lang").to_numpy(), column(part, "n").to_numpy().astype(float), m,
                    )
            piece, which = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(which, pa.int32()), pa.array(total[piece, which])],
                names=["piece", "lang", "n"],
            )

        uses = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        got = uses.toArrow()
        total = np.full(prob.shape, smooth)
        np.add.at(total, (got["piece"].to_numpy(), got["lang"].to_numpy()), got["n"].to_numpy())
        model = PieceModel(langs, keys, lengths, total / total.sum(axis=0))
        held.unpersist()
    return model


def identify(docs: DataFrame, model: PieceModel, text: str = "text", keep=None, names=("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and a score under ``names`` (the posterior of the predicted language, all equally likely before).

    ``und`` with score 0 for null and blank texts, texts without a letter, and where no language was
    learned. Ties go to the first language by code point. Whole texts are read.
    """
    fields = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123)]] = True
    memory: dict[bytes, int] = {}
    scores: list[np.ndarray] = []

    def make(raw, at):
        m = held.value
        n = len(at) - 1
        if not m.langs:
            return [pa.array(["und"] * n), np.zeros(n)]
        texts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.large_string())
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = [w.encode() for w in coded.dictionary.to_pylist()]
        if len(memory) > MEMORY:
            memory.clear()
            scores.clear()
        fresh = [w for w in words if w and w not in memory]
        if fresh:
            base = len(memory)
            memory.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            scores[:] = [np.concatenate([*scores, word_scores(fresh, m)])]
        table = scores[0] if scores else np.zeros((0, len(m.langs)))
        table = np.concatenate([table, np.zeros((1, len(m.langs)))])
        place = np.array([memory.get(w, -1) for w in words], np.int64)
        each = table[place[coded.indices.to_numpy()]] if len(words) else np.zeros((0, len(m.langs)))
        sums = np.concatenate([np.zeros((1, len(m.langs))), np.cumsum(each, axis=0)])
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        score = sums[ends[1:]] - sums[ends[:-1]]
        best = score.argmax(axis=1)
        post = 1.0 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        seen = np.concatenate(([0], np.cumsum(letters[raw])))
        lettered = seen[at[1:]] > seen[at[:-1]]
        for i in np.flatnonzero(~lettered & (at[1:] > at[:-1])).tolist():
            lettered[i] = any(map(str.isalpha, raw[at[i] : at[i + 1]].tobytes().decode()))
        named = pa.array([m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)])
        return [named, np.where(lettered, post, 0.0)]

    return annotate(docs, fields, make, text, keep)


def with_language(docs: DataFrame, model: PieceModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` in a known language: not ``und``, and with a score of at least ``least``.

    A model that learned no language can reject nothing: all rows stay.
    """
    if not model.langs:
        return docs
    named = identify(docs, model, text, names=("__lang", "__score"))
    return named.where((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*docs.columns)
