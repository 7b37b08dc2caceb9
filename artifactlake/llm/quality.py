"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Score of a document with features x: bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2).
The square identity makes the pairwise part linear in the number of features. Features are the distinct
words, hashed (scaled to length one together), and the structure numbers and the declared length, each in
steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, column, row_of, text_bytes, word_bounds, word_codes
from .rules import measurements

BUCKETS, FACTORS, STEPS = 1 << 16, 8, 12
STATS = (
    "words", "word_length", "upper", "symbols", "digits", "marks", "repeated", "repeated_lines", "distinct",
    "line_length", "declared_length",
)
SIZE = BUCKETS + len(STATS) * STEPS


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def _class(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_UPPER, _LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_DIGIT, _MARK = _class(b"0123456789"), _class(b"!?.,;:'\"()-")


def features(raw: np.ndarray, at: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, feature numbers, values) of a chunk of texts and their declared lengths (null: 0)."""
    n = len(at) - 1

    def summed(kind):
        total = np.concatenate(([0], np.cumsum(kind[raw], dtype=np.int64)))
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    n_words, chars, symbols, lines, dup_lines, repeated = (x.astype(float) for x in measurements(raw, at))
    upper, lower, digits, marks = map(summed, (_UPPER, _LOWER, _DIGIT, _MARK))
    starts, ends, words = word_bounds(raw, at)
    bucket = (word_codes(raw, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    keys = np.unique(row_of(words) * BUCKETS + bucket)
    row, bucket = keys // BUCKETS, keys % BUCKETS
    distinct = np.bincount(row, minlength=n).astype(float)
    w, c, ln = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    unit = np.stack(
        [
            np.log1p(n_words) / 12, chars / w / 16, upper / np.maximum(upper + lower, 1), symbols / w / 2,
            digits / c, marks / c * 2, repeated / w, dup_lines / ln, distinct / w,
            np.log1p(n_words / ln) / 8, np.log1p(declared) / 16,
        ],
        axis=1,
    )
    step = np.minimum((unit * STEPS).astype(np.int64), STEPS - 1).clip(0)
    stat = BUCKETS + np.arange(len(STATS)) * STEPS + step
    numbers = np.concatenate([bucket, stat.ravel()])
    rows = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
    values = np.concatenate([1.0 / np.sqrt(np.maximum(distinct[row], 1)), np.ones(stat.size)])
    order = np.argsort(rows, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return offsets, numbers[order], values[order]


def margins(m: Machine, offsets: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Scores before the logistic function; linear in the number of features."""
    if len(offsets) == 1:
        return np.zeros(0)
    at = offsets[:-1]
    vx = m.factor[number] * value[:, None]
    pair = np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx * vx, at)
    return m.bias + np.add.reduceat(m.weight[number] * value, at) + 0.5 * pair.sum(axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, batch: int = 32, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adaptive gradient steps on the logistic loss; ``rows`` holds (numbers, values, 0 or 1)."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, FACTORS)))
    sq_b, sq_w, sq_v = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            part = [rows[i] for i in order[a : a + batch]]
            offsets = np.concatenate(([0], np.cumsum([len(p[0]) for p in part])))
            number, value = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            y = np.array([p[2] for p in part], float)
            g = (logistic(margins(m, offsets, number, value)) - y) / len(part)
            each = np.repeat(g, np.diff(offsets)) * value
            vx = m.factor[number] * value[:, None]
            total = np.repeat(np.add.reduceat(vx, offsets[:-1]), np.diff(offsets), axis=0)
            used, where = np.unique(number, return_inverse=True)
            grad_w = np.bincount(where, each, len(used)) + decay * m.weight[used]
            grad_v = np.zeros((len(used), FACTORS))
            np.add.at(grad_v, where, each[:, None] * (total - vx))
            grad_v += decay * m.factor[used]
            sq_b += g.sum() ** 2
            sq_w[used] += grad_w**2
            sq_v[used] += grad_v**2
            m.bias -= rate * g.sum() / np.sqrt(sq_b)
            m.weight[used] -= rate * grad_w / np.sqrt(sq_w[used])
            m.factor[used] -= rate * grad_v / np.sqrt(sq_v[used])
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", declared: str = "n_chars", per_class: int = 3000) -> Machine:
    """Fit on about ``per_class`` labelled documents of each class, drawn by a hash of the id.

    The bound is what allows the sample to be broadcast to the documents and the fit to run in one place:
    its cost is the same for every table size. Null labels and ids without a document are left out; with
    no labelled document every score is 1/2.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y"))
    counts = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    if not counts:
        return Machine(0.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_class / n)))])
    drawn = F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 30)) < share[F.col("__y")] * float(1 << 30)
    sample = F.broadcast(known.where(drawn))
    joined = docs.select(F.col(id_col).alias("__doc"), F.col(text).alias("__text"), _declared(docs, declared)).join(
        sample, F.col("__doc") == F.col("__id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(column(batch, "__text"))
            given = column(batch, "__declared").to_numpy(zero_copy_only=False)
            out = []
            for a, b, r, o in chunks(raw, at):
                offsets, number, value = features(r, o, given[a:b])
                for i in range(b - a):
                    s = slice(offsets[i], offsets[i + 1])
                    out.append((number[s].astype(np.int32).tobytes(), value[s].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "__id").cast(pa.string()), column(batch, "__y"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                names=["id", "y", "number", "value"],
            )

    got = joined.select("__id", "__y", "__text", "__declared").mapInArrow(run, "id string, y int, number binary, value binary").toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["number"].to_pylist(), got["value"].to_pylist(), got["y"].to_pylist(), strict=True))
    return fit([(np.frombuffer(n, np.int32), np.frombuffer(v, np.float32).astype(float), y) for _, n, v, y in rows])


def _declared(docs: DataFrame, name: str):
    kind = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in docs.columns else F.lit(0.0)
    return F.greatest(kind, F.lit(0.0)).alias("__declared")


def score(docs: DataFrame, machine: Machine, text: str = "text", declared: str = "n_chars", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``keep`` columns and ``out``: the probability of label 1, for every row (null texts are empty texts)."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c != out]
    held = docs.sparkSession.sparkContext.broadcast(machine)
    source = docs.select(*keep, F.col(text).cast("string").alias("__text"), _declared(docs, declared))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(column(batch, "__text"))
            given = column(batch, "__declared").to_numpy(zero_copy_only=False)
            parts = [logistic(margins(held.value, *features(r, o, given[a:b]))) for a, b, r, o in chunks(raw, at)]
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(parts))], names=[*keep, out])

    return source.mapInArrow(run, schema)
