"""Quality rules as a ledger of failure bits.

One pass over the texts stores the measurements and one bit per failed rule. A policy is a named,
versioned set of rules; applying it, counting what each rule costs and comparing policies are bitwise
operations on the ledger, without the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODES, Spans, annotate, mix, row_of, word_bounds, word_codes

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def measurements(raw: np.ndarray, at: np.ndarray, window: int = 3) -> list[np.ndarray]:
    """The numbers of ``MEASURES`` for a chunk of whole texts."""
    n = len(at) - 1
    starts, ends, words = word_bounds(raw, at)
    n_words = np.diff(words)

    def summed(flags):
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[at[1:]] - total[at[:-1]]

    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    chars = summed(solid & ((raw & 0xC0) != 0x80))
    symbols = summed(_IS_SYMBOL[raw])
    # lines: cut at newlines and at row ends
    cuts = np.union1d(np.flatnonzero(raw == 10) + 1, at)
    begin, stop = cuts[:-1], cuts[1:].copy()
    newline = (stop > begin) & (raw[np.maximum(stop, 1) - 1] == 10) if len(raw) else np.zeros(0, bool)
    row = np.searchsorted(at, begin, side="right") - 1
    stop[newline] -= 1
    filled = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, row = begin[filled], stop[filled], row[filled]
    code = Spans(BYTE_CODES[raw]).of(begin, stop)
    n_lines = np.bincount(row, minlength=n)
    _, first = np.unique(mix(code + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(row[first], minlength=n)
    # windows of words
    codes = word_codes(raw, starts, ends)
    word_row = row_of(words)
    i = np.arange(max(0, len(codes) - window + 1))
    i = i[word_row[i] == word_row[i + window - 1]]
    code = mix(Spans(codes).of(i, i + window) + word_row[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, count = np.unique(code, return_inverse=True, return_counts=True)
    again = i[count[which] >= 2] if len(i) else i
    covered = np.zeros(len(codes) + window, bool)
    for step in range(window):
        covered[again + step] = True
    total = np.concatenate(([0], np.cumsum(covered, dtype=np.int64)))
    repeated = total[words[1:]] - total[words[:-1]]
    return [x.astype(np.int64) for x in (n_words, chars, symbols, n_lines, n_lines - distinct, repeated)]


def measure(docs: DataFrame, text: str = "text", keep=None, window: int = 3) -> DataFrame:
    """Add the measurements of ``MEASURES``; a null text has none of anything (all 0).

    ``n_lines`` counts newline-split lines with a word, ``n_dup_lines`` those equal to an earlier one, and
    ``n_repeat_words`` the words covered by ``window``-word windows that the text has more than once.
    """
    fields = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])
    return annotate(docs, fields, lambda raw, at: measurements(raw, at, window), text, keep)


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measurements that marks a failure."""

    name: str
    failed: str


#: bit i of the ledger belongs to RULES[i]; new rules go to the end, so old ledgers stay readable
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
#: policy -> names of the rules that a document must pass
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"),
}


def bits_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    place = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << place[n] for n in names)


def ledger(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``failed_bits``: bit i is set where rule i fails (each rule is evaluated once)."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def passes(policy: str, rules: Sequence[Rule] = RULES, policies=POLICIES) -> Column:
    """Whether a row of the ledger fails no rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(bits_of(policies[policy], rules))) == 0


def ablations(book: DataFrame, policy: str, rules: Sequence[Rule] = RULES, policies=POLICIES) -> DataFrame:
    """(rule, n_failed, n_alone) for each rule of a policy: rows that fail it, and rows lost to it alone.

    ``n_alone`` is what dropping the rule from the policy would bring back. The ledger is first counted
    by bit pattern; there are at most 2 ** rules patterns.
    """
    mask = bits_of(policies[policy], rules)
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    place = {r.name: i for i, r in enumerate(rules)}
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << place[n]).cast("long").alias("bit")) for n in policies[policy]])
    spread = patterns.select("bits", "n", F.inline(pairs))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return spread.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"),
    )
