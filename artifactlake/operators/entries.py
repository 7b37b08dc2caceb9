"""Normalization of enumerated filesystem entries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import present


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(df: DataFrame, cols: list[str]) -> DataFrame:
    """NFC form of text columns.

    Spark has no built-in for it. ASCII text is its own NFC form and is passed to Python as NULL, so
    only the few other values are converted.
    """
    for c in cols:
        plain = F.coalesce(F.col(c).rlike(r"^[\x00-\x7f]*$"), F.lit(True))
        df = df.withColumn(
            f"__nfc_{c}", _nfc(F.when(~plain, F.col(c)))
        ).withColumn(c, F.coalesce(f"__nfc_{c}", c)).drop(f"__nfc_{c}")
    return df


def shown(text: Column) -> Column:
    """Display form: invalid bytes as U+FFFD, NUL as a visible mark."""
    return F.replace(F.make_valid_utf8(text), F.lit("\0"), F.lit("\\0"))


def normalize_entries(df: DataFrame, unicode_form: bool = True) -> DataFrame:
    """Stable id, display names, stream, type and warnings of enumerated entries.

    Input: ord, volume_id, object_id, path, name, entry_type, allocated (more columns pass through).
    Parent and sibling flags come from ``resolve_parents`` and ``duplicate_siblings``.
    """
    if unicode_form:
        df = nfc(df, ["path", "name"])
    path, name = F.col("path"), F.col("name")
    raw = path.cast("binary")
    digest = F.sha2(
        F.concat(
            F.col("volume_id").cast("binary"),
            F.unhex(F.lit("00")),
            F.col("object_id").cast("binary"),
            F.unhex(F.lit("00")),
            raw,
        ),
        256,
    )
    invalid = F.contains(F.make_valid_utf8(path), F.lit("�")) | F.contains(
        F.make_valid_utf8(name), F.lit("�")
    )
    nul = F.contains(path, F.lit("\0")) | F.contains(name, F.lit("\0"))
    segments = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    stream = F.nullif(F.regexp_extract(shown(name), r"(?s)^[^:]+:(.+)$", 1), F.lit(""))
    kind = F.col("entry_type")
    gone = ~F.col("allocated") & kind.isin("file", "directory", "symlink", "unknown")
    return (
        df.withColumn("entry_id", F.concat(F.lit("entry-"), F.substring(digest, 1, 32)))
        .withColumn("raw_path_bytes", raw)
        .withColumn("display_path", shown(path))
        .withColumn("display_name", shown(name))
        .withColumn("alternate_stream", stream)
        .withColumn("entry_type", F.when(gone, "deleted").otherwise(kind))
        .withColumn(
            "warnings",
            present(
                (invalid, "invalid_unicode"),
                (nul, "nul_byte"),
                (F.array_contains(segments, ".."), "path_traversal_segment"),
                (F.col("alternate_stream").isNotNull(), "alternate_stream"),
            ),
        )
    )
