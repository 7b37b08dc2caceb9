"""Redaction of secrets in text and of values under sensitive keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import REDACTED, SECRET_PATTERNS, SENSITIVE_KEY_PARTS


def redact_secrets(
    df: DataFrame,
    text_col: str,
    patterns: Sequence[str] = SECRET_PATTERNS,
    out: str = "redacted",
    codes: str = "redactions",
) -> DataFrame:
    """Replace secret shapes one pattern after the other and list the patterns that fired.

    Whether a pattern fires is asked of the text the earlier patterns have left.
    """
    work = df.withColumn(out, F.col(text_col))
    fired = []
    for i, pattern in enumerate(patterns):
        flag = f"__p{i}"
        work = work.withColumn(flag, F.col(out).rlike(pattern))
        work = work.withColumn(
            out,
            F.when(F.col(flag), F.regexp_replace(out, pattern, REDACTED)).otherwise(F.col(out)),
        )
        fired.append(F.when(F.col(flag), F.lit(f"pattern:{i}")))
    return work.withColumn(codes, F.array_compact(F.array(*fired))).drop(
        *[f"__p{i}" for i in range(len(patterns))]
    )


def redact_json_keys(
    json_text: str | Column, words: Sequence[str] = SENSITIVE_KEY_PARTS, mark: str = REDACTED
) -> Column:
    """Replace string, number and literal values under sensitive keys of JSON text, at any depth.

    A key is sensitive when it contains one of ``words`` in any case.
    """
    text = F.col(json_text) if isinstance(json_text, str) else json_text
    key = r'("[^"\\]*(?i:' + "|".join(words) + r')[^"\\]*"\s*:\s*)'
    value = r'(?:"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+\-]*|true|false|null)'
    return F.regexp_replace(text, key + value, '$1"' + mark + '"')


def redact_fields(
    df: DataFrame, words: Sequence[str] = SENSITIVE_KEY_PARTS, mark: str = REDACTED, max_chars: int | None = None
) -> DataFrame:
    """Redact typed columns: fields and map keys with sensitive names, and NUL characters.

    Strings stay whole; with ``max_chars`` longer ones are cut, and a column ``fields_cut`` tells which rows
    that concerns. The rewrite follows the schema, so it is planned once and needs no recursion in Python.
    """

    def sensitive(name: str) -> bool:
        low = name.lower()
        return any(w in low for w in words)

    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            whole = F.replace(value, F.lit("\0"), F.lit(""))
            return whole if max_chars is None else F.substring(whole, 1, max_chars)
        if isinstance(kind, T.StructType):
            return F.when(
                value.isNotNull(),
                F.struct(
                    *[
                        (
                            F.lit(mark)
                            if sensitive(f.name)
                            else clean(value.getField(f.name), f.dataType)
                        ).alias(f.name)
                        for f in kind.fields
                    ]
                ),
            )
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda item: clean(item, kind.elementType))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            pattern = "(?i)" + "|".join(words)
            return F.transform_values(
                value,
                lambda k, v: F.when(k.rlike(pattern), F.lit(mark)).otherwise(
                    clean(v, kind.valueType)
                ),
            )
        return value

    def longest(value: Column, kind: T.DataType) -> Column | None:
        """Length of the longest string that ``clean`` may cut."""
        found: list[Column | None] = []
        if isinstance(kind, T.StringType):
            found = [F.length(F.replace(value, F.lit("\0"), F.lit("")))]
        elif isinstance(kind, T.StructType):
            found = [longest(value.getField(f.name), f.dataType) for f in kind.fields if not sensitive(f.name)]
        elif isinstance(kind, T.ArrayType) and longest(value[0], kind.elementType) is not None:
            found = [F.array_max(F.transform(value, lambda item: longest(item, kind.elementType)))]
        elif isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            found = [F.array_max(F.transform(F.map_values(value), lambda v: longest(v, kind.valueType)))]
        known = [c for c in found if c is not None]
        return F.array_max(F.array(*known)) if known else None

    open_fields = [f for f in df.schema.fields if not sensitive(f.name)]
    sizes = [c for f in open_fields if (c := longest(F.col(f.name), f.dataType)) is not None]
    cut = [] if max_chars is None else [(F.coalesce(F.array_max(F.array(F.lit(0), *sizes)), F.lit(0)) > max_chars).alias("fields_cut")]
    return df.select(
        *[
            (F.lit(mark) if sensitive(f.name) else clean(F.col(f.name), f.dataType)).alias(f.name)
            for f in df.schema.fields
        ],
        *cut,
    )
