"""Small column builders shared by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ascii_lower(value: str | Column) -> Column:
    """Lower-case A-Z only, the way LIKE folds case in the catalog's own store."""
    return F.translate(col(value), UPPER, LOWER)


def text_match(columns: list[str | Column], needle: str) -> Column:
    """ASCII case-insensitive substring search over any of ``columns``.

    The needle is literal text: ``%``, ``_`` and backslash have no special meaning.
    """
    want = F.lit(needle.translate(str.maketrans(UPPER, LOWER)))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(ascii_lower(c), want), F.lit(False))
    return hit


def stable_id(prefix: str, parts: list[str | Column], digits: int = 24) -> Column:
    """``prefix`` plus the first hex digits of SHA-256 over the NUL-joined parts."""
    filled = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *filled), 256), 1, digits))


def present(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    items = []
    for cond, label in pairs:
        value = F.lit(label) if isinstance(label, str) else label
        items.append(F.when(cond, value))
    return F.array_compact(F.array(*items))


def path_suffix(path: str | Column) -> Column:
    """Last extension of the final path part, lower-case with its dot, '' where there is none."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def utc_text(ts: str | Column) -> Column:
    """Canonical ``YYYY-MM-DDTHH:MM:SSZ`` text of a timestamp."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_is_one(json_text: str | Column, path: str) -> Column:
    """True where the JSON value at ``path`` is ``true`` or the number 1 (never the text "1")."""
    node = F.try_variant_get(F.try_parse_json(col(json_text)), path, "variant")
    kind = F.schema_of_variant(node)
    as_number = F.try_variant_get(F.try_parse_json(col(json_text)), path, "double")
    return F.coalesce((kind != F.lit("STRING")) & (as_number == 1.0), F.lit(False))
