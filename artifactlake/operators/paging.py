"""Keyset paging, ordered resume and top-n reads.

A page is ``where(after cursor).orderBy(key, id).limit(n)``: Spark runs it as a top-n, so no page
ever sorts or skips the rows before it.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAGE_LIMIT = 500
POLL_LIMIT = 500
COMPACT_LIMIT = 10_000
GALLERY_LIMIT = 200
SORTABLE = ("path", "size_bytes", "modified_at", "interest_score", "confidence")


class PagingError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def encode_cursor(fields: dict[str, Any]) -> str:
    text = json.dumps(fields, sort_keys=True, separators=(",", ":"), default=str)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, fields: Sequence[str]) -> dict[str, Any]:
    try:
        padded = cursor + "=" * (-len(cursor) % 4)
        data = json.loads(base64.urlsafe_b64decode(padded.encode()))
    except (ValueError, binascii.Error) as error:
        raise PagingError("invalid_cursor", "cursor is not readable") from error
    if not isinstance(data, dict) or any(f not in data for f in fields):
        raise PagingError("invalid_cursor", "cursor is malformed")
    return data


def after(key: str, id_col: str, value: Any, last_id: Any) -> Column:
    """Rows that sort strictly after (value, last_id); NULL keys sort lowest."""
    k, i = F.col(key), F.col(id_col)
    if value is None:
        tie = k.isNull() & (i > F.lit(last_id)) if last_id is not None else F.lit(False)
        return k.isNotNull() | tie
    tie = (k == F.lit(value)) & (i > F.lit(last_id)) if last_id is not None else F.lit(False)
    return (k > F.lit(value)) | tie


def keyset_page(
    df: DataFrame,
    key: str,
    id_col: str,
    limit: int,
    value: Any = None,
    last_id: Any = None,
    first: bool = True,
) -> DataFrame:
    if not first:
        df = df.where(after(key, id_col, value, last_id))
    return df.orderBy(F.col(key).asc_nulls_first(), F.col(id_col)).limit(limit)


def page_findings(df: DataFrame, cursor: str | None = None, limit: int = 100) -> DataFrame:
    """Findings page on (created_at, finding_id); ask for one row more to learn of a next page."""
    return _created_page(df, "finding_id", cursor, limit)


def page_artifacts(df: DataFrame, cursor: str | None = None, limit: int = 100) -> DataFrame:
    """Browser artifact page on (created_at, browser_artifact_id)."""
    return _created_page(df, "browser_artifact_id", cursor, limit)


def _created_page(df: DataFrame, id_col: str, cursor: str | None, limit: int) -> DataFrame:
    if not 1 <= limit <= PAGE_LIMIT + 1:
        raise PagingError("invalid_limit", "page limit is out of range")
    if cursor is None:
        return keyset_page(df, "created_at", id_col, limit)
    at = decode_cursor(cursor, ["created_at", id_col])
    if not isinstance(at["created_at"], str) or not isinstance(at[id_col], str):
        raise PagingError("invalid_cursor", "cursor fields have a wrong type")
    stamp = F.lit(at["created_at"]).cast(df.schema["created_at"].dataType)
    return keyset_page(df, "created_at", id_col, limit, stamp, at[id_col], first=False)


def page(
    df: DataFrame, sort: str = "path", cursor: str | None = None, limit: int = 100
) -> DataFrame:
    """Table page on any sortable field with the entry id as tiebreaker."""
    if sort not in SORTABLE:
        raise PagingError("invalid_sort", f"sort field {sort!r} is not supported")
    if not 1 <= limit <= PAGE_LIMIT + 1:
        raise PagingError("invalid_limit", "page limit is out of range")
    if cursor is None:
        return keyset_page(df, sort, "entry_id", limit)
    at = decode_cursor(cursor, ["sort", "key"])
    if at["sort"] != sort:
        raise PagingError("invalid_cursor", "cursor sort does not match the request")
    return keyset_page(df, sort, "entry_id", limit, at.get("value"), at["key"], first=False)


def take_page(df: DataFrame, sort: str, id_col: str, limit: int) -> tuple[list, str | None]:
    """Collect a page read with ``limit + 1`` rows and build its next cursor (at most 501 rows)."""
    rows = df.take(limit + 1)
    items = rows[:limit]
    if len(rows) <= limit or not items:
        return items, None
    last = items[-1]
    if sort == "created_at":
        fields = {"created_at": str(last["created_at"]), id_col: last[id_col]}
    else:
        fields = {"sort": sort, "key": last[id_col], "value": last[sort]}
    return items, encode_cursor(fields)


def events_after(df: DataFrame, case_id: Any, sequence: int = 0, limit: int = 100) -> DataFrame:
    """Ordered events of one case after a sequence number, at most 500."""
    if not 1 <= limit <= POLL_LIMIT:
        raise PagingError("invalid_limit", "page limit is out of range")
    return (
        df.where((F.col("case_id") == F.lit(case_id)) & (F.col("sequence") > sequence))
        .orderBy("sequence")
        .limit(limit)
    )


def compaction_candidates(df: DataFrame, before: Any, limit: int = 1000) -> DataFrame:
    """Oldest published events created before a time, at most 10,000 per call."""
    if not 1 <= limit <= COMPACT_LIMIT:
        raise PagingError("invalid_limit", "page limit is out of range")
    return (
        df.where(F.col("published_at").isNotNull() & (F.col("created_at") < F.lit(before)))
        .orderBy("created_at", "event_id")
        .limit(limit)
    )


def live_samples(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows per key with their position.

    ``row_number() <= n`` makes Spark keep only n rows per key and task before the shuffle
    (WindowGroupLimit), so a huge key costs no more than a small one.
    """
    win = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("position", F.row_number().over(win))
        .where(F.col("position") <= n)
    )


def aspect_ratio() -> Column:
    w, h = F.col("thumb_width"), F.col("thumb_height")
    return F.when((w > 0) & (h > 0), w / h).otherwise(F.lit(4.0 / 3.0))


def gallery_columns(df: DataFrame) -> DataFrame:
    """Tile columns: thumbnail, aspect ratio, placeholder size and labels."""
    thumb = F.nullif(F.col("thumbnail_ref"), F.lit(""))
    missing = thumb.isNull()
    return df.select(
        "entry_id",
        thumb.alias("thumbnail_ref"),
        F.lit(300).alias("placeholder_width"),
        F.when(missing, F.lit(225))
        .otherwise(F.greatest(F.lit(1), F.bround(F.lit(300.0) / aspect_ratio()).cast("int")))
        .alias("placeholder_height"),
        missing.alias("missing_thumbnail"),
        F.coalesce("duplicate", F.lit(False)).alias("duplicate"),
        F.concat(F.lit("media finding "), F.col("entry_id").cast("string")).alias("aria_label"),
    )


def gallery_page(
    df: DataFrame, duplicates: DataFrame, cursor: str | None = None, limit: int = 60
) -> DataFrame:
    """Gallery page in path order with duplicate flags; the page is cut before the join."""
    if not 1 <= limit <= GALLERY_LIMIT:
        raise PagingError("invalid_limit", "page limit is out of range")
    window = page(df, "path", cursor, limit)
    flags = duplicates.select("entry_id").distinct().withColumn("duplicate", F.lit(True))
    # at most 200 page rows: the page is the side to broadcast
    flagged = flags.join(F.broadcast(window.select("entry_id")), "entry_id")
    return gallery_columns(window.join(flagged, "entry_id", "left"))


def table_columns(df: DataFrame, ui_base: str = "") -> DataFrame:
    """Rendered table projection with a detail link."""
    link = (
        F.concat(
            F.lit(f"{ui_base}/case/"),
            F.coalesce(F.col("case_id").cast("string"), F.lit("")),
            F.lit("/finding/"),
            F.col("entry_id").cast("string"),
        )
        if ui_base
        else F.lit("")
    )
    return df.select(
        "path",
        F.col("entry_type").alias("type"),
        "size_bytes",
        "modified_at",
        "state",
        "interest_score",
        "confidence",
        "category",
        F.col("export_state").alias("export"),
        link.alias("detail_link"),
    )
