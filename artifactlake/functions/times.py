"""Epoch conversions of the browser stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# seconds between 1601-01-01 and 1970-01-01
SECONDS_1601_TO_1970 = 11_644_473_600


def epoch_to_utc(value: str | Column, origin: str) -> Column:
    """Timestamp of an epoch number: ``1601us``, ``1970us`` or ``1970ms``."""
    v = F.col(value) if isinstance(value, str) else value
    raw = F.coalesce(v.try_cast("long"), F.lit(0).cast("long"))
    if origin == "1601us":
        return F.timestamp_micros(raw - F.lit(SECONDS_1601_TO_1970 * 1_000_000))
    if origin == "1970us":
        return F.timestamp_micros(raw)
    if origin == "1970ms":
        return F.timestamp_millis(raw)
    raise ValueError(f"unknown epoch origin {origin!r}")


def epoch_parts(value: str | Column, origin: str) -> Column:
    """Raw number, normalized UTC text and display zone of an epoch value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.struct(
        F.coalesce(v.try_cast("long"), F.lit(0).cast("long")).alias("raw_epoch"),
        F.date_format(epoch_to_utc(value, origin), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(
            "normalized_utc"
        ),
        F.lit("UTC").alias("display_timezone"),
    )
