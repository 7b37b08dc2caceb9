"""Delays and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def retry_delay(attempt: Column | str, base: float, cap: float | None = None) -> Column:
    """Exponential delay ``base * 2^(attempt-1)``, capped when ``cap`` is given."""
    n = F.col(attempt) if isinstance(attempt, str) else attempt
    raw = F.lit(base) * F.pow(F.lit(2.0), F.greatest(n - 1, F.lit(0)))
    return F.least(raw, F.lit(cap)) if cap is not None else raw


def minutes_of_day(ts: Column | str) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(t) * 60 + F.minute(t)
