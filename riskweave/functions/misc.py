"""Small scalar helpers: null-keeping comparisons, dates, JSON, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_flagged(flag: Column, value=1) -> Column:
    """``flag != value`` with pandas semantics: a null flag counts as *not* flagged."""
    return ~flag.eqNullSafe(F.lit(value))


def epoch_ms_to_date(c: Column) -> Column:
    """Epoch milliseconds → UTC ``yyyy-MM-dd``; day arithmetic, so the session time zone
    cannot shift the date."""
    days = F.floor(c / F.lit(86_400_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def ntz_to_epoch_ms(c: Column) -> Column:
    """``timestamp_ntz`` (wall clock in UTC) → epoch milliseconds, without any time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def year_of_month_string(c: Column) -> Column:
    """``'yyyy-MM'`` → ``'yyyy'``."""
    return F.split(c, "-").getItem(0)


def prob_label(p: Column, thresh: float = 0.5) -> Column:
    """Probability → 0/1 with a strict ``>`` (the classifier's rule)."""
    return (p > F.lit(thresh)).cast("int")


def stable_bucket(key: Column, buckets: int, seed: int = 0) -> Column:
    """Deterministic bucket in ``[0, buckets)`` from a key, independent of partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets))


def md5_int(c: Column) -> Column:
    """First eight hex digits of ``md5(c)`` as an integer."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def round6(c: Column) -> Column:
    """Output rounding to 6 decimals that agrees across engines: snap to 10 decimals first, so a
    value sitting on a ...5 tie rounds the same way whatever its binary noise."""
    return F.round(F.round(c, 10), 6)
