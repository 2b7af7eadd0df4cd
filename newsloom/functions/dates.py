"""Dates of many forms (DT1) and the lookback window (FL1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms tried in turn, after the weekday is taken off.
FORMS = ["dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm:ss Z", "yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy", "dd MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm"]


def parse_date(value: Column) -> Column:
    """A timestamp of the first form that fits; without a zone UTC (the session's); null if none fits."""
    text = F.regexp_replace(F.trim(value), r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    text = F.regexp_replace(text, r"\b(?:GMT|UTC|UT)$", "+0000")
    iso = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in FORMS])


def within_lookback(published: Column, now: Column, hours: int) -> Column:
    """Not older than so many hours; undated items stay."""
    return published.isNull() | (published >= now - F.make_dt_interval(hours=F.lit(hours)))
