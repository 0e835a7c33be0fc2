"""Dates as pages, feeds and search results write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order in which they are tried, and the seconds of relative units.
PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd MMM yyyy",
    "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd",
)
UNITS = (("minute", 60), ("hour", 3_600), ("day", 86_400), ("week", 604_800), ("month", 2_592_000), ("year", 31_536_000))


def parse_date(text: Column, now: Column) -> Column:
    """A timestamp from any of the patterns (weekday names are passed over), a leading ISO date, or "3 days ago" before ``now``; else null."""
    plain = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", "")
    tried = [F.try_to_timestamp(plain, F.lit(p)) for p in PATTERNS]
    head = F.try_to_timestamp(F.regexp_extract(plain, "^(\\d{4}-\\d{2}-\\d{2})", 1), F.lit("yyyy-MM-dd"))
    low = F.lower(plain)
    seconds = F.coalesce(*[F.when(low.contains(u), F.lit(s)) for u, s in UNITS])
    count = F.regexp_extract(low, "(\\d+)", 1).try_cast("long")
    ago = F.when(low.contains("ago"), F.timestamp_seconds(F.unix_seconds(now) - count * seconds))
    return F.coalesce(*tried, head, ago)
