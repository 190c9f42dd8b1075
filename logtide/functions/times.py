"""Times, durations and sizes: literals on the driver, Column functions on data."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import DAY_MS

DURATIONS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": DAY_MS}
SIZES = {"": 1, "b": 1} | {u + s: base**i for i, u in enumerate("kmgt", 1) for s, base in (("", 1000), ("b", 1000), ("ib", 1024))}


def time_ms(text: str) -> int:
    """Milliseconds as digits, or RFC 3339 with an offset."""
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError(f"{text}: an offset is required")
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // (datetime.resolution * 1000)


def duration_ms(text: str) -> int:
    found = re.fullmatch(r"(\d+)\s*(ms|s|m|h|d)", text.strip().lower())
    if not found:
        raise ValueError(f"{text}: a number with one of the units ms, s, m, h, d is required")
    return int(found[1]) * DURATIONS[found[2]]


def size_bytes(text: str) -> int:
    found = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower())
    if not found or found[2] not in SIZES:
        raise ValueError(f"{text}: not a size")
    return int(found[1]) * SIZES[found[2]]


def valid_range(start: int, end: int) -> None:
    if start >= end:
        raise ValueError(f"empty range: {start} is not before {end}")


def one_of(**given: object) -> str:
    """The name of the one option that is given (is not None); a ValueError where none is, or several that exclude each other are."""
    names = [k for k, v in given.items() if v is not None]
    if len(names) != 1:
        raise ValueError(f"exactly one of {', '.join(given)} is required" + (f", not {' and '.join(names)}" if names else ""))
    return names[0]


def parse_time(text: Column) -> Column:
    """Like ``time_ms``, null if it is neither."""
    digits, offset = text.rlike(r"^-?\d+$"), text.rlike(r"([zZ]|[+-]\d\d:\d\d)$")
    return F.when(digits, text.try_cast("long")).when(offset, F.unix_millis(F.try_to_timestamp(text)))


def fmt_ts(ms: Column) -> Column:
    """RFC 3339 with milliseconds and Z; what no calendar date can show as ``<n>ms``."""
    inside = ms.between(-62_167_219_200_000, 253_402_300_799_999)
    shown = F.date_format(F.timestamp_millis(F.when(inside, ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(shown, F.concat(ms.cast("string"), F.lit("ms")))


def align_down(ms: Column, width: int) -> Column:
    """Start of the window that holds ``ms``: windows of ``width`` restart every UTC day."""
    day = ms - F.pmod(ms, F.lit(DAY_MS))
    return day + (F.pmod(ms, F.lit(DAY_MS)) - F.pmod(F.pmod(ms, F.lit(DAY_MS)), F.lit(width)))


def next_boundary(start: Column, width: int) -> Column:
    return F.least(start + width, start - F.pmod(start, F.lit(DAY_MS)) + DAY_MS)


def format_bytes(n: Column) -> Column:
    """One decimal, in steps of 1024."""
    shown = F.format_string("%d B", n)
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        shown = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), F.lit(1)))).otherwise(shown)
    return shown


def in_range(ms: Column, start: int, end: int) -> Column:
    """All time ranges are half open."""
    return (ms >= start) & (ms < end)


def overlaps(low: Column, high: Column, start: int, end: int) -> Column:
    """Closed interval low .. high meets the half-open range."""
    return (low < end) & (high >= start)
