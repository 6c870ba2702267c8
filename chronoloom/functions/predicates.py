"""Selections of keys and times. All of them reach the Parquet scan as pushed filters."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANOS = 1_000_000_000
MOST_NANOS = 2**63 - 1


def key_is(key: str, column: str = "key") -> Column:
    return F.col(column) == key


def key_range(lower: str | None = None, upper: str | None = None, include_lower: bool = True, include_upper: bool = False, column: str = "key") -> Column:
    """Keys between two bounds, in the order of their bytes; None is unbounded. A range that cannot hold a key is an error."""
    if lower is not None and upper is not None:
        low, high = lower.encode(), upper.encode()
        if low > high:
            raise ValueError(f"range start {lower!r} is after its end {upper!r}")
        if low == high and not (include_lower and include_upper):
            raise ValueError(f"range from {lower!r} to itself is empty")
    out = F.lit(True)
    if lower is not None:
        out = out & (F.col(column) >= lower if include_lower else F.col(column) > lower)
    if upper is not None:
        out = out & (F.col(column) <= upper if include_upper else F.col(column) < upper)
    return out


def time_range(after: int | None = None, before: int | None = None, column: str = "ts_nanos") -> Column:
    """Times from ``after`` on, before ``before``."""
    out = F.lit(True)
    if after is not None:
        out = out & (F.col(column) >= after)
    if before is not None:
        out = out & (F.col(column) < before)
    return out


def wildcard_parts(pattern: str) -> tuple[str, bool]:
    """The literal beginning of a pattern, and whether that is all of it."""
    head, percent, _ = pattern.partition("%")
    return head, not percent


def like_pattern(pattern: str) -> str:
    """``%`` is the only special character; what LIKE treats specially besides is escaped."""
    return re.sub(r"([\\_])", r"\\\1", pattern)


def wildcard(pattern: str, column: str = "key") -> Column:
    """Keys that match a pattern in which ``%`` stands for any characters, or none."""
    head, exact = wildcard_parts(pattern)
    return F.col(column) == head if exact else F.col(column).like(like_pattern(pattern))


_TIME = re.compile(r"(?a)(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?)?")


def parse_time(text: str) -> int:
    """Nanoseconds of a time literal: a date, with ``T`` or a space a time of day, with up to nine digits of a second."""
    m = _TIME.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a time: {text!r}")
    at = datetime(*(int(x or 0) for x in m.groups()[:6]), tzinfo=UTC)
    return checked_nanos(int(at.timestamp()) * NANOS + int((m[7] or "").ljust(9, "0")))


def checked_nanos(nanos: int) -> int:
    """Times before 1970 or beyond the storage type are errors."""
    if not 0 <= nanos <= MOST_NANOS:
        raise ValueError(f"timestamp out of range: {nanos}")
    return nanos


def nanos_of(column: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) * 1000L")


def select_columns(text: str | None) -> list[tuple[int, int]]:
    """A column choice such as ``1,3,5-7`` as ranges of numbers from 1; None chooses all."""
    if text is None:
        return [(1, MOST_NANOS)]
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*([0-9]+)\s*(?:-\s*([0-9]+)\s*)?", part)
        if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
            raise ValueError(f"not a choice of columns: {text!r}")
        out.append((int(m[1]), int(m[2] or m[1])))
    return out


def chosen(n: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= n <= b for a, b in ranges)


def pick_columns(text: str, cols: str = "cols") -> Column:
    """The ``cols`` array with only the chosen columns, in stored order."""
    ranges = select_columns(text)

    def keep(_: Column, k: Column) -> Column:
        out = F.lit(False)
        for a, b in ranges:
            out = out | k.between(a - 1, b - 1)
        return out

    return F.filter(cols, keep)


def pick_format(text: str, fmt: str = "fmt") -> Column:
    """The format of what ``pick_columns`` leaves."""
    ranges = select_columns(text)
    codes = F.split(fmt, "")

    def keep(_: Column, k: Column) -> Column:
        out = F.lit(False)
        for a, b in ranges:
            out = out | k.between(a - 1, b - 1)
        return out

    return F.array_join(F.filter(codes, keep), "")


def seconds(column: str = "ts_nanos") -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.expr(f"{column} div {NANOS}")


def formatted(pattern: str, column: str = "ts_nanos") -> Column:
    """A time by a Spark date pattern, in UTC whatever the session's zone, to the microsecond."""
    return F.date_format(F.expr(f"timestampadd(MICROSECOND, {column} div 1000, timestamp_ntz'1970-01-01 00:00:00')"), pattern)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
