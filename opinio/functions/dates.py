"""Date column functions and date literals."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length of a relative unit in hours (a year is 365 days, a month 30).
UNIT_HOURS = {
    "year": 365 * 24,
    "month": 30 * 24,
    "week": 7 * 24,
    "day": 24,
    "hour": 1,
    "minute": 1 / 60,
}

# Span in days above which a coarser bin is chosen.
AUTO_FREQUENCY = ((730, "Y"), (180, "Q"), (60, "ME"), (14, "W"))

_RELATIVE = re.compile(r"\s*(-?\d+)\s+([a-z]+)\s+ago\s*")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(at: Column | str, millis: Column | str | None = None) -> Column:
    """Timestamp of epoch seconds (number or digit string), ISO text, else of ``millis``.

    Anything unparsable is null.
    """
    raw = F.trim(_col(at).cast("string"))
    seconds = F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), raw.try_cast("double"))
    # Seconds beyond the year 9999 are no review dates and would overflow the clock.
    parsed = F.coalesce(
        F.timestamp_seconds(F.when(F.abs(seconds) < 253402300800.0, seconds)),
        F.when(seconds.isNull(), F.try_to_timestamp(raw)),
    )
    if millis is None:
        return parsed
    ms = F.trim(_col(millis).cast("string")).try_cast("bigint")
    return F.coalesce(parsed, F.timestamp_millis(F.when(F.abs(ms) < 253402300800000, ms)))


def resolve_date(value: object, now: datetime | None = None) -> datetime | None:
    """Driver-side date literal: ``now``, ``3 months ago``, epoch seconds or ISO text."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    text = str(value).strip().lower()
    if text == "now":
        return now
    try:
        if isinstance(value, (int, float)) or text.isdigit():
            return datetime.fromtimestamp(float(text), timezone.utc).replace(tzinfo=None)
        relative = _RELATIVE.fullmatch(text)
        if relative:
            hours = UNIT_HOURS.get(relative[2].removesuffix("s"))
            return None if hours is None else now - timedelta(hours=int(relative[1]) * hours)
        parsed = datetime.fromisoformat(str(value).strip())
        return parsed if parsed.tzinfo is None else parsed.astimezone(timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError, OSError):
        return None


def relative_date(c: Column | str, now: Column) -> Column:
    """Column form of :func:`resolve_date` against a given ``now``."""
    raw = F.lower(F.trim(_col(c)))
    pattern = r"^(-?\d+)\s+([a-z]+?)s?\s+ago$"
    amount = F.regexp_extract(raw, pattern, 1).try_cast("int")
    unit = F.regexp_extract(raw, pattern, 2)
    minutes = None
    for name, hours in UNIT_HOURS.items():
        value = amount * int(hours * 60)
        minutes = F.when(unit == name, value) if minutes is None else minutes.when(unit == name, value)
    return (
        F.when(raw == "now", now)
        .when(minutes.isNotNull(), now - F.make_dt_interval(mins=minutes))
        .when(amount.isNull(), parse_timestamp(c))
    )


def reformat(c: Column | str, source: str | None = None, target: str | None = "yyyy-MM-dd") -> Column:
    """Parse (optionally with a format) and print again; unparsable gives null."""
    raw = _col(c).cast("string")
    parsed = F.try_to_timestamp(raw, F.lit(source)) if source else F.try_to_timestamp(raw)
    return F.date_format(parsed, target) if target else parsed


def calendar_features(date: Column | str = "date") -> dict[str, Column]:
    date = _col(date)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day_of_week": F.date_format(date, "EEEE"),
        "is_weekend": F.dayofweek(date).isin(1, 7),
    }


def week_of_year(date: Column | str) -> Column:
    """Week number counted from the first Sunday of the year, 0 before it."""
    date = _col(date)
    return F.floor((F.dayofyear(date) + 7 - F.dayofweek(date)) / 7).cast("int")


def period_key(date: Column | str, period: str = "month") -> Column:
    """Sortable text key of the day, week, month or quarter."""
    date = _col(date)
    if period == "day":
        return F.date_format(date, "yyyy-MM-dd")
    if period == "week":
        return F.concat(
            F.date_format(date, "yyyy"), F.lit("-"), F.lpad(week_of_year(date).cast("string"), 2, "0")
        )
    if period == "quarter":
        return F.concat(F.date_format(date, "yyyy"), F.lit("-Q"), F.quarter(date).cast("string"))
    return F.date_format(date, "yyyy-MM")


def frequency(freq: str) -> str:
    """Bin frequency code with the plain month spelling folded in."""
    freq = "ME" if "M" in freq else freq
    if freq not in ("D", "W", "ME", "Q", "Y"):
        raise ValueError(f"unknown frequency {freq!r}")
    return freq


def bin_start(date: Column | str, freq: str) -> Column:
    """First day of the bin a date falls in; weeks run Monday to Sunday."""
    unit = {"D": "day", "W": "week", "ME": "month", "Q": "quarter", "Y": "year"}[frequency(freq)]
    day = _col(date).cast("date")
    return day if unit == "day" else F.trunc(day, unit)


def bin_step(freq: str) -> Column:
    """Interval from one bin start to the next."""
    step = {
        "D": "interval 1 day",
        "W": "interval 7 days",
        "ME": "interval 1 month",
        "Q": "interval 3 months",
        "Y": "interval 1 year",
    }[frequency(freq)]
    return F.expr(step)


def bin_end(start: Column | str, freq: str) -> Column:
    """Last day of the bin, which labels it."""
    start = _col(start)
    freq = frequency(freq)
    if freq == "D":
        return start
    if freq == "W":
        return F.date_add(start, 6)
    months = {"ME": 0, "Q": 2, "Y": 11}[freq]
    return F.last_day(F.add_months(start, months))


def frequency_for(days: Column) -> Column:
    """Bin frequency code for a span in days; the finest one for an unknown span."""
    out = None
    for bound, code in AUTO_FREQUENCY:
        out = F.when(days > bound, code) if out is None else out.when(days > bound, code)
    return out.otherwise("D")


def span_days(date: Column | str) -> Column:
    """Whole days between the first and the last date (an aggregate)."""
    seconds = F.unix_timestamp(F.max(date)) - F.unix_timestamp(F.min(date))
    return F.floor(seconds / 86400).cast("int")


def auto_frequency(df: DataFrame, date: str = "date") -> str:
    """Bin frequency for the span of the data; one min/max job, one row to the driver."""
    return df.agg(frequency_for(span_days(date)).alias("freq")).first()["freq"]
