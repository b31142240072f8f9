"""Days with a cutoff hour in a time zone. Columns are instants in a session whose zone is UTC."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Days, as the half-open stretch of instants that they cover."""

    start: datetime
    end: datetime
    dates: tuple[date, ...]
    zone: str

    def holds(self, ts: Column) -> Column:
        """Pushed down to a scan; null is outside."""
        return (ts >= F.lit(self.start.replace(tzinfo=None)).cast("timestamp")) & (ts < F.lit(self.end.replace(tzinfo=None)).cast("timestamp"))


def _at(day: date, hour: int, zone: str) -> datetime:
    return datetime.combine(day, time(hour), ZoneInfo(zone)).astimezone(ZoneInfo("UTC"))


def days(last: date, count: int = 1, cutoff: int = 4, zone: str = "UTC") -> Range:
    """count days up to last, each from its cutoff hour to the next day's; an unknown zone raises."""
    dates = tuple(last - timedelta(days=i) for i in reversed(range(count)))
    return Range(_at(dates[0], cutoff, zone), _at(last + timedelta(days=1), cutoff, zone), dates, zone)


def local_date(ts: Column, cutoff: int = 4, zone: str = "UTC") -> Column:
    """The calendar date in the zone, cutoff hours earlier. Hours are subtracted from the instant, so about a change of clocks this can differ from days()."""
    return F.to_date(F.from_utc_timestamp(ts - F.make_interval(hours=F.lit(cutoff)), zone))


def hhmm(ts: Column, zone: str = "UTC") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm"), F.lit("--:--"))


def utc_offset_minutes(ts: Column, zone: str) -> Column:
    return ((F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts)) / 60).cast("int")


def utc_offset_label(ts: Column, zone: str) -> Column:
    m = utc_offset_minutes(ts, zone)
    return F.format_string("UTC%s%02d:%02d", F.when(m < 0, "-").otherwise("+"), F.floor(F.abs(m) / 60).cast("int"), F.abs(m) % 60)


def to_instant(value: Column) -> Column:
    """Text with seconds, milliseconds or an ISO time as an instant; null if it is none."""
    digits = value.rlike(r"^\s*\d{9,16}(\.\d+)?\s*$")
    number = F.trim(value).try_cast("double")
    return F.when(digits, F.timestamp_millis(F.when(number < 1e11, number * 1000).otherwise(number).cast("long"))).otherwise(F.try_to_timestamp(value))


def duration_minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two instants, rounded, never below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_millis(end) - F.unix_millis(start)) / 60000 + 0.5)).cast("long")


#: Names of days near today.
NEAR = {0: "今天", 1: "昨天", 2: "前天", -1: "明天"}


def relative_day(day: Column, today: Column) -> Column:
    """The name of a day near today, else empty."""
    names = F.create_map(*[F.lit(x) for kv in NEAR.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.datediff(today, day)), F.lit(""))


def date_words(day: Column, today: Column) -> Column:
    """Month, day and weekday; the year where it isn't today's."""
    weekday = F.element_at(F.array(*[F.lit(f"周{x}") for x in "一二三四五六日"]), F.weekday(day) + 1)
    year = F.when(F.year(day) == F.year(today), "").otherwise(F.concat(F.year(day).cast("string"), F.lit("年")))
    return F.concat(year, F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日 "), weekday)


def duration_words(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return F.when(F.coalesce(minutes, F.lit(0)) == 0, "").when(minutes < 60, F.concat(m, F.lit(" 分钟"))).when(minutes % 60 == 0, F.concat(h, F.lit(" 小时"))).otherwise(F.concat(h, F.lit(" 小时 "), m, F.lit(" 分钟")))
