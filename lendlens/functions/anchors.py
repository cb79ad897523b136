"""Calendar anchors and reporting periods derived from one "as of" instant.

Every anchor is a Column. Given a literal instant Catalyst folds it to a literal,
so filters on it reach the scan; given a column it is computed per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta, timezone, tzinfo
from functools import cached_property
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANT = "timestamp_ntz"


@dataclass(frozen=True)
class Period:
    """A closed interval."""

    start: Column
    end: Column

    def holds(self, value: Column) -> Column:
        return value.between(self.start, self.end)


#: A day, maybe a time, and maybe a zone after it.
_INSTANT_TEXT = re.compile(
    r"(\d{4})-(\d{1,2})-(\d{1,2})"
    r"(?:(?:T|\s+)(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?)?"
    r"\s*(\S.*)?"
)
_OFFSET = re.compile(r"(?:UTC|GMT|UT)?([+-])(\d{1,2})(?::?(\d{2})(?::?(\d{2}))?)?", re.I)


def zone_of(name: str) -> tzinfo:
    """A zone by its name in the time zone database, or by its offset from UTC.

    Abbreviations that the database lacks, as they stand for several zones, are an error.
    """
    if name.upper() in ("Z", "UTC", "GMT", "UT"):
        return UTC
    offset = _OFFSET.fullmatch(name)
    if offset:
        sign, *parts = offset.groups()
        hours, minutes, seconds = (int(part or 0) for part in parts)
        if hours > 18 or minutes > 59 or seconds > 59:
            raise ValueError(f"no offset from UTC: {name!r}")
        ahead = timedelta(hours=hours, minutes=minutes, seconds=seconds)
        return timezone(ahead if sign == "+" else -ahead)
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError) as error:
        raise ValueError(f"no time zone of the database or offset: {name!r}") from error


def parsed_instant(text: str) -> datetime:
    """An instant's text as a datetime, with a zone if the text names one.

    A clock time that a zone's change skips or repeats is taken as before the change. Text
    that is not understood as a whole is an error.
    """
    found = _INSTANT_TEXT.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not an instant: {text!r}")
    *numbers, fraction, zone = found.groups()
    micros = int(((fraction or "") + "0" * 6)[:6])
    clock = datetime(*(int(number or 0) for number in numbers), micros)
    return clock if zone is None else clock.replace(tzinfo=zone_of(zone))


def _in_utc(instant: datetime | str) -> str:
    """An instant's time in UTC as text."""
    if isinstance(instant, str):
        instant = parsed_instant(instant)
    if instant.tzinfo is not None:
        instant = instant.astimezone(UTC).replace(tzinfo=None)
    return str(instant)


class PeriodAnchors:
    def __init__(self, now: Column):
        self.now = now.cast(INSTANT)

    @classmethod
    def of(cls, as_of: Column | datetime | str | None = None) -> PeriodAnchors:
        """An instant without zone is UTC; ``None`` means the clock, read once, here."""
        if isinstance(as_of, Column):
            return cls(as_of)
        if as_of is None:
            as_of = datetime.now(UTC)
        return cls(F.lit(_in_utc(as_of)))

    # Calendar days.

    @cached_property
    def today(self) -> Column:
        return F.to_date(self.now)

    @cached_property
    def yesterday(self) -> Column:
        return F.date_sub(self.today, 1)

    @cached_property
    def current_month_first(self) -> Column:
        return F.trunc(self.today, "MM")

    @cached_property
    def last_month_first(self) -> Column:
        return F.trunc(self.same_day_last_month_date, "MM")

    @cached_property
    def same_day_last_month_date(self) -> Column:
        """Today minus one month, clamped to the end of a shorter month."""
        return F.add_months(self.today, -1)

    @cached_property
    def last_day_of_month(self) -> Column:
        return F.last_day(self.today)

    @cached_property
    def last_day_of_last_month(self) -> Column:
        return F.last_day(self.same_day_last_month_date)

    def days_ago(self, days: int) -> Column:
        return F.date_sub(self.today, days)

    # Instants.

    @cached_property
    def current_month_start(self) -> Column:
        return self.current_month_first.cast(INSTANT)

    @cached_property
    def last_month_start(self) -> Column:
        return self.last_month_first.cast(INSTANT)

    @cached_property
    def same_day_last_month(self) -> Column:
        """Midnight at the start of the same day last month."""
        return self.same_day_last_month_date.cast(INSTANT)

    @cached_property
    def last_month_end(self) -> Column:
        return self.current_month_start - F.make_dt_interval(secs=F.lit(1))

    def instant_days_ago(self, days: int) -> Column:
        return self.now - F.make_dt_interval(days=F.lit(days))

    # Periods. With instants the last period ends at midnight before the same day
    # and the current one at this moment; with dates both include the whole day.

    def last_period(self, grain: str) -> Period:
        if grain == "date":
            return Period(self.last_month_first, self.same_day_last_month_date)
        return Period(self.last_month_start, self.same_day_last_month)

    def current_period(self, grain: str) -> Period:
        if grain == "date":
            return Period(self.current_month_first, self.today)
        return Period(self.current_month_start, self.now)

    # Parameter columns, by name.

    def instants(self) -> dict[str, Column]:
        return {
            "now_ts": self.now,
            "current_month_start": self.current_month_start,
            "last_month_start": self.last_month_start,
            "same_day_last_month": self.same_day_last_month,
            "last_month_end": self.last_month_end,
        }

    def dates(self) -> dict[str, Column]:
        return {
            "now_dt": self.today,
            "current_month_start": self.current_month_first,
            "last_month_start": self.last_month_first,
            "same_day_last_month": self.same_day_last_month_date,
        }
