"""Dates and times. Local wall-clock work goes through TIMESTAMP_NTZ-like values and back to UTC, never through offsets.

Written dates are read by a small grammar: named parts (a month's name, a day's number, a clock) are put together into the
forms that listings use, and each form is read part by part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WEEKDAYS

TZ = "America/Los_Angeles"
# Months, and the parts that written dates and times are made of.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
FULL_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NUMBER, YEAR = r"(\d{1,2})", r"(\d{4})"
SHORT_NAME, ANY_NAME = "([A-Za-z]{3})", "([A-Za-z]{3,9})"
DASH, HALF_DAY = r"\s*[–\-]\s*", "(am|pm)"
UNTIL = r"(?:to|until|[-–])\s*"

# Forms of these parts.
ISO_DAY = rf"{YEAR}-(\d{{2}})-(\d{{2}})"
CLOCK = rf"{NUMBER}(?::(\d{{2}}))?\s*{HALF_DAY}"
#: With minutes the half of the day may be missing; without them it may not.
PAGE_CLOCK = rf"(?:{NUMBER}:(\d{{2}})\s*{HALF_DAY}?|{NUMBER}\s*{HALF_DAY})"
NAMED_DAY = rf"{SHORT_NAME}\s+{NUMBER}"
NAMED_DAY_OF_YEAR = rf"{NAMED_DAY}(?:,\s*{YEAR})?"


def hour24(hour: Column, meridiem: Column) -> Column:
    return (hour % 12) + F.when(F.lower(meridiem) == "pm", 12).otherwise(0)


def month_number(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.element_at(known, F.lower(F.substring(name, 1, 3)))


class _Form:
    """The first place of a text that has a form, read by the numbers of its parts; parts that are not there are null."""

    def __init__(self, text: Column, form: str) -> None:
        self.text, self.form = text, f"(?i){form}"

    def found(self) -> Column:
        return self.text.rlike(self.form)

    def word(self, part: int) -> Column:
        return F.nullif(F.regexp_extract(self.text, self.form, part), F.lit(""))

    def number(self, part: int) -> Column:
        return self.word(part).try_cast("int")

    def month(self, part: int) -> Column:
        return month_number(self.word(part))

    def clock(self, part: int, hour: int | None, minute: int | None) -> tuple[Column, Column]:
        """Hour and minute of a CLOCK that begins with that part; the given ones where the text lacks the form."""
        h = hour24(self.number(part), self.word(part + 2))
        if hour is None:
            return h, F.coalesce(self.number(part + 1), F.lit(0))
        return F.coalesce(h, F.lit(hour)), F.coalesce(self.number(part + 1), F.when(self.found(), 0).otherwise(minute) if minute else F.lit(0))

    def page_clock(self, part: int) -> tuple[Column, Column]:
        """Hour and minute of a PAGE_CLOCK that begins with that part; an hour without its half of the day counts as it is."""
        hour, half = F.coalesce(self.number(part), self.number(part + 3)), F.lower(F.coalesce(self.word(part + 2), self.word(part + 4)))
        hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
        return hour, F.coalesce(self.number(part + 1), F.lit(0))


def _day(year: Column, month: Column, number: Column) -> Column:
    """A date, null where there is no such day."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, number, zero, zero, zero).cast("date")


def _wall(day: Column, clock: tuple[Column, Column]) -> Column:
    """A local wall-clock time, null where there is no such clock time."""
    hour, minute = clock
    return F.when((hour < 24) & (minute < 60), F.timestamp_add("MINUTE", (hour * 60 + minute).cast("int"), day.cast("timestamp")))


def flexible_datetime(text: Column, reference: Column, tz: str = TZ, hour: int = 19, minute: int = 0) -> Column:
    """UTC instant of an ISO date, or month and day (and year), with an am/pm time or the default; null if there is none.

    Without a date the reference date counts; an impossible ISO date counts as the reference too, an impossible month-day
    as none.
    """
    t = F.trim(text)
    iso, named = _Form(t, ISO_DAY), _Form(t, rf"{ANY_NAME}\s+{NUMBER}(?:[,\s]+{YEAR})?")
    iso_day = F.coalesce(_day(iso.number(1), iso.number(2), iso.number(3)), reference)
    named_day = _day(F.coalesce(named.number(3), F.year(reference)), named.month(1), named.number(2))
    day = F.when(iso.found(), iso_day).when(named.found(), named_day).otherwise(reference)
    return F.when(F.length(t) > 0, F.to_utc_timestamp(_wall(day, _Form(t, rf"{CLOCK}\b").clock(1, hour, minute)), tz))


def card_instant(date_text: Column, time_text: Column, reference: Column, tz: str = TZ, hour: int = 19) -> Column:
    """UTC instant of a card's day, an ISO date or a month's three letters and a day (and year, else the reference's), at the
    time of its time text or the default hour; null without a day or with one that is none."""
    iso, named = _Form(date_text, rf"{YEAR}-(\d{{1,2}})-(\d{{1,2}})"), _Form(date_text, rf"([a-z]{{3}})\s+{NUMBER}(?:,\s*{YEAR})?")
    named_day = _day(F.coalesce(named.number(3), F.year(reference)), named.month(1), named.number(2))
    day = F.when(iso.found(), _day(iso.number(1), iso.number(2), iso.number(3))).otherwise(named_day)
    return F.to_utc_timestamp(_wall(day, _Form(F.coalesce(time_text, F.lit("")), CLOCK).clock(1, hour, 0)), tz)


def date_range(text: Column, reference: Column, tz: str = TZ) -> tuple[Column, Column]:
    """First and last instant of 'Feb 14–Mar 28, 2026' or 'Mar 7–31, 2026', in UTC; nulls if there is none.

    One year counts for both ends, none means the reference's. An inferred end before the start is a year later.
    """
    two, one = _Form(text, NAMED_DAY_OF_YEAR + DASH + NAMED_DAY_OF_YEAR), _Form(text, rf"{NAMED_DAY}{DASH}{NUMBER}(?:,\s*{YEAR})?")
    said1, said2, now = two.number(3), two.number(6), F.year(reference)
    first = _day(F.coalesce(said1, said2, now), two.month(1), two.number(2))
    year2 = F.coalesce(said2, said1, now)
    last = _day(year2, two.month(4), two.number(5))
    last = F.when((last < first) & (said1.isNull() | said2.isNull()), _day(year2 + 1, two.month(4), two.number(5))).otherwise(last)
    year = F.coalesce(one.number(4), now)
    same1, same2 = _day(year, one.month(1), one.number(2)), _day(year, one.month(1), one.number(3))
    across, within = first.isNotNull() & last.isNotNull(), same1.isNotNull() & same2.isNotNull()
    begin, end = (F.when(across, a).when(within, b) for a, b in ((first, same1), (last, same2)))
    return F.to_utc_timestamp(begin.cast("timestamp"), tz), F.to_utc_timestamp(end.cast("timestamp") + F.expr("INTERVAL '23:59' HOUR TO MINUTE"), tz)


def date_in_url(url: Column) -> Column:
    """The day of a path such as /events/2026/3/2/."""
    form = _Form(url, rf"/{YEAR}/{NUMBER}/{NUMBER}(?:/|$)")
    return _day(form.number(1), form.number(2), form.number(3))


def date_line(line: Column, year: Column) -> Column:
    """The day of a line that begins with a weekday, a month and a number; null where the weekday is not that of the day."""
    form = _Form(line, rf"^({'|'.join(WEEKDAYS)}),\s*([a-z]+)\s+{NUMBER}\b")
    whole = F.lower(form.word(2)).isin([F.lit(m) for m in FULL_MONTHS])
    day = F.when(whole, _day(year, form.month(2), form.number(3)))
    return F.when(weekday_agrees(form.word(1), day), day)


def roll_end(start: Column, end: Column) -> Column:
    """An end at or before the start belongs to the next day."""
    return F.when(end <= start, end + F.expr("INTERVAL 1 DAY")).otherwise(end)


def relative_weekday(weekday: Column, posted: Column, is_next: Column) -> Column:
    """Date of the next weekday (Monday 0) from the posting date; 'next' adds a week only on the same weekday."""
    ahead = F.pmod(weekday - F.weekday(posted), F.lit(7))
    return F.date_add(posted, (ahead + F.when(is_next & (ahead == 0), 7).otherwise(0)).cast("int"))


def roll_year(day: Column, issued: Column, slack_days: int = 60) -> Column:
    """A date long before its issue means the next year; 29 February stays."""
    later = F.try_make_timestamp_ntz(F.year(day) + 1, F.month(day), F.dayofmonth(day), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(day < F.date_sub(issued, slack_days), F.coalesce(later, day)).otherwise(day)


def weekday_agrees(name: Column, day: Column) -> Column:
    return F.lower(F.date_format(day, "EEEE")) == F.lower(F.trim(name))


def iso_instant(text: Column, tz: str = "UTC") -> Column:
    """ISO text to an instant; naive text is local to tz, bad text null."""
    zoned = F.try_to_timestamp(text)
    has_zone = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_zone, zoned).otherwise(F.to_utc_timestamp(zoned, tz))


def local_hour(instant: Column, tz: str = TZ) -> Column:
    return F.hour(F.from_utc_timestamp(instant, tz))


def _at(day: Column, clock: str) -> Column:
    return F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(clock)))


def window_of(label: Column, as_of: Column, tz: str = TZ) -> tuple[Column, Column]:
    """UTC window of a timeframe label, from local wall-clock days."""
    today = F.from_utc_timestamp(as_of, tz).cast("date")
    weekday = F.coalesce(*[F.when(label == f"this_{d}", i) for i, d in enumerate(WEEKDAYS)])
    target = F.date_add(today, F.pmod(weekday - F.weekday(today), F.lit(7)).cast("int"))
    saturday = F.date_add(today, F.pmod(5 - F.weekday(today), F.lit(7)).cast("int"))
    tomorrow = F.date_add(today, 1)
    start = (
        F.when(label == "tonight", _at(today, "18:00:00"))
        .when(label == "tomorrow", _at(tomorrow, "10:00:00"))
        .when(weekday.isNotNull(), _at(target, "10:00:00"))
        .when(label == "this_weekend", _at(saturday, "10:00:00"))
    )
    end = (
        F.when(label == "tonight", _at(F.date_add(today, 1), "03:00:00"))
        .when(label == "tomorrow", _at(F.date_add(tomorrow, 1), "02:00:00"))
        .when(weekday.isNotNull(), _at(F.date_add(target, 1), "02:00:00"))
        .when(label == "this_weekend", _at(F.date_add(saturday, 1), "23:59:00"))
    )
    return F.coalesce(F.to_utc_timestamp(start, tz), as_of), F.coalesce(F.to_utc_timestamp(end, tz), as_of + F.expr("INTERVAL 7 DAY"))


def preset_window(preset: str, as_of: Column, tz: str = TZ) -> tuple[Column, Column]:
    """UTC window of a search preset: 'tonight' from now to 03:00, 'this_weekend' from Friday 17:00 to Monday 06:00.

    On a Saturday or Sunday the weekend is the next one.
    """
    today = F.from_utc_timestamp(as_of, tz).cast("date")
    if preset == "tonight":
        return as_of, F.to_utc_timestamp(_at(F.date_add(today, 1), "03:00:00"), tz)
    friday = F.date_add(today, F.pmod(4 - F.weekday(today), F.lit(7)).cast("int"))
    return F.to_utc_timestamp(_at(friday, "17:00:00"), tz), F.to_utc_timestamp(_at(F.date_add(friday, 3), "06:00:00"), tz)


def expires_at(created_at: Column, ttl_days: Column) -> Column:
    """Null or zero days: never."""
    return F.when(ttl_days > 0, F.timestamp_add("DAY", ttl_days.cast("int"), created_at))


def listing_range(text: Column, as_of: Column, tz: str = TZ) -> tuple[Column, Column]:
    """Start and end of a listing such as 'Sat Mar 7 10pm-4am', in UTC; 20:00 to 23:59 without a range, nulls without a day.

    The year is that of now, but for a January listed in December and a December listed in January.
    """
    named, span = _Form(text, rf"\b{NAMED_DAY}\b"), _Form(text, rf"{CLOCK}\s*-\s*{CLOCK}")
    today, month = F.from_utc_timestamp(as_of, tz), named.month(1)
    turn = F.when((F.month(today) == 12) & (month == 1), 1).when((F.month(today) == 1) & (month == 12), -1).otherwise(0)
    day = _day(F.year(today) + turn, month, named.number(2))
    start, end = _wall(day, span.clock(1, 20, 0)), _wall(day, span.clock(4, 23, 59))
    return F.to_utc_timestamp(start, tz), F.to_utc_timestamp(roll_end(start, end), tz)


def end_of_range(text: Column, start: Column, tz: str = TZ) -> Column:
    """The end of a time range on the start's local day, or the next if it is not later; null without a second time."""
    second = F.get(F.regexp_extract_all(text, F.lit(f"(?i){CLOCK}"), 0), F.lit(1))
    local = F.from_utc_timestamp(start, tz)
    return F.to_utc_timestamp(roll_end(local, _wall(local, _Form(second, CLOCK).clock(1, None, None))), tz)


def absolute_date(text: Column) -> Column:
    """'Sunday, March 1, 2026', 'March 1, 2026' or an ISO date; null for anything else."""
    named, iso = _Form(text, rf"{ANY_NAME}\s+{NUMBER},\s+{YEAR}"), _Form(text, ISO_DAY)
    return F.coalesce(_day(named.number(3), named.month(1), named.number(2)), _day(iso.number(1), iso.number(2), iso.number(3)))


def page_times(full_text: Column, date_text: Column, as_of: Column, tz: str = TZ) -> tuple[Column, Column]:
    """Start and end of a detail page in UTC: a relative day or a full date (else nulls), the first time of the text (else
    midnight), and an end behind 'to', 'until' or a dash somewhere after it."""
    today, low = F.from_utc_timestamp(as_of, tz).cast("date"), F.lower(date_text)
    day = F.when(low.contains("today") | low.contains("tonight"), today).when(low.contains("tomorrow"), F.date_add(today, 1)).when(low.contains("yesterday"), F.date_sub(today, 1)).otherwise(absolute_date(date_text))
    hour, minute = _Form(full_text, PAGE_CLOCK).page_clock(1)
    start = _wall(day, (F.coalesce(hour, F.lit(0)), minute))
    end = _wall(day, _Form(full_text, rf"(?s){PAGE_CLOCK}.*?{UNTIL}{PAGE_CLOCK}").page_clock(6))
    return F.to_utc_timestamp(start, tz), F.to_utc_timestamp(roll_end(start, end), tz)


# Fixed value: a month's name, whole or cut, with a number, or an ISO date.
EXPLICIT_DATE = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b|\b\d{4}-\d{2}-\d{2}\b"


def explicit_date(text: Column) -> Column:
    """Whether a text names a day."""
    return text.rlike(EXPLICIT_DATE)


def local_clock(instant: Column, tz: str = TZ) -> Column:
    """'7:30 PM'."""
    return F.date_format(F.from_utc_timestamp(instant, tz), "h:mm a")


def local_day(instant: Column, tz: str = TZ) -> Column:
    """'Sat, Aug 8'."""
    return F.date_format(F.from_utc_timestamp(instant, tz), "EEE, MMM d")


def local_when(instant: Column, tz: str = TZ) -> Column:
    """'Sat Aug 8 7:30pm'."""
    local = F.from_utc_timestamp(instant, tz)
    return F.concat(F.date_format(local, "EEE MMM d "), F.lower(F.date_format(local, "h:mma")))
