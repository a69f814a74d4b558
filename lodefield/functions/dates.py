"""Spans of time that questions name, and dates in prose."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_PAST = re.compile(r"\b(?:did|was|were|had|said|told|asked|mentioned|talked|discussed|happened|went|made|ago|last|yesterday|remember|recall|wrote|worked|met)\b")
_COUNT = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1}


# What stands before a day that bounds a range.
BOUNDS = tuple(" before, after, since, until, between, through, from, as of, earlier than, later than".split(","))


def _month_on(d: date, n: int) -> date:
    at = d.year * 12 + d.month - 1 + n
    return date(at // 12, at % 12 + 1, 1)


def window(question: str, now: datetime) -> tuple[datetime, datetime, str] | None:
    """The half-open span of days that a question about the past names, and its name: a day, week, month or year before or
    around now, some days, weeks, months or years ago, a weekday, a month, a year or an ISO day. Weeks begin on Monday;
    the past month is 30 days. None where no span is named, where the question is not about the past, or where an ISO
    day only bounds a range."""
    text = re.sub(r"[^a-z0-9'-]+", " ", question.lower()).strip()
    today = now.date()
    iso = re.search(r"\b(\d{4})-(\d{2})-(\d{2})\b", text)
    if iso and text[: iso.start()].rstrip().endswith(BOUNDS):
        return None
    if not _PAST.search(text):
        return None

    def span(start: date, end: date, name: str) -> tuple[datetime, datetime, str]:
        return datetime(start.year, start.month, start.day), datetime(end.year, end.month, end.day), name

    one, week, month = timedelta(days=1), today - timedelta(days=today.weekday()), today.replace(day=1)
    if iso:
        try:
            day = date(*map(int, iso.groups()))
        except ValueError:
            return None
        return span(day, day + one, iso[0])
    if "the day before yesterday" in text:
        return span(today - 2 * one, today - one, "the day before yesterday")
    for name, start, end in (
        ("yesterday", today - one, today),
        ("last night", today - one, today),
        ("today", today, today + one),
        ("this week", week, week + 7 * one),
        ("last week", week - 7 * one, week),
        ("past week", today - 7 * one, today + one),
        ("this month", month, _month_on(month, 1)),
        ("last month", _month_on(month, -1), month),
        ("past month", today - 30 * one, today + one),
        ("this year", date(today.year, 1, 1), date(today.year + 1, 1, 1)),
        ("last year", date(today.year - 1, 1, 1), date(today.year, 1, 1)),
    ):
        if re.search(rf"\b{name}\b", text):
            return span(start, end, name)
    ago = re.search(rf"\b(\d+|{'|'.join(_COUNT)}) (day|week|month|year)s? ago\b", text)
    if ago:
        n = int(ago[1]) if ago[1].isdigit() else _COUNT[ago[1]]
        if ago[2] == "day":
            return span(today - n * one, today - (n - 1) * one, ago[0])
        if ago[2] == "week":
            return span(week - 7 * n * one, week - 7 * (n - 1) * one, ago[0])
        if ago[2] == "month":
            return span(_month_on(month, -n), _month_on(month, 1 - n), ago[0])
        return span(date(today.year - n, 1, 1), date(today.year - n + 1, 1, 1), ago[0])
    day = re.search(rf"\b(?:on|last) ({'|'.join(DAYS)})\b", text)
    if day:
        back = (today.weekday() - DAYS.index(day[1])) % 7 or 7
        return span(today - back * one, today - (back - 1) * one, day[1])
    named = re.search(rf"\bin ({'|'.join(MONTHS)})(?: (\d{{4}}))?\b", text)
    if named:
        m = MONTHS.index(named[1]) + 1
        start = date(int(named[2]), m, 1) if named[2] else date(today.year if m <= today.month else today.year - 1, m, 1)
        return span(start, _month_on(start, 1), named[0][3:])
    year = re.search(r"\bin (\d{4})\b", text)
    if year and 1 <= int(year[1]) < 9999:
        return span(date(int(year[1]), 1, 1), date(int(year[1]) + 1, 1, 1), year[1])
    return None


def window_factor(at: Column, start: datetime, end: datetime) -> Column:
    """What a score is multiplied by: 1.35 inside the span, less the further away, 0.65 at least."""
    lo, hi = F.lit(start), F.lit(end)
    seconds = lambda a, b: (F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400.0
    days = F.when(at < lo, seconds(lo, at)).when(at >= hi, seconds(at, hi)).otherwise(0.0)
    return F.when((at >= lo) & (at < hi), 1.35).when(at.isNull(), 1.0).otherwise(0.65 + 0.35 / (1 + days / 7.0))


def prose_date(text: Column, said_on: Column) -> Column:
    """The first date that a text names: an ISO day, a month's day with its year, or so many days, weeks or months before or
    after the day it was said on; null without one."""
    months = "|".join(MONTHS)
    grab = lambda pattern, i: F.regexp_extract(text, rf"(?i){pattern}", i)
    iso = grab(r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    american, british = rf"\b({months})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({months}),?\s+(\d{{4}})\b"
    number = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("string")
    made = lambda y, m, d: F.try_to_timestamp(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    amount = rf"\b(\d+|{'|'.join(_COUNT)})\s+(day|week|month)s?\s+(ago|later|from now)\b"
    counts = F.create_map(*(F.lit(x) for p in _COUNT.items() for x in p))
    n = F.coalesce(F.try_element_at(counts, F.lower(grab(amount, 1))), F.when(grab(amount, 1).rlike(r"^\d+$"), grab(amount, 1)).cast("int"))
    way = F.when(F.lower(grab(amount, 3)) == "ago", -n).otherwise(n)
    unit = F.lower(grab(amount, 2))
    moved = F.when(unit == "day", F.date_add(said_on, way)).when(unit == "week", F.date_add(said_on, way * 7)).when(unit == "month", F.add_months(said_on, way))
    return F.coalesce(
        F.when(iso != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")),
        F.when(grab(american, 1) != "", made(grab(american, 3), number(grab(american, 1)), grab(american, 2))),
        F.when(grab(british, 1) != "", made(grab(british, 3), number(grab(british, 2)), grab(british, 1))),
        F.when(grab(r"\b(yesterday)\b", 1) != "", F.date_sub(said_on, 1)),
        F.when(grab(r"\b(tomorrow)\b", 1) != "", F.date_add(said_on, 1)),
        moved,
    )
