"""What texts say of time, row by row: when a commitment is due, and what span a question about the past asks for.

Times are UTC without a zone (timestamp_ntz) on both sides; each row's own zone gives the calendar that its words mean. A
rule is a row of a table: a pattern, and what it makes of the calendar day on which the text was said.
"""

from __future__ import annotations

import calendar
from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of days and months, numbers in words, and how a text names a time that is to come.
MONTHS = [m.lower() for m in calendar.month_name[1:]]
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
DIGITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
NUMBERS = {w: i for i, w in enumerate(DIGITS)} | {"a": 1, "an": 1} | {w: 20 + 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
_NUMBER = rf"(?:\d+|(?:{'|'.join(NUMBERS)})(?:[- ](?:{'|'.join(DIGITS[1:10])}))?)"
_MONTH = rf"(?:{'|'.join(MONTHS)}|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec|sept)"
_DAY = "|".join(DAYS)
_ISO, _NTH = r"\d{4}-\d{2}-\d{2}", r"\d{1,2}(?:st|nd|rd|th)?"
DUE = (
    rf"(?:\b(?:by|until|to|on)\s+)?\b(?:the day after tomorrow|tomorrow|today|yesterday|in {_NUMBER} (?:minutes?|hours?|days?|weeks?|months?|years?)|(?:next|this|on|coming) (?:{_DAY})|{_DAY}|{_ISO}|"
    rf"{_MONTH}\s+{_NTH}(?:,?\s+\d{{4}})?|{_NTH}\s+{_MONTH}(?:\s+\d{{4}})?)\b(?:\s+at\s+(?:noon|midnight|\d{{1,2}}(?::\d{{2}})?\s*(?:am|pm)?))?"
)
FARTHEST = 36525
COMMITMENT = "wording string, rule string, status string, reason string, precision string, day date, start timestamp_ntz, end timestamp_ntz, candidates array<date>"

# What makes a question one about the past, small numbers in words, and the hours of the parts of a day.
PAST = (
    r"\b(?:did|was|were|had|remember|recall|said|told|asked|talked|mentioned|happened|discussed|spoke|wrote|recorded|logged|messaged|replied|suggested|answered|first thing|last thing|"
    r"took|participated|spent|went|visited|bought|purchased|attended|watched|signed up|redeemed)\b"
)
FEW = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "few": 3, "a": 1}
PARTS = {"morning": (5, 12), "afternoon": (12, 17), "evening": (17, 24), "tonight": (17, 24), "night": (18, 24)}
_SOME = rf"(\d+|{'|'.join(FEW)})"


@lru_cache(maxsize=1)
def zones() -> list[str]:
    return sorted({z for z in available_timezones() if "/" in z} | {"UTC", "GMT"})


def utc(at: Column) -> Column:
    """An instant (timestamp) as UTC without a zone, whatever the session's zone."""
    micros = (F.unix_micros(at).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros)


def _within(at: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, at)


def _instant(local: Column, zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), local)


def _midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date; null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.left(F.lower(name), F.lit(3))).cast("int")


def _found(table: dict[str, int], word: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), word)


def commitment_times(rows: DataFrame, text: str, said_at: str, zone: str, name: str = "due") -> DataFrame:
    """rows with a struct of COMMITMENT: when what a text commits to is due, of the first time that it names.

    said_at is UTC without a zone, zone the name of one or null. status is resolved (start and end in UTC; a day ends where
    the next begins, an instant has no length), ambiguous (reason says why; nothing is made up: no year, no zone where the
    words need one, a weekday that can be in either of two weeks, 5 o'clock of which half, an hour that the clocks pass
    over or come to twice) or unknown (no time is named, or the text is null). rule is what kind of wording it was."""
    own = rows.withColumn("_w", F.lower(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), "(?i)" + DUE, 0)))
    w = F.col("_w")
    grab = lambda pattern, i=0: F.regexp_extract(w, pattern, i)
    named, turned = rf"({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b(?:,?\s+(\d{{4}}))?", rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})(?:\s+(\d{{4}}))?"
    some = rf"in ({_NUMBER}) (minute|hour|day|week|month|year)s?"
    weekday = F.coalesce(*(F.when(w.contains(d), i) for i, d in enumerate(DAYS)))
    kind = (
        F.when(w == "", None).when(w.rlike(_ISO), "iso").when(w.rlike(named), "month_day").when(w.rlike(turned), "day_month").when(w.contains("day after tomorrow"), "day_after_tomorrow")
        .when(w.contains("tomorrow"), "tomorrow").when(w.contains("today"), "today").when(w.contains("yesterday"), "yesterday").when(w.rlike(some), "offset").when(weekday.isNotNull(), "weekday")
    )
    known = F.array_contains(F.lit(zones()), F.col(zone))
    own = own.withColumns({"_rule": kind, "_zone": F.when(known, F.col(zone)).otherwise("UTC"), "_zoned": F.col(zone).isNotNull()})
    own = own.withColumn("_today", F.to_date(_within(F.col(said_at), F.col("_zone"))))
    rule, today = F.col("_rule"), F.col("_today")
    year = F.when(rule == "month_day", grab(named, 3)).when(rule == "day_month", grab(turned, 3))
    dated = F.when(rule == "month_day", _day(year, _month_number(grab(named, 1)), grab(named, 2))).otherwise(_day(year, _month_number(grab(turned, 2)), grab(turned, 1)))
    amount = F.when(grab(some, 1).rlike(r"^\d+$"), grab(some, 1).try_cast("long")).otherwise(F.aggregate(F.split(grab(some, 1), "[- ]"), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(_found(NUMBERS, x), F.lit(0))))
    own = own.withColumns({"_n": F.when(rule == "offset", F.when((grab(some, 1).rlike(r"^\d+$") & amount.isNull()) | (amount > FARTHEST), FARTHEST + 1).otherwise(amount)).cast("int"), "_unit": grab(some, 2)})
    n, unit = F.col("_n"), F.col("_unit")
    months = F.year(today) * 12 + F.month(today) - 1 + F.when(unit == "year", n * 12).otherwise(n)
    far = rule.eqNullSafe("offset") & (n > FARTHEST)
    moved = F.when(unit.isin("month", "year"), _day(F.floor(months / 12), months % 12 + 1, F.dayofmonth(today))).otherwise(F.date_add(today, F.when(unit == "week", n * 7).otherwise(n)))
    ahead = F.pmod(weekday - (F.dayofweek(today) + 5) % 7, F.lit(7))
    following = F.date_add(today, F.when((ahead == 0) & ~w.rlike(r"\bthis\b"), 7).otherwise(ahead))
    surely = w.rlike(r"\b(?:this|coming)\b")
    day = (
        F.when(rule == "iso", F.to_date(F.try_to_timestamp(grab(_ISO), F.lit("yyyy-MM-dd")))).when(rule.isin("month_day", "day_month"), dated).when(rule == "day_after_tomorrow", F.date_add(today, 2))
        .when(rule == "tomorrow", F.date_add(today, 1)).when(rule == "today", today).when(rule == "yesterday", F.date_add(today, -1)).when((rule == "offset") & ~unit.isin("minute", "hour") & ~far, moved)
        .when((rule == "weekday") & surely, following)
    )
    moment = (rule == "offset") & unit.isin("minute", "hour") & ~far
    own = own.withColumns({"_day": day, "_moment": F.coalesce(moment, F.lit(False)), "_clock": F.regexp_replace(F.regexp_replace(w, r"\bat\s+noon\b", "at 12:00pm"), r"\bat\s+midnight\b", "at 12:00am")})
    clock = r"\bat\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\b"
    part = lambda i: F.regexp_extract("_clock", clock, i)
    hour, minute, half = part(1).try_cast("int"), F.coalesce(part(2).try_cast("int"), F.lit(0)), part(3)
    timed = part(1) != ""
    hour24 = F.when(half != "", hour % 12 + F.when(half == "pm", 12).otherwise(0)).otherwise(hour)
    bad_time = timed & ((minute > 59) | (hour > F.when(half != "", 12).otherwise(23)) | ((half != "") & (hour == 0)))
    no_half = timed & (half == "") & (part(2) == "") & (hour <= 12)
    local = _midnight(F.col("_day")) + F.make_dt_interval(F.lit(0), F.when(bad_time, 0).otherwise(hour24), F.when(bad_time, 0).otherwise(minute))
    own = own.withColumns({"_timed": timed, "_local": F.when(timed, local)})
    at = _instant(F.col("_local"), F.col("_zone"))
    own = own.withColumn("_at", at)
    again = lambda m: _within(F.col("_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m)), F.col("_zone")) == F.col("_local")
    shifted = (_within(F.col("_at"), F.col("_zone")) != F.col("_local")) | again(60) | again(-60) | again(30) | again(-30)
    day, zoned, moment, timed = F.col("_day"), F.col("_zoned"), F.col("_moment"), F.col("_timed")
    reason = (
        F.when(rule.isNull(), None)
        .when(zoned & ~known, "unknown_timezone")
        .when(rule.isin("month_day", "day_month") & (year == ""), "year_required")
        .when(rule.isin("iso", "month_day", "day_month") & day.isNull(), "invalid_date")
        .when(~rule.isin("iso", "month_day", "day_month") & ~zoned, "timezone_required")
        .when(far, "date_out_of_range")
        .when((rule == "offset") & ~moment & day.isNull(), "invalid_relative_date")
        .when((rule == "weekday") & ~surely, "weekday_reference_ambiguous")
        .when(~zoned, "timezone_required")
        .when(~moment & bad_time, "invalid_time")
        .when(~moment & no_half, "meridiem_required")
        .when(~moment & timed & shifted, "daylight_saving_transition")
    )
    own = own.withColumn("_reason", reason)
    status = F.when(rule.isNull(), "unknown").when(F.col("_reason").isNotNull(), "ambiguous").otherwise("resolved")
    open_day = F.col("_reason").isin("weekday_reference_ambiguous", "invalid_time", "meridiem_required", "daylight_saving_transition")
    dated_only = F.col("_reason").eqNullSafe("timezone_required") & day.isNotNull() & rule.isin("iso", "month_day", "day_month")
    fine = status == "resolved"
    after = F.col(said_at) + F.make_dt_interval(F.lit(0), F.when(unit == "hour", n).otherwise(0), F.when(unit == "minute", n).otherwise(0))
    start = F.when(moment, after).when(timed, F.col("_at")).otherwise(_instant(_midnight(day), F.col("_zone")))
    end = F.when(moment | timed, start).otherwise(_instant(_midnight(F.date_add(day, 1)), F.col("_zone")))
    precision = F.when(fine & (moment | timed), "instant").when(fine | open_day | dated_only, "day").otherwise("unknown")
    shown = F.when(fine & moment, F.to_date(_within(after, F.col("_zone")))).when(fine | (open_day & (rule != "weekday")) | dated_only | (open_day & surely), day)
    two = F.when(F.col("_reason") == "weekday_reference_ambiguous", F.array(following, F.date_add(following, 7)))
    due = F.struct(w.alias("wording"), rule.alias("rule"), status.alias("status"), F.col("_reason").alias("reason"), precision.alias("precision"), shown.alias("day"), F.when(fine, start).alias("start"), F.when(fine, end).alias("end"), two.alias("candidates"))
    return own.withColumn(name, due).drop("_w", "_rule", "_zone", "_zoned", "_today", "_n", "_unit", "_day", "_moment", "_clock", "_timed", "_local", "_at", "_reason")


def time_windows(rows: DataFrame, question: str, now: str, zone: str, name: str = "asked") -> DataFrame:
    """rows with a struct (rule, label, start, end): the span that a question about the past names, in UTC, from start up to
    before end; null where it names none, is not about the past, names more than one, or only bounds a range by a day.

    Days are those of the row's zone (null or unknown: UTC). Spans that go on end now. A day's morning, afternoon, evening
    and night are its hours from 5, 12, 17 and 18 on; last night goes on until 5."""
    clean = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(question), F.lit(""))), F.lit("[a-z0-9'-]+"), 0), " ")
    own = rows.withColumns({"_q": clean, "_zone": F.when(F.array_contains(F.lit(zones()), F.col(zone)), F.col(zone)).otherwise("UTC")})
    own = own.withColumn("_now", _within(F.col(now), F.col("_zone"))).withColumn("_today", F.to_date("_now"))
    q, today = F.col("_q"), F.col("_today")
    grab = lambda pattern, i=0: F.regexp_extract(q, pattern, i)
    monday = F.date_sub(today, F.pmod(F.dayofweek(today) + 5, F.lit(7)))
    first, year = F.trunc(today, "month"), F.trunc(today, "year")
    iso = r"(?<![\w-])(?:(?:on|during|in) )?(\d{4}-\d{2}-\d{2})(?![\w-])"
    month, in_year = rf"\b(?:in|during|back in) ({'|'.join(MONTHS)})(?: (\d+))?\b", r"\b(?:in|during|back in) (\d{4})(?![\d-])\b"
    days_ago, weeks_ago = rf"\b{_SOME} days? ago\b", rf"\b{_SOME} weeks? ago\b"
    over, past = rf"\b(?:in|during|over) the (?:past|last) {_SOME} (day|week|month|year)s?\b", r"\b(?:in|during|over) the (?:past|last) (day|week|month|year)\b"
    weekday = rf"\b(?:(last|on|this past) )?({_DAY})\b"

    def some(pattern: str) -> Column:
        n = F.when(grab(pattern, 1).rlike(r"^\d+$"), grab(pattern, 1).try_cast("int")).otherwise(_found(FEW, grab(pattern, 1)))
        return F.when(n <= 700_000, n)

    def back(pattern: str, n: Column, i: int) -> Column:
        size = F.when(grab(pattern, i) == "day", 1).when(grab(pattern, i) == "week", 7).when(grab(pattern, i) == "month", 30).otherwise(365)
        return F.date_sub(today, n * size)

    back_to = F.pmod(F.pmod(F.dayofweek(today) + 5, F.lit(7)) - F.array_position(F.array(*map(F.lit, DAYS)), grab(weekday, 2)).cast("int") + 1, F.lit(7))
    back_to = F.when((back_to == 0) & grab(weekday, 1).isin("last", "this past"), 7).otherwise(back_to)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), grab(month, 1)).cast("int")
    of_year = F.when(grab(month, 2) != "", grab(month, 2).try_cast("int")).when(number <= F.month(today), F.year(today)).otherwise(F.year(today) - 1)
    named = F.when(of_year.between(1, 9998), _day(of_year, number, F.lit(1)))
    whole = F.when(grab(in_year, 1).try_cast("int").between(1, 9998), _day(grab(in_year, 1), F.lit(1), F.lit(1)))
    iso_day = F.to_date(F.try_to_timestamp(grab(iso, 1), F.lit("yyyy-MM-dd")))
    here = F.lit(None).cast("date")  # an end of null is now
    # rule, pattern, whether it is one day (which can have a part), start, end, label
    table = [
        ("iso_day", iso, False, iso_day, F.date_add(iso_day, 1), grab(iso, 1)),
        ("day_before_yesterday", r"\b(?:the )?day before yesterday\b", True, F.date_sub(today, 2), F.date_sub(today, 1), F.lit("the day before yesterday")),
        ("last_night", r"\blast night\b", False, today, today, F.lit("last night")),
        ("yesterday", r"\byesterday\b", True, F.date_sub(today, 1), today, F.lit("yesterday")),
        ("days_ago", days_ago, True, F.date_sub(today, some(days_ago)), F.date_sub(today, some(days_ago) - 1), grab(days_ago)),
        ("weeks_ago", weeks_ago, False, F.date_sub(monday, 7 * some(weeks_ago)), F.date_sub(monday, 7 * some(weeks_ago) - 7), grab(weeks_ago)),
        ("last_week", r"\blast week\b", False, F.date_sub(monday, 7), monday, F.lit("last week")),
        ("this_week", r"\bthis week\b", False, monday, here, F.lit("this week")),
        ("past_some", over, False, back(over, some(over), 2), here, grab(over)),
        ("past_one", past, False, back(past, F.lit(1), 1), here, grab(past)),
        ("year_to_date", r"\bsince the start of the year\b", False, year, here, F.lit("since the start of the year")),
        ("last_month", r"\blast month\b", False, F.add_months(first, -1), first, F.lit("last month")),
        ("this_month", r"\bthis month\b", False, first, here, F.lit("this month")),
        ("last_year", r"\blast year\b", False, F.add_months(year, -12), year, F.lit("last year")),
        ("this_year", r"\bthis year\b", False, year, here, F.lit("this year")),
        ("weekday", weekday, True, F.date_sub(today, back_to), F.date_sub(today, back_to - 1), grab(weekday, 2)),
        ("month", month, False, named, F.add_months(named, 1), F.trim(F.concat(grab(month, 1), F.lit(" "), grab(month, 2)))),
        ("year", in_year, False, whole, F.add_months(whole, 12), grab(in_year, 1)),
        ("today", r"\b(today|this (?:morning|afternoon|evening)|tonight)\b", True, today, F.date_add(today, 1), grab(r"\b(today|this (?:morning|afternoon|evening)|tonight)\b", 1)),
    ]
    # "last month" and "this year" are looked for together: the one that comes first in the text counts.
    either = r"\b(last|this) (month|year)\b"
    own = own.withColumn("_rule", F.coalesce(*(F.when((grab(either, 1) == k.split("_")[0]) & (grab(either, 2) == k.split("_")[1]), k) if k in ("last_month", "this_month", "last_year", "this_year") else F.when(q.rlike(p), k) for k, p, *_ in table)))
    rule = F.col("_rule")

    def of(i: int) -> Column:
        out = None
        for row in table:
            value = row[i] if isinstance(row[i], Column) else F.lit(row[i])
            out = F.when(rule == row[0], value) if out is None else out.when(rule == row[0], value)
        return out

    spans = F.size(F.regexp_extract_all(q, F.lit(iso), 0)) + F.size(F.regexp_extract_all(q, F.lit(month), 0)) + F.size(F.regexp_extract_all(q, F.lit(in_year), 0))
    dated = F.filter(F.split(q, " "), lambda t: t.rlike(r"^\d{4}-"))
    bounds = rf"\b(?:before|after|since|until|between|through|from|as of|earlier than|later than) {_ISO}\b"
    asks = q.rlike(PAST) & ~F.exists(dated, lambda t: ~t.rlike(rf"^{_ISO}$")) & ~q.rlike(bounds) & ~q.rlike(r"\bbetween\b.+\band\b") & ~q.rlike(r"\bwhat (?:was|is) the (?:date|day|time)\b") & (spans <= 1)
    own = own.withColumns({"_one": of(2), "_from": of(3), "_to": of(4), "_label": of(5)})
    part = F.when(F.col("_one"), F.coalesce(*(F.when(q.rlike(rf"\b{p}\b"), p) for p in PARTS)))
    own = own.withColumn("_part", part)
    part, label = F.col("_part"), F.col("_label")
    hours = lambda k: _found({p: h[k] for p, h in PARTS.items()}, part)
    plus = lambda d, h: _midnight(d) + F.make_dt_interval(F.lit(0), h)
    start = F.when(rule == "last_night", plus(F.date_sub("_from", 1), F.lit(18))).when(part.isNotNull(), plus(F.col("_from"), hours(0))).otherwise(_midnight(F.col("_from")))
    end = F.when(rule == "last_night", plus(F.col("_from"), F.lit(5))).when(part.isNotNull(), plus(F.col("_from"), hours(1))).when(F.col("_to").isNull(), F.col("_now")).otherwise(_midnight(F.col("_to")))
    shown = F.when(part.isNotNull() & ~F.contains(label, part), F.concat(label, F.lit(" "), part)).otherwise(label)
    span = F.struct(rule.alias("rule"), shown.alias("label"), _instant(start, F.col("_zone")).alias("start"), _instant(end, F.col("_zone")).alias("end"))
    asked = F.when(asks & rule.isNotNull() & F.col("_from").isNotNull(), span)
    return own.withColumn(name, asked).drop("_q", "_zone", "_now", "_today", "_rule", "_one", "_from", "_to", "_label", "_part")
