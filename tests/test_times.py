"""Times that texts name, rule by rule, in zones, across changes of the clocks, whatever the session's zone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodefield.functions import times

NOW = dt.datetime(2024, 3, 13, 15, 30)  # a Wednesday, 16:30 in Berlin
D = dt.date


def t(*x):
    return dt.datetime(2024, *x)


#: text, zone, and rule, status, reason, precision, start, end
DUE = [
    ("meet Ann tomorrow at 5pm", "Europe/Berlin", "tomorrow", "resolved", None, "instant", t(3, 14, 16), t(3, 14, 16)),
    ("Until the day after tomorrow", "Europe/Berlin", "day_after_tomorrow", "resolved", None, "day", t(3, 14, 23), t(3, 15, 23)),
    ("we finish today at 18:15", "America/New_York", "today", "resolved", None, "instant", t(3, 13, 22, 15), t(3, 13, 22, 15)),
    ("I paid yesterday", "UTC", "yesterday", "resolved", None, "day", t(3, 12), t(3, 13)),
    ("pay by Friday", "UTC", "weekday", "ambiguous", "weekday_reference_ambiguous", "day", None, None),
    ("pay this wednesday", "UTC", "weekday", "resolved", None, "day", t(3, 13), t(3, 14)),
    ("pay coming wednesday", "UTC", "weekday", "resolved", None, "day", t(3, 20), t(3, 21)),
    ("in twenty-one days", "UTC", "offset", "resolved", None, "day", t(4, 3), t(4, 4)),
    ("in a week", "UTC", "offset", "resolved", None, "day", t(3, 20), t(3, 21)),
    ("in 2 months", "UTC", "offset", "resolved", None, "day", t(5, 13), t(5, 14)),
    ("in 90 minutes", None, "offset", "ambiguous", "timezone_required", "unknown", None, None),
    ("in 90 minutes", "Asia/Tokyo", "offset", "resolved", None, "instant", t(3, 13, 17), t(3, 13, 17)),
    ("in 99999999999999999999 days", "UTC", "offset", "ambiguous", "date_out_of_range", "unknown", None, None),
    ("on March 5", "UTC", "month_day", "ambiguous", "year_required", "unknown", None, None),
    ("on March 5th, 2024 at noon", "UTC", "month_day", "resolved", None, "instant", t(3, 5, 12), t(3, 5, 12)),
    ("5 Sep 2024", "UTC", "day_month", "resolved", None, "day", t(9, 5), t(9, 6)),
    ("31 Feb 2024", "UTC", "day_month", "ambiguous", "invalid_date", "unknown", None, None),
    ("2024-02-30", "UTC", "iso", "ambiguous", "invalid_date", "unknown", None, None),
    ("2024-05-01", None, "iso", "ambiguous", "timezone_required", "day", None, None),
    ("2024-05-01 at midnight", "Europe/Berlin", "iso", "resolved", None, "instant", t(4, 30, 22), t(4, 30, 22)),
    ("2024-03-31 at 2:30am", "Europe/Berlin", "iso", "ambiguous", "daylight_saving_transition", "day", None, None),
    ("2024-10-27 at 2:30am", "Europe/Berlin", "iso", "ambiguous", "daylight_saving_transition", "day", None, None),
    ("2024-10-27", "Europe/Berlin", "iso", "resolved", None, "day", t(10, 26, 22), t(10, 27, 23)),
    ("tomorrow at 5", "UTC", "tomorrow", "ambiguous", "meridiem_required", "day", None, None),
    ("tomorrow at 25:00", "UTC", "tomorrow", "ambiguous", "invalid_time", "day", None, None),
    ("tomorrow at 0:10 am", "UTC", "tomorrow", "ambiguous", "invalid_time", "day", None, None),
    ("tomorrow", "Mars/Base", "tomorrow", "ambiguous", "unknown_timezone", "unknown", None, None),
    ("nothing of the kind", "UTC", None, "unknown", None, "unknown", None, None),
    (None, "UTC", None, "unknown", None, "unknown", None, None),
]

#: question, zone, and label, start, end (None: no span)
ASKED = [
    ("What did I say yesterday morning?", "Europe/Berlin", "yesterday morning", t(3, 12, 4), t(3, 12, 11)),
    ("What happened last night", "Europe/Berlin", "last night", t(3, 12, 17), t(3, 13, 4)),
    ("Who did I meet the day before yesterday?", "UTC", "the day before yesterday", t(3, 11), t(3, 12)),
    ("What did we discuss three days ago in the evening", "UTC", "three days ago evening", t(3, 10, 17), t(3, 11)),
    ("What did we discuss two weeks ago", "UTC", "two weeks ago", t(2, 26), t(3, 4)),
    ("did I go on friday", "UTC", "friday", t(3, 8), t(3, 9)),
    ("did I go on Wednesday", "UTC", "wednesday", t(3, 13), t(3, 14)),
    ("did I go last Wednesday", "UTC", "wednesday", t(3, 6), t(3, 7)),
    ("what did I buy in March", "UTC", "march", t(3, 1), t(4, 1)),
    ("what did I buy in April", "UTC", "april", dt.datetime(2023, 4, 1), dt.datetime(2023, 5, 1)),
    ("what did I buy during march 2023", "UTC", "march 2023", dt.datetime(2023, 3, 1), dt.datetime(2023, 4, 1)),
    ("what did I do in 2022", "UTC", "2022", dt.datetime(2022, 1, 1), dt.datetime(2023, 1, 1)),
    ("What did you tell me last month", "UTC", "last month", t(2, 1), t(3, 1)),
    ("What did you tell me last year", "UTC", "last year", dt.datetime(2023, 1, 1), t(1, 1)),
    ("did I write this week", "UTC", "this week", t(3, 11), NOW),
    ("did I write last week", "UTC", "last week", t(3, 4), t(3, 11)),
    ("what did I do over the past two weeks", "UTC", "over the past two weeks", t(2, 28), NOW),
    ("what did I do in the last month", "UTC", "in the last month", t(2, 12), NOW),
    ("what was spent since the start of the year", "UTC", "since the start of the year", t(1, 1), NOW),
    ("what did I write on 2024-02-28", "UTC", "2024-02-28", t(2, 28), t(2, 29)),
    ("what did I say this afternoon", "UTC", "this afternoon", t(3, 13, 12), t(3, 13, 17)),
    ("did I write 2024-02-30", "UTC", None, None, None),
    ("what did I write before 2024-02-28", "UTC", None, None, None),
    ("what did I do from 2024-02-01 to 2024-02-28", "UTC", None, None, None),
    ("what did I do in 2022 and in 2023", "UTC", None, None, None),
    ("what happened between monday and friday", "UTC", None, None, None),
    ("what was the date yesterday", "UTC", None, None, None),
    ("I am tired today", "UTC", None, None, None),
    ("what did I say", "UTC", None, None, None),
    (None, "UTC", None, None, None),
]


@pytest.fixture(params=["UTC", "America/New_York"])
def session(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def test_commitments(session):
    df = session.createDataFrame([(i, r[0], r[1], NOW, "x") for i, r in enumerate(DUE)], "i int, text string, zone string, at timestamp_ntz, due2 string")
    out = times.commitment_times(df, "text", "at", "zone")
    assert out.columns == [*df.columns, "due"]
    for r, want in zip(out.orderBy("i").collect(), DUE):
        d = r["due"]
        assert (d["rule"], d["status"], d["reason"], d["precision"], d["start"], d["end"]) == want[2:], want
    by = {r["text"]: r["due"] for r in out.collect()}
    assert by["pay by Friday"]["candidates"] == [D(2024, 3, 15), D(2024, 3, 22)] and by["pay by Friday"]["day"] is None
    assert by["2024-05-01"]["day"] == D(2024, 5, 1) and by["tomorrow at 5"]["day"] == D(2024, 3, 14)


def test_windows(session):
    df = session.createDataFrame([(i, r[0], r[1], NOW) for i, r in enumerate(ASKED)], "i int, q string, zone string, at timestamp_ntz")
    for r, want in zip(times.time_windows(df, "q", "at", "zone").orderBy("i").collect(), ASKED):
        a = r["asked"]
        assert ((a["label"], a["start"], a["end"]) if a else (None, None, None)) == want[2:], want


def test_instants(session):
    """UTC without a zone of an instant, whatever zone the session has."""
    got = session.range(1).select(times.utc(F.timestamp_seconds(F.lit(1_711_843_200.25))).alias("u")).first()["u"]
    assert got == dt.datetime(2024, 3, 31, 0, 0, 0, 250000)
