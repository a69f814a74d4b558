"""Streams over tables that are folders, and keyed state: late, replayed and odd rows, recurrence, expiry, eviction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodefield.operators.lineage import new_path
from lodefield.streaming import prospective, streams

T0 = dt.datetime(2024, 1, 1)
EVENTS = streams.EVENTS


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def us(hours):
    return int((at(hours) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def folder(spark, *batches):
    """A folder whose event table is a folder with a file for each batch, read one in a batch in their order."""
    import time

    path = new_path(spark, "events")
    for rows in batches:
        spark.createDataFrame([(i, at(h), u, kind, value, "{}") for i, h, u, kind, value in rows], EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
        time.sleep(1.1)  # files are taken by their times
    return path


def test_a_table_that_is_a_folder(spark):
    path = folder(spark, [(1, 0, 7, "a", 1.0)], [(2, 1, 7, "a", 1.0), (3, 50, 7, "a", 1.0)])
    assert streams.drained(streams.events(spark, path)).count() == 3
    assert streams.drained(streams.sessions(streams.events(spark, path))).count() == 1
    one = new_path(spark, "events")
    spark.read.parquet(f"{path}/events.parquet").coalesce(1).write.parquet(one)
    name = next(f.rsplit("/", 1)[1] for f in spark.read.parquet(one).inputFiles())
    assert streams.drained(streams.events(spark, one, name)).count() == 3  # a table that is a file
    with pytest.raises(FileNotFoundError):
        streams.events(spark, path, "nothing.parquet")


def run(spark, path, intentions):
    rows = [(u, i, kind, event_type, least, due, until, step, most) for u, i, kind, event_type, least, due, until, step, most in intentions]
    held = spark.createDataFrame(rows, "user_id long, " + prospective.INTENTIONS)
    got = streams.drained(prospective.fired(streams.events(spark, path, most_files=1), held))
    return sorted((r["user_id"], r["intention_id"], r["occurrence"], r["event_id"], r["fired_at"]) for r in got.withColumn("event_id", F.coalesce("event_id", F.lit(-1))).collect())


def test_signals(spark):
    """Signals come late and twice, in any order, and are used in the order of their times, each once."""
    hour = 3_600_000_000
    first = [(1, 0, 7, "buy", 5.0), (3, 10, 7, "buy", 5.0), (3, 10, 7, "buy", 5.0), (9, 10.5, 7, "buy", 1.0), (5, 10, 8, "buy", 9.0), (6, 11, None, "buy", 9.0)]
    second = [(2, 9.7, 7, "buy", 5.0), (3, 10, 7, "buy", 5.0), (4, 16, 7, "buy", 5.0), (7, 18, 7, "buy", None)]  # 2 is late, 3 comes again
    third = [(8, 40, 7, "buy", 5.0), (10, 60, 7, "other", 0.0)]
    got = run(spark, folder(spark, first, second, third), [(7, 1, "event", "buy", 2.0, us(1), -1, 6 * hour, 3), (7, 2, "event", "buy", 2.0, us(1), -1, -1, -1), (9, 1, "event", "buy", 0.0, us(0), -1, -1, -1)])
    assert got == [(7, 1, 0, 2, at(9.7)), (7, 1, 1, 3, at(10)), (7, 1, 2, 4, at(16)), (7, 2, 0, 2, at(9.7))]


def test_times_and_ends(spark):
    """Times fire as the watermark passes them, again and again up to the most; what has ended fires no more."""
    day = 86_400_000_000
    signals = [(i, 12 * i, 1, "tick", 0.0) for i in range(1, 16)]
    intentions = [(1, 1, "exact_time", "", 0.0, us(24), -1, 2 * day, 2), (1, 2, "time_window", "", 0.0, us(48), us(60), day, -1), (1, 3, "event", "tick", 0.0, us(10), us(20), -1, -1), (1, 4, "event", "tick", 0.0, us(1), us(5), -1, -1), (2, 5, "exact_time", "", 0.0, us(30), -1, -1, -1)]
    got = run(spark, folder(spark, signals[:5], signals[5:]), intentions)
    want = [(1, 1, 0, -1, at(24)), (1, 1, 1, -1, at(72)), (1, 3, 0, 1, at(12)), (2, 5, 0, -1, at(30))]
    want += [(1, 2, k, -1, at(48 + 24 * k)) for k in range(6) if 48 + 24 * k <= 179]
    assert got == sorted(want)


def test_working_memory(spark):
    """Against a walk over the items in order, with late and repeated rows."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.randint(0, 400) / 4, rng.randint(1, 3), "x", 0.0) for i in range(120)]
    rows.sort(key=lambda r: r[1])
    batches = [rows[:50] + rows[:5], rows[52:], [(200, 300, 1, "x", 0.0)]]
    batches[0] += [rows[51]]
    got = streams.drained(prospective.forgotten(streams.events(spark, folder(spark, *batches), most_files=1), "10 hours", 4, late="1 hour"))
    want, kept = [], {}
    for i, h, u, *_ in sorted((r for r in rows if r is not rows[50]), key=lambda r: (r[1], r[0])):
        own = kept.setdefault(u, [])
        while own and own[0][1] + 10 <= h:
            want.append((u, own[0][0], "expired", at(own.pop(0)[1] + 10)))
        own.append((i, h))
        if len(own) > 4:
            want.append((u, own.pop(0)[0], "evicted", at(h)))
    want += [(u, i, "expired", at(h + 10)) for u, own in kept.items() for i, h in own]
    assert sorted(map(tuple, got.collect())) == sorted(want)


class Calls:
    """Stands for the handle and the state of one key, and counts the calls and the rows of state that they send."""

    def __init__(self):
        self.lists, self.calls, self.sent = {}, 0, 0

    def getListState(self, name, schema):
        outer, held = self, self.lists.setdefault(name, [])

        class State:
            def exists(self):
                outer.calls += 1
                return bool(held)

            def get(self):
                outer.calls += 1
                return iter(list(held))

            def appendList(self, rows):
                outer.calls, outer.sent = outer.calls + 1, outer.sent + len(rows)
                held.extend(rows)

            def put(self, rows):
                held.clear()
                self.appendList(rows)

            def clear(self):
                outer.calls += 1
                held.clear()

        return State()

    def registerTimer(self, at_ms):
        self.calls += 1


def test_calls_do_not_grow_with_rows_or_users(spark):
    """Neighbouring users are one key, whose rows are sent together; an initial state that comes in parts is kept whole."""
    import types

    import pandas as pd

    users = spark.range(64).select(F.col("id").alias("user_id")).select(prospective._block(F.col("user_id"))).distinct()
    assert users.count() == 2
    times = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: us(30) // 1000)
    expired = types.SimpleNamespace(getExpiryTimeInMs=lambda: us(0) // 1000)
    rows = pd.DataFrame([(us(h), 100 * u + h, u, "buy", 1.0) for u in range(32) for h in range(40)], columns=["at", "id", "user_id", "event_type", "value"])
    memory, handle = prospective.Memory(36 * 3_600_000_000, 4), Calls()
    memory.init(handle)
    assert list(memory.handleInputRows((0,), iter([rows, rows]), times)) == []
    out = pd.concat(memory.handleExpiredTimer((0,), times, expired))
    assert sorted(zip(out["user_id"], out["event_id"], out["reason"], out["left_at"])) == [(u, 100 * u + h, "evicted", at(h + 4)) for u in range(32) for h in range(27)]
    assert handle.calls <= 20 and handle.sent <= 6
    firing, handle = prospective.Prospective(), Calls()
    firing.init(handle)
    for part in (range(0, 16), range(16, 32)):
        held = [(u, 1, "event", "buy", 1.0, us(2), -1, -1, 1) for u in part]
        firing.handleInitialState((0,), pd.DataFrame(held, columns=["user_id", *(f.split()[0] for f in prospective.INTENTIONS.split(", "))]), times)
    assert list(firing.handleInputRows((0,), iter([rows]), times)) == []
    out = pd.concat(firing.handleExpiredTimer((0,), times, expired))
    assert sorted(zip(out["user_id"], out["event_id"], out["fired_at"])) == [(u, 100 * u + 2, at(2)) for u in range(32)]
    assert handle.calls <= 20 and not any(handle.lists.values())
