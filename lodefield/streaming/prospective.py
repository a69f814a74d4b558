"""Intentions that wait for signals or times, and working memory with a lifetime and a capacity: keyed state with timers.

Rows are not acted on as they come but when the watermark passes their time, in the order of (time, id): until then they
wait in the state, under a timer. So late rows take their place, rows that come twice count once, and what the state holds
of a user is what has not ended. A key is a block of users.
"""

from __future__ import annotations

import bisect
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Intentions as initial state: kind is event, exact_time or time_window; times are in microseconds, of which -1 is none.
INTENTIONS = "intention_id long, kind string, event_type string, least double, due long, until long, step long, most long"
_INTENTION = "user_id long, " + INTENTIONS + ", n long, used_at long, used_id long"
_WAITING = "at long, id long, user_id long, event_type string, value double"
FIRED = "user_id long, intention_id long, occurrence long, event_id long, fired_at timestamp"
LEFT = "user_id long, event_id long, reason string, left_at timestamp"
#: Rows that a row of state holds.
MOST_IN_ONE = 4096
#: A block has two to this power of neighbouring user_ids.
USERS_BITS = 5


def ready(spark: SparkSession) -> SparkSession:
    """Keyed state of more than one variable needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def micros(c) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows whose last column is a time in microseconds."""
    pdf = pd.DataFrame(rows, columns=columns)
    return pdf.assign(**{columns[-1]: pdf[columns[-1]].to_numpy("datetime64[us]")})


def _ms(us: int) -> int:
    """The first millisecond at which a time has come."""
    return -(-us // 1000)


class _Rows:
    """Rows of a block in a list state, many by their columns in one of its rows: each of these is sent and converted by
    itself, which takes longer than what is done with it."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str):
        self.state = handle.getListState(name, ", ".join("{} array<{}>".format(*f.split()) for f in schema.split(", ")))

    def get(self) -> list[tuple]:
        return [r for part in self.state.get() for r in zip(*part)] if self.state.exists() else []

    @staticmethod
    def _parts(rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[i : i + MOST_IN_ONE]))) for i in range(0, len(rows), MOST_IN_ONE)]

    def add(self, rows: list[tuple]) -> None:
        if rows:
            self.state.appendList(self._parts(rows))

    def put(self, rows: list[tuple]) -> None:
        if rows:
            self.state.put(self._parts(rows))
        else:
            self.state.clear()


class _Waiting:
    """Rows of a block that the watermark has not passed, with a timer for the first of them."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.state = handle, _Rows(handle, "waiting", _WAITING)

    def add(self, new: pd.DataFrame) -> None:
        own = sorted(set(zip(*(new[f.split()[0]].tolist() for f in _WAITING.split(", ")))))
        if own:
            self.state.add(own)
            self.handle.registerTimer(_ms(own[0][0]))

    def split(self, upto_ms: int) -> tuple[list[tuple], list[tuple]]:
        """What has come by that time and what has not, in order and each once."""
        rows = sorted(set(self.state.get()))
        now = bisect.bisect_right(rows, upto_ms, key=lambda r: _ms(r[0]))
        return rows[:now], rows[now:]

    def keep(self, later: list[tuple]) -> None:
        self.state.put(later)
        if later:
            self.handle.registerTimer(_ms(later[0][0]))


class Prospective(StatefulProcessor):
    """Fires intentions. One that waits for an event fires at a signal of its type, worth `least` at least, that is not
    before it is due and comes after the signal it last used; one of exact_time or time_window fires when it is due. It is
    due again `step` after the time it was due, `most` times in all; without a step it ends as it fires, and an event
    intention whose time is over (until) ends too. What has ended leaves the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting, self.intentions = handle, _Waiting(handle), _Rows(handle, "intentions", _INTENTION)

    def _awaits(self, rows: list) -> None:
        """A timer for the first time that an intention waits for."""
        times = [r[5] for r in rows if r[2] != "event"]
        if times:
            self.handle.registerTimer(_ms(min(times)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = [(int(r.user_id), int(r.intention_id), r.kind, r.event_type, float(r.least), int(r.due), int(r.until), int(r.step), int(r.most), 0, -1, -1) for r in initialState.itertuples()]
        self.intentions.add(rows)
        self._awaits(rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        users = {r[0] for r in self.intentions.get()}
        for pdf in rows:
            if users:  # signals for nobody are not kept
                self.waiting.add(pdf[pdf["user_id"].isin(users)])
        return iter(())  # no frame, not an empty one: each costs as much as many rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        before = self.intentions.get()
        held, of, out = [list(r) for r in before], defaultdict(list), []
        for r in held:
            if r[2] == "event":
                of[r[0], r[3]].append(r)

        def fired(r: list, at: int, event_id: int | None) -> None:
            out.append((r[0], r[1], r[9], event_id, at))
            r[9] += 1
            r[5] = r[5] + r[7] if r[7] > 0 and (r[8] < 0 or r[9] < r[8]) else None  # None: it has ended
            if r[5] is not None and r[6] >= 0:
                r[6] += r[7]

        for r in held:
            while r[5] is not None and r[2] != "event" and _ms(r[5]) <= now:
                fired(r, r[5], None)
        come, later = self.waiting.split(now)
        for at, event_id, user, event_type, value in come:
            for r in of.get((user, event_type), ()):
                if r[5] is not None and not 0 <= r[6] <= at and value >= r[4] and at >= r[5] and (at, event_id) > (r[10], r[11]):
                    r[10], r[11] = at, event_id
                    fired(r, at, event_id)
        last = {r[2]: r[0] for r in come}  # of each user
        left = [r for r in held if r[5] is not None and not (r[2] == "event" and 0 <= r[6] <= last.get(r[0], -1))]
        if len(left) < len(held):
            users = {r[0] for r in left}
            kept = [r for r in later if r[2] in users]
        else:
            kept = later
        if come or len(kept) < len(later):
            self.waiting.keep(kept)
        left = [tuple(r) for r in left]
        if left != before:
            self.intentions.put(left)
        self._awaits(left)
        if out:
            yield _frame(out, ["user_id", "intention_id", "occurrence", "event_id", "fired_at"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


class Memory(StatefulProcessor):
    """Users' items by age: one leaves when its lifetime is over (expired), or when `capacity` newer ones of its user are
    there (evicted)."""

    def __init__(self, ttl_us: int, capacity: int):
        self.ttl, self.capacity = ttl_us, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting, self.items = handle, _Waiting(handle), _Rows(handle, "items", "user_id long, at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.add(pdf)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        before, of, out = self.items.get(), defaultdict(deque), []
        for user, at, event_id in before:
            of[user].append((at, event_id))

        def outlived(user: int, items: deque, at: int) -> None:
            while items and items[0][0] + self.ttl <= at:
                first = items.popleft()
                out.append((user, first[1], "expired", first[0] + self.ttl))

        come, later = self.waiting.split(now)
        for at, event_id, user, _, _ in come:
            items = of[user]
            outlived(user, items, at)
            items.append((at, event_id))
            if len(items) > self.capacity:
                out.append((user, items.popleft()[1], "evicted", at))
        for user, items in of.items():
            outlived(user, items, 1000 * now)
        if come:
            self.waiting.keep(later)
        left = [(user, *x) for user, items in of.items() for x in items]
        if left:
            self.handle.registerTimer(_ms(min(r[1] for r in left) + self.ttl))
        if left != before:
            self.items.put(left)
        if out:
            yield _frame(out, ["user_id", "event_id", "reason", "left_at"])

    def close(self) -> None:
        pass


def _block(user: Column) -> Column:
    """The users of a block are one key: a key is set, read, written and timed by calls that take longer than its rows. A
    block is so many neighbouring numbers, whatever the number of users."""
    return F.shiftright(user.cast("long"), USERS_BITS).alias("block")


def _signals(stream: DataFrame, late: str):
    own = stream.select(_block(F.col("user_id")), "user_id", F.col("ts").alias("time"), micros(F.col("ts")).alias("at"), F.col("event_id").alias("id"), "event_type", "value")
    return own.withWatermark("time", late).groupBy("block")


def fired(stream: DataFrame, intentions: DataFrame, late: str = "1 hour") -> DataFrame:
    """(user_id, intention_id, occurrence, event_id, fired_at) of intentions (user_id and the columns of INTENTIONS) over a
    stream of signals (event_id, ts, user_id, event_type, value) that come up to `late` late; event_id is null where a time
    was waited for. Signals without a user, an id or a time are passed over; one without a value is worth nothing."""
    ready(stream.sparkSession)
    fine = stream.where("user_id is not null and event_id is not null and ts is not null").withColumns({"value": F.coalesce("value", F.lit(float("-inf"))), "event_type": F.coalesce("event_type", F.lit(""))})
    held = intentions.select(_block(F.col("user_id")), "user_id", *(f.split()[0] for f in INTENTIONS.split(", "))).groupBy("block")
    return _signals(fine, late).transformWithStateInPandas(Prospective(), FIRED, "append", "eventTime", initialState=held)


def forgotten(stream: DataFrame, ttl: str, capacity: int, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, reason, left_at) of items (event_id, ts, user_id) that leave a user's working memory."""
    ready(stream.sparkSession)
    fine = stream.where("user_id is not null and event_id is not null and ts is not null").withColumns({"value": F.lit(0.0), "event_type": F.lit("")})
    return _signals(fine, late).transformWithStateInPandas(Memory(pd.Timedelta(ttl).value // 1000, capacity), LEFT, "append", "eventTime")
