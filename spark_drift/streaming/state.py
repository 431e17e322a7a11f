"""State per particle by stateful processors: sessions closed by timers, status from a saved state.

State has typed columns and lives in the RocksDB store (``run_to_parquet`` asks for it), so it is not
bounded by an executor's memory. Rows of a key come as an iterator and are folded one by one: a key that
has a third of all rows is never held."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from spark_drift.util import from_micros

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


COUNTS = ("n", "n_in_domain", "n_beached", "n_error")


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


# --- sessions ----------------------------------------------------------------------


def add_to_sessions(sessions: list[list[int]], gap: int, t: int, counts: tuple[int, ...]) -> None:
    """Put a fix at ``t`` into disjoint sessions [first, last, n, counts…], which stay in order of time.

    A fix at most ``gap`` from a session belongs to it; one near two of them joins them."""
    i = bisect_right(sessions, t, key=lambda s: s[0])
    if i and t <= sessions[i - 1][1] + gap:
        at = i - 1
        own = sessions[at]
        own[1] = max(own[1], t)
    elif i < len(sessions) and sessions[i][0] <= t + gap:
        at = i
        own = sessions[at]
        own[0] = t
    else:
        sessions.insert(i, [t, t, 1, *counts])
        return
    own[2:] = [a + b for a, b in zip(own[2:], (1, *counts))]
    if at + 1 < len(sessions) and sessions[at + 1][0] <= own[1] + gap:
        after = sessions.pop(at + 1)
        own[1] = after[1]
        own[2:] = [a + b for a, b in zip(own[2:], after[2:])]


class Sessions(StatefulProcessor):
    """Open sessions of a key as list state, and a timer at the end of the first of them."""

    def __init__(self, key: str, gap_us: int):
        self.gap, self.row = gap_us, Row(key, "_first", "_last", *COUNTS, "is_open")

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _longs("first", "last", *COUNTS))

    def _timer(self, sessions: list[list[int]]) -> int | None:
        return min(-(-(s[1] + self.gap) // 1000) for s in sessions) if sessions else None

    def _load(self) -> list[list[int]]:
        return [list(r) for r in self.open.get()]

    def _settle(self, key, sessions: list[list[int]], timer: int | None, timers) -> Iterator[Row]:
        """All sessions of the key, those over by the watermark for the last time; the others are kept."""
        now = timers.getCurrentWatermarkInMs() * 1000
        kept = []
        for s in sessions:
            over = s[1] + self.gap <= now
            if not over:
                kept.append(s)
            yield self.row(key[0], *s, not over)
        if kept:
            self.open.put([tuple(s) for s in kept])
        else:
            self.open.clear()
        again = self._timer(kept)
        if timer != again:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if again is not None:
                self.handle.registerTimer(again)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sessions = self._load()
        timer = self._timer(sessions)
        for _, t, in_domain, beached, error, _ in rows:  # the last one is the time that the watermark goes by
            add_to_sessions(sessions, self.gap, t, (in_domain, beached, error))
        yield from self._settle(key, sessions, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sessions = self._load()
        yield from self._settle(key, sessions, self._timer(sessions), timerValues)

    def close(self) -> None:
        pass


def stream_sessions(fixes: DataFrame, gap_s: float, late: str = "1 hour", key: str = "particle_id") -> DataFrame:
    """(key, t_start, t_end, n, n_in_domain, n_beached, n_error, is_open): sessions of each ``key`` in update form.

    A session ends ``gap_s`` after its last fix; a fix not later than that continues it. In every batch
    in which a key has fixes, or a session of its ends by the watermark (``late`` behind the newest
    fix), all its open sessions come out as they stand and the ended ones once more, as closed. So the
    closed rows and each key's open rows of its newest batch are its sessions (``newest_sessions``).
    Rows later than the watermark are dropped and counted in the progress of the query
    (numRowsDroppedByWatermark); a null ``key`` is a key of its own, rows without a time play no part."""
    at = F.unix_micros(F.col("time"))
    rows = fixes.where("time is not null").withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("in_domain", "is_beached", "error_status")]
    rows = rows.select(key, at.alias("_t"), *counts, "time")
    out = T.StructType([fixes.schema[key], *_longs("_first", "_last", *COUNTS).fields, T.StructField("is_open", T.BooleanType())])
    done = rows.groupBy(key).transformWithState(Sessions(key, round(gap_s * 1e6)), out, "update", "EventTime")
    end = from_micros(F.col("_last") + F.lit(round(gap_s * 1e6)))
    return done.select(key, from_micros(F.col("_first")).alias("t_start"), end.alias("t_end"), *COUNTS, "is_open")


def newest_sessions(rows: DataFrame, key: str = "particle_id") -> DataFrame:
    """The sessions of what ``stream_sessions`` gave, by batch: closed ones, and open ones of a key's newest batch."""
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_batch"))
    joined = rows.join(last, F.col(key).eqNullSafe(F.col("_key")))
    return joined.where(~F.col("is_open") | (F.col("batch") == F.col("_batch"))).select(rows.columns)


# --- status --------------------------------------------------------------------------

STATUS = T.StructType([*_longs("t_first_us", "t_last_us", "land_encounters").fields, *[T.StructField(n, T.IntegerType()) for n in ("is_beached", "in_domain", "is_alive")]])


class Status(StatefulProcessor):
    """First and newest time, land encounters, beaching, domain and life of a key, as one value."""

    def __init__(self, key: str, death_age_s: float, settling_delay_s: float, ttl_ms: int | None):
        self.death, self.settling, self.ttl = death_age_s, settling_delay_s, ttl_ms
        self.row = Row(key, "age_s", "land_encounters", "is_beached", "in_domain", "is_alive", "settling", "t_first_us", "t_last_us")

    def init(self, handle) -> None:
        self.value = handle.getValueState("status", STATUS, self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.value.update(tuple(initialState)[1:])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last, land, beached, domain, alive = self.value.get() if self.value.exists() else (None, None, 0, 0, 1, 1)
        for _, t, now_beached, now_domain, hits in rows:
            first = t if first is None else min(first, t)
            if last is None or t > last:
                last, beached = t, now_beached
            elif t == last:
                beached = max(beached, now_beached)
            land += hits
            domain = min(domain, now_domain)
        age = (last - first) / 1e6
        if age >= self.death:
            alive = 0
        self.value.update((first, last, land, beached, domain, alive))
        yield self.row(key[0], age, land, beached, domain, alive, int(age >= self.settling), first, last)

    def close(self) -> None:
        pass


def stream_status(fixes: DataFrame, death_age_s: float, settling_delay_s: float, saved: DataFrame | None = None, ttl_s: float | None = None,
                  key: str = "particle_id") -> DataFrame:
    """Running state per particle, emitted once per batch in which it has fixes (``run_to_parquet``
    keeps the newest by ``key``): age_s, land_encounters, is_beached (at the newest time; 1 if fixes of one
    time differ), in_domain, is_alive, settling, t_first_us, t_last_us.

    A particle that left the domain stays out, a dead one stays dead. ``saved`` is an earlier run's result:
    its rows are the state to start from, so a run split in two gives the rows of one. States never expire
    unless ``ttl_s`` is given: then a particle without
    fixes for so long (by the clock of the run) starts anew; drain such a stream without idle batches.
    Rows without a time play no part; a null beaching or encounter counts as 0, a null domain as inside."""
    us = F.unix_micros(F.col("time").cast("timestamp"))
    value = lambda c, other, kind="int": F.coalesce(F.col(c).cast(kind), F.lit(other).cast(kind)).alias(c)
    rows = fixes.where("time is not null").select(key, us.alias("_t"), value("is_beached", 0), value("in_domain", 1), value("land_boundary_encounters", 0, "long"))
    flags = [T.StructField(n, T.IntegerType()) for n in ("is_beached", "in_domain", "is_alive", "settling")]
    out = T.StructType([fixes.schema[key], T.StructField("age_s", T.DoubleType()), *_longs("land_encounters").fields, *flags, *_longs("t_first_us", "t_last_us").fields])
    start = None if saved is None else saved.select(key, "t_first_us", "t_last_us", "land_encounters", "is_beached", "in_domain", "is_alive").groupBy(key)
    work = Status(key, death_age_s, settling_delay_s, None if ttl_s is None else round(ttl_s * 1000))
    return rows.groupBy(key).transformWithState(work, out, "update", "None" if ttl_s is None else "ProcessingTime", start)
