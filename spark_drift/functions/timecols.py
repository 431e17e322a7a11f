"""Time expressions. Timestamps are timestamp_ntz; run sessions in UTC."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from spark_drift.functions.geo import col, nonzero
from spark_drift.util import from_micros, micros, seconds_between, ts_literal

DAY_US = 86_400_000_000
_UNIT_US = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000,
            "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "h": 3_600_000_000,
            "day": DAY_US, "d": DAY_US}


def parse_units(units: str) -> tuple[int, int]:
    """Microseconds per unit and microseconds of the epoch of ``<unit> since <datetime>``."""
    m = re.fullmatch(r"\s*(\w+)\s+since\s+(.+?)\s*", units)
    unit = m and m.group(1).lower()
    unit_us = m and (_UNIT_US.get(unit) or _UNIT_US.get(unit.rstrip("s")))
    if not unit_us:
        raise ValueError(f"cannot read time units {units!r}")
    epoch = datetime.fromisoformat(m.group(2).replace(" UTC", "").rstrip("Z"))
    delta = epoch.replace(tzinfo=None) - datetime(1970, 1, 1)
    return unit_us, (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def decode_time(value, units: str) -> Column:
    unit_us, epoch_us = parse_units(units)
    return from_micros(F.round(col(value) * F.lit(float(unit_us))).cast("long") + F.lit(epoch_us))


def decode_split_time(day, msec, units: str) -> Column:
    """Whole days plus milliseconds of the day, added as integers."""
    _, epoch_us = parse_units(units)
    days, ms = col(day).cast("long"), col(msec).cast("long")
    return from_micros(days * F.lit(DAY_US) + ms * F.lit(1000) + F.lit(epoch_us))


def encode_time(ts, units: str = "seconds since 1960-01-01") -> Column:
    """Whole units since the epoch, as a long."""
    unit_us, epoch_us = parse_units(units)
    return F.floor((micros(col(ts)) - F.lit(epoch_us)) / F.lit(unit_us)).cast("long")


def round_time(ts, interval_s: int = 3600) -> Column:
    """Nearest multiple of the interval counted from midnight; half rounds up."""
    us = micros(col(ts))
    midnight = us - F.pmod(us, F.lit(DAY_US))
    sec = F.floor(F.pmod(us, F.lit(DAY_US)) / F.lit(1_000_000))
    steps = F.floor((sec + F.lit(interval_s / 2)) / F.lit(interval_s)).cast("long")
    return from_micros(midnight + steps * F.lit(interval_s * 1_000_000))


def linear_fraction(t, t0, t1) -> Column:
    t, t0, t1 = map(col, (t, t0, t1))
    return (t - t0) / nonzero(t1 - t0)


def linear_fraction_safe(t, t0, t1) -> Column:
    f = linear_fraction(t, t0, t1)
    return F.when(f.between(0, 1), f).otherwise(
        F.raise_error(F.lit("value outside its bracket")).cast("double")
    )


def lerp(f, a, b) -> Column:
    """(1−f)·a + f·b, exactly a when both ends are equal."""
    f, a, b = map(col, (f, a, b))
    return F.when(a == b, a).otherwise((F.lit(1.0) - f) * a + f * b)


def due(ts, start, every_s: int) -> Column:
    """Whole seconds from ``start`` are a multiple of the period."""
    elapsed = F.floor(F.abs(seconds_between(col(ts), ts_literal(start)))).cast("long")
    return F.pmod(elapsed, F.lit(int(every_s))) == 0
