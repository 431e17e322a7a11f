"""Time operators: frame intervals, as-of joins, date matching, schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_drift.functions.timecols import due, lerp
from spark_drift.util import from_micros, micros, one_row, order_neighbours, seconds_between, skew_safe_join, ts_literal


def _require_empty(missing: DataFrame, what: str) -> None:
    row = missing.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")


def find_time(times: DataFrame, refs: DataFrame, tol_s: float = 60, time: str = "time", idx: str = "idx",
              ref: str = "ref", strict: bool = True) -> DataFrame:
    """First row of ``times`` by ``idx`` strictly within the tolerance of each reference time.

    Both sides are keyed by tolerance-wide slots, so the join is an equi-join on three slots."""
    width = int(tol_s * 1_000_000)
    slot = lambda c: F.floor(micros(F.col(c)) / F.lit(width)).cast("long")
    left = refs.select(ref).distinct().withColumn("_s", F.explode(F.array(*[slot(ref) + d for d in (-1, 0, 1)])))
    # one row per distinct time: what meets in a slot is bounded by the resolution of the clock
    right = times.groupBy(time).agg(F.min(idx).alias(idx)).withColumn("_s", slot(time))
    close = F.abs(seconds_between(F.col(time), F.col(ref))) < tol_s
    found = left.join(right, "_s").where(close).groupBy(ref).agg(
        F.min(idx).alias(idx), F.min_by(time, idx).alias(time)
    )
    if strict:
        _require_empty(refs.select(ref).join(found, ref, "left_anti"), "no time within the tolerance of")
    return found


def match_dates(df: DataFrame, dates: DataFrame, time: str = "time", order: str | None = None,
                strict: bool = True) -> DataFrame:
    """Rows of ``df`` whose time equals a wanted date. With ``order``, the first row of each date."""
    wanted = dates.select(time).distinct()
    if strict:
        _require_empty(wanted.join(df.select(time), time, "left_anti"), "date not in the data set")
    rows = skew_safe_join(df, wanted, [time])
    if order is None:
        return rows
    return rows.join(rows.groupBy(time).agg(F.min(order).alias(order)), [time, order], "left_semi")


def nearest_time(df: DataFrame, date, time: str = "time") -> DataFrame:
    """All rows at the time nearest to ``date``; the earlier time wins a tie."""
    gap = F.abs(micros(F.col(time)) - micros(ts_literal(date)))
    best = df.agg(F.min(F.struct(gap.alias("gap"), F.col(time).alias("t"))).alias("best")).select(
        F.col("best.t").alias(time)
    )
    return df.join(F.broadcast(best), time)  # one row


def elapsed_dates(fixes: DataFrame, deltas_s: Sequence[float], release: str = "release",
                  time: str = "time") -> DataFrame:
    """(release, delta_s, time): the first time of each release plus each delta."""
    first = fixes.groupBy(release).agg(F.min(time).alias("_t0"))
    deltas = F.explode(F.array(*[F.lit(float(d)) for d in deltas_s]))
    rows = first.select(release, "_t0", deltas.alias("delta_s"))
    shift = (F.col("delta_s") * 1_000_000).cast("long")
    return rows.select(release, "delta_s", from_micros(micros(F.col("_t0")) + shift).alias(time))


def frame_intervals(times: DataFrame, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Consecutive distinct frames as (t_last, t_next). Frames repeated between files count once."""
    distinct = times.select(*by, time).distinct()
    rows = order_neighbours(distinct, [time], F.unix_date(F.col(time).cast("date")), by, lead={time: "t_next"})
    return rows.where(F.col("t_next").isNotNull()).select(*by, F.col(time).alias("t_last"), "t_next")


def interval_level(start: Column, end: Column) -> Column:
    """Exponent of the power of two (of microseconds) at or above the length of an interval."""
    return F.ceil(F.log2(F.greatest(micros(end) - micros(start), F.lit(1)).cast("double"))).cast("int")


def interval_cells(spans: DataFrame) -> DataFrame:
    """Intervals (t_last, t_next) with their _level, one row per cell (_cell) of that level they touch.

    Cells are as wide as the level's power of two, so an interval lies in one cell or two. All intervals of a
    level are at least half a cell long: a cell meets at most four of one series, however unevenly its frames
    are spread."""
    out = spans.withColumn("_level", interval_level(F.col("t_last"), F.col("t_next")))
    return out.withColumn("_cell", F.explode(F.sequence(_cell(F.col("t_last"), F.col("_level")), _cell(F.col("t_next"), F.col("_level")))))


def _cell(t: Column, level: Column) -> Column:
    # an arithmetic shift rounds down before 1970 too
    return F.call_function("shiftright", micros(t), level)


def asof_frames(points: DataFrame, frames: DataFrame, direction: int = 1, by: Sequence[str] = (),
                time: str = "time", missing: str = "error") -> DataFrame:
    """Add the bracketing frames (t_last, t_next) and the fraction between them.

    Forward brackets are [last, next), backward ones (last, next]. The interval join is an
    equi-join on cells as wide as the power of two at or above an interval's own length, with the
    exact bounds as a residual. A point looks once into each such level that its series has: once where
    frames are regular, a few times where minutes, days and gaps of years mix. Points outside
    the frames, of a series without frames or without a time are known before the join and look nowhere.
    ``missing`` = error | null | drop."""
    spans = frame_intervals(frames, by, time)
    t, by = F.col(time), list(by)
    whole = [F.min("t_last").alias("_t_first"), F.max("t_next").alias("_t_end"),
             F.collect_set(interval_level(F.col("t_last"), F.col("t_next"))).alias("_levels")]
    if by:
        # one row per series
        left = skew_safe_join(points, spans.groupBy(*by).agg(*whole), by, "left").select(*points.columns, "_t_first", "_t_end", "_levels")
    else:
        left = points.withColumn("_series", spans.agg(F.struct(*whole)).scalar())
        left = left.select(*points.columns, "_series.*")
    inside = lambda first, end: (t >= first) & (t < end) if direction > 0 else (t > first) & (t <= end)
    covered = F.coalesce(inside(F.col("_t_first"), F.col("_t_end")), F.lit(False))
    left = left.withColumn("_levels", F.when(covered, F.col("_levels")).otherwise(F.array(F.lit(None).cast("int"))))
    left = left.withColumn("_look", F.explode("_levels")).drop("_levels", "_t_first", "_t_end")
    left = left.withColumn("_at", _cell(t, F.col("_look")))
    cells = interval_cells(spans)
    on = (F.col("_look") == F.col("_level")) & (F.col("_at") == F.col("_cell"))
    for b in by:
        cells = cells.withColumnRenamed(b, f"_{b}")
        on = on & (F.col(b) == F.col(f"_{b}"))
    out = left.join(cells, on & inside(F.col("t_last"), F.col("t_next")), "inner" if missing == "drop" else "left")
    if missing != "drop":
        # the intervals tile the series: of a covered point's looks exactly one finds its bracket
        out = out.where(F.col("t_last").isNotNull() | F.col("_look").isNull())
    out = out.drop("_look", "_at", "_level", "_cell", *[f"_{b}" for b in by])
    if missing == "error":
        outside = F.raise_error(F.lit("time outside the frames")).cast("timestamp_ntz")
        out = out.withColumn("t_last", F.coalesce(F.col("t_last"), outside))
    f = (micros(t) - micros(F.col("t_last"))) / (micros(F.col("t_next")) - micros(F.col("t_last")))
    return out.withColumn("t_frac", f)


def fields_around(fields: DataFrame, frames: DataFrame, first: Column, last: Column, time: str = "time") -> DataFrame:
    """Field rows from the frame before ``first`` to the frame after ``last``.

    The bounds are scalar subqueries over the frames, evaluated before the scan: they prune the
    folders of a table partitioned by date and the row groups of the others."""
    before = frames.agg(F.coalesce(F.max(F.when(F.col(time) < first, F.col(time))), F.max(F.when(F.col(time) <= first, F.col(time))))).scalar()
    after = frames.agg(F.coalesce(F.min(F.when(F.col(time) > last, F.col(time))), F.min(F.when(F.col(time) >= last, F.col(time))))).scalar()
    rows = fields.where((F.col(time) >= before) & (F.col(time) <= after))
    if "date" in fields.columns:
        rows = rows.where((F.col("date") >= before.cast("date")) & (F.col("date") <= after.cast("date")))
    return rows


def thin_output(df: DataFrame, every_s: int, start=None, time: str = "time") -> DataFrame:
    """Rows whose whole seconds since the start are a multiple of the period."""
    if start is None:
        start = one_row(df.agg(F.min(time).alias("t0")))["t0"]
    return df.where(due(time, start, every_s))


def release_schedule(spark: SparkSession, start, n: int = 1, interval_h: float = 0, duration_d: float | None = None,
                     end=None, direction: int = 1) -> DataFrame:
    """(release, t_start, t_end) for every release of an ensemble."""
    if direction not in (1, -1):
        raise ValueError("direction must be 1 or -1")
    if n == 1 and end is None or n > 1 and duration_d is None:
        raise ValueError("one release takes an end, several take a duration")
    begin = micros(ts_literal(start)) + (F.col("id") * F.lit(int(interval_h * 3_600_000_000)))
    if n == 1:
        stop = micros(ts_literal(end))
    else:
        stop = begin + F.lit(int(duration_d * 86_400_000_000) * direction)
    bad = F.raise_error(F.lit("the end contradicts the start and the direction")).cast("timestamp_ntz")
    ok = (stop - begin) * direction > 0
    return spark.range(n).select(
        F.col("id").cast("int").alias("release"),
        F.when(ok, from_micros(begin)).otherwise(bad).alias("t_start"),
        from_micros(stop).alias("t_end"),
    )


def expand_releases(seeds: DataFrame, start, n: int, interval_h: float, duration_d: float,
                    direction: int = 1) -> DataFrame:
    """Every seed once per release, written as an explode of the schedule on each row."""
    begin = micros(ts_literal(start)) + F.col("release") * F.lit(int(interval_h * 3_600_000_000))
    rows = seeds.withColumn("release", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumns({
        "t_start": from_micros(begin),
        "t_end": from_micros(begin + F.lit(int(duration_d * 86_400_000_000) * direction)),
    })


def check_step_alignment(times: DataFrame, step_s: float, start=None, periods_s: Sequence[float] = (),
                         time: str = "time") -> DataFrame:
    """(n_times, n_misaligned, max_remainder_s); periods must be multiples of the step."""
    for p in periods_s:
        if p % step_s:
            raise ValueError(f"period {p} s is not a multiple of the step {step_s} s")
    origin = ts_literal(start) if start is not None else None
    if origin is None:
        origin = ts_literal(one_row(times.agg(F.min(time).alias("t0")))["t0"])
    rest = F.pmod(seconds_between(F.col(time), origin), F.lit(float(step_s)))
    return times.agg(
        F.count(F.lit(1)).alias("n_times"),
        F.count_if(rest != 0).alias("n_misaligned"),
        F.max(rest).alias("max_remainder_s"),
    )


def cell_bounds(df: DataFrame, column: str) -> DataFrame:
    """n distinct centres to n+1 edges, half of the first spacing to either side."""
    centres = df.select(F.col(column).alias("edge")).distinct()
    is_time = dict(centres.dtypes)["edge"].startswith("timestamp")
    if is_time:
        centres = centres.select(micros(F.col("edge")).alias("edge"))
    first = one_row(centres.agg(F.min("edge").alias("lo"), F.max("edge").alias("hi")))
    second = one_row(centres.where(F.col("edge") > F.lit(first["lo"])).agg(F.min("edge").alias("v")))["v"]
    if second is None:
        raise ValueError("cell bounds need two centres")
    half = (second - first["lo"]) / 2
    ends = F.when(F.col("edge") == F.lit(first["hi"]), F.array(F.col("edge") - F.lit(half), F.col("edge") + F.lit(half)))
    edges = centres.select(F.explode(F.coalesce(ends, F.array(F.col("edge") - F.lit(half)))).alias("edge"))
    return edges.select(from_micros(F.col("edge")).alias("edge")) if is_time else edges


def level_bounds_at(depths: DataFrame, time: str = "time", level: str = "level", z: str = "z") -> DataFrame:
    """(edge, level, z): every level's depth at the time-cell edges, linear between frames, clamped."""
    edges = cell_bounds(depths, time).withColumnRenamed("edge", time)
    span = one_row(depths.agg(F.min(time).alias("lo"), F.max(time).alias("hi")))
    lo, hi = ts_literal(span["lo"]), ts_literal(span["hi"])
    t = F.least(F.greatest(F.col(time), lo), hi)
    held = edges.select(F.col(time).alias("edge"), t.alias(time))
    framed = asof_frames(held, depths, time=time, missing="null")
    # the last instant lies in no [last, next) bracket: there both ends are the last frame
    framed = framed.select("edge", F.coalesce("t_last", time).alias("t_last"), F.coalesce("t_next", time).alias("t_next"),
                           F.coalesce("t_frac", F.lit(0.0)).alias("t_frac"))
    a = depths.select(F.col(time).alias("t_last"), level, F.col(z).alias("_a"))
    b = depths.select(F.col(time).alias("t_next"), level, F.col(z).alias("_b"))
    rows = framed.join(a, "t_last").join(b, ["t_next", level])
    return rows.select("edge", level, lerp("t_frac", "_a", "_b").alias(z))
