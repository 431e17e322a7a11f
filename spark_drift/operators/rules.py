"""Row rules on tables of particle states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_drift.functions import geo
from spark_drift.functions.geo import nonzero
from spark_drift.operators.locate import crossings, first_walls, reflect_across_side
from spark_drift.schema import (BOTTOM_CROSSED, IN_DOMAIN, LAND_CROSSED, NOT_FOUND, OPEN_CROSSED, PERMANENTLY_BEACHED, Mesh)
from spark_drift.util import cut_lineage, gaussian, seconds_between, skew_safe_join, uniform


def total_velocity(df: DataFrame, wind_factor: float = 0.0, settling: str | None = None) -> DataFrame:
    """u, v, w: ocean + wind_factor·wind + Stokes; the vertical part less settling. Missing terms are 0."""
    term = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.withColumns({
        "u": term("uo") + F.lit(float(wind_factor)) * term("u10") + term("usd"),
        "v": term("vo") + F.lit(float(wind_factor)) * term("v10") + term("vsd"),
        "w": term("wo") - (term(settling) if settling else F.lit(0.0)),
    })


def settling_velocity(df: DataFrame, mode: str = "fixed", value: float = 0.0, low: float = 0.0, high: float = 0.0,
                      delay_s: float | None = None, key: str = "particle_id", elapsed: str = "elapsed_s", seed: int = 0) -> DataFrame:
    """Adds ws. ``uniform`` draws once per particle; with a delay it is 0 until the time is up,
    and ``held`` says that the particle stays at the surface."""
    if mode == "fixed":
        ws = F.lit(float(value))
    elif mode == "uniform":
        ws = F.lit(float(low)) + uniform("settling", seed, F.col(key)) * F.lit(float(high - low))
    else:
        raise ValueError(f"unknown settling mode {mode!r}")
    if delay_s is None:
        return df.withColumns({"ws": ws, "held": F.lit(0)})
    waiting = F.col(elapsed) < F.lit(float(delay_s))
    return df.withColumns({"ws": F.when(waiting, F.lit(0.0)).otherwise(ws), "held": waiting.cast("int")})


def reflect_vertical_column(z: Column, zmin: Column, zmax: Column) -> Column:
    """Fold z into [zmin, zmax] by mirrors at both ends, in closed form; a dry column gives zmin."""
    depth = zmax - zmin
    turn = F.pmod(z - zmin, nonzero(F.lit(2.0) * depth))
    folded = zmin + F.when(turn > depth, F.lit(2.0) * depth - turn).otherwise(turn)
    return F.when(zmin >= zmax, zmin).when(z.between(zmin, zmax), z).otherwise(folded)


def reflect_vertical(df: DataFrame, z: str = "z", zmin: str = "zmin", zmax: str = "zmax") -> DataFrame:
    return df.withColumn(z, reflect_vertical_column(F.col(z), F.col(zmin), F.col(zmax)))


def absorb_bottom(df: DataFrame, z: str = "z", zmin: str = "zmin", zmax: str = "zmax", flag: str = "flag") -> DataFrame:
    """Below the floor the particle stays put with flag −5; above the surface it is mirrored once.

    A mirror image below the floor counts as crossing it; a dry column gives zmin."""
    v, lo, hi = F.col(z), F.col(zmin), F.col(zmax)
    mirrored = hi * 2 - v
    dry = lo >= hi
    out = F.when(dry, lo).when((v > hi) & (mirrored >= lo), mirrored).otherwise(v)
    crossed = ~dry & ((v < lo) | ((v > hi) & (mirrored < lo)))
    return df.withColumns({flag: F.when(crossed, BOTTOM_CROSSED).otherwise(IN_DOMAIN).cast("int"), z: out})


def apply_land_rule(moves: DataFrame, mesh: Mesh, rule: str) -> DataFrame:
    """End of each move (move_id, x, y, x_new, y_new, host) under a land rule.

    Adds x_end, y_end, flag and land_hits. restoring: back to the start; absorbing: stays at
    the start with flag −6; reflecting: mirrored once at the side crossed."""
    if rule not in ("restoring", "absorbing", "reflecting"):
        raise ValueError(f"unknown land rule {rule!r}")
    walls = first_walls(moves, mesh)
    if rule == "reflecting":
        walls = cut_lineage(walls)  # used twice: one row per move that meets a wall
    ended = crossings(moves, mesh, walls)
    hit = F.col("flag") == LAND_CROSSED
    if rule in ("restoring", "absorbing"):
        flag = IN_DOMAIN if rule == "restoring" else PERMANENTLY_BEACHED
        return ended.withColumns({
            "x_end": F.when(hit, F.col("x")).otherwise(F.col("x_new")),
            "y_end": F.when(hit, F.col("y")).otherwise(F.col("y_new")),
            "land_hits": hit.cast("int"),
            "flag": F.when(hit, flag).otherwise(F.col("flag")).cast("int"),
        }).select(*moves.columns, "x_end", "y_end", "flag", "land_hits")
    mirrored = reflect_across_side(moves.join(walls.where(F.col("kind") == LAND_CROSSED), "move_id"), mesh.cs)
    back = ended.join(mirrored.select("move_id", "x_ref", "y_ref"), "move_id", "left")
    return back.withColumns({
        "x_end": F.when(hit, F.col("x_ref")).otherwise(F.col("x_new")),
        "y_end": F.when(hit, F.col("y_ref")).otherwise(F.col("y_new")),
        "land_hits": hit.cast("int"),
        "flag": F.when(hit, IN_DOMAIN).otherwise(F.col("flag")).cast("int"),
    }).select(*moves.columns, "x_end", "y_end", "flag", "land_hits")


def hold_depth(df: DataFrame, depth: float | None = None, height: float | None = None, z: str = "z") -> DataFrame:
    """z at a fixed depth below the surface or a fixed height above the bed."""
    if (depth is None) == (height is None):
        raise ValueError("give either a depth or a height")
    if depth is not None:
        return df.withColumn(z, F.lit(float(depth)) + F.col("zmax"))
    return df.withColumn(z, F.lit(float(height)) + F.col("zmin"))


def update_status(df: DataFrame, allow_beaching: bool = True, flag: str = "flag") -> DataFrame:
    """in_domain, error_status and is_beached after a move.

    Leaving through the open boundary or the bottom, or beaching for good, ends the stay in
    the domain; a failed move also sets the error status. A dry host beaches when allowed,
    else ``relocate`` asks for the nearest wet host."""
    f = F.col(flag)
    gone = f.isin(OPEN_CROSSED, BOTTOM_CROSSED, PERMANENTLY_BEACHED)
    failed = f == NOT_FOUND
    dry = (f == IN_DOMAIN) & (F.col("wet") == 0)
    return df.withColumns({
        "in_domain": F.when(gone | failed, 0).otherwise(F.col("in_domain")).cast("int"),
        "error_status": F.when(failed, 1).otherwise(F.col("error_status")).cast("int"),
        "is_beached": F.when(dry & F.lit(allow_beaching), 1).otherwise(F.when(f == IN_DOMAIN, 0).otherwise(F.col("is_beached"))).cast("int"),
        "relocate": (dry & F.lit(not allow_beaching)).cast("int"),
    })


def assign_death_age(seeds: DataFrame, mode: str = "common", value_s: float = 0.0, low_s: float = 0.0, high_s: float = 0.0,
                     mean_s: float = 0.0, std_s: float = 0.0, key: str = "particle_id", seed: int = 0) -> DataFrame:
    """Adds age_of_death in seconds: a common value, a uniform or a Gaussian draw per particle."""
    if mode == "common":
        age = F.lit(float(value_s))
    elif mode == "uniform":
        age = F.lit(float(low_s)) + uniform("death", seed, F.col(key)) * F.lit(float(high_s - low_s))
    elif mode == "gaussian":
        age = F.lit(float(mean_s)) + gaussian("death", seed, F.col(key)) * F.lit(float(std_s))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return seeds.withColumn("age_of_death", age)


def _dead_from(fixes: DataFrame, dies: Column, key: str, time: str) -> DataFrame:
    """is_alive from the first time at which ``dies`` holds, by an aggregate joined back.

    No task orders the rows of one particle, however many there are."""
    first = fixes.groupBy(key).agg(F.min(F.when(dies, F.col(time))).alias("_death"))
    joined = skew_safe_join(fixes, first, [key])
    alive = F.col("_death").isNull() | (F.col(time) < F.col("_death"))
    return joined.withColumn("is_alive", alive.cast("int")).drop("_death")


def mark_dead(fixes: DataFrame, age: str = "age_s", death_age: str = "age_of_death", key: str = "particle_id",
              time: str = "time") -> DataFrame:
    """Dead from the first row whose age reaches the age of death."""
    return _dead_from(fixes, F.col(age) >= F.col(death_age), key, time)


def mark_dead_random(fixes: DataFrame, rate_per_s: float, step_s: float, key: str = "particle_id", time: str = "time",
                     seed: int = 0) -> DataFrame:
    """Dead from the first row whose draw is below rate·step."""
    draw = uniform("mortality", seed, F.col(key), F.col(time).cast("string"))
    return _dead_from(fixes, draw < F.lit(rate_per_s * step_s), key, time)


def particle_age(fixes: DataFrame, key: str = "particle_id", time: str = "time") -> DataFrame:
    """age_s in seconds and age in days since the first fix of each particle."""
    first = fixes.groupBy(key).agg(F.min(time).alias("_t0"))
    joined = skew_safe_join(fixes, first, [key])
    age = seconds_between(F.col(time), F.col("_t0"))
    return joined.withColumns({"age_s": age, "age": age / F.lit(86400.0)}).drop("_t0")


def dead_reckon(df: DataFrame, dt_s: float, cs: str = "cartesian", x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """One straight displacement by (u, v, w) over dt: adds x_new, y_new, z_new (degrees when geographic)."""
    d = [F.col(c) * F.lit(float(dt_s)) for c in ("u", "v", "w")]
    if cs == "geographic":
        lon, lat, zn = geo.displace(F.radians(x), F.radians(y), F.col(z), *d, cs=cs)
        return df.withColumns({"x_new": F.degrees(lon), "y_new": F.degrees(lat), "z_new": zn})
    xn, yn, zn = geo.displace(F.col(x), F.col(y), F.col(z), *d)
    return df.withColumns({"x_new": xn, "y_new": yn, "z_new": zn})
