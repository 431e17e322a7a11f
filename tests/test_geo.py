import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spark_drift.functions import geo, projection, timecols
from spark_drift.functions.geo import col

L = F.lit


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_utm_golden(spark):
    df = spark.createDataFrame([(1, -4.0, 50.0)], "i int, lon double, lat double")
    r = projection.lonlat_from_utm(projection.utm_from_lonlat(df, order="i")).first()
    assert r["epsg"] == 32630
    assert r["easting"] == pytest.approx(428333.55, abs=0.01)
    assert r["northing"] == pytest.approx(5539109.82, abs=0.01)
    assert (r["lon"], r["lat"]) == pytest.approx((-4.0, 50.0), abs=1e-9)


def test_zone_exceptions(spark):
    pts = [(5.0, 60.0, 32), (2.9, 60.0, 31), (8.0, 75.0, 31), (20.0, 75.0, 33), (30.0, 75.0, 35), (41.0, 75.0, 37), (43.0, 75.0, 38), (-180.0, 0.0, 1)]
    df = spark.createDataFrame(pts, "lon double, lat double, want int")
    assert df.where(projection.utm_zone_number("lon", "lat") != F.col("want")).count() == 0


def test_zone_letter_outside_is_an_error(spark):
    with pytest.raises(Exception, match="no zone letter"):
        one(spark, projection.utm_zone_letter(L(85.0)))


def test_national_grid(spark):
    df = spark.createDataFrame([(651409.903, 313177.270)], "easting double, northing double")  # Caister water tower
    r = projection.bng_to_lonlat(df).first()
    assert r["lon"] == pytest.approx(1.716073973, abs=1e-4)
    assert r["lat"] == pytest.approx(52.658007833, abs=1e-4)


def test_areas(spark):
    p = lambda *c: tuple(L(float(v)) for v in c)
    r = one(spark, geo.triangle_area(p(0, 0), p(1, 0), p(0, 1)).alias("plane"),
            geo.spherical_triangle_area(p(1, 0, 0), p(0, 1, 0), p(0, 0, 1), 1.0).alias("octant"),
            geo.spherical_triangle_area(p(1, 0, 0), p(1, 0, 0), p(0, 0, 1), 1.0).alias("flat"),
            geo.haversine(L(0.0), L(0.0), L(math.pi), L(0.0)).alias("anti"))
    assert r["plane"] == 0.5
    assert r["octant"] == pytest.approx(math.pi / 2)
    assert r["flat"] == 0.0
    assert r["anti"] == pytest.approx(math.pi)


def test_crossings_of_arcs_and_segments(spark):
    p = lambda a, b: (L(math.radians(a)), L(math.radians(b)))
    q = lambda a, b: (L(float(a)), L(float(b)))
    r = one(spark, geo.arc_intersection(p(89, 0), p(91, 0), p(90, -1), p(90, 1)).alias("hit"),
            geo.arc_intersection(p(89, 0), p(91, 0), p(-90, -1), p(-90, 1)).alias("far"),
            geo.arc_intersection(p(89, 0), p(89, 0), p(90, -1), p(90, 1)).alias("none"),
            geo.segment_intersection(q(0, 0), q(2, 2), q(0, 2), q(2, 0)).alias("seg"),
            geo.segment_intersection(q(0, 0), q(2, 2), q(0, 1), q(2, 3)).alias("par"),
            geo.segment_intersection(q(0, 0), q(1, 0), q(1, 0), q(1, 5)).alias("end"))
    assert (math.degrees(r["hit"]["x"]), math.degrees(r["hit"]["y"])) == pytest.approx((90, 0), abs=1e-9)
    assert r["far"] is None and r["none"] is None and r["par"] is None
    assert tuple(r["seg"]) == (1.0, 1.0) and tuple(r["end"]) == (1.0, 0.0)


@settings(max_examples=8, deadline=None)
@given(st.floats(-179, 179), st.floats(-89, 89), st.floats(-3, 3), st.floats(-1.5, 1.5))
def test_round_trips(spark, lon, lat, a, b):
    u = geo.to_unit_vector(L(math.radians(lon)), L(math.radians(lat)))
    back = geo.to_lonlat(geo.reverse_rotate_axes(geo.rotate_axes(u, L(a), L(b)), L(a), L(b)))
    r = one(spark, F.degrees(back[0]).alias("x"), F.degrees(back[1]).alias("y"))
    assert (r["x"], r["y"]) == pytest.approx((lon, lat), abs=1e-6)


def test_rotated_frame_points_up(spark):
    u = geo.to_unit_vector(L(0.7), L(0.3))
    r = one(spark, *[c.alias(n) for n, c in zip("xyz", geo.rotate_axes(u, L(0.7), L(0.3)))])
    assert tuple(r) == pytest.approx((0, 0, 1), abs=1e-12)


def test_sigma(spark):
    r = one(spark, *[geo.depth_to_sigma(L(z), L(-10.0), L(0.0)).alias(n) for z, n in ((0.0, "a"), (-5.0, "b"), (-10.0, "c"))])
    assert tuple(r) == pytest.approx((0, -0.5, -1))


def test_time_units(spark):
    r = one(spark, timecols.decode_time(L(1.5), "hours since 1960-01-01 00:00:00").alias("t"),
            timecols.encode_time(F.lit("1960-01-01 01:30:00.7").cast("timestamp_ntz")).alias("s"),
            timecols.round_time(F.lit("2000-01-01 23:30:00").cast("timestamp_ntz")).alias("up"))
    assert str(r["t"]) == "1960-01-01 01:30:00" and r["s"] == 5400 and str(r["up"]) == "2000-01-02 00:00:00"
    with pytest.raises(ValueError):
        timecols.parse_units("fortnights since 2000-01-01")


def test_safe_fraction_outside(spark):
    with pytest.raises(Exception, match="outside its bracket"):
        one(spark, timecols.linear_fraction_safe(L(2.0), L(0.0), L(1.0)))


def test_angle_to_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(geo.array_angle(col("a"), col("b"))).collect()] == [pytest.approx(math.pi / 2), None]
