"""Queries: coordinate and geometry scalars."""

import math

from pyspark.sql import functions as F

from spark_drift.functions import geo
from spark_drift.functions import projection as proj
from spark_drift.plans.registry import query, rd

C = F.col


def _v(k: int) -> geo.Vec:
    return (C(f"x{k}"), C(f"y{k}"), C(f"z{k}"))


def _out(df, **columns):
    return df.select("id", *[rd(c).alias(n) for n, c in columns.items()])


@query("haversine", """
    SELECT id, round(2 * asin(least(1, sqrt(pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin((a2 - a1) / 2), 2)))), 6) + 0.0 AS angle
    FROM rad""")
def haversine(t):
    return _out(t.table("rad"), angle=geo.haversine("a1", "b1", "a2", "b2"))


@query("euclid", "SELECT id, round(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)), 6) + 0.0 AS d FROM pairs")
def euclid(t):
    return _out(t.table("pairs"), d=geo.euclid("ax", "ay", "bx", "by_"))


@query("to_unit_vector", """
    SELECT id, round(x1, 6) + 0.0 AS x, round(y1, 6) + 0.0 AS y, round(z1, 6) + 0.0 AS z,
      round(degrees(atan2(y1, x1)), 6) + 0.0 AS lon, round(degrees(asin(z1)), 6) + 0.0 AS lat FROM units""")
def to_unit_vector(t):
    v = geo.to_unit_vector("a1", "b1")
    lon, lat = geo.to_lonlat(v)
    return _out(t.table("rad"), x=v[0], y=v[1], z=v[2], lon=F.degrees(lon), lat=F.degrees(lat))


@query("rotate_axes", """
    SELECT id, round(-sin(a2) * x1 + cos(a2) * y1, 6) + 0.0 AS east,
      round(-sin(b2) * cos(a2) * x1 - sin(b2) * sin(a2) * y1 + cos(b2) * z1, 6) + 0.0 AS north,
      round(x1 * x2 + y1 * y2 + z1 * z2, 6) + 0.0 AS up,
      round(x1, 6) + 0.0 AS x, round(y1, 6) + 0.0 AS y, round(z1, 6) + 0.0 AS z,
      round(cos(a2) * y1 + sin(a2) * z1, 6) + 0.0 AS rx, round(sin(a2) * x1 + cos(a2) * z1, 6) + 0.0 AS ry,
      round(cos(a2) * x1 + sin(a2) * y1, 6) + 0.0 AS rz FROM units""")
def rotate_axes(t):
    r = geo.rotate_axes(_v(1), "a2", "b2")
    back = geo.reverse_rotate_axes(r, "a2", "b2")
    return _out(t.table("units"), east=r[0], north=r[1], up=r[2], x=back[0], y=back[1], z=back[2],
                rx=geo.rotate_x(_v(1), "a2")[1], ry=geo.rotate_y(_v(1), "a2")[2], rz=geo.rotate_z(_v(1), "a2")[0])


@query("vector_algebra", """
    SELECT id, round(x1 * x2 + y1 * y2, 6) + 0.0 AS dot2, round(x1 * x2 + y1 * y2 + z1 * z2, 6) + 0.0 AS dot3,
      round(y1 * z2 - z1 * y2, 6) + 0.0 AS cx, round(z1 * x2 - x1 * z2, 6) + 0.0 AS cy, round(x1 * y2 - y1 * x2, 6) + 0.0 AS cz,
      round(sqrt(pow(x1 + x2, 2) + pow(y1 + y2, 2) + pow(z1 + z2, 2)), 6) + 0.0 AS norm3,
      round(x1 * y2 - x2 * y1, 6) + 0.0 AS det2,
      round(x1 * (y2 * z3 - z2 * y3) - y1 * (x2 * z3 - z2 * x3) + z1 * (x2 * y3 - y2 * x3), 6) + 0.0 AS det3,
      round(acos(greatest(-1, least(1, x1 * x3 + y1 * y3 + z1 * z3))), 5) + 0.0 AS angle FROM units""")
def vector_algebra(t):
    a, b, c = _v(1), _v(2), _v(3)
    cr = geo.cross3(a, b)
    both = (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    df = t.table("units")
    return _out(df, dot2=geo.dot2(a[:2], b[:2]), dot3=geo.dot3(a, b), cx=cr[0], cy=cr[1], cz=cr[2], norm3=geo.norm3(both),
                det2=geo.det2(a[:2], b[:2]), det3=geo.det3(a, b, c)).join(
        df.select("id", rd(geo.angle_between(a, c), 5).alias("angle")), "id")


@query("array_vectors", """
    SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS dot,
      round(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) + 0.0 AS norm,
      round(acos(greatest(-1, least(1, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
        / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
        / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))))), 6) + 0.0 AS angle
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def array_vectors(t):
    a = t.base("embeddings").select("vec_id", C("embedding").alias("a"))
    b = t.base("embeddings").select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", rd(geo.array_dot("a", "b")).alias("dot"), rd(geo.array_norm("a")).alias("norm"),
                                      rd(geo.array_angle("a", "b")).alias("angle"))


@query("triangle_area", "SELECT id, round(abs((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / 2, 6) + 0.0 AS area FROM pairs")
def triangle_area(t):
    return _out(t.table("pairs"), area=geo.triangle_area((C("ax"), C("ay")), (C("bx"), C("by_")), (C("cx"), C("cy"))))


@query("spherical_triangle_area", """
    SELECT id, round(abs(2 * atan2(x1 * (y2 * z3 - z2 * y3) - y1 * (x2 * z3 - z2 * x3) + z1 * (x2 * y3 - y2 * x3),
      1 + x1 * x2 + y1 * y2 + z1 * z2 + x2 * x3 + y2 * y3 + z2 * z3 + x3 * x1 + y3 * y1 + z3 * z1)), 4) + 0.0 AS area FROM units""")
def spherical_triangle_area(t):
    return t.table("units").select("id", rd(geo.spherical_triangle_area(_v(1), _v(2), _v(3), 1.0), 4).alias("area"))


@query("segment_intersection", """
    SELECT id, CASE WHEN hit THEN round(ax + s * (bx - ax), 6) + 0.0 END AS x, CASE WHEN hit THEN round(ay + s * (by_ - ay), 6) + 0.0 END AS y
    FROM (SELECT *, s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AS hit FROM (
      SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif(d, 0) AS s,
        ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / nullif(d, 0) AS u
      FROM (SELECT *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS d FROM pairs) p) q) r""")
def segment_intersection(t):
    hit = geo.segment_intersection((C("ax"), C("ay")), (C("bx"), C("by_")), (C("cx"), C("cy")), (C("dx"), C("dy")))
    df = t.table("pairs").withColumn("h", hit)
    return _out(df, x=C("h.x"), y=C("h.y"))


# the arc from (lon1, lat1) some degrees towards the north-east against one around it: signs of four triple products
@query("arc_intersection", """
    WITH ends AS (SELECT id, lon1, lat1, radians(lon1) AS pa, radians(lat1 * 0.8) AS pb, radians(lon1 + 3 + id % 5) AS qa, radians(lat1 * 0.8 + 4) AS qb,
        radians(lon1 - 1) AS ra, radians(lat1 * 0.8 + 3) AS rb, radians(lon1 + 5) AS sa, radians(lat1 * 0.8 + 0.37 + id % 7) AS sb FROM pairs),
    v AS (SELECT id, cos(pa)*cos(pb) AS px, sin(pa)*cos(pb) AS py, sin(pb) AS pz, cos(qa)*cos(qb) AS qx, sin(qa)*cos(qb) AS qy, sin(qb) AS qz,
        cos(ra)*cos(rb) AS rx, sin(ra)*cos(rb) AS ry, sin(rb) AS rz, cos(sa)*cos(sb) AS sx, sin(sa)*cos(sb) AS sy, sin(sb) AS sz FROM ends),
    n AS (SELECT *, py*qz-pz*qy AS nx, pz*qx-px*qz AS ny, px*qy-py*qx AS nz, ry*sz-rz*sy AS mx, rz*sx-rx*sz AS my, rx*sy-ry*sx AS mz FROM v),
    l AS (SELECT *, (ny*mz-nz*my) AS lx, (nz*mx-nx*mz) AS ly, (nx*my-ny*mx) AS lz,
        (nx*rx+ny*ry+nz*rz) * (nx*sx+ny*sy+nz*sz) <= 0 AND (mx*px+my*py+mz*pz) * (mx*qx+my*qy+mz*qz) <= 0 AS hit FROM n),
    g AS (SELECT *, sign(lx*px+ly*py+lz*pz) AS w, sqrt(lx*lx+ly*ly+lz*lz) AS len FROM l)
    SELECT id, CAST(hit AS INT) AS hit, CASE WHEN hit THEN round(degrees(atan2(w*ly, w*lx)), 6) + 0.0 END AS lon,
      CASE WHEN hit THEN round(degrees(asin(w*lz/len)), 6) + 0.0 END AS lat FROM g""")
def arc_intersection(t):
    lat = C("lat1") * F.lit(0.8)
    lon = C("lon1")
    r = lambda a, b: (F.radians(a), F.radians(b))
    ends = (r(lon, lat), r(lon + 3 + C("id") % 5, lat + 4), r(lon - 1, lat + 3), r(lon + 5, lat + F.lit(0.37) + C("id") % 7))
    df = t.table("pairs").withColumn("h", geo.arc_intersection(*ends))
    return df.select("id", C("h").isNotNull().cast("int").alias("hit"), rd(F.degrees(C("h.x"))).alias("lon"), rd(F.degrees(C("h.y"))).alias("lat"))


@query("displace", """
    SELECT id, round(degrees(a1 + p / (6371000 * cos(b1))), 6) + 0.0 AS lon, round(degrees(b1 + p * 0.5 / 6371000), 6) + 0.0 AS lat,
      round(-5 + p * 0.001, 6) + 0.0 AS z FROM rad""")
def displace(t):
    lon, lat, z = geo.displace("a1", "b1", F.lit(-5.0), "p", C("p") * 0.5, C("p") * 0.001, "geographic")
    return _out(t.table("rad"), lon=F.degrees(lon), lat=F.degrees(lat), z=z)


@query("wrap_longitude", """
    SELECT id, round(CASE WHEN lon1 + 180 > 180 THEN lon1 - 180 ELSE lon1 + 180 END, 6) + 0.0 AS lon, round(lat1 - 90, 6) + 0.0 AS lat FROM pairs""")
def wrap_longitude(t):
    return _out(t.table("pairs"), lon=geo.wrap_longitude(C("lon1") + 180), lat=geo.recentre_latitude("lat1", 90))


ZONE_SQL = """CASE WHEN lat1 >= 56 AND lat1 < 64 AND lon1 >= 3 AND lon1 < 12 THEN 32
      WHEN lat1 >= 72 AND lat1 <= 84 AND lon1 >= 0 AND lon1 <= 9 THEN 31 WHEN lat1 >= 72 AND lat1 <= 84 AND lon1 >= 0 AND lon1 <= 21 THEN 33
      WHEN lat1 >= 72 AND lat1 <= 84 AND lon1 >= 0 AND lon1 <= 33 THEN 35 WHEN lat1 >= 72 AND lat1 <= 84 AND lon1 >= 0 AND lon1 <= 42 THEN 37
      ELSE CAST(floor((lon1 + 180) / 6) AS INT) % 60 + 1 END"""


@query("utm_zone_number", f"SELECT id, CAST({ZONE_SQL} AS INT) AS zone FROM pairs")
def utm_zone_number(t):
    return t.table("pairs").select("id", proj.utm_zone_number("lon1", "lat1").cast("int").alias("zone"))


@query("utm_zone_letter", """
    SELECT id, CASE WHEN lat1 BETWEEN -80 AND 84 THEN substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat1 + 80) / 8) AS INT) + 1, 1) END AS letter FROM pairs""")
def utm_zone_letter(t):
    return t.table("pairs").select("id", proj.utm_zone_letter("lat1", missing="null").alias("letter"))


@query("valid_utm_zone", """
    SELECT id, z, letter, CAST(z >= 1 AND z <= 60 AND regexp_matches(upper(letter), '^[C-X]$') AND upper(letter) NOT IN ('I', 'O') AS INT) AS ok
    FROM (SELECT id, CAST(id % 64 AS INT) AS z, chr(CAST(65 + id % 58 AS INT)) AS letter FROM pairs) q""")
def valid_utm_zone(t):
    df = t.table("pairs").select("id", (C("id") % 64).cast("int").alias("z"), F.char((C("id") % 58 + 65).cast("long")).alias("letter"))
    return df.select("id", "z", "letter", proj.valid_utm_zone("z", "letter").cast("int").alias("ok"))


@query("epsg_code", f"SELECT id, CAST(CASE WHEN lat1 >= 0 THEN 32600 ELSE 32700 END + {ZONE_SQL} AS INT) AS epsg FROM pairs")
def epsg_code(t):
    return t.table("pairs").select("id", proj.epsg_code("lon1", "lat1").alias("epsg"))


# Snyder's series in the eccentricity, an independent form of the same projection, near the central meridian
@query("utm_from_lonlat", """
    WITH k AS (SELECT 6378137e0 AS a, 6.69437999014132e-3 AS e2),
    q AS (SELECT id, lat1 * 0.9 AS lat, radians(lat1 * 0.9) AS f, radians((id % 5) * 0.25 - 0.5) AS dl, k.* FROM pairs, k),
    s AS (SELECT *, a / sqrt(1 - e2 * sin(f) * sin(f)) AS nu, tan(f) * tan(f) AS t, e2 / (1 - e2) * cos(f) * cos(f) AS c, dl * cos(f) AS aa,
      a * ((1 - e2/4 - 3*pow(e2,2)/64 - 5*pow(e2,3)/256 - 175*pow(e2,4)/16384) * f
        - (3*e2/8 + 3*pow(e2,2)/32 + 45*pow(e2,3)/1024 + 105*pow(e2,4)/4096) * sin(2*f)
        + (15*pow(e2,2)/256 + 45*pow(e2,3)/1024 + 525*pow(e2,4)/16384) * sin(4*f)
        - (35*pow(e2,3)/3072 + 175*pow(e2,4)/12288) * sin(6*f) + 315*pow(e2,4)/131072 * sin(8*f)) AS m FROM q)
    SELECT id, round(500000 + 0.9996 * nu * (aa + (1-t+c) * pow(aa,3)/6 + (5-18*t+t*t+72*c-58*e2/(1-e2)) * pow(aa,5)/120), 1) + 0.0 AS easting,
      round(0.9996 * (m + nu * tan(f) * (aa*aa/2 + (5-t+9*c+4*c*c) * pow(aa,4)/24 + (61-58*t+t*t+600*c-330*e2/(1-e2)) * pow(aa,6)/720)), 1) + 0.0 AS northing,
      round(lat, 6) + 0.0 AS lat, round(CAST((id % 5) * 0.25 - 3.5 AS DOUBLE), 6) + 0.0 AS lon
    FROM s""")
def utm_from_lonlat(t):
    df = t.table("pairs").select("id", (C("lat1") * F.lit(0.9)).alias("lat"), ((C("id") % 5) * F.lit(0.25) - 3.5).alias("lon"))
    there = proj.utm_from_lonlat(df, epsg=32630)
    back = proj.lonlat_from_utm(there)
    return back.select("id", rd("easting", 1).alias("easting"), rd("northing", 1).alias("northing"), rd("lat").alias("lat"), rd("lon").alias("lon"))


def _bng_sql() -> str:
    """Series, Helmert shift and closed form of the latitude in SQL, over the same fixed values."""
    b, (a, f), (a2, f2) = proj._BNG, proj._AIRY, proj._WGS84
    scale, e2 = b.k0 * b.radius, f * (2 - f)
    xi = "".join(f" - ({c!r}) * sin({2 * j + 2} * x0) * cosh({2 * j + 2} * y0)" for j, c in enumerate(b.beta))
    eta = "".join(f" - ({c!r}) * cos({2 * j + 2} * x0) * sinh({2 * j + 2} * y0)" for j, c in enumerate(b.beta))
    lat = "".join(f" + ({c!r}) * sin({2 * j + 2} * chi)" for j, c in enumerate(b.delta))
    (tx, ty, tz), (rx, ry, rz), sc = proj._HELMERT_T, (math.radians(r / 3600) for r in proj._HELMERT_R), 1 + proj._HELMERT_S
    b2 = a2 * (1 - f2)
    e2w, ep2 = f2 * (2 - f2), (a2 * a2 - b2 * b2) / (b2 * b2)
    return f"""
    WITH q0 AS (SELECT id, ax * 60000 + 50000 AS e, ay * 100000 + 20000 AS n FROM pairs),
    q1 AS (SELECT *, (n - ({b.fn!r})) / {scale!r} AS x0, (e - {b.fe!r}) / {scale!r} AS y0 FROM q0),
    q2 AS (SELECT *, x0{xi} AS xi, y0{eta} AS eta FROM q1),
    q3 AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi, radians(-2) + atan2(sinh(eta), cos(xi)) AS lon0 FROM q2),
    q4 AS (SELECT *, chi{lat} AS lat0 FROM q3),
    q5 AS (SELECT *, {a!r} / sqrt(1 - {e2!r} * pow(sin(lat0), 2)) AS nu FROM q4),
    q6 AS (SELECT *, nu * cos(lat0) * cos(lon0) AS x, nu * cos(lat0) * sin(lon0) AS y, nu * {1 - e2!r} * sin(lat0) AS z FROM q5),
    q7 AS (SELECT *, {tx!r} + {sc!r} * x - {rz!r} * y + {ry!r} * z AS x2, {ty!r} + {rz!r} * x + {sc!r} * y - {rx!r} * z AS y2,
      {tz!r} - {ry!r} * x + {rx!r} * y + {sc!r} * z AS z2 FROM q6),
    q8 AS (SELECT *, sqrt(x2 * x2 + y2 * y2) AS p, atan2(z2 * {a2!r}, sqrt(x2 * x2 + y2 * y2) * {b2!r}) AS t FROM q7)
    SELECT id, e, n, round(degrees(atan2(y2, x2)), 6) + 0.0 AS lon,
      round(degrees(atan2(z2 + {ep2 * b2!r} * pow(sin(t), 3), p - {e2w * a2!r} * pow(cos(t), 3))), 6) + 0.0 AS lat FROM q8"""


@query("bng_to_lonlat", _bng_sql())
def bng_to_lonlat(t):
    df = t.table("pairs").select("id", (C("ax") * 60000 + 50000).alias("e"), (C("ay") * 100000 + 20000).alias("n"))
    return proj.bng_to_lonlat(df, "e", "n").select("id", "e", "n", rd("lon").alias("lon"), rd("lat").alias("lat"))


@query("dms_to_decimal", """
    SELECT id, round(CASE WHEN least(d, m, s) < 0 THEN -1 ELSE 1 END * (abs(d) + abs(m) / 60 + abs(s) / 3600), 6) + 0.0 AS dms,
      round(CASE WHEN least(d, m, s) < 0 THEN -1 ELSE 1 END * (abs(d) + abs(m) / 60 + abs(s) / 6000), 6) + 0.0 AS wco
    FROM (SELECT id, CAST(floor(lon1) AS DOUBLE) AS d, CAST(id % 60 - 3 AS DOUBLE) AS m, CAST(id % 59 AS DOUBLE) AS s FROM pairs) q""")
def dms_to_decimal(t):
    df = t.table("pairs").select("id", F.floor("lon1").cast("double").alias("d"), (C("id") % 60 - 3).cast("double").alias("m"),
                                 (C("id") % 59).cast("double").alias("s"))
    return _out(df, dms=geo.dms_to_decimal("d", "m", "s"), wco=geo.wco_to_decimal("d", "m", "s"))


@query("sigma_to_depth", """
    SELECT id, round(bx * 0.1 - ax * 0.1 * (bx * 0.1 + ay + 5), 6) + 0.0 AS field,
      round(bx * 0.1 - ax * 0.1 * (bx * 0.1 + ay + 5), 6) + 0.0 AS point, round(-ax * 0.1, 6) + 0.0 AS sigma FROM pairs""")
def sigma_to_depth(t):
    sigma, h, zeta = -C("ax") * F.lit(0.1), C("ay") + 5, C("bx") * F.lit(0.1)
    point = geo.sigma_to_cartesian(sigma, -h, zeta)
    return _out(t.table("pairs"), field=geo.sigma_to_depth(sigma, h, zeta), point=point, sigma=geo.depth_to_sigma(point, -h, zeta))


@query("s_levels_to_depth", """
    SELECT id, k, round((2 * (s - cs) + cs * h) + z * (1 + (2 * (s - cs) + cs * h) / h), 6) + 0.0 AS v1,
      round(z + (z + h) * ((2 * s + cs * h) / (2 + h)), 6) + 0.0 AS v2
    FROM (SELECT id, k, -(k + 0.5) / 5 AS s, -pow((k + 0.5) / 5, 2) AS cs, ay + 5 AS h, bx * 0.1 AS z FROM pairs, (SELECT unnest([0,1,2,3,4]) AS k) l) q""")
def s_levels_to_depth(t):
    df = t.table("pairs").select("id", (C("ay") + 5).alias("h"), (C("bx") * F.lit(0.1)).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    s = -(C("k") + F.lit(0.5)) / 5
    cs = -(s * s)
    return df.select("id", "k", rd(geo.s_level_to_depth(s, cs, F.lit(2.0), "h", "z", 1)).alias("v1"), rd(geo.s_level_to_depth(s, cs, F.lit(2.0), "h", "z", 2)).alias("v2"))


@query("fixed_levels_to_depth", "SELECT id, k, round(-k * 10 + bx * 0.1, 6) + 0.0 AS z FROM pairs, (SELECT unnest([0,1,2,3]) AS k) l")
def fixed_levels_to_depth(t):
    df = t.table("pairs").select("id", (C("bx") * F.lit(0.1)).alias("zeta"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return df.select("id", "k", rd(geo.fixed_level_to_depth(C("k") * F.lit(10.0), "zeta")).alias("z"))


@query("rotate_vector", "SELECT id, round(bx * cos(a) - by_ * sin(a), 6) + 0.0 AS u, round(bx * sin(a) + by_ * cos(a), 6) + 0.0 AS v FROM (SELECT *, radians(lon1) AS a FROM pairs) q")
def rotate_vector(t):
    u, v = geo.rotate_vector("bx", "by_", F.radians("lon1"))
    return _out(t.table("pairs"), u=u, v=v)
