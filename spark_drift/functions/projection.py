"""UTM and British National Grid as Column expressions (Krüger series)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_drift.functions.geo import col

BANDS = "CDEFGHJKLMNPQRSTUVWXX"


def utm_zone_number(lon, lat) -> Column:
    lon, lat = col(lon), col(lat)
    plain = F.floor(F.pmod(lon + 180, F.lit(360.0)) / 6).cast("int") + 1
    return (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), F.lit(32))
        .when(
            lat.between(72, 84) & (lon >= 0) & (lon <= 42),
            F.when(lon <= 9, 31).when(lon <= 21, 33).when(lon <= 33, 35).otherwise(37),
        )
        .otherwise(plain)
    )


def utm_zone_letter(lat, missing: str = "error") -> Column:
    """Letter of the band; outside the bands an error, or null with ``missing`` = null."""
    lat = col(lat)
    index = F.floor((lat + 80) / 8).cast("int") + 1
    letter = F.lit(BANDS).substr(index, F.lit(1))
    if missing == "null":
        return F.when(lat.between(-80, 84), letter)
    return F.when(lat.between(-80, 84), letter).otherwise(
        F.raise_error(F.lit("latitude outside -80..84 has no zone letter")).cast("string")
    )


def valid_utm_zone(number, letter) -> Column:
    number, letter = col(number), F.upper(F.col(letter) if isinstance(letter, str) else letter)
    return number.between(1, 60) & letter.rlike("^[C-HJ-NP-X]$")


def epsg_code(lon, lat) -> Column:
    north = F.when(col(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700))
    return (north + utm_zone_number(lon, lat)).cast("int")


class TransverseMercator:
    """Krüger n-series to fourth order for one ellipsoid."""

    def __init__(self, a: float, f: float, k0: float, fe: float, fn: float, lat0: float = 0.0):
        n = f / (2 - f)
        self.n, self.k0, self.fe = n, k0, fe
        self.radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # coefficients of the published series (fixed values)
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
                      61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
                     17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        self.delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
                      56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        self.e = 2 * math.sqrt(n) / (1 + n)
        t = math.sinh(math.atanh(math.sin(lat0)) - self.e * math.atanh(self.e * math.sin(lat0)))
        xi = math.atan(t)
        xi += sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(self.alpha))
        self.fn = fn - k0 * self.radius * xi

    def forward(self, lon: Column, lat: Column, lon0: Column) -> tuple[Column, Column]:
        s = F.sin(lat)
        t = F.sinh(F.atanh(s) - F.lit(self.e) * F.atanh(F.lit(self.e) * s))
        d = lon - lon0
        xi0 = F.atan2(t, F.cos(d))
        eta0 = F.atanh(F.sin(d) / F.sqrt(t * t + 1))
        xi, eta = xi0, eta0
        for j, c in enumerate(self.alpha):
            k = 2.0 * (j + 1)
            xi = xi + F.lit(c) * F.sin(F.lit(k) * xi0) * F.cosh(F.lit(k) * eta0)
            eta = eta + F.lit(c) * F.cos(F.lit(k) * xi0) * F.sinh(F.lit(k) * eta0)
        scale = F.lit(self.k0 * self.radius)
        return F.lit(self.fe) + scale * eta, F.lit(self.fn) + scale * xi

    def inverse(self, easting: Column, northing: Column, lon0: Column) -> tuple[Column, Column]:
        scale = F.lit(self.k0 * self.radius)
        xi0 = (northing - F.lit(self.fn)) / scale
        eta0 = (easting - F.lit(self.fe)) / scale
        xi, eta = xi0, eta0
        for j, c in enumerate(self.beta):
            k = 2.0 * (j + 1)
            xi = xi - F.lit(c) * F.sin(F.lit(k) * xi0) * F.cosh(F.lit(k) * eta0)
            eta = eta - F.lit(c) * F.cos(F.lit(k) * xi0) * F.sinh(F.lit(k) * eta0)
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lat = chi
        for j, c in enumerate(self.delta):
            lat = lat + F.lit(c) * F.sin(F.lit(2.0 * (j + 1)) * chi)
        return lon0 + F.atan2(F.sinh(eta), F.cos(xi)), lat


_WGS84 = (6378137.0, 1 / 298.257223563)
_NORTH = TransverseMercator(*_WGS84, 0.9996, 500000.0, 0.0)


def _zone_of(epsg: Column) -> Column:
    return F.when(epsg > 32700, epsg - 32700).otherwise(epsg - 32600)


def _central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6 - 183)


def utm_from_lonlat_cols(lon, lat, epsg) -> tuple[Column, Column]:
    """Easting and northing in the zone of ``epsg`` (degrees in, metres out)."""
    epsg = F.lit(int(epsg)) if isinstance(epsg, (int, str)) and str(epsg).isdigit() else col(epsg)
    lon0 = _central_meridian(_zone_of(epsg))
    east, north = _NORTH.forward(F.radians(col(lon)), F.radians(col(lat)), lon0)
    return east, north + F.when(epsg > 32700, F.lit(1.0e7)).otherwise(F.lit(0.0))


def lonlat_from_utm_cols(easting, northing, epsg) -> tuple[Column, Column]:
    epsg = F.lit(int(epsg)) if isinstance(epsg, (int, str)) and str(epsg).isdigit() else col(epsg)
    lon0 = _central_meridian(_zone_of(epsg))
    shift = F.when(epsg > 32700, F.lit(1.0e7)).otherwise(F.lit(0.0))
    lon, lat = _NORTH.inverse(col(easting), col(northing) - shift, lon0)
    return F.degrees(lon), F.degrees(lat)


def utm_from_lonlat(df: DataFrame, lon: str = "lon", lat: str = "lat", epsg: int | None = None,
                    order: str | None = None) -> DataFrame:
    """Add easting, northing and epsg. Without a code, the first point by ``order`` fixes it for all."""
    if epsg is None:
        if order is None:
            raise ValueError("give an epsg code, or the column that tells which point is first")
        epsg = df.agg(F.min_by(epsg_code(lon, lat), order)).first()[0]
    east, north = utm_from_lonlat_cols(lon, lat, int(epsg))
    return df.withColumns({"easting": east, "northing": north, "epsg": F.lit(int(epsg))})


def lonlat_from_utm(df: DataFrame, easting: str = "easting", northing: str = "northing",
                    epsg: str | int = "epsg") -> DataFrame:
    lon, lat = lonlat_from_utm_cols(easting, northing, epsg)
    return df.withColumns({"lon": lon, "lat": lat})


_AIRY = (6377563.396, 1 - 6356256.909 / 6377563.396)
_BNG = TransverseMercator(*_AIRY, 0.9996012717, 400000.0, -100000.0, math.radians(49.0))

# Helmert shift OSGB36 -> WGS84 (fixed values): metres, parts per million, arc seconds.
_HELMERT_T = (446.448, -125.157, 542.060)
_HELMERT_S = -20.4894e-6
_HELMERT_R = (0.1502, 0.2470, 0.8421)


def bng_to_lonlat(df: DataFrame, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Adds WGS 84 lon, lat in degrees to British National Grid points, good to about 5 m (Helmert shift)."""
    c = F.col
    a, f = _AIRY
    e2 = f * (2 - f)
    lon, lat = _BNG.inverse(c(easting), c(northing), F.lit(math.radians(-2.0)))
    out = df.withColumns({"_lon": lon, "_lat": lat})
    out = out.withColumn("_nu", F.lit(a) / F.sqrt(F.lit(1.0) - F.lit(e2) * F.pow(F.sin("_lat"), 2)))
    x, y, z = c("_nu") * F.cos("_lat") * F.cos("_lon"), c("_nu") * F.cos("_lat") * F.sin("_lon"), c("_nu") * F.lit(1 - e2) * F.sin("_lat")
    out = out.withColumns({"_x": x, "_y": y, "_z": z})
    rx, ry, rz = (math.radians(r / 3600) for r in _HELMERT_R)
    s = F.lit(1 + _HELMERT_S)
    out = out.withColumns({
        "_x2": F.lit(_HELMERT_T[0]) + s * c("_x") - F.lit(rz) * c("_y") + F.lit(ry) * c("_z"),
        "_y2": F.lit(_HELMERT_T[1]) + F.lit(rz) * c("_x") + s * c("_y") - F.lit(rx) * c("_z"),
        "_z2": F.lit(_HELMERT_T[2]) - F.lit(ry) * c("_x") + F.lit(rx) * c("_y") + s * c("_z"),
    })
    a2, f2 = _WGS84
    b2 = a2 * (1 - f2)
    e2w, ep2 = f2 * (2 - f2), (a2 * a2 - b2 * b2) / (b2 * b2)
    out = out.withColumn("_p", F.sqrt(c("_x2") * c("_x2") + c("_y2") * c("_y2")))
    out = out.withColumn("_t", F.atan2(c("_z2") * F.lit(a2), c("_p") * F.lit(b2)))
    lat2 = F.atan2(c("_z2") + F.lit(ep2 * b2) * F.pow(F.sin("_t"), 3), c("_p") - F.lit(e2w * a2) * F.pow(F.cos("_t"), 3))
    out = out.withColumns({"lon": F.degrees(F.atan2(c("_y2"), c("_x2"))), "lat": F.degrees(lat2)})
    return out.drop("_lon", "_lat", "_nu", "_x", "_y", "_z", "_x2", "_y2", "_z2", "_p", "_t")
