"""Table schemas, status flags and the catalogue of standard variables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Status flags (fixed values).
IN_DOMAIN = 0
LAND_CROSSED = -1
OPEN_CROSSED = -2
NOT_FOUND = -3
MASKED_ELEMENT = -4
BOTTOM_CROSSED = -5
PERMANENTLY_BEACHED = -6

FLAG_NAMES = {
    IN_DOMAIN: "in_domain",
    LAND_CROSSED: "land_crossed",
    OPEN_CROSSED: "open_crossed",
    NOT_FOUND: "not_found",
    MASKED_ELEMENT: "masked_element",
    BOTTOM_CROSSED: "bottom_crossed",
    PERMANENTLY_BEACHED: "permanently_beached",
}

# Element masks (fixed values).
SEA, BOUNDARY, LAND = 0, 1, 2

# Sentinels of the interchange format (fixed values).
INVALID_INT = -999
INVALID_FLOAT = 1.0e20

EARTH_RADIUS = 6371000.0
PHI_EPS = 1.0e-12

FIELDS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

SEEDS = T.StructType([
    T.StructField("particle_id", T.LongType()),
    T.StructField("group_id", T.IntegerType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("x3", T.DoubleType()),
])

ZONES = T.StructType([
    T.StructField("group_id", T.IntegerType()),
    T.StructField("cx", T.DoubleType()),
    T.StructField("cy", T.DoubleType()),
    T.StructField("radius", T.DoubleType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("depth", T.DoubleType()),
    T.StructField("cs", T.StringType()),
    T.StructField("epsg", T.StringType()),
])


@dataclass(frozen=True)
class Variable:
    kind: str  # INT or REAL
    units: str
    long_name: str


# Standard names with kind, units and long name (fixed values).
VARIABLES = {
    "group_id": Variable("INT", "NA", "Particle group ID"),
    "x": Variable("REAL", "m", "x"),
    "y": Variable("REAL", "m", "y"),
    "z": Variable("REAL", "m", "z"),
    "longitude": Variable("REAL", "degrees_east", "longitude"),
    "latitude": Variable("REAL", "degrees_north", "latitude"),
    "depth": Variable("REAL", "m", "depth"),
    "uo": Variable("REAL", "m s-1", "Eastward Current Velocity in the Water Column"),
    "vo": Variable("REAL", "m s-1", "Northward Current Velocity in the Water Column"),
    "wo": Variable("REAL", "m s-1", "Vertical Current Velocity in the Water Column"),
    "u10": Variable("REAL", "m s-1", "10 meter U wind component"),
    "v10": Variable("REAL", "m s-1", "10 meter V wind component"),
    "usd": Variable("REAL", "m s-1", "Sea surface wave stokes drift x velocity"),
    "vsd": Variable("REAL", "m s-1", "Sea surface wave stokes drift y velocity"),
    "h": Variable("REAL", "meters (m)", "Water depth"),
    "zeta": Variable("REAL", "meters (m)", "Sea surface elevation"),
    "land_boundary_encounters": Variable("INT", "None", "Number of land boundary encounters"),
    "error_status": Variable("INT", "None", "Status flag (1 - error state; 0 - ok)"),
    "in_domain": Variable("INT", "None", "In domain flag (1 - yes; 0 - no)"),
    "is_beached": Variable("INT", "None", "Is beached (1 - yes; 0 - no)"),
    "age": Variable("REAL", "days (d)", "Particle age"),
    "is_alive": Variable("INT", "None", "Is alive flag (1 - yes; 0 - no)"),
    "thetao": Variable("REAL", "degC", "Sea Water Potential Temperature"),
    "so": Variable("REAL", "psu", "Sea Water Salinity"),
    "rsdo": Variable("REAL", "W m-2", "Downwelling Shortwave Radiation in Sea Water "),
}

# Coordinate names by coordinate system, and file names by source (fixed values).
COORDINATE_NAMES = {
    "cartesian": {"x1": "x", "x2": "y", "x3": "z"},
    "geographic": {"x1": "longitude", "x2": "latitude", "x3": "depth"},
}
SOURCE_NAMES = {
    "standard": {"thetao": "thetao", "so": "so"},
    "fvcom": {"thetao": "temp", "so": "salinity"},
    "gotm": {"thetao": "temp", "so": "salt", "rsdo": "rad"},
}


@dataclass(frozen=True)
class Mesh:
    """A triangle mesh: a node table, an element table and its coordinate system.

    ``nodes``: node_id, x, y [, h, mask]; degrees when geographic.
    ``elements``: element_id, nv array<long>, nbe array<long> [, mask_c].
    """

    nodes: DataFrame
    elements: DataFrame
    cs: str = "cartesian"

    @property
    def geographic(self) -> bool:
        if self.cs not in ("cartesian", "geographic"):
            raise ValueError(f"unknown coordinate system {self.cs!r}")
        return self.cs == "geographic"
