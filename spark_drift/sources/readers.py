"""Readers of fields, meshes, trajectories and text lists, and their catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_drift.operators.time import asof_frames
from spark_drift.schema import COORDINATE_NAMES, INVALID_FLOAT, INVALID_INT, SOURCE_NAMES, VARIABLES, Mesh
from spark_drift.util import one_row, order_neighbours, seconds_between, ts_literal


def read_fields(spark: SparkSession, path: str, variables: Sequence[str] | None = None, start=None, end=None,
                source: str | None = None) -> DataFrame:
    """Field rows of the wanted variables and period.

    Folders are partitioned by (source, variable, date): the variable and date conditions
    prune folders, the time condition prunes row groups."""
    df = spark.read.parquet(path)
    if source is not None and "source" in df.columns:
        df = df.where(F.col("source") == source)
    if variables is not None:
        df = df.where(F.col("variable").isin(list(variables)))
    for bound, test in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is not None:
            t = ts_literal(bound)
            df = df.where(test(F.col("time"), t))
            if "date" in df.columns:
                df = df.where(test(F.col("date"), t.cast("date")))
    return df


def read_mesh(spark: SparkSession, path: str, cs: str = "cartesian", shift: bool = True, radians: bool = False) -> Mesh:
    """Mesh tables under a folder: plane nodes less their minimum, geographic nodes in degrees, as all
    operators take them; ``radians`` for other use."""
    nodes, elements = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/elements")
    if cs == "geographic":
        if radians:
            nodes = nodes.withColumns({"x": F.radians("x"), "y": F.radians("y")})
    elif shift:
        low = one_row(nodes.agg(F.min("x").alias("x"), F.min("y").alias("y")))
        nodes = nodes.withColumns({"x": F.col("x") - F.lit(low["x"]), "y": F.col("y") - F.lit(low["y"])})
    return Mesh(nodes, elements, cs)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """Level table; depths counted down in the file become positive up."""
    return spark.read.parquet(f"{path}/levels").withColumn("depth", -F.abs("depth"))


def read_frames_at(fields: DataFrame, t, variables: Sequence[str], frames: DataFrame | None = None) -> DataFrame:
    """(variable, level, node_id, last, next): values at the two frames around ``t``."""
    rows = fields.where(F.col("variable").isin(list(variables)))
    times = frames if frames is not None else rows.select("time").distinct()
    one = fields.sparkSession.range(1).select(ts_literal(t).alias("time"))
    pair = one_row(asof_frames(one, times))
    last, nxt = ts_literal(pair["t_last"]), ts_literal(pair["t_next"])
    rows = rows.where((F.col("time") == last) | (F.col("time") == nxt))
    return rows.groupBy("variable", "level", "node_id").agg(
        F.max(F.when(F.col("time") == last, F.col("value"))).alias("last"),
        F.max(F.when(F.col("time") == nxt, F.col("value"))).alias("next"),
    )


def read_trajectories(spark: SparkSession, path: str, releases: Sequence[int] | None = None,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Fixes of the wanted ensemble members; a folder without them is an error."""
    df = spark.read.parquet(path)
    if releases is not None:
        df = df.where(F.col("release").isin(list(releases)))
    if df.isEmpty():
        raise FileNotFoundError(f"no trajectories of releases {releases} under {path}")
    return df.select(*columns) if columns else df


def file_coverage(fields: DataFrame, file: str | None = None, time: str = "time") -> DataFrame:
    """(file, t_first, t_last, gap_next_s, gap_prev_s); 0 at either end of the list."""
    if file is None:
        fields, file = fields.select("*", F.col("_metadata.file_path").alias("file")), "file"
    spans = fields.groupBy(F.col(file).alias("file")).agg(F.min(time).alias("t_first"), F.max(time).alias("t_last"))
    rows = order_neighbours(spans, ["t_first", "file"], F.unix_date(F.col("t_first").cast("date")),
                            lead={"t_first": "_next"}, lag={"t_last": "_prev"})
    gap = lambda a, b: F.coalesce(F.abs(seconds_between(F.col(a), F.col(b))), F.lit(0.0))
    return rows.select("file", "t_first", "t_last", gap("_next", "t_last").alias("gap_next_s"), gap("t_first", "_prev").alias("gap_prev_s"))


def validate_period(coverage: DataFrame, start, end, strict: bool = True) -> DataFrame:
    """One row (t_first, t_last, start_covered, end_covered); a time is covered when t_first ≤ t < t_last."""
    whole = coverage.agg(F.min("t_first").alias("t_first"), F.max("t_last").alias("t_last"))
    covered = lambda t: (ts_literal(t) >= F.col("t_first")) & (ts_literal(t) < F.col("t_last"))
    out = whole.withColumns({"start_covered": covered(start), "end_covered": covered(end)})
    if strict:
        row = one_row(out)
        if row["t_first"] == row["t_last"]:
            raise ValueError("the data set holds one time point only")
        if not (row["start_covered"] and row["end_covered"]):
            raise ValueError(f"{start} to {end} is not covered by {row['t_first']} to {row['t_last']}")
    return out


def time_slice(fields: DataFrame, variable: str, t) -> DataFrame:
    return fields.where((F.col("variable") == variable) & (F.col("time") == ts_literal(t)))


def mask_of(fields: DataFrame, variable: str, strict: bool = True) -> DataFrame:
    """1 where the value is missing. A variable without gaps carries no mask: an error."""
    rows = fields.where(F.col("variable") == variable)
    if strict and rows.where(F.col("value").isNull()).isEmpty():
        raise ValueError(f"variable {variable!r} carries no mask")
    return rows.withColumn("masked", F.col("value").isNull().cast("int")).drop("value")


def fill_masked(fields: DataFrame, value: float = 0.0) -> DataFrame:
    return fields.withColumn("value", F.coalesce("value", F.lit(float(value))))


def unpivot_arrays(df: DataFrame, dims: Sequence[str], column: str, trim_first_lat: bool = False, trim_last_lat: bool = False,
                   permutation: DataFrame | None = None) -> DataFrame:
    """Nested arrays in any dimension order to long rows; node = lon index · n_lat + lat index.

    ``dims`` names the nesting from the outside in: time, depth, lat and lon in any order,
    two to four of them. Polar rows may be trimmed; nodes may be permuted (place, node_id)."""
    dims = list(dims)
    if not 2 <= len(dims) <= 4 or not {"lat", "lon"} <= set(dims) <= {"time", "depth", "lat", "lon"}:
        raise ValueError(f"cannot unpivot dimensions {dims}")
    keep = [c for c in df.columns if c != column]
    out = df.withColumn("_a", F.col(column))
    for d in dims:
        if d == "lat":
            out = out.withColumn("_n_lat", F.size("_a"))
        out = out.select("*", F.posexplode("_a").alias(f"{d}_index", "_b")).withColumn("_a", F.col("_b")).drop("_b")
    lat, n_lat = F.col("lat_index"), F.col("_n_lat")
    if trim_first_lat:
        out = out.where(lat > 0)
        lat, n_lat = lat - 1, n_lat - 1
    if trim_last_lat:
        out = out.where(F.col("lat_index") < F.col("_n_lat") - 1)
        n_lat = n_lat - 1
    node = (F.col("lon_index") * n_lat + lat).cast("long").alias("node_id")
    idx = [F.col(f"{d}_index") for d in ("time", "depth") if d in dims]
    out = out.select(*keep, *idx, node, F.col("_a").cast("double").alias("value"))
    if permutation is not None:
        out = out.join(permutation.select("node_id", "place"), "node_id").withColumn("node_id", F.col("place")).drop("place")
    return out


def flip_levels(fields: DataFrame, n_levels: int | None = None, level: str = "level") -> DataFrame:
    """Level 0 at the other end of the column."""
    if n_levels is None:
        n_levels = one_row(fields.agg(F.max(level).alias("m")))["m"] + 1
    return fields.withColumn(level, (F.lit(n_levels - 1) - F.col(level)).cast("int"))


def apply_variable_catalogue(df: DataFrame, cs: str = "cartesian", precision: str = "d", source: str = "standard") -> DataFrame:
    """Standard names, types by precision (s: 32 bit, d: 64 bit), units and long names as metadata."""
    if precision not in ("s", "d"):
        raise ValueError("precision must be s or d")
    names = dict(COORDINATE_NAMES[cs]) | {v: k for k, v in SOURCE_NAMES[source].items()}
    renamed = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and k != v})
    kinds = {("INT", "s"): "int", ("INT", "d"): "long", ("REAL", "s"): "float", ("REAL", "d"): "double"}
    out = []
    for c in renamed.columns:
        v = VARIABLES.get(c)
        if v is None:
            out.append(F.col(c))
        else:
            out.append(F.col(c).cast(kinds[v.kind, precision]).alias(c, metadata={"units": v.units, "long_name": v.long_name}))
    return renamed.select(*out)


def _by_type(df: DataFrame, fix) -> DataFrame:
    new = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            new[f.name] = fix(F.col(f.name), F.lit(INVALID_INT).cast(f.dataType))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            new[f.name] = fix(F.col(f.name), F.lit(INVALID_FLOAT).cast(f.dataType))
    return df.withColumns(new)


def invalid_to_null(df: DataFrame) -> DataFrame:
    return _by_type(df, lambda c, bad: F.nullif(c, bad))


def null_to_invalid(df: DataFrame) -> DataFrame:
    return _by_type(df, lambda c, bad: F.coalesce(c, bad))


def _counted_rows(spark: SparkSession, path: str, pattern: str, width: int, what: str) -> DataFrame:
    """Rows of a text list whose first line gives their number; ``line`` rises in the order of the files'
    names and of the lines in each.

    A file's split starts at a byte of it, and lines of a split are read in order by one task: the
    place in the task tells the order within the split. Lines are numbered file by file."""
    order = ["file", "start", "at"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                         F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value"))
    lines = number_splits(lines, order)
    parts = lines.where(F.col("value") != "").withColumn("p", F.split("value", pattern))
    check = one_row(parts.agg(
        F.max(F.when(F.size("p") == 1, F.expr("try_cast(p[0] AS BIGINT)"))).alias("n"),
        F.count_if(F.size("p") == 1).alias("heads"),
        F.count_if(F.size("p") == width).alias("rows"),
        F.count_if(~F.size("p").isin(1, width)).alias("bad"),
    ))
    if check["heads"] != 1 or check["bad"]:
        raise ValueError(f"{what}: one count line and rows of {width} columns expected, got {check}")
    if check["n"] != check["rows"]:
        raise ValueError(f"{what}: {check['n']} rows declared, {check['rows']} found")
    return parts.where(F.size("p") == width)


def number_splits(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``line``, numbered from 0 along file, split and place: ranks within splits and the sizes of
    the splits before, of which there is one row each."""
    file, start, at = order
    inside = F.row_number().over(Window.partitionBy(file, start).orderBy(at)) - 1
    sizes = lines.groupBy(file, start).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(file, start, before.alias("_before"))
    return lines.withColumn("_in", inside).join(sizes, [file, start]).withColumn("line", (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before", *order)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(line, group_id, x1, x2, x3) from space-separated text headed by the number of rows."""
    rows = _counted_rows(spark, path, r"\s+", 4, "seed file")
    return rows.select("line", F.col("p")[0].cast("int").alias("group_id"), *[F.col("p")[i].cast("double").alias(f"x{i}") for i in (1, 2, 3)])


def read_snapshot(spark: SparkSession, path: str, start) -> DataFrame:
    """Seeds (group_id, x1, x2, x3) of a saved state whose stored time must be the wanted start."""
    df = spark.read.parquet(path)
    wrong = df.where(~F.col("time").eqNullSafe(ts_literal(start)))
    if not wrong.isEmpty():
        raise ValueError(f"the saved state is not of {start}")
    return df.select("group_id", "x1", "x2", "x3")


def read_open_boundary_nodes(spark: SparkSession, path: str, delimiter: str = r"\s+") -> DataFrame:
    """(node_id) counted from 0, from text rows of three columns with the node id counted from 1 in the middle."""
    rows = _counted_rows(spark, path, delimiter, 3, "open boundary file")
    return rows.select((F.trim(F.col("p")[1]).cast("long") - 1).alias("node_id"))


def describe_variables(fields: DataFrame) -> DataFrame:
    """(variable, n, n_times, n_levels, n_nodes, dtype, units, long_name); nulls are no item.

    One scan: the nodes and levels of a time are bits of words of 64, so that a task folds the cells of a block into
    one small row before anything is shuffled, and distinct items are counted as bits of merged words."""
    word = lambda c: F.shiftright(F.col(c).cast("long"), 6)
    bits = lambda c: F.bit_or(F.when(F.col(c).isNotNull(), F.expr(f"shiftleft(1L, cast({c} & 63 AS INT))")))
    blocks = fields.groupBy("variable", "time", word("level").alias("_l"), word("node_id").alias("_i")).agg(
        F.count(F.lit(1)).alias("_n"), bits("level").alias("_levels"), bits("node_id").alias("_nodes"))
    item = lambda kind, at, held, n: F.struct(F.lit(kind).alias("kind"), F.col(at).cast("string").alias("at"), held.cast("long").alias("bits"), n.cast("long").alias("n"))
    # n is carried by one of the three kinds
    items = blocks.select("variable", F.explode(F.array(
        item("n_times", "time", F.when(F.col("time").isNotNull(), 1), F.col("_n")),
        item("n_levels", "_l", F.col("_levels"), F.lit(0)),
        item("n_nodes", "_i", F.col("_nodes"), F.lit(0)))).alias("i")).select("variable", "i.*")
    words = items.groupBy("variable", "kind", "at").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    counted = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.bit_count("bits").cast("long"))), F.lit(0)).alias(k)
    sizes = words.groupBy("variable").agg(F.sum("n").alias("n"), *[counted(k) for k in ("n_times", "n_levels", "n_nodes")])
    pairs = [F.struct(F.lit(k).alias("k"), F.struct(F.lit(v.units).alias("units"), F.lit(v.long_name).alias("long_name")).alias("v"))
             for k, v in VARIABLES.items()]
    about = F.map_from_entries(F.array(*pairs))
    out = sizes.withColumn("_a", F.element_at(about, F.col("variable")))
    return out.select("variable", "n", "n_times", "n_levels", "n_nodes", F.lit(dict(fields.dtypes)["value"]).alias("dtype"),
                      "_a.units", "_a.long_name")
