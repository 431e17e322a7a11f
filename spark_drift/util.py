"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def one_row(df: DataFrame) -> dict:
    """The single row of a global aggregate."""
    return df.first().asDict()


def skew_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a hot key of ``left`` can be split although ``right`` was grouped by the keys.

    Adaptive execution splits a hot partition only where both inputs are shuffled for the
    join itself; a right side that comes grouped by the same keys is used as it lies and
    rules that out. One more (constant) key makes both sides shuffle. When the right side is
    small enough to be broadcast there is no shuffle and the key costs nothing."""
    keys = list(keys)
    same = F.pmod(F.hash(*keys), F.lit(1))
    return left.withColumn("_same", same).join(right.withColumn("_same", same), [*keys, "_same"], how).drop("_same")


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that meets the other by a shuffle, never by a broadcast through the driver.

    Spark judges a side by its compressed files and doesn't count the rows that an ``explode`` adds. Once a
    broadcast is planned, adaptive execution keeps it when it sees the true size, since the other plan has
    more shuffles. Sides that grow with the mesh, its frames or the points are named by this."""
    return df.hint("merge")


#: Rows of a block and pairs of a task in ``join_in_blocks``.
BLOCK_ROWS, TASK_PAIRS, MOST_TASKS = 2048, 4_000_000, 20_000


def join_in_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on whole-numbered ``keys`` whose tasks get a like share of the pairs, not of the rows or bytes.

    The rows of a key are dealt into blocks on both sides by a hash of the whole row, and every block of one
    side meets every block of the other in a place of its own: a key that many rows share is spread over as
    many tasks as its pairs need, which byte sizes don't show. Keys of one side alone are left out first."""
    keys = list(keys)
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), keys)
    sizes = cut_lineage(sizes)
    pairs = one_row(sizes.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr")).alias("n")))["n"] or 0
    tasks = int(min(max(1, -(-pairs // TASK_PAIRS)), MOST_TASKS))
    blocks = sizes.select(*keys, *[F.ceil(F.col(n) / BLOCK_ROWS).cast("int").alias(b) for n, b in (("_nl", "_bl"), ("_nr", "_br"))])

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        row = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
        rows = skew_safe_join(shuffled(df), blocks, keys).withColumn(own, F.pmod(row, F.col(n_own)))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other).cast("long") - 1)))
        # one column: of several, a constant one would drop out of the join's keys, and with it what is dealt here
        return rows.withColumn("_place", F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, "_l", "_r")])).drop("_bl", "_br", "_l", "_r").repartition(tasks, "_place")

    a = dealt(left, "_l", "_bl", "_r", "_br")
    b = dealt(right, "_r", "_br", "_l", "_bl").drop(*keys)
    return a.join(shuffled(b), "_place").drop("_place")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark_drift_"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp (either kind), as a long."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    """later − earlier in seconds, as a double."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def ts_literal(t) -> Column:
    """A timestamp_ntz literal from a string, a datetime or a Column."""
    return t if isinstance(t, Column) else F.lit(str(t)).cast("timestamp_ntz")


def uniform(*keys: Column | str | int) -> Column:
    """Repeatable uniform draw in [0, 1) from the md5 of the keys.

    The same keys give the same draw after a task is retried, which
    ``rand`` does not promise when its input is repartitioned."""
    text = F.concat_ws("|", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gaussian(*keys: Column | str | int) -> Column:
    """Repeatable standard normal draw (Box–Muller on two uniform draws)."""
    u1 = F.lit(1.0) - uniform(*keys, "a")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * uniform(*keys, "b"))


def order_neighbours(df: DataFrame, order: Sequence[str], bucket: Column, by: Sequence[str] = (),
                     lead: dict[str, str] | None = None, lag: dict[str, str] | None = None) -> DataFrame:
    """Values of the following (``lead``) and preceding (``lag``) row as new columns.

    ``bucket`` must rise with ``order``. Rows are ordered inside a bucket; only the first and
    last row of each bucket travel further, so no task orders the whole table."""
    by, order, lead, lag = list(by), list(order), lead or {}, lag or {}
    rows = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*by, "_bucket").orderBy(*order)
    outer = Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")
    at = F.struct(*order)
    ends = rows.groupBy(*by, "_bucket").agg(
        *[F.min_by(c, at).alias(f"_first_{o}") for c, o in lead.items()],
        *[F.max_by(c, at).alias(f"_last_{o}") for c, o in lag.items()],
    )
    ends = ends.select(*by, "_bucket", *[F.lead(f"_first_{o}").over(outer).alias(f"_out_{o}") for o in lead.values()],
                       *[F.lag(f"_last_{o}").over(outer).alias(f"_out_{o}") for o in lag.values()])
    for c, o in lead.items():
        rows = rows.withColumn(f"_in_{o}", F.lead(c).over(inner))
    for c, o in lag.items():
        rows = rows.withColumn(f"_in_{o}", F.lag(c).over(inner))
    names = [*lead.values(), *lag.values()]
    rows = rows.join(ends, [*by, "_bucket"])
    rows = rows.withColumns({o: F.coalesce(f"_in_{o}", f"_out_{o}") for o in names})
    return rows.drop("_bucket", *[f"_in_{o}" for o in names], *[f"_out_{o}" for o in names])


def number_rows(df: DataFrame, key: str, out: str, width: int = 65_536) -> DataFrame:
    """Number rows 1..n in the order of a distinct integer ``key``.

    Each task sorts one block of at most ``width`` keys; block sizes are summed over
    blocks of blocks, so no task sees more than ``width`` rows up to width³ keys."""
    k = F.col(key)
    rows = df.withColumn("_b", F.floor(k / F.lit(width)).cast("long"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    blocks = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    blocks = blocks.withColumn("_s", F.floor(F.col("_b") / F.lit(width)).cast("long"))
    inner = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    supers = blocks.groupBy("_s").agg(F.sum("_n").alias("_m"))
    outer = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("_s", F.coalesce(F.sum("_m").over(outer), F.lit(0)).alias("_so"))
    blocks = blocks.withColumn("_bo", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(supers, "_s")
    blocks = blocks.select("_b", (F.col("_bo") + F.col("_so")).alias("_off"))
    return rows.join(blocks, "_b").withColumn(out, (F.col("_r") + F.col("_off")).cast("long")).drop("_b", "_r", "_off")
