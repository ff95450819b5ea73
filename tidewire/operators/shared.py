"""The shared folder, broadcasts behind a count, and joins without any."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers or short names that a broadcast may hold.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, on one machine alone, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> None:
    """Set the folder of checkpoints where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked for a join by shuffle and sort: by the size of files Spark may take it for small, and build it in the driver.

    Such estimates know neither compression, nor rows that ``explode`` makes of one.
    """
    return df.hint("merge")


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], most: int = 4096) -> DataFrame:
    """An inner equi-join in which no task gets all pairs of a frequent key.

    A key that more than ``most`` rows of a side have is cut into parts on both sides by a hash of the row, and each
    part of one side meets each of the other as a key of its own: about ``most`` x ``most`` pairs each.  There are at
    most as many such keys as ``most`` goes into the rows.  Rows without a key meet nothing.  Neither side, nor its
    counts, are ever broadcast.
    """
    counted = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    hot = counted(left, "_lp").join(shuffled(counted(right, "_rp")), keys).where("_lp > 1 or _rp > 1")
    checkpoint_dir(left.sparkSession)
    hot = hot.checkpoint()
    if not hot.limit(1).count():
        return left.join(shuffled(right), keys)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int")
        rows = df.join(sized(hot), keys, "left").withColumn(f"{own}_at", part).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return rows.drop("_lp", "_rp")

    both = dealt(left, "_lp", "_rp").join(shuffled(dealt(right, "_rp", "_lp")), [*keys, "_lp_at", "_rp_at"])
    return both.drop("_lp_at", "_rp_at")
