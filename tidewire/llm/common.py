"""Shared plumbing: the shared folder, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that a broadcast may hold (about 100 MB in memory).
BROADCAST_ROWS = 2_000_000
#: Rows of a table that ``lookup_join`` broadcasts whole (about 15 MB).
LOOKUP_ROWS = 100_000
#: Rows that a join deals out by their keys alone, since one task may take them all.
SALTED_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, on one machine alone, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables written as Parquet in the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no pending result reads."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; else as it is, for a shuffled join.

    ``df`` should be a written table, as its rows are counted here.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup_join(rows: DataFrame, found: DataFrame, key: str, how: str = "inner", limit: int = LOOKUP_ROWS, held: str | None = None) -> DataFrame:
    """``rows`` joined with ``found``, a written table in which each ``key`` stands once; no key makes a hot task.

    Up to ``limit`` rows of ``found`` are broadcast.  Of a larger table only those are whose key a thousandth of the
    rows or more have, which can be no more than a thousand; the others are joined by a shuffle.  ``how`` is inner,
    left, left_semi or left_anti; rows without a key meet nothing.  ``held`` names a column of ``found`` that tells how
    many rows have its key, if it is known.
    """
    if found.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(found), key, how)
    scratch = Scratch(rows.sparkSession, "lookup")
    keyed = rows.where(F.col(key).isNotNull())
    many = max(1000, keyed.count() // 1000)
    counts = found.select(key, F.col(held).alias("count")) if held else keyed.groupBy(key).count()
    heavy = scratch.save(counts.where(F.col("count") > many).select(key), "heavy")
    hot = scratch.save(found.join(F.broadcast(heavy), key, "left_semi"), "hot")
    cold = keyed.join(F.broadcast(heavy), key, "left_anti").join(found, key, how)
    out = keyed.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(hot), key, how).unionByName(cold)
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how in ("left", "left_anti") else out


def salted_join(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows``, a written table, joined with ``found``, in which each ``key`` stands once and whose rows may be long.

    A key that a thousandth of the rows or more have is dealt out to several tasks, and its row of ``found`` copied to
    each of them: about two thousand copies at most, whatever the sizes.  Up to ``SALTED_ROWS`` rows are joined as they are.
    """
    n = rows.count()
    if n <= SALTED_ROWS:
        return rows.join(found, key)
    many = max(1000, n // 1000)
    heavy = Scratch(rows.sparkSession, "salted").save(rows.groupBy(key).count().where(F.col("count") > many).select(key, F.ceil(F.col("count") / many).cast("int").alias("_salts")), "heavy")
    if not heavy.limit(1).count():
        return rows.join(found, key)
    heavy, others = F.broadcast(heavy), [F.col(c) for c in rows.columns if c != key]
    left = rows.join(heavy, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*others), F.col("_salts")).cast("int"))).drop("_salts")
    right = found.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column of ``df`` is called so, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_mod(id_col: str, mod: int):
    """The remainder of the CRC-32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
