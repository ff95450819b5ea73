"""Writers: keyed replacement of a Parquet table, ledgers, reports, and dry runs that write nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import merge_patches, upsert


def commit(spark: SparkSession, table_path: str, incoming: DataFrame, patches: DataFrame | None, version: str, key: str = "id") -> str:
    """Write the next version of a stories table beside the last one and return its path.

    Each version is a folder of its own, so a run that fails leaves the last one whole and one that repeats writes
    the same again: readers follow the path that the ledger names.
    """
    stories = spark.read.parquet(table_path)
    if patches is not None:
        stories = merge_patches(stories, patches, key)
    target = f"{table_path.rstrip('/')}-{version}"
    upsert(stories, incoming, key).write.mode("overwrite").parquet(target)
    return target


def append_ledger(row: DataFrame, path: str) -> None:
    row.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot(rows: DataFrame, predicted: list[str], path: str) -> None:
    """Rows for a benchmark as JSON below ``path``: full, and blind without what was predicted of them."""
    report(rows, f"{path}/full")
    report(rows.drop(*predicted), f"{path}/blind")


def dry_run(changes: DataFrame) -> DataFrame:
    """The change set alone, by kind of action."""
    return changes.groupBy("action").count()
