"""Structured Streaming jobs over (.., ts) events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions import scores


def landed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def land_in_order(spark: SparkSession, path: str) -> None:
    """Give the files of a folder, in order of their names, times one second apart: a stream takes older files first."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        files.setTimes(jvm.org.apache.hadoop.fs.Path(part), 1_000_000_000_000 + i * 1000, -1)


def on_time(events: DataFrame, ts: str = "ts", tier: str = "normal") -> DataFrame:
    """Events under the watermark of their poll tier: 36, 48 or 96 hours."""
    return events.withWatermark(ts, f"{scores.POLL_AGE_MS[tier] // scores.HOUR_MS} hours")


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", horizon: str = "48 hours") -> DataFrame:
    """Each key once within the horizon; state older than that is dropped."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by key."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def session_counts(events: DataFrame, key: str, ts: str = "ts", gap: str = "72 hours", late: str = "96 hours") -> DataFrame:
    """Sessions by key that end when nothing comes for longer than the gap."""
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def unseen_against(events: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Events whose key a static history does not have."""
    return events.join(history.select(key).distinct(), key, "left_anti")


#: Groups of keys that a stream's state is kept by.
GROUPS = 256


class _Chain(StatefulProcessor):
    """Keeps the story and time of the last report of each key of a group, until nothing came for longer than the horizon."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "keys array<string>, stories array<bigint>, at_us array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f[["key", "id", "at_us"]] for f in rows])
        code, keys = pd.factorize(frame["key"], use_na_sentinel=False)
        order = np.lexsort((frame["id"].to_numpy(), frame["at_us"].to_numpy(), code))
        code, ids, at = code[order], frame["id"].to_numpy()[order], frame["at_us"].to_numpy()[order]
        names = [None if pd.isna(k) else k for k in keys]
        held = {k: (s, t) for k, s, t in zip(*self.last.get(), strict=True)} if self.last.exists() else {}
        first = np.concatenate([[True], code[1:] != code[:-1]])
        before = np.concatenate([at[:1], at[:-1]])
        known = [held.get(k) for k in names]
        has = np.array([x is not None for x in known])
        before[first] = [at_ if x is None else x[1] for x, at_ in zip(known, at[first], strict=True)]
        begins = (at - before > self.horizon_ms * 1000) | (first & ~has[code])
        # what goes on at a key's first row is the story that the state holds
        goes_on = first & ~begins
        named = np.where(goes_on, np.array([0 if x is None else x[0] for x in known], np.int64)[code], ids)
        story = named[np.maximum.accumulate(np.where(begins | goes_on, np.arange(len(ids)), 0))]
        last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(ids) - 1]])
        held |= {names[c]: (s, t) for c, s, t in zip(code[last].tolist(), story[last].tolist(), at[last].tolist(), strict=True)}
        # keys that no report can reach any more go
        gone = (timerValues.getCurrentWatermarkInMs() - self.horizon_ms) * 1000
        held = {k: x for k, x in held.items() if x[1] >= gone}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.last.update((list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]))
            self.handle.registerTimer(max(x[1] for x in held.values()) // 1000 + self.horizon_ms + 1)
        else:
            self.last.clear()
        yield pd.DataFrame({"key": pd.Series([names[c] for c in code], dtype=object), "id": ids, "story": story})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "id": pd.Series([], dtype="int64"), "story": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def matched(reports: DataFrame, key: str, id_col: str, ts: str = "ts", horizon: str = "48 hours", late: str = "1 hour") -> DataFrame:
    """(key, id, story) of a stream of reports: the story of the key's last report if that is not older than the horizon, else a new one.

    A story is named by its first report.  State has an entry for each key that had a report within the horizon, and is kept
    by groups of keys, so that a batch reads and writes it once a group: entries go with the group's next report, or by
    an event-time timer, so it does not grow with history.  Reports of one key in one batch are taken by time,
    then by id; what is later than ``late`` is dropped.  The state store has to be RocksDB (``use_rocksdb``).
    """
    hours = int(horizon.split()[0])
    own = reports.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("bigint").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(ts).alias("ts"))
    return own.withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int")).groupBy("_group").transformWithStateInPandas(_Chain(hours * scores.HOUR_MS), "key string, id bigint, story bigint", "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streams' state in RocksDB, which keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keyed_batches(events: DataFrame, checkpoint: str, path: str, step: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A writer that runs ``step`` on each micro-batch and writes it to a folder of the batch's number.

    A batch that is replayed after a failure overwrites its own folder, so each takes effect once; offsets are
    committed after the write.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
