"""Incremental jobs: rank sync, publication bursts, drop alerts.

All sources are files read by Structured Streaming; every job can be started
again from its checkpoint without double counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspan.operators.search import best_page
from quillspan.sources import sinks

SEARCH_SCHEMA = "site_id bigint, event_id bigint, query string, page string, dt date, ts timestamp, position double, impressions bigint, clicks bigint"


def search_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Landed Parquet files of search rows as a stream."""
    return spark.readStream.schema(SEARCH_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


SNAPSHOT_SCHEMA = "site_id bigint, keyword string, current_position double, previous_position double, best_position double, impressions bigint, clicks bigint"


class RankSync:
    """R1: history append and keyword snapshot merge, once per batch.

    The snapshot is kept in ``buckets`` parts by a hash of (site, keyword).  A
    batch reads and writes only the parts that its keywords fall into, into a
    folder named by the batch, and then says in a table of one row per part
    which batch has the newest of each; so its cost follows the batch, not the
    snapshot.  The history of a batch overwrites its own folder as well.  A
    replayed batch starts from the versions before it and leaves the same files
    behind; parts that neither the last nor the present batch refers to are
    deleted.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, keyword: str):
        return F.pmod(F.xxhash64("site_id", keyword), F.lit(self.buckets)).cast("int")

    def _files(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _batches(self) -> list[int]:
        """Batches whose versions are written, in order."""
        files, path = self._files(f"{self.root}/versions")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        done = (n.removeprefix("batch=") for n in names if n.startswith("batch=") and files.exists(self._files(f"{self.root}/versions/{n}/_SUCCESS")[1]))
        return sorted(map(int, done))

    def _versions(self, batch_id: int) -> dict[int, int]:
        """Which batch has the newest of each part, after ``batch_id``; at most one row a part."""
        if batch_id < 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version bigint").parquet(f"{self.root}/versions/batch={batch_id}").collect()}

    def _parts(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/snapshot/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(SNAPSHOT_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SNAPSHOT_SCHEMA)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        earlier = [b for b in self._batches() if b < batch_id]
        before = self._versions(earlier[-1] if earlier else -1)
        now = best_page(batch).persist()
        sinks.history_rows(now, F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.root}/history/batch={batch_id}")
        touched = [r[0] for r in now.select(self._bucket("query").alias("b")).distinct().collect()]  # at most one a part
        old = self._parts({b: before[b] for b in touched if b in before})
        merged = sinks.merge_keywords(old, now, now.limit(0)).withColumn("bucket", self._bucket("keyword"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/snapshot/batch={batch_id}")
        after = before | dict.fromkeys(touched, batch_id)
        rows = self.spark.createDataFrame(sorted(after.items()), "bucket int, version bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/batch={batch_id}")
        now.unpersist()
        if len(earlier) > 1:
            self._forget(self._versions(earlier[-2]), before, after)

    def _forget(self, older: dict[int, int], before: dict[int, int], after: dict[int, int]) -> None:
        """Delete parts that were superseded before the last batch."""
        for bucket, version in older.items():
            if version not in (before.get(bucket), after.get(bucket)):
                files, path = self._files(f"{self.root}/snapshot/batch={version}/bucket={bucket}")
                files.delete(path, True)

    def run(self, rows: DataFrame) -> int:
        """Work through all files there are; returns the last batch id (-1 without any)."""
        query = rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=-1)

    def snapshot(self) -> DataFrame:
        """The keyword snapshot after the last batch."""
        done = self._batches()
        return self._parts(self._versions(done[-1] if done else -1))

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/history")


def daily_counts(events: DataFrame, site, delay: str = "1 day") -> DataFrame:
    """R2: rows per site and day as a stream; a day is final once the watermark has passed it."""
    return events.withColumn("site", site).withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "site").agg(F.count("*").alias("n")).select("site", F.col("w.start").cast("date").alias("day"), "n")


def burst_from_days(days: DataFrame) -> DataFrame:
    """Share of the busiest day from the finished days."""
    return days.groupBy("site").agg(F.count("*").alias("days"), F.sum("n").alias("total"), (F.floor(F.max("n") / F.sum("n") * 10000 + 0.5) / 10000.0).alias("burst_share"))


ALERT_SCHEMA = "site_id bigint, query string, event_id bigint, previous_position double, current_position double, delta double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastPosition(StatefulProcessor):
    """State of one (site, query): its last position and event, and when it was last heard of.

    A timer on event time forgets a key that has been silent for ``ttl_ms``;
    each row heard moves it.  Of a key's rows in a batch only three numbers are
    held at once, to bring them into the order of their events.
    """

    def __init__(self, least: float, ttl_ms: int):
        self.least, self.ttl_ms = least, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "position double, event_id bigint, expires bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["event_id"].to_numpy(np.int64), f["position"].to_numpy(np.float64), f["ts"].to_numpy("datetime64[ms]").astype(np.int64)) for f in rows]
        ids, positions, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
        before, seen, expires = self.last.get() if self.last.exists() else (None, -1, None)
        order = np.argsort(ids, kind="stable")
        order = order[ids[order] > seen]  # others are replayed or late
        if not len(order):
            return
        ids, positions, newest = ids[order], positions[order], int(times[order].max())
        first = np.append(True, ids[1:] != ids[:-1])
        ids, positions = ids[first], positions[first]
        previous = np.append(np.nan if before is None else before, positions[:-1])
        until = max(newest, timerValues.getCurrentWatermarkInMs()) + self.ttl_ms
        if expires is None or until > expires:
            if expires is not None:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(until)
        self.last.update((float(positions[-1]), int(ids[-1]), until if expires is None else max(until, expires)))
        hit = np.flatnonzero(positions - previous >= self.least)
        if len(hit):
            yield pd.DataFrame({"site_id": key[0], "query": key[1], "event_id": ids[hit], "previous_position": previous[hit], "current_position": positions[hit], "delta": positions[hit] - previous[hit]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def drop_alerts(rows: DataFrame, least: float = 3.0, delay: str = "1 day", ttl_days: int = 45) -> DataFrame:
    """R3: last position of each (site, query) as keyed state; a row that lost ``least`` positions is emitted.

    Rows carry rising event ids, so replays are dropped; state of keys silent
    for ``ttl_days`` of event time goes.  State lies in RocksDB, not on the heap;
    this sets the session's state store accordingly.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    watched = rows.filter("position IS NOT NULL").select("site_id", "query", "event_id", "ts", "position").withWatermark("ts", delay)
    return watched.groupBy("site_id", "query").transformWithStateInPandas(LastPosition(least, ttl_days * 86_400_000), ALERT_SCHEMA, "append", "EventTime")


def batch_drop_alerts(rows: DataFrame, least: float = 3.0) -> DataFrame:
    """The same alerts over a whole table."""
    from pyspark.sql import Window

    w = Window.partitionBy("site_id", "query").orderBy("event_id")
    before = rows.filter("position IS NOT NULL").withColumn("previous_position", F.lag("position").over(w))
    return before.withColumn("delta", F.col("position") - F.col("previous_position")).filter(F.col("delta") >= least).select("site_id", "query", "event_id", "previous_position", F.col("position").alias("current_position"), "delta")
