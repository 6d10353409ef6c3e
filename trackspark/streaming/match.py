"""Streams: tumbling windows, online nearest match, smoothing as keyed state."""

from __future__ import annotations

import time
from collections.abc import Collection, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..shared import new_folder
from .watch import Watch


def start(stream: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Starts a stream that appends Parquet files to folder/data and keeps its progress in
    folder/checkpoint, so that a restart goes on where it ended: every so often ("200 milliseconds"), or
    else over what is there now, in batches, and then ends."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def written(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream of this schema has written to the folder."""
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, and returns what it has written as a table."""
    folder = folder or new_folder(stream.sparkSession, "stream")
    start(stream, folder).awaitTermination()
    return written(stream, folder)


class Live:
    """Streams that run until stopped, by name. A stream that has failed fails health() and stop() with its
    own error; started anew on the same folder it goes on from its checkpoint. Streams in clocked have
    state that goes with time (idle_ms): they make a batch at every trigger, whether rows come or not. With
    a watch, errors tell the stream's last lines, and whether it had read anything."""

    def __init__(self, streams: Mapping[str, DataFrame], folder: str, every: str = "200 milliseconds", clocked: Collection[str] = (), watch: Watch | None = None):
        self.streams, self.folder, self.clocked, self.watch = dict(streams), folder, frozenset(clocked), watch
        self.queries = {name: start(s, f"{folder}/{name}", every) for name, s in self.streams.items()}

    def health(self) -> dict[str, bool]:
        """Which streams have read anything yet; raises the error of one that has died."""
        for name, q in self.queries.items():
            if q.exception() is not None:
                raise RuntimeError(self._death(name, q))
        return {name: any(p["numInputRows"] for p in q.recentProgress) for name, q in self.queries.items()}

    def _death(self, name: str, query: StreamingQuery) -> str:
        run, what = str(query.runId), f"stream {name} died: {query.exception()}"
        if self.watch is None:
            return what
        return what + ("" if self.watch.rows.get(run) else "\nit died before its first row") + f"\nits last lines:\n{self.watch.tail(run)}"

    def stop(self) -> dict[str, DataFrame]:
        """Works off what has come, stops all streams, and returns what they have written."""
        try:
            for name, q in self.queries.items():
                if name in self.clocked:
                    _until_nothing_comes(q)
                else:
                    q.processAllAvailable()
        finally:
            for q in self.queries.values():
                q.stop()
        return {name: written(s, f"{self.folder}/{name}") for name, s in self.streams.items()}


def _until_nothing_comes(query: StreamingQuery) -> None:
    """Waits until a batch that began from now on has read nothing."""
    began = pd.Timestamp.now("UTC")
    while True:
        if query.exception() is not None:
            raise RuntimeError(f"stream died: {query.exception()}")
        last = query.lastProgress
        if last is not None and last["numInputRows"] == 0 and pd.Timestamp(last["timestamp"]) >= began:
            return
        time.sleep(0.05)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files at path; ts becomes event time."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n and total of value per keys and window of event time; rows later than late are left out."""
    out = stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", width)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.unix_millis("window.start").alias("window_ms"), "n", "total")


def to_the_end(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All windows of a stream made by windowed, run over what is there now: those that the watermark has
    closed, as written, and those still open, as their state stands."""
    folder = folder or new_folder(stream.sparkSession, "stream")
    return drained(stream, folder).unionByName(still_open(stream, folder))


def still_open(stream: DataFrame, folder: str) -> DataFrame:
    """The windows that a stopped stream of windowed has not written yet, from its state; if it goes on it
    writes them itself."""
    spark = stream.sparkSession
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    rows = state.select("key.*", F.col("value.count").alias("n"), F.col("value.sum").alias("total"))
    return rows.withColumn("window_ms", F.unix_millis("window.start")).select(stream.columns)


def hourly_windows(spark: SparkSession, path: str) -> DataFrame:
    """Hourly windows of an events table, read as a stream, to its end."""
    return to_the_end(windowed(event_stream(spark, path), ["event_type"], "value"))


def nearest_within(left: DataFrame, right: DataFrame, key: str, tolerance: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of two streams (key, ts, id) within tolerance, each with its distance: the state that it
    needs is bounded by the watermark. The nearest of an id is min_by(distance) downstream."""
    a = left.withWatermark("ts", late).alias("a")
    b = right.withWatermark("ts", late).alias("b")
    within = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.ts") >= F.col("a.ts") - F.expr(f"INTERVAL {tolerance}")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"INTERVAL {tolerance}"))
    delta = F.unix_micros("a.ts") - F.unix_micros("b.ts")
    return a.join(b, within).select(F.col(f"a.{key}").alias(key), F.col("a.id").alias("id"), F.col("a.ts").alias("ts"), F.col("b.id").alias("ref_id"), (delta / 1000).alias("delta_ms"))


def nearest_of_last(t: np.ndarray, came: np.ndarray, times: np.ndarray, keep: int) -> np.ndarray:
    """For each t the place of the nearest of the last keep of the first came times; the oldest of equally
    near ones, the latest where t is missing, -1 where none has come."""
    out = np.full(len(t), -1)
    padded = np.concatenate([np.full(keep, np.nan), times])
    for start in range(0, len(t), 4096):
        rows = slice(start, start + 4096)
        at = came[rows, None] + np.arange(keep)  # the places of the ring in padded
        far = np.abs(t[rows, None] - padded[at])
        far = np.where(np.isnan(far), np.inf, far)
        best = far.argmin(axis=1)
        known = np.isfinite(far[np.arange(len(best)), best])
        out[rows] = np.where(came[rows] == 0, -1, np.where(known, came[rows] - keep + best, came[rows] - 1))
    return out


class _Nearest(StatefulProcessor):
    """A ring of the last right rows of a key."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "ids array<long>, times array<double>", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # in a batch: by arrival, right rows first among rows of one time
        rows = pd.concat(list(rows), ignore_index=True)
        rows = rows.assign(_o=(rows["side"] == "left").astype(int)).sort_values(["seq", "_o"], kind="stable")
        held = list(zip(*(self.ring.get() or ([], [])), strict=True))
        right = (rows["side"] == "right").to_numpy()
        ids = np.concatenate([np.array([h[0] for h in held], np.int64), rows.loc[right, "id"].to_numpy(np.int64)])
        times = np.concatenate([np.array([np.nan if h[1] is None else h[1] for h in held], float), rows.loc[right, "t"].to_numpy(float)])
        left = rows[~right]
        came, t = (len(held) + np.cumsum(right))[~right], left["t"].to_numpy(float)
        at = nearest_of_last(t, came, times, self.keep)
        if right.any():
            kept = slice(max(0, len(ids) - self.keep), None)
            self.ring.update((ids[kept].tolist(), [None if x != x else x for x in times[kept].tolist()]))
        if len(left):
            found = at >= 0
            ref = pd.array(np.where(found, ids[at] if len(ids) else 0, 0), "Int64")
            ref[~found] = pd.NA
            delta = np.where(found, t - (times[at] if len(times) else 0.0), np.nan)
            yield pd.DataFrame({"key": key[0], "id": left["id"].to_numpy(np.int64), "ref_id": ref, "delta": pd.array(delta, "Float64")}).replace({np.nan: None}).astype({"ref_id": "Int64"})

    def close(self) -> None:
        pass


class _Smooth(StatefulProcessor):
    """The last smoothed value of a key."""

    def __init__(self, alpha: float, idle_ms: int | None):
        self.alpha, self.idle_ms = alpha, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last double", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        x, before = rows["x"].to_numpy(float), self.last.get()
        course = pd.Series(x if before is None else np.concatenate([[before[0]], x])).ewm(alpha=self.alpha, adjust=False, ignore_na=True).mean().to_numpy()
        known = np.isfinite(course)
        if known.any():
            self.last.update((float(course[known][-1]),))
        course = np.where(np.isnan(x), np.nan, course[len(course) - len(x) :])
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(np.int64), "smoothed": course}).replace({np.nan: None})

    def close(self) -> None:
        pass


def _with_state(stream: DataFrame, processor: StatefulProcessor, schema: str, idle_ms: int | None) -> DataFrame:
    """A keyed state needs Spark's RocksDB store, which the session gets for streams started from now on."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if idle_ms else "None")


def matched_now(stream: DataFrame, keep: int = 64, idle_ms: int | None = None) -> DataFrame:
    """Emit-now nearest match, per key of one stream of both sides (key, side, id, t, seq): each "left" row
    takes, of the last keep "right" rows that have come, the nearest in t (equally near: the oldest;
    without t: the latest), and is never revised. Rows come batch after batch, and by seq within one. State is
    a ring of keep rows a key. With idle_ms a ring goes when no right row has come for so long; such a stream
    goes on until it is stopped (Live, clocked) and can't be drained."""
    return _with_state(stream, _Nearest(keep, idle_ms), "key long, id long, ref_id long, delta double", idle_ms)


def smoothed_now(stream: DataFrame, alpha: float, idle_ms: int | None = None) -> DataFrame:
    """Exponential smoothing as state, per key of a stream (key, seq, x); missing values are skipped. Rows come
    batch after batch, and by seq within one. With idle_ms the state of a key goes when no value has come for
    so long; such a stream goes on until it is stopped (Live, clocked) and can't be drained."""
    return _with_state(stream, _Smooth(alpha, idle_ms), "key long, seq long, smoothed double", idle_ms)
