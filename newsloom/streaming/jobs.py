"""Structured Streaming jobs: landing of records, url dedup with a horizon, source health, and request usage.

Health and usage are stateful processors whose state stays bounded: each source has a horizon behind the latest time it has
sent, what lies before it is settled, and rows that come later than that are put out as late instead of being lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as x
from ..storage import new_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds.
SECOND, HOUR, DAY = 10**6, 3600 * 10**6, 86_400 * 10**6
#: Kinds of events of a source, in the order in which those of one time and number count.
FAILURE, SUCCESS, BACK = 0, 1, 2
#: Stands for no time.
NEVER = -(2**63)


def stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; of a path that is one file, that file."""
    landed = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    files = landed.inputFiles()
    reader = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", per_trigger)
    if len(files) == 1 and files[0].endswith("/" + name):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def landed_records(feeds: DataFrame) -> DataFrame:
    """A stream of page or feed rows(url, html) as cleaned records."""
    return feeds.select(x.url_key(F.col("url")).alias("url_key"), x.record_id(F.lit("web"), F.col("url")).alias("id"), "url", x.clean_html(F.col("html")).alias("body"))


def first_seen(records: DataFrame, time: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """The first record of each url key within the horizon."""
    return records.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["url_key"])


def usage(log: DataFrame, width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Requests of each source in tumbling windows; later rows are dropped, or none where late is None (state then holds all windows)."""
    counts = (log.withWatermark("ts", late) if late else log).groupBy(F.window("ts", width), "source_id").agg(F.count("*").alias("requests"))
    return counts.select("source_id", F.col("window.start").alias("slot"), "requests")


EVENT = np.dtype([("ts", "<i8"), ("ord", "<i8"), ("kind", "<i1")])
HEALTH = "source_id long, ts timestamp, failures long, active boolean, late long, version long"


def packed_events(log: DataFrame) -> DataFrame:
    """(source_id, events) for each piece of a log(source_id, ts, ok[, ord, back]): its events as bytes, so that state gets few rows of a busy source.

    A row with `back` reactivates the source, whatever its `ok`; rows without source, time or outcome are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = np.zeros(len(batch), EVENT)
            events["ts"] = batch.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            events["ord"], events["kind"] = batch.column("ord").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy(zero_copy_only=False)
            source = batch.column("source_id").to_numpy(zero_copy_only=False)
            order = np.argsort(source, kind="stable")
            source, events = source[order], events[order]
            at = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else np.zeros(0, int)
            own = [events[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(source)))]
            yield pa.RecordBatch.from_arrays([pa.array(source[at], pa.int64()), pa.array(own, pa.binary())], names=["source_id", "events"])

    back = F.coalesce("back", F.lit(False)) if "back" in log.columns else F.lit(False)
    kind = F.when(back, BACK).when(F.col("ok"), SUCCESS).when(~F.col("ok"), FAILURE)
    number = F.coalesce(F.col("ord").cast("long"), F.lit(0)) if "ord" in log.columns else F.lit(0)
    rows = log.select(F.col("source_id").cast("long").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), number.cast("long").alias("ord"), kind.cast("byte").alias("kind"))
    return rows.where("source_id is not null and ts is not null and kind is not null").mapInArrow(run, "source_id long, events binary")


def replayed(failures: int, active: bool, kinds: np.ndarray, most: int) -> tuple[int, bool]:
    """Failures in a row and whether the source is active after events in order: `most` failures in a row make it inactive, and only a reactivation revives it."""
    for kind in kinds.tolist():
        if kind == FAILURE:
            failures += 1
            active = active and failures < most
        else:
            failures, active = 0, active or kind == BACK
    return failures, active


class Health(StatefulProcessor):
    """State of a source: what its settled events have come to, and the events within the horizon, which may still come out of order."""

    def __init__(self, most: int, horizon: int, idle: int):
        self.most, self.horizon, self.idle = most, horizon, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", "failures long, active boolean, settled long, last long, waiting binary, late long, version long")

    def read(self) -> list:
        return list(self.state.get()) if self.state.exists() else [0, True, NEVER, NEVER, b"", 0, 0]

    def settle(self, own: list, until: int) -> None:
        """Events up to a time come to their outcome and leave the state."""
        waiting = np.frombuffer(own[4], EVENT)
        n = int(np.searchsorted(waiting["ts"], until, "right"))
        own[0], own[1] = replayed(own[0], own[1], waiting["kind"][:n], self.most)
        own[2], own[4] = max(own[2], until), waiting[n:].tobytes()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = self.read()
        pieces = pd.concat([pdf[["events", "arrived"]] for pdf in rows])
        fresh, arrived = np.frombuffer(b"".join(pieces["events"]), EVENT), int(pieces["arrived"].max().value // 1000)
        late = fresh["ts"] <= own[2]
        waiting = np.sort(np.concatenate([np.frombuffer(own[4], EVENT), fresh[~late]]), order=["ts", "ord", "kind"])
        own[3] = max(own[3], int(fresh["ts"].max(initial=NEVER)))
        own[4], own[5], own[6] = waiting.tobytes(), own[5] + int(late.sum()), own[6] + 1
        if own[3] - self.horizon > own[2]:
            self.settle(own, own[3] - self.horizon)
        self.state.update(tuple(own))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if own[4]:
            self.handle.registerTimer((arrived + self.idle) // 1000)
        failures, active = replayed(own[0], own[1], np.frombuffer(own[4], EVENT)["kind"], self.most)
        last = pd.NaT if own[3] == NEVER else pd.Timestamp(own[3], unit="us")
        yield pd.DataFrame({"source_id": [key[0]], "ts": pd.Series([last], dtype="datetime64[ns]"), "failures": [failures], "active": [active], "late": [own[5]], "version": [own[6]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A source that has been silent for long keeps its outcome only."""
        own = self.read()
        self.settle(own, own[3])
        self.state.update(tuple(own))
        return iter(())

    def close(self) -> None:
        pass


def health(log: DataFrame, most: int = 5, horizon: int = 45 * DAY, idle: int = 7 * DAY) -> DataFrame:
    """A row whenever a batch brings events of a source: failures in a row, whether it is active, late events so far, and the number of the change.

    Events count in order of time, whatever the order of files, as long as none comes more than `horizon` (microseconds) of log time behind the latest
    one of its source, or after a silence of `idle`; those are counted as late and change nothing. State holds the events within the horizon of a source, and three numbers of all before."""
    # timers run by the time of arrival, on which no row is ever late
    arriving = packed_events(log).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 second")
    return arriving.groupBy("source_id").transformWithStateInPandas(Health(most, horizon, idle), HEALTH, "Append", "EventTime")


USAGE = "source_id long, slot timestamp, requests long, kind string, version long"


class Usage(StatefulProcessor):
    """State of a source: requests of the slots within the horizon."""

    def __init__(self, width: int, horizon: int):
        self.width, self.horizon = width, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("usage", "closed long, last long, version long, slots binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed, last, version, packed = self.state.get() if self.state.exists() else (NEVER, NEVER, 0, b"")
        held = np.frombuffer(packed, np.int64).reshape(-1, 2)
        fresh = pd.concat([pdf[["slot", "requests", "last"]] for pdf in rows])
        slots = np.concatenate([held[:, 0], fresh["slot"].to_numpy(np.int64)])
        n = np.concatenate([held[:, 1], fresh["requests"].to_numpy(np.int64)])
        slots, at = np.unique(slots, return_inverse=True)
        n = np.bincount(at, n, len(slots)).astype(np.int64)
        late = slots + self.width <= closed
        last = max(last, int(fresh["last"].max()))
        until = max(closed, last - self.horizon)
        done = ~late & (slots + self.width <= until)
        open_ = ~late & ~done
        self.state.update((until, last, version + 1, np.stack([slots[open_], n[open_]], axis=1).tobytes()))
        kind = np.where(late, "late", np.where(done, "closed", "open"))
        yield pd.DataFrame({"source_id": key[0], "slot": pd.Series(pd.to_datetime(slots, unit="us")).astype("datetime64[ns]"), "requests": n, "kind": kind, "version": version + 1})

    def close(self) -> None:
        pass


def usage_with_late(log: DataFrame, width: int = HOUR, horizon: int = DAY) -> DataFrame:
    """Requests of each source(log: source_id, ts) in slots: `open` counts so far, `closed` ones once the horizon has passed, and `late` ones that correct them.

    State holds the slots of a source within the horizon (horizon / width of them); no row is lost, however late: `usage_totals` adds all up."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.select(F.col("source_id").cast("long").alias("source_id"), (micros - F.pmod(micros, F.lit(width))).alias("slot"), micros.alias("last")).where("source_id is not null and slot is not null")
    return counted(rows).groupBy("source_id").transformWithStateInPandas(Usage(width, horizon), USAGE, "Append", "None")


def counted(rows: DataFrame) -> DataFrame:
    """(source_id, slot, requests, last) of each piece of rows(source_id, slot, last), so that state gets few rows of a busy source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(["source_id", "slot"]).aggregate([("last", "count"), ("last", "max")])
            yield from t.select(["source_id", "slot", "last_count", "last_max"]).rename_columns(["source_id", "slot", "requests", "last"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, "source_id long, slot long, requests long, last long")


def usage_totals(out: DataFrame) -> DataFrame:
    """(source_id, slot, requests, late): whole counts of what `usage_with_late` put out: closed and late ones add up, of open ones the last stands until the slot is closed."""
    own = F.col("requests")
    sums = out.groupBy("source_id", "slot").agg(F.sum(F.when(F.col("kind") == "closed", own)).alias("closed"), F.max_by(F.when(F.col("kind") == "open", own), F.when(F.col("kind") == "open", F.col("version"))).alias("open"), F.coalesce(F.sum(F.when(F.col("kind") == "late", own)), F.lit(0)).alias("late"))
    return sums.select("source_id", "slot", (F.coalesce("closed", "open", F.lit(0)) + F.col("late")).alias("requests"), "late")


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what has landed, into a Parquet table of the shared folder, and reads it."""
    spark = df.sparkSession
    path, state = new_path(spark, name), new_path(spark, name + "-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again overwrites itself

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # state on the executors' disks, with snapshots in the shared folder
    try:
        q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(f"{path}/batch=*")
