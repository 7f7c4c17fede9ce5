"""Structured Streaming forms of the feed operators; each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stintline.operators.history import POINT, Kept

#: Fixed value: how far provider instants may lie from receive times.
WATERMARK = "26 hours"


def frames(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """The bronze folder as a stream; the checkpoint of the query remembers what was taken."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def with_time(frame: DataFrame) -> DataFrame:
    return frame.withColumn("ts", F.timestamp_micros("received_at_us")).withWatermark("ts", WATERMARK)


def dedupe(frame: DataFrame, key: list[str]) -> DataFrame:
    """One row per natural key within the watermark."""
    return with_time(frame).dropDuplicatesWithinWatermark(key)


def ticks(frame: DataFrame, width: str = "1 second") -> DataFrame:
    """The newest handle and the count of each connection and tick."""
    rows = with_time(frame).groupBy("conn_id", F.window("ts", width))
    out = rows.agg(F.max_by("handle", F.struct("received_at_us", "frame_id")).alias("handle"), F.count("*").alias("frames"))
    return out.select("conn_id", F.unix_micros("window.start").alias("tick_us"), "handle", "frames")


def sessions(frame: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of frames of a handle without a longer pause."""
    out = with_time(frame).groupBy("handle", F.session_window("ts", gap)).agg(F.min("received_at_us").alias("first_us"), F.max("received_at_us").alias("last_us"), F.count("*").alias("frames"))
    return out.drop("session_window")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of all that is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class SparseHistory(StatefulProcessor):
    """The points of a scope that history keeps, by the rule of `history.Kept`; a newer point of a second replaces the one told before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        point = "second long, at_us long, seq long, value long, version long"
        self.last, self.prior = handle.getValueState("last", point), handle.getValueState("prior", point)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = Kept(*(tuple(x.get()) if x.exists() else None for x in (self.last, self.prior)))
        out = []
        for r in pd.concat(list(rows)).sort_values(["at_us", "seq"]).itertuples():
            if kept.take(int(r.at_us), int(r.seq), int(r.value), int(r.version), bool(r.is_event)):
                out.append((key[0], *kept.last))
        if kept.last:
            self.last.update(kept.last)
        if kept.prior:
            self.prior.update(kept.prior)
        yield pd.DataFrame(out, columns=["scope_key", "second", "at_us", "seq", "value", "version"])

    def close(self) -> None:
        pass


class Grid(StatefulProcessor):
    """The current value of each cell of a heat; `r_i` starts the grid anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "row_ix long, col_ix long", "value long, frame_id long, message_ordinal long, change_ordinal long")
        self.start = handle.getValueState("start", "frame_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.start.get()[0] if self.start.exists() else -1
        changed = {}
        for r in pd.concat(list(rows)).sort_values(["frame_id", "message_ordinal", "change_ordinal", "value"]).itertuples():
            if r.handle == "r_i" and r.frame_id > start:
                for place in list(self.cells.keys()):
                    if self.cells.getValue(place)[1] < r.frame_id:
                        self.cells.removeKey(place)
                changed = {p: v for p, v in changed.items() if v[1] >= r.frame_id}
                start = int(r.frame_id)
                self.start.update((start,))
            if r.frame_id < start:
                continue
            place, now = (int(r.row_ix), int(r.col_ix)), (int(r.value), int(r.frame_id), int(r.message_ordinal), int(r.change_ordinal))
            old = self.cells.getValue(place) if self.cells.containsKey(place) else None
            if old is None or (*now[1:], now[0]) >= (*tuple(old)[1:], old[0]):
                self.cells.updateValue(place, now)
                changed[place] = now
        yield pd.DataFrame([(key[0], *p, *v) for p, v in changed.items()], columns=["heat_id", "row_ix", "col_ix", "value", "frame_id", "message_ordinal", "change_ordinal"])

    def close(self) -> None:
        pass


def sparse_history(points: DataFrame) -> DataFrame:
    """T4 over (scope_key, at_us, seq, value, version, is_event); of each (scope_key, second) the newest point counts."""
    return points.groupBy("scope_key").transformWithStateInPandas(SparseHistory(), POINT, "append", "none")


def grid(cells: DataFrame) -> DataFrame:
    """T7 over the cells of a stream: changed cells of each batch, to be read by newest rank."""
    return cells.groupBy("heat_id").transformWithStateInPandas(Grid(), "heat_id long, row_ix long, col_ix long, value long, frame_id long, message_ordinal long, change_ordinal long", "append", "none")
