"""Read models: current values, history, archive windows, comparisons, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """R2: latest values of each scope by source order."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("x")).select(*by, "x.*")


def snapshot(lap: DataFrame, state: DataFrame, pit: DataFrame, at_us: Column | int) -> DataFrame:
    """Each car as it stood at an instant: laps, last lap, state, stops."""
    until = at_us if isinstance(at_us, Column) else F.lit(at_us)
    laps = lap.where(F.col("completed_at_us") <= until).groupBy("participant_id", "class_key").agg(F.max("lap_number").alias("laps"), F.max_by("duration_ms", "completed_at_us").alias("last_lap_ms"), F.min("duration_ms").alias("best_lap_ms"))
    now = state.where(F.col("observed_at_us") <= until).groupBy("participant_id").agg(F.max_by("state_kind", "observed_at_us").alias("state_kind"))
    stops = pit.where(F.col("completed") & (F.col("exited_at_us") <= until)).groupBy("participant_id").agg(F.count("*").alias("pits"))
    return laps.join(now, "participant_id", "left").join(stops, "participant_id", "left").withColumn("pits", F.coalesce("pits", F.lit(0)))


def archive_window(keyframe: DataFrame, finish: DataFrame) -> DataFrame:
    """Where a replay ends: the first keyframe at or after FINISH if within 60 s, else the last before it."""
    rows = keyframe.join(finish, "conn_id", "left")
    after = F.min(F.when((F.col("at_us") >= F.col("finish_us")) & (F.col("at_us") <= F.col("finish_us") + 60_000_000), F.col("at_us")))
    before = F.max(F.when(F.col("at_us") < F.col("finish_us"), F.col("at_us")))
    ends = rows.groupBy("conn_id").agg(F.min("at_us").alias("start_us"), F.max("at_us").alias("last_us"), after.alias("after"), before.alias("before"), F.max("finish_us").alias("finish_us"), F.count("*").alias("keyframes"))
    end = F.when(F.col("finish_us").isNull(), F.col("last_us")).otherwise(F.coalesce("after", "before", "last_us"))
    kind = F.when(F.col("keyframes") == 1, "terminal_snapshot").when(F.col("finish_us").isNull(), "partial_capture").otherwise("replay")
    return ends.select("conn_id", "start_us", end.alias("end_us"), kind.alias("kind"), (F.col("last_us") > end).alias("tail_omitted"))


def timeline(stint: DataFrame, pit: DataFrame, low: Column, high: Column) -> DataFrame:
    """Stint and pit segments in turn, cut to a range."""
    a = stint.select("participant_id", F.lit("stint").alias("kind"), F.coalesce("started_at_us", low).alias("s"), F.coalesce("ended_at_us", high).alias("e"))
    b = pit.select("participant_id", F.lit("pit").alias("kind"), F.col("entered_at_us").alias("s"), F.coalesce("exited_at_us", high).alias("e"))
    rows = a.unionByName(b).where((F.col("s") < high) & (F.col("e") > low)).withColumn("s", F.greatest("s", low)).withColumn("e", F.least("e", high))
    return rows.withColumn("segment", F.row_number().over(Window.partitionBy("participant_id").orderBy("s", "e", "kind")).cast("long"))


def alert(rows: DataFrame, key: str, severity: str, when: Column, at: str, consequence: Column, by: str = "participant_id") -> DataFrame:
    """An alert record of each row that meets a condition."""
    return rows.where(when).select(F.lit(key).alias("key"), F.lit(severity).alias("severity"), F.col(by).alias("scope_key"), F.col(at).alias("at_us"), consequence.cast("double").alias("numeric_consequence"))


def ingest_health(frame: DataFrame, gap: DataFrame) -> DataFrame:
    """Frames by state, newest frame, open gap, per connection."""
    seen = frame.groupBy("conn_id").agg(F.count("*").alias("frames"), F.count_if(F.col("decode_state") == "failed").alias("failed"), F.max("received_at_us").alias("latest_us"), F.min("received_at_us").alias("floor_us"))
    return seen.join(gap.where("ended_at_us is null").select("conn_id", F.lit(True).alias("open_gap")).distinct(), "conn_id", "left").withColumn("open_gap", F.coalesce("open_gap", F.lit(False)))


def keyframe_payload(rows: DataFrame) -> DataFrame:
    """One nested payload per keyframe."""
    cars = F.array_sort(F.collect_list(F.struct("participant_id", "class_key", "laps", "last_lap_ms", "best_lap_ms", "state_kind", "pits")))
    return rows.groupBy("at_us").agg(F.struct(F.count("*").alias("n"), cars.alias("cars")).alias("payload"))
