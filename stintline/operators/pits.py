"""Pit stops, tyre stints, obligations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.operators.windows import array_mad, array_median


def completed_pits(pit: DataFrame) -> DataFrame:
    """Completed stops, one per number (else per instants); the latest exit wins."""
    good = pit.where("completed and entered_at_us is not null and exited_at_us >= entered_at_us")
    key = F.coalesce(F.col("stop_number").cast("string"), F.concat_ws("-", "entered_at_us", "exited_at_us"))
    best = good.withColumn("__key", key).groupBy("participant_id", "__key").agg(F.max_by(F.struct(*good.columns), F.struct("exited_at_us", "entered_at_us")).alias("x"))
    return best.select("x.*")


def pit_stops(state: DataFrame) -> DataFrame:
    """An observed change into IN_PIT opens a stop, the next ON_TRACK or OUT_LAP closes it.

    The first row of a car is a baseline only. A stop's number is its source count if that is ahead, else one more
    than the last: r + max over i <= r of (count_i - i), nothing below 0.
    """
    w = Window.partitionBy("participant_id").orderBy("observed_at_us", "event_id")
    before = F.lag("state_kind").over(w)
    out_at = F.first(F.when(F.col("state_kind").isin("ON_TRACK", "OUT_LAP"), F.col("observed_at_us")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = state.withColumn("before", before).withColumn("exited_at_us", out_at).where("state_kind = 'IN_PIT' and before is not null and before <> 'IN_PIT'")
    r = F.row_number().over(w)
    ahead = (F.col("pit_count") - r) if "pit_count" in state.columns else F.lit(None).cast("int")
    rows = rows.withColumn("r", r).withColumn("ahead", ahead)
    number = F.col("r") + F.greatest(F.lit(0), F.coalesce(F.max("ahead").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return rows.select("participant_id", number.cast("long").alias("stop_number"), F.col("observed_at_us").alias("entered_at_us"), "exited_at_us", F.col("exited_at_us").isNotNull().alias("completed"))


def tyre_stints(lap: DataFrame, pit: DataFrame) -> DataFrame:
    """N completed stops give n + 1 stints; laps by lap numbers where the stop has them, else by instants."""
    done = completed_pits(pit)
    w = Window.partitionBy("participant_id").orderBy("exited_at_us", "entered_at_us")
    after = done.select(
        "participant_id",
        (F.row_number().over(w) + 1).alias("stint_number"),
        F.col("exited_at_us").alias("started_at_us"),
        F.lead("entered_at_us").over(w).alias("ended_at_us"),
        F.col("exited_lap").alias("started_lap"),
        F.lead("entered_lap").over(w).alias("ended_lap"),
    )
    first = done.groupBy("participant_id").agg(F.min_by("entered_at_us", F.struct("exited_at_us", "entered_at_us")).alias("ended_at_us"), F.min_by("entered_lap", F.struct("exited_at_us", "entered_at_us")).alias("ended_lap"))
    cars = lap.groupBy("participant_id").agg(F.max("lap_number").alias("max_lap"))
    first = cars.select("participant_id").join(first, "participant_id", "left").select("participant_id", F.lit(1).alias("stint_number"), F.lit(None).cast("long").alias("started_at_us"), "ended_at_us", F.lit(None).cast("long").alias("started_lap"), "ended_lap")
    stints = first.unionByName(after).join(cars, "participant_id", "left")
    by_time = stints.where("started_lap is null").select("participant_id", "stint_number", "started_at_us", "ended_at_us").join(lap.select("participant_id", "completed_at_us"), "participant_id")
    by_time = by_time.where("completed_at_us > coalesce(started_at_us, -1) and (ended_at_us is null or completed_at_us <= ended_at_us)").groupBy("participant_id", "stint_number").agg(F.count("*").alias("seen"))
    laps = F.when(F.col("started_lap").isNotNull(), F.greatest(F.lit(0), F.coalesce("ended_lap", "max_lap") - F.col("started_lap"))).otherwise(F.coalesce("seen", F.lit(0)))
    out = stints.join(by_time, ["participant_id", "stint_number"], "left")
    return out.select("participant_id", F.col("stint_number").cast("long").alias("stint_number"), "started_at_us", "ended_at_us", "started_lap", "ended_lap", laps.cast("long").alias("completed_laps"), (F.col("stint_number") == 1).alias("is_partial"), F.col("ended_at_us").isNull().alias("is_current"))


def obligations(pits: Column, duration_s: Column, required: Column, elapsed_s: Column) -> Column:
    """Mandatory stops and even cadence as a struct; NULL fields without a valid race plan."""
    ok = duration_s.isin(14_400, 21_600, 43_200, 86_400) & required.between(2, 8) & (elapsed_s >= 0)
    left = F.greatest(F.lit(0), required - pits)
    time = F.greatest(F.lit(0.0), duration_s - elapsed_s)
    first = duration_s / (required + 1)
    target = F.when(left > 0, (pits + 1) * first)
    fields = {
        "remaining_pits": left,
        "remaining_time_s": time,
        "initial_equal_stint_target_s": first,
        "remaining_equal_stint_s": time / (left + 1),
        "stop_load_per_hour": F.when((left > 0) & (time > 0), left / (time / 3600.0)),
        "next_equal_pit_target_elapsed_s": target,
        "next_equal_pit_in_s": F.when(target.isNotNull(), F.greatest(F.lit(0.0), target - elapsed_s)),
        "stint_schedule_deviation_s": elapsed_s - target,
    }
    return F.struct(*[F.when(ok, v).alias(k) for k, v in fields.items()])


def pit_lane_anomaly(pit: DataFrame) -> DataFrame:
    """The last measured stop against three or more before it: beyond 3 MAD (deviations cut to integers)."""
    xs = completed_pits(pit).where("pit_lane_ms is not null").groupBy("participant_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("exited_at_us", "entered_at_us", "pit_lane_ms"))), lambda x: x.pit_lane_ms).alias("xs"))
    xs = xs.where("size(xs) >= 4").withColumn("last", F.element_at("xs", -1)).withColumn("base", F.slice("xs", 1, F.size("xs") - 1))
    xs = xs.withColumn("median_ms", array_median(F.col("base"))).withColumn("mad_ms", array_mad(F.col("base"), True))
    return xs.where(F.abs(F.col("last") - F.col("median_ms")) > 3 * F.col("mad_ms")).select("participant_id", F.col("last").alias("pit_lane_ms"), "median_ms", "mad_ms", (F.abs(F.col("last") - F.col("median_ms")) - 3 * F.col("mad_ms")).alias("excess_ms"))
