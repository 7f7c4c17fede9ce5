"""Gap trends, catch ranges, neighbours, tactical intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.operators.windows import PARTS, islands

RUN = ["focal_id", "relation"]
#: The closure windows, the look-back of trends, and how long samples are retained for both.
WINDOWS_S, AGO_S, TAIL_S = (30, 60, 180), 600, 1800


def is_eligible(gap: DataFrame) -> Column:
    """Known target, instant and gap, same lap, GREEN; states and feed gaps count where the table has them."""
    good = F.col("target_id").isNotNull() & F.col("observed_at_us").isNotNull() & (F.col("gap_ms") >= 0) & (F.col("our_lap") == F.col("target_lap")) & (F.col("flag") == "GREEN")
    for c in ("our_state", "target_state"):
        if c in gap.columns:
            good = good & (F.col(c) == "ON_TRACK")
    if "has_feed_gap" in gap.columns:
        good = good & F.col("has_feed_gap").eqNullSafe(F.lit(False))
    return F.coalesce(good, F.lit(False))


def eligible_runs(gap: DataFrame) -> DataFrame:
    """Eligible samples with the number of their contiguous run of one target; any other sample ends a run."""
    rows = gap.withColumn("eligible", is_eligible(gap))
    w = Window.partitionBy(*RUN).orderBy("observed_at_us", "seq")
    breaks = ~F.col("eligible") | ~F.coalesce(F.lag("eligible").over(w), F.lit(False)) | ~F.col("target_id").eqNullSafe(F.lag("target_id").over(w))
    return islands(rows.withColumn("__b", breaks), RUN, ["observed_at_us", "seq"], F.col("__b"), "run").drop("__b").where("eligible").drop("eligible")


def direction(relation: Column, change: Column) -> Column:
    return (
        F.when(change == 0, "STABLE")
        .when(relation == "AHEAD", F.when(change < 0, "CLOSING").otherwise("LOSING_GROUND"))
        .otherwise(F.when(change > 0, "PULLING_AWAY").otherwise("BEING_CAUGHT"))
    )


def _ago(window_s: int) -> Column:
    """The last sample of the run that is `window_s` or more older."""
    w = Window.partitionBy(*RUN, "run").orderBy("observed_at_us").rangeBetween(Window.unboundedPreceding, -window_s * 1_000_000)
    return F.max(F.struct("observed_at_us", "seq", "gap_ms", "our_lap")).over(w)


def _change(first: Column) -> tuple[Column, Column, Column]:
    """Change of the gap since a sample, the closure, and the closure of a lap."""
    change = F.col("gap_ms") - first["gap_ms"]
    closure = F.when(F.col("relation") == "AHEAD", -change).otherwise(change)
    laps = F.col("our_lap") - first["our_lap"]
    return change, closure, F.when(laps > 0, closure / laps)


def gap_trend(gap: DataFrame, window_s: int) -> DataFrame:
    """per sample the change since the last sample of its run that is `window_s` or more older."""
    rows = eligible_runs(gap).withColumn("first", _ago(window_s)).where("first is not null")
    change, closure, per_lap = _change(F.col("first"))
    elapsed = F.col("observed_at_us") - F.col("first.observed_at_us")
    return rows.select(
        *RUN,
        "target_id",
        "observed_at_us",
        "seq",
        "our_lap",
        F.lit(window_s).alias("window_s"),
        "gap_ms",
        change.alias("gap_change_ms"),
        (closure * 60_000_000.0 / elapsed).alias("closure_ms_per_min"),
        per_lap.alias("closure_ms_per_lap"),
        direction(F.col("relation"), change).alias("direction"),
    )


def sliding_closures(gap: DataFrame, seconds: tuple[int, ...] = WINDOWS_S, ago_s: int = AGO_S, tail_s: int = TAIL_S) -> DataFrame:
    """T5: each eligible sample with its change and closure over every window, and the gap of its run `ago_s` before, all within the tail.

    The first sample of a window is the last one of the run that is as old as the window or older, as in `gap_trend`.
    """
    order = Window.partitionBy(*RUN, "run").orderBy("observed_at_us")
    rows = eligible_runs(gap)
    first = F.struct("observed_at_us", "seq", "gap_ms")
    rows = rows.select("*", *[F.max(first).over(order.rangeBetween(-tail_s * 1_000_000, -w * 1_000_000)).alias(f"w{w}") for w in dict.fromkeys((*seconds, ago_s))])
    out = []
    for w in seconds:
        change = F.col("gap_ms") - F.col(f"w{w}.gap_ms")
        closure = F.when(F.col("relation") == "AHEAD", -change).otherwise(change)
        out += [change.alias(f"change_{w}_ms"), (closure * 60_000_000.0 / (F.col("observed_at_us") - F.col(f"w{w}.observed_at_us"))).alias(f"closure_{w}_ms_per_min")]
    kept = ["is_new"] if "is_new" in gap.columns else []
    return rows.select(*RUN, "target_id", "observed_at_us", "seq", "gap_ms", *out, F.col(f"w{ago_s}.gap_ms").alias("gap_ago_ms"), *kept)


def gap_lap_trend(gap: DataFrame, laps: int) -> DataFrame:
    """per sample the change since the last sample of its run exactly `laps` laps before."""
    rows = eligible_runs(gap)
    first = rows.select(*RUN, "run", (F.col("our_lap") + laps).alias("our_lap"), F.struct("observed_at_us", "seq", "gap_ms").alias("f"))
    pairs = rows.where(F.col("our_lap") >= laps).join(first, [*RUN, "run", "our_lap"]).where("f.observed_at_us < observed_at_us")
    best = pairs.groupBy(*RUN, "target_id", "observed_at_us", "seq", "our_lap", "gap_ms").agg(F.max("f").alias("f"))
    change = F.col("gap_ms") - F.col("f.gap_ms")
    rate = F.when(F.col("relation") == "AHEAD", -change).otherwise(change) / laps
    way = direction(F.col("relation"), change)
    catching = F.when((F.col("relation") == "AHEAD") & (rate > 0), rate).when((F.col("relation") == "BEHIND") & (rate < 0), -rate)
    return best.select(*RUN, "observed_at_us", "seq", "our_lap", F.lit(laps).alias("window_laps"), change.alias("gap_change_ms"), rate.alias("closure_ms_per_lap"), way.alias("direction"), (F.col("gap_ms") / catching).alias("catch_laps"))


def _caught(way: Column, per_lap: Column) -> Column:
    return F.when((way == "CLOSING") & (per_lap > 0), per_lap).when((way == "BEING_CAUGHT") & (per_lap < 0), -per_lap)


def _to_catch(rates: DataFrame, pace: Column) -> DataFrame:
    low, high = F.col("gap_ms") / F.col("fast"), F.col("gap_ms") / F.col("slow")
    return rates.where("n >= 2").select(*RUN, "observed_at_us", "seq", low.alias("min_laps"), high.alias("max_laps"), (low * pace).alias("min_time_ms"), (high * pace).alias("max_time_ms"))


def catch_range(trends: list[DataFrame], pace: Column) -> DataFrame:
    """F8: laps and time to the catch from the fastest and slowest of two closing windows or more."""
    rows = trends[0]
    for t in trends[1:]:
        rows = rows.unionByName(t)
    rate = _caught(F.col("direction"), F.col("closure_ms_per_lap"))
    return _to_catch(rows.groupBy(*RUN, "observed_at_us", "seq", "gap_ms").agg(F.max(rate).alias("fast"), F.min(rate).alias("slow"), F.count(rate).alias("n")), pace)


def catch_windows(gap: DataFrame, seconds: tuple[int, ...], pace: Column) -> DataFrame:
    """F8: `catch_range` of the trends over each of the windows, from one pass over the samples of a pair of cars."""
    rows = eligible_runs(gap.repartition(PARTS, *RUN))
    rows = rows.select("*", *[_ago(s).alias(f"__{s}") for s in seconds])
    told = [_change(F.col(f"__{s}")) for s in seconds]
    rates = F.filter(F.array(*[_caught(direction(F.col("relation"), change), per_lap) for change, _, per_lap in told]), lambda x: x.isNotNull())
    rows = rows.select(*RUN, "observed_at_us", "seq", "gap_ms", rates.alias("x")).where(F.size("x") > 0)
    # samples told more than once count as one
    rates = rows.groupBy(*RUN, "observed_at_us", "seq", "gap_ms").agg(F.max(F.array_max("x")).alias("fast"), F.min(F.array_min("x")).alias("slow"), F.sum(F.size("x")).alias("n"))
    return _to_catch(rates, pace)


def required_pace(relation: Column, ours: Column, target: Column, gap: Column, remaining_s: Column) -> Column:
    """Pace to catch the car ahead, or that the car behind needs to catch us, by the end."""
    laps = remaining_s * 1000.0 / ours
    return F.when((remaining_s > 0) & (ours > 0) & (target > 0) & (gap >= 0), F.when(relation == "AHEAD", target - gap / laps).otherwise(target + gap / laps))


def projected_gap(relation: Column, gap: Column, closure_per_lap: Column, laps: int) -> Column:
    """The gap after some laps; a closure shortens the gap to the car ahead and lengthens that to the car behind."""
    return gap + F.when(relation == "AHEAD", -1.0).otherwise(1.0) * closure_per_lap * laps


def neighbours(standing: DataFrame) -> DataFrame:
    """Leader, ahead and behind by position in class; NULL unless every member has a state and its own position, from 1 on."""
    w = Window.partitionBy("class_key").orderBy("position_class")
    rows = standing.withColumn("ahead_id", F.lag("participant_id").over(w)).withColumn("behind_id", F.lead("participant_id").over(w))
    valid = standing.groupBy("class_key").agg(
        ((F.count("*") == F.count("position_class")) & (F.count_distinct("position_class") == F.count("*")) & (F.min("position_class") == 1) & (F.count("state_kind") == F.count("*"))).alias("valid"),
        F.min_by("participant_id", "position_class").alias("leader_id"),
    )
    known = F.col("valid")
    return rows.join(valid, "class_key").select("class_key", "participant_id", *[F.when(known, F.col(c)).alias(c) for c in ("leader_id", "ahead_id", "behind_id")])


def tactical_interval(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Interval between two cars of one message: our own GAP to the target, the target's to us, our DIFF, theirs, then two GAPs to a common leader.

    cells: (message_id, participant_id, kind, value_ms, target_id); pairs: (message_id, ours_id, target_id).
    """
    direct = pairs.join(cells.select("message_id", F.col("participant_id").alias("ours_id"), "kind", "value_ms", "target_id"), ["message_id", "ours_id", "target_id"]).select("message_id", "ours_id", "target_id", F.when(F.col("kind") == "GAP", 1).otherwise(3).alias("rank"), "value_ms")
    turned = pairs.join(cells.select("message_id", F.col("participant_id").alias("target_id"), "kind", "value_ms", F.col("target_id").alias("ours_id")), ["message_id", "ours_id", "target_id"]).select("message_id", "ours_id", "target_id", F.when(F.col("kind") == "GAP", 2).otherwise(4).alias("rank"), "value_ms")
    own = cells.where("kind = 'GAP'").select("message_id", F.col("participant_id").alias("ours_id"), F.col("target_id").alias("leader"), F.col("value_ms").alias("a"))
    other = cells.where("kind = 'GAP'").select("message_id", F.col("participant_id").alias("target_id"), F.col("target_id").alias("leader"), F.col("value_ms").alias("b"))
    common = pairs.join(own, ["message_id", "ours_id"]).join(other, ["message_id", "target_id", "leader"]).select("message_id", "ours_id", "target_id", F.lit(5).alias("rank"), F.abs(F.col("a") - F.col("b")).alias("value_ms"))
    found = direct.unionByName(turned).unionByName(common).where("value_ms >= 0")
    best = found.groupBy("message_id", "ours_id", "target_id").agg(F.min(F.struct("rank", "value_ms")).alias("x"))
    status = F.lit("MISSING")
    for rank, name in enumerate(("OWN_GAP", "TARGET_GAP", "OWN_DIFF", "TARGET_DIFF", "COMMON_LEADER"), 1):
        status = F.when(F.col("x.rank") == rank, name).otherwise(status)
    return pairs.join(best, ["message_id", "ours_id", "target_id"], "left").select("message_id", "ours_id", "target_id", "x.value_ms", status.alias("status"))
