"""Fact builders: the reference's stateful reducers as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import parse_gap
from stintline.operators.windows import islands

SOURCE = ["frame_id", "message_ordinal", "change_ordinal", "row_ix"]


def grid_current(cell: DataFrame, at_frame: int | None = None) -> DataFrame:
    """Value of each (heat, row, column) after all messages: `r_i` starts the grid anew, `r_c` merges, newest source rank wins."""
    rows = cell if at_frame is None else cell.where(F.col("frame_id") <= at_frame)
    epoch = rows.groupBy("heat_id").agg(F.max(F.when(F.col("handle") == "r_i", F.col("frame_id"))).alias("from_frame"))
    live = rows.join(epoch, "heat_id").where("from_frame is null or frame_id >= from_frame")
    return live.groupBy("heat_id", "row_ix", "col_ix").agg(F.max_by("value", F.struct(*SOURCE[:3], "value")).alias("value"))


def gap_coordinates(grid: DataFrame) -> DataFrame:
    """(laps behind the leader, time within the lap group) of each row of a heat by position."""
    w = Window.partitionBy("heat_id").orderBy("position", "row_key")
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.withColumn("g", parse_gap(F.col("gap_text")))
    opens = F.when(F.col("g.kind") == "LAP_GROUP", F.struct(F.col("g.completed_laps").alias("laps"), F.col("row_key").alias("leader"), F.col("position").alias("at")))
    rows = rows.withColumn("group", F.last(opens, ignorenulls=True).over(seen)).withColumn("lead", F.first(F.when(F.col("g.kind") == "LAP_GROUP", F.col("g.completed_laps")), ignorenulls=True).over(seen))
    status = (
        F.when(F.col("position").isNull(), "POSITION_UNRESOLVED")
        .when(F.col("g.kind").isin("EMPTY", "UNKNOWN"), "VALUE_UNSUPPORTED")
        .when((F.col("g.kind") == "LAP_GROUP") | F.col("group").isNotNull(), F.when(F.col("lead") >= F.col("group.laps"), "EXACT").otherwise("GROUP_UNRESOLVED"))
        .otherwise("GROUP_UNRESOLVED")
    )
    exact = F.col("coordinate_status") == "EXACT"
    residual = F.when(F.col("g.kind") == "LAP_GROUP", F.lit(0)).otherwise(F.col("g.time_ms"))
    return rows.withColumn("coordinate_status", status).select(
        "heat_id",
        "row_key",
        "position",
        F.col("g.kind").alias("display_kind"),
        F.when(exact, F.col("lead") - F.col("group.laps")).alias("laps_behind"),
        F.when(exact, residual).cast("long").alias("residual_ms"),
        F.when(exact, F.col("group.leader")).alias("group_leader"),
        "coordinate_status",
    )


def gap_snapshot_quality(coordinates: DataFrame) -> DataFrame:
    """COMPLETE, PARTIAL or UNRESOLVED per heat."""
    n, good = F.count("*"), F.count_if(F.col("coordinate_status") == "EXACT")
    contiguous = (F.min("position") == 1) & (F.max("position") == F.count("position")) & (F.count_distinct("position") == F.count("position"))
    return coordinates.groupBy("heat_id").agg(n.alias("participants"), good.alias("resolved"), F.when((n == good) & contiguous, "COMPLETE").when(good > 0, "PARTIAL").otherwise("UNRESOLVED").alias("completeness"))


def change_segments(rows: DataFrame, by: list[str], order: list[str], value: Column, at: str) -> DataFrame:
    """Runs of an unchanged value as [started, ended), the last one open."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("value", value).withColumn("__before", F.lag(F.struct("value")).over(w))
    first = marked.where(F.col("__before").isNull() | ~F.col("value").eqNullSafe(F.col("__before.value")))
    return first.select(*by, "value", F.col(at).alias("started_at_us"), F.lead(at).over(w).alias("ended_at_us"), F.row_number().over(w).cast("long").alias("segment"))


def clock_offsets(clock: DataFrame, samples: int = 31) -> DataFrame:
    """Lower-middle median of the last `samples` offsets of a connection, as whole microseconds."""
    w = Window.partitionBy("conn_id").orderBy("received_at_us", "frame_id").rowsBetween(-(samples - 1), 0)
    offset = F.col("received_at_us") - F.col("provider_ts")
    xs = F.sort_array(F.collect_list(offset).over(w))
    n = F.size("xs")
    middle = F.call_function("div", F.get("xs", ((n - 1) / 2).cast("int")) + F.get("xs", (n / 2).cast("int")), F.lit(2).cast("bigint"))
    return clock.withColumn("xs", xs).select("conn_id", "frame_id", "received_at_us", middle.alias("offset_us"))


def last_ledger(cell: DataFrame, column: int = 4, dense_rows: int = 2, dense_share: float = 0.95) -> DataFrame:
    """Each LAST cell as CONFIRMED_LAP, REFRESH_REPEAT, UNCONFIRMED or INVALID.

    A snapshot (`r_i`) confirms nothing; an equal value in a dense refresh (most cells of a message repeat) is a repeat.
    """
    w = Window.partitionBy("heat_id", "row_ix").orderBy(*SOURCE[:3])
    rows = cell.where(F.col("col_ix") == column).withColumn("before", F.lag("value").over(w))
    message = Window.partitionBy("heat_id", "frame_id", "message_ordinal")
    same = F.col("value").eqNullSafe(F.col("before")).cast("int")
    dense = (F.count("*").over(message) >= dense_rows) & (F.avg(same).over(message) >= dense_share)
    kind = (
        F.when(F.col("value").isNull() | (F.col("value") <= 0), "INVALID")
        .when(F.col("handle") == "r_i", "UNCONFIRMED")
        .when(F.col("value").eqNullSafe(F.col("before")) & F.col("dense"), "REFRESH_REPEAT")
        .otherwise("CONFIRMED_LAP")
    )
    return rows.withColumn("dense", dense).select("heat_id", "row_ix", *SOURCE[:3], "value", kind.alias("classification"))


def laps_from_counter(counter: DataFrame) -> DataFrame:
    """A counter that goes from k to n gives laps k + 1 to n; only n has an instant."""
    w = Window.partitionBy("participant_id").orderBy("observed_at_us", "event_id")
    rows = counter.withColumn("k", F.lag("laps").over(w)).where("laps > k")
    rows = rows.withColumn("lap_number", F.explode(F.sequence(F.col("k") + 1, F.col("laps"))))
    return rows.select("participant_id", "lap_number", F.when(F.col("lap_number") == F.col("laps"), F.col("observed_at_us")).alias("completed_at_us"))


def lap_boundaries(passing: DataFrame) -> DataFrame:
    """Crossings of the finish line in strictly increasing time, the first as COVERAGE_START."""
    w = Window.partitionBy("participant_id").orderBy("provider_us", "event_id")
    rows = passing.where("start_mm = 0").withColumn("__high", F.max("provider_us").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("__high is null or provider_us > __high")
    kind = F.when(F.col("__high").isNull(), "COVERAGE_START").when(F.col("is_in_pit"), "PIT_FINISH").otherwise("MAIN_FINISH")
    return rows.select("participant_id", "event_id", "provider_us", kind.alias("kind"), (F.row_number().over(w) - 1).cast("long").alias("boundary"))


def canonical_laps(boundary: DataFrame, passing: DataFrame) -> DataFrame:
    """Consecutive boundaries as laps; a pit lap ends in the pits or holds a passing there."""
    w = Window.partitionBy("participant_id").orderBy("boundary")
    laps = boundary.withColumn("start_us", F.lag("provider_us").over(w)).where("start_us is not null")
    marks = passing.select("participant_id", "provider_us", "event_id", "is_in_pit")
    # each passing belongs to the first boundary at or after it: one union and one window
    both = marks.select("participant_id", "provider_us", "is_in_pit", F.lit(None).cast("long").alias("b")).unionByName(boundary.select("participant_id", "provider_us", F.lit(False).alias("is_in_pit"), F.col("boundary").alias("b")))
    order = Window.partitionBy("participant_id").orderBy("provider_us", F.col("b").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    owned = both.withColumn("boundary", F.first("b", ignorenulls=True).over(order)).where("b is null and boundary is not null")
    pits = owned.groupBy("participant_id", "boundary").agg(F.bool_or("is_in_pit").alias("any_pit"), F.count("*").alias("passings"))
    out = laps.join(pits, ["participant_id", "boundary"], "left")
    return out.select("participant_id", F.col("boundary").alias("lap_number"), "start_us", F.col("provider_us").alias("finish_us"), F.call_function("div", F.col("provider_us") - F.col("start_us"), F.lit(1000).cast("bigint")).alias("duration_ms"), ((F.col("kind") == "PIT_FINISH") | F.coalesce("any_pit", F.lit(False))).alias("is_pit_lap"), F.coalesce("passings", F.lit(0)).alias("passings"))


def board(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, current) of a message board: sparse upserts, deletes and clears in source order."""
    w = Window.partitionBy("heat_id").orderBy("message_ordinal").rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.sum(F.when(F.col("action") == "CLEAR", 1).otherwise(0)).over(w)
    rows = ops.withColumn("epoch", epoch)
    own = Window.partitionBy("heat_id", "message_id", "epoch").orderBy("message_ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("life", F.sum(F.when(F.col("action") == "DELETE", 1).otherwise(0)).over(own))
    upserts = rows.where("action = 'UPSERT'")
    merged = upserts.groupBy("heat_id", "message_id", "epoch", "life").agg(
        F.max_by("text_patch", F.when(F.col("text_patch").isNotNull(), F.col("message_ordinal"))).alias("text"),
        F.max_by("modality_patch", F.when(F.col("modality_patch").isNotNull(), F.col("message_ordinal"))).alias("modality"),
        F.min("message_ordinal").alias("first_ordinal"),
        F.max("message_ordinal").alias("last_ordinal"),
    )
    now = rows.groupBy("heat_id").agg(F.max("epoch").alias("epoch"))
    lives = rows.groupBy("heat_id", "message_id", "epoch").agg(F.max("life").alias("life"))
    current = merged.join(now, ["heat_id", "epoch"]).join(lives, ["heat_id", "message_id", "epoch", "life"])
    return merged, current


def feed_gaps(connection: DataFrame) -> DataFrame:
    """From each disconnect to the next connect; open at the end."""
    w = Window.partitionBy("session_id").orderBy("connected_at_us")
    rows = connection.withColumn("ended_at_us", F.lead("connected_at_us").over(w))
    return rows.where("disconnected_at_us is not null and (ended_at_us is null or ended_at_us > disconnected_at_us)").select("session_id", F.col("disconnected_at_us").alias("started_at_us"), "ended_at_us")


def sparse_last(rows: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Each field's last known value so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*[c for c in rows.columns if c not in fields], *[F.last(f, ignorenulls=True).over(w).alias(f) for f in fields])


def bucket_downsample(rows: DataFrame, by: list[str], at: str, most: int) -> DataFrame:
    """at most `most` points per scope: the first of each of most - 1 equal buckets, and the true last."""
    w = Window.partitionBy(*by).orderBy(at)
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).withColumn("__i", F.row_number().over(w)).withColumn("__b", F.ntile(most - 1).over(w))
    first = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(at)) == 1
    return rows.withColumn("__first", first).where((F.col("__n") <= most) | F.col("__first") | (F.col("__i") == F.col("__n"))).drop("__n", "__i", "__b", "__first")


def event_downsample(rows: DataFrame, by: list[str], at: str, event: str, most: int) -> DataFrame:
    """ends and events are kept; the rest is evenly spaced at (i * (n - 1)) div (k - 1); too many events are thinned so."""
    w = Window.partitionBy(*by).orderBy(at)
    every = Window.partitionBy(*by)
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(every))
    must = (F.col("__i") == 0) | (F.col("__i") == F.col("__n") - 1) | F.col(event)
    rows = rows.withColumn("__must", must).withColumn("__g", F.row_number().over(Window.partitionBy(*by, "__must").orderBy(at)) - 1).withColumn("__m", F.count("*").over(Window.partitionBy(*by, "__must")))
    rows = rows.withColumn("__all_must", F.count_if("__must").over(every))
    room = F.when(F.col("__must"), F.least(F.col("__all_must"), F.lit(most))).otherwise(F.greatest(F.lit(most) - F.col("__all_must"), F.lit(0)))
    # index i of k is at (i * (m - 1)) div (k - 1): g is one of them if the next multiple falls on it
    k, m, g = F.col("__k"), F.col("__m"), F.col("__g")
    i = F.ceil(g * (k - 1) / F.greatest(m - 1, F.lit(1)))
    hit = F.call_function("div", i * (m - 1), F.greatest(k - 1, F.lit(1)).cast("bigint")) == g
    rows = rows.withColumn("__k", room.cast("bigint"))
    keep = F.when(F.col("__n") <= most, True).when(k <= 0, False).when(k >= m, True).when(k == 1, g == 0).otherwise(hit & (i < k))
    return rows.where(keep).drop("__i", "__n", "__must", "__g", "__m", "__all_must", "__k")


def clip(rows: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Intervals cut to a range, with `carried_into_range` where they began before it."""
    inside = rows.where((F.col(start) < high) & (F.col(end).isNull() | (F.col(end) > low)))
    return inside.withColumn("carried_into_range", F.col(start) < low).withColumn(start, F.greatest(F.col(start), low)).withColumn(end, F.least(F.coalesce(F.col(end), high), high))


def groups_by_idle(rows: DataFrame, by: list[str], start: str, end: str, idle: int, name: str = "island") -> DataFrame:
    """rows with the number of their group; a new one begins after `idle` since the latest end so far."""
    w = Window.partitionBy(*by).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(rows.withColumn("__latest", latest), by, [start, end], F.col(start) - F.col("__latest") > idle, name).drop("__latest")
