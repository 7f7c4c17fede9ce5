"""Flag reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINISH, GREEN = "FINISH", "GREEN"
#: Of points at one instant: an exact start, an exact end, a state seen live.
_START, _END, _LIVE = 0, 1, 2


def _history(history: DataFrame, finish: DataFrame) -> DataFrame:
    """Known flag records (heat_id, flag, at, until): ends that are a neighbour's start by raw text share its instant, exact finishes are records too."""
    columns = {"ended_at_us": "long", "started_raw": "string", "ended_raw": "string"}
    rows = history.select("heat_id", "flag", "started_at_us", *[F.col(c) if c in history.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    rows = rows.where("started_at_us is not null").distinct()
    starts = rows.where("started_raw is not null").groupBy("heat_id", F.col("started_raw").alias("ended_raw")).agg(F.min(F.struct(F.col("flag") != FINISH, "started_at_us")).alias("next"))
    rows = rows.join(starts, ["heat_id", "ended_raw"], "left")
    until = F.when(F.col("next.started_at_us") >= F.col("started_at_us"), F.col("next.started_at_us")).otherwise(F.col("ended_at_us"))
    rows = rows.select("heat_id", "flag", F.col("started_at_us").alias("at"), until.alias("until"))
    return rows.unionByName(finish.select("heat_id", F.lit(FINISH).alias("flag"), F.col("finish_at_us").alias("at"), F.lit(None).cast("long").alias("until")))


def _nearest(near: Column, at: Column, fits) -> Column:
    """Of live points (at, flag) the nearest one that fits, the earlier of two."""
    found = F.filter(near, fits)
    return F.array_min(F.transform(found, lambda x: F.struct(F.abs(x.at - at).alias("away"), x.at.alias("at"), x.flag.alias("flag"))))


def reconcile_flags(live: DataFrame, history: DataFrame, tolerance_us: int = 120_000_000, bounds: DataFrame | None = None) -> DataFrame:
    """(heat_id, flag, started_at_us, ended_at_us, calibrated, end_calibrated): one timeline a heat of states seen live and exact records.

    live: heat_id, flag, started_at_us. history: heat_id, flag, started_at_us, and where known ended_at_us, started_raw and
    ended_raw (the provider's texts of the two instants). bounds: heat_id, green_at_us, finish_at_us, at most one row a heat.

    - A record's start is exact; the nearest live state of its flag within the tolerance (the earlier of two) is that start.
    - At a record's end begins the nearest free live state of another flag that came within the tolerance after it. If there
      is none, a successor is inserted: the state seen last by then. Where that is the record's own flag, or nothing was
      seen, the state is unknown until the next point. Ends inside another record, or at the start of one, are no points.
      Equal raw texts share the instant of the later record's start.
    - Free live states inside a closed record go; a record without an end is closed by the next live state.
    - FINISH stands at finish_at_us, unless a record of it is near; a live FINISH near it, or last of the heat, is that one.
      No end of a record at or after it counts. A heat that begins with a live GREEN later than green_at_us begins there.
    - At one instant exact starts go before exact ends and these before live states, then the smaller flag. Equal neighbours
      are one period, which lasts until the next begins.

    Rows without a heat or start are left out, repeated rows are one, a null flag is an unknown state. One sorted window a
    heat; what it looks at are the states within the tolerance of a point.
    """
    if bounds is None:
        bounds = history.sparkSession.createDataFrame([], "heat_id long, green_at_us long, finish_at_us long")
    bounds = bounds.select("heat_id", "green_at_us", "finish_at_us").dropDuplicates(["heat_id"])
    seen = live.select("heat_id", "flag", F.col("started_at_us").alias("at")).where("heat_id is not null and at is not null").distinct()
    near_finish = history.where(F.col("flag") == FINISH).join(bounds, "heat_id").where(F.abs(F.col("started_at_us") - F.col("finish_at_us")) <= tolerance_us)
    finish = bounds.where("finish_at_us is not null").join(near_finish.select("heat_id"), "heat_id", "left_anti")
    known = _history(history.where("heat_id is not null"), finish)

    def points(states: DataFrame) -> DataFrame:
        exact = known.select("heat_id", "flag", "at", "until", F.lit(_START).alias("kind"))
        ends = known.where("until is not null").select("heat_id", "flag", F.col("until").alias("at"), F.lit(None).cast("long").alias("until"), F.lit(_END).alias("kind"))
        return exact.unionByName(ends).unionByName(states.select("heat_id", "flag", "at", F.lit(None).cast("long").alias("until"), F.lit(_LIVE).alias("kind")))

    state = F.when(F.col("kind") == _LIVE, F.struct("at", "flag"))
    heat = Window.partitionBy("heat_id")
    around = heat.orderBy("at").rangeBetween(-tolerance_us, tolerance_us)
    told = points(seen).withColumn("near", F.collect_list(state).over(around)).where(F.col("kind") == _START)
    claimed = told.select("heat_id", "flag", _nearest(F.col("near"), F.col("at"), lambda x: x.flag == F.col("flag")).alias("own")).select("heat_id", "flag", F.col("own.at").alias("at")).where("at is not null")
    last = seen.groupBy("heat_id").agg(F.max_by("flag", "at").alias("flag"), F.max("at").alias("at")).where(F.col("flag") == FINISH)
    claimed = claimed.unionByName(last.join(bounds.where("finish_at_us is not null"), "heat_id").select("heat_id", "flag", "at")).distinct()

    # of all live states the one in force at a point, of the free ones those that follow it
    free = seen.join(claimed.withColumn("taken", F.lit(True)), ["heat_id", "flag", "at"], "left")
    marked = points(seen).join(free.select("heat_id", "flag", "at", "taken", F.lit(_LIVE).alias("kind")), ["heat_id", "flag", "at", "kind"], "left")
    after = heat.orderBy("at").rangeBetween(0, tolerance_us)
    until_now = heat.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    free_state = F.when((F.col("kind") == _LIVE) & F.col("taken").isNull(), F.struct("at", "flag"))
    marked = marked.withColumns(
        {
            "following": F.collect_list(free_state).over(after),
            "in_force": F.max(state).over(until_now),
            "covered_until": F.max("until").over(until_now),
            "open_start": F.max(F.when(F.col("kind") == _START, F.col("at"))).over(until_now),
        }
    )
    end = F.col("kind") == _END
    covered = F.coalesce(F.col("covered_until") > F.col("at"), F.lit(False))
    marked = marked.join(bounds, "heat_id", "left")
    shared = F.coalesce(F.col("open_start") == F.col("at"), F.lit(False))
    over = F.coalesce(F.col("at") >= F.col("finish_at_us"), F.lit(False))
    ends = marked.where(end & ~covered & ~shared & ~over)
    ends = ends.withColumn("next", _nearest(F.col("following"), F.col("at"), lambda x: x.flag != F.col("flag")))
    earlier = F.when(F.col("in_force.flag") != F.col("flag"), F.col("in_force.flag"))
    moved = ends.where("next is not null").select("heat_id", F.col("next.flag").alias("flag"), F.col("next.at").alias("at")).distinct()
    kept = marked.where((F.col("kind") == _LIVE) & F.col("taken").isNull() & ~covered).select("heat_id", "flag", "at")
    kept = kept.join(moved, ["heat_id", "flag", "at"], "left_anti")

    one = known.select("heat_id", "flag", "at", F.lit(_START).alias("kind"))
    one = one.unionByName(ends.select("heat_id", F.coalesce("next.flag", earlier).alias("flag"), "at", "kind")).unionByName(kept.withColumn("kind", F.lit(_LIVE)))
    one = one.groupBy("heat_id", "at").agg(F.min(F.struct("kind", F.col("flag").isNull(), "flag")).alias("first")).select("heat_id", "at", "first.flag", "first.kind")
    ordered = heat.orderBy("at")
    one = one.join(bounds, "heat_id", "left").withColumn("nr", F.row_number().over(ordered))
    early = F.coalesce((F.col("nr") == 1) & (F.col("flag") == GREEN) & (F.col("kind") == _LIVE) & (F.col("at") > F.col("green_at_us")), F.lit(False))
    one = one.select("heat_id", "flag", F.when(early, F.col("green_at_us")).otherwise(F.col("at")).alias("started_at_us"), (early | (F.col("kind") != _LIVE)).alias("calibrated"))
    by_start = heat.orderBy("started_at_us")
    rows = one.withColumn("nr", F.row_number().over(by_start)).withColumn("before", F.lag("flag").over(by_start))
    rows = rows.where((F.col("nr") == 1) | ~F.col("before").eqNullSafe(F.col("flag")))
    rows = rows.withColumn("ended_at_us", F.lead("started_at_us").over(by_start)).withColumn("end_calibrated", F.lead("calibrated").over(by_start))
    return rows.where("flag is not null").select("heat_id", "flag", "started_at_us", "ended_at_us", "calibrated", "end_calibrated")
