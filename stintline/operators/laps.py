"""Clean laps and pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.operators.windows import PARTS, overlap_sums

KEY = ["participant_id", "lap_number"]


def is_clean_lap(duration: Column, flags: Column, in_lap: Column, out_lap: Column, pit: Column, gap: Column) -> Column:
    """A positive time, all flags GREEN and at least one, and the four marks known to be false."""
    known = [x.eqNullSafe(F.lit(False)) for x in (in_lap, out_lap, pit, gap)]
    return F.coalesce((duration > 0) & (F.size(flags) > 0) & F.forall(flags, lambda f: f.eqNullSafe(F.lit("GREEN"))), F.lit(False)) & known[0] & known[1] & known[2] & known[3]


def _of_each(lap: DataFrame, spans: DataFrame, parts: int) -> DataFrame:
    """Periods (heat_id, kind, r_start, r_end) of a heat as those of each of its participants.

    Both meet by heat and slot of its participants, dealt among `parts` tasks: a heat is not one task here either. A
    participant gets those that overlap the time from its first lap's start to its last lap's end; no other can overlap a lap.
    """
    slots = 4 * parts
    own = lap.groupBy("heat_id", "participant_id").agg(F.min("started_at_us").alias("__from"), F.max("completed_at_us").alias("__to"))
    own = own.withColumn("__slot", F.pmod(F.xxhash64("participant_id"), F.lit(slots)).cast("int"))
    each = spans.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    both = own.repartition(parts, "heat_id", "__slot").join(each, ["heat_id", "__slot"]).where("r_start < __to and (r_end is null or r_end > __from)")
    return both.select("heat_id", "participant_id", "kind", "r_start", "r_end")


def _covered(lap: DataFrame, periods: DataFrame, kinds: list[str], seen: DataFrame | None, parts: int) -> DataFrame:
    rows = lap.withColumn("l_start", F.col("started_at_us")).withColumn("l_end", F.col("completed_at_us"))
    return overlap_sums(rows, periods, ["heat_id", "participant_id"], kinds, seen, ["participant_id"], parts).drop("l_start", "l_end")


def _flags(flag: DataFrame) -> DataFrame:
    kind = F.when(F.col("flag") == "GREEN", F.lit("green")).otherwise(F.lit("other"))
    return flag.select("heat_id", kind.alias("kind"), F.col("started_at_us").alias("r_start"), F.col("ended_at_us").alias("r_end"))


def flag_cover(lap: DataFrame, flag: DataFrame, parts: int = PARTS) -> DataFrame:
    """Adds non_green (a flag of the heat other than GREEN overlaps the lap) and green_us (how much of it GREEN covers)."""
    rows = _covered(lap, _of_each(lap, _flags(flag), parts), ["green", "other"], None, parts)
    return rows.withColumn("non_green", F.col("other_n") > 0).drop("green_n", "other_n", "other_us")


def clean_laps(lap: DataFrame, flag: DataFrame, pit: DataFrame, gap: DataFrame, state: DataFrame, parts: int = PARTS) -> DataFrame:
    """Laps with crosses_pit, has_feed_gap, is_in_lap, is_out_lap, non_green, green_us and is_clean.

    Flags and feed gaps are those of the lap's own heat, stops those of its heat and participant. A lap without a start
    (the first of a capture) is never clean; GREEN has to cover all of it. Participants are dealt among `parts` tasks.
    """
    gaps = gap.select("heat_id", F.lit("gap").alias("kind"), F.col("started_at_us").alias("r_start"), F.col("ended_at_us").alias("r_end"))
    stops = pit.where("completed and exited_at_us is not null")
    stops = stops.select("heat_id", "participant_id", F.lit("pit").alias("kind"), F.col("entered_at_us").alias("r_start"), F.col("exited_at_us").alias("r_end"))
    periods = _of_each(lap, _flags(flag).unionByName(gaps), parts).unionByName(stops)
    seen = lap.select("heat_id", "participant_id").distinct().join(state.select("participant_id", F.col("observed_at_us").alias("at"), "state_kind"), "participant_id")
    rows = _covered(lap, periods, ["green", "other", "pit", "gap"], seen, parts)
    rows = rows.withColumns({"non_green": F.col("other_n") > 0, "crosses_pit": F.col("pit_n") > 0, "has_feed_gap": F.col("gap_n") > 0})
    rows = rows.drop("green_n", "other_n", "other_us", "pit_n", "pit_us", "gap_n", "gap_us")
    rows = rows.withColumn("is_in_lap", F.col("state_kind") == "IN_PIT").withColumn("is_out_lap", F.col("state_kind") == "OUT_LAP")
    whole = (F.col("green_us") == F.col("completed_at_us") - F.col("started_at_us")) & ~F.col("non_green")
    clean = (F.col("duration_ms") > 0) & whole & ~F.col("crosses_pit") & ~F.col("has_feed_gap") & ~F.col("is_in_lap") & ~F.col("is_out_lap")
    return rows.withColumn("is_clean", F.coalesce(clean, F.lit(False)))


def rolling_pace(clean: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pace3/5/10, consistency10 and P10-P90 over the last N clean laps; NULL before there are N."""
    w = Window.partitionBy(*(by or ["participant_id"])).orderBy("lap_number")
    last = F.collect_list("duration_ms").over(w.rowsBetween(-9, 0))
    rows = clean.where("is_clean").withColumn("last10", last)
    # the last n in order, each sorted once
    rows = rows.select("*", *[F.when(F.size("last10") >= n, F.sort_array(F.slice("last10", -n, n))).alias(f"s{n}") for n in (3, 5, 10)])
    rows = rows.withColumn("m10", (F.get("s10", F.lit(4)) + F.get("s10", F.lit(5))) / 2)
    rows = rows.withColumn("d10", F.sort_array(F.transform("s10", lambda x: F.abs(x - F.col("m10")))))
    return rows.select(
        *clean.columns,
        F.get("s3", F.lit(1)).cast("double").alias("pace_3_ms"),
        F.get("s5", F.lit(2)).cast("double").alias("pace_5_ms"),
        F.col("m10").alias("pace_10_ms"),
        ((F.get("d10", F.lit(4)) + F.get("d10", F.lit(5))) / 2 * 1.4826).alias("consistency_10_ms"),
        (F.get("s10", F.lit(8)) - F.get("s10", F.lit(0))).cast("double").alias("p10_p90_ms"),
    )


def slow_laps(clean: DataFrame, latest: int | None = None, whole: bool = True, by: list[str] | None = None) -> DataFrame:
    """clean laps beyond median + max(2000, 3 MAD) of the ten before; `whole` cuts deviations to integers.

    Laps without a number are no candidates, yet count in later baselines. `latest` keeps candidates among the last N.
    """
    by = by or ["participant_id"]
    w = Window.partitionBy(*by).orderBy("lap_number")
    prior = F.collect_list("duration_ms").over(w.rowsBetween(-10, -1))
    rows = clean.where("is_clean").withColumn("prior", prior)
    if latest:
        rows = rows.withColumn("__back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("lap_number")))).where(F.col("__back") <= latest).drop("__back")
    middle = lambda xs: (F.get(xs, F.lit(4)) + F.get(xs, F.lit(5))) / 2
    far = lambda x: F.abs(x - F.col("__m"))
    rows = rows.where(F.size("prior") == 10).withColumn("__s", F.sort_array("prior")).withColumn("__m", middle("__s"))
    rows = rows.withColumn("__d", F.sort_array(F.transform("__s", lambda x: F.floor(far(x)).cast("double") if whole else far(x).cast("double"))))
    rows = rows.withColumn("threshold_ms", F.col("__m") + F.greatest(F.lit(2000.0), 3 * middle("__d")))
    return rows.where("lap_number is not null and duration_ms > threshold_ms").drop("prior", "__s", "__m", "__d")


def abrupt_deterioration(slow: DataFrame, by: list[str] | None = None) -> DataFrame:
    """is the last slow lap right after the one before?"""
    w = Window.partitionBy(*(by or ["participant_id"])).orderBy("lap_number")
    rows = slow.withColumn("follows", F.col("lap_number") - F.lag("lap_number").over(w) == 1)
    return rows.groupBy(*(by or ["participant_id"])).agg(F.coalesce(F.max_by("follows", "lap_number"), F.lit(False)).alias("abrupt"))


def latest_pace(pace: DataFrame) -> DataFrame:
    """The newest pace of each participant."""
    return pace.groupBy("participant_id", "class_key").agg(*[F.max_by(c, "lap_number").alias(c) for c in ("pace_3_ms", "pace_5_ms", "pace_10_ms", "consistency_10_ms", "p10_p90_ms")])


def class_pace(latest: DataFrame) -> DataFrame:
    """Median of the members' Pace5."""
    return latest.groupBy("class_key").agg(F.percentile("pace_5_ms", F.lit(0.5)).alias("class_pace_5_ms"), F.count("pace_5_ms").alias("members"))


def pace_rank(latest: DataFrame) -> DataFrame:
    """competition rank by Pace5 within the class; no pace, no rank."""
    ranked = F.rank().over(Window.partitionBy("class_key").orderBy("pace_5_ms")).cast("long")
    return latest.where("pace_5_ms is not null").withColumn("pace_rank_class", ranked)


def theil_sen(points: DataFrame, by: list[str], x: str, y: str, latest: int = 60) -> DataFrame:
    """E5: median of pairwise slopes over the last 60 points of a key; shown with 6 different ages at least; and the range of x."""
    w = Window.partitionBy(*by).orderBy(F.desc(x), F.desc(y))
    last = points.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= latest).select(*by, F.struct(F.col(x).alias("x"), F.col(y).cast("double").alias("y")).alias("p"))
    held = last.groupBy(*by).agg(F.collect_list("p").alias("ps"), F.count_distinct("p.x").alias("ages"), (F.max("p.x") - F.min("p.x")).alias("x_span"))  # `latest` points at most

    pairs = held.where("ages >= 6").select(*by, F.posexplode("ps").alias("i", "p"), "ps").select(*by, "p", F.explode(F.slice("ps", F.col("i") + 2, latest)).alias("q")).where("q.x <> p.x")
    slopes = pairs.groupBy(*by).agg(F.percentile((F.col("q.y") - F.col("p.y")) / (F.col("q.x") - F.col("p.x")), F.lit(0.5)).alias("slope"))
    return held.select(*by, "x_span").join(slopes, by, "left").select(*by, "slope", "x_span")


def sector_bests(lap: DataFrame, sectors: tuple[str, ...] = ("sector_1", "sector_2", "sector_3")) -> tuple[DataFrame, DataFrame]:
    """(participant, sector) last and best, (class, sector) best; ideal lap only if no sector is missing."""
    long = lap.select("participant_id", "class_key", "lap_number", F.explode(F.array(*[F.struct(F.lit(s).alias("sector"), F.col(f"{s}_ms").alias("ms")) for s in sectors])).alias("s")).select("participant_id", "class_key", "lap_number", "s.*")
    long = long.where("ms > 0")
    own = long.groupBy("participant_id", "class_key", "sector").agg(F.max_by("ms", "lap_number").alias("last_ms"), F.min("ms").alias("best_ms"))
    best = own.groupBy("class_key", "sector").agg(F.min("best_ms").alias("class_best_ms"))
    return own.join(best, ["class_key", "sector"]), own.groupBy("participant_id", "class_key").agg(F.when(F.count("*") == len(sectors), F.sum("best_ms")).alias("ideal_lap_ms"))
