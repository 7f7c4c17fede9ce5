"""Clean laps, pace, sectors and lap windows (C, D1-D6, E, F, S12 and pace metrics)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintline.operators import laps as L
from stintline.operators import windows as W
from stintline.queries.registry import query

c = F.col

COVER = """cover AS (
  SELECT participant_id, lap_number, bool_or(flag <> 'GREEN') AS non_green,
    CAST(sum(CASE WHEN flag = 'GREEN' THEN least(l.completed_at_us, coalesce(f.ended_at_us, 9000000000000000)) - greatest(l.started_at_us, f.started_at_us) END) AS BIGINT) AS green_us
  FROM fx_lap l JOIN fx_flag f ON f.heat_id = l.heat_id AND f.started_at_us < l.completed_at_us AND coalesce(f.ended_at_us, 9000000000000000) > l.started_at_us GROUP BY 1, 2)"""
CLEAN = (
    COVER
    + """,
lapx AS (
  SELECT l.*, coalesce(v.non_green, false) AS non_green, coalesce(v.green_us, 0) AS green_us, s.state_kind,
    s.state_kind = 'IN_PIT' AS is_in_lap, s.state_kind = 'OUT_LAP' AS is_out_lap,
    EXISTS (SELECT 1 FROM fx_pit p WHERE p.heat_id = l.heat_id AND p.participant_id = l.participant_id AND p.completed AND p.entered_at_us < l.completed_at_us AND p.exited_at_us > l.started_at_us) AS crosses_pit,
    EXISTS (SELECT 1 FROM fx_feedgap g WHERE g.heat_id = l.heat_id AND g.started_at_us < l.completed_at_us AND g.ended_at_us > l.started_at_us) AS has_feed_gap
  FROM fx_lap l LEFT JOIN cover v USING (participant_id, lap_number) LEFT JOIN fx_state s USING (participant_id, lap_number)),
clean AS (
  SELECT *, coalesce(duration_ms > 0 AND green_us = completed_at_us - started_at_us AND NOT non_green AND NOT crosses_pit AND NOT has_feed_gap AND NOT is_in_lap AND NOT is_out_lap, false) AS is_clean FROM lapx)"""
)
PACE = (
    CLEAN
    + """,
good AS (SELECT *, list(duration_ms) OVER (PARTITION BY participant_id ORDER BY lap_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l10,
  list(duration_ms) OVER (PARTITION BY participant_id ORDER BY lap_number ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS p10,
  CASE WHEN count(*) OVER w3 = 3 THEN median(duration_ms) OVER w3 END AS pace_3_ms, CASE WHEN count(*) OVER w5 = 5 THEN median(duration_ms) OVER w5 END AS pace_5_ms,
  CASE WHEN count(*) OVER w10 = 10 THEN median(duration_ms) OVER w10 END AS pace_10_ms
  FROM clean WHERE is_clean
  WINDOW w3 AS (PARTITION BY participant_id ORDER BY lap_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY participant_id ORDER BY lap_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    w10 AS (PARTITION BY participant_id ORDER BY lap_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
pace AS (SELECT *, CASE WHEN len(l10) = 10 THEN 1.4826::DOUBLE * list_median(list_transform(l10, lambda x: abs(x - list_median(l10)))) END AS consistency_10_ms,
  CASE WHEN len(l10) = 10 THEN CAST(list_sort(l10)[9] - list_sort(l10)[1] AS DOUBLE) END AS p10_p90_ms FROM good),
latest AS (SELECT participant_id, class_key, arg_max(pace_3_ms, lap_number) AS pace_3_ms, arg_max(pace_5_ms, lap_number) AS pace_5_ms, arg_max(pace_10_ms, lap_number) AS pace_10_ms,
  arg_max(consistency_10_ms, lap_number) AS consistency_10_ms, arg_max(p10_p90_ms, lap_number) AS p10_p90_ms FROM pace GROUP BY 1, 2)"""
)
SLOW = (
    PACE
    + """,
slow AS (SELECT participant_id, class_key, lap_number, duration_ms, threshold_ms FROM (
  SELECT *, list_median(p10) + greatest(2000.0::DOUBLE, 3 * list_median(list_transform(p10, lambda x: CAST(floor(abs(x - list_median(p10))) AS DOUBLE)))) AS threshold_ms FROM good WHERE len(p10) = 10)
  WHERE duration_ms > threshold_ms)"""
)


def clean_laps(fx):
    own = fx.dealt()
    return L.clean_laps(own.lap, fx.flag, own.pit, fx.feedgap, own.state, own.parts)


def pace(fx):
    return L.rolling_pace(clean_laps(fx))


@query("s12_clean_laps", CLEAN + " SELECT participant_id, lap_number, non_green, green_us, crosses_pit, has_feed_gap, is_in_lap, is_out_lap, is_clean FROM clean")
def s12(fx):
    return clean_laps(fx).select("participant_id", "lap_number", "non_green", "green_us", "crosses_pit", "has_feed_gap", "is_in_lap", "is_out_lap", "is_clean")


@query("f2_rolling_pace", PACE + " SELECT participant_id, lap_number, pace_3_ms, pace_5_ms, pace_10_ms, consistency_10_ms, p10_p90_ms FROM pace")
def f2(fx):
    return pace(fx).select("participant_id", "lap_number", "pace_3_ms", "pace_5_ms", "pace_10_ms", "consistency_10_ms", "p10_p90_ms")


@query("e7_class_pace", PACE + " SELECT class_key, median(pace_5_ms) AS class_pace_5_ms, count(pace_5_ms) AS members FROM latest GROUP BY class_key")
def e7(fx):
    return L.class_pace(L.latest_pace(pace(fx)))


@query("f19_pace_rank", PACE + " SELECT participant_id, class_key, pace_5_ms, rank() OVER (PARTITION BY class_key ORDER BY pace_5_ms) AS pace_rank_class FROM latest WHERE pace_5_ms IS NOT NULL")
def f19(fx):
    return L.pace_rank(L.latest_pace(pace(fx))).select("participant_id", "class_key", "pace_5_ms", "pace_rank_class")


@query("f3_slow_laps", SLOW + " SELECT participant_id, lap_number, duration_ms, threshold_ms FROM slow")
def f3(fx):
    return L.slow_laps(clean_laps(fx)).select("participant_id", "lap_number", "duration_ms", "threshold_ms")


@query(
    "f4_abrupt_deterioration",
    SLOW + " SELECT participant_id, coalesce(arg_max(follows, lap_number), false) AS abrupt FROM (SELECT *, lap_number - lag(lap_number) OVER (PARTITION BY participant_id ORDER BY lap_number) = 1 AS follows FROM slow) GROUP BY 1",
)
def f4(fx):
    return L.abrupt_deterioration(L.slow_laps(clean_laps(fx)))


@query(
    "c1_clean_lap_filter",
    """SELECT event_id FROM fx_lap WHERE duration_ms > 0 AND event_id % 3 <> 0 AND event_id % 5 = 1""",
)
def c1(fx):
    n = c("event_id")
    flags = F.when(n % 3 == 0, F.array(F.lit("GREEN"), F.lit("RED"))).otherwise(F.array(F.lit("GREEN")))
    mark = F.when(n % 5 == 1, False).when(n % 5 == 2, True)
    return fx.lap.where(L.is_clean_lap(c("duration_ms"), flags, mark, F.lit(False), F.lit(False), F.lit(False))).select("event_id")


@query("c3_completed_pits", "SELECT participant_id, stop_number, pit_lane_ms FROM fx_pit WHERE completed AND entered_at_us IS NOT NULL AND exited_at_us >= entered_at_us")
def c3(fx):
    return fx.pit.where("completed and entered_at_us is not null and exited_at_us >= entered_at_us").select("participant_id", "stop_number", "pit_lane_ms")


@query("c4_confirmed_last", "SELECT heat_id, frame_id, value FROM fx_cell WHERE handle = 'r_c' AND value > 0 AND col_ix = 4")
def c4(fx):
    return fx.cell.where("handle = 'r_c' and value > 0 and col_ix = 4").select("heat_id", "frame_id", "value")


@query("c5_measured_pit_lane", "SELECT participant_id, stop_number, CASE WHEN entered_lap % 2 = 0 THEN pit_lane_ms END AS pit_lane_ms FROM fx_pit")
def c5(fx):
    source = F.when(c("entered_lap") % 2 == 0, "RESULT_L_PIT").otherwise("OBSERVED")
    return fx.pit.withColumn("duration_source", source).select("participant_id", "stop_number", F.when(c("duration_source") == "RESULT_L_PIT", c("pit_lane_ms")).alias("pit_lane_ms"))


@query(
    "c6_fact_range",
    "SELECT participant_id, lap_number FROM fx_lap WHERE completed_at_us >= (SELECT min(completed_at_us) FROM fx_lap) + 3600000000 AND completed_at_us < (SELECT min(completed_at_us) FROM fx_lap) + 3600000000 + 86400000000",
)
def c6(fx):
    start = fx.lap.agg((F.min("completed_at_us") + 3_600_000_000).alias("from_us"))
    rows = fx.lap.crossJoin(F.broadcast(start))  # one row
    return rows.where("completed_at_us >= from_us and completed_at_us < from_us + least(86400000000, 200000000000)").select("participant_id", "lap_number")


@query("c7_catalogue_search", "SELECT doc_id FROM fx_object WHERE (object_key ILIKE '%src1%' OR object_key ILIKE '%RACE%') AND split_part(object_key, '/', 1) = 'onboard_video'")
def c7(fx):
    return fx.object.where((c("object_key").ilike("%src1%") | c("object_key").ilike("%RACE%")) & (F.split("object_key", "/")[0] == "onboard_video")).select("doc_id")


@query("c8_resolved", "SELECT participant_id, lap_number FROM fx_lap WHERE participant_id IS NOT NULL AND class_key IS NOT NULL AND sector_2_ms IS NOT NULL")
def c8(fx):
    return fx.lap.dropna(subset=["participant_id", "class_key", "sector_2_ms"]).select("participant_id", "lap_number")


@query(
    "c9_race_spec",
    """SELECT event_id, ok, CASE WHEN ok THEN h * 3600 END AS duration_s, CASE WHEN ok THEN p END AS required_pits FROM (
  SELECT *, h IN (4, 6, 12, 24) AND p BETWEEN 2 AND 8 AS ok FROM (SELECT event_id, event_id % 13 AS h, event_id % 11 AS p FROM fx_lap))""",
)
def c9(fx):
    h, p = c("event_id") % 13, c("event_id") % 11
    ok = h.isin(4, 6, 12, 24) & p.between(2, 8)
    return fx.lap.select("event_id", ok.alias("ok"), F.when(ok, h * 3600).alias("duration_s"), F.when(ok, p).alias("required_pits"))


@query(
    "c10_pace_outliers",
    PACE
    + """, m AS (SELECT median(duration_ms) AS m FROM clean), d AS (SELECT median(abs(duration_ms - m)) AS mad, any_value(m) AS m FROM clean, m)
SELECT participant_id, lap_number, CASE WHEN duration_ms <= m + greatest(45000.0::DOUBLE, 0.35::DOUBLE * m, 8 * mad) THEN duration_ms END AS shown_ms FROM clean, d""",
)
def c10(fx):
    rows = clean_laps(fx).select("participant_id", "lap_number", "duration_ms")
    m = rows.agg(F.percentile("duration_ms", F.lit(0.5)).alias("m"))
    d = rows.crossJoin(F.broadcast(m)).groupBy("m").agg(F.percentile(F.abs(c("duration_ms") - c("m")), F.lit(0.5)).alias("mad"))  # one row
    bound = c("m") + F.greatest(F.lit(45000.0), 0.35 * c("m"), 8 * c("mad"))
    return rows.crossJoin(F.broadcast(d)).select("participant_id", "lap_number", F.when(c("duration_ms") <= bound, c("duration_ms")).alias("shown_ms"))


@query("d1_green_cover", COVER + " SELECT l.participant_id, l.lap_number, coalesce(non_green, false) AS non_green, coalesce(green_us, 0) AS green_us FROM fx_lap l LEFT JOIN cover USING (participant_id, lap_number)")
def d1(fx):
    own = fx.dealt()
    return L.flag_cover(own.lap, fx.flag, own.parts).select("participant_id", "lap_number", "non_green", "green_us")


@query("d2_crosses_pit", CLEAN + " SELECT participant_id, lap_number FROM lapx WHERE crosses_pit")
def d2(fx):
    return clean_laps(fx).where("crosses_pit").select("participant_id", "lap_number")


@query("d3_feed_gap", CLEAN + " SELECT participant_id, lap_number FROM lapx WHERE has_feed_gap")
def d3(fx):
    return clean_laps(fx).where("has_feed_gap").select("participant_id", "lap_number")


@query(
    "d4_flag_as_of",
    "SELECT participant_id, lap_number, (SELECT arg_max(flag, f.started_at_us) FROM fx_flag f WHERE f.heat_id = l.heat_id AND f.started_at_us <= l.completed_at_us AND coalesce(f.ended_at_us, 9000000000000000) > l.completed_at_us) AS flag FROM fx_lap l",
)
def d4(fx):
    lap = fx.lap.select("heat_id", "participant_id", "lap_number", "completed_at_us")
    seen = lap.select("heat_id", "participant_id").distinct().join(fx.flag, "heat_id").withColumnRenamed("started_at_us", "completed_at_us")
    hit = W.as_of(lap, seen, ["heat_id", "participant_id"], "completed_at_us", ["flag", "ended_at_us"])
    open_now = F.coalesce(c("ended_at_us") > c("completed_at_us"), F.lit(True))
    return hit.select("participant_id", "lap_number", F.when(open_now, c("flag")).alias("flag"))


@query(
    "d5_driver_as_of",
    "SELECT l.participant_id, l.lap_number, (SELECT arg_max(p.stop_number, p.entered_at_us) FROM fx_pit p WHERE p.participant_id = l.participant_id AND p.entered_at_us <= l.completed_at_us) AS driver_segment FROM fx_lap l",
)
def d5(fx):
    segments = fx.pit.select("participant_id", c("entered_at_us").alias("completed_at_us"), c("stop_number").alias("driver_segment"))
    return W.as_of(fx.lap.select("participant_id", "lap_number", "completed_at_us"), segments, ["participant_id"], "completed_at_us", ["driver_segment"]).select("participant_id", "lap_number", "driver_segment")


@query("d6_state_as_of", "SELECT l.participant_id, l.lap_number, s.state_kind FROM fx_lap l JOIN fx_state s USING (participant_id, lap_number)")
def d6(fx):
    seen = fx.state.select("participant_id", c("observed_at_us").alias("completed_at_us"), "state_kind")
    return W.as_of(fx.lap.select("participant_id", "lap_number", "completed_at_us"), seen, ["participant_id"], "completed_at_us", ["state_kind"]).select("participant_id", "lap_number", "state_kind")


@query("e1_median", "SELECT class_key, median(duration_ms) AS median_ms FROM fx_lap WHERE duration_ms > 0 GROUP BY 1")
def e1(fx):
    return fx.lap.where("duration_ms > 0").groupBy("class_key").agg(F.percentile("duration_ms", F.lit(0.5)).alias("median_ms"))


@query("e2_mad", "SELECT participant_id, median(abs(duration_ms - m)) AS mad_ms FROM (SELECT *, median(duration_ms) OVER (PARTITION BY participant_id) AS m FROM fx_lap) GROUP BY 1")
def e2(fx):
    m = fx.lap.groupBy("participant_id").agg(F.percentile("duration_ms", F.lit(0.5)).alias("m"))
    return fx.lap.join(m, "participant_id").groupBy("participant_id").agg(F.percentile(F.abs(c("duration_ms") - c("m")), F.lit(0.5)).alias("mad_ms"))


@query("e3_nearest_rank", "SELECT participant_id, l[CAST(greatest(1, ceil(len(l) * 0.1::DOUBLE)) AS BIGINT)] AS p10, l[CAST(ceil(len(l) * 0.9::DOUBLE) AS BIGINT)] AS p90 FROM (SELECT participant_id, list_sort(list(duration_ms)) AS l FROM fx_lap GROUP BY 1)")
def e3(fx):
    xs = fx.lap.groupBy("participant_id").agg(F.collect_list("duration_ms").alias("xs"))
    return xs.select("participant_id", W.nearest_rank(c("xs"), 0.1).alias("p10"), W.nearest_rank(c("xs"), 0.9).alias("p90"))


@query("e4_interpolated", "SELECT class_key, quantile_cont(duration_ms, 0.25) AS p25, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.75) AS p75 FROM fx_lap GROUP BY 1")
def e4(fx):
    return fx.lap.groupBy("class_key").agg(*[F.percentile("duration_ms", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


@query(
    "e5_theil_sen",
    """last AS (SELECT participant_id, lap_number AS x, CAST(duration_ms AS DOUBLE) AS y, row_number() OVER (PARTITION BY participant_id ORDER BY lap_number DESC) AS n FROM fx_lap QUALIFY n <= 60),
s AS (SELECT a.participant_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM last a JOIN last b ON a.participant_id = b.participant_id AND a.n > b.n GROUP BY 1)
SELECT participant_id, CASE WHEN ages >= 6 THEN slope END AS slope FROM (SELECT participant_id, count(DISTINCT x) AS ages FROM last GROUP BY 1) LEFT JOIN s USING (participant_id)""",
)
def e5(fx):
    return L.theil_sen(fx.lap, ["participant_id"], "lap_number", "duration_ms").drop("x_span")


@query("e6_best_lap", "SELECT participant_id, class_key, best_ms, min(best_ms) OVER (PARTITION BY class_key) AS class_best_ms FROM (SELECT participant_id, class_key, coalesce(arg_max(CASE WHEN event_id % 5 = 0 THEN duration_ms END, lap_number), min(duration_ms)) AS best_ms FROM fx_lap GROUP BY 1, 2)")
def e6(fx):
    own = fx.lap.groupBy("participant_id", "class_key").agg(F.coalesce(F.max_by("duration_ms", F.when(c("event_id") % 5 == 0, c("lap_number"))), F.min("duration_ms")).alias("best_ms"))
    best = own.groupBy("class_key").agg(F.min("best_ms").alias("class_best_ms"))
    return own.join(best, "class_key").select("participant_id", "class_key", "best_ms", "class_best_ms")


@query(
    "e8_class_summary",
    PACE + """, t AS (SELECT class_key, count(*) AS participants, median(pace_5_ms) AS pace_ms, arg_min(participant_id, pace_5_ms) AS leader_id FROM latest GROUP BY 1)
SELECT class_key, participants, pace_ms, leader_id, pits, median_pit_ms FROM t LEFT JOIN (SELECT class_key, count(*) FILTER (WHERE completed) AS pits, median(pit_lane_ms) AS median_pit_ms FROM fx_pit GROUP BY 1) USING (class_key)""",
)
def e8(fx):
    t = L.latest_pace(pace(fx)).groupBy("class_key").agg(F.count("*").alias("participants"), F.percentile("pace_5_ms", F.lit(0.5)).alias("pace_ms"), F.min_by("participant_id", "pace_5_ms").alias("leader_id"))
    p = fx.pit.groupBy("class_key").agg(F.count_if("completed").alias("pits"), F.percentile("pit_lane_ms", F.lit(0.5)).alias("median_pit_ms"))
    return t.join(p, "class_key", "left")


_SECTORS = """long AS (SELECT participant_id, class_key, lap_number, 'sector_1' AS sector, sector_1_ms AS ms FROM fx_lap UNION ALL SELECT participant_id, class_key, lap_number, 'sector_2', sector_2_ms FROM fx_lap
  UNION ALL SELECT participant_id, class_key, lap_number, 'sector_3', sector_3_ms FROM fx_lap),
own AS (SELECT participant_id, class_key, sector, arg_max(ms, lap_number) AS last_ms, min(ms) AS best_ms FROM long WHERE ms > 0 GROUP BY 1, 2, 3)"""


@query("e9_sector_bests", _SECTORS + " SELECT *, min(best_ms) OVER (PARTITION BY class_key, sector) AS class_best_ms FROM own")
def e9(fx):
    return L.sector_bests(fx.lap)[0].select("participant_id", "class_key", "sector", "last_ms", "best_ms", "class_best_ms")


@query("e9_ideal_lap", _SECTORS + " SELECT participant_id, class_key, CASE WHEN count(*) = 3 THEN CAST(sum(best_ms) AS BIGINT) END AS ideal_lap_ms FROM own GROUP BY 1, 2")
def e9_ideal(fx):
    return L.sector_bests(fx.lap)[1]


@query("e10_pit_totals", "SELECT participant_id, CAST(sum(pit_lane_ms) AS BIGINT) AS total_ms, median(pit_lane_ms) AS median_ms FROM fx_pit WHERE completed GROUP BY 1")
def e10(fx):
    return fx.pit.where("completed").groupBy("participant_id").agg(F.sum("pit_lane_ms").alias("total_ms"), F.percentile("pit_lane_ms", F.lit(0.5)).alias("median_ms"))


@query(
    "e12_lap_counts",
    "SELECT p.participant_id, count(l.lap_number) AS observed, max(l.lap_number) AS max_number, coalesce(bool_and(l.started_at_us IS NOT NULL), false) AS exact FROM (SELECT DISTINCT participant_id FROM fx_pit) p LEFT JOIN fx_lap l ON l.participant_id = p.participant_id AND l.lap_number > 3 GROUP BY 1",
)
def e12(fx):
    known = fx.pit.select("participant_id").distinct()
    return known.join(fx.lap.where("lap_number > 3"), "participant_id", "left").groupBy("participant_id").agg(F.count("lap_number").alias("observed"), F.max("lap_number").alias("max_number"), F.coalesce(F.bool_and(F.when(c("lap_number").isNotNull(), c("started_at_us").isNotNull())), F.lit(False)).alias("exact"))


@query("e13_sessions", "SELECT conn_id, min(received_at_us) AS first_us, max(received_at_us) AS last_us, count(DISTINCT handle) AS handles, count(*) AS points FROM fx_frame WHERE conn_id % 2 = 0 GROUP BY 1")
def e13(fx):
    gone = fx.frame.where("conn_id % 2 <> 0").select("conn_id").distinct()
    return fx.frame.join(gone, "conn_id", "left_anti").groupBy("conn_id").agg(F.min("received_at_us").alias("first_us"), F.max("received_at_us").alias("last_us"), F.count_distinct("handle").alias("handles"), F.count("*").alias("points"))


@query(
    "e14_bucket_benchmark",
    CLEAN + """, b AS (SELECT completed_at_us // 86400000000 AS bucket, participant_id, arg_max(duration_ms, completed_at_us) AS ms FROM clean WHERE is_clean GROUP BY 1, 2)
SELECT bucket, median(ms) AS median_ms, quantile_cont(ms, 0.25) AS p25_ms, quantile_cont(ms, 0.75) AS p75_ms, count(*) AS cars FROM b WHERE participant_id <> (SELECT min(participant_id) FROM fx_lap) GROUP BY 1""",
)
def e14(fx):
    focal = fx.lap.agg(F.min("participant_id").alias("focal"))
    rows = clean_laps(fx).where("is_clean").withColumn("bucket", F.call_function("div", c("completed_at_us"), F.lit(86_400_000_000)))
    one = rows.groupBy("bucket", "participant_id").agg(F.max_by("duration_ms", "completed_at_us").alias("ms"))
    one = one.join(F.broadcast(focal), c("participant_id") != c("focal"))  # one row
    return one.groupBy("bucket").agg(F.percentile("ms", F.lit(0.5)).alias("median_ms"), F.percentile("ms", F.lit(0.25)).alias("p25_ms"), F.percentile("ms", F.lit(0.75)).alias("p75_ms"), F.count("*").alias("cars"))


@query("e17_clean_ratio", CLEAN + " SELECT participant_id, count(*) FILTER (WHERE is_clean) / count(*) AS clean_ratio, count(*) AS observed FROM clean GROUP BY 1")
def e17(fx):
    return clean_laps(fx).groupBy("participant_id").agg((F.count_if("is_clean") / F.count("*")).alias("clean_ratio"), F.count("*").alias("observed"))


@query("f1_source_order", "SELECT heat_id, frame_id, message_ordinal, change_ordinal, row_ix, row_number() OVER (PARTITION BY heat_id ORDER BY frame_id, message_ordinal, change_ordinal, row_ix) AS source_rank FROM fx_cell")
def f1(fx):
    w = Window.partitionBy("heat_id").orderBy("frame_id", "message_ordinal", "change_ordinal", "row_ix")
    return fx.cell.select("heat_id", "frame_id", "message_ordinal", "change_ordinal", "row_ix", F.row_number().over(w).cast("long").alias("source_rank"))


@query("f5_previous_boundary", "SELECT participant_id, lap_number, lag(completed_at_us) OVER (PARTITION BY participant_id ORDER BY lap_number) AS started_at_us FROM fx_lap")
def f5(fx):
    return fx.lap.select("participant_id", "lap_number", F.lag("completed_at_us").over(Window.partitionBy("participant_id").orderBy("lap_number")).alias("started_at_us"))


@query(
    "f9_islands",
    "SELECT participant_id, lap_number, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY participant_id ORDER BY lap_number) AS BIGINT) AS island FROM (SELECT participant_id, lap_number, coalesce(event_type <> lag(event_type) OVER (PARTITION BY participant_id ORDER BY lap_number), false) AS b FROM fx_lap)",
)
def f9(fx):
    w = Window.partitionBy("participant_id").orderBy("lap_number")
    return W.islands(fx.lap.withColumn("before", F.lag("event_type").over(w)), ["participant_id"], ["lap_number"], c("event_type") != c("before")).select("participant_id", "lap_number", "island")


@query(
    "f9_merge_intervals",
    """x AS (SELECT participant_id, entered_at_us AS s, exited_at_us + 86400000000 * 3 AS e FROM fx_pit WHERE completed),
y AS (SELECT *, max(e) OVER (PARTITION BY participant_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x),
z AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY participant_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM y)
SELECT participant_id, min(s) AS s, max(e) AS e FROM z GROUP BY participant_id, i""",
)
def f9_merge(fx):
    return W.merge_intervals(fx.pit.where("completed").select("participant_id", c("entered_at_us").alias("s"), (c("exited_at_us") + 86_400_000_000 * 3).alias("e")), ["participant_id"], "s", "e")


@query(
    "f10_idle_sessions",
    """x AS (SELECT participant_id, completed_at_us AS s, completed_at_us + duration_ms * 1000 AS e FROM fx_lap),
y AS (SELECT *, max(e) OVER (PARTITION BY participant_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x),
z AS (SELECT *, CAST(sum(CASE WHEN s - b > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY participant_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM y)
SELECT participant_id, island, count(*) AS parts, min(s) AS first_us, max(e) AS last_us FROM z GROUP BY 1, 2""",
)
def f10(fx):
    x = fx.lap.select("participant_id", c("completed_at_us").alias("s"), (c("completed_at_us") + c("duration_ms") * 1000).alias("e"))
    before = F.max("e").over(Window.partitionBy("participant_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    z = W.islands(x.withColumn("b", before), ["participant_id"], ["s", "e"], c("s") - c("b") > 43_200_000_000)
    return z.groupBy("participant_id", "island").agg(F.count("*").alias("parts"), F.min("s").alias("first_us"), F.max("e").alias("last_us"))


@query("f11_capture_index", "SELECT participant_id, event_id, row_number() OVER (PARTITION BY participant_id ORDER BY completed_at_us, event_id) AS capture_index FROM fx_lap")
def f11(fx):
    return fx.lap.select("participant_id", "event_id", F.row_number().over(Window.partitionBy("participant_id").orderBy("completed_at_us", "event_id")).cast("long").alias("capture_index"))
