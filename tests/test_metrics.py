"""Operators on tiny tables with known numbers."""

import pytest
from pyspark.sql import functions as F

from stintline.functions import scalars as S
from stintline.operators import battle, facts, flags, laps, pits, windows
from stintline.queries import QUERIES

DURATIONS = [100_000 + 1000 * i for i in range(10)] + [120_000]


def clean(spark, durations=DURATIONS):
    return spark.createDataFrame([(1, 0, i + 1, d, True) for i, d in enumerate(durations)], "participant_id long, class_key long, lap_number long, duration_ms long, is_clean boolean")


def test_pace_windows(spark):
    last = laps.rolling_pace(clean(spark)).orderBy(F.desc("lap_number")).first()
    first_ten = laps.rolling_pace(clean(spark, DURATIONS[:10])).orderBy(F.desc("lap_number")).first()
    assert first_ten.pace_10_ms == 104_500 and first_ten.pace_3_ms == 108_000
    assert last.pace_3_ms == 109_000 and last.pace_5_ms == 108_000 and last.pace_10_ms == 105_500
    assert last.consistency_10_ms == pytest.approx(3706.5) and last.p10_p90_ms == 8000


def test_windows_are_null_before_they_are_full(spark):
    rows = laps.rolling_pace(clean(spark)).orderBy("lap_number").collect()
    assert rows[1].pace_3_ms is None and rows[2].pace_3_ms is not None and rows[8].consistency_10_ms is None


def test_slow_lap(spark):
    assert [r.lap_number for r in laps.slow_laps(clean(spark)).collect()] == [11]
    assert [r.lap_number for r in laps.slow_laps(clean(spark), whole=False, latest=1).collect()] == [11]


def gaps(spark, relation="AHEAD", **change):
    rows = [dict(focal_id=1, relation=relation, target_id=2, observed_at_us=t * 1_000_000, gap_ms=g, our_lap=10 + i, target_lap=10 + i, flag="GREEN", seq=i) for i, (t, g) in enumerate([(0, 10_000), (30, 8_500), (60, 6_000)])]
    for i, fields in change.items():
        rows[int(i[1:])] |= fields
    return spark.createDataFrame(rows, "focal_id long, relation string, target_id long, observed_at_us long, gap_ms long, our_lap long, target_lap long, flag string, seq long")


def test_gap_trend(spark):
    r = battle.gap_trend(gaps(spark), 60).collect()
    assert len(r) == 1 and r[0].closure_ms_per_min == 4000 and r[0].closure_ms_per_lap == 2000 and r[0].direction == "CLOSING"
    behind = battle.gap_trend(gaps(spark, "BEHIND"), 60).first()
    assert behind.closure_ms_per_lap == -2000 and behind.direction == "BEING_CAUGHT"


@pytest.mark.parametrize("change", [{"flag": "RED"}, {"target_id": 3}, {"target_lap": 4}, {"gap_ms": None}])
def test_any_break_resets_the_trend(spark, change):
    assert battle.gap_trend(gaps(spark, _1=change), 60).count() == 0


def test_catch_range_needs_two_windows(spark):
    g = gaps(spark)
    assert battle.catch_range([battle.gap_trend(g, 60)], F.lit(100_000.0)).count() == 0
    r = battle.catch_range([battle.gap_trend(g, 60), battle.gap_trend(g, 30)], F.lit(100_000.0)).where("seq = 2").first()
    assert r.min_laps == pytest.approx(6000 / 2500) and r.max_laps == pytest.approx(3)


def test_obligations(spark):
    o = spark.range(1).select(pits.obligations(F.lit(1), F.lit(14_400), F.lit(3), F.lit(3600.0)).alias("o")).select("o.*").first()
    assert o.remaining_pits == 2 and o.initial_equal_stint_target_s == 3600 and o.remaining_equal_stint_s == 3600
    assert o.stop_load_per_hour == pytest.approx(2 / 3) and o.next_equal_pit_target_elapsed_s == 7200 and o.stint_schedule_deviation_s == -3600
    assert spark.range(1).select(pits.obligations(F.lit(1), F.lit(7_200), F.lit(3), F.lit(0.0)).alias("o")).select("o.*").first().remaining_pits is None


def test_clean_lap_needs_known_marks(spark):
    green = F.array(F.lit("GREEN"))
    no, unknown = F.lit(False), F.lit(None).cast("boolean")
    one = lambda *a: spark.range(1).select(laps.is_clean_lap(*a).alias("x")).first().x
    assert one(F.lit(1), green, no, no, no, no) is True
    assert one(F.lit(1), green, unknown, no, no, no) is False
    assert one(F.lit(1), F.array().cast("array<string>"), no, no, no, no) is False
    assert one(F.lit(None).cast("long"), green, no, no, no, no) is False


def test_stop_numbers_follow_the_source_count(spark):
    rows = [(1, 1, 10, "ON_TRACK", 0), (1, 2, 20, "IN_PIT", None), (1, 3, 30, "OUT_LAP", 3), (1, 4, 40, "IN_PIT", 5), (1, 5, 50, "IN_PIT", 5), (1, 6, 60, "ON_TRACK", 5), (1, 7, 70, "IN_PIT", None), (2, 8, 5, "IN_PIT", 1), (2, 9, 9, "ON_TRACK", 1)]
    got = [(r.participant_id, r.stop_number, r.entered_at_us, r.exited_at_us) for r in pits.pit_stops(spark.createDataFrame(rows, "participant_id long, event_id long, observed_at_us long, state_kind string, pit_count int")).orderBy("participant_id", "entered_at_us").collect()]
    assert got == [(1, 1, 20, 30), (1, 5, 40, 60), (1, 6, 70, None)]


def test_as_of_and_islands(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 3)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "k long, t long, v string")
    assert sorted((r.k, r.t, r.v) for r in windows.as_of(left, right, ["k"], "t", ["v"]).collect() if r.v) == [(1, 5, "a"), (1, 10, "b")]
    assert sorted((r.k, r.t, r.v) for r in windows.as_of(left, right, ["k"], "t", ["v"], inclusive=False).collect() if r.v) == [(1, 10, "b")]
    m = windows.merge_intervals(spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, None), (1, 25, 30)], "k long, s long, e long"), ["k"], "s", "e")
    assert sorted((r.s, r.e) for r in m.collect()) == [(0, 9), (20, None)]


def test_overlap_over_many_bins(spark):
    left = spark.createDataFrame([(1, 0, 10 * windows.BIN_US), (2, 5, 5), (3, None, 5), (4, 9 * windows.BIN_US + 1, 9 * windows.BIN_US + 2)], "id long, l_start long, l_end long")
    right = spark.createDataFrame([(3 * windows.BIN_US - 1, 4 * windows.BIN_US + 1), (9 * windows.BIN_US, None)], "r_start long, r_end long")
    got = {(r.id): r.n for r in windows.interval_pairs(left, right, []).groupBy("id").agg(F.sum("cut_us").alias("n")).collect()}
    assert got == {1: windows.BIN_US + 2 + windows.BIN_US, 4: 1}


def test_gap_texts(spark):
    texts = ["", None, "12.3456", "1:02.5", "1:60.0", "1:02:03", "-- 12 laps --", "PIT", "-3"]
    got = [tuple(r.g) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.parse_gap(F.col("t")).alias("g")).orderBy("i").collect()]
    assert got == [("EMPTY", None, None), ("EMPTY", None, None), ("TIME", None, 12346), ("TIME", None, 62500), ("UNKNOWN", None, None), ("TIME", None, 3723000), ("LAP_GROUP", 12, None), ("UNKNOWN", None, None), ("UNKNOWN", None, None)]


def test_gap_coordinates(spark):
    rows = [(1, 1, 1, "-- 20 laps --"), (1, 2, 2, "5.0"), (1, 3, 3, "-- 18 laps --"), (1, 4, 4, "1:00.0"), (1, 5, 5, "")]
    got = [(r.laps_behind, r.residual_ms, r.coordinate_status) for r in facts.gap_coordinates(spark.createDataFrame(rows, "heat_id long, row_key long, position long, gap_text string")).orderBy("position").collect()]
    assert got == [(0, 0, "EXACT"), (0, 5000, "EXACT"), (2, 0, "EXACT"), (2, 60000, "EXACT"), (None, None, "VALUE_UNSUPPORTED")]


def test_history_flags_replace_live_ones(spark):
    live = spark.createDataFrame([(1, "GREEN", 0), (1, "RED", 500_000_000)], "heat_id long, flag string, started_at_us long")
    history = spark.createDataFrame([(1, "RED", 450_000_000), (1, "FINISH", 900_000_000)], "heat_id long, flag string, started_at_us long")
    got = [(r.flag, r.started_at_us, r.ended_at_us) for r in flags.reconcile_flags(live, history).orderBy("started_at_us").collect()]
    assert got == [("GREEN", 0, 450_000_000), ("RED", 450_000_000, 900_000_000), ("FINISH", 900_000_000, None)]


def test_row_order_does_not_matter(spark):
    rows = clean(spark)
    a = sorted(map(str, laps.rolling_pace(rows).collect()))
    assert a == sorted(map(str, laps.rolling_pace(rows.orderBy(F.desc("duration_ms")).repartition(3)).collect()))


def test_empty_tables(spark):
    assert laps.rolling_pace(clean(spark).limit(0)).collect() == []
    assert battle.gap_trend(gaps(spark).limit(0), 30).collect() == []


def test_flags_and_gaps_count_in_their_own_heat_only(spark):
    lap = spark.createDataFrame([(1, 7, 1, 100, 200, 100), (2, 8, 1, 100, 200, 100), (1, 7, 2, 200, 300, 100), (1, 7, 3, None, 350, 100)], "heat_id long, participant_id long, lap_number long, started_at_us long, completed_at_us long, duration_ms long")
    flag = spark.createDataFrame([(1, "GREEN", 0, 250), (1, "GREEN", 250, None), (2, "GREEN", 0, 120), (2, "RED", 120, 130), (2, "GREEN", 130, None)], "heat_id long, flag string, started_at_us long, ended_at_us long")
    pit = spark.createDataFrame([(2, 7, True, 100, 200)], "heat_id long, participant_id long, completed boolean, entered_at_us long, exited_at_us long")
    gap = spark.createDataFrame([(2, 150, 160), (1, 300, 310)], "heat_id long, started_at_us long, ended_at_us long")
    state = spark.createDataFrame([(7, 0, "ON_TRACK"), (8, 0, "ON_TRACK")], "participant_id long, observed_at_us long, state_kind string")
    rows = {(r.heat_id, r.lap_number): r for r in laps.clean_laps(lap, flag, pit, gap, state).collect()}
    assert rows[1, 1].is_clean and rows[1, 2].is_clean and rows[1, 2].green_us == 100 and not rows[1, 1].crosses_pit
    assert not rows[2, 1].is_clean and rows[2, 1].non_green and rows[2, 1].has_feed_gap and rows[2, 1].green_us == 90
    assert not rows[1, 3].is_clean and rows[1, 3].green_us == 0


def test_overlap_sums_match_pairs(spark):
    left = [(k, i, a, a + n) for i, (k, a, n) in enumerate([(1, 0, 10), (1, 5, 1), (1, 9, 0), (2, 3, 50), (1, None, 3), (3, 1, 5), (1, 12, 30)]) for n in [n if a is not None else 0] if a is not None] + [(1, 99, None, 7)]
    periods = [(1, "x", 0, 4), (1, "x", 2, 8), (1, "y", 8, 8), (1, "y", 6, None), (2, "x", 53, 60), (2, "y", 3, 4), (1, "x", 10, 12)]
    df = spark.createDataFrame(left, "k long, id long, l_start long, l_end long")
    got = windows.overlap_sums(df, spark.createDataFrame(periods, "k long, kind string, r_start long, r_end long"), ["k"], ["x", "y"]).collect()
    for r in got:
        for kind in "xy":
            cut = [min(e if e is not None else 10**9, r.l_end) - max(s, r.l_start) for k, x, s, e in periods if r.l_start is not None and (k, x) == (r.k, kind) and (e is None or e > s)]
            cut = [c for c in cut if c > 0]
            assert (r[f"{kind}_n"], r[f"{kind}_us"]) == (len(cut), sum(cut)), r


def test_clock_interpolation_reads_no_frame_to_the_end(spark):
    plan = QUERIES["f24_clock_interpolation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan
