"""Running values in blocks against plain ones."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintline.fixtures import Fixture
from stintline.operators import laps as L
from stintline.operators import windows as W
from stintline.queries import q_battle, q_laps


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_values_equal_plain_ones_and_rows_are_not_joined(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for i in rng.sample(range(-40, 60), 80)]
    want, state = [], {}
    for h, i, n, x in sorted(rows, key=lambda r: r[1]):
        total, last = state.get(h, (0, None))
        state[h] = (total + (n or 0), last if x is None else x)
        want.append((h, i, n, x, *state[h]))
    df = spark.createDataFrame(rows, "h long, i long, n int, x string")
    out = W.running(df, ["h"], ["i"], {"total": F.col("n")}, {"last": F.col("x")}, width=8, parts=3)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_covered_laps_are_sorted_once_and_stay_dealt_by_participant(spark):
    lap = spark.createDataFrame([(1, 7, 1, 0, 10)], "heat_id long, participant_id long, lap_number long, started_at_us long, completed_at_us long")
    flag = spark.createDataFrame([(1, "GREEN", 0, None)], "heat_id long, flag string, started_at_us long, ended_at_us long")
    out = L.flag_cover(lap, flag)
    ranked = out.withColumn("n", F.row_number().over(Window.partitionBy("participant_id").orderBy("lap_number")))
    assert plan(ranked).count("Exchange") == plan(out).count("Exchange")
    assert sum("Sort [" in line and "__turn" in line for line in plan(out).splitlines()) == 1
    assert [(r.non_green, r.green_us) for r in out.collect()] == [(False, 10)]


def test_windows_of_dealt_laps_share_one_exchange(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    for name in ("lap", "pit", "state"):
        text = plan(getattr(fx.dealt(), name))
        assert text.count("Exchange") == 1 and f"{W.PARTS}), REPARTITION_BY_NUM" in text
    assert fx.dealt().state.count() == fx.state.count()


def test_as_of_may_be_dealt_among_parts(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 4, "c")], "k long, at long, x string")
    found = W.as_of(rows.select("k", "at"), rows, ["k"], "at", ["x"], inclusive=False, parts=5)
    assert sorted(map(tuple, found.collect())) == [(1, 3, None), (1, 5, "b"), (2, 4, None)]
    assert "5), REPARTITION_BY_NUM" in plan(found)


def test_tasks_of_clean_laps_follow_the_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    few = sorted(map(tuple, q_laps.e8(Fixture(spark, sf)).collect()))
    monkeypatch.setattr(W, "ROWS", 8)
    parts = W.parts_of(spark.read.parquet(f"{sf}/events.parquet").count())
    assert W.MOST == W.parts_of(10**9) > parts > W.PARTS == W.parts_of(1)
    for query in (q_laps.s12, q_laps.d1, q_laps.f4, q_laps.e7, q_laps.e8, q_battle.d15, q_battle.e11):
        text = plan(query(Fixture(spark, sf)))
        assert f"{parts}), REPARTITION_BY_NUM" in text and f"{W.PARTS}), REPARTITION_BY_NUM" not in text
    assert sorted(map(tuple, q_laps.e8(Fixture(spark, sf)).collect())) == few


def test_no_heat_is_one_task_where_its_periods_meet_participants(spark):
    lap = spark.createDataFrame([(h, p, 1, 0, 10) for h, p in ((1, 7), (1, 8), (None, 9), (2, 10))], "heat_id long, participant_id long, lap_number long, started_at_us long, completed_at_us long")
    flag = spark.createDataFrame([(1, "GREEN", 0, None), (1, "RED", 4, 6), (2, "GREEN", 3, 5), (None, "RED", 0, 9)], "heat_id long, flag string, started_at_us long, ended_at_us long")
    out = L.flag_cover(lap, flag, 3)
    assert sorted((r.participant_id, r.non_green, r.green_us) for r in out.collect()) == [(7, True, 10), (8, True, 10), (9, False, 0), (10, False, 2)]
    assert not re.search(r"hashpartitioning\(heat_id#\d+L?, \d+\)", plan(out)) and not re.search(r"Join \[heat_id#\d+L?\]", plan(out))


def test_a_class_is_not_one_task_beside_the_focal_car(spark):
    text = plan(q_battle.d15(Fixture(spark, "/root/testdata/sf0.001")))
    assert not re.search(r"SortMergeJoin \[class_key#\d+L?\]", text) and not re.search(r"hashpartitioning\(class_key#\d+L?, \d+\)", text)


def test_a_participant_gets_only_the_periods_of_its_time(spark):
    lap = spark.createDataFrame([(1, 7, 1, None, 10), (1, 7, 2, 10, 20), (1, 8, 1, 90, 100), (1, 9, 1, None, 50)], "heat_id long, participant_id long, lap_number long, started_at_us long, completed_at_us long")
    flag = spark.createDataFrame([(1, "GREEN", 0, 10), (1, "GREEN", 10, 15), (1, "RED", 19, 90), (1, "RED", 20, 91), (1, "GREEN", 95, None), (1, "RED", 100, None)], "heat_id long, flag string, started_at_us long, ended_at_us long")
    given = L._of_each(lap, L._flags(flag), 3)
    assert sorted((r.participant_id, r.r_start) for r in given.collect()) == [(7, 10), (7, 19), (8, 20), (8, 95)]
    out = L.flag_cover(lap, flag, 3)
    assert sorted((r.participant_id, r.lap_number, r.non_green, r.green_us) for r in out.collect()) == [(7, 1, False, 0), (7, 2, True, 5), (8, 1, True, 5), (9, 1, False, 0)]


def test_tasks_of_participants_do_not_follow_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        texts = [plan(query(Fixture(spark, "/root/testdata/sf0.001"))) for query in (q_laps.f4, q_laps.e8)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for text in texts:
        assert ", 7), ENSURE" in text and not re.search(r"hashpartitioning\((user|participant)_id#\d+L?, 7\)", text)
