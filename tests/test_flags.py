"""Flag reconciliation: one case of each rule, in seconds."""

from stintline.operators.flags import reconcile_flags

S = 1_000_000


def told(spark, live, history, bounds=None, raw=False):
    live = spark.createDataFrame([(1, f, a * S) for f, a in live], "heat_id long, flag string, started_at_us long")
    rows = [(1, h[0], h[1] * S, None if h[2] is None else h[2] * S, *(h[3:] or (None, None))) for h in history]
    history = spark.createDataFrame(rows, "heat_id long, flag string, started_at_us long, ended_at_us long, started_raw string, ended_raw string")
    if bounds:
        bounds = spark.createDataFrame([(1, *(None if x is None else x * S for x in bounds))], "heat_id long, green_at_us long, finish_at_us long")
    out = reconcile_flags(live, history, bounds=bounds).orderBy("started_at_us").collect()
    return [(r.flag, r.started_at_us // S, None if r.ended_at_us is None else r.ended_at_us // S, r.calibrated) for r in out]


def test_start_and_successor_are_aligned(spark):
    got = told(spark, [("GREEN", 0), ("SC", 1030), ("GREEN", 2020)], [("SC", 1000, 2000)])
    assert got == [("GREEN", 0, 1000, False), ("SC", 1000, 2000, True), ("GREEN", 2000, None, True)]


def test_missing_successor_is_the_state_before(spark):
    assert told(spark, [("GREEN", 0)], [("SC", 1000, 2000)]) == [("GREEN", 0, 1000, False), ("SC", 1000, 2000, True), ("GREEN", 2000, None, True)]
    # still seen as the record's own flag: unknown after its end
    assert told(spark, [("SC", 1000)], [("SC", 1000, 2000)]) == [("SC", 1000, 2000, True)]
    # nothing seen at all
    assert told(spark, [], [("SC", 1000, 2000)]) == [("SC", 1000, 2000, True)]


def test_successor_is_the_nearest_free_state_of_another_flag(spark):
    got = told(spark, [("GREEN", 0), ("SC", 1000), ("SC", 2010), ("RED", 2030), ("GREEN", 3000)], [("SC", 1000, 2000)])
    assert got == [("GREEN", 0, 1000, False), ("SC", 1000, 2000, True), ("RED", 2000, 2010, True), ("SC", 2010, 3000, False), ("GREEN", 3000, None, False)]


def test_states_inside_a_closed_record_go_and_tell_its_successor(spark):
    got = told(spark, [("GREEN", 0), ("RED", 1500)], [("SC", 1000, 2000)])
    assert got == [("GREEN", 0, 1000, False), ("SC", 1000, 2000, True), ("RED", 2000, None, True)]


def test_open_record_is_closed_by_a_later_state(spark):
    assert told(spark, [("GREEN", 0), ("GREEN", 1500)], [("SC", 1000, None)]) == [("GREEN", 0, 1000, False), ("SC", 1000, 1500, True), ("GREEN", 1500, None, False)]


def test_nearest_of_equal_distance_is_the_earlier(spark):
    got = told(spark, [("SC", 990), ("SC", 1010), ("GREEN", 1005)], [("SC", 1000, None)])
    assert got == [("SC", 1000, 1005, True), ("GREEN", 1005, 1010, False), ("SC", 1010, None, False)]


def test_equal_raw_texts_share_one_instant(spark):
    got = told(spark, [], [("SC", 1000, 1990, "a", "b"), ("RED", 2000, 3000, "b", "c")])
    assert got == [("SC", 1000, 2000, True), ("RED", 2000, 3000, True)]


def test_first_green_and_finish_are_exact(spark):
    got = told(spark, [("GREEN", 60), ("SC", 1000), ("FINISH", 5400)], [("SC", 1000, 2000)], (10, 5000))
    assert got == [("GREEN", 10, 1000, True), ("SC", 1000, 2000, True), ("FINISH", 5000, None, True)]
    assert told(spark, [("GREEN", 60)], [], (10, 5000)) == [("GREEN", 10, 5000, True), ("FINISH", 5000, None, True)]
    # a record of the finish stands; a first state that is not green does not move
    assert told(spark, [("RED", 60)], [("FINISH", 4990, None)], (10, 5000)) == [("RED", 60, 4990, False), ("FINISH", 4990, None, True)]


def test_ends_at_a_start_inside_a_record_or_after_the_finish_are_no_points(spark):
    assert told(spark, [], [("SC", 1000, 2000), ("RED", 2000, 3000)]) == [("SC", 1000, 2000, True), ("RED", 2000, 3000, True)]
    assert told(spark, [("GREEN", 0)], [("SC", 1000, 2000), ("RED", 1500, 3000)]) == [("GREEN", 0, 1000, False), ("SC", 1000, 1500, True), ("RED", 1500, 3000, True), ("GREEN", 3000, None, True)]
    assert told(spark, [("GREEN", 0)], [("SC", 1000, 6000)], (None, 5000)) == [("GREEN", 0, 1000, False), ("SC", 1000, 5000, True), ("FINISH", 5000, None, True)]


def test_nothing_and_null_rows(spark):
    assert told(spark, [], []) == []
    live = spark.createDataFrame([(1, "GREEN", None), (None, "GREEN", 5), (1, None, 5), (1, "RED", 9), (1, "RED", 9)], "heat_id long, flag string, started_at_us long")
    history = live.limit(0)
    assert [(r.flag, r.started_at_us, r.ended_at_us) for r in reconcile_flags(live, history).collect()] == [("RED", 9, None)]
