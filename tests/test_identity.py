"""Participants of grid rows: numbers, teams, conflicts."""

import random
import time

from stintline.operators import identity

ROW = "heat_id long, frame_id long, row_ix long, start_number string, team_name string, class_name string"


def keys(spark, *rows):
    df = spark.createDataFrame([(1, i, 5, *r) for i, r in enumerate(rows)], ROW)
    return [(r.external_key, r.is_ours) for r in identity.resolve(df, "21", "Ours").orderBy("frame_id").collect()]


def test_number_then_team_then_row(spark):
    assert keys(spark, ("7", "A", "GT"), (None, "a ", None), (None, "A", "LM"), (None, "B", None), (None, None, None), (None, "B", None)) == [("nr:7", False), ("nr:7", False), ("team:a:class:lm", False), ("team:b:class:", False), ("row:5", False), ("team:b:class:", False)]


def test_our_number_with_another_team_is_a_conflict_once_we_are_known(spark):
    assert keys(spark, ("21", "X", None), ("21", "Ours", None), ("21", "X", None), (None, "ours", None), ("21", None, None)) == [("nr:21", False), ("nr:21", True), ("conflict:nr:21:team:x", False), ("nr:21", True), ("nr:21", True)]


def test_fields_that_are_left_out_stay(spark):
    df = spark.createDataFrame([(1, 0, 0, "7", "A", "GT"), (1, 1, 0, "7", None, None), (2, 0, 0, "7", None, None)], ROW)
    got = {(r.heat_id, r.frame_id): (r.team_name, r.class_name) for r in identity.resolve(df, "21", "Ours").collect()}
    assert got == {(1, 0): ("a", "gt"), (1, 1): ("a", "gt"), (2, 0): (None, None)}


def test_roster_equals_a_plain_search_and_keeps_its_speed():
    rng, roster, known = random.Random(5), identity.Roster("21", "ours"), {}
    for i in range(3000):
        number, team, klass = rng.choice([None, None, "7", "21", str(i % 40)]), rng.choice([None, "ours", "a", "b", f"t{i % 9}"]), rng.choice([None, "gt", "lm"])
        clash = number == "21" and team not in (None, "ours") and any(p[0] == "21" and p[1] == "ours" and p[3] for p in known.values())
        like = [(p[3], p[4], k) for k, p in known.items() if p[1] == team and klass in (None, p[2])] if number is None and team is not None else []
        key = f"conflict:nr:21:team:{team}" if clash else max(like)[2] if like else f"nr:{number}" if number else f"team:{team}:class:{klass or ''}" if team else f"row:{i % 50}"
        ours = not clash and (team == "ours" or (team is None and number == "21"))
        held = known.get(key, [None] * 3)
        known[key] = [*[x if x is not None else old for x, old in zip((number, team, klass), held, strict=False)], ours, i]
        assert roster.take(i % 50, number, team, klass) == (key, ours, *known[key][:3])
    start = time.process_time()
    for i in range(60_000):
        roster.take(i, "21" if i % 3 == 0 else None, None if i % 3 == 2 else f"team {i}", None)
    assert time.process_time() - start < 10
