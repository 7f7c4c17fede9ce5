"""Streams against their batch twins over restarts: freshness by the clock, windows over a tail, outbox, compaction, revised laps."""

import random
import time

from pyspark.sql import functions as F

from stintline.operators import battle, history, laps
from stintline.streaming import freshness, tables

S = 1_000_000


def run(spark, tmp_path, name, parts, schema, step):
    """Each part as a file and a run of its own, as after a restart."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"{name}-in"))
        tables.each_batch(stream, step, str(tmp_path / f"{name}-ck")).awaitTermination()


def test_freshness_turns_by_the_clock_alone(spark, tmp_path):
    schema = "session_id long, at_us long, seq long, kind string, value string"
    now = int(time.time() * 1e6)
    rows = [(1, now, 0, "tick", None), (2, now, 0, "tick", None), (2, now, 1, "gap", "OPEN"), (3, now, 0, "flag", "FINISH")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live_us, stale_us = 30 * S, 45 * S

    def start():
        changes = freshness.freshness(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), live_us, stale_us)
        return changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()

    def told():
        try:
            return {(r.session_id, r.status, r.reason): r.at_us for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        except Exception:  # nothing written yet
            return {}

    try:
        for last in ("LIVE", "OFFLINE"):  # the query is stopped in between: the timers outlive it
            q = start()
            until = time.time() + 90
            while time.time() < until and not any(s == 1 and status == last for s, status, _ in told()):
                time.sleep(1)
            q.stop()
    finally:
        spark.conf.unset(key)
    got = told()
    twin = history.freshness_changes(spark.createDataFrame(rows, schema), F.lit(now + 100 * S), live_us, stale_us)
    want = {(r.session_id, r.status, r.reason): r.at_us for r in twin.where("reason <> 'fresh' or session_id <> 2").collect()}
    assert set(got) == set(want) == {(1, "LIVE", "fresh"), (1, "STALE", "stale"), (1, "OFFLINE", "source_timeout"), (2, "OFFLINE", "source_gap"), (3, "OFFLINE", "track_finished")}
    # timers have milliseconds
    assert all(0 <= got[k] - want[k] <= 1000 for k in got if k[0] == 1 and k[1] != "LIVE")


GAP = "focal_id long, relation string, target_id long, observed_at_us long, gap_ms long, our_lap long, target_lap long, flag string, seq long"


def samples(n=400, seed=2):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.randrange(1, 20) * S
        rows.append((i % 3, "AHEAD" if i % 3 else "BEHIND", 10 + (i // 90) % 2, at, rng.randrange(0, 5000), 1, 1 + (rng.random() < 0.02), "GREEN" if rng.random() > 0.02 else "RED", i))
    return rows


def test_sliding_windows_equal_batch_over_restarts(spark, tmp_path):
    rows = samples()
    step = tables.closures_step(str(tmp_path / "out"), str(tmp_path / "tail"))
    run(spark, tmp_path, "gap", [rows[:100], rows[100:110], rows[110:290], rows[290:]], GAP, step)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    batch = battle.sliding_closures(spark.createDataFrame(rows, GAP))
    order = lambda df: sorted(map(repr, df.select(*batch.columns).collect()))
    assert order(got) == order(batch)
    assert batch.where("closure_180_ms_per_min is not null and gap_ago_ms is not null").count() > 20
    # the tail stays bounded, and a batch that is run again writes the same
    newest = spark.read.parquet(str(tmp_path / "tail" / "batch=3"))
    spread = newest.groupBy("focal_id").agg((F.max("observed_at_us") - F.min("observed_at_us")).alias("s")).agg(F.max("s")).first()[0]
    assert spread <= battle.TAIL_S * S and newest.count() < len(rows)
    step(spark.createDataFrame(rows[290:], GAP), 3)
    assert order(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == order(batch)


EVENT = "frame_id long, facet string, payload string"


def test_outbox_gives_each_event_one_cursor(spark, tmp_path):
    path = str(tmp_path / "box")
    step = tables.outbox_step(path, ["frame_id", "facet"], ["frame_id", "facet"])
    rows = [(i // 2, "lap" if i % 2 else "state", f"p{i}") for i in range(60)]
    run(spark, tmp_path, "ev", [rows[:20] + rows[:4], rows[10:40], rows[40:]], EVENT, step)
    read = lambda: sorted((r.cursor, r.frame_id, r.facet) for r in tables.outbox(spark, path).collect())
    first = read()
    assert [x[0] for x in first] == list(range(1, 61)) and sorted(x[1:] for x in first) == sorted(r[:2] for r in rows)
    for n, part in ((1, rows[10:40]), (2, rows[40:])):  # run again
        step(spark.createDataFrame(part, EVENT), n)
    assert read() == first
    tables.prune(spark, path, 39)
    assert [x[0] for x in read()] == list(range(21, 61))
    bounds = tables.cursor_bounds(spark, path)
    assert tuple(bounds.first()) == (20, 60)
    asked = spark.createDataFrame([(-1,), (0,), (19,), (20,), (45,), (60,), (61,)], "cursor long")
    assert {r.cursor: r.reset for r in tables.needs_reset(asked, bounds).collect()} == {-1: True, 0: True, 19: True, 20: False, 45: False, 60: False, 61: True}
    step(spark.createDataFrame([(100, "lap", "x"), (29, "lap", "again")], EVENT), 3)
    assert [x for x in read() if x[0] > 60] == [(61, 100, "lap")]


def test_current_rows_are_merged(spark, tmp_path):
    path = str(tmp_path / "now")
    step = tables.upsert_step(path, ["k"], ["rank"])
    for n in range(4):
        step(spark.createDataFrame([(i, n * 10 + (i == 2) * -100, f"{n}.{i}") for i in range(n, n + 3)], "k long, rank long, v string"), n)
    now = lambda: {r.k: r.v for r in tables.read_current(spark, path, ["k"], ["rank"]).collect()}
    want = {0: "0.0", 1: "1.1", 2: "2.2", 3: "3.3", 4: "3.4", 5: "3.5"}
    assert now() == want
    assert tables.compact(spark, path, ["k"], ["rank"]) == 3 and now() == want
    assert sorted(p.name for p in (tmp_path / "now").iterdir()) == ["base=3", "batch=3"]
    step(spark.createDataFrame([(9, 99, "new"), (0, -999, "old")], "k long, rank long, v string"), 4)
    assert now() == {**want, 9: "new"} and tables.compact(spark, path, ["k"], ["rank"]) == 4 and now() == {**want, 9: "new"}


def test_late_evidence_revises_only_what_it_touches(spark, tmp_path):
    lap = spark.createDataFrame([(h, p, n, n * 100 * S, (n + 1) * 100 * S, 100_000) for h in (1, 2) for p in range(h * 100, h * 100 + 40) for n in range(6)], "heat_id long, participant_id long, lap_number long, started_at_us long, completed_at_us long, duration_ms long")
    state = lap.select("participant_id", "lap_number", F.col("completed_at_us").alias("observed_at_us"), F.lit("ON_TRACK").alias("state_kind"))
    flag = spark.createDataFrame([(h, "GREEN", 0, 10_000 * S) for h in (1, 2)], "heat_id long, flag string, started_at_us long, ended_at_us long")
    gap = spark.createDataFrame([], "heat_id long, started_at_us long, ended_at_us long")
    pit_schema = "heat_id long, participant_id long, entered_at_us long, exited_at_us long, completed boolean"
    none = spark.createDataFrame([], pit_schema)
    path = str(tmp_path / "clean")
    tables.publish_clean_laps(lap, flag, none, gap, state, path)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "clean").rglob("*.parquet")}
    unclean = lambda: {(r.participant_id, r.lap_number) for r in spark.read.parquet(path).where("not is_clean").collect()}
    before = files()
    assert unclean() == set() and spark.read.parquet(path).count() == 480
    late = [(1, 105, 250 * S, 310 * S, True)]
    step = tables.late_pits_step(lambda: {"lap": lap, "flag": flag, "gap": gap, "state": state}, str(tmp_path / "pits"), path)
    run(spark, tmp_path, "pit", [late, [(2, 203, 10 * S, 20 * S, True)]], pit_schema, step)
    assert unclean() == {(105, 2), (105, 3), (203, 0)}
    after = files()
    touched = {(k.parts[1], k.parts[2]) for k in after if before.get(k) != after[k]}
    assert len(touched) == 2 and {k for k in before if (k.parts[1], k.parts[2]) not in touched} == {k for k in after if before.get(k) == after[k]}
    assert spark.read.parquet(path).count() == 480
    # a caution that comes late touches its whole heat, and no other
    flags = tables.late_flags_step(lambda: {"lap": lap, "pit": none, "gap": gap, "state": state}, str(tmp_path / "flags"), path)
    flags(flag, 0)
    flags(spark.createDataFrame([(2, "SAFETY_CAR", 590 * S, 595 * S)], flag.schema), 1)
    assert unclean() == {(p, 5) for p in range(200, 240)}
    whole = laps.clean_laps(lap, flag.unionByName(spark.createDataFrame([(2, "SAFETY_CAR", 590 * S, 595 * S)], flag.schema)), none, gap, state)
    assert {(r.participant_id, r.lap_number) for r in whole.where("not is_clean").collect()} == unclean()
