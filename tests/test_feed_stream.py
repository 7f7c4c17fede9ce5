"""Sources and streams: capture reading, envelopes, and stream = batch."""

import json

from pyspark.sql import functions as F

from stintline.operators import facts, history
from stintline.sources import feed
from stintline.streaming import live, tables


def test_capture_and_envelope(spark, tmp_path):
    lines = [{"v": 1, "kind": "recording_started"}, {"v": 1, "kind": "decoded", "frame_sequence": 2, "messages": [{"handle": "r_c", "args": "[[1,2,3]]"}, {"handle": "h_h", "args": "{}"}]}]
    (tmp_path / "c.ndjson").write_text("\n".join([json.dumps(lines[0]), "", "not json", json.dumps(lines[1])]))
    cap = feed.read_capture(spark, str(tmp_path / "c.ndjson")).cache()
    assert cap.where("_corrupt_record is not null").count() == 1
    assert [(r.message_ordinal, r.handle) for r in feed.capture_messages(cap).collect()] == [(0, "r_c"), (1, "h_h")]
    raw = spark.createDataFrame([(1, '{"C":"x","M":[["r_c",[[1,2,"a"]]],["t_p",1,2]]}'), (2, "{}"), (3, "oops")], "frame_id long, raw string")
    got = [(r.frame_id, r.handle, r.payload) for r in feed.decode_envelope(raw.where("frame_id < 3")).orderBy("message_ordinal").collect()]
    assert got == [(1, "r_c", '[[1,2,"a"]]'), (1, "t_p", '["1","2"]')]
    assert [r.decode_state for r in feed.quarantine(raw).orderBy("frame_id").collect()] == ["decoded", "decoded", "failed"]


def frames(spark, path):
    rows = [(i % 3, i, 1_700_000_000_000_000 + i * 400_000, "abc"[i % 3]) for i in range(60)]
    spark.createDataFrame(rows + rows[:9], "conn_id long, frame_id long, received_at_us long, handle string").repartition(3).write.parquet(path)
    return "conn_id long, frame_id long, received_at_us long, handle string"


def test_stream_equals_batch(spark, tmp_path):
    schema = frames(spark, str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    live.append(live.dedupe(live.frames(spark, str(tmp_path / "in"), schema, 1), ["conn_id", "frame_id"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == feed.dedupe(batch, ["conn_id", "frame_id"]).count() == 60
    # a restart takes nothing twice
    live.append(live.dedupe(live.frames(spark, str(tmp_path / "in"), schema, 1), ["conn_id", "frame_id"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_ticks_and_upsert(spark, tmp_path):
    schema = frames(spark, str(tmp_path / "in"))
    tables.each_batch(live.frames(spark, str(tmp_path / "in"), schema, 1), tables.upsert_step(str(tmp_path / "up"), ["conn_id"], ["frame_id"]), str(tmp_path / "ck")).awaitTermination()
    now = {r.conn_id: r.frame_id for r in tables.read_current(spark, str(tmp_path / "up"), ["conn_id"], ["frame_id"]).collect()}
    assert now == {0: 57, 1: 58, 2: 59}
    q = live.ticks(live.frames(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("ticks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ticks").agg(F.sum("frames")).first()[0] == 69


def test_grid_restart_rules(spark):
    rows = [(1, 1, 0, 0, 1, 1, 10, "r_i"), (1, 2, 0, 0, 1, 1, 11, "r_c"), (1, 3, 0, 0, 2, 1, 5, "r_i"), (1, 4, 0, 1, 2, 1, 6, "r_c"), (1, 4, 0, 0, 2, 1, 7, "r_c")]
    cells = spark.createDataFrame(rows, "heat_id long, frame_id long, message_ordinal long, change_ordinal long, row_ix long, col_ix long, value long, handle string")
    assert [(r.row_ix, r.value) for r in facts.grid_current(cells).collect()] == [(2, 6)]
    assert [(r.row_ix, r.value) for r in facts.grid_current(cells, at_frame=2).collect()] == [(1, 11)]


def run_stateful(spark, tmp_path, rows, schema, job):
    """A file at a time through a stateful job; gives all rows that it wrote."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = job(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_grid_stream_equals_batch_over_restarts(spark, tmp_path):
    parts = [[(1, 1, 0, 0, 1, 1, 10, "r_i"), (1, 2, 0, 0, 1, 1, 11, "r_c")], [(1, 3, 0, 0, 2, 1, 5, "r_i"), (1, 4, 0, 1, 2, 1, 6, "r_c"), (1, 4, 0, 0, 2, 1, 7, "r_c"), (2, 1, 0, 0, 1, 1, 3, "r_c")]]
    schema = "heat_id long, frame_id long, message_ordinal long, change_ordinal long, row_ix long, col_ix long, value long, handle string"
    out = run_stateful(spark, tmp_path, parts, schema, live.grid)
    newest = {}
    for r in out:
        key = (r.heat_id, r.row_ix, r.col_ix)
        newest[key] = max(newest.get(key, ()), (r.frame_id, r.message_ordinal, r.change_ordinal, r.value))
    batch = {(r.heat_id, r.row_ix, r.col_ix): r.value for r in facts.grid_current(spark.createDataFrame(sum(parts, []), schema)).collect()}
    assert {k: newest[k][3] for k in batch} == batch


POINTS = "scope_key long, at_us long, seq long, value long, version long, is_event boolean"


def test_sparse_history_keeps_changes_per_bucket(spark, tmp_path):
    s = 1_000_000
    parts = [[(1, 0, 0, 5, 1, False), (1, 1 * s, 1, 6, 1, False), (1, 6 * s, 2, 5, 1, False), (1, 6 * s + 5, 3, 7, 1, False)], [(1, 7 * s, 4, 9, 1, True), (1, 7 * s + 9, 5, 8, 1, False), (1, 8 * s, 6, 9, 1, True), (1, 11 * s, 7, 9, 1, False), (1, 12 * s, 8, 8, 1, False), (1, 13 * s, 9, 8, 2, False)]]
    out = run_stateful(spark, tmp_path, parts, POINTS, live.sparse_history)
    newest = {}
    for r in sorted(out, key=lambda r: (r.at_us, r.seq)):
        newest[r.scope_key, r.second] = tuple(r)
    batch = history.sparse_history(spark.createDataFrame(sum(parts, []), POINTS).repartition(3))
    assert sorted(map(tuple, batch.collect())) == sorted(newest.values())
    # 6 s is periodic and its second's newer value replaces it; 8 s is an event without a change
    assert [(r.at_us, r.value) for r in batch.orderBy("at_us").collect()] == [(0, 5), (6 * s + 5, 7), (7 * s, 9), (12 * s, 8), (13 * s, 8)]
