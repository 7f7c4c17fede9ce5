"""Import of a capture and rebuild of a heat."""

import base64
import json

from stintline.plans import rebuild


def test_import_and_rebuild(spark, tmp_path):
    raw = lambda m: {"text_b64": base64.b64encode(json.dumps({"M": m}).encode()).decode()}
    lines = [
        {"v": 1, "kind": "recording_started"},
        {"v": 1, "kind": "frame", "connection_id": "c1", "frame_sequence": 1, "frame": raw([["r_i", [[0, 1, "a"], [0], [1, 1, "b"]]]])},
        {"v": 1, "kind": "frame", "connection_id": "c1", "frame_sequence": 1, "frame": raw([["r_i", [[0, 1, "a"], [0], [1, 1, "b"]]]])},
        {"v": 1, "kind": "frame", "connection_id": "c1", "frame_sequence": 2, "frame": {"text_b64": base64.b64encode(b"oops").decode()}},
        {"v": 1, "kind": "disconnected", "connection_id": "c1"},
    ]
    (tmp_path / "c.ndjson").write_text("\n".join(map(json.dumps, lines)))
    got = rebuild.import_capture(spark, str(tmp_path / "c.ndjson"))
    assert {(r.frame_sequence, r.decode_state) for r in got["frame"].collect()} == {(1, "decoded"), (2, "failed")}
    assert sorted((r.row_ix, r.col_ix, r.value) for r in got["cell"].collect()) == [(0, 1, "a"), (1, 1, "b")]
    rows = [(h, f, 0, 0, 1, 1, f * 10 + h, "r_c") for h in (1, 2) for f in (1, 2)]
    cell = spark.createDataFrame(rows, "heat_id long, frame_id long, message_ordinal long, change_ordinal long, row_ix long, col_ix long, value long, handle string")
    once = {(r.heat_id, r.value) for r in rebuild.rebuild(cell, str(tmp_path / "grid")).collect()}
    assert once == {(1, 21), (2, 22)}
    assert {(r.heat_id, r.value) for r in rebuild.rebuild(cell.where("heat_id = 2"), str(tmp_path / "grid")).collect()} == once


def test_rebuild_of_all_tables_is_repeatable_and_keeps_other_heats(spark, tmp_path):
    told = [
        ("r_i", {"l": {"h": [{"n": "NR"}, {"n": "POS"}]}, "r": [[0, 0, "21"], [0, 1, "3"]]}),
        ("r_c", [[0, 1, "2"]]),
        ("a_i", {"p": 30, "l": {"1": {"l": 4, "n": "T"}}}),
        ("a_u", {"p": 31}),
        ("m_c", {"Id": "a", "t": "x"}),
        ("m_a", None),
    ]
    schema = "heat_id long, conn_id long, frame_id long, message_ordinal long, handle string, payload string"
    rows = [(h, 1, i, 0, k, json.dumps(p)) for h in (1, 2) for i, (k, p) in enumerate(told)]
    message = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "gold")
    read = lambda tables: {n: sorted(map(repr, t.collect())) for n, t in tables.items()}
    first = read(rebuild.rebuild_all(message, path))
    assert all(first.values())
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "gold").rglob("heat_id=1/*.parquet")}
    assert read(rebuild.rebuild_all(message.where("heat_id = 2"), path)) == first
    assert files and {p: p.stat().st_mtime_ns for p in (tmp_path / "gold").rglob("heat_id=1/*.parquet")} == files
    changed = message.where("not (heat_id = 2 and handle = 'r_c')")
    got = rebuild.rebuild_all(changed.where("heat_id = 2"), path)["grid"]
    assert {(r.heat_id, r.key): r.value for r in got.collect()} == {(1, "start_number"): "21", (1, "position_overall"): "2", (2, "start_number"): "21", (2, "position_overall"): "3"}
