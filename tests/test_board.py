"""Race-control board: snapshots, sparse changes, deletes, clears."""

import json

from stintline.operators import board

MESSAGE = "heat_id long, frame_id long, message_ordinal long, handle string, payload string"


def state(spark, *told):
    rows = [(1, i, 0, h, json.dumps(p)) for i, (h, p) in enumerate(told)]
    return {r.message_id: r for r in board.board(board.observations(spark.createDataFrame(rows, MESSAGE))).collect()}


def test_changes_are_sparse_and_outlive_a_removal(spark):
    got = state(spark, ("m_c", {"Id": "a", "t": "x", "l": 2}), ("m_d", "a"), ("m_c", {"Id": "a", "m": 7}))
    assert (got["a"].text, got["a"].line, got["a"].modality, got["a"].is_active, got["a"].first_frame, got["a"].last_frame) == ("x", 2, 7, True, 0, 2)


def test_snapshot_is_applied_backwards_and_removes_what_it_lacks(spark):
    got = state(spark, ("m_c", {"Id": "old", "t": "o"}), ("m_i", [{"Id": "a", "t": "first"}, {"Id": "a", "t": "last"}, {"Id": "b"}]), ("m_a", None))
    assert got["a"].text == "first" and (got["old"].is_active, got["old"].removed_frame, got["old"].removal_action) == (False, 1, "SNAPSHOT_ABSENCE")
    assert (got["b"].removed_frame, got["b"].removal_action) == (2, "CLEAR")


def test_incomplete_snapshot_and_unknown_messages_remove_nothing(spark):
    got = state(spark, ("m_c", {"Id": "old", "t": "o"}), ("m_i", [{"Id": "a"}, {"t": "no id"}, 5]), ("m_c", {"t": "no id"}), ("m_z", {}), ("m_i", "oops"))
    assert {k: r.is_active for k, r in got.items()} == {"old": True, "a": True}
    ends = state(spark, ("m_c", {"Id": "old"}), ("m_i", None))
    assert (ends["old"].is_active, ends["old"].removal_action) == (False, "SNAPSHOT_ABSENCE")
