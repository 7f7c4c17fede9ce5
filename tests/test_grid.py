"""The dynamic grid: rules, batch against a plain reducer, stream against batch over restarts."""

import json
import random

import pytest

from stintline.operators import grid
from stintline.streaming import grid_stream
from tests.test_feed_stream import run_stateful

MESSAGE = "heat_id long, conn_id long, frame_id long, message_ordinal long, handle string, payload string"


def layout(*names):
    return {"h": [{"n": n, "p": p} if p else {"n": n} for n, p in (n if isinstance(n, tuple) else (n, None) for n in names)]}


def messages(spark, *told):
    return spark.createDataFrame([(1, 1, i, 0, h, json.dumps(p)) for i, (h, p) in enumerate(told)], MESSAGE)


def values(df):
    return {(r.row_ix, r.key): r.value for r in df.collect()}


def test_snapshot_changes_and_removal(spark):
    told = [("r_i", {"l": layout("NR", "Team", "futureX"), "r": [[4, 0, "21"], [4, 1, "A", "style"], [4, 2, "raw"], [-1, -1, "m"], ["row", 1, "bad"], [5, 1], [6, 9, "far"]]}), ("r_c", [[7, 0, "9"]]), ("r_d", [[4], [-1], ["x"]])]
    before = grid.grid_as_of(messages(spark, *told), at_frame=1)
    assert values(before) == {(4, "start_number"): "21", (4, "team_name"): "A", (4, "unknown:futureX:"): "raw", (6, "column_9"): "far", (7, "start_number"): "9"}
    assert {r.key: r.presentation for r in before.where("row_ix = 4").collect()}["team_name"] == ["style"]
    assert values(grid.grid_as_of(messages(spark, *told))) == {(6, "column_9"): "far", (7, "start_number"): "9"}


def test_nothing_enters_without_a_layout_or_under_an_ambiguous_one(spark):
    told = [("r_c", [[0, 0, "a"]]), ("r_i", {"r": [[0, 0, "b"]]}), ("r_l", layout("NR")), ("r_c", [[0, 0, "c"]]), ("r_l", layout("NR", "startnumber")), ("r_c", [[0, 0, "d"]])]
    assert values(grid.grid_as_of(messages(spark, *told), at_frame=2)) == {}
    assert values(grid.grid_as_of(messages(spark, *told), at_frame=3)) == {(0, "start_number"): "c"}
    assert values(grid.grid_as_of(messages(spark, *told))) == {}


def test_layout_keeps_cells_by_meaning(spark):
    told = [("r_i", {"l": layout("NR", "POS", "PIC", "fut", ("fut", "2")), "r": [[0, 0, "21"], [0, 1, "3"], [0, 2, "1"], [0, 3, "x"], [0, 4, "y"], [0, 8, "z"]]}), ("r_l", layout("NR", "PIC", ("fut", "2"), "LAPS")), ("r_c", [[0, 3, "28"]])]
    assert values(grid.grid_as_of(messages(spark, *told))) == {(0, "start_number"): "21", (0, "position_class"): "1", (0, "unknown:fut:2"): "y", (0, "laps"): "28"}
    # a column that was away for one layout does not come back
    again = [*told, ("r_l", layout("NR", "POS", "PIC"))]
    assert values(grid.grid_as_of(messages(spark, *again))) == {(0, "start_number"): "21", (0, "position_class"): "1"}


NAMES = ["NR", "POS", "LAPS", "LAST", "GAP", "fut", ("fut", "2"), "startnumber", "x"]
KEYS = {"NR": "start_number", "startnumber": "start_number", "POS": "position_overall", "LAPS": "laps", "LAST": "last_lap", "GAP": "gap"}


def story(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        some = rng.sample(NAMES, rng.randrange(1, 7))
        cells = [[rng.randrange(4), rng.randrange(7), f"{i}.{k}"] for k in range(rng.randrange(0, 4))]
        kind = rng.choices(["r_c", "r_i", "r_l", "r_d"], [20, 1, 2, 2])[0]
        payload = {"r_c": cells, "r_i": {"r": cells, **({"l": layout(*some)} if rng.random() < 0.7 else {})}, "r_l": layout(*some), "r_d": [[rng.randrange(4)]]}[kind]
        out.append((rng.randrange(2), rng.randrange(2), i // 3, i % 3, kind, json.dumps(payload)))
    return out


def reduced(told):
    """Plain reducer: {(heat, row, key): value}."""
    state = {}
    for heat, _, _, _, kind, payload in sorted(told, key=lambda m: (m[2], m[3])):
        columns, rows = state.setdefault(heat, [None, {}])
        p = json.loads(payload)
        changes = p if kind == "r_c" else []
        if kind in ("r_i", "r_l"):
            new = p.get("l") if kind == "r_i" else p
            if kind == "r_i":
                rows.clear()
                changes = p["r"]
            if new is not None:
                columns = [(c["n"], c.get("p")) for c in new["h"]]
                meant = [KEYS.get(n, (n, q)) for n, q in columns]
                clash = any(meant.count(KEYS[n]) > 1 for n, _ in columns if n in KEYS)
                columns = [] if clash else meant
                state[heat][0] = None if clash else meant
                for place in [k for k in rows if clash or meant.count(k[1]) != 1]:
                    del rows[place]
        if kind == "r_d":
            for place in [k for k in rows if k[0] == p[0][0]]:
                del rows[place]
        if state[heat][0] is not None:
            for row, col, value in changes:
                meant = state[heat][0]
                rows[row, meant[col] if col < len(meant) else col] = value
    shown = lambda k: k if isinstance(k, str) else f"column_{k}" if isinstance(k, int) else f"unknown:{k[0]}:{k[1] or ''}"
    return {(heat, row, shown(k)): v for heat, (_, rows) in state.items() for (row, k), v in rows.items()}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_batch_equals_a_plain_reducer(spark, seed):
    told = story(seed)
    got = grid.grid_as_of(spark.createDataFrame(told, MESSAGE).repartition(3))
    assert {(r.heat_id, r.row_ix, r.key): r.value for r in got.collect()} == reduced(told)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    told = story(5, 200)
    cuts = [told[:70], told[60:130], told[130:]]  # ten messages come twice
    run_stateful(spark, tmp_path, cuts, MESSAGE, grid_stream.grid_changes)
    now = grid_stream.current(spark.read.parquet(str(tmp_path / "out")))
    batch = grid.grid_as_of(spark.createDataFrame(told, MESSAGE))
    pick = ["heat_id", "row_ix", "key", "value", "frame_id", "message_ordinal", "change_ordinal"]
    assert sorted(map(tuple, now.select(*pick).collect())) == sorted(map(tuple, batch.select(*pick).collect()))
    assert {(r.heat_id, r.row_ix, r.key): r.value for r in now.collect()} == reduced(told)


def test_change_is_trusted_only_after_a_baseline_of_its_connection(spark):
    rows = [
        (1, 1, 0, 0, "r_c", "[[0,0,\"a\"]]"),
        (1, 1, 1, 0, "r_i", json.dumps({"l": layout("NR"), "r": []})),
        (1, 1, 1, 1, "r_c", "[[0,0,\"b\"]]"),
        (1, 2, 2, 0, "r_c", "[[0,0,\"c\"]]"),
        (1, 2, 3, 0, "r_l", json.dumps(layout("NR", "POS"))),
        (1, 1, 4, 0, "r_c", "[[0,0,\"d\"]]"),
        (1, 2, 5, 0, "r_c", "[[0,1,\"e\"]]"),
        (1, 2, 6, 0, "r_l", json.dumps(layout("NR", "startno"))),
        (1, 2, 7, 0, "r_c", "[[0,1,\"f\"]]"),
    ]
    got = grid.trusted_changes(spark.createDataFrame(rows, MESSAGE))
    assert {r.frame_id * 10 + r.message_ordinal: r.trusted for r in got.collect()} == {0: False, 11: True, 20: False, 40: False, 50: True, 70: False}


def test_contract(spark):
    full = [(w, p) for _, w, p in grid.REQUIRED_HEADERS]
    told = [("r_i", {"l": layout(*full), "r": []}), ("r_l", layout(*full[1:], "pos", "extra")), ("r_i", {"l": layout(*full), "r": []})]
    got = {r.version: r for r in grid.schema_contract(grid.layout_versions(messages(spark, *told))).collect()}
    assert got[0].status == "CURRENT" and got[0].missing == got[0].mismatched == got[0].unknown == "" and got[0].columns == 16
    assert (got[1].status, got[1].missing, got[1].mismatched, got[1].unknown) == ("DEGRADED", "position_overall", "position_overall", "extra") and set(got) == {0, 1}


def test_trusted_changes_pair_no_connection_with_all_layouts(spark):
    told = [(1, i // 4, i, 0, "r_l" if i % 4 == 0 else "r_c", json.dumps(layout("NR") if i % 4 == 0 else [[i % 3, 0, "1"]])) for i in range(40_000, 40_040)]
    cells = grid.trusted_changes(spark.createDataFrame(told, MESSAGE)).orderBy("frame_id").collect()
    assert len(cells) == 30 and all(r.trusted for r in cells)
    plan = grid.trusted_changes(spark.createDataFrame(told, MESSAGE))._jdf.queryExecution().optimizedPlan().toString().lower()
    joins = [line for line in plan.splitlines() if "join " in line]
    assert joins and not any(line.count("heat_id") and "conn" not in line and "__block" not in line for line in joins)
