"""Merged statistics patches against a plain deep merge."""

import json
import random

import pytest

from stintline.operators import statistics

MESSAGE = "heat_id long, frame_id long, message_ordinal long, handle string, payload string"


def deep(current, patch):
    out = dict(current)
    for k, v in patch.items():
        out[k] = deep(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def leaves(tree, at=()):
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from leaves(v, (*at, k))
        else:
            yield statistics.SEP.join((*at, k)), str(v)


def patch(rng, depth=0):
    return {rng.choice("abclz"): patch(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else rng.randrange(100) for _ in range(rng.randrange(1, 3))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_equals_a_plain_one(spark, seed):
    rng = random.Random(seed)
    told = [(h, i, 0, rng.choices(["a_u", "a_i", "a_r"], [30, 1, 1])[0], json.dumps(patch(rng))) for h in (1, 2) for i in range(80)]
    want, state, epoch = {}, {}, {}
    for h, _, _, handle, text in told:
        if handle != "a_u":
            epoch[h] = epoch.get(h, 0) + 1
        state[h] = {} if handle == "a_r" else deep({} if handle == "a_i" else state.get(h, {}), json.loads(text))
        want[h, epoch.get(h, 0)] = dict(leaves(state[h]))
    got = {}
    for r in statistics.merged(spark.createDataFrame(told, MESSAGE).repartition(3)).collect():
        got.setdefault((r.heat_id, r.epoch), {})[r.path] = r.value
    assert got == {k: v for k, v in want.items() if v}


def test_summary_tells_what_is_wrong(spark):
    told = [(1, 0, 0, "a_i", json.dumps({"h": "R1", "p": 30, "o": "12", "x": -1, "g": 5, "f": "no", "bC": 3, "qC": "x", "new": [1], "u": "1:02"})), (1, 1, 0, "a_u", json.dumps({"x": 7, "b": {"10": {"r": 3}, "2": {"r": 1}, "z": {"r": 9}}}))]
    state = statistics.merged(spark.createDataFrame(told, MESSAGE))
    r = statistics.summary(state).first()
    assert (r.heat_name, r.participants_started, r.total_laps, r.total_pitstops, r.green_flag_ts_time, r.finish_flag_ts_time, r.safety_car_total_time_raw) == ("R1", 30, 12, 7, 5, None, "1:02")
    assert (r.truncations, r.unknown_keys, r.errors) == ("b=3", "new", "invalid_finish_flag_ts_time,invalid_qC")
    assert [(x.provider_key, x.lap_number) for x in statistics.records(state, "b").orderBy("place").collect()] == [("2", 1), ("10", 3), ("z", 9)]


def test_patches_are_read_once_and_paths_not_joined(spark):
    plan = statistics.merged(spark.createDataFrame([(1, 0, 0, "a_u", '{"a": 1}')], MESSAGE))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join" not in plan
