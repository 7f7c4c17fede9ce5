"""Queries over the provider's statistics: merged patches, lap and leader records."""

from stintline.operators import statistics as T
from stintline.queries.registry import query

#: What the fixture's patches write, leaf by leaf: (variant, condition, path, value).
_LEAVES = (
    (0, "true", "'p'", "n"),
    (0, "true", "'o'", "n + 1"),
    (0, "true", "'h'", "'Race ' || k"),
    (1, "true", "'b/' || k || '/r'", "n"),
    (1, "true", "'b/' || k || '/i'", "n * 1000"),
    (1, "true", "'b/' || k || '/d'", "'driver ' || k"),
    (1, "true", "'q/' || k || '/m'", "'class ' || k % 2"),
    (1, "true", "'q/' || k || '/i'", "n * 1000"),
    (1, "true", "'q/' || k || '/s'", "k"),
    (2, "true", "'b/' || k || '/i'", "n * 7"),
    (2, "true", "'bC'", "n"),
    (3, "true", "'l/' || k || '/f'", "n"),
    (3, "true", "'l/' || k || '/l'", "n"),
    (3, "true", "'l/' || k || '/n'", "'team ' || k"),
    (3, "true", "'lC'", "n"),
    (4, "n % 5 = 0", "'b'", "n"),
    (4, "n % 5 <> 0", "'b/' || k || '/t'", "n"),
    (5, "true", "'h'", "'Race ' || n"),
    (5, "true", "'x'", "'bad'"),
    (5, "true", "'zz'", "1"),
    (6, "true", "'d/' || k || '/e'", "n"),
    (6, "true", "'d/' || k || '/n'", "'team ' || k"),
    (6, "true", "'d2/w/deep/er'", "n"),
    (7, "true", "'c'", "n"),
    (7, "true", "'fc'", "-1"),
    (7, "true", "'x'", "n"),
    (7, "true", "'d/' || k || '/e/odd'", "n"),
)
_STATE = (
    "part AS (SELECT *, sum(CASE WHEN handle <> 'a_u' THEN 1 ELSE 0 END) OVER (PARTITION BY heat_id ORDER BY frame_id) AS epoch FROM fx_statpart),\nleaf AS ("
    + " UNION ALL ".join(f"SELECT heat_id, epoch, frame_id, {path} AS path, CAST({value} AS VARCHAR) AS value FROM part WHERE handle <> 'a_r' AND variant = {v} AND {cond}" for v, cond, path, value in _LEAVES)
    + """),
made AS (SELECT DISTINCT heat_id, epoch, frame_id, array_to_string(string_split(path, '/')[:i], '/') AS path FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS i FROM leaf)),
newest AS (SELECT heat_id, epoch, path, max(frame_id) AS frame_id, arg_max(value, frame_id) AS value FROM leaf GROUP BY 1, 2, 3),
state AS (
  SELECT * FROM newest n WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.heat_id = n.heat_id AND m.epoch = n.epoch AND m.path = n.path AND m.frame_id > n.frame_id)
    AND NOT EXISTS (SELECT 1 FROM newest a WHERE a.heat_id = n.heat_id AND a.epoch = n.epoch AND starts_with(n.path, a.path || '/') AND a.frame_id > n.frame_id))"""
)


def _field(path, kind="BIGINT"):
    return f"max(CASE WHEN path = '{path}' THEN CASE WHEN regexp_full_match(value, '[0-9]+') THEN CAST(value AS BIGINT) END END)" if kind == "BIGINT" else f"max(CASE WHEN path = '{path}' THEN value END)"


@query(
    "a9_statistics",
    _STATE + f""" SELECT heat_id, CAST(epoch AS BIGINT) AS epoch, {_field('h', 'TEXT')} AS heat_name, {_field('p')} AS participants_started, {_field('o')} AS total_laps, {_field('x')} AS total_pitstops, {_field('c')} AS safety_car_count, {_field('fc')} AS full_course_yellow_count,
  coalesce(string_agg(path[:1] || '=' || value, ',' ORDER BY path) FILTER (path IN ('bC', 'lC')), '') AS truncations,
  coalesce(string_agg(DISTINCT string_split(path, '/')[1], ',' ORDER BY string_split(path, '/')[1]) FILTER (string_split(path, '/')[1] IN ('zz', 'd2')), '') AS unknown_keys,
  coalesce(string_agg(CASE WHEN path = 'x' AND value = 'bad' THEN 'invalid_total_pitstops' WHEN path = 'fc' THEN 'invalid_full_course_yellow_count' END, ',' ORDER BY path), '') AS errors FROM state GROUP BY 1, 2""",
)
def a9(fx):
    out = T.summary(T.merged(fx.statmsg))
    return out.select("heat_id", "epoch", "heat_name", "participants_started", "total_laps", "total_pitstops", "safety_car_count", "full_course_yellow_count", "truncations", "unknown_keys", "errors").fillna("", ["truncations", "errors"])


def _record(collection, *fields):
    picks = ", ".join(f"max(CASE WHEN f = '{wire}' THEN {'CAST(value AS BIGINT)' if number else 'value'} END) AS {name}" for wire, name, number in fields)
    return f"SELECT heat_id, CAST(epoch AS BIGINT) AS epoch, string_split(path, '/')[2] AS provider_key, {picks} FROM (SELECT *, string_split(path, '/')[3] AS f FROM state WHERE starts_with(path, '{collection}/') AND len(string_split(path, '/')) = 3) GROUP BY 1, 2, 3"


@query(
    "a10_best_lap_history",
    _STATE + f", r AS ({_record('b', ('r', 'lap_number', 1), ('i', 'lap_time_us', 1), ('t', 'occurred_at_ts_time', 1), ('d', 'driver_name', 0))}) SELECT *, row_number() OVER (PARTITION BY heat_id, epoch ORDER BY CAST(provider_key AS BIGINT)) AS place FROM r",
)
def a10(fx):
    return T.records(T.merged(fx.statmsg), "b").select("heat_id", "epoch", "provider_key", "lap_number", "lap_time_us", "occurred_at_ts_time", "driver_name", "place")


@query(
    "a10_class_bests",
    _STATE + f", r AS ({_record('q', ('m', 'class_name', 0), ('i', 'lap_time_us', 1), ('s', 'start_number', 0))}) SELECT heat_id, epoch, class_name, min(lap_time_us) AS lap_time_us, arg_min(start_number, {{'t': lap_time_us, 'k': CAST(provider_key AS BIGINT)}}) AS start_number FROM r GROUP BY 1, 2, 3",
)
def a10_class(fx):
    return T.class_bests(T.merged(fx.statmsg)).select("heat_id", "epoch", "class_name", "lap_time_us", "start_number")


@query("a11_leader_history", _STATE + f" {_record('l', ('f', 'occurred_at_ts_time', 1), ('l', 'lap_number', 1), ('n', 'team_name', 0))}")
def a11(fx):
    return T.records(T.merged(fx.statmsg), "l").select("heat_id", "epoch", "provider_key", "occurred_at_ts_time", "lap_number", "team_name")


@query("a11_leader_laps", _STATE + f" {_record('d', ('e', 'leader_laps', 1), ('n', 'team_name', 0))}")
def a11_laps(fx):
    return T.records(T.merged(fx.statmsg), "d").select("heat_id", "epoch", "provider_key", "leader_laps", "team_name")
