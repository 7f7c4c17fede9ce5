"""Batch twins of the streams: sparse history, freshness, sliding closures, revised laps, the outbox."""

from pyspark.sql import functions as F

from stintline.operators import battle, history, laps
from stintline.queries.q_battle import RUNS
from stintline.queries.q_laps import CLEAN
from stintline.queries.registry import query
from stintline.streaming import tables

c = F.col


def points(fx):
    return fx.tick.select(c("participant_id").alias("scope_key"), "at_us", c("event_id").alias("seq"), "value", "version", (c("event_type") == "error").alias("is_event"))


@query(
    "f14_sparse_history",
    """RECURSIVE x AS (SELECT participant_id AS scope_key, at_us, event_id AS seq, value, version, event_type = 'error' AS is_event, row_number() OVER (PARTITION BY participant_id ORDER BY at_us, event_id) AS i FROM fx_tick),
s(scope_key, i, kept, at_us, seq, value, version, last_us, last_value, last_version, prior_us, prior_value, prior_version) AS (
  SELECT scope_key, i, true, at_us, seq, value, version, at_us, value, version, NULL::BIGINT, NULL::BIGINT, NULL::INT FROM x WHERE i = 1
  UNION ALL
  SELECT scope_key, i, keep, at_us, seq, value, version, CASE WHEN keep THEN at_us ELSE last_us END, CASE WHEN keep THEN value ELSE last_value END, CASE WHEN keep THEN version ELSE last_version END,
    CASE WHEN keep AND NOT same THEN last_us ELSE prior_us END, CASE WHEN keep AND NOT same THEN last_value ELSE prior_value END, CASE WHEN keep AND NOT same THEN last_version ELSE prior_version END
  FROM (
    SELECT *, NOT (value = last_value AND version = last_version) AND (is_event OR before_us IS NULL OR at_us // 5000000 > before_us // 5000000 OR before_version <> version) AS keep
    FROM (
      SELECT x.*, s.last_us, s.last_value, s.last_version, s.prior_us, s.prior_value, s.prior_version, x.at_us // 1000000 = s.last_us // 1000000 AS same,
        CASE WHEN x.at_us // 1000000 = s.last_us // 1000000 THEN s.prior_us ELSE s.last_us END AS before_us, CASE WHEN x.at_us // 1000000 = s.last_us // 1000000 THEN s.prior_version ELSE s.last_version END AS before_version
      FROM s JOIN x ON x.scope_key = s.scope_key AND x.i = s.i + 1)))
SELECT scope_key, at_us // 1000000 AS second, arg_max(at_us, i) AS at_us, arg_max(seq, i) AS seq, arg_max(value, i) AS value, CAST(arg_max(version, i) AS BIGINT) AS version FROM s WHERE kept GROUP BY 1, 2""",
)
def f14(fx):
    return history.sparse_history(points(fx))


@query(
    "f18_value_ago",
    """x AS (SELECT *, max(CASE WHEN event_id % 97 = 0 THEN at_us END) OVER (PARTITION BY participant_id ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS off_us,
  max({'t': at_us, 'v': ms}) OVER (PARTITION BY participant_id ORDER BY at_us RANGE BETWEEN 600000000 PRECEDING AND 60000000 PRECEDING) AS f FROM fx_tick)
SELECT participant_id, event_id, CASE WHEN off_us IS NULL OR off_us < f.t THEN f.v END AS before_ms FROM x""",
)
def f18(fx):
    ago = history.value_ago(fx.tick, ["participant_id"], "at_us", "ms", 60_000_000, 600_000_000, c("event_id") % 97 != 0)
    return fx.tick.select("participant_id", "event_id", ago.alias("before_ms"))


def _events(fx):
    kind = F.when(c("event_type") == "error", "gap").when(c("event_type") == "signup", "flag").otherwise("tick")
    value = F.when(c("event_type") == "error", F.when(c("event_id") % 2 == 0, "OPEN").otherwise("CLOSED")).when(c("event_type") == "signup", F.when(c("event_id") % 5 == 0, "FINISH").otherwise("GREEN"))
    return fx.tick.select(c("participant_id").alias("session_id"), "at_us", c("event_id").alias("seq"), kind.alias("kind"), value.alias("value"))


@query(
    "t11_freshness_changes",
    """e AS (SELECT participant_id AS session_id, at_us, 0 AS turn, event_id AS seq, CASE event_type WHEN 'error' THEN 'gap' WHEN 'signup' THEN 'flag' ELSE 'tick' END AS kind,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'FINISH' ELSE 'GREEN' END END AS value FROM fx_tick),
p AS (SELECT session_id, at_us, turn, seq FROM e UNION ALL SELECT session_id, at_us + 3000001, 1, seq FROM e WHERE kind = 'tick' AND at_us + 3000001 <= 1704067920000000 UNION ALL SELECT session_id, at_us + 10000001, 1, seq FROM e WHERE kind = 'tick' AND at_us + 10000001 <= 1704067920000000),
s AS (
  SELECT p.session_id, p.at_us, p.turn, p.seq, max(e.at_us) FILTER (e.kind = 'tick') AS seen, arg_max(e.value, {'a': e.at_us, 's': e.seq}) FILTER (e.kind = 'gap') AS gap, arg_max(e.value, {'a': e.at_us, 's': e.seq}) FILTER (e.kind = 'flag') AS flag
  FROM p JOIN e ON e.session_id = p.session_id AND (e.at_us < p.at_us OR (e.at_us = p.at_us AND (p.turn = 1 OR e.seq <= p.seq))) GROUP BY 1, 2, 3, 4),
r AS (SELECT *, CASE WHEN flag = 'FINISH' THEN 'track_finished' WHEN gap = 'OPEN' THEN 'source_gap' WHEN seen IS NULL THEN 'no_state_tick' WHEN at_us - seen <= 3000000 THEN 'fresh' WHEN at_us - seen <= 10000000 THEN 'stale' ELSE 'source_timeout' END AS reason FROM s)
SELECT session_id, at_us, CASE reason WHEN 'fresh' THEN 'LIVE' WHEN 'stale' THEN 'STALE' ELSE 'OFFLINE' END AS status, reason
FROM (SELECT *, lag(reason) OVER (PARTITION BY session_id ORDER BY at_us, turn, seq) AS b FROM r) WHERE b IS NULL OR b <> reason""",
)
def t11(fx):
    return history.freshness_changes(_events(fx), F.lit(1_704_067_920_000_000))


def _window_sql(w):
    f = f"w{w}"
    change = f"gap_ms - {f}.g"
    return f"{change} AS change_{w}_ms, CASE WHEN relation = 'AHEAD' THEN -({change}) ELSE {change} END * 60000000.0 / (observed_at_us - {f}.t) AS closure_{w}_ms_per_min"


@query(
    "t5_sliding_closures",
    RUNS.replace("fx_gap_sample", "fx_gap_tick")
    + ",\nw AS (SELECT *, "
    + ", ".join(f"max({{'t': observed_at_us, 's': seq, 'g': gap_ms}}) OVER (PARTITION BY focal_id, relation, run ORDER BY observed_at_us RANGE BETWEEN 1800000000 PRECEDING AND {w}000000 PRECEDING) AS w{w}" for w in (30, 60, 180, 600))
    + f" FROM runs) SELECT focal_id, relation, target_id, observed_at_us, seq, gap_ms, {', '.join(map(_window_sql, (30, 60, 180)))}, w600.g AS gap_ago_ms FROM w",
)
def t5(fx):
    return battle.sliding_closures(fx.gap_tick)


@query(
    "t8_revised_laps",
    CLEAN.replace("fx_pit", "fx_pit_early") + " SELECT l.participant_id, l.lap_number FROM clean l WHERE is_clean AND EXISTS (SELECT 1 FROM fx_pit_late s WHERE s.heat_id = l.heat_id AND s.participant_id = l.participant_id AND s.completed AND s.entered_at_us < l.completed_at_us AND s.exited_at_us > l.started_at_us)",
)
def t8(fx):
    """Laps that were clean before the late stops came, and are not since; only the participants that those stops touch are looked at."""
    touched = fx.pit_late.select("heat_id", "participant_id").distinct()
    rows, key = fx.lap.join(touched, ["heat_id", "participant_id"], "left_semi"), ["participant_id", "lap_number"]
    before = laps.clean_laps(rows, fx.flag, fx.pit_early, fx.feedgap, fx.state).where("is_clean").select(*key)
    now = laps.clean_laps(rows, fx.flag, fx.pit_early.unionByName(fx.pit_late), fx.feedgap, fx.state).where("is_clean").select(*key)
    return before.join(now, key, "left_anti")


@query("t9_outbox", "SELECT conn_id, frame_id, handle, row_number() OVER (ORDER BY received_at_us, frame_id) AS cursor FROM fx_frame")
def t9(fx):
    return tables.numbered(fx.frame.select("conn_id", "frame_id", "handle", "received_at_us"), ["received_at_us", "frame_id"]).drop("received_at_us")
