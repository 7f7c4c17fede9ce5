"""Gap trends, stints, pits, joins and obligations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintline.operators import battle as B
from stintline.operators import identity
from stintline.operators import laps as L
from stintline.operators import pits as P
from stintline.operators import windows as W
from stintline.queries.q_laps import CLEAN, PACE, clean_laps, pace
from stintline.queries.registry import query

c = F.col
DAY = 86_400

RUNS = """g AS (SELECT *, target_id IS NOT NULL AND gap_ms >= 0 AND our_lap = target_lap AND flag = 'GREEN' AS ok FROM fx_gap_sample),
h AS (SELECT *, NOT ok OR NOT coalesce(lag(ok) OVER w, false) OR target_id IS DISTINCT FROM lag(target_id) OVER w AS br FROM g WINDOW w AS (PARTITION BY focal_id, relation ORDER BY observed_at_us, seq)),
runs AS (SELECT * FROM (SELECT *, sum(CASE WHEN br THEN 1 ELSE 0 END) OVER (PARTITION BY focal_id, relation ORDER BY observed_at_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM h) WHERE ok)"""


def trend_sql(name: str, seconds: int) -> str:
    return f"""{name}_x AS (SELECT *, max({{'t': observed_at_us, 's': seq, 'g': gap_ms, 'l': our_lap}}) OVER (PARTITION BY focal_id, relation, run ORDER BY observed_at_us RANGE BETWEEN UNBOUNDED PRECEDING AND {seconds * 1_000_000} PRECEDING) AS f FROM runs),
{name}_y AS (SELECT *, gap_ms - f.g AS ch, CASE WHEN relation = 'AHEAD' THEN f.g - gap_ms ELSE gap_ms - f.g END AS cl FROM {name}_x WHERE f IS NOT NULL),
{name} AS (SELECT focal_id, relation, target_id, observed_at_us, seq, our_lap, {seconds} AS window_s, gap_ms, ch AS gap_change_ms, cl * 60000000.0::DOUBLE / (observed_at_us - f.t) AS closure_ms_per_min,
  CASE WHEN our_lap > f.l THEN cl / (our_lap - f.l) END AS closure_ms_per_lap,
  CASE WHEN ch = 0 THEN 'STABLE' WHEN relation = 'AHEAD' THEN CASE WHEN ch < 0 THEN 'CLOSING' ELSE 'LOSING_GROUND' END ELSE CASE WHEN ch > 0 THEN 'PULLING_AWAY' ELSE 'BEING_CAUGHT' END END AS direction FROM {name}_y)"""


@query("c2_eligible_gaps", RUNS + " SELECT focal_id, relation, seq FROM g WHERE ok")
def c2(fx):
    return fx.gap_sample.where(B.is_eligible(fx.gap_sample)).select("focal_id", "relation", "seq")


for _name, _days in (("f6_gap_trend_1d", 1), ("f6_gap_trend_2d", 2), ("f6_gap_trend_7d", 7)):
    query(_name, RUNS + ",\n" + trend_sql("t", _days * DAY) + " SELECT * FROM t")(lambda fx, d=_days: B.gap_trend(fx.gap_sample, d * DAY))


def _lap_trend_sql(n: int) -> str:
    return RUNS + f""",
p AS (SELECT a.*, max({{'t': b.observed_at_us, 's': b.seq, 'g': b.gap_ms}}) AS f FROM runs a JOIN runs b ON a.focal_id = b.focal_id AND a.relation = b.relation AND a.run = b.run AND b.our_lap = a.our_lap - {n} AND b.observed_at_us < a.observed_at_us WHERE a.our_lap >= {n} GROUP BY ALL),
q AS (SELECT *, gap_ms - f.g AS ch, CASE WHEN relation = 'AHEAD' THEN f.g - gap_ms ELSE gap_ms - f.g END / {n} AS rate FROM p)
SELECT focal_id, relation, observed_at_us, seq, our_lap, {n} AS window_laps, ch AS gap_change_ms, rate AS closure_ms_per_lap,
  CASE WHEN ch = 0 THEN 'STABLE' WHEN relation = 'AHEAD' THEN CASE WHEN ch < 0 THEN 'CLOSING' ELSE 'LOSING_GROUND' END ELSE CASE WHEN ch > 0 THEN 'PULLING_AWAY' ELSE 'BEING_CAUGHT' END END AS direction,
  CASE WHEN relation = 'AHEAD' AND rate > 0 THEN gap_ms / rate WHEN relation = 'BEHIND' AND rate < 0 THEN gap_ms / -rate END AS catch_laps FROM q"""


for _n in (3, 5):
    query(f"f7_gap_lap_trend_{_n}", _lap_trend_sql(_n))(lambda fx, n=_n: B.gap_lap_trend(fx.gap_sample, n))


@query(
    "f8_catch_range",
    RUNS + ",\n" + ",\n".join(trend_sql(f"t{d}", d * DAY) for d in (1, 2, 7)) + """,
u AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t7),
v AS (SELECT *, CASE WHEN direction = 'CLOSING' AND closure_ms_per_lap > 0 THEN closure_ms_per_lap WHEN direction = 'BEING_CAUGHT' AND closure_ms_per_lap < 0 THEN -closure_ms_per_lap END AS rate FROM u)
SELECT focal_id, relation, observed_at_us, seq, gap_ms / max(rate) AS min_laps, gap_ms / min(rate) AS max_laps, gap_ms / max(rate) * 100000.0::DOUBLE AS min_time_ms, gap_ms / min(rate) * 100000.0::DOUBLE AS max_time_ms
FROM v GROUP BY focal_id, relation, observed_at_us, seq, gap_ms HAVING count(rate) >= 2""",
)
def f8(fx):
    return B.catch_windows(fx.gap_sample, (DAY, 2 * DAY, 7 * DAY), F.lit(100_000.0))


@query(
    "m_projected_gap",
    RUNS + ",\n" + trend_sql("t", 2 * DAY) + " SELECT focal_id, relation, seq, gap_ms + CASE WHEN relation = 'AHEAD' THEN -1 ELSE 1 END * closure_ms_per_lap * 5 AS gap_5, gap_ms + CASE WHEN relation = 'AHEAD' THEN -1 ELSE 1 END * closure_ms_per_lap * 10 AS gap_10, CASE WHEN relation = 'AHEAD' THEN 99000.0::DOUBLE - gap_ms / (3600.0::DOUBLE * 1000 / 100000) ELSE 99000.0::DOUBLE + gap_ms / (3600.0::DOUBLE * 1000 / 100000) END AS required_ms FROM t WHERE closure_ms_per_lap IS NOT NULL",
)
def m_projected(fx):
    t = B.gap_trend(fx.gap_sample, 2 * DAY).where("closure_ms_per_lap is not null")
    return t.select("focal_id", "relation", "seq", *[B.projected_gap(c("relation"), c("gap_ms"), c("closure_ms_per_lap"), n).alias(f"gap_{n}") for n in (5, 10)], B.required_pace(c("relation"), F.lit(100_000.0), F.lit(99_000.0), c("gap_ms"), F.lit(3600.0)).alias("required_ms"))


@query("d7_calibration_as_of", "cal AS (SELECT conn_id, received_at_us AS at_us, provider_ts FROM fx_clock WHERE frame_id % 10 = 0) SELECT l.conn_id, l.frame_id, c.provider_ts FROM fx_clock l ASOF LEFT JOIN cal c ON l.conn_id = c.conn_id AND l.received_at_us >= c.at_us")
def d7(fx):
    cal = fx.clock.where("frame_id % 10 = 0").select("conn_id", "received_at_us", "provider_ts")
    return W.as_of(fx.clock.select("conn_id", "frame_id", "received_at_us"), cal, ["conn_id"], "received_at_us", ["provider_ts"]).select("conn_id", "frame_id", "provider_ts")


@query(
    "d8_last_lap_link",
    """t AS (SELECT participant_id, lap_number, completed_at_us AS at_us, duration_ms FROM fx_lap WHERE event_id % 3 = 0), s AS (SELECT participant_id, event_id, completed_at_us + (event_id % 9) * 1000000 AS at_us, duration_ms FROM fx_lap),
p AS (SELECT s.participant_id, s.event_id, t.lap_number, count(*) OVER (PARTITION BY s.participant_id, s.event_id) AS a, count(*) OVER (PARTITION BY t.participant_id, t.lap_number) AS b FROM s JOIN t ON s.participant_id = t.participant_id AND s.duration_ms = t.duration_ms AND abs(s.at_us - t.at_us) <= 5000000)
SELECT participant_id, event_id, lap_number FROM p WHERE a = 1 AND b = 1""",
)
def d8(fx):
    t = fx.lap.where("event_id % 3 = 0").select("participant_id", "lap_number", c("completed_at_us").alias("t_us"), "duration_ms")
    s = fx.lap.select("participant_id", "event_id", (c("completed_at_us") + (c("event_id") % 9) * 1_000_000).alias("s_us"), "duration_ms")
    p = s.join(t, ["participant_id", "duration_ms"]).where("abs(s_us - t_us) <= 5000000")
    a, b = Window.partitionBy("participant_id", "event_id"), Window.partitionBy("participant_id", "lap_number")
    return p.withColumn("a", F.count("*").over(a)).withColumn("b", F.count("*").over(b)).where("a = 1 and b = 1").select("participant_id", "event_id", "lap_number")


@query(
    "d9_same_frame_pair",
    "x AS (SELECT *, count(*) OVER (PARTITION BY heat_id, frame_id, row_ix % 10) AS n FROM fx_cell WHERE col_ix = 1), y AS (SELECT *, count(*) OVER (PARTITION BY heat_id, frame_id, row_ix % 10) AS n FROM fx_cell WHERE col_ix = 2) SELECT x.heat_id, x.frame_id, x.value AS boundary, y.value AS last_value FROM x JOIN y ON x.heat_id = y.heat_id AND x.frame_id = y.frame_id AND x.row_ix % 10 = y.row_ix % 10 WHERE x.n = 1 AND y.n = 1",
)
def d9(fx):
    w = Window.partitionBy("heat_id", "frame_id", "car")
    one = lambda k, name: fx.cell.where(c("col_ix") == k).withColumn("car", c("row_ix") % 10).withColumn("n", F.count("*").over(w)).where("n = 1").select("heat_id", "frame_id", "car", c("value").alias(name))
    return one(1, "boundary").join(one(2, "last_value"), ["heat_id", "frame_id", "car"]).select("heat_id", "frame_id", "boundary", "last_value")


@query(
    "d10_passing_participant",
    "k AS (SELECT participant_id AS n, arg_max(class_key, lap_number) AS id FROM fx_lap WHERE participant_id % 3 > 0 GROUP BY 1), t AS (SELECT participant_id + 1000000 AS n, min(class_key) AS id FROM fx_lap GROUP BY 1) SELECT p.event_id, coalesce(k.id, t.id) AS resolved FROM fx_passing p LEFT JOIN k ON k.n = p.participant_id LEFT JOIN t ON t.n = p.participant_id + 1000000",
)
def d10(fx):
    k = fx.lap.where("participant_id % 3 > 0").groupBy("participant_id").agg(F.max_by("class_key", "lap_number").alias("by_number"))
    t = fx.lap.groupBy((c("participant_id") + 1_000_000).alias("transponder")).agg(F.min("class_key").alias("by_transponder"))
    p = fx.passing.withColumn("transponder", c("participant_id") + 1_000_000).join(k, "participant_id", "left").join(t, "transponder", "left")
    return p.select("event_id", F.coalesce("by_number", "by_transponder").alias("resolved"))


@query(
    "d11_identity",
    """RECURSIVE x AS (
  SELECT heat_id, frame_id, row_ix, trim(start_number) AS n, CASE team_name WHEN 'Our  Team' THEN 'our team' ELSE lower(team_name) END AS t, lower(class_name) AS k, row_number() OVER (PARTITION BY heat_id ORDER BY frame_id, row_ix) AS i FROM fx_identrow),
s(heat_id, i, frame_id, row_ix, external_key, is_ours, known, ours) AS (
  SELECT heat_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, false, MAP {'': ''}, false FROM (SELECT DISTINCT heat_id FROM x)
  UNION ALL
  SELECT heat_id, i, frame_id, row_ix, key, NOT clash AND (coalesce(t = 'our team', false) OR (t IS NULL AND coalesce(n = '21', false))), CASE WHEN t IS NULL THEN known ELSE map_concat(known, MAP {t: key}) END, ours OR (coalesce(n = '21', false) AND coalesce(t = 'our team', false))
  FROM (
    SELECT *, CASE WHEN clash THEN 'conflict:nr:' || n || ':team:' || t WHEN n IS NULL AND t IS NOT NULL AND known[t] IS NOT NULL THEN known[t] WHEN n IS NOT NULL THEN 'nr:' || n WHEN t IS NOT NULL THEN 'team:' || t || ':class:' || coalesce(k, '') ELSE 'row:' || row_ix END AS key
    FROM (SELECT x.*, s.known, s.ours, coalesce(x.n = '21' AND x.t <> 'our team' AND s.ours, false) AS clash FROM s JOIN x ON x.heat_id = s.heat_id AND x.i = s.i + 1)))
SELECT heat_id, frame_id, row_ix, external_key, is_ours FROM s WHERE i > 0""",
)
def d11(fx):
    return identity.resolve(fx.identrow, "21", "Our Team").select("heat_id", "frame_id", "row_ix", "external_key", "is_ours")


@query(
    "d12_relation_target",
    "n AS (SELECT heat_id, position, row_key, count(*) OVER (PARTITION BY heat_id, position) AS k FROM fx_gaptext) SELECT g.heat_id, g.row_key, l.row_key AS gap_target, a.row_key AS diff_target FROM fx_gaptext g LEFT JOIN n l ON l.heat_id = g.heat_id AND l.position = 1 AND l.k = 1 AND g.position > 1 LEFT JOIN n a ON a.heat_id = g.heat_id AND a.position = g.position - 1 AND a.k = 1",
)
def d12(fx):
    g = fx.gaptext
    n = g.withColumn("k", F.count("*").over(Window.partitionBy("heat_id", "position"))).where("k = 1")
    lead = n.where("position = 1").select("heat_id", c("row_key").alias("gap_target"))
    ahead = n.select("heat_id", (c("position") + 1).alias("position"), c("row_key").alias("diff_target"))
    return g.join(lead, "heat_id", "left").join(ahead, ["heat_id", "position"], "left").select("heat_id", "row_key", F.when(c("position") > 1, c("gap_target")).alias("gap_target"), "diff_target")


_CELLS = "cells AS (SELECT heat_id AS message_id, position AS participant_id, CASE WHEN position % 3 = 0 THEN 'DIFF' ELSE 'GAP' END AS kind, row_key % 90000 AS value_ms, CASE WHEN position % 3 = 0 THEN position - 1 ELSE position - 1 - position % 2 END AS target_id FROM fx_gaptext WHERE position > 2), pairs AS (SELECT heat_id AS message_id, position AS ours_id, position + 1 AS target_id FROM fx_gaptext WHERE position > 2)"


@query(
    "d13_tactical_interval",
    _CELLS + """, f AS (
  SELECT p.*, CASE WHEN x.kind = 'GAP' THEN 1 ELSE 3 END AS rank, value_ms FROM pairs p JOIN cells x ON x.message_id = p.message_id AND x.participant_id = p.ours_id AND x.target_id = p.target_id
  UNION ALL SELECT p.*, CASE WHEN x.kind = 'GAP' THEN 2 ELSE 4 END, value_ms FROM pairs p JOIN cells x ON x.message_id = p.message_id AND x.participant_id = p.target_id AND x.target_id = p.ours_id
  UNION ALL SELECT p.*, 5, abs(x.value_ms - y.value_ms) FROM pairs p JOIN cells x ON x.message_id = p.message_id AND x.participant_id = p.ours_id AND x.kind = 'GAP' JOIN cells y ON y.message_id = p.message_id AND y.participant_id = p.target_id AND y.kind = 'GAP' AND y.target_id = x.target_id),
b AS (SELECT message_id, ours_id, target_id, min({'r': rank, 'v': value_ms}) AS x FROM f GROUP BY 1, 2, 3)
SELECT message_id, ours_id, target_id, x.v AS value_ms, coalesce(CASE x.r WHEN 1 THEN 'OWN_GAP' WHEN 2 THEN 'TARGET_GAP' WHEN 3 THEN 'OWN_DIFF' WHEN 4 THEN 'TARGET_DIFF' WHEN 5 THEN 'COMMON_LEADER' END, 'MISSING') AS status FROM pairs LEFT JOIN b USING (message_id, ours_id, target_id)""",
)
def d13(fx):
    g = fx.gaptext.where("position > 2")
    p = c("position")
    target = F.when(p % 3 == 0, p - 1).otherwise(p - 1 - p % 2)
    cells = g.select(c("heat_id").alias("message_id"), p.alias("participant_id"), F.when(p % 3 == 0, "DIFF").otherwise("GAP").alias("kind"), (c("row_key") % 90_000).alias("value_ms"), target.alias("target_id"))
    return B.tactical_interval(cells, g.select(c("heat_id").alias("message_id"), p.alias("ours_id"), (p + 1).alias("target_id")))


@query(
    "d14_neighbours",
    "SELECT heat_id AS class_key, row_key AS participant_id, first_value(row_key) OVER w AS leader_id, lag(row_key) OVER w AS ahead_id, lead(row_key) OVER w AS behind_id FROM fx_gaptext WINDOW w AS (PARTITION BY heat_id ORDER BY position)",
)
def d14(fx):
    return B.neighbours(fx.gaptext.select(c("heat_id").alias("class_key"), c("row_key").alias("participant_id"), c("position").alias("position_class"), F.lit("ON_TRACK").alias("state_kind")))


@query("d15_focal_competitors", PACE + " SELECT a.participant_id AS focal_id, b.participant_id AS other_id, a.pace_5_ms - b.pace_5_ms AS delta_ms FROM latest a JOIN latest b ON a.class_key = b.class_key AND a.participant_id <> b.participant_id WHERE a.participant_id = (SELECT min(participant_id) FROM fx_lap)")
def d15(fx):
    latest = L.latest_pace(pace(fx))
    focal = fx.lap.agg(F.min("participant_id").alias("participant_id"))
    ours = latest.join(F.broadcast(focal), "participant_id").select("class_key", c("participant_id").alias("focal_id"), c("pace_5_ms").alias("p"))  # one row
    return latest.join(F.broadcast(ours), "class_key").where("focal_id <> participant_id").select("focal_id", c("participant_id").alias("other_id"), (c("p") - c("pace_5_ms")).alias("delta_ms"))


@query(
    "d19_lap_passings",
    """SELECT l.participant_id, l.lap_number, p.event_id, row_number() OVER (PARTITION BY l.participant_id, l.lap_number ORDER BY p.provider_us, p.event_id) AS n,
  CASE WHEN p.sector_id = -1 THEN 'PIT_PATH' WHEN p.start_mm = 0 THEN 'FINISH' WHEN p.sector_id > 0 THEN concat('SECTOR_', p.sector_id, '_END') ELSE 'OTHER' END AS role
FROM fx_lap l JOIN fx_passing p ON p.participant_id = l.participant_id AND p.provider_us + 946684800000000 - 10800000000 > l.started_at_us AND p.provider_us + 946684800000000 - 10800000000 <= l.completed_at_us""",
)
def d19(fx):
    at = c("provider_us") + 946_684_800_000_000 - 10_800_000_000
    left = fx.lap.where("started_at_us is not null").select("participant_id", "lap_number", (c("started_at_us") + 1).alias("l_start"), (c("completed_at_us") + 1).alias("l_end"))
    right = fx.passing.select("participant_id", "event_id", "provider_us", "sector_id", "start_mm", at.alias("r_start"), (at + 1).alias("r_end"))
    hit = W.interval_pairs(left, right, ["participant_id"])
    role = F.when(c("sector_id") == -1, "PIT_PATH").when(c("start_mm") == 0, "FINISH").when(c("sector_id") > 0, F.concat(F.lit("SECTOR_"), c("sector_id").cast("string"), F.lit("_END"))).otherwise("OTHER")
    return hit.select("participant_id", "lap_number", "event_id", F.row_number().over(Window.partitionBy("participant_id", "lap_number").orderBy("provider_us", "event_id")).cast("long").alias("n"), role.alias("role"))


@query(
    "d20_flag_reconcile",
    "h AS (SELECT heat_id, flag, started_at_us + 30000000 AS h_us FROM fx_flag WHERE started_at_us % 7 <> 0), p AS (SELECT f.heat_id, f.flag, f.started_at_us, h.h_us, row_number() OVER (PARTITION BY f.heat_id, f.flag, f.started_at_us ORDER BY abs(h.h_us - f.started_at_us), h.h_us) AS r FROM fx_flag f JOIN h ON h.heat_id = f.heat_id AND h.flag = f.flag AND abs(h.h_us - f.started_at_us) <= 120000000) SELECT heat_id, flag, started_at_us, h_us FROM p WHERE r = 1",
)
def d20(fx):
    # both sides are dealt by time, the history also to the neighbouring bin, so that a flag of a heat is not one task
    width = 240_000_000
    h = fx.flag.where("started_at_us % 7 <> 0").select("heat_id", "flag", (c("started_at_us") + 30_000_000).alias("h_us"))
    near = F.array_distinct(F.array(*[F.call_function("div", c("h_us") + shift, F.lit(width).cast("bigint")) for shift in (-120_000_000, 120_000_000)]))
    h = h.withColumn("bin", F.explode(near))
    live = fx.flag.select("heat_id", "flag", "started_at_us", F.call_function("div", c("started_at_us"), F.lit(width).cast("bigint")).alias("bin"))
    p = live.join(h, ["heat_id", "flag", "bin"]).where("abs(h_us - started_at_us) <= 120000000")
    return p.groupBy("heat_id", "flag", "started_at_us").agg(F.min_by("h_us", F.struct(F.abs(c("h_us") - c("started_at_us")), "h_us")).alias("h_us"))


@query(
    "d22_sectors_of_last",
    """x AS (SELECT *, min(CASE WHEN col_ix = 4 THEN frame_id END) OVER (PARTITION BY heat_id, row_ix ORDER BY frame_id RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_frame FROM fx_cell)
SELECT heat_id, row_ix, last_frame, col_ix, arg_max(value, {'f': frame_id, 'm': message_ordinal, 'c': change_ordinal}) AS value FROM x WHERE col_ix < 4 AND last_frame IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def d22(fx):
    w = Window.partitionBy("heat_id", "row_ix").orderBy("frame_id").rangeBetween(0, Window.unboundedFollowing)
    x = fx.cell.withColumn("last_frame", F.min(F.when(c("col_ix") == 4, c("frame_id"))).over(w)).where("col_ix < 4 and last_frame is not null")
    return x.groupBy("heat_id", "row_ix", "last_frame", "col_ix").agg(F.max_by("value", F.struct("frame_id", "message_ordinal", "change_ordinal")).alias("value"))


@query("d23_raw_anti_legacy", "SELECT participant_id, lap_number, 'raw' AS source, true AS timing_eligible FROM fx_lap WHERE event_id % 2 = 0 UNION ALL SELECT participant_id, lap_number, 'legacy', duration_ms % 20 = 0 FROM fx_lap l WHERE event_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM fx_lap r WHERE r.event_id % 2 = 0 AND r.participant_id = l.participant_id AND r.lap_number = l.lap_number)")
def d23(fx):
    raw, legacy = fx.lap.where("event_id % 2 = 0"), fx.lap.where("event_id % 3 = 0")
    left = legacy.join(raw.select("participant_id", "lap_number"), ["participant_id", "lap_number"], "left_anti")
    return raw.select("participant_id", "lap_number", F.lit("raw").alias("source"), F.lit(True).alias("timing_eligible")).unionByName(left.select("participant_id", "lap_number", F.lit("legacy").alias("source"), (c("duration_ms") % 20 == 0).alias("timing_eligible")))


@query(
    "d24_sector_reconciliation",
    "a AS (SELECT participant_id, lap_number, sector_2_ms AS s FROM fx_lap WHERE event_id % 7 > 0 AND sector_2_ms IS NOT NULL), b AS (SELECT participant_id, lap_number, 28000 + (event_id * 53) % 9000 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS t FROM fx_lap WHERE event_id % 5 > 0) SELECT participant_id, lap_number, CASE WHEN s IS NULL THEN 'MISSING_SOURCE' WHEN t IS NULL THEN 'MISSING_TRACKER' WHEN s = t THEN 'EXACT' ELSE 'MISMATCH' END AS status FROM a FULL JOIN b USING (participant_id, lap_number)",
)
def d24(fx):
    n = c("event_id")
    a = fx.lap.where("event_id % 7 > 0 and sector_2_ms is not null").select("participant_id", "lap_number", c("sector_2_ms").alias("s"))
    b = fx.lap.where("event_id % 5 > 0").select("participant_id", "lap_number", (28_000 + (n * 53) % 9_000 + F.when(n % 11 == 0, 1).otherwise(0)).alias("t"))
    status = F.when(c("s").isNull(), "MISSING_SOURCE").when(c("t").isNull(), "MISSING_TRACKER").when(c("s") == c("t"), "EXACT").otherwise("MISMATCH")
    return a.join(b, ["participant_id", "lap_number"], "full").select("participant_id", "lap_number", status.alias("status"))


@query("e16_class_density", "SELECT heat_id, count(*) FILTER (WHERE ms <= 60000) AS within_60s, count(*) FILTER (WHERE ms <= 120000) AS within_120s, count(*) FILTER (WHERE ms <= 240000) AS within_240s FROM (SELECT heat_id, row_key % 500000 AS ms FROM fx_gaptext) GROUP BY 1")
def e16(fx):
    ms = c("row_key") % 500_000
    return fx.gaptext.groupBy("heat_id").agg(*[F.count_if(ms <= s * 1000).alias(f"within_{s}s") for s in (60, 120, 240)])


STINTS = """done AS (SELECT * FROM fx_pit WHERE completed AND exited_at_us >= entered_at_us), cars AS (SELECT participant_id, max(lap_number) AS max_lap FROM fx_lap GROUP BY 1),
after AS (SELECT participant_id, 1 + row_number() OVER w AS stint_number, exited_at_us AS started_at_us, lead(entered_at_us) OVER w AS ended_at_us, exited_lap AS started_lap, lead(entered_lap) OVER w AS ended_lap FROM done WINDOW w AS (PARTITION BY participant_id ORDER BY exited_at_us, entered_at_us)),
st AS (SELECT participant_id, 1 AS stint_number, NULL::BIGINT AS started_at_us, f.entered_at_us AS ended_at_us, NULL::BIGINT AS started_lap, f.entered_lap AS ended_lap FROM cars LEFT JOIN (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY exited_at_us, entered_at_us) = 1) f USING (participant_id) UNION ALL SELECT * FROM after),
stint AS (SELECT participant_id, CAST(stint_number AS BIGINT) AS stint_number, started_at_us, ended_at_us, started_lap, ended_lap, CASE WHEN started_lap IS NOT NULL THEN greatest(0, coalesce(ended_lap, max_lap) - started_lap)
  ELSE (SELECT count(*) FROM fx_lap l WHERE l.participant_id = st.participant_id AND l.completed_at_us > coalesce(st.started_at_us, -1) AND (st.ended_at_us IS NULL OR l.completed_at_us <= st.ended_at_us)) END AS completed_laps, stint_number = 1 AS is_partial, ended_at_us IS NULL AS is_current FROM st JOIN cars USING (participant_id))"""


@query("s15_tyre_stints", STINTS + " SELECT * FROM stint")
def s15(fx):
    return P.tyre_stints(fx.lap, fx.pit)


@query(
    "s13_pit_stops",
    """x AS (SELECT *, lag(state_kind) OVER w AS b, (SELECT min(o.observed_at_us) FROM fx_state o WHERE o.participant_id = s.participant_id AND o.observed_at_us > s.observed_at_us AND o.state_kind IN ('ON_TRACK', 'OUT_LAP')) AS exited_at_us FROM fx_state s WINDOW w AS (PARTITION BY participant_id ORDER BY observed_at_us, event_id))
SELECT participant_id, row_number() OVER (PARTITION BY participant_id ORDER BY observed_at_us, event_id) AS stop_number, observed_at_us AS entered_at_us, exited_at_us, exited_at_us IS NOT NULL AS completed FROM x WHERE state_kind = 'IN_PIT' AND b IS NOT NULL AND b <> 'IN_PIT'""",
)
def s13(fx):
    return P.pit_stops(fx.state)


@query("s14_completed_pits", "SELECT participant_id, stop_number, entered_at_us, exited_at_us FROM fx_pit WHERE completed")
def s14(fx):
    return P.completed_pits(fx.pit.union(fx.pit)).select("participant_id", "stop_number", "entered_at_us", "exited_at_us")


@query(
    "m_pit_obligations",
    """p AS (SELECT participant_id, count(*) FILTER (WHERE completed) AS n, participant_id % 7 + 2 AS r, CASE participant_id % 3 WHEN 0 THEN 14400 WHEN 1 THEN 43200 ELSE 7200 END AS d, 3600.0::DOUBLE AS e FROM fx_pit GROUP BY 1),
q AS (SELECT *, greatest(0, r - n) AS k, greatest(0.0::DOUBLE, d - e) AS t, d / (r + 1) AS f, d <> 7200 AS ok FROM p)
SELECT participant_id, CASE WHEN ok THEN k END AS remaining_pits, CASE WHEN ok THEN t END AS remaining_time_s, CASE WHEN ok THEN f END AS initial_equal_stint_target_s, CASE WHEN ok THEN t / (k + 1) END AS remaining_equal_stint_s,
  CASE WHEN ok AND k > 0 AND t > 0 THEN k / (t / 3600.0::DOUBLE) END AS stop_load_per_hour, CASE WHEN ok AND k > 0 THEN (n + 1) * f END AS next_equal_pit_target_elapsed_s,
  CASE WHEN ok AND k > 0 THEN greatest(0.0::DOUBLE, (n + 1) * f - e) END AS next_equal_pit_in_s, CASE WHEN ok AND k > 0 THEN e - (n + 1) * f END AS stint_schedule_deviation_s FROM q""",
)
def m_obligations(fx):
    d = F.when(c("participant_id") % 3 == 0, 14_400).when(c("participant_id") % 3 == 1, 43_200).otherwise(7_200)
    p = fx.pit.groupBy("participant_id").agg(F.count_if("completed").alias("n"))
    return p.select("participant_id", P.obligations(c("n"), d, c("participant_id") % 7 + 2, F.lit(3600.0)).alias("o")).select("participant_id", "o.*")


@query(
    "m_pit_lane_anomaly",
    """x AS (SELECT participant_id, list(pit_lane_ms ORDER BY exited_at_us) AS xs FROM fx_pit WHERE completed AND pit_lane_ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 4),
y AS (SELECT participant_id, xs[-1] AS last, list_median(xs[:-2]) AS m, xs[:-2] AS b FROM x), z AS (SELECT *, list_median(list_transform(b, lambda v: CAST(floor(abs(v - m)) AS DOUBLE))) AS mad FROM y)
SELECT participant_id, last AS pit_lane_ms, m AS median_ms, mad AS mad_ms, abs(last - m) - 3 * mad AS excess_ms FROM z WHERE abs(last - m) > 3 * mad""",
)
def m_anomaly(fx):
    return P.pit_lane_anomaly(fx.pit)


STINT_LAPS = STINTS + ",\n" + CLEAN + """, sl AS (SELECT c.*, s.stint_number, c.lap_number - coalesce(s.started_lap, 0) AS tyre_age FROM clean c JOIN stint s ON s.participant_id = c.participant_id AND c.completed_at_us > coalesce(s.started_at_us, -1) AND (s.ended_at_us IS NULL OR c.completed_at_us <= s.ended_at_us))"""


def stint_laps(fx):
    laps = clean_laps(fx).select("participant_id", "class_key", "lap_number", "duration_ms", "is_clean", "completed_at_us")
    starts = P.tyre_stints(fx.lap, fx.pit).select("participant_id", F.coalesce("started_at_us", F.lit(-1)).alias("completed_at_us"), "stint_number", F.coalesce("started_lap", F.lit(0)).alias("started_lap"), F.coalesce("ended_at_us", F.lit(1 << 62)).alias("ended"))
    found = W.as_of(laps, starts, ["participant_id"], "completed_at_us", ["stint_number", "started_lap", "ended"], inclusive=False, parts=fx.parts)
    return found.where("completed_at_us <= ended").withColumn("tyre_age", c("lap_number") - c("started_lap")).drop("ended", "started_lap")


@query("e11_stint_summary", STINT_LAPS + " SELECT participant_id, stint_number, count(*) AS laps, min(duration_ms) AS best_ms, median(CASE WHEN is_clean THEN duration_ms END) AS pace_ms, count(*) FILTER (WHERE is_clean) / count(*) AS clean_ratio FROM sl GROUP BY 1, 2")
def e11(fx):
    return stint_laps(fx).groupBy("participant_id", "stint_number").agg(F.count("*").alias("laps"), F.min("duration_ms").alias("best_ms"), F.percentile(F.when(c("is_clean"), c("duration_ms")), F.lit(0.5)).alias("pace_ms"), (F.count_if("is_clean") / F.count("*")).alias("clean_ratio"))


@query(
    "m_stint_pace_5",
    STINT_LAPS + " SELECT participant_id, stint_number, lap_number, CASE WHEN count(*) OVER w = 5 THEN median(duration_ms) OVER w END AS stint_pace_5_ms FROM sl WHERE is_clean WINDOW w AS (PARTITION BY participant_id, stint_number ORDER BY lap_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
)
def m_stint_pace(fx):
    return L.rolling_pace(stint_laps(fx), ["participant_id", "stint_number"]).select("participant_id", "stint_number", "lap_number", c("pace_5_ms").alias("stint_pace_5_ms"))


@query(
    "m_stint_trend",
    STINT_LAPS + """, l60 AS (SELECT participant_id, stint_number, tyre_age AS x, CAST(duration_ms AS DOUBLE) AS y, row_number() OVER (PARTITION BY participant_id, stint_number ORDER BY tyre_age DESC, duration_ms DESC) AS n FROM sl WHERE is_clean QUALIFY n <= 60),
slopes AS (SELECT a.participant_id, a.stint_number, median((b.y - a.y) / (b.x - a.x)) AS slope FROM l60 a JOIN l60 b ON a.participant_id = b.participant_id AND a.stint_number = b.stint_number AND a.n > b.n AND a.x <> b.x GROUP BY 1, 2)
SELECT participant_id, stint_number, CASE WHEN ages >= 6 THEN slope END AS trend_ms_per_lap, CASE WHEN ages >= 6 THEN slope * (hi - lo) END AS cumulative_ms FROM (SELECT participant_id, stint_number, count(DISTINCT x) AS ages, min(x) AS lo, max(x) AS hi FROM l60 GROUP BY 1, 2) LEFT JOIN slopes USING (participant_id, stint_number)""",
)
def m_stint_trend(fx):
    slope = L.theil_sen(stint_laps(fx).where("is_clean"), ["participant_id", "stint_number"], "tyre_age", "duration_ms")
    return slope.select("participant_id", "stint_number", c("slope").alias("trend_ms_per_lap"), (c("slope") * c("x_span")).alias("cumulative_ms"))


@query(
    "m_stint_delta_previous",
    STINT_LAPS + ", p AS (SELECT participant_id, stint_number, median(duration_ms) AS m FROM sl WHERE is_clean GROUP BY 1, 2) SELECT participant_id, stint_number, m - lag(m) OVER (PARTITION BY participant_id ORDER BY stint_number) AS delta_ms FROM p",
)
def m_stint_delta(fx):
    p = stint_laps(fx).where("is_clean").groupBy("participant_id", "stint_number").agg(F.percentile("duration_ms", F.lit(0.5)).alias("m"))
    return p.select("participant_id", "stint_number", (c("m") - F.lag("m").over(Window.partitionBy("participant_id").orderBy("stint_number"))).alias("delta_ms"))


@query(
    "m_pace_near_tyre_age",
    STINT_LAPS + """, f AS (SELECT participant_id AS fid, class_key, arg_max(tyre_age, lap_number) AS age FROM sl WHERE participant_id = (SELECT min(participant_id) FROM fx_lap) GROUP BY 1, 2),
n AS (SELECT s.participant_id, s.class_key, median(duration_ms) AS m, count(*) AS k FROM sl s JOIN f ON s.class_key = f.class_key AND abs(s.tyre_age - f.age) <= 2 WHERE is_clean GROUP BY 1, 2)
SELECT o.participant_id AS other_id, u.m - o.m AS delta_ms FROM f JOIN n u ON u.participant_id = f.fid JOIN n o ON o.class_key = f.class_key AND o.participant_id <> f.fid WHERE u.k >= 3 AND o.k >= 3""",
)
def m_near_age(fx):
    rows = stint_laps(fx)
    focal = fx.lap.agg(F.min("participant_id").alias("fid"))
    f = rows.join(F.broadcast(focal), c("participant_id") == c("fid")).groupBy("fid", "class_key").agg(F.max_by("tyre_age", "lap_number").alias("age"))  # one row
    n = rows.where("is_clean").join(F.broadcast(f), "class_key").where("abs(tyre_age - age) <= 2").groupBy("participant_id", "class_key", "fid").agg(F.percentile("duration_ms", F.lit(0.5)).alias("m"), F.count("*").alias("k")).where("k >= 3")
    ours = n.where("participant_id = fid").select("class_key", c("m").alias("own"))
    return n.where("participant_id <> fid").join(ours, "class_key").select(c("participant_id").alias("other_id"), (c("own") - c("m")).alias("delta_ms"))


@query(
    "m_competitor_stints",
    STINTS + " SELECT s.participant_id, s.stint_number, s.completed_laps AS tyre_age_laps, coalesce(p.n, 0) AS pits_completed, coalesce(p.n, 0) - coalesce((SELECT count(*) FROM done WHERE participant_id = (SELECT min(participant_id) FROM fx_lap)), 0) AS pit_offset FROM stint s LEFT JOIN (SELECT participant_id, count(*) AS n FROM done GROUP BY 1) p USING (participant_id) WHERE s.is_current",
)
def m_competitor(fx):
    done = P.completed_pits(fx.pit).groupBy("participant_id").agg(F.count("*").alias("n"))
    focal = fx.lap.agg(F.min("participant_id").alias("participant_id")).join(done, "participant_id", "left").select(F.coalesce("n", F.lit(0)).alias("ours"))
    now = P.tyre_stints(fx.lap, fx.pit).where("is_current").join(done, "participant_id", "left").crossJoin(F.broadcast(focal))  # one row
    n = F.coalesce("n", F.lit(0))
    return now.select("participant_id", "stint_number", c("completed_laps").alias("tyre_age_laps"), n.alias("pits_completed"), (n - c("ours")).alias("pit_offset"))
