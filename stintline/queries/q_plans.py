"""Read models, alerts, operations, catalogue and the batch twins of the streams (R, P, D16-D18, alerts, T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintline.functions import scalars as X
from stintline.operators import battle as B
from stintline.operators import facts as S
from stintline.operators import laps as L
from stintline.operators import pits as P
from stintline.plans import archive as A
from stintline.plans import health as H
from stintline.queries.q_battle import DAY, RUNS, STINTS, trend_sql
from stintline.queries.q_facts import _BOARD
from stintline.queries.q_laps import CLEAN, PACE, SLOW, clean_laps, pace
from stintline.queries.registry import query
from stintline.sources import feed

c = F.col
MIDDLE = "(SELECT min(completed_at_us) + 1296000000000 FROM fx_lap)"
END = "(SELECT max(completed_at_us) FROM fx_lap)"


def _objects(fx):
    return fx.object.select("doc_id", "object_key", "size", X.object_key_parts(c("object_key")).alias("k")).select("doc_id", "object_key", "size", "k.date", "k.slug", "k.code", "k.category", "k.filename")


_OBJ = "o AS (SELECT doc_id, object_key, size, string_split(object_key, '/')[1] AS category, string_split(object_key, '/')[2] AS date, string_split(object_key, '/')[3] AS slug, upper(regexp_extract(string_split(object_key, '/')[4], '^([A-Za-z]{2,4})[_\\-]', 1)) AS code FROM fx_object)"


@query(
    "d16_object_enrichment",
    _OBJ + """, an AS (SELECT object_key, date, code, concat('note ', doc_id) AS note FROM o WHERE doc_id % 9 = 0), cd AS (SELECT date, code, min(note) AS n FROM an WHERE code <> '' GROUP BY 1, 2), rel AS (SELECT date, slug, count(*) AS k FROM o WHERE category = 'telemetry' GROUP BY 1, 2)
SELECT v.object_key, coalesce(an.note, CASE WHEN v.code <> '' THEN cd.n END) AS note, v.doc_id % 8 = 0 AS has_thumb, coalesce(rel.k, 0) AS related_files FROM o v LEFT JOIN an ON an.object_key = v.object_key LEFT JOIN cd ON cd.date = v.date AND cd.code = v.code LEFT JOIN rel ON rel.date = v.date AND rel.slug = v.slug WHERE v.category IN ('stream_records', 'onboard_video')""",
)
def d16(fx):
    o = _objects(fx)
    notes = o.where("doc_id % 9 = 0").select("object_key", "date", "code", F.concat(F.lit("note "), c("doc_id").cast("string")).alias("note"))
    return H.enrich_objects(o.where(c("category").isin("stream_records", "onboard_video")), notes, o.where("doc_id % 8 = 0").select("doc_id"), o.where("category = 'telemetry'"))


_CAL = [("round 1", "2024-01-03", "2024-01-07", 1), ("round 2", "2024-01-06", "2024-01-12", 2), ("round 3", "2024-01-20", "2024-01-22", 3)]


@query("d17_calendar_event", _OBJ + " SELECT object_key, date, CASE WHEN date BETWEEN '2024-01-03' AND '2024-01-07' THEN 'round 1' WHEN date BETWEEN '2024-01-06' AND '2024-01-12' THEN 'round 2' WHEN date BETWEEN '2024-01-20' AND '2024-01-22' THEN 'round 3' END AS event FROM o")
def d17(fx):
    calendar = fx.spark.createDataFrame(_CAL, "event string, start_date string, end_date string, rank int")
    return H.calendar_event(_objects(fx).select("object_key", "date"), calendar)


@query("d18_video_heat", _OBJ + ", v AS (SELECT doc_id, date, size, code FROM o WHERE category = 'onboard_video'), h AS (SELECT doc_id AS heat, date, size, code FROM o WHERE category = 'telemetry') SELECT doc_id, heat FROM (SELECT v.doc_id, h.heat, row_number() OVER (PARTITION BY v.doc_id ORDER BY h.size DESC, h.heat) AS r FROM v JOIN h ON h.date = v.date AND h.code = v.code) WHERE r = 1")
def d18(fx):
    o = _objects(fx)
    v = o.where("category = 'onboard_video'").select("doc_id", "date", "code")
    h = o.where("category = 'telemetry'").select(c("doc_id").alias("heat"), "date", "code", c("size").alias("points"))
    return v.join(h, ["date", "code"]).groupBy("doc_id").agg(F.min_by("heat", F.struct((-c("points")).alias("p"), "heat")).alias("heat"))


@query("r1_snapshot", f"SELECT l.participant_id, l.class_key, l.laps, l.last_lap_ms, l.best_lap_ms, s.state_kind, coalesce(p.n, 0) AS pits FROM (SELECT participant_id, class_key, max(lap_number) AS laps, arg_max(duration_ms, completed_at_us) AS last_lap_ms, min(duration_ms) AS best_lap_ms FROM fx_lap WHERE completed_at_us <= {MIDDLE} GROUP BY 1, 2) l LEFT JOIN (SELECT participant_id, arg_max(state_kind, observed_at_us) AS state_kind FROM fx_state WHERE observed_at_us <= {MIDDLE} GROUP BY 1) s USING (participant_id) LEFT JOIN (SELECT participant_id, count(*) AS n FROM fx_pit WHERE completed AND exited_at_us <= {MIDDLE} GROUP BY 1) p USING (participant_id)")
def r1(fx):
    return A.snapshot(fx.lap, fx.state, fx.pit, _middle(fx))


def _middle(fx):
    return fx.lap.agg(F.min("completed_at_us") + 1_296_000_000_000).first()[0]


@query("r2_current_metrics", PACE + " SELECT participant_id, arg_max(pace_5_ms, lap_number) AS pace_5_ms, max(lap_number) AS lap_number FROM pace WHERE pace_5_ms IS NOT NULL GROUP BY 1")
def r2(fx):
    return A.current(pace(fx).where("pace_5_ms is not null"), ["participant_id"], ["lap_number"], ["pace_5_ms", "lap_number"])


@query(
    "r3_metric_history",
    f"w AS (SELECT * FROM fx_lap WHERE completed_at_us >= {MIDDLE} AND completed_at_us < {MIDDLE} + 432000000000), x AS (SELECT *, count(*) OVER (PARTITION BY participant_id) AS n, row_number() OVER v AS i, ntile(4) OVER v AS b FROM w WINDOW v AS (PARTITION BY participant_id ORDER BY completed_at_us)), y AS (SELECT *, row_number() OVER (PARTITION BY participant_id, b ORDER BY completed_at_us) AS r FROM x) SELECT participant_id, completed_at_us AS at_us, duration_ms FROM y WHERE n <= 5 OR r = 1 OR i = n",
)
def r3(fx):
    at = _middle(fx)
    rows = fx.lap.where(c("completed_at_us").between(at, at + 432_000_000_000 - 1))
    return S.bucket_downsample(rows, ["participant_id"], "completed_at_us", 5).select("participant_id", c("completed_at_us").alias("at_us"), "duration_ms")


@query("r4_dashboard_flags", f"SELECT heat_id, flag, greatest(started_at_us, {MIDDLE}) AS started_at_us, least(coalesce(ended_at_us, {END}), {END}) AS ended_at_us, started_at_us < {MIDDLE} AS carried_into_range FROM fx_flag WHERE started_at_us < {END} AND (ended_at_us IS NULL OR ended_at_us > {MIDDLE})")
def r4(fx):
    high = fx.lap.agg(F.max("completed_at_us")).first()[0]
    return S.clip(fx.flag.select("heat_id", "flag", "started_at_us", "ended_at_us"), "started_at_us", "ended_at_us", F.lit(_middle(fx)), F.lit(high))


@query("r5_laps", CLEAN + " SELECT participant_id, lap_number, duration_ms, is_clean, CASE WHEN non_green THEN 'NEUTRAL' WHEN green_us > 0 THEN 'GREEN' END AS flag, sector_1_ms + coalesce(sector_2_ms, 0) AS first_two_ms FROM clean")
def r5(fx):
    flag = F.when(c("non_green"), "NEUTRAL").when(c("green_us") > 0, "GREEN")
    return clean_laps(fx).select("participant_id", "lap_number", "duration_ms", "is_clean", flag.alias("flag"), (c("sector_1_ms") + F.coalesce("sector_2_ms", F.lit(0))).alias("first_two_ms"))


@query("r6_pit_stops", "SELECT participant_id, stop_number, pit_lane_ms, CASE WHEN pit_lane_ms IS NOT NULL THEN 'measured' ELSE 'observed' END AS provenance FROM fx_pit WHERE completed")
def r6(fx):
    return fx.pit.where("completed").select("participant_id", "stop_number", "pit_lane_ms", F.when(c("pit_lane_ms").isNotNull(), "measured").otherwise("observed").alias("provenance"))


@query("r7_race_control", _BOARD + " SELECT heat_id, message_id, text, last_ordinal FROM led QUALIFY row_number() OVER (PARTITION BY heat_id ORDER BY last_ordinal DESC, message_id) <= 5")
def r7(fx):
    w = Window.partitionBy("heat_id").orderBy(F.desc("last_ordinal"), "message_id")
    return S.board(fx.board)[0].withColumn("n", F.row_number().over(w)).where("n <= 5").select("heat_id", "message_id", "text", "last_ordinal")


@query("r8_archived_sessions", "SELECT conn_id, min(received_at_us) AS first_us, max(received_at_us) AS last_us, (max(received_at_us) - min(received_at_us)) // 1000000 AS duration_s, count(*) AS points FROM fx_frame WHERE conn_id % 5 <> 0 GROUP BY 1")
def r8(fx):
    rows = fx.frame.where("conn_id % 5 <> 0").groupBy("conn_id").agg(F.min("received_at_us").alias("first_us"), F.max("received_at_us").alias("last_us"), F.count("*").alias("points"))
    return rows.select("conn_id", "first_us", "last_us", X.div(c("last_us") - c("first_us"), 1_000_000).alias("duration_s"), "points")


@query(
    "r9_archive_window",
    """k AS (SELECT conn_id, received_at_us AS at_us FROM fx_frame WHERE frame_id % 3 = 0), f AS (SELECT conn_id, max(received_at_us) - 3600000000 AS finish_us FROM fx_frame WHERE conn_id % 2 = 0 GROUP BY 1),
e AS (SELECT conn_id, min(at_us) AS s, max(at_us) AS l, min(CASE WHEN at_us BETWEEN finish_us AND finish_us + 60000000 THEN at_us END) AS a, max(CASE WHEN at_us < finish_us THEN at_us END) AS b, max(finish_us) AS f, count(*) AS n FROM k LEFT JOIN f USING (conn_id) GROUP BY 1),
g AS (SELECT *, CASE WHEN f IS NULL THEN l ELSE coalesce(a, b, l) END AS t FROM e) SELECT conn_id, s AS start_us, t AS end_us, CASE WHEN n = 1 THEN 'terminal_snapshot' WHEN f IS NULL THEN 'partial_capture' ELSE 'replay' END AS kind, l > t AS tail_omitted FROM g""",
)
def r9(fx):
    finish = fx.frame.where("conn_id % 2 = 0").groupBy("conn_id").agg((F.max("received_at_us") - 3_600_000_000).alias("finish_us"))
    return A.archive_window(fx.frame.where("frame_id % 3 = 0").select("conn_id", c("received_at_us").alias("at_us")), finish)


@query("r10_archive_markers", "SELECT 'flag' AS marker, flag AS label, started_at_us AS at_us FROM fx_flag UNION ALL SELECT 'pit', concat('car ', participant_id), entered_at_us FROM fx_pit UNION ALL SELECT 'gap', reason, started_at_us FROM fx_feedgap")
def r10(fx):
    a = fx.flag.select(F.lit("flag").alias("marker"), c("flag").alias("label"), c("started_at_us").alias("at_us"))
    b = fx.pit.select(F.lit("pit").alias("marker"), F.concat(F.lit("car "), c("participant_id").cast("string")).alias("label"), c("entered_at_us").alias("at_us"))
    return a.unionByName(b).unionByName(fx.feedgap.select(F.lit("gap").alias("marker"), c("reason").alias("label"), c("started_at_us").alias("at_us")))


@query("r11_archive_snapshot", f"SELECT participant_id, max(completed_at_us) AS keyframe_us, (SELECT min(completed_at_us) FROM fx_lap n WHERE n.participant_id = l.participant_id AND n.completed_at_us > {MIDDLE}) AS next_us FROM fx_lap l WHERE completed_at_us <= {MIDDLE} GROUP BY 1")
def r11(fx):
    at = _middle(fx)
    return fx.lap.groupBy("participant_id").agg(F.max(F.when(c("completed_at_us") <= at, c("completed_at_us"))).alias("keyframe_us"), F.min(F.when(c("completed_at_us") > at, c("completed_at_us"))).alias("next_us")).where("keyframe_us is not null")


@query(
    "r12_archive_comparison",
    CLEAN + """, b AS (SELECT completed_at_us // 86400000000 AS bucket, participant_id, arg_max(duration_ms, completed_at_us) AS ms FROM clean WHERE is_clean GROUP BY 1, 2)
SELECT bucket, max(CASE WHEN participant_id = m THEN ms END) AS ours_ms, median(CASE WHEN participant_id <> m THEN ms END) AS class_ms FROM b, (SELECT min(participant_id) AS m FROM fx_lap) GROUP BY 1""",
)
def r12(fx):
    rows = clean_laps(fx).where("is_clean").withColumn("bucket", X.div(c("completed_at_us"), 86_400_000_000))
    one = rows.groupBy("bucket", "participant_id").agg(F.max_by("duration_ms", "completed_at_us").alias("ms")).crossJoin(F.broadcast(fx.lap.agg(F.min("participant_id").alias("m"))))  # one row
    return one.groupBy("bucket").agg(F.max(F.when(c("participant_id") == c("m"), c("ms"))).alias("ours_ms"), F.percentile(F.when(c("participant_id") != c("m"), c("ms")), F.lit(0.5)).alias("class_ms"))


@query(
    "r13_stint_timeline",
    STINTS + f""", a AS (SELECT participant_id, 'stint' AS kind, coalesce(started_at_us, {MIDDLE}) AS s, coalesce(ended_at_us, {END}) AS e FROM stint UNION ALL SELECT participant_id, 'pit', entered_at_us, coalesce(exited_at_us, {END}) FROM fx_pit),
b AS (SELECT participant_id, kind, greatest(s, {MIDDLE}) AS s, least(e, {END}) AS e FROM a WHERE s < {END} AND e > {MIDDLE}) SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY s, e, kind) AS segment FROM b""",
)
def r13(fx):
    high = fx.lap.agg(F.max("completed_at_us")).first()[0]
    return A.timeline(P.tyre_stints(fx.lap, fx.pit), fx.pit, F.lit(_middle(fx)), F.lit(high))


@query("r14_ingest_health", "SELECT conn_id, count(*) AS frames, count(*) FILTER (WHERE raw = 'not-json') AS failed, max(received_at_us) AS latest_us, min(received_at_us) AS floor_us, conn_id % 4 = 0 AS open_gap FROM fx_frame GROUP BY 1")
def r14(fx):
    gap = fx.frame.where("conn_id % 4 = 0").select("conn_id", F.lit(None).cast("long").alias("ended_at_us"))
    return A.ingest_health(feed.quarantine(fx.frame), gap)


@query("r15_catalogue", _OBJ + " SELECT object_key, category, date, row_number() OVER (PARTITION BY category ORDER BY date DESC, object_key) AS place, count(*) OVER (PARTITION BY category) AS total FROM o WHERE slug <> '' QUALIFY place <= 20")
def r15(fx):
    w = Window.partitionBy("category").orderBy(F.desc("date"), "object_key")
    rows = _objects(fx).where("slug <> ''").withColumn("place", F.row_number().over(w).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("category")))
    return rows.where("place <= 20").select("object_key", "category", "date", "place", "total")


@query("r16_keyframe_payload")
def r16(fx):
    at = _middle(fx)
    return A.keyframe_payload(A.snapshot(fx.lap, fx.state, fx.pit, at).withColumn("at_us", F.lit(at)))


_ALERTS = """al AS (SELECT conn_id AS scope_key, 'FRAME_DECODE_FAILURE' AS code, 'CRITICAL' AS severity, count(*) AS fact FROM fx_frame WHERE raw = 'not-json' GROUP BY 1
UNION ALL SELECT conn_id, 'RECONNECT_STORM', CASE WHEN conn_id % 12 >= 10 THEN 'CRITICAL' ELSE 'WARNING' END, conn_id % 12 FROM (SELECT DISTINCT conn_id FROM fx_frame) WHERE conn_id % 12 >= 4
UNION ALL SELECT conn_id, 'UNKNOWN_SOURCE_HANDLE', 'WARNING', count(*) FROM fx_frame WHERE handle = 't_q' GROUP BY 1)"""


def _health(fx):
    known = fx.spark.createDataFrame([(h,) for h in ("r_c", "t_p", "h_h", "s_t")], "handle string")
    storms = fx.frame.select("conn_id").distinct().select(c("conn_id").alias("scope_key"), (c("conn_id") % 12).alias("reconnects"))
    return H.health_alerts(feed.quarantine(fx.frame), storms, known)


@query("p1_health_alerts", _ALERTS + " SELECT * FROM al")
def p1(fx):
    return _health(fx)


@query("p2_health_summary", _ALERTS + " SELECT scope_key, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'DEGRADED' END AS status, count(*) AS alerts FROM al GROUP BY 1")
def p2(fx):
    return H.health_summary(_health(fx))


@query(
    "p3_incidents",
    _ALERTS + """, op AS (SELECT scope_key, code, CASE WHEN scope_key % 3 = 0 THEN 'WARNING' ELSE 'CRITICAL' END AS severity, 2 AS occurrences FROM al WHERE scope_key % 2 = 0 UNION ALL SELECT scope_key, 'INGEST_RUN_FAILED', 'CRITICAL', 1 FROM al GROUP BY 1),
r AS (SELECT coalesce(a.code, o.code) AS code, coalesce(a.scope_key, o.scope_key) AS scope_key, CASE a.severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 END AS n, CASE o.severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 END AS w, o.occurrences AS k FROM al a FULL JOIN op o ON a.code = o.code AND a.scope_key = o.scope_key)
SELECT code, scope_key, CASE WHEN w IS NULL THEN 'OPENED' WHEN n IS NULL THEN 'RESOLVED' WHEN n > w THEN 'ESCALATED' WHEN n < w THEN 'DEESCALATED' ELSE 'UNCHANGED' END AS transition, CAST(coalesce(k, 0) + CASE WHEN n IS NULL THEN 0 ELSE 1 END AS BIGINT) AS occurrences FROM r""",
)
def p3(fx):
    alerts = _health(fx)
    was = alerts.where("scope_key % 2 = 0").select("scope_key", "code", F.when(c("scope_key") % 3 == 0, "WARNING").otherwise("CRITICAL").alias("severity"), F.lit(2).alias("occurrences"))
    was = was.unionByName(alerts.select("scope_key").distinct().select("scope_key", F.lit("INGEST_RUN_FAILED").alias("code"), F.lit("CRITICAL").alias("severity"), F.lit(1).alias("occurrences")))
    return H.reconcile_incidents(was, alerts)


_SESSION = "se AS (SELECT conn_id, CASE WHEN conn_id % 3 > 0 THEN 'stopped' ELSE 'running' END AS lifecycle, CASE WHEN conn_id % 5 > 0 THEN max(received_at_us) END AS last_keyframe_us FROM fx_frame GROUP BY 1)"


def _sessions(fx):
    return fx.frame.groupBy("conn_id").agg(F.max("received_at_us").alias("m")).select("conn_id", F.when(c("conn_id") % 3 > 0, "stopped").otherwise("running").alias("lifecycle"), F.when(c("conn_id") % 5 > 0, c("m")).alias("last_keyframe_us"))


@query("p4_retention_plan", _SESSION + f" SELECT f.conn_id, f.frame_id FROM fx_frame f JOIN se USING (conn_id) WHERE lifecycle = 'stopped' AND last_keyframe_us IS NOT NULL AND received_at_us < {END} - 604800000000")
def p4(fx):
    now = fx.lap.agg(F.max("completed_at_us")).first()[0]
    return H.retention_plan(fx.frame, _sessions(fx), now)


@query("p5_rebuild_plan", _SESSION + " SELECT conn_id, concat_ws(',', CASE WHEN lifecycle <> 'stopped' THEN 'NOT_STOPPED' END, CASE WHEN n > 0 THEN 'FAILED_FRAMES' END) AS blocked_by, lifecycle = 'stopped' AND n = 0 AS ready FROM se JOIN (SELECT conn_id, count(*) FILTER (WHERE raw = 'not-json') AS n FROM fx_frame GROUP BY 1) USING (conn_id)")
def p5(fx):
    return H.rebuild_plan(_sessions(fx), feed.quarantine(fx.frame))


@query("p8_index_catalogue", _OBJ + ", l AS (SELECT object_key, concat('t', doc_id) AS title, size FROM o WHERE doc_id % 4 <> 3), k AS (SELECT object_key, concat('old', doc_id) AS old_title, 1 AS old_size, doc_id % 6 = 0 AS edited FROM o WHERE doc_id % 3 = 0) SELECT coalesce(l.object_key, k.object_key) AS object_key, CASE WHEN k.edited THEN k.old_title ELSE coalesce(l.title, k.old_title) END AS title, coalesce(l.size, k.old_size) AS size, coalesce(k.edited, false) AS edited FROM l FULL JOIN k ON l.object_key = k.object_key")
def p8(fx):
    o = _objects(fx)
    listing = o.where("doc_id % 4 <> 3").select("object_key", F.concat(F.lit("t"), c("doc_id").cast("string")).alias("title"), "size")
    old = o.where("doc_id % 3 = 0").select("object_key", F.concat(F.lit("old"), c("doc_id").cast("string")).alias("old_title"), F.lit(1).cast("long").alias("old_size"), (c("doc_id") % 6 == 0).alias("edited"))
    return H.index_catalogue(listing, old)


@query(
    "p9_group_recordings",
    f"""x AS (SELECT participant_id AS source, completed_at_us AS start_us, completed_at_us + duration_ms * 1000 AS end_us, duration_ms * 5 AS size, event_id % 97 = 0 AS busy FROM fx_lap),
y AS (SELECT *, max(end_us) OVER (PARTITION BY source ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x), z AS (SELECT *, CAST(sum(CASE WHEN start_us - b > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM y)
SELECT source, island, count(*) AS parts, min(start_us) AS first_us, max(end_us) AS last_us, count(*) FILTER (WHERE size < 524288) AS tiny_parts, max(end_us) < {END} - 43200000000 AND NOT bool_or(busy) AS ready FROM z GROUP BY 1, 2""",
)
def p9(fx):
    part = fx.lap.select(c("participant_id").alias("source"), c("completed_at_us").alias("start_us"), (c("completed_at_us") + c("duration_ms") * 1000).alias("end_us"), (c("duration_ms") * 5).alias("size"), (c("event_id") % 97 == 0).alias("busy"))
    now = fx.lap.agg(F.max("completed_at_us")).first()[0]
    return H.group_recordings(part, S.groups_by_idle(part, ["source"], "start_us", "end_us", 43_200_000_000), now, 43_200_000_000)


@query("p10_broken_recordings", "x AS (SELECT participant_id, completed_at_us - lag(completed_at_us) OVER (PARTITION BY participant_id ORDER BY completed_at_us) AS step FROM fx_lap) SELECT participant_id, count(*) FILTER (WHERE step > 172800000000) AS breaks FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE step > 172800000000) > 0")
def p10(fx):
    step = c("completed_at_us") - F.lag("completed_at_us").over(Window.partitionBy("participant_id").orderBy("completed_at_us"))
    return fx.lap.select("participant_id", step.alias("step")).groupBy("participant_id").agg(F.count_if(c("step") > 172_800_000_000).alias("breaks")).where("breaks > 0")


@query("p11_annotate", _OBJ + " SELECT object_key, concat_ws(' · ', CASE WHEN date BETWEEN '2024-01-03' AND '2024-01-07' THEN 'round 1' WHEN date BETWEEN '2024-01-06' AND '2024-01-12' THEN 'round 2' WHEN date BETWEEN '2024-01-20' AND '2024-01-22' THEN 'round 3' END, date) AS title FROM o")
def p11(fx):
    return d17(fx).select("object_key", X.title(c("event"), c("date")).alias("title"))


@query("p12_invariants", "SELECT 'laps_unique' AS invariant, count(*) - count(DISTINCT participant_id * 1000000 + lap_number) AS violations FROM fx_lap UNION ALL SELECT 'exit_after_entry', count(*) FILTER (WHERE exited_at_us < entered_at_us) FROM fx_pit UNION ALL SELECT 'start_before_end', count(*) FILTER (WHERE started_at_us >= completed_at_us) FROM fx_lap")
def p12(fx):
    a = fx.lap.agg((F.count("*") - F.count_distinct("participant_id", "lap_number")).alias("violations")).select(F.lit("laps_unique").alias("invariant"), "violations")
    b = fx.pit.agg(F.count_if(c("exited_at_us") < c("entered_at_us")).alias("violations"))
    d = fx.lap.agg(F.count_if(c("started_at_us") >= c("completed_at_us")).alias("violations"))
    return a.unionByName(b.select(F.lit("exit_after_entry").alias("invariant"), "violations")).unionByName(d.select(F.lit("start_before_end").alias("invariant"), "violations"))


@query(
    "al_alerts",
    SLOW + """, best AS (SELECT participant_id, completed_at_us, best, lag(best) OVER (PARTITION BY participant_id ORDER BY lap_number) AS b FROM (SELECT *, min(duration_ms) OVER (PARTITION BY participant_id ORDER BY lap_number) AS best FROM fx_lap)),
st AS (SELECT *, lag(state_kind) OVER (PARTITION BY participant_id ORDER BY lap_number) AS b FROM fx_state), fl AS (SELECT *, lag(flag) OVER (PARTITION BY heat_id ORDER BY started_at_us) AS b FROM fx_flag),
md AS (SELECT class_key, list(pit_lane_ms) AS l FROM fx_pit WHERE pit_lane_ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), mx AS (SELECT class_key, list_median(l) + 3 * list_median(list_transform(l, lambda v: CAST(floor(abs(v - list_median(l))) AS DOUBLE))) AS lim FROM md)
SELECT 'new_best_lap' AS key, 'information' AS severity, participant_id AS scope_key, completed_at_us AS at_us, CAST(b - best AS DOUBLE) AS numeric_consequence FROM best WHERE b IS NOT NULL AND best <> b
UNION ALL SELECT 'competitor_pit_transition', 'action', participant_id, observed_at_us, NULL FROM st WHERE b IS NOT NULL AND state_kind <> b AND state_kind IN ('IN_PIT', 'OUT_LAP')
UNION ALL SELECT 'flag_changed', 'action', heat_id, started_at_us, NULL FROM fl WHERE b IS NOT NULL AND flag <> b
UNION ALL SELECT 'stint_pace_deteriorated', 'action', s.participant_id, c.completed_at_us, s.duration_ms - s.threshold_ms FROM slow s JOIN fx_lap c ON c.participant_id = s.participant_id AND c.lap_number = s.lap_number
UNION ALL SELECT 'pit_completed_new_stint', 'information', participant_id, exited_at_us, CAST(pit_lane_ms AS DOUBLE) FROM fx_pit WHERE completed
UNION ALL SELECT 'ours_pit_too_long', 'critical', p.participant_id, p.exited_at_us, p.pit_lane_ms - lim FROM fx_pit p JOIN mx USING (class_key) WHERE p.pit_lane_ms > lim""",
)
def al_alerts(fx):
    w = Window.partitionBy("participant_id").orderBy("lap_number")
    none = F.lit(None)
    best = fx.lap.withColumn("best", F.min("duration_ms").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.lag("best").over(w))
    state = fx.state.withColumn("b", F.lag("state_kind").over(w))
    flag = S.change_segments(fx.flag, ["heat_id"], ["started_at_us"], c("flag"), "started_at_us").where("segment > 1")
    slow = L.slow_laps(clean_laps(fx))
    half = F.lit(0.5)
    middle = fx.pit.where("pit_lane_ms is not null").groupBy("class_key").agg(F.percentile("pit_lane_ms", half).alias("middle"), F.count("*").alias("n")).where("n >= 3")
    limit = fx.pit.where("pit_lane_ms is not null").join(middle, "class_key").groupBy("class_key", "middle").agg((c("middle") + 3 * F.percentile(F.floor(F.abs(c("pit_lane_ms") - c("middle"))), half)).alias("lim")).select("class_key", "lim")
    parts = [
        A.alert(best, "new_best_lap", "information", c("b").isNotNull() & (c("best") != c("b")), "completed_at_us", c("b") - c("best")),
        A.alert(state, "competitor_pit_transition", "action", c("b").isNotNull() & (c("state_kind") != c("b")) & c("state_kind").isin("IN_PIT", "OUT_LAP"), "observed_at_us", none),
        A.alert(flag, "flag_changed", "action", F.lit(True), "started_at_us", none, "heat_id"),
        A.alert(slow, "stint_pace_deteriorated", "action", F.lit(True), "completed_at_us", c("duration_ms") - c("threshold_ms")),
        A.alert(fx.pit, "pit_completed_new_stint", "information", c("completed"), "exited_at_us", c("pit_lane_ms")),
        A.alert(fx.pit.join(limit, "class_key"), "ours_pit_too_long", "critical", c("pit_lane_ms") > c("lim"), "exited_at_us", c("pit_lane_ms") - c("lim")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "al_race_alerts",
    RUNS + ",\n" + ",\n".join(trend_sql(f"t{d}", d * DAY) for d in (1, 2, 7)) + """,
u AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t7),
v AS (SELECT *, CASE WHEN direction = 'CLOSING' AND closure_ms_per_lap > 0 THEN closure_ms_per_lap WHEN direction = 'BEING_CAUGHT' AND closure_ms_per_lap < 0 THEN -closure_ms_per_lap END AS rate FROM u),
cr AS (SELECT focal_id, observed_at_us, gap_ms / max(rate) AS min_laps FROM v GROUP BY focal_id, relation, observed_at_us, seq, gap_ms HAVING count(rate) >= 2),
p AS (SELECT participant_id, min(class_key) AS class_key, max(entered_at_us) AS at_us, count(*) FILTER (WHERE completed) AS n, participant_id % 60 + 2 AS r, CASE participant_id % 3 WHEN 0 THEN 14400 WHEN 1 THEN 43200 ELSE 7200 END AS d FROM fx_pit GROUP BY 1),
q AS (SELECT *, r - n AS k, d - participant_id % 11 * 10.0::DOUBLE AS e, (participant_id % 11) * 10.0::DOUBLE AS t FROM p WHERE d <> 7200 AND r BETWEEN 2 AND 8),
md AS (SELECT class_key, median(pit_lane_ms) AS m FROM fx_pit WHERE completed AND pit_lane_ms IS NOT NULL GROUP BY 1)
SELECT 'catch_or_threat_crossing' AS key, 'action' AS severity, focal_id AS scope_key, observed_at_us AS at_us, min_laps AS numeric_consequence FROM cr WHERE min_laps <= 5
UNION ALL SELECT 'even_schedule_deviation', 'action', participant_id, at_us, e - (n + 1) * (d / (r + 1)) FROM q WHERE k > 0 AND abs(e - (n + 1) * (d / (r + 1))) >= 900
UNION ALL SELECT 'mandatory_pits_infeasible', 'critical', participant_id, at_us, k * m / 1000.0::DOUBLE - t FROM q JOIN md USING (class_key) WHERE k > 0 AND t < k * m / 1000.0::DOUBLE""",
)
def al_race_alerts(fx):
    d = F.when(c("participant_id") % 3 == 0, 14_400).when(c("participant_id") % 3 == 1, 43_200).otherwise(7_200)
    stops = fx.pit.groupBy("participant_id").agg(F.min("class_key").alias("class_key"), F.max("entered_at_us").alias("at_us"), F.count_if("completed").alias("n"))
    plan = stops.withColumn("o", P.obligations(c("n"), d, c("participant_id") % 60 + 2, d - c("participant_id") % 11 * 10.0)).select("participant_id", "class_key", "at_us", "o.*")
    middle = fx.pit.where("completed and pit_lane_ms is not null").groupBy("class_key").agg(F.percentile("pit_lane_ms", F.lit(0.5)).alias("m"))
    needed_s = c("remaining_pits") * c("m") / 1000.0
    off = c("stint_schedule_deviation_s")
    catch = B.catch_windows(fx.gap_sample, (DAY, 2 * DAY, 7 * DAY), F.lit(100_000.0))
    parts = [
        A.alert(catch, "catch_or_threat_crossing", "action", c("min_laps") <= 5, "observed_at_us", c("min_laps"), "focal_id"),
        A.alert(plan, "even_schedule_deviation", "action", F.abs(off) >= 900, "at_us", off),
        A.alert(plan.join(middle, "class_key"), "mandatory_pits_infeasible", "critical", (c("remaining_pits") > 0) & (c("remaining_time_s") < needed_s), "at_us", needed_s - c("remaining_time_s")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "m_tactical_scoreboard",
    PACE + """, m AS (SELECT participant_id, max(lap_number) AS laps, arg_max(duration_ms, lap_number) AS last_lap_ms, min(duration_ms) AS best_lap_ms FROM fx_lap GROUP BY 1)
SELECT l.participant_id, l.class_key, m.laps AS completed_laps, m.last_lap_ms, m.best_lap_ms, CASE WHEN m.last_lap_ms >= m.best_lap_ms THEN m.last_lap_ms - m.best_lap_ms END AS last_to_best_delta_ms, m.best_lap_ms - min(m.best_lap_ms) OVER (PARTITION BY l.class_key) AS delta_to_class_best_ms,
  l.pace_5_ms - median(l.pace_5_ms) OVER (PARTITION BY l.class_key) AS pace_delta_to_class_ms, l.consistency_10_ms, l.p10_p90_ms FROM latest l JOIN m USING (participant_id)""",
)
def m_scoreboard(fx):
    m = fx.lap.groupBy("participant_id").agg(F.max("lap_number").alias("completed_laps"), F.max_by("duration_ms", "lap_number").alias("last_lap_ms"), F.min("duration_ms").alias("best_lap_ms"))
    rows = L.latest_pace(pace(fx)).join(m, "participant_id")
    classes = rows.groupBy("class_key").agg(F.min("best_lap_ms").alias("cb"), F.percentile("pace_5_ms", F.lit(0.5)).alias("cp"))
    delta = c("last_lap_ms") - c("best_lap_ms")
    return rows.join(classes, "class_key").select("participant_id", "class_key", "completed_laps", "last_lap_ms", "best_lap_ms", F.when(delta >= 0, delta).alias("last_to_best_delta_ms"), (c("best_lap_ms") - c("cb")).alias("delta_to_class_best_ms"), (c("pace_5_ms") - c("cp")).alias("pace_delta_to_class_ms"), "consistency_10_ms", "p10_p90_ms")


@query(
    "m_sector_losses",
    """long AS (SELECT participant_id, class_key, 'sector_1' AS sector, sector_1_ms AS ms FROM fx_lap UNION ALL SELECT participant_id, class_key, 'sector_2', sector_2_ms FROM fx_lap UNION ALL SELECT participant_id, class_key, 'sector_3', sector_3_ms FROM fx_lap),
own AS (SELECT participant_id, class_key, sector, min(ms) AS best_ms FROM long WHERE ms > 0 GROUP BY 1, 2, 3), d AS (SELECT *, best_ms - min(best_ms) OVER (PARTITION BY class_key, sector) AS loss FROM own)
SELECT participant_id, arg_min(sector, {'a': -loss, 'b': sector}) AS largest_sector_loss, max(loss) AS loss_ms FROM d WHERE loss > 0 GROUP BY 1""",
)
def m_sectors(fx):
    rows = L.sector_bests(fx.lap)[0].withColumn("loss", c("best_ms") - c("class_best_ms")).where("loss > 0")
    return rows.groupBy("participant_id").agg(F.min_by("sector", F.struct((-c("loss")).alias("a"), "sector")).alias("largest_sector_loss"), F.max("loss").alias("loss_ms"))


@query("m_flag_phase", "SELECT participant_id, lap_number, greatest(0, completed_at_us - started_at_us) / 1000000.0::DOUBLE AS elapsed_s, (SELECT (l.completed_at_us - max(f.started_at_us)) / 1000000.0::DOUBLE FROM fx_flag f WHERE f.heat_id = l.heat_id AND f.started_at_us <= l.completed_at_us) AS phase_s FROM fx_lap l WHERE started_at_us IS NOT NULL AND completed_at_us >= (SELECT min(f.started_at_us) FROM fx_flag f WHERE f.heat_id = l.heat_id)")
def m_flag_phase(fx):
    from stintline.operators.windows import as_of

    lap = fx.lap.where("started_at_us is not null").select("heat_id", "participant_id", "lap_number", "started_at_us", "completed_at_us")
    since = lap.select("heat_id", "participant_id").distinct().join(fx.flag.select("heat_id", c("started_at_us").alias("since_us")), "heat_id").withColumn("completed_at_us", c("since_us"))
    hit = as_of(lap, since, ["heat_id", "participant_id"], "completed_at_us", ["since_us"]).where("since_us is not null")
    return hit.select("participant_id", "lap_number", (F.greatest(F.lit(0), c("completed_at_us") - c("started_at_us")) / 1_000_000.0).alias("elapsed_s"), ((c("completed_at_us") - c("since_us")) / 1_000_000.0).alias("phase_s"))


@query("m_position_change", "SELECT heat_id, row_key, lag(position) OVER w - position AS position_change FROM (SELECT heat_id, row_key % 50 AS row_key, position, row_key AS k FROM fx_gaptext) WINDOW w AS (PARTITION BY heat_id, row_key ORDER BY k)")
def m_position(fx):
    w = Window.partitionBy("heat_id", "car").orderBy("row_key")
    return fx.gaptext.withColumn("car", c("row_key") % 50).select("heat_id", c("car").alias("row_key"), (F.lag("position").over(w) - c("position")).alias("position_change"))


@query("m_pit_cycle_loss", "SELECT class_key, count(*) AS stops, median(pit_lane_ms) AS loss_ms FROM fx_pit WHERE completed AND pit_lane_ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def m_cycle(fx):
    return fx.pit.where("completed and pit_lane_ms is not null").groupBy("class_key").agg(F.count("*").alias("stops"), F.percentile("pit_lane_ms", F.lit(0.5)).alias("loss_ms")).where("stops >= 3")


@query("t3_one_second_tick", "SELECT conn_id, received_at_us // 1000000 AS tick, arg_max(handle, {'a': received_at_us, 'b': frame_id}) AS handle, count(*) AS frames FROM fx_frame GROUP BY 1, 2")
def t3(fx):
    return fx.frame.groupBy("conn_id", X.div(c("received_at_us"), 1_000_000).alias("tick")).agg(F.max_by("handle", F.struct("received_at_us", "frame_id")).alias("handle"), F.count("*").alias("frames"))


@query("t6_session_windows", "x AS (SELECT *, lag(received_at_us) OVER (PARTITION BY handle ORDER BY received_at_us) AS b FROM fx_frame), y AS (SELECT *, sum(CASE WHEN received_at_us - b >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY handle ORDER BY received_at_us ROWS UNBOUNDED PRECEDING) AS i FROM x) SELECT handle, min(received_at_us) AS first_us, max(received_at_us) AS last_us, count(*) AS frames FROM y GROUP BY handle, i")
def t6(fx):
    rows = fx.frame.select("handle", "received_at_us", F.timestamp_micros("received_at_us").alias("ts"))
    return rows.groupBy("handle", F.session_window("ts", "6 hours")).agg(F.min("received_at_us").alias("first_us"), F.max("received_at_us").alias("last_us"), F.count("*").alias("frames")).drop("session_window")


@query("t10_cursor_reset", "SELECT frame_id, k < 0 OR k > m OR k <= 10 OR k % 5 = 4 AS reset FROM (SELECT frame_id, frame_id * 3 - 50 AS k, max(frame_id) OVER () AS m FROM fx_frame)")
def t10(fx):
    latest = fx.frame.agg(F.max("frame_id").alias("m"))
    k = c("frame_id") * 3 - 50
    return fx.frame.crossJoin(F.broadcast(latest)).select("frame_id", ((k < 0) | (k > c("m")) | (k <= 10) | (k % 5 == 4)).alias("reset"))  # one row


@query("t12_active_viewers", f"SELECT participant_id, max(completed_at_us) AS seen_us FROM fx_lap GROUP BY 1 HAVING max(completed_at_us) > {END} - 86400000000")
def t12(fx):
    latest = fx.lap.agg(F.max("completed_at_us").alias("now_us"))
    seen = fx.lap.groupBy("participant_id").agg(F.max("completed_at_us").alias("seen_us"))
    return seen.crossJoin(F.broadcast(latest)).where("seen_us > now_us - 86400000000").select("participant_id", "seen_us")  # one row
