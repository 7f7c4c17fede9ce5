"""Fact builders, sources, windows of history, sets and limits (A, E18-E25, F12-F25, G, H, S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintline.functions.scalars import fingerprint
from stintline.operators import facts as S
from stintline.queries.q_laps import CLEAN, PACE, clean_laps, pace
from stintline.queries.registry import query
from stintline.sources import feed

c = F.col


@query("a3_quarantine", "SELECT frame_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN 'decoded' ELSE 'failed' END AS decode_state FROM fx_frame")
def a3(fx):
    return feed.quarantine(fx.frame).select("frame_id", "decode_state")


@query("a4_dedupe_frames", "SELECT conn_id, frame_id, min(received_at_us) AS received_at_us FROM fx_frame GROUP BY 1, 2")
def a4(fx):
    return feed.dedupe(fx.frame.union(fx.frame), ["conn_id", "frame_id"]).select("conn_id", "frame_id", "received_at_us")


@query("a5_frame_hash", "SELECT frame_id, sha256(raw) AS digest FROM fx_frame")
def a5(fx):
    return fx.frame.select("frame_id", F.sha2("raw", 256).alias("digest"))


@query("a6_explode_cells", "SELECT heat_id, frame_id, message_ordinal, change_ordinal, row_ix, col_ix, CAST(value AS VARCHAR) AS value FROM fx_cell WHERE col_ix % 5 <> 0")
def a6(fx):
    n = c("col_ix")
    text = F.when(n % 5 == 0, F.concat(F.lit("["), c("row_ix").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), F.concat_ws(",", c("row_ix").cast("string"), n.cast("string"), c("value").cast("string")), F.lit("]")))
    return feed.explode_cells(fx.cell.select("heat_id", "frame_id", "message_ordinal", "change_ordinal", F.concat(F.lit("["), text, F.lit("]")).alias("payload"))).select("heat_id", "frame_id", "message_ordinal", "change_ordinal", "row_ix", "col_ix", "value")


@query(
    "a7_explode_passings",
    "SELECT event_id, speed_mm_s * 0.0036::DOUBLE AS speed_kph, sector_id, CASE WHEN event_id % 6 = 0 THEN 'truncated_tuple' WHEN event_id % 7 = 0 THEN 'invalid_speed' ELSE '' END AS errors FROM fx_passing WHERE event_id % 6 > 0 AND event_id % 7 > 0 UNION ALL SELECT event_id, NULL, CASE WHEN event_id % 6 > 0 THEN sector_id END, CASE WHEN event_id % 6 = 0 THEN 'truncated_tuple' ELSE 'invalid_speed' END FROM fx_passing WHERE event_id % 6 = 0 OR event_id % 7 = 0",
)
def a7(fx):
    n = c("event_id")
    fields = F.array(n.cast("string"), c("participant_id").cast("string"), c("start_mm").cast("string"), c("stop_mm").cast("string"), c("sector_id").cast("string"), F.when(n % 7 == 0, "fast").otherwise(c("speed_mm_s").cast("string")), c("is_in_pit").cast("string"), c("provider_us").cast("string"), F.lit("0"))
    raw = fx.passing.select("event_id", F.when(n % 6 == 0, F.slice(fields, 1, 4)).otherwise(fields).alias("fields"))
    return feed.passings(raw).select("event_id", "speed_kph", "sector_id", F.array_join("errors", ",").alias("errors"))


@query("a8_passing_dedupe", "SELECT sha256(concat_ws('|', CAST(participant_id AS VARCHAR), CAST(provider_us AS VARCHAR), CAST(start_mm AS VARCHAR))) AS fingerprint, min(event_id) AS event_id FROM fx_passing GROUP BY 1")
def a8(fx):
    p = fx.passing.withColumn("fingerprint", fingerprint(c("participant_id"), c("provider_us"), c("start_mm")))
    return p.union(p).groupBy("fingerprint").agg(F.min("event_id").alias("event_id"))


@query("a12_list_objects", "SELECT object_key, CASE WHEN object_key LIKE 'thumbnails/%' THEN 'thumb' WHEN object_key LIKE 'telemetry/%' THEN 'telemetry' WHEN object_key LIKE '%.mp4' THEN 'video' ELSE 'other' END AS kind FROM fx_object")
def a12(fx):
    return feed.classify_objects(fx.object).select("object_key", "kind")


@query("e18_unknown_handles", "SELECT handle, count(*) AS frames, max(received_at_us) AS latest_us FROM fx_frame WHERE handle NOT IN ('r_c', 't_p', 'h_h', 's_t') GROUP BY 1 ORDER BY frames DESC, handle LIMIT 20")
def e18(fx):
    known = fx.spark.createDataFrame([(h,) for h in ("r_c", "t_p", "h_h", "s_t")], "handle string")
    return fx.frame.join(F.broadcast(known), "handle", "left_anti").groupBy("handle").agg(F.count("*").alias("frames"), F.max("received_at_us").alias("latest_us")).orderBy(F.desc("frames"), "handle").limit(20)


@query("e19_frame_counts", "SELECT decode_state, count(*) AS frames, min(received_at_us) AS oldest_us FROM (SELECT *, CASE WHEN raw = 'not-json' THEN 'failed' ELSE 'decoded' END AS decode_state FROM fx_frame) GROUP BY 1")
def e19(fx):
    return feed.quarantine(fx.frame).groupBy("decode_state").agg(F.count("*").alias("frames"), F.min("received_at_us").alias("oldest_us"))


@query("e20_facets", "SELECT 'lang' AS facet, lang AS value FROM documents WHERE lang <> '' GROUP BY lang UNION ALL SELECT 'source', source FROM documents WHERE source <> '' GROUP BY source")
def e20(fx):
    long = fx.documents.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c(n).alias("value")) for n in ("lang", "source")])).alias("x")).select("x.*")
    return long.where("value <> ''").distinct()


@query("e21_handle_counters", "SELECT handle, count(*) AS messages FROM fx_frame GROUP BY 1")
def e21(fx):
    return fx.frame.groupBy("handle").agg(F.count("*").alias("messages"))


@query("e22_state_hash")
def e22(fx):
    grid = S.grid_current(fx.cell)
    return grid.groupBy("heat_id").agg(F.bit_xor(F.xxhash64("row_ix", "col_ix", "value")).alias("state_hash"), F.count("*").alias("cells"))


@query("e23_roster_merge", "SELECT conv_id, arg_max(CASE WHEN turn % 2 = 0 THEN role END, turn) AS team, bool_or(turn % 5 = 1) AS is_ours FROM conversations GROUP BY 1")
def e23(fx):
    return fx.conversations.groupBy("conv_id").agg(F.max_by("role", F.when(c("turn") % 2 == 0, c("turn"))).alias("team"), F.bool_or(c("turn") % 5 == 1).alias("is_ours"))


@query("e24_track_length", "SELECT sector_id, max(stop_mm) AS track_mm FROM fx_passing WHERE stop_mm > 0 GROUP BY 1")
def e24(fx):
    return fx.passing.where("stop_mm > 0").groupBy("sector_id").agg(F.max("stop_mm").alias("track_mm"))


@query("e25_finish_loops", "SELECT DISTINCT sector_id FROM fx_passing WHERE start_mm = 0 AND NOT is_in_pit AND sector_id >= 0")
def e25(fx):
    return fx.passing.where("start_mm = 0 and not is_in_pit and sector_id >= 0").select("sector_id").distinct()


@query(
    "f12_bucket_downsample",
    "x AS (SELECT *, count(*) OVER (PARTITION BY participant_id) AS n, row_number() OVER w AS i, ntile(19) OVER w AS b FROM fx_lap WINDOW w AS (PARTITION BY participant_id ORDER BY completed_at_us)), y AS (SELECT *, row_number() OVER (PARTITION BY participant_id, b ORDER BY completed_at_us) AS r FROM x) SELECT participant_id, lap_number FROM y WHERE n <= 20 OR r = 1 OR i = n",
)
def f12(fx):
    return S.bucket_downsample(fx.lap, ["participant_id"], "completed_at_us", 20).select("participant_id", "lap_number")


@query(
    "f13_event_downsample",
    """x AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY participant_id) AS n FROM fx_lap WINDOW w AS (PARTITION BY participant_id ORDER BY completed_at_us)),
y AS (SELECT *, i = 0 OR i = n - 1 OR event_type = 'error' AS must FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY participant_id, must ORDER BY completed_at_us) - 1 AS g, count(*) OVER (PARTITION BY participant_id, must) AS m, count(*) FILTER (WHERE must) OVER (PARTITION BY participant_id) AS q FROM y),
k AS (SELECT *, CASE WHEN must THEN least(q, 30) ELSE greatest(30 - q, 0) END AS k FROM z)
SELECT participant_id, lap_number FROM k WHERE n <= 30 OR (k > 0 AND (k >= m OR list_contains(CASE WHEN k = 1 THEN [0] ELSE list_transform(range(0, k), lambda j: (j * (m - 1)) // (k - 1)) END, g)))""",
)
def f13(fx):
    return S.event_downsample(fx.lap.withColumn("is_event", c("event_type") == "error"), ["participant_id"], "completed_at_us", "is_event", 30).select("participant_id", "lap_number")


@query(
    "f15_change_detection",
    "SELECT participant_id, lap_number, state_kind, b AS before FROM (SELECT *, lag(state_kind) OVER (PARTITION BY participant_id ORDER BY lap_number) AS b FROM fx_state) WHERE b IS NOT NULL AND state_kind <> b",
)
def f15(fx):
    w = Window.partitionBy("participant_id").orderBy("lap_number")
    return fx.state.withColumn("before", F.lag("state_kind").over(w)).where(c("before").isNotNull() & ~c("state_kind").eqNullSafe(c("before"))).select("participant_id", "lap_number", "state_kind", "before")


@query("f16_scope_fan_out", "SELECT DISTINCT x.k AS scope_kind, x.s AS scope_key, at_us FROM (SELECT completed_at_us AS at_us, unnest([{'k': 'participant', 's': participant_id}, {'k': 'class', 's': class_key}, {'k': 'session', 's': CASE WHEN class_key = 0 THEN 0 END}]) AS x FROM fx_lap WHERE event_type = 'error') WHERE x.s IS NOT NULL")
def f16(fx):
    scopes = F.array(F.struct(F.lit("participant").alias("scope_kind"), c("participant_id").alias("scope_key")), F.struct(F.lit("class").alias("scope_kind"), c("class_key").alias("scope_key")), F.struct(F.lit("session").alias("scope_kind"), F.when(c("class_key") == 0, F.lit(0).cast("long")).alias("scope_key")))
    return fx.lap.where("event_type = 'error'").select(c("completed_at_us").alias("at_us"), F.explode(scopes).alias("x")).select("x.scope_kind", "x.scope_key", "at_us").where("scope_key is not null").distinct()


@query("f17_best_lap_events", "SELECT participant_id, lap_number, best FROM (SELECT *, lag(best) OVER (PARTITION BY participant_id ORDER BY lap_number) AS b FROM (SELECT *, min(duration_ms) OVER (PARTITION BY participant_id ORDER BY lap_number) AS best FROM fx_lap)) WHERE b IS NOT NULL AND best <> b")
def f17(fx):
    w = Window.partitionBy("participant_id").orderBy("lap_number")
    rows = fx.lap.withColumn("best", F.min("duration_ms").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("b", F.lag("best").over(w)).where("b is not null and best <> b").select("participant_id", "lap_number", "best")


@query(
    "f20_line_breaks",
    CLEAN + " SELECT participant_id, lap_number, coalesce(lap_number - lag(lap_number) OVER w > 1, false) OR crosses_pit OR has_feed_gap AS is_break FROM clean WHERE duration_ms % 3 > 0 WINDOW w AS (PARTITION BY participant_id ORDER BY lap_number)",
)
def f20(fx):
    w = Window.partitionBy("participant_id").orderBy("lap_number")
    jump = F.coalesce(c("lap_number") - F.lag("lap_number").over(w) > 1, F.lit(False))
    return clean_laps(fx).where("duration_ms % 3 > 0").select("participant_id", "lap_number", (jump | c("crosses_pit") | c("has_feed_gap")).alias("is_break"))


@query("f21_interval_breaks", "SELECT focal_id, relation, seq, coalesce(target_id <> lag(target_id) OVER w OR flag <> lag(flag) OVER w OR our_lap - target_lap <> lag(our_lap - target_lap) OVER w, false) AS is_break FROM fx_gap_sample WINDOW w AS (PARTITION BY focal_id, relation ORDER BY observed_at_us, seq)")
def f21(fx):
    w = Window.partitionBy("focal_id", "relation").orderBy("observed_at_us", "seq")
    now = F.struct("target_id", "flag", (c("our_lap") - c("target_lap")).alias("d"))
    rows = fx.gap_sample.withColumn("now", now).withColumn("before", F.lag("now").over(w))
    return rows.select("focal_id", "relation", "seq", (c("before").isNotNull() & (c("now") != c("before"))).alias("is_break"))


@query(
    "f22_sector_window",
    "r AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY abs(completed_at_us - (SELECT min(completed_at_us) + 864000000000 FROM fx_lap)), completed_at_us) AS k FROM fx_lap), t AS (SELECT participant_id, lap_number AS centre, sector_1_ms AS base FROM r WHERE k = 1) SELECT l.participant_id, l.lap_number - t.centre AS offset_laps, l.sector_1_ms - t.base AS delta_ms FROM fx_lap l JOIN t USING (participant_id) WHERE abs(l.lap_number - t.centre) <= 2",
)
def f22(fx):
    at = fx.lap.agg((F.min("completed_at_us") + 864_000_000_000).alias("at_us"))
    near = fx.lap.crossJoin(F.broadcast(at)).groupBy("participant_id").agg(F.min_by(F.struct("lap_number", "sector_1_ms"), F.struct(F.abs(c("completed_at_us") - c("at_us")), "completed_at_us")).alias("t"))  # one row
    rows = fx.lap.join(near, "participant_id").where("abs(lap_number - t.lap_number) <= 2")
    return rows.select("participant_id", (c("lap_number") - c("t.lap_number")).alias("offset_laps"), (c("sector_1_ms") - c("t.sector_1_ms")).alias("delta_ms"))


@query(
    "f23_clock_median",
    "x AS (SELECT *, list_sort(list(received_at_us - provider_ts) OVER (PARTITION BY conn_id ORDER BY received_at_us, frame_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)) AS l FROM fx_clock) SELECT conn_id, frame_id, (l[(len(l) - 1) // 2 + 1] + l[len(l) // 2 + 1]) // 2 AS offset_us FROM x",
)
def f23(fx):
    return S.clock_offsets(fx.clock).select("conn_id", "frame_id", "offset_us")


@query(
    "f24_clock_interpolation",
    """x AS (SELECT *, CASE WHEN frame_id % 10 = 0 THEN received_at_us END AS a FROM fx_clock), y AS (SELECT *, last_value(a IGNORE NULLS) OVER w AS lo, first_value(a IGNORE NULLS) OVER v AS hi FROM x
WINDOW w AS (PARTITION BY conn_id ORDER BY received_at_us, frame_id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY conn_id ORDER BY received_at_us, frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT conn_id, frame_id, CASE WHEN hi - lo BETWEEN 1 AND 3600000000 THEN (received_at_us - lo) / (hi - lo) WHEN hi = lo THEN 0.0::DOUBLE END AS share FROM y""",
)
def f24(fx):
    # the first that follows is the last one in the order turned round: frames without an end are read anew for each row
    until = lambda *order: Window.partitionBy("conn_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    a = F.when(c("frame_id") % 10 == 0, c("received_at_us"))
    rows = fx.clock.withColumn("a", a).withColumn("lo", F.last("a", ignorenulls=True).over(until("received_at_us", "frame_id"))).withColumn("hi", F.last("a", ignorenulls=True).over(until(F.desc("received_at_us"), F.desc("frame_id"))))
    span = c("hi") - c("lo")
    return rows.select("conn_id", "frame_id", F.when(span.between(1, 3_600_000_000), (c("received_at_us") - c("lo")) / span).when(span == 0, 0.0).alias("share"))


@query(
    "f25_dts_regions",
    "x AS (SELECT participant_id, completed_at_us AS t, lag(completed_at_us) OVER (PARTITION BY participant_id ORDER BY completed_at_us) AS b FROM fx_lap) SELECT participant_id, 1 + count(*) FILTER (WHERE t - b > 86400000000) AS regions, count(*) FILTER (WHERE t - b > 86400000000) > 0 OR min(t) > (SELECT min(completed_at_us) + 43200000000 FROM fx_lap) AS broken FROM x GROUP BY 1",
)
def f25(fx):
    b = F.lag("completed_at_us").over(Window.partitionBy("participant_id").orderBy("completed_at_us"))
    start = fx.lap.agg((F.min("completed_at_us") + 43_200_000_000).alias("start"))
    rows = fx.lap.withColumn("step", c("completed_at_us") - b).groupBy("participant_id").agg((1 + F.count_if(c("step") > 86_400_000_000)).alias("regions"), F.min("completed_at_us").alias("first"))
    return rows.crossJoin(F.broadcast(start)).select("participant_id", "regions", ((c("regions") > 1) | (c("first") > c("start"))).alias("broken"))  # one row


@query("g1_newest_facts", "SELECT * FROM (SELECT participant_id, lap_number, completed_at_us FROM fx_lap ORDER BY completed_at_us DESC, participant_id LIMIT 500) ORDER BY completed_at_us")
def g1(fx):
    return fx.lap.select("participant_id", "lap_number", "completed_at_us").orderBy(F.desc("completed_at_us"), "participant_id").limit(500).orderBy("completed_at_us")


@query("g2_last_per_participant", "SELECT participant_id, lap_number FROM fx_lap QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY lap_number DESC) <= 12")
def g2(fx):
    w = Window.partitionBy("participant_id").orderBy(F.desc("lap_number"))
    return fx.lap.withColumn("n", F.row_number().over(w)).where("n <= 12").select("participant_id", "lap_number")


@query("g3_latest_one", "SELECT participant_id, arg_max(event_id, completed_at_us) AS latest_event FROM fx_lap GROUP BY 1")
def g3(fx):
    return fx.lap.groupBy("participant_id").agg(F.max_by("event_id", "completed_at_us").alias("latest_event"))


@query("g4_catalogue_page", "SELECT object_key, size FROM fx_object ORDER BY size DESC NULLS LAST, object_key LIMIT 50 OFFSET 50")
def g4(fx):
    return fx.object.select("object_key", "size").orderBy(F.desc_nulls_last("size"), "object_key").offset(50).limit(50)


@query("g5_participant_order", "SELECT participant_id, row_number() OVER (PARTITION BY class_key ORDER BY participant_id % 7 = 0 DESC, try_cast(concat('', participant_id) AS BIGINT), participant_id) AS place FROM (SELECT DISTINCT participant_id, class_key FROM fx_lap)")
def g5(fx):
    cars = fx.lap.select("participant_id", "class_key").distinct()
    w = Window.partitionBy("class_key").orderBy(F.desc(c("participant_id") % 7 == 0), c("participant_id").cast("string").try_cast("bigint"), "participant_id")
    return cars.select("participant_id", F.row_number().over(w).cast("long").alias("place"))


@query("g6_severity_order", "SELECT handle, severity, frames, row_number() OVER (PARTITION BY severity ORDER BY handle) AS place FROM (SELECT handle, CASE WHEN count(*) % 2 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, count(*) AS frames FROM fx_frame GROUP BY 1)")
def g6(fx):
    rows = fx.frame.groupBy("handle").agg(F.count("*").alias("frames")).withColumn("severity", F.when(c("frames") % 2 == 0, "CRITICAL").otherwise("WARNING"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("severity").orderBy("handle")).cast("long")).orderBy(F.when(c("severity") == "CRITICAL", 0).otherwise(1), "handle")


@query("h1_event_union", "SELECT 'lap' AS kind, participant_id, completed_at_us AS at_us FROM fx_lap UNION ALL SELECT 'pit', participant_id, entered_at_us FROM fx_pit UNION ALL SELECT 'flag', NULL, started_at_us FROM fx_flag")
def h1(fx):
    lap = fx.lap.select(F.lit("lap").alias("kind"), "participant_id", c("completed_at_us").alias("at_us"))
    pit = fx.pit.select(F.lit("pit").alias("kind"), "participant_id", c("entered_at_us").alias("at_us"))
    flag = fx.flag.select(F.lit("flag").alias("kind"), F.lit(None).cast("long").alias("participant_id"), c("started_at_us").alias("at_us"))
    return lap.unionByName(pit).unionByName(flag)


@query("h2_snapshot_absences", "SELECT DISTINCT heat_id, message_id FROM fx_board WHERE action = 'UPSERT' AND message_id NOT IN (0, 1)")
def h2(fx):
    complete = fx.board.where("message_id in (0, 1)").select("heat_id", "message_id").distinct()
    return fx.board.where("action = 'UPSERT'").select("heat_id", "message_id").distinct().join(complete, ["heat_id", "message_id"], "left_anti")


@query("h3_roster_diff", "SELECT coalesce(a.participant_id, b.participant_id) AS participant_id, CASE WHEN a.participant_id IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS change FROM (SELECT DISTINCT participant_id FROM fx_pit) a FULL JOIN (SELECT DISTINCT participant_id FROM fx_lap WHERE event_id % 4 = 1) b ON a.participant_id = b.participant_id WHERE a.participant_id IS NULL OR b.participant_id IS NULL")
def h3(fx):
    a = fx.pit.select("participant_id").distinct().withColumn("a", F.lit(1))
    b = fx.lap.where("event_id % 4 = 1").select("participant_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "participant_id", "full").where("a is null or b is null").select("participant_id", F.when(c("a").isNull(), "ADDED").otherwise("REMOVED").alias("change"))


@query("h4_roster_union", "SELECT participant_id, max(CASE WHEN src = 'pit' THEN class_key END) AS pit_class, max(CASE WHEN src = 'lap' THEN class_key END) AS lap_class FROM (SELECT participant_id, class_key, 'pit' AS src FROM fx_pit UNION ALL SELECT participant_id, class_key, 'lap' FROM fx_lap) GROUP BY 1")
def h4(fx):
    both = fx.pit.select("participant_id", c("class_key").alias("pit_class"), F.lit(None).cast("long").alias("lap_class")).unionByName(fx.lap.select("participant_id", F.lit(None).cast("long").alias("pit_class"), c("class_key").alias("lap_class")))
    return both.groupBy("participant_id").agg(F.max("pit_class").alias("pit_class"), F.max("lap_class").alias("lap_class"))


@query("h5_incident_sets", "SELECT coalesce(a.participant_id, o.participant_id) AS participant_id, CASE WHEN o.participant_id IS NULL THEN 'OPENED' WHEN a.participant_id IS NULL THEN 'RESOLVED' ELSE 'KEPT' END AS transition FROM (SELECT DISTINCT participant_id FROM fx_pit WHERE NOT completed) a FULL JOIN (SELECT DISTINCT participant_id FROM fx_pit WHERE stop_number = 2) o ON a.participant_id = o.participant_id")
def h5(fx):
    a = fx.pit.where("not completed").select("participant_id").distinct().withColumn("a", F.lit(1))
    o = fx.pit.where("stop_number = 2").select("participant_id").distinct().withColumn("o", F.lit(1))
    return a.join(o, "participant_id", "full").select("participant_id", F.when(c("o").isNull(), "OPENED").when(c("a").isNull(), "RESOLVED").otherwise("KEPT").alias("transition"))


@query("s3_heat_state", "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER w AS name, last_value(CASE WHEN turn % 4 = 1 THEN turn END IGNORE NULLS) OVER w AS started FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def s3(fx):
    rows = fx.conversations.select("conv_id", "turn", F.when(c("turn") % 3 == 0, c("role")).alias("name"), F.when(c("turn") % 4 == 1, c("turn")).alias("started"))
    return S.sparse_last(rows, ["conv_id"], ["turn"], ["name", "started"])


@query("s5_identity_segments", "x AS (SELECT *, lag(event_type) OVER w AS b, lag(lap_number) OVER w AS p FROM fx_lap WINDOW w AS (PARTITION BY participant_id ORDER BY lap_number)) SELECT participant_id, event_type AS value, completed_at_us AS started_at_us, lead(completed_at_us) OVER v AS ended_at_us, row_number() OVER v AS segment FROM x WHERE p IS NULL OR event_type <> b WINDOW v AS (PARTITION BY participant_id ORDER BY lap_number)")
def s5(fx):
    return S.change_segments(fx.lap, ["participant_id"], ["lap_number"], c("event_type"), "completed_at_us")


@query("s6_state_current", "SELECT participant_id, arg_max(state_kind, lap_number) AS state_kind, max(observed_at_us) AS observed_at_us, max(lap_number) AS lap_number FROM fx_state GROUP BY 1")
def s6(fx):
    return fx.state.groupBy("participant_id").agg(F.max_by("state_kind", "lap_number").alias("state_kind"), F.max("observed_at_us").alias("observed_at_us"), F.max("lap_number").alias("lap_number"))


@query(
    "s7_last_ledger",
    """x AS (SELECT *, lag(value) OVER (PARTITION BY heat_id, row_ix ORDER BY frame_id, message_ordinal, change_ordinal) AS b FROM fx_cell WHERE col_ix = 4),
y AS (SELECT *, count(*) OVER m >= 2 AND avg(CASE WHEN value IS NOT DISTINCT FROM b THEN 1 ELSE 0 END) OVER m >= 0.95 AS dense FROM x WINDOW m AS (PARTITION BY heat_id, frame_id, message_ordinal))
SELECT heat_id, row_ix, frame_id, message_ordinal, change_ordinal, value, CASE WHEN value IS NULL OR value <= 0 THEN 'INVALID' WHEN handle = 'r_i' THEN 'UNCONFIRMED' WHEN value IS NOT DISTINCT FROM b AND dense THEN 'REFRESH_REPEAT' ELSE 'CONFIRMED_LAP' END AS classification FROM y""",
)
def s7(fx):
    return S.last_ledger(fx.cell)


@query(
    "s8_laps_from_counter",
    "x AS (SELECT participant_id, lap_number AS laps, completed_at_us AS t, lag(lap_number) OVER (PARTITION BY participant_id ORDER BY completed_at_us, event_id) AS k FROM fx_lap WHERE event_id % 3 > 0), y AS (SELECT *, unnest(range(k + 1, laps + 1)) AS n FROM x WHERE laps > k) SELECT participant_id, n AS lap_number, CASE WHEN n = laps THEN t END AS completed_at_us FROM y",
)
def s8(fx):
    return S.laps_from_counter(fx.lap.where("event_id % 3 > 0").select("participant_id", "event_id", c("lap_number").alias("laps"), c("completed_at_us").alias("observed_at_us")))


_BOUNDARY = """b0 AS (SELECT *, max(provider_us) OVER (PARTITION BY participant_id ORDER BY provider_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM fx_passing WHERE start_mm = 0),
bd AS (SELECT participant_id, event_id, provider_us, CASE WHEN h IS NULL THEN 'COVERAGE_START' WHEN is_in_pit THEN 'PIT_FINISH' ELSE 'MAIN_FINISH' END AS kind, row_number() OVER (PARTITION BY participant_id ORDER BY provider_us, event_id) - 1 AS boundary FROM b0 WHERE h IS NULL OR provider_us > h)"""


@query("s9_lap_boundaries", _BOUNDARY + " SELECT * FROM bd")
def s9(fx):
    return S.lap_boundaries(fx.passing)


@query(
    "s10_canonical_laps",
    _BOUNDARY + """, l AS (SELECT *, lag(provider_us) OVER (PARTITION BY participant_id ORDER BY boundary) AS s FROM bd)
SELECT l.participant_id, l.boundary AS lap_number, l.s AS start_us, l.provider_us AS finish_us, (l.provider_us - l.s) // 1000 AS duration_ms, l.kind = 'PIT_FINISH' OR coalesce(bool_or(p.is_in_pit), false) AS is_pit_lap, count(p.event_id) AS passings
FROM l LEFT JOIN fx_passing p ON p.participant_id = l.participant_id AND p.provider_us > l.s AND p.provider_us <= l.provider_us WHERE l.s IS NOT NULL GROUP BY l.participant_id, l.boundary, l.s, l.provider_us, l.kind""",
)
def s10(fx):
    return S.canonical_laps(S.lap_boundaries(fx.passing), fx.passing)


@query("s11_lap_sectors", "SELECT participant_id, sector_id, min(provider_us) AS first_us, arg_min(speed_mm_s, provider_us) AS speed_mm_s FROM fx_passing WHERE sector_id > 0 GROUP BY 1, 2")
def s11(fx):
    return fx.passing.where("sector_id > 0").groupBy("participant_id", "sector_id").agg(F.min("provider_us").alias("first_us"), F.min_by("speed_mm_s", "provider_us").alias("speed_mm_s"))


@query("s16_flag_periods", "x AS (SELECT conn_id, received_at_us, frame_id, handle, lag(handle) OVER (PARTITION BY conn_id ORDER BY received_at_us, frame_id) AS b, lag(frame_id) OVER (PARTITION BY conn_id ORDER BY received_at_us, frame_id) AS p FROM fx_frame) SELECT conn_id, handle AS value, received_at_us AS started_at_us, lead(received_at_us) OVER w AS ended_at_us, row_number() OVER w AS segment FROM x WHERE p IS NULL OR handle <> b WINDOW w AS (PARTITION BY conn_id ORDER BY received_at_us, frame_id)")
def s16(fx):
    return S.change_segments(fx.frame, ["conn_id"], ["received_at_us", "frame_id"], c("handle"), "received_at_us")


_FLAGS = """p AS (SELECT heat_id, flag, started_at_us AS at_us, started_at_us // 86400000000 AS d FROM fx_flag WHERE started_at_us IS NOT NULL),
l AS (SELECT DISTINCT heat_id, flag, at_us + 25000000 AS at_us FROM p WHERE NOT (flag = 'GREEN' AND d % 5 = 1) AND NOT (flag <> 'GREEN' AND d % 7 = 3)),
b AS (SELECT heat_id, min(at_us) - 60000000 AS green_at, max(at_us) + 3600000000 AS finish_at FROM p GROUP BY heat_id),
h AS (SELECT heat_id, flag, started_at_us AS s, CASE WHEN (started_at_us // 86400000000) % 13 <> 0 THEN ended_at_us END AS e FROM fx_caution WHERE (started_at_us // 86400000000) % 11 <> 0),
x AS (SELECT * FROM h UNION ALL SELECT heat_id, 'FINISH', finish_at, NULL FROM b),
claimed AS (SELECT heat_id, flag, at_us FROM (SELECT l.*, row_number() OVER (PARTITION BY x.heat_id, x.flag, x.s ORDER BY abs(l.at_us - x.s), l.at_us) AS r FROM x JOIN l ON l.heat_id = x.heat_id AND l.flag = x.flag AND abs(l.at_us - x.s) <= 120000000) WHERE r = 1),
f AS (SELECT heat_id, flag, at_us FROM l EXCEPT SELECT * FROM claimed),
e AS (SELECT h.heat_id, h.flag, h.e AS at_us FROM h JOIN b ON b.heat_id = h.heat_id AND h.e < b.finish_at WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.heat_id = h.heat_id AND (x.s = h.e OR (x.s <= h.e AND x.e > h.e)))),
n AS (SELECT * FROM (SELECT e.*, f.flag AS next_flag, f.at_us AS next_at, row_number() OVER (PARTITION BY e.heat_id, e.flag, e.at_us ORDER BY f.at_us) AS r FROM e JOIN f ON f.heat_id = e.heat_id AND f.flag <> e.flag AND f.at_us BETWEEN e.at_us AND e.at_us + 120000000) WHERE r = 1),
g AS (SELECT * FROM (SELECT e.*, l.flag AS last_flag, row_number() OVER (PARTITION BY e.heat_id, e.flag, e.at_us ORDER BY l.at_us DESC, l.flag DESC) AS r FROM e JOIN l ON l.heat_id = e.heat_id AND l.at_us <= e.at_us) WHERE r = 1),
pts AS (SELECT heat_id, flag, s AS at_us, 0 AS k FROM x
  UNION ALL SELECT e.heat_id, coalesce(n.next_flag, CASE WHEN g.last_flag <> e.flag THEN g.last_flag END), e.at_us, 1 FROM e LEFT JOIN n ON n.heat_id = e.heat_id AND n.flag = e.flag AND n.at_us = e.at_us LEFT JOIN g ON g.heat_id = e.heat_id AND g.flag = e.flag AND g.at_us = e.at_us
  UNION ALL SELECT heat_id, flag, at_us, 2 FROM f WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.heat_id = f.heat_id AND n.next_flag = f.flag AND n.next_at = f.at_us) AND NOT EXISTS (SELECT 1 FROM x WHERE x.heat_id = f.heat_id AND x.s <= f.at_us AND x.e > f.at_us)),
one AS (SELECT *, row_number() OVER (PARTITION BY heat_id ORDER BY at_us) AS nr FROM (SELECT *, row_number() OVER (PARTITION BY heat_id, at_us ORDER BY k, flag NULLS LAST) AS r FROM pts) WHERE r = 1),
moved AS (SELECT one.heat_id, one.flag, CASE WHEN nr = 1 AND one.flag = 'GREEN' AND k = 2 AND at_us > green_at THEN green_at ELSE at_us END AS at_us, k <> 2 OR (nr = 1 AND one.flag = 'GREEN' AND at_us > green_at) AS calibrated FROM one JOIN b USING (heat_id)),
told AS (SELECT *, lag(flag) OVER (PARTITION BY heat_id ORDER BY at_us) AS bf, row_number() OVER (PARTITION BY heat_id ORDER BY at_us) AS nr FROM moved),
periods AS (SELECT heat_id, flag, at_us AS started_at_us, lead(at_us) OVER (PARTITION BY heat_id ORDER BY at_us) AS ended_at_us, calibrated, lead(calibrated) OVER (PARTITION BY heat_id ORDER BY at_us) AS end_calibrated FROM told WHERE nr = 1 OR bf IS DISTINCT FROM flag)
SELECT * FROM periods WHERE flag IS NOT NULL"""


@query("s17_reconcile_flags", _FLAGS)
def s17(fx):
    from stintline.operators.flags import reconcile_flags

    day = F.expr("started_at_us div 86400000000")
    shown = fx.flag.where("started_at_us is not null")
    late = (c("started_at_us") + 25_000_000).alias("started_at_us")
    live = shown.where(~((c("flag") == "GREEN") & (day % 5 == 1)) & ~((c("flag") != "GREEN") & (day % 7 == 3))).select("heat_id", "flag", late)
    history = fx.caution.where(day % 11 != 0).select("heat_id", "flag", "started_at_us", F.when(day % 13 != 0, c("ended_at_us")).alias("ended_at_us"))
    bounds = shown.groupBy("heat_id").agg((F.min("started_at_us") - 60_000_000).alias("green_at_us"), (F.max("started_at_us") + 3_600_000_000).alias("finish_at_us"))
    return reconcile_flags(live, history, bounds=bounds)


@query("s18_interval_facts", "SELECT heat_id, row_key, position, CASE WHEN row_key % 500 = 0 THEN 'SNAPSHOT_BASELINE' ELSE 'DELTA' END AS observation_kind, lag(row_key) OVER (PARTITION BY heat_id ORDER BY position) AS target_id FROM fx_gaptext")
def s18(fx):
    kind = F.when(c("row_key") % 500 == 0, "SNAPSHOT_BASELINE").otherwise("DELTA")
    return fx.gaptext.select("heat_id", "row_key", "position", kind.alias("observation_kind"), F.lag("row_key").over(Window.partitionBy("heat_id").orderBy("position")).alias("target_id"))


_COORD = """p AS (SELECT *, try_cast(nullif(regexp_extract(gap_text, '^-- (\\d+) laps --$', 1), '') AS BIGINT) AS laps, CASE WHEN gap_text LIKE '%:%' THEN CAST(round((try_cast(split_part(gap_text, ':', 1) AS BIGINT) * 60 + try_cast(split_part(gap_text, ':', 2) AS DECIMAL(18,6))) * 1000, 0) AS BIGINT) END AS ms FROM fx_gaptext),
q AS (SELECT *, last_value(laps IGNORE NULLS) OVER w AS gl, last_value(CASE WHEN laps IS NOT NULL THEN row_key END IGNORE NULLS) OVER w AS gk, first_value(laps IGNORE NULLS) OVER w AS lead FROM p WINDOW w AS (PARTITION BY heat_id ORDER BY position, row_key ROWS UNBOUNDED PRECEDING)),
co AS (SELECT *, CASE WHEN laps IS NULL AND ms IS NULL THEN 'VALUE_UNSUPPORTED' WHEN gl IS NOT NULL AND lead >= gl THEN 'EXACT' ELSE 'GROUP_UNRESOLVED' END AS st FROM q)"""


@query(
    "s19_gap_coordinates",
    _COORD + " SELECT heat_id, row_key, position, CASE WHEN laps IS NOT NULL THEN 'LAP_GROUP' WHEN ms IS NOT NULL THEN 'TIME' WHEN gap_text = '' THEN 'EMPTY' ELSE 'UNKNOWN' END AS display_kind, CASE WHEN st = 'EXACT' THEN lead - gl END AS laps_behind, CASE WHEN st = 'EXACT' THEN CASE WHEN laps IS NOT NULL THEN 0 ELSE ms END END AS residual_ms, CASE WHEN st = 'EXACT' THEN gk END AS group_leader, st AS coordinate_status FROM co",
)
def s19(fx):
    return S.gap_coordinates(fx.gaptext)


@query("s19_snapshot_quality", _COORD + " SELECT heat_id, count(*) AS participants, count(*) FILTER (WHERE st = 'EXACT') AS resolved, CASE WHEN count(*) = count(*) FILTER (WHERE st = 'EXACT') THEN 'COMPLETE' WHEN count(*) FILTER (WHERE st = 'EXACT') > 0 THEN 'PARTIAL' ELSE 'UNRESOLVED' END AS completeness FROM co GROUP BY 1")
def s19_quality(fx):
    return S.gap_snapshot_quality(S.gap_coordinates(fx.gaptext))


@query("s20_feed_gaps", "x AS (SELECT conn_id, min(received_at_us) AS a, max(received_at_us) AS d FROM fx_frame GROUP BY 1), y AS (SELECT *, lead(a) OVER (PARTITION BY conn_id % 2 ORDER BY a) AS n FROM x) SELECT conn_id % 2 AS session_id, d AS started_at_us, n AS ended_at_us FROM y WHERE n IS NULL OR n > d")
def s20(fx):
    return S.feed_gaps(fx.frame.groupBy("conn_id").agg(F.min("received_at_us").alias("connected_at_us"), F.max("received_at_us").alias("disconnected_at_us")).withColumn("session_id", c("conn_id") % 2))


_BOARD = """e AS (SELECT *, sum(CASE WHEN action = 'CLEAR' THEN 1 ELSE 0 END) OVER (PARTITION BY heat_id ORDER BY message_ordinal) AS ep FROM fx_board),
v AS (SELECT *, sum(CASE WHEN action = 'DELETE' THEN 1 ELSE 0 END) OVER (PARTITION BY heat_id, message_id, ep ORDER BY message_ordinal) AS life FROM e),
led AS (SELECT heat_id, message_id, ep, life, arg_max(text_patch, message_ordinal) FILTER (WHERE text_patch IS NOT NULL) AS text, arg_max(modality_patch, message_ordinal) FILTER (WHERE modality_patch IS NOT NULL) AS modality, min(message_ordinal) AS first_ordinal, max(message_ordinal) AS last_ordinal FROM v WHERE action = 'UPSERT' GROUP BY 1, 2, 3, 4)"""


@query("s21_board_ledger", _BOARD + " SELECT heat_id, message_id, text, modality, first_ordinal, last_ordinal FROM led")
def s21_ledger(fx):
    return S.board(fx.board)[0].select("heat_id", "message_id", "text", "modality", "first_ordinal", "last_ordinal")


@query("s21_board_current", _BOARD + " SELECT led.heat_id, led.message_id, text, modality FROM led JOIN (SELECT heat_id, max(ep) AS ep FROM v GROUP BY 1) m USING (heat_id, ep) JOIN (SELECT heat_id, message_id, ep, max(life) AS life FROM v GROUP BY 1, 2, 3) n USING (heat_id, message_id, ep, life)")
def s21(fx):
    return S.board(fx.board)[1].select("heat_id", "message_id", "text", "modality")


@query("s22_car_enrichment", "SELECT l.event_id, coalesce(n.n_name, r.r_name) AS car FROM fx_lap l LEFT JOIN customer c ON c.c_custkey = l.participant_id LEFT JOIN (SELECT n_nationkey, n_name FROM nation) n ON n.n_nationkey = c.c_nationkey AND c.c_nationkey % 2 = 0 LEFT JOIN region r ON r.r_regionkey = l.class_key")
def s22(fx):
    n = fx.customer.join(fx.nation, c("c_nationkey") == c("n_nationkey")).where("c_nationkey % 2 = 0").select(c("c_custkey").alias("participant_id"), "n_name")
    r = fx.region.select(c("r_regionkey").alias("class_key"), "r_name")
    return fx.lap.join(n, "participant_id", "left").join(r, "class_key", "left").select("event_id", F.coalesce("n_name", "r_name").alias("car"))


@query("e15_benchmark_series", PACE + ", k AS (SELECT completed_at_us // 86400000000 AS keyframe, participant_id, arg_max(pace_5_ms, lap_number) AS p FROM pace GROUP BY 1, 2) SELECT keyframe, median(p) AS p50, quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.75) AS p75 FROM k WHERE p IS NOT NULL GROUP BY 1")
def e15(fx):
    k = pace(fx).groupBy(F.call_function("div", c("completed_at_us"), F.lit(86_400_000_000)).alias("keyframe"), "participant_id").agg(F.max_by("pace_5_ms", "lap_number").alias("p")).where("p is not null")
    return k.groupBy("keyframe").agg(F.percentile("p", F.lit(0.5)).alias("p50"), F.percentile("p", F.lit(0.25)).alias("p25"), F.percentile("p", F.lit(0.75)).alias("p75"))
