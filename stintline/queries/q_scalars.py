"""Scalar parsers over texts derived from the tables (B)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintline.functions import scalars as S
from stintline.operators import battle as B
from stintline.queries.registry import query

c = F.col


def pick(number: str, *texts: str | None) -> Column:
    """One of some texts by a number; what {n} stands for is the number."""
    out = F.lit(None).cast("string")
    for k, t in enumerate(texts):
        if t is not None:
            head, brace, tail = t.partition("{n}")
            value = F.concat(F.lit(head), c(number).cast("string"), F.lit(tail)) if brace else F.lit(t)
            out = F.when(c(number) % len(texts) == k, value).otherwise(out)
    return out


def pick_sql(number: str, *texts: str | None) -> str:
    cases = []
    for k, t in enumerate(texts):
        if t is not None:
            head, brace, tail = t.replace("'", "''").partition("{n}")
            cases.append(f"WHEN {k} THEN " + (f"concat('{head}', {number}, '{tail}')" if brace else f"'{head}'"))
    return f"CASE {number} % {len(texts)} {' '.join(cases)} END"


_TIMES = ("{n}", "-{n}", "abc", "9223372036854775807", " {n} ", "0", None, "{n}.5")


@query(
    "b1_parse_ts_time",
    f"""SELECT event_id, try_cast(trim(x) AS BIGINT) AS parsed, try_cast(trim(x) AS BIGINT) = 9223372036854775807 AS is_open,
  CASE WHEN try_cast(trim(x) AS BIGINT) <> 9223372036854775807 THEN try_cast(trim(x) AS BIGINT) + 946684800000000 END AS unix_us,
  CASE WHEN try_cast(trim(x) AS BIGINT) NOT IN (0, 9223372036854775807) THEN try_cast(trim(x) AS BIGINT) END AS event_ts,
  nullif(try_cast(trim(x) AS BIGINT), 0) AS boundary_ts
FROM (SELECT event_id, CASE WHEN regexp_full_match(trim(x), '[0-9]+') THEN x END AS x FROM (SELECT event_id, {pick_sql('event_id', *_TIMES)} AS x FROM fx_lap))""",
)
def b1(fx):
    x = fx.lap.select("event_id", pick("event_id", *_TIMES).alias("x"))
    return x.select("event_id", S.parse_ts_time(c("x")).alias("parsed"), S.is_open_ended(c("x")).alias("is_open"), S.provider_to_unix_us(S.parse_ts_time(c("x"))).alias("unix_us"), S.event_ts(c("x")).alias("event_ts"), S.heat_boundary_ts(c("x")).alias("boundary_ts"))


@query("b2_provider_to_unix", "SELECT participant_id, event_id, provider_us + 946684800000000 AS unix_us FROM fx_passing")
def b2(fx):
    return fx.passing.select("participant_id", "event_id", S.provider_to_unix_us(c("provider_us")).alias("unix_us"))


_STAMPS = ("2024-01-15T10:20:30Z", "2024-01-15T10:20:30.250+03:00", "2024-01-15T10:20:30", "{n}", "soon", None)


@query(
    "b3_received_at",
    f"""SELECT event_id, CASE WHEN regexp_full_match(x, '[0-9]+') THEN try_cast(x AS BIGINT)
  WHEN regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?([Zz]|[+-]\\d{{2}}:\\d{{2}})') THEN epoch_us(try_cast(x AS TIMESTAMPTZ)) END AS at_us
FROM (SELECT event_id, {pick_sql('event_id', *_STAMPS)} AS x FROM fx_lap)""",
)
def b3(fx):
    return fx.lap.select("event_id", pick("event_id", *_STAMPS).alias("x")).select("event_id", S.received_at_us(c("x")).alias("at_us"))


@query(
    "b5_duration_ms",
    """SELECT event_id, CASE WHEN us >= 1000000 AND us < 9223372036854775807 THEN us // 1000 END AS ms
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 999999 WHEN 1 THEN 9223372036854775807 ELSE duration_ms * 1000 + event_id % 1000 END AS us FROM fx_lap)""",
)
def b5(fx):
    us = F.when(c("event_id") % 7 == 0, F.lit(999_999)).when(c("event_id") % 7 == 1, F.lit(S.OPEN_ENDED)).otherwise(c("duration_ms") * 1000 + c("event_id") % 1000)
    return fx.lap.select("event_id", us.alias("us")).select("event_id", S.duration_ms(c("us")).alias("ms"))


_GAPS = ("{n}.5", "-- {n} laps --", "1:02.0005", "2:75.0", "1:02:03.25", "1:62:03", "", None, "PIT", "-- 1 lap --", " 12.3456 ", "x:1.0", "1:2:3:4", "-5")
GAP_SQL = """kind, completed_laps, time_ms FROM (
  SELECT *, CASE WHEN t IS NULL OR t = '' THEN 'EMPTY' WHEN completed_laps IS NOT NULL THEN 'LAP_GROUP' WHEN time_ms IS NOT NULL THEN 'TIME' ELSE 'UNKNOWN' END AS kind FROM (
  SELECT *, try_cast(nullif(regexp_extract(lower(t), '^--\\s*(\\d+)\\s+laps?\\s*--$', 1), '') AS BIGINT) AS completed_laps,
    CAST(round(CASE len(p) WHEN 1 THEN s WHEN 2 THEN CASE WHEN s < 60 THEN m0 * 60 + s END WHEN 3 THEN CASE WHEN s < 60 AND m1 < 60 THEN m0 * 3600 + m1 * 60 + s END END * 1000, 0) AS BIGINT) AS time_ms
  FROM (SELECT *, CASE WHEN regexp_full_match(trim(p[-1]), '\\d+(\\.\\d*)?|\\.\\d+') THEN try_cast(trim(p[-1]) AS DECIMAL(18,6)) END AS s,
      CASE WHEN regexp_full_match(trim(p[1]), '\\d+') THEN try_cast(p[1] AS BIGINT) END AS m0, CASE WHEN regexp_full_match(trim(p[2]), '\\d+') THEN try_cast(p[2] AS BIGINT) END AS m1
    FROM (SELECT *, trim(x) AS t, string_split(trim(x), ':') AS p FROM {source}))))"""


@query("b6_parse_gap", "SELECT event_id, " + GAP_SQL.replace("{source}", f"(SELECT event_id, {pick_sql('event_id', *_GAPS)} AS x FROM fx_lap)"))
def b6(fx):
    return fx.lap.select("event_id", S.parse_gap(pick("event_id", *_GAPS)).alias("g")).select("event_id", "g.*")


_STATES = ("E{n}", "SIn Pit", "SOutLap", "SFinshd", "E", "finished", "SLunch", "", None, "E9223372036854775807", "e {n}")


@query(
    "b7_parse_state",
    f"""SELECT event_id, timer, CASE WHEN h = 'E' AND timer IS NOT NULL THEN 'ON_TRACK' ELSE coalesce(CASE regexp_replace(lower(literal), '[^a-z0-9]+', '', 'g')
    WHEN 'inpit' THEN 'IN_PIT' WHEN 'outlap' THEN 'OUT_LAP' WHEN 'finshd' THEN 'FINISHED' WHEN 'finished' THEN 'FINISHED' END, 'UNKNOWN') END AS kind
FROM (SELECT *, CASE WHEN h = 'E' AND regexp_full_match(r, '[0-9]+') AND r <> '9223372036854775807' THEN try_cast(r AS BIGINT) END AS timer,
    CASE WHEN h = 'E' THEN NULL WHEN h = 'S' THEN r ELSE t END AS literal
  FROM (SELECT event_id, trim(x) AS t, upper(substr(trim(x), 1, 1)) AS h, trim(substr(trim(x), 2)) AS r FROM (SELECT event_id, {pick_sql('event_id', *_STATES)} AS x FROM fx_lap)))""",
)
def b7(fx):
    return fx.lap.select("event_id", S.parse_state(pick("event_id", *_STATES)).alias("s")).select("event_id", "s.timer", "s.kind")


_FLAGS = ("-1", "0", "1", "2", "3", "4", "5", "6", "7", "8", "Green flag", "FCY", "Yellow Flag", "purple", None, "")


@query(
    "b8_canonical_flag",
    f"""SELECT event_id, coalesce(CASE code WHEN -1 THEN 'NOT_STARTED' WHEN 0 THEN 'NOT_STARTED' WHEN 1 THEN 'READY' WHEN 2 THEN 'RED' WHEN 3 THEN 'SAFETY_CAR' WHEN 4 THEN 'CODE_60'
    WHEN 5 THEN 'FINISH' WHEN 6 THEN 'GREEN' WHEN 7 THEN 'FULL_COURSE_YELLOW' END, 'UNKNOWN') AS flag
FROM (SELECT event_id, coalesce(try_cast(x AS INT), CASE regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') WHEN 'greenflag' THEN 6 WHEN 'fcy' THEN 7 WHEN 'yellowflag' THEN 3 END) AS code
  FROM (SELECT event_id, {pick_sql('event_id', *_FLAGS)} AS x FROM fx_lap))""",
)
def b8(fx):
    return fx.lap.select("event_id", S.canonical_flag(pick("event_id", *_FLAGS)).alias("flag"))


_STINTS = ("S{n}", "P{n}", "L{n}000", "X{n}", "S", None, "Labc")


@query(
    "b9_driver_stint",
    f"""SELECT event_id, CASE WHEN v IS NOT NULL AND k IS NOT NULL THEN k ELSE 'UNKNOWN' END AS kind, CASE WHEN k IS NOT NULL THEN v END AS value
FROM (SELECT event_id, CASE substr(x, 1, 1) WHEN 'S' THEN 'START_TS' WHEN 'P' THEN 'POINT_TS' WHEN 'L' THEN 'DURATION' END AS k, try_cast(substr(x, 2) AS BIGINT) AS v
  FROM (SELECT event_id, {pick_sql('event_id', *_STINTS)} AS x FROM fx_lap))""",
)
def b9(fx):
    return fx.lap.select("event_id", S.parse_driver_stint(pick("event_id", *_STINTS)).alias("s")).select("event_id", "s.*")


@query(
    "b10_pit_cells",
    f"""SELECT event_id, CASE WHEN x LIKE 'L%' THEN try_cast(substr(x, 2) AS BIGINT) // 1000 END AS duration_ms, CASE WHEN x LIKE 'S%' THEN nullif(try_cast(substr(x, 2) AS BIGINT), 0) END AS entry_ts
FROM (SELECT event_id, {pick_sql('event_id', *_STINTS)} AS x FROM fx_lap)""",
)
def b10(fx):
    x = fx.lap.select("event_id", pick("event_id", *_STINTS).alias("x"))
    return x.select("event_id", S.pit_duration_ms(c("x")).alias("duration_ms"), S.pit_entry_ts(c("x")).alias("entry_ts"))


_HEADERS = ("Position", "Start No", "SectorTimes", "Team name", "Sect 12", "sector", "Mystery", "PIC", "fastestRoundTime", "L-PIT", "")


@query(
    "b11_canonical_header",
    f"""SELECT event_id, CASE t WHEN 'position' THEN 'position_overall' WHEN 'startno' THEN 'start_number' WHEN 'teamname' THEN 'team_name' WHEN 'pic' THEN 'position_class'
  WHEN 'fastestroundtime' THEN 'best_lap' WHEN 'lpit' THEN 'pit_time' WHEN 'sect12' THEN 'sector_12'
  WHEN 'sectortimes' THEN CASE WHEN event_id % 4 > 0 THEN concat('sector_', event_id % 4) ELSE 'laps' END
  WHEN 'sector' THEN CASE WHEN event_id % 4 > 0 THEN concat('sector_', event_id % 4) ELSE 'laps' END ELSE 'laps' END AS canonical_key
FROM (SELECT event_id, regexp_replace(lower({pick_sql('event_id', *_HEADERS)}), '[^a-z0-9]+', '', 'g') AS t FROM fx_lap)""",
)
def b11(fx):
    return fx.lap.select("event_id", S.canonical_header(pick("event_id", *_HEADERS), (c("event_id") % 4).cast("string"), F.lit("LAPS")).alias("canonical_key"))


@query("b12_norm_key", "SELECT conv_id, turn, nullif(lower(regexp_replace(trim(concat('  ', role, '   ', turn, ' ')), '\\s+', ' ', 'g')), '') AS norm FROM conversations")
def b12(fx):
    return fx.conversations.select("conv_id", "turn", S.norm_key(F.concat(F.lit("  "), "role", F.lit("   "), c("turn").cast("string"), F.lit(" "))).alias("norm"))


@query("b13_speed_kph", "SELECT event_id, speed_mm_s * 0.0036::DOUBLE AS speed_kph FROM fx_passing")
def b13(fx):
    return fx.passing.select("event_id", S.speed_kph(c("speed_mm_s")).alias("speed_kph"))


_VALUES = ("{n}", "-{n}", "{n}.25", "true", "false", "NaN", "inf", "1e5", "", None, " x ")


@query(
    "b14_strict_values",
    f"""SELECT event_id, CASE WHEN regexp_full_match(x, '-?[0-9]+') THEN try_cast(x AS BIGINT) END AS as_int,
  CASE WHEN regexp_full_match(x, '-?[0-9]+(\\.[0-9]+)?') THEN try_cast(x AS DOUBLE) END AS as_float,
  CASE x WHEN 'true' THEN true WHEN 'false' THEN false END AS as_bool, nullif(trim(x), '') AS as_text
FROM (SELECT event_id, {pick_sql('event_id', *_VALUES)} AS x FROM fx_lap)""",
)
def b14(fx):
    x = fx.lap.select("event_id", pick("event_id", *_VALUES).alias("x"))
    return x.select("event_id", S.as_int(c("x")).alias("as_int"), S.as_float(c("x")).alias("as_float"), S.as_bool(c("x")).alias("as_bool"), S.as_text(c("x")).alias("as_text"))


@query(
    "b15_plausible",
    "SELECT event_id, CASE WHEN abs(e - completed_at_us) <= 93600000000 THEN e END AS plausible_us FROM (SELECT event_id, completed_at_us, completed_at_us + (event_id % 60) * 3600000000 - 108000000000 AS e FROM fx_lap)",
)
def b15(fx):
    e = c("completed_at_us") + (c("event_id") % 60) * 3_600_000_000 - 108_000_000_000
    return fx.lap.select("event_id", S.plausible_us(e, c("completed_at_us")).alias("plausible_us"))


@query("b16_fingerprint", "SELECT event_id, sha256(concat_ws('|', coalesce(CAST(participant_id AS VARCHAR), '~'), coalesce(CAST(sector_2_ms AS VARCHAR), '~'))) AS digest FROM fx_lap")
def b16(fx):
    return fx.lap.select("event_id", S.fingerprint(c("participant_id"), c("sector_2_ms")).alias("digest"))


@query(
    "b17_freshness",
    """SELECT event_id, CASE WHEN l IN ('stopped', 'aborted') OR event_id % 13 = 0 OR f = 'FINISH' OR event_id % 17 = 0 OR age IS NULL THEN 'OFFLINE'
  WHEN age <= 3000000 THEN 'LIVE' WHEN age <= 10000000 THEN 'STALE' ELSE 'OFFLINE' END AS freshness
FROM (SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN (event_id % 15) * 1000000 END AS age, CASE event_id % 5 WHEN 0 THEN 'stopped' ELSE 'running' END AS l, CASE event_id % 7 WHEN 0 THEN 'FINISH' WHEN 1 THEN NULL ELSE 'GREEN' END AS f FROM fx_lap)""",
)
def b17(fx):
    n = c("event_id")
    age = F.when(n % 19 != 0, (n % 15) * 1_000_000)
    flag = F.when(n % 7 == 0, "FINISH").when(n % 7 != 1, "GREEN")
    return fx.lap.select("event_id", S.freshness(age, n % 17 == 0, flag, F.when(n % 5 == 0, "stopped").otherwise("running"), n % 13 != 0).alias("freshness"))


@query(
    "b18_sector_map",
    """SELECT event_id, 'sector_1' AS sector_key, sector_1_ms AS ms FROM fx_lap UNION ALL SELECT event_id, 'sector_2', sector_2_ms FROM fx_lap WHERE sector_2_ms IS NOT NULL""",
)
def b18(fx):
    text = F.to_json(F.create_map(F.lit("sector_1"), c("sector_1_ms") * 1000 + 7, F.lit("sector_2"), c("sector_2_ms") * 1000, F.lit("sector_x"), F.lit(5_000_000), F.lit("sector_3"), F.lit(999)))
    return fx.lap.select("event_id", F.explode(S.sector_map(text)).alias("sector_key", "ms"))


_SESSION = [("qualif", "Квалификация"), ("race", "Гонка"), ("practice", "Тренировка")]


@query(
    "b19_object_key",
    """SELECT doc_id, p[1] AS category, p[2] AS date, p[3] AS slug, p[4] AS filename, substr(p[2], 1, 4) AS season, upper(regexp_extract(p[4], '^([A-Za-z]{2,4})[_\\-]', 1)) AS code,
  CASE WHEN contains(p[4], 'qualif') THEN 'Квалификация' WHEN contains(p[4], 'race') THEN 'Гонка' ELSE 'Тренировка' END AS session_type
FROM (SELECT doc_id, string_split(object_key, '/') AS p FROM fx_object)""",
)
def b19(fx):
    o = fx.object.select("doc_id", S.object_key_parts(c("object_key")).alias("k")).select("doc_id", "k.*")
    return o.withColumn("session_type", S.first_token(c("filename"), _SESSION))


@query("b20_object_id", "SELECT doc_id, substr(sha1(object_key), 1, 16) AS id, concat_ws(' · ', 'x', CAST(size AS VARCHAR)) AS title FROM fx_object")
def b20(fx):
    return fx.object.select("doc_id", S.object_id(c("object_key")).alias("id"), S.title(F.lit("x"), F.lit(""), c("size").cast("string")).alias("title"))


@query(
    "b21_session_type",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Трансляция' WHEN d < '2024-01-15' THEN 'Тренировка' WHEN size >= 6000 THEN 'Гонка' WHEN coalesce(h, 12) < 12 THEN 'Квалификация' ELSE 'Трансляция' END AS kind
FROM (SELECT doc_id, size, string_split(object_key, '/')[2] AS d, CASE WHEN doc_id % 9 > 0 THEN doc_id % 24 END AS h FROM fx_object)""",
)
def b21(fx):
    n = c("doc_id")
    return fx.object.select("doc_id", S.session_type(n % 11 != 0, S.object_key_parts(c("object_key")).date, F.lit("2024-01-15"), F.when(n % 9 > 0, n % 24), c("size")).alias("kind"))


@query(
    "b22_match_keys",
    """SELECT event_id, regexp_replace(lower(concat('Igora  Drive #', event_id % 5)), '[^a-z0-9]+', '', 'g') AS track_key, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS local_date FROM events""",
)
def b22(fx):
    us = F.unix_micros(c("ts").cast("timestamp"))
    return fx.events.select("event_id", S.text_key(F.concat(F.lit("Igora  Drive #"), (c("event_id") % 5).cast("string"))).alias("track_key"), S.local_date(us, "Europe/Moscow").alias("local_date"))


_TRACKS = ("Test track", "igora drive (rec)", "Smolensk", None)


@query("b23_norm_track", f"SELECT event_id, CASE lower(x) WHEN 'test track' THEN 'Тестовая трасса' WHEN 'igora drive (rec)' THEN 'Igora Drive' ELSE x END AS track FROM (SELECT event_id, {pick_sql('event_id', *_TRACKS)} AS x FROM fx_lap)")
def b23(fx):
    return fx.lap.select("event_id", S.norm_track(pick("event_id", *_TRACKS)).alias("track"))


@query(
    "b24_closed_formulas",
    """SELECT event_id, CASE WHEN d > 0 AND s > 0 THEN d - s END AS pace_delta, CASE WHEN d > 0 AND s >= 0 AND n > 0 THEN CASE WHEN event_id % 2 = 0 THEN s - d / (n * 1000.0::DOUBLE / d) ELSE s + d / (n * 1000.0::DOUBLE / d) END END AS required, CASE WHEN event_id % 2 = 0 THEN s - 12.5::DOUBLE * 5 ELSE s + 12.5::DOUBLE * 5 END AS projected,
  CAST(floor(3600.0::DOUBLE * 1000 / (d + 500.0::DOUBLE)) AS BIGINT) AS laps_low, CAST(ceil(3600.0::DOUBLE * 1000 / (d - 500.0::DOUBLE)) AS BIGINT) AS laps_high
FROM (SELECT event_id, duration_ms AS d, sector_1_ms AS s, event_id % 4 AS n FROM fx_lap)""",
)
def b24(fx):
    d, s, n = c("duration_ms"), c("sector_1_ms"), c("event_id") % 4
    laps = S.expected_laps(F.lit(3600.0), d, F.lit(500.0))
    side = F.when(c("event_id") % 2 == 0, "AHEAD").otherwise("BEHIND")
    return fx.lap.select("event_id", S.pace_delta(d, s).alias("pace_delta"), B.required_pace(side, d, s, d, n).alias("required"), B.projected_gap(side, s, F.lit(12.5), 5).alias("projected"), laps.low.cast("long").alias("laps_low"), laps.high.cast("long").alias("laps_high"))


@query(
    "b25_mixed_gap",
    """SELECT a.participant_id, a.lap_number, b.sector_1_ms - a.sector_1_ms AS ms, b.lap_number - a.lap_number AS laps FROM fx_lap a JOIN fx_lap b ON a.participant_id = b.participant_id AND b.lap_number = a.lap_number + 1""",
)
def b25(fx):
    b = fx.lap.select("participant_id", (c("lap_number") - 1).alias("lap_number"), c("lap_number").alias("lap_b"), c("sector_1_ms").alias("ms_b"))
    return fx.lap.join(b, ["participant_id", "lap_number"]).select("participant_id", "lap_number", S.mixed_gap(c("lap_number"), c("sector_1_ms"), c("lap_b"), c("ms_b")).alias("g")).select("participant_id", "lap_number", "g.ms", "g.laps")
