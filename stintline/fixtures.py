"""The driver's tables seen as canonical timing tables; one SQL text for Spark and for other engines."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from stintline.operators.windows import parts_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents")

#: {us} is the instant of `ts` in microseconds, {str} the string type.
VIEWS = {
    "fx_heat": """SELECT DISTINCT user_id % 3 AS heat_id FROM events""",
    "fx_lap": """SELECT user_id % 3 AS heat_id, user_id AS participant_id, user_id % 5 AS class_key, event_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lap_number,
  lag({us}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS started_at_us,
  {us} AS completed_at_us,
  90000 + CAST(round(value * 100) AS BIGINT) * 10 AS duration_ms,
  30000 + (event_id * 37) % 9000 AS sector_1_ms,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE 28000 + (event_id * 53) % 9000 END AS sector_2_ms,
  90000 + CAST(round(value * 100) AS BIGINT) * 10 - 30000 - (event_id * 37) % 9000 - 28000 - (event_id * 53) % 9000 AS sector_3_ms
FROM events""",
    "fx_pit": """SELECT heat_id, participant_id, class_key,
  row_number() OVER (PARTITION BY participant_id ORDER BY lap_number) AS stop_number,
  completed_at_us AS entered_at_us,
  CASE WHEN event_id % 20 = 0 THEN NULL ELSE completed_at_us + 20000000 + (event_id % 1000) * 40000 END AS exited_at_us,
  lap_number AS entered_lap, CASE WHEN event_id % 20 = 0 THEN NULL ELSE lap_number END AS exited_lap,
  CASE WHEN event_id % 20 = 0 OR event_id % 28 = 0 THEN NULL ELSE 20000 + (event_id % 1000) * 40 END AS pit_lane_ms,
  event_id % 20 <> 0 AS completed
FROM fx_lap WHERE event_type = 'error' AND event_id % 4 = 0""",
    "fx_pit_early": """SELECT heat_id, participant_id, entered_at_us, exited_at_us, completed FROM fx_pit WHERE stop_number % 2 = 1""",
    "fx_pit_late": """SELECT heat_id, participant_id, entered_at_us - 36000000000 AS entered_at_us, exited_at_us - 36000000000 AS exited_at_us, completed FROM fx_pit WHERE stop_number % 2 = 0""",
    "fx_day": """SELECT DISTINCT CAST({us} - {us} % 86400000000 AS BIGINT) AS day_us, CAST(({us} - {us} % 86400000000) / 86400000000 AS BIGINT) AS d FROM events""",
    "fx_caution": """SELECT heat_id, CASE WHEN (d + heat_id) % 6 = 4 THEN 'FULL_COURSE_YELLOW' ELSE 'SAFETY_CAR' END AS flag,
  day_us + 72000000000 AS started_at_us, day_us + 75600000000 AS ended_at_us FROM fx_day CROSS JOIN fx_heat WHERE (d + heat_id) % 2 = 0""",
    "fx_flag": """SELECT heat_id, flag, started_at_us, ended_at_us FROM fx_caution
UNION ALL SELECT heat_id, 'GREEN', ended_at_us, lead(started_at_us) OVER (PARTITION BY heat_id ORDER BY started_at_us) FROM fx_caution
UNION ALL SELECT heat_id, 'GREEN', (SELECT min(day_us) FROM fx_day), min(started_at_us) FROM fx_caution GROUP BY heat_id""",
    "fx_feedgap": """SELECT heat_id, day_us + 10800000000 AS started_at_us, day_us + 12600000000 AS ended_at_us, 'reconnect' AS reason FROM fx_day CROSS JOIN fx_heat WHERE (d + heat_id) % 7 = 3""",
    "fx_state": """SELECT participant_id, event_id, lap_number, completed_at_us AS observed_at_us,
  CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'IN_PIT'
       WHEN lag(event_type) OVER (PARTITION BY participant_id ORDER BY lap_number) = 'error'
        AND lag(event_id) OVER (PARTITION BY participant_id ORDER BY lap_number) % 4 = 0 THEN 'OUT_LAP'
       ELSE 'ON_TRACK' END AS state_kind FROM fx_lap""",
    "fx_gap_sample": """SELECT participant_id AS focal_id, CASE WHEN participant_id % 2 = 0 THEN 'AHEAD' ELSE 'BEHIND' END AS relation,
  participant_id + 1 + CAST(floor(lap_number / 25.0) AS BIGINT) % 2 AS target_id, completed_at_us AS observed_at_us, duration_ms - 90000 AS gap_ms,
  lap_number AS our_lap, lap_number - CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS target_lap,
  CASE WHEN event_id % 41 = 0 THEN 'SAFETY_CAR' ELSE 'GREEN' END AS flag, event_id AS seq FROM fx_lap""",
    "fx_passing": """SELECT participant_id, event_id, completed_at_us - 946684800000000 + 10800000000 AS provider_us,
  CASE event_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN -1 ELSE 0 END AS sector_id,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1000000 * (event_id % 4) END AS start_mm, 4000000 AS stop_mm,
  event_id % 16 IN (8, 3) AS is_in_pit, 20000 + event_id % 50000 AS speed_mm_s FROM fx_lap""",
    "fx_clock": """SELECT CAST(({us} - {us} % 259200000000) / 259200000000 AS BIGINT) AS conn_id, event_id AS frame_id, {us} AS received_at_us,
  {us} - 946684800000000 + 10800000000 - (event_id % 1001) * 1000 AS provider_ts FROM events""",
    "fx_cell": """SELECT l_partkey % 4 AS heat_id, l_orderkey AS frame_id, l_linenumber AS message_ordinal, l_suppkey AS row_ix,
  l_linenumber AS col_ix, CAST(l_quantity AS BIGINT) AS value, CASE WHEN l_orderkey % 500 = 0 THEN 'r_i' ELSE 'r_c' END AS handle,
  l_partkey AS change_ordinal FROM lineitem""",
    "fx_identrow": """SELECT user_id % 3 AS heat_id, event_id AS frame_id, user_id AS row_ix, CASE WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 7 = 0 THEN ' 21' ELSE CAST(event_id % 7 AS {str}) END AS start_number,
  CASE WHEN event_id % 11 = 5 THEN NULL WHEN event_id % 7 = 0 AND event_id > 100 AND event_id % 9 = 4 THEN 'Other' WHEN event_id % 7 = 0 THEN 'Our  Team' ELSE concat('Team ', CAST(event_id % 7 AS {str})) END AS team_name,
  'GT' AS class_name FROM events""",
    # race control: braces stand as < and >, as in the grid feed
    "fx_boardpart": """SELECT conv_id % 20 AS heat_id, conv_id * 1000 + turn AS frame_id, turn, turn % 5 AS id, turn % 3 AS id_a, turn % 4 AS id_b,
  CASE WHEN (conv_id * 1000 + turn) % 29 = 28 THEN 'm_a' WHEN (conv_id + turn) % 7 = 6 THEN 'm_d' WHEN (conv_id + turn) % 5 = 4 THEN 'm_i' WHEN (conv_id + turn) % 31 = 30 THEN 'm_x' ELSE 'm_c' END AS handle FROM conversations""",
    "fx_boardmsg": """SELECT heat_id, frame_id, 0 AS message_ordinal, handle, translate(CASE handle WHEN 'm_a' THEN 'null' WHEN 'm_d' THEN concat('"', CAST(id AS {str}), '"')
  WHEN 'm_i' THEN concat('[<"Id": "', CAST(id_a AS {str}), '", "t": "a', CAST(frame_id AS {str}), '">, <"Id": "', CAST(id_b AS {str}), '", "t": "b", "m": ', CAST(turn AS {str}), '>', CASE WHEN frame_id % 3 = 0 THEN ', "x"]' ELSE ']' END)
  ELSE concat('<"Id": "', CAST(id AS {str}), '"', CASE WHEN frame_id % 3 = 1 THEN '' ELSE concat(', "t": "c', CAST(frame_id AS {str}), '"') END, CASE WHEN turn % 2 = 0 THEN concat(', "m": ', CAST(turn AS {str})) ELSE '' END, ', "l": 1>') END, '<>', concat(chr(123), chr(125))) AS payload FROM fx_boardpart""",
    # statistics patches: braces stand as < and >, as in the grid feed
    "fx_statpart": """SELECT user_id % 3 AS heat_id, event_id AS frame_id, event_id % 8 AS variant, user_id % 4 AS k, CAST(floor(value * 10) AS BIGINT) AS n,
  CASE WHEN event_id % 400 = 0 THEN 'a_i' WHEN event_id % 701 = 0 THEN 'a_r' ELSE 'a_u' END AS handle FROM events""",
    "fx_statmsg": """SELECT heat_id, frame_id, 0 AS message_ordinal, handle, translate(CASE
  WHEN handle = 'a_r' THEN '<>'
  WHEN variant = 0 THEN concat('<"p": ', CAST(n AS {str}), ', "o": ', CAST(n + 1 AS {str}), ', "h": "Race ', CAST(k AS {str}), '">')
  WHEN variant = 1 THEN concat('<"b": <"', CAST(k AS {str}), '": <"r": ', CAST(n AS {str}), ', "i": ', CAST(n * 1000 AS {str}), ', "d": "driver ', CAST(k AS {str}), '">>, "q": <"', CAST(k AS {str}), '": <"m": "class ', CAST(k % 2 AS {str}), '", "i": ', CAST(n * 1000 AS {str}), ', "s": "', CAST(k AS {str}), '">>>')
  WHEN variant = 2 THEN concat('<"b": <"', CAST(k AS {str}), '": <"i": ', CAST(n * 7 AS {str}), '>>, "bC": ', CAST(n AS {str}), '>')
  WHEN variant = 3 THEN concat('<"l": <"', CAST(k AS {str}), '": <"f": ', CAST(n AS {str}), ', "l": ', CAST(n AS {str}), ', "n": "team ', CAST(k AS {str}), '">>, "lC": ', CAST(n AS {str}), '>')
  WHEN variant = 4 AND n % 5 = 0 THEN concat('<"b": ', CAST(n AS {str}), '>')
  WHEN variant = 4 THEN concat('<"b": <"', CAST(k AS {str}), '": <"t": ', CAST(n AS {str}), '>>>')
  WHEN variant = 5 THEN concat('<"h": "Race ', CAST(n AS {str}), '", "x": "bad", "zz": 1>')
  WHEN variant = 6 THEN concat('<"d": <"', CAST(k AS {str}), '": <"e": ', CAST(n AS {str}), ', "n": "team ', CAST(k AS {str}), '">>, "d2": <"w": <"deep": <"er": ', CAST(n AS {str}), '>>>>')
  ELSE concat('<"c": ', CAST(n AS {str}), ', "fc": -1, "x": ', CAST(n AS {str}), ', "d": <"', CAST(k AS {str}), '": <"e": <"odd": ', CAST(n AS {str}), '>>>>') END, '<>', concat(chr(123), chr(125))) AS payload
FROM fx_statpart""",
    # the events on a clock that runs 3,600 times slower, for what counts in seconds
    "fx_tick": """SELECT user_id % 3 AS heat_id, user_id AS participant_id, event_id, 1704067200000000 + CAST(({us} - 1704067200000000 - ({us} - 1704067200000000) % 3600) / 3600 AS BIGINT) AS at_us,
  CAST(round(value * 100) AS BIGINT) * 10 AS ms, CAST(floor(value) AS BIGINT) % 3 AS value, event_type, CASE WHEN event_id > 5000 THEN 2 ELSE 1 END AS version FROM events""",
    "fx_gap_tick": """SELECT participant_id AS focal_id, CASE WHEN participant_id % 2 = 0 THEN 'AHEAD' ELSE 'BEHIND' END AS relation,
  participant_id + 1 + CAST(floor(row_number() OVER (PARTITION BY participant_id ORDER BY at_us, event_id) / 40.0) AS BIGINT) % 2 AS target_id, at_us AS observed_at_us, ms AS gap_ms,
  1 AS our_lap, CASE WHEN event_id % 37 = 0 THEN 2 ELSE 1 END AS target_lap, CASE WHEN event_id % 41 = 0 THEN 'SAFETY_CAR' ELSE 'GREEN' END AS flag, event_id AS seq FROM fx_tick""",
    # a grid feed: braces stand as < and > until they are put in place, since both engines' texts are formatted
    "fx_gridpart": """SELECT l_orderkey % 4 AS heat_id, CAST(floor(l_orderkey / 3000.0) AS BIGINT) AS conn_id, l_orderkey AS frame_id, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS message_ordinal,
  l_suppkey % 40 AS row_ix, CAST(l_linenumber % 6 AS BIGINT) AS col_ix, CAST(l_quantity AS BIGINT) AS value, CAST(floor(l_orderkey / 100.0) AS BIGINT) % 5 AS variant,
  CASE WHEN l_linenumber > 1 THEN 'r_c' WHEN l_orderkey % 5000 < 4 THEN 'r_i' WHEN l_orderkey % 700 BETWEEN 8 AND 11 THEN 'r_l' WHEN l_orderkey % 40 BETWEEN 20 AND 23 THEN 'r_d' ELSE 'r_c' END AS handle FROM lineitem""",
    "fx_gridlayout": """SELECT 0 AS variant, '<"h": [<"n": "NR">, <"n": "POS">, <"n": "LAPS">, <"n": "LAST">, <"n": "futureMetric", "p": "7">, <"n": "GAP">]>' AS layout
UNION ALL SELECT 1, '<"h": [<"n": "POS">, <"n": "NR">, <"n": "LAST">, <"n": "LAPS">, <"n": "futureMetric", "p": "7">]>'
UNION ALL SELECT 2, '<"l": <"h": ["NR", "LAPS", <"n": "lastRoundTime", "c": "LAST">, <"n": "x1", "c": "Gap">, "POS", <"n": "SectorTimes", "p": "1">]>>'
UNION ALL SELECT 3, '<"h": [<"n": "NR">, <"n": "startnumber">, <"n": "LAPS">]>'
UNION ALL SELECT 4, '<"h": [<"n": "LAST">, <"n": "futureMetric", "p": "7">, <"n": "NR">, <"n": "POS">, <"n": "GAP">, <"n": "LAPS">]>'""",
    "fx_gridmsg": """SELECT heat_id, conn_id, frame_id, message_ordinal, handle, translate(CASE handle WHEN 'r_l' THEN layout
  WHEN 'r_d' THEN concat('[[', CAST(row_ix AS {str}), '], [-1], ["x"]]')
  WHEN 'r_i' THEN concat('<', CASE WHEN frame_id % 3 = 0 THEN '' ELSE concat('"l": ', layout, ', ') END, '"r": [[', CAST(row_ix AS {str}), ', 0, "', CAST(value AS {str}), '"], [', CAST(row_ix + 1 AS {str}), ', 1, "', CAST(value + 1 AS {str}), '", "style"]]>')
  ELSE concat('[[', CAST(row_ix AS {str}), ', ', CAST(col_ix AS {str}), ', "', CAST(value AS {str}), '"], [-1, 2, "meta"], [3, 1]]') END, '<>', concat(chr(123), chr(125))) AS payload
FROM fx_gridpart p JOIN fx_gridlayout l ON l.variant = p.variant""",
    "fx_gaptext": """SELECT o_custkey % 20 AS heat_id, o_orderkey AS row_key,
  row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice DESC, o_orderkey) AS position,
  CASE WHEN o_orderkey % 9 = 0 OR row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice DESC, o_orderkey) = 1
       THEN concat('-- ', CAST(900 - row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice DESC, o_orderkey) AS {str}), ' laps --')
       WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'PIT'
       ELSE concat(CAST(o_orderkey % 7 AS {str}), ':', lpad(CAST(o_orderkey % 60 AS {str}), 2, '0'), '.', lpad(CAST(o_custkey % 1000 AS {str}), 3, '0')) END AS gap_text
FROM orders""",
    "fx_board": """SELECT conv_id AS heat_id, turn AS message_ordinal, turn % 4 AS message_id,
  CASE WHEN turn % 11 = 10 THEN 'CLEAR' WHEN turn % 7 = 6 THEN 'DELETE' ELSE 'UPSERT' END AS action,
  CASE WHEN turn % 3 = 0 THEN NULL ELSE text END AS text_patch, role AS modality_patch FROM conversations""",
    "fx_object": """SELECT concat(CASE doc_id % 4 WHEN 0 THEN 'stream_records' WHEN 1 THEN 'onboard_video' WHEN 2 THEN 'thumbnails' ELSE 'telemetry' END,
  '/2024-01-', lpad(CAST(doc_id % 28 + 1 AS {str}), 2, '0'), '/', source, '/', lang, '_', CASE doc_id % 3 WHEN 0 THEN 'race' WHEN 1 THEN 'qualif' ELSE 'practice' END,
  '_', CAST(doc_id AS {str}), CASE WHEN doc_id % 4 = 2 THEN '.jpg' ELSE '.mp4' END) AS object_key, n_chars AS size, doc_id FROM documents""",
    "fx_frame": """SELECT event_id AS frame_id, CAST(({us} - {us} % 259200000000) / 259200000000 AS BIGINT) AS conn_id, {us} AS received_at_us,
  CASE WHEN event_id % 53 = 0 THEN 'not-json' ELSE props END AS raw,
  CASE event_type WHEN 'click' THEN 'r_c' WHEN 'view' THEN 't_p' WHEN 'signup' THEN 'h_h' WHEN 'purchase' THEN 's_t' ELSE 't_q' END AS handle FROM events""",
}


def needed(sql: str) -> list[str]:
    """The fixture views that a text uses, those they use first."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name in VIEWS and name not in out:
                add(VIEWS[name])
                out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """A query for another engine: the views it needs as common table expressions before it."""
    recursive = sql.strip().startswith("RECURSIVE ")
    sql = sql.strip().removeprefix("RECURSIVE ")
    views = [f"{name} AS ({VIEWS[name].format(us='epoch_us(ts)', str='VARCHAR')})" for name in needed(sql)]
    body = sql.strip()
    if not views:
        return body if body.upper().startswith("SELECT") else f"WITH {body}"
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(views) + ("\n" if body.upper().startswith("SELECT") else ",\n") + body


class Fixture:
    """The canonical tables of one data folder: `fx.lap`, `fx.pit`, ... and the driver's own tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str, by_user: bool = False):
        self.spark, self.sf_dir, self.by_user, self.schemas = spark, sf_dir, by_user, {}

    def dealt(self) -> Fixture:
        """The same tables, for long work on laps: events are dealt by user among many tasks, which all windows over a user's laps keep."""
        out = Fixture(self.spark, self.sf_dir, True)
        out.parts = self.parts
        return out

    @cached_property
    def parts(self) -> int:
        """Tasks for long work on laps; they follow the rows of events, whose count stands in the file's footers."""
        return parts_of(self.events.count())

    def table(self, name: str) -> DataFrame:
        """A table of the folder; its schema is looked up once, while each use is a relation of its own."""
        path = f"{self.sf_dir}/{name}.parquet"
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        view = f"fx_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        ctes = [f"{v} AS ({VIEWS[v].format(us='unix_micros(CAST(ts AS TIMESTAMP))', str='STRING')})" for v in needed(view)]
        text = "WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {view}"
        used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]
        for t in used:
            text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
        dealt = lambda t: self.table(t).repartition(self.parts, "user_id") if self.by_user and t == "events" else self.table(t)
        return self.spark.sql(text, **{t: dealt(t) for t in used})
