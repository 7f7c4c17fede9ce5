"""Queries over the provider's dynamic grid: cells, layouts, schema baselines."""

from stintline.operators import grid
from stintline.queries.registry import query

#: What the fixture's layouts mean, written out: (variant, column, name, parameter, key).
_LAYOUT = """lay(variant, ix, name, parameter, k) AS (VALUES
  (0, 0, 'NR', NULL, 'start_number'), (0, 1, 'POS', NULL, 'position_overall'), (0, 2, 'LAPS', NULL, 'laps'), (0, 3, 'LAST', NULL, 'last_lap'), (0, 4, 'futureMetric', '7', NULL), (0, 5, 'GAP', NULL, 'gap'),
  (1, 0, 'POS', NULL, 'position_overall'), (1, 1, 'NR', NULL, 'start_number'), (1, 2, 'LAST', NULL, 'last_lap'), (1, 3, 'LAPS', NULL, 'laps'), (1, 4, 'futureMetric', '7', NULL),
  (2, 0, 'NR', NULL, 'start_number'), (2, 1, 'LAPS', NULL, 'laps'), (2, 2, 'lastRoundTime', NULL, 'last_lap'), (2, 3, 'x1', NULL, 'gap'), (2, 4, 'POS', NULL, 'position_overall'), (2, 5, 'SectorTimes', '1', 'sector_1'),
  (3, 0, 'NR', NULL, 'start_number'), (3, 1, 'startnumber', NULL, 'start_number'), (3, 2, 'LAPS', NULL, 'laps'),
  (4, 0, 'LAST', NULL, 'last_lap'), (4, 1, 'futureMetric', '7', NULL), (4, 2, 'NR', NULL, 'start_number'), (4, 3, 'POS', NULL, 'position_overall'), (4, 4, 'GAP', NULL, 'gap'), (4, 5, 'LAPS', NULL, 'laps')),
shown AS (SELECT *, coalesce(k, 'unknown:' || name || ':' || coalesce(parameter, '')) AS s FROM lay),
part AS (SELECT *, frame_id * 10000000000 + message_ordinal AS r FROM fx_gridpart),
ev AS (
  SELECT heat_id, conn_id, frame_id, message_ordinal, r, handle, has, variant, sum(CAST(has AS INT)) OVER (PARTITION BY heat_id ORDER BY r) AS gen,
    last_value(CASE WHEN has THEN variant END IGNORE NULLS) OVER (PARTITION BY heat_id ORDER BY r) AS now
  FROM (SELECT *, handle = 'r_l' OR frame_id % 3 <> 0 AS has FROM part WHERE handle IN ('r_i', 'r_l'))),
cells AS (
  SELECT heat_id, conn_id, frame_id, message_ordinal, r, handle, 0 AS change, row_ix, col_ix, value FROM part WHERE handle = 'r_c'
  UNION ALL SELECT heat_id, conn_id, frame_id, message_ordinal, r, handle, 0, row_ix, 0, value FROM part WHERE handle = 'r_i'
  UNION ALL SELECT heat_id, conn_id, frame_id, message_ordinal, r, handle, 1, row_ix + 1, 1, value + 1 FROM part WHERE handle = 'r_i'),
placed AS (SELECT c.*, e.gen, e.now FROM cells c ASOF JOIN ev e ON c.heat_id = e.heat_id AND c.r >= e.r)"""


def messages(fx):
    """The fixture is one file, read by one task; messages are dealt out as those of a bronze folder are."""
    return fx.gridmsg.repartition("heat_id", "frame_id")


@query(
    "s1_grid_current",
    _LAYOUT + """
, named AS (SELECT p.*, s.s FROM placed p LEFT JOIN shown s ON s.variant = p.now AND s.ix = p.col_ix WHERE p.gen > 0 AND p.now <> 3)
SELECT heat_id, row_ix, coalesce(s, 'column_' || col_ix) AS key, CAST(arg_max(value, r * 10 + change) AS VARCHAR) AS value, arg_max(frame_id, r * 10 + change) AS frame_id, arg_max(message_ordinal, r * 10 + change) AS message_ordinal
FROM named n
WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.heat_id = n.heat_id AND e.r > n.r AND (e.handle = 'r_i' OR (e.has AND e.variant = 3)))
  AND NOT EXISTS (SELECT 1 FROM part d WHERE d.handle = 'r_d' AND d.heat_id = n.heat_id AND d.row_ix = n.row_ix AND d.r > n.r)
  AND NOT EXISTS (SELECT 1 FROM ev e LEFT JOIN shown s ON s.variant = e.variant WHERE e.has AND e.heat_id = n.heat_id AND e.gen > n.gen GROUP BY e.gen HAVING count(*) FILTER (s.s IS NOT DISTINCT FROM n.s AND n.s IS NOT NULL) <> 1)
GROUP BY 1, 2, 3""",
)
def s1(fx):
    return grid.grid_as_of(messages(fx)).select("heat_id", "row_ix", "key", "value", "frame_id", "message_ordinal")


@query(
    "d21_schema_baseline",
    _LAYOUT + """
SELECT heat_id, conn_id, frame_id, message_ordinal, row_ix, col_ix, gen IS NOT NULL AND gen > 0 AND now <> 3
  AND EXISTS (SELECT 1 FROM ev e WHERE e.heat_id = c.heat_id AND e.conn_id = c.conn_id AND e.gen = c.gen AND e.r < c.r) AS trusted
FROM (SELECT c.*, e.gen, e.now FROM cells c ASOF LEFT JOIN ev e ON c.heat_id = e.heat_id AND c.r >= e.r) c WHERE handle = 'r_c'""",
)
def d21(fx):
    return grid.trusted_changes(messages(fx)).select("heat_id", "conn_id", "frame_id", "message_ordinal", "row_ix", "col_ix", "trusted")


@query(
    "s2_layout_contract",
    _LAYOUT + """
, bound(k, wire, parameter, required) AS (VALUES
  ('position_overall', 'position', NULL, true), ('start_number', 'startnumber', NULL, true), ('state', 'state', NULL, true), ('team_name', 'teamname', NULL, true), ('current_driver', 'currentdriver', NULL, true),
  ('class_name', 'class', NULL, true), ('position_class', 'positioninclass', NULL, true), ('gap', 'hole', NULL, true), ('best_lap', 'fastestroundtime', NULL, true), ('last_lap', 'lastroundtime', NULL, true),
  ('driver_stint', 'currentdriverstinttime', NULL, true), ('pit_time', 'pittime', NULL, true), ('pit_stops', 'pitstops', NULL, true), ('sector_1', 'sectortimes', '1', true), ('sector_2', 'sectortimes', '2', true), ('sector_3', 'sectortimes', '3', true),
  ('car_name', 'car', NULL, false), ('laps', 'laps', NULL, false), ('diff', 'diff', NULL, false), ('section_marker', 'sectionmarker', NULL, false)),
fit AS (
  SELECT v.variant, b.k, b.required, count(l.k) AS n, count(*) FILTER (lower(l.name) = b.wire AND l.parameter IS NOT DISTINCT FROM b.parameter) AS exact
  FROM (SELECT DISTINCT variant FROM lay) v CROSS JOIN bound b LEFT JOIN lay l ON l.variant = v.variant AND l.k = b.k GROUP BY 1, 2, 3),
told AS (SELECT variant, coalesce(string_agg(k, ',' ORDER BY k) FILTER (required AND exact = 0), '') AS missing, coalesce(string_agg(k, ',' ORDER BY k) FILTER (n > 0 AND (n <> 1 OR exact <> 1)), '') AS mismatched FROM fit GROUP BY 1),
own AS (SELECT variant, count(*) AS columns, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') AS present, coalesce(string_agg(DISTINCT CASE WHEN k IS NULL THEN name END, ',' ORDER BY CASE WHEN k IS NULL THEN name END), '') AS unknown FROM lay GROUP BY 1),
ver AS (SELECT heat_id, variant, min(r) AS r, arg_min(frame_id, r) AS frame_id, arg_min(message_ordinal, r) AS message_ordinal, arg_min(gen, r) AS generation FROM ev WHERE has GROUP BY 1, 2)
SELECT heat_id, row_number() OVER (PARTITION BY heat_id ORDER BY r) - 1 AS version, frame_id, message_ordinal, CAST(generation AS BIGINT) AS generation, variant = 3 AS ambiguous, columns, present, missing, mismatched, unknown,
  CASE WHEN missing = '' AND mismatched = '' THEN 'CURRENT' ELSE 'DEGRADED' END AS status
FROM ver JOIN told USING (variant) JOIN own USING (variant)""",
)
def s2(fx):
    return grid.schema_contract(grid.layout_versions(messages(fx)))
