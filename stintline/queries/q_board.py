"""The race-control board from its messages."""

from stintline.operators import board
from stintline.queries.registry import query

_OPS = """ops AS (
  SELECT heat_id, frame_id, frame_id * 10 AS r, 'UPSERT' AS action, id, CASE WHEN frame_id % 3 <> 1 THEN 'c' || frame_id END AS text, CASE WHEN turn % 2 = 0 THEN turn END AS modality, 1 AS line FROM fx_boardpart WHERE handle = 'm_c'
  UNION ALL SELECT heat_id, frame_id, frame_id * 10 + 2, 'INITIAL_SNAPSHOT', id_a, 'a' || frame_id, NULL, NULL FROM fx_boardpart WHERE handle = 'm_i'
  UNION ALL SELECT heat_id, frame_id, frame_id * 10 + 1, 'INITIAL_SNAPSHOT', id_b, 'b', turn, NULL FROM fx_boardpart WHERE handle = 'm_i'),
ends AS (
  SELECT heat_id, frame_id, frame_id * 10 AS r, CASE handle WHEN 'm_a' THEN 'CLEAR' WHEN 'm_d' THEN 'DELETE' ELSE 'SNAPSHOT_ABSENCE' END AS off, CASE WHEN handle = 'm_d' THEN id END AS id
  FROM fx_boardpart WHERE handle IN ('m_a', 'm_d') OR (handle = 'm_i' AND frame_id % 3 <> 0)),
now AS (
  SELECT heat_id, id, arg_max(text, r) FILTER (text IS NOT NULL) AS text, arg_max(line, r) FILTER (line IS NOT NULL) AS line, arg_max(modality, r) FILTER (modality IS NOT NULL) AS modality,
    min(frame_id) AS first_frame, max(r) AS r, max(frame_id) AS last_frame, arg_max(action, r) AS last_action FROM ops GROUP BY 1, 2)"""


@query(
    "s21_board_state",
    _OPS + """
SELECT n.heat_id, CAST(n.id AS VARCHAR) AS message_id, any_value(n.text) AS text, CAST(any_value(n.line) AS BIGINT) AS line, CAST(any_value(n.modality) AS BIGINT) AS modality, count(e.r) = 0 AS is_active, any_value(n.first_frame) AS first_frame,
  any_value(n.last_action) AS last_action, any_value(n.last_frame) AS last_frame, min(e.frame_id) AS removed_frame, arg_min(e.off, e.r) AS removal_action
FROM now n LEFT JOIN ends e ON e.heat_id = n.heat_id AND e.r > n.r AND (e.id IS NULL OR e.id = n.id) GROUP BY n.heat_id, n.id""",
)
def s21_state(fx):
    return board.board(board.observations(fx.boardmsg)).drop("background_color", "font_color")
