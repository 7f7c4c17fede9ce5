"""All registered queries."""

from stintline.queries import q_battle, q_board, q_facts, q_grid, q_laps, q_plans, q_scalars, q_statistics, q_streams
from stintline.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "q_battle", "q_board", "q_facts", "q_grid", "q_laps", "q_plans", "q_scalars", "q_statistics", "q_streams"]
