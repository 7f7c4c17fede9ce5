"""Freshness by processing-time timers, which speak when no row comes; `history.freshness_changes` is the batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stintline.operators.history import LIVE_US, STALE_US

CHANGE = "session_id long, at_us long, status string, reason string"


class Freshness(StatefulProcessor):
    """Newest tick, open gap, flag and lifecycle of a session, and a timer for each of the two ages at which it turns."""

    def __init__(self, live_us: int = LIVE_US, stale_us: int = STALE_US):
        self.live_us, self.stale_us = live_us, stale_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "seen_us long, gap string, flag string, lifecycle string, told string")

    def _told(self, key, state: dict, at_us: int) -> list[tuple]:
        age = None if state["seen_us"] is None else max(0, at_us - state["seen_us"])
        if state["lifecycle"] in ("stopped", "aborted"):
            reason = f"session_{state['lifecycle']}"
        elif state["flag"] == "FINISH":
            reason = "track_finished"
        elif state["gap"] == "OPEN":
            reason = "source_gap"
        elif age is None:
            reason = "no_state_tick"
        else:
            reason = "fresh" if age <= self.live_us else "stale" if age <= self.stale_us else "source_timeout"
        changed = reason != state["told"]
        state["told"] = reason
        self.now.update(tuple(state.values()))
        return [(key[0], at_us, {"fresh": "LIVE", "stale": "STALE"}.get(reason, "OFFLINE"), reason)] if changed else []

    def _state(self) -> dict:
        found = self.now.get() if self.now.exists() else (None,) * 5
        return dict(zip(("seen_us", "gap", "flag", "lifecycle", "told"), found, strict=True))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "at_us", "status", "reason"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, clock = self._state(), timerValues.getCurrentProcessingTimeInMs() * 1000
        for r in pd.concat(list(rows)).sort_values(["at_us", "seq"]).itertuples():
            if r.kind == "tick":
                state["seen_us"] = max(int(r.at_us), state["seen_us"] or 0)
            else:
                state[r.kind] = r.value
        told = self._told(key, state, clock)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if state["seen_us"] is not None:
            for limit in (self.live_us, self.stale_us):
                due = (state["seen_us"] + limit) // 1000 + 1
                if due * 1000 > clock:
                    self.handle.registerTimer(due)
        yield self._frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._told(key, self._state(), expiredTimerInfo.getExpiryTimeInMs() * 1000))

    def close(self) -> None:
        pass


def freshness(events: DataFrame, live_us: int = LIVE_US, stale_us: int = STALE_US) -> DataFrame:
    """Changes of status over a stream of (session_id, at_us, seq, kind, value), by events and by the clock."""
    return events.groupBy("session_id").transformWithStateInPandas(Freshness(live_us, stale_us), CHANGE, "append", "processingTime")
