"""The dynamic grid as a stateful stream; `grid.grid_as_of` is its batch twin."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stintline.operators.grid import RANK, parsed

CHANGE = "heat_id long, row_ix long, key string, value string, live boolean, frame_id long, message_ordinal long, change_ordinal long"


class DynamicGrid(StatefulProcessor):
    """Cells of a heat by row and the identity of their column, and the layout in force.

    Messages at or before the last one taken are left out, so a batch that is read again changes nothing. A cell that
    goes is told with `live` false, under the rank of the message that ended it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "row_ix long, identity string", "key string")
        self.layout = handle.getValueState("layout", "columns string, ready boolean, frame_id long, message_ordinal long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, ready, *last = self.layout.get() if self.layout.exists() else (None, False, -1, -1)
        columns, last, told = self._columns(text), tuple(last), {}
        held = {tuple(place): shown[0] for place, shown in self.cells.iterator()}
        before = dict(held)

        def end(place, rank) -> None:
            told[place[0], held.pop(place)] = (None, False, *rank, -1)

        for m in pd.concat(list(rows)).sort_values(["frame_id", "message_ordinal"]).itertuples():
            rank = (int(m.frame_id), int(m.message_ordinal))
            if rank <= last:
                continue
            last = rank
            if m.handle == "r_i":
                for place in list(held):
                    end(place, rank)
            if isinstance(m.columns_json, str):
                text, columns, ready = m.columns_json, self._columns(m.columns_json), not m.ambiguous
                found = [identity for identity, _ in columns.values()]
                for place in [p for p in held if not ready or found.count(p[1]) != 1]:
                    end(place, rank)
            for row in json.loads(m.dropped_json) if isinstance(m.dropped_json, str) else ():
                for place in [p for p in held if p[0] == row]:
                    end(place, rank)
            for c in json.loads(m.cells_json) if ready and isinstance(m.cells_json, str) else ():
                identity, shown = columns.get(c["col_ix"], (f"#{c['col_ix']}", f"column_{c['col_ix']}"))
                held[c["row_ix"], identity] = shown
                told[c["row_ix"], shown] = (c.get("value"), True, *rank, c["change_ordinal"])
        for place in before.keys() - held.keys():
            self.cells.removeKey(place)
        for place in held.keys() - before.keys():
            self.cells.updateValue(place, (held[place],))
        if last > (-1, -1):
            self.layout.update((text, bool(ready), *last))
        yield pd.DataFrame([(key[0], *place, *change) for place, change in told.items()], columns=["heat_id", "row_ix", "key", "value", "live", *RANK])

    @staticmethod
    def _columns(text: str | None) -> dict[int, tuple[str, str]]:
        out = {}
        for c in json.loads(text) if text else ():
            name, parameter = c.get("name", ""), c.get("parameter")
            known = c.get("key")
            out[c["ix"]] = (known, known) if known else (json.dumps([name, parameter]), f"unknown:{name}:{parameter or ''}")
        return out

    def close(self) -> None:
        pass


def grid_changes(message: DataFrame) -> DataFrame:
    """Changes of the grid of each heat, from a stream of messages."""
    rows = parsed(message).select("heat_id", "frame_id", "message_ordinal", "handle", "ambiguous", F.to_json("columns").alias("columns_json"), F.to_json("cells").alias("cells_json"), F.to_json("dropped").alias("dropped_json"))
    return rows.groupBy("heat_id").transformWithStateInPandas(DynamicGrid(), CHANGE, "append", "none")


def current(changes: DataFrame) -> DataFrame:
    """The grid after all changes told so far: of each cell the newest, if it lives."""
    newest = changes.groupBy("heat_id", "row_ix", "key").agg(F.max_by(F.struct("value", "live", *RANK), F.struct(*RANK)).alias("x"))
    return newest.select("heat_id", "row_ix", "key", "x.*").where("live").drop("live")
