"""Which participant a row of the grid belongs to, told from those seen before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.functions.scalars import norm_key

FIELDS = ("start_number", "team_name", "class_name")
#: In the place of a class: any.
ANY = object()
RESOLVED = "heat_id long, frame_id long, row_ix long, external_key string, is_ours boolean, start_number string, team_name string, class_name string"


class Roster:
    """The participants of a heat seen so far, by key: number, team, class and ours; and the keys of each team and class, the one seen last at the end."""

    def __init__(self, ours_number: str, ours_team: str):
        self.ours_number, self.ours_team = ours_number, ours_team
        self.known: dict[str, tuple] = {}
        self.of_team: dict[tuple, dict[str, None]] = {}
        self.as_ours: set[str] = set()

    def _seats(self, p: tuple) -> list[tuple]:
        """Where a participant is looked for: team and class, or team alone, each by ours."""
        return [(p[1], p[2], p[3]), (p[1], ANY, p[3])] if p[1] is not None else []

    def _last(self, team: str, klass: str | None) -> str | None:
        for ours in (True, False):
            keys = self.of_team.get((team, ANY if klass is None else klass, ours))
            if keys:
                return next(reversed(keys))
        return None

    def take(self, row_ix: int, number: str | None, team: str | None, klass: str | None) -> tuple:
        """(key, ours, number, team, class): the row's own fields, else those last seen of its participant.

        A number names the participant. Without one, a team (and class) that is known does, ours before others, then
        the one seen last. Our number with another team is a conflict, once we have been seen. A row takes the same
        time, however many participants there are.
        """
        conflict = number == self.ours_number and team not in (None, self.ours_team) and bool(self.as_ours)
        like = self._last(team, klass) if number is None and team is not None else None
        if conflict:
            key = f"conflict:nr:{number}:team:{team}"
        elif like is not None:
            key = like
        else:
            key = f"nr:{number}" if number else f"team:{team}:class:{klass or ''}" if team else f"row:{row_ix}"
        ours = not conflict and (team == self.ours_team or (team is None and number == self.ours_number))
        held = self.known.get(key)
        for seat in self._seats(held) if held else ():
            del self.of_team[seat][key]
        new = (*[x if x is not None else old for x, old in zip((number, team, klass), held or (None,) * 3, strict=False)], ours)
        self.known[key] = new
        for seat in self._seats(new):
            self.of_team.setdefault(seat, {})[key] = None
        if new[0] == self.ours_number and new[1] == self.ours_team and ours:
            self.as_ours.add(key)
        else:
            self.as_ours.discard(key)
        return (key, ours, *new[:3])


def resolve(rows: DataFrame, ours_number: str, ours_team: str) -> DataFrame:
    """(external_key, is_ours) of grid rows (heat_id, frame_id, row_ix, start_number, team_name, class_name), in source order.

    Each row depends on those before it, so a heat is read once in order; a task holds the participants of one heat.
    """
    number, team = ours_number.strip().lower(), " ".join(ours_team.lower().split())

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heat, roster = None, Roster(number, team)
        for part in frames:
            out = []
            for r in zip(*[part[c].tolist() for c in part.columns], strict=True):
                if r[0] != heat:
                    heat, roster = r[0], Roster(number, team)
                own = [x if isinstance(x, str) else None for x in r[3:]]
                out.append((*r[:3], *roster.take(r[2], *own)))
            yield pd.DataFrame(out, columns=["heat_id", "frame_id", "row_ix", "external_key", "is_ours", *FIELDS])

    plain = rows.select("heat_id", "frame_id", "row_ix", *[norm_key(F.col(c)).alias(c) for c in FIELDS])
    return plain.repartition("heat_id").sortWithinPartitions("heat_id", "frame_id", "row_ix").mapInPandas(fold, RESOLVED)
