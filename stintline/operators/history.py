"""Sparse history, values of some time ago, freshness over time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a history bucket, and the ages up to which a source is LIVE and STALE.
BUCKET_US, SECOND_US = 5_000_000, 1_000_000
LIVE_US, STALE_US = 3_000_000, 10_000_000
POINT = "scope_key long, second long, at_us long, seq long, value long, version long"


class Kept:
    """The points of one scope that are kept, in time order: at most one a second, of which the newest wins.

    A point is kept if its value or version differs from the one before, and if it is an event, lies in a later bucket
    or has another version. Only the last two kept points matter for the next.
    """

    def __init__(self, last: tuple | None = None, prior: tuple | None = None):
        self.last, self.prior = last, prior

    def take(self, at_us: int, seq: int, value, version: int, is_event: bool) -> str | None:
        """`insert`, `update` (of the same second) or None; points out of order are left out."""
        second = at_us // SECOND_US
        if self.last and (at_us, seq) <= self.last[1:3]:
            return None
        same = self.last is not None and self.last[0] == second
        before = self.prior if same else self.last
        like = self.last if same else before
        if like and (like[3], like[4]) == (value, version):
            return None
        periodic = before is None or at_us // BUCKET_US > before[1] // BUCKET_US
        if not (is_event or periodic or before[4] != version):
            return None
        if not same:
            self.prior = self.last
        self.last = (second, at_us, seq, value, version)
        return "update" if same else "insert"


def sparse_history(points: DataFrame) -> DataFrame:
    """of points (scope_key, at_us, seq, value, version, is_event) those that history keeps.

    Whether a point stays depends on the last one that stayed, so each scope is read once in order; a task holds two
    points at a time, however long the scope.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, kept = None, Kept()
        for rows in frames:
            out = []
            for r in rows.itertuples(index=False):
                if r.scope_key != scope:
                    if kept.last:
                        out.append((scope, *kept.last))
                    scope, kept = r.scope_key, Kept()
                before = kept.last
                if kept.take(r.at_us, r.seq, r.value, r.version, r.is_event) == "insert" and before:
                    out.append((scope, *before))
            yield pd.DataFrame(out, columns=["scope_key", "second", "at_us", "seq", "value", "version"])
        if kept.last:
            yield pd.DataFrame([(scope, *kept.last)], columns=["scope_key", "second", "at_us", "seq", "value", "version"])

    rows = points.where("scope_key is not null").select("scope_key", "at_us", "seq", "value", "version", "is_event")
    return rows.repartition("scope_key").sortWithinPartitions("scope_key", "at_us", "seq").mapInPandas(fold, POINT)


def value_ago(rows: DataFrame, by: list[str], at: str, value: str, ago_us: int, tail_us: int | None = None, live: Column | None = None) -> Column:
    """the newest value at or before `ago_us` before a row, within the tail; NULL unless all rows from then on are `live`."""
    order = Window.partitionBy(*by).orderBy(at)
    frame = order.rangeBetween(-tail_us if tail_us else Window.unboundedPreceding, -ago_us)
    found = F.max(F.struct(at, value)).over(frame)
    if live is None:
        return found[value]
    off = F.max(F.when(~F.coalesce(live, F.lit(False)), F.col(at))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(off.isNull() | (off < found[at]), found[value])


def freshness_changes(events: DataFrame, until_us: Column, live_us: int = LIVE_US, stale_us: int = STALE_US) -> DataFrame:
    """When a source turned LIVE, STALE or OFFLINE, also by the clock alone.

    events: (session_id, at_us, seq, kind, value) with kind `tick`, `gap` (value OPEN or CLOSED), `flag` or `lifecycle`.
    Beside the events themselves the two instants after each tick at which it ages are looked at, up to `until_us`.
    """
    own = events.select("session_id", "at_us", F.lit(0).alias("turn"), "seq", "kind", "value")
    tick = events.where("kind = 'tick'")
    aged = tick.select("session_id", F.explode(F.array(F.col("at_us") + live_us + 1, F.col("at_us") + stale_us + 1)).alias("at_us"), F.lit(1).alias("turn"), "seq", F.lit("clock").alias("kind"), F.lit(None).cast("string").alias("value"))
    w = Window.partitionBy("session_id").orderBy("at_us", "turn", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = own.unionByName(aged.where(F.col("at_us") <= until_us))
    latest = lambda kind, x: F.last(F.when(F.col("kind") == kind, x), ignorenulls=True).over(so_far)
    rows = rows.select("session_id", "at_us", "turn", "seq", *[latest(k, F.col("value")).alias(k) for k in ("gap", "flag", "lifecycle")], latest("tick", F.col("at_us")).alias("seen_us"))
    age = F.col("at_us") - F.col("seen_us")
    status = freshness_status(age, F.col("gap"), F.col("flag"), F.col("lifecycle"), live_us, stale_us)
    rows = rows.withColumns({"status": status[0], "reason": status[1]})
    rows = rows.withColumn("before", F.lag(F.concat_ws(":", "status", "reason")).over(w))
    changed = F.col("before").isNull() | (F.col("before") != F.concat_ws(":", "status", "reason"))
    return rows.where(changed).select("session_id", "at_us", "status", "reason")


def freshness_status(age_us: Column, gap: Column, flag: Column, lifecycle: Column, live_us: int = LIVE_US, stale_us: int = STALE_US) -> tuple[Column, Column]:
    """Status and reason of a source."""
    stopped = F.coalesce(lifecycle.isin("stopped", "aborted"), F.lit(False))
    reason = (
        F.when(stopped, F.concat(F.lit("session_"), lifecycle))
        .when(flag == "FINISH", "track_finished")
        .when(gap == "OPEN", "source_gap")
        .when(age_us.isNull(), "no_state_tick")
        .when(age_us <= live_us, "fresh")
        .when(age_us <= stale_us, "stale")
        .otherwise("source_timeout")
    )
    status = F.when(reason == "fresh", "LIVE").when(reason == "stale", "STALE").otherwise("OFFLINE")
    return status, reason
