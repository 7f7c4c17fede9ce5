"""Operational jobs on the stored data: health, incidents, retention, rebuild, recordings catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reconnects within the window that warn, and that are critical.
RECONNECT_WARNING, RECONNECT_CRITICAL = 4, 10


def health_alerts(frame: DataFrame, reconnect: DataFrame, known_handles: DataFrame) -> DataFrame:
    """(scope_key, code, severity, fact) of each connection: failed frames, reconnect storms, unknown handles."""
    failed = frame.where("decode_state = 'failed'").groupBy(F.col("conn_id").alias("scope_key")).agg(F.count("*").alias("fact")).select("scope_key", F.lit("FRAME_DECODE_FAILURE").alias("code"), F.lit("CRITICAL").alias("severity"), "fact")
    storm = reconnect.where(F.col("reconnects") >= RECONNECT_WARNING).select("scope_key", F.lit("RECONNECT_STORM").alias("code"), F.when(F.col("reconnects") >= RECONNECT_CRITICAL, "CRITICAL").otherwise("WARNING").alias("severity"), F.col("reconnects").alias("fact"))
    unknown = frame.join(F.broadcast(known_handles), "handle", "left_anti").groupBy(F.col("conn_id").alias("scope_key")).agg(F.count("*").alias("fact")).select("scope_key", F.lit("UNKNOWN_SOURCE_HANDLE").alias("code"), F.lit("WARNING").alias("severity"), "fact")
    return failed.unionByName(storm).unionByName(unknown)


def health_summary(alerts: DataFrame) -> DataFrame:
    """HEALTHY, DEGRADED or CRITICAL per scope."""
    worst = F.max(F.when(F.col("severity") == "CRITICAL", 2).otherwise(1))
    return alerts.groupBy("scope_key").agg(F.when(worst == 2, "CRITICAL").when(worst == 1, "DEGRADED").otherwise("HEALTHY").alias("status"), F.count("*").alias("alerts"))


def reconcile_incidents(open_incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """Transitions per (code, scope): OPENED, ESCALATED, DEESCALATED, RESOLVED, or unchanged."""
    rank = lambda s: F.when(s == "CRITICAL", 2).when(s == "WARNING", 1)
    a = alerts.select("code", "scope_key", rank(F.col("severity")).alias("now"))
    o = open_incidents.select("code", "scope_key", rank(F.col("severity")).alias("was"), "occurrences")
    both = a.join(o, ["code", "scope_key"], "full")
    kind = F.when(F.col("was").isNull(), "OPENED").when(F.col("now").isNull(), "RESOLVED").when(F.col("now") > F.col("was"), "ESCALATED").when(F.col("now") < F.col("was"), "DEESCALATED").otherwise("UNCHANGED")
    return both.select("code", "scope_key", kind.alias("transition"), (F.coalesce("occurrences", F.lit(0)) + F.col("now").isNotNull().cast("int")).cast("long").alias("occurrences"))


def retention_plan(frame: DataFrame, session: DataFrame, now_us: int, days: int = 7) -> DataFrame:
    """Raw frames older than `days`, only of stopped sessions that have a later keyframe."""
    safe = session.where("lifecycle = 'stopped' and last_keyframe_us is not null").select("conn_id", "last_keyframe_us")
    old = frame.where(F.col("received_at_us") < now_us - days * 86_400_000_000)
    return old.join(safe, "conn_id").where("received_at_us <= last_keyframe_us").select("conn_id", "frame_id")


def rebuild_plan(session: DataFrame, frame: DataFrame) -> DataFrame:
    """P5: what blocks a rebuild of each session."""
    seen = frame.groupBy("conn_id").agg(F.count_if(F.col("decode_state") == "failed").alias("failed"), F.count_if(F.col("decode_state") == "decoded").alias("decoded"))
    rows = session.join(seen, "conn_id", "left")
    why = F.filter(
        F.array(
            F.when(F.col("lifecycle") != "stopped", "NOT_STOPPED"),
            F.when(F.coalesce("failed", F.lit(0)) > 0, "FAILED_FRAMES"),
            F.when(F.coalesce("decoded", F.lit(0)) == 0, "NO_DECODED_FRAMES"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("conn_id", F.array_join(why, ",").alias("blocked_by"), (F.size(why) == 0).alias("ready"))


def group_recordings(part: DataFrame, grouped: DataFrame, now_us: int, idle_us: int, tiny: int = 512 * 1024) -> DataFrame:
    """Groups of recordings; ready when the last end is older than the idle gap and no part is busy."""
    return grouped.groupBy("source", "island").agg(F.count("*").alias("parts"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"), F.count_if(F.col("size") < tiny).alias("tiny_parts"), ((F.max("end_us") < now_us - idle_us) & ~F.bool_or("busy")).alias("ready"))


def index_catalogue(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Upsert of listed objects; edited entries keep their own fields and take size only."""
    return listing.join(catalogue, "object_key", "full").select(
        "object_key",
        F.when(F.col("edited"), F.col("old_title")).otherwise(F.coalesce("title", "old_title")).alias("title"),
        F.coalesce("size", "old_size").alias("size"),
        F.coalesce("edited", F.lit(False)).alias("edited"),
    )


def enrich_objects(video: DataFrame, annotation: DataFrame, thumb: DataFrame, related: DataFrame) -> DataFrame:
    """Annotation by exact key, else by date and code; thumbnail by path; related files by date and slug."""
    exact = annotation.select("object_key", F.col("note").alias("by_key"))
    coded = annotation.where("code <> ''").groupBy("date", "code").agg(F.min("note").alias("by_code"))
    others = related.groupBy("date", "slug").agg(F.count("*").alias("related_files"), F.sum("size").alias("related_bytes"))
    rows = video.join(exact, "object_key", "left").join(coded, ["date", "code"], "left").join(thumb.withColumn("has_thumb", F.lit(True)), "doc_id", "left").join(others, ["date", "slug"], "left")
    return rows.select("object_key", F.coalesce("by_key", F.when(F.col("code") != "", F.col("by_code"))).alias("note"), F.coalesce("has_thumb", F.lit(False)).alias("has_thumb"), F.coalesce("related_files", F.lit(0)).alias("related_files"))


def calendar_event(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """The first event whose days hold the date; the calendar is a short fixed table."""
    hit = rows.join(F.broadcast(calendar), (F.col("date") >= F.col("start_date")) & (F.col("date") <= F.col("end_date")), "left")
    return hit.groupBy(*rows.columns).agg(F.min_by("event", "rank").alias("event"))
