"""Captures, frames and messages of the timing feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schema of a capture line; unknown fields are left aside.
CAPTURE = (
    "v int, kind string, received_at string, monotonic_ns long, frame_sequence long, connection_id string, frame struct<text_b64: string, sha256: string>,"
    " messages array<struct<handle: string, args: string, compressed: boolean>>, _corrupt_record string"
)


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """A1: one row per NDJSON line; lines that are no objects keep their text in _corrupt_record."""
    return spark.read.schema(CAPTURE).option("mode", "PERMISSIVE").json(path)


def capture_messages(capture: DataFrame) -> DataFrame:
    """A1: messages of decoded records, in order."""
    rows = capture.where("messages is not null").select("connection_id", "frame_sequence", "received_at", F.posexplode("messages").alias("message_ordinal", "m"))
    return rows.select("connection_id", "frame_sequence", "received_at", "message_ordinal", "m.handle", F.col("m.args").alias("payload"))


def decode_envelope(frame: DataFrame) -> DataFrame:
    """A2: {"M": [[handle, args...]]} to one row per message; a single argument stands by itself."""
    parts = F.from_json(F.get_json_object("raw", "$.M"), "array<array<string>>")
    rows = frame.select(*[c for c in frame.columns if c != "raw"], F.posexplode(parts).alias("message_ordinal", "m"))
    args = F.slice("m", 2, F.size("m"))
    return rows.select("*", F.get("m", F.lit(0)).alias("handle"), F.when(F.size(args) == 1, F.get(args, F.lit(0))).otherwise(F.to_json(args)).alias("payload")).drop("m")


def quarantine(frame: DataFrame) -> DataFrame:
    """A3: every frame with decode_state; those that are no JSON object failed and are kept."""
    return frame.withColumn("decode_state", F.when(F.from_json("raw", "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull(), "decoded").otherwise("failed"))


def dedupe(rows: DataFrame, key: list[str]) -> DataFrame:
    """A4: one row per natural key; where copies differ, the least by all their columns, so that the same rows give the same one."""
    return rows.groupBy(*key).agg(F.min(F.struct(*rows.columns)).alias("x")).select("x.*")


def explode_cells(message: DataFrame, payload: str = "payload") -> DataFrame:
    """[[row, column, value...], ...] to cells; entries of fewer than three items or without whole non-negative places are left out."""
    items = F.from_json(payload, "array<array<string>>")
    rows = message.select(*[c for c in message.columns if c != payload], F.posexplode(items).alias("entry", "x")).where("size(x) >= 3")
    place = lambda i: F.when(F.get("x", F.lit(i)).rlike("^[0-9]+$"), F.get("x", F.lit(i)).try_cast("bigint"))
    return rows.select("*", place(0).alias("row_ix"), place(1).alias("col_ix"), F.get("x", F.lit(2)).alias("value")).where("row_ix is not null and col_ix is not null").drop("x")


def passings(raw: DataFrame, fields: str = "fields") -> DataFrame:
    """Tuples of nine to typed rows with the list of what was wrong."""
    get = lambda i: F.get(fields, F.lit(i))
    short = F.size(fields) < 9
    whole = lambda i: F.when(~short & get(i).rlike("^-?[0-9]+$"), get(i).try_cast("bigint"))
    wrong = lambda i, name: F.when(~short & whole(i).isNull(), F.lit(f"invalid_{name}"))
    names = {2: "start_mm", 3: "stop_mm", 4: "sector_id", 5: "speed", 7: "provider_us"}
    errors = F.filter(F.array(F.when(short, "truncated_tuple"), *[wrong(i, n) for i, n in names.items()]), lambda e: e.isNotNull())
    return raw.select(*[c for c in raw.columns if c != fields], *[whole(i).alias(n) for i, n in names.items() if n != "speed"], whole(5).alias("speed_mm_s"), (whole(5) * 0.0036).alias("speed_kph"), F.when(~short, get(6) == "true").alias("is_in_pit"), errors.alias("errors"))


def classify_objects(objects: DataFrame) -> DataFrame:
    """Kind of a listed object by its top folder and extension."""
    top, low = F.split("object_key", "/")[0], F.lower("object_key")
    kind = F.when(top == "thumbnails", "thumb").when(top.isin("telemetry", "data_log", "report"), "telemetry").when((top == "annotations") & low.endswith(".json"), "annotation").when(top.isin("onboard_video", "stream_records") & low.rlike(r"\.(mp4|mkv|mov|avi|ts)$"), "video").otherwise("other")
    return objects.withColumn("kind", kind)
