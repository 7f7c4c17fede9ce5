"""Batch jobs from bronze to silver: import of a capture, and rebuild of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.operators import board, facts, grid, statistics
from stintline.sources import feed


def import_capture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Frames, messages and cells of an NDJSON capture; a recorded disconnect ends the connection and writes no feed gap."""
    capture = feed.read_capture(spark, path).where("_corrupt_record is null and kind is not null")
    raw = capture.where("frame is not null").select("connection_id", "frame_sequence", "received_at", F.unbase64("frame.text_b64").cast("string").alias("raw"))
    frames = feed.dedupe(feed.quarantine(raw), ["connection_id", "frame_sequence"])
    decoded = feed.decode_envelope(frames.where("decode_state = 'decoded'")).select("connection_id", "frame_sequence", "message_ordinal", "handle", "payload")
    sibling = feed.capture_messages(capture).select("connection_id", "frame_sequence", "message_ordinal", "handle", "payload")
    messages = feed.dedupe(decoded.unionByName(sibling), ["connection_id", "frame_sequence", "message_ordinal"])
    cells = feed.explode_cells(messages.where(F.col("handle").isin("r_i", "r_c")))
    return {"frame": frames, "message": messages, "cell": cells}


def rebuild(cell: DataFrame, path: str) -> DataFrame:
    """The current grid of every heat from all its cells, heat by heat overwritten; bronze is only read."""
    spark = cell.sparkSession
    grid = facts.grid_current(cell)
    grid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("heat_id").parquet(path)
    return spark.read.parquet(path)


#: What is derived from messages, in the order in which it is built. Each table is made of bronze alone or of one before it.
DERIVED = {
    "layouts": lambda message, done: grid.schema_contract(grid.layout_versions(message)),
    "grid": lambda message, done: grid.grid_as_of(message),
    "trusted": lambda message, done: grid.trusted_changes(message),
    "statistics": lambda message, done: statistics.merged(message.where(F.col("handle").isin("a_i", "a_u", "a_r"))),
    "statistics_summary": lambda message, done: statistics.summary(done("statistics")),
    "leaders": lambda message, done: statistics.records(done("statistics"), "l"),
    "board_ledger": lambda message, done: board.observations(message),
    "board": lambda message, done: board.board(done("board_ledger")),
}


def rebuild_all(message: DataFrame, path: str) -> dict[str, DataFrame]:
    """Every derived table of the heats of `message`, heat by heat replaced; other heats and the messages stay as they are.

    A second run writes the same rows, and a run that broke off is mended by the next.
    """
    spark = message.sparkSession
    heats = message.select("heat_id").distinct()

    def done(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").join(heats, "heat_id", "left_semi")

    for name, make in DERIVED.items():
        make(message, done).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("heat_id").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in DERIVED}
