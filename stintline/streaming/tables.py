"""Sinks of streams as tables of batches: current rows with compaction, an outbox with a cursor, a retained tail, revised facts.

Every table is a folder with one subfolder a batch. A batch that is run again overwrites its own subfolder and reads
only those of earlier batches, so that a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stintline.operators import battle, laps


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete subfolders {prefix}={n}, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(where):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if done(p))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a step over each batch of what is there now."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- A13: current rows -------------------------------------------------------


def _newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("batch", "base")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select("x.*")


def upsert_step(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """The rows of a batch, newest source rank of a key, as a version of the table."""
    return lambda batch, number: _newest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_current(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: the last merged version and the batches after it, nothing older."""
    base = _folders(spark, path, "base")[-1:]
    later = [n for n in _folders(spark, path, "batch") if not base or n > base[0]]
    return _newest(spark.read.parquet(*[f"{path}/base={n}" for n in base], *[f"{path}/batch={n}" for n in later]), key, order)


def compact(spark: SparkSession, path: str, key: list[str], order: list[str]) -> int | None:
    """Merge all complete batches into one version and remove what it replaces; gives the number of the last merged batch.

    The new version is complete before anything goes, and a reader of an older one finds it until the next call.
    """
    numbers, bases = _folders(spark, path, "batch"), _folders(spark, path, "base")
    new = [n for n in numbers if not bases or n > bases[-1]]
    if not new:
        return bases[-1] if bases else None
    read_current(spark, path, key, order).write.mode("overwrite").parquet(f"{path}/base={new[-1]}")
    for n in bases:
        _remove(spark, f"{path}/base={n}")
    for n in numbers:
        if n < new[-1]:  # the newest batch may be run again after a restart
            _remove(spark, f"{path}/batch={n}")
    return new[-1]


# --- T9: outbox --------------------------------------------------------------


def numbered(events: DataFrame, order: list[str], base: int = 0, parts: int = 32) -> DataFrame:
    """Events with `cursor`, base + 1 on without gaps in the given order, which begins with a number.

    Ranges of that number are numbered apart and moved by the sizes of those before, so no task sees all.
    """
    first = F.col(order[0])
    cuts = events.agg(F.percentile_approx(first, [i / parts for i in range(1, parts)], F.lit(1000)).alias("__cuts"))  # one row
    placed = events.crossJoin(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("__cuts", lambda x: x < first))).drop("__cuts")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each range
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn("__at", at).join(F.broadcast(starts), "__part").withColumn("cursor", (F.col("__start") + F.col("__at") + base).cast("long")).drop("__part", "__at", "__start")


def outbox_step(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Events of a batch that no earlier batch holds, under a cursor that only grows; the batch's range of cursors is its entry in `ranges`."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _folders(spark, f"{path}/events", "batch") if n < number]
        ranges = [n for n in _folders(spark, f"{path}/ranges", "batch") if n < number]
        new = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("x")).select("x.*")
        if earlier:
            new = new.join(spark.read.parquet(*[f"{path}/events/batch={n}" for n in earlier]).select(*key), key, "left_anti")
        base = spark.read.parquet(f"{path}/ranges/batch={ranges[-1]}").first().last if ranges else 0
        out = numbered(new, order, base)
        out.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        written = spark.read.parquet(f"{path}/events/batch={number}")
        low = F.coalesce(F.min("cursor"), F.lit(base + 1)).alias("first")
        written.agg(low, F.coalesce(F.max("cursor"), F.lit(base)).alias("last")).write.mode("overwrite").parquet(f"{path}/ranges/batch={number}")

    return step


def outbox(spark: SparkSession, path: str) -> DataFrame:
    """All events that are kept."""
    return spark.read.parquet(*[f"{path}/events/batch={n}" for n in _folders(spark, f"{path}/events", "batch")])


def prune(spark: SparkSession, path: str, through: int) -> None:
    """Remove the events of batches whose cursors are all at or below `through`; the newest batch stays."""
    for n in _folders(spark, f"{path}/ranges", "batch")[:-1]:
        if spark.read.parquet(f"{path}/ranges/batch={n}").first().last <= through:
            _remove(spark, f"{path}/events/batch={n}")


def cursor_bounds(spark: SparkSession, path: str) -> DataFrame:
    """(floor, last): cursors at or below the floor are gone. One row."""
    kept = set(_folders(spark, f"{path}/events", "batch"))
    every = _folders(spark, f"{path}/ranges", "batch")
    ranges = spark.read.parquet(*[f"{path}/ranges/batch={n}" for n in every])
    gone = [n for n in every if n not in kept]
    floor = spark.read.parquet(*[f"{path}/ranges/batch={n}" for n in gone]).agg(F.max("last").alias("floor")) if gone else spark.range(1).select(F.lit(0).cast("long").alias("floor"))
    return floor.crossJoin(ranges.agg(F.max("last").alias("last")))  # one row each


def needs_reset(cursors: DataFrame, bounds: DataFrame) -> DataFrame:
    """Must a client with this cursor begin anew? So if it is negative, below the floor or beyond the last event."""
    k = F.col("cursor")
    return cursors.crossJoin(F.broadcast(bounds)).select(*cursors.columns, ((k < 0) | (k < F.col("floor")) | (k > F.col("last"))).alias("reset"))  # one row of bounds


# --- T5: sliding windows over a retained tail --------------------------------


def closures_step(out: str, tail: str, seconds: tuple[int, ...] = battle.WINDOWS_S, ago_s: int = battle.AGO_S, tail_s: int = battle.TAIL_S) -> Callable[[DataFrame, int], None]:
    """T5: closures of the samples of a batch, over the tail of the samples before, which is then moved on.

    Samples come in time order between batches; the tail of a run reaches `tail_s` back from its newest sample.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _folders(spark, tail, "batch") if n < number]
        rows = batch.withColumn("is_new", F.lit(True))
        if before:
            rows = spark.read.parquet(f"{tail}/batch={before[-1]}").withColumn("is_new", F.lit(False)).unionByName(rows)
        battle.sliding_closures(rows, seconds, ago_s, tail_s).where("is_new").drop("is_new").write.mode("overwrite").parquet(f"{out}/batch={number}")
        newest = F.max("observed_at_us").over(Window.partitionBy(*battle.RUN))
        rows.withColumn("__newest", newest).where(F.col("observed_at_us") >= F.col("__newest") - tail_s * 1_000_000).drop("__newest", "is_new").write.mode("overwrite").parquet(f"{tail}/batch={number}")
        for n in before[:-1]:  # the last one serves a batch that is run again
            _remove(spark, f"{tail}/batch={n}")

    return step


# --- T8: facts revised by late evidence --------------------------------------

#: Parts of a heat's participants that are recomputed and replaced together.
SLOTS = 16


def slot(participant: str = "participant_id"):
    return F.pmod(F.xxhash64(participant), F.lit(SLOTS)).cast("int")


def publish_clean_laps(lap: DataFrame, flag: DataFrame, pit: DataFrame, gap: DataFrame, state: DataFrame, path: str, touched: DataFrame | None = None) -> None:
    """Clean laps by heat and slot; with `touched` (heat_id, slot) only those parts are recomputed and replaced.

    Evidence is all that is known by now. Parts that nothing touches are neither read nor written.
    """
    rows, evidence, seen = lap.withColumn("slot", slot()), pit.withColumn("slot", slot()), state.withColumn("slot", slot())
    if touched is not None:
        rows, evidence = (x.join(F.broadcast(touched), ["heat_id", "slot"], "left_semi") for x in (rows, evidence))  # SLOTS parts a heat at most
        seen = seen.join(F.broadcast(touched.select("slot").distinct()), "slot", "left_semi")
    out = laps.clean_laps(rows, flag, evidence.drop("slot"), gap, seen.drop("slot"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("heat_id", "slot").parquet(path)


def late_pits_step(tables: Callable[[], dict[str, DataFrame]], evidence: str, path: str) -> Callable[[DataFrame, int], None]:
    """Stops that come late turn the laps that they cross unclean: the parts of their participants are published anew."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{evidence}/batch={number}")
        known = spark.read.parquet(*[f"{evidence}/batch={n}" for n in _folders(spark, evidence, "batch") if n <= number])
        touched = batch.select("heat_id", slot().alias("slot")).distinct()
        t = tables()
        publish_clean_laps(t["lap"], t["flag"], known, t["gap"], t["state"], path, touched)

    return step


def late_flags_step(tables: Callable[[], dict[str, DataFrame]], evidence: str, path: str) -> Callable[[DataFrame, int], None]:
    """Flag periods that come late touch all parts of their heat."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{evidence}/batch={number}")
        known = spark.read.parquet(*[f"{evidence}/batch={n}" for n in _folders(spark, evidence, "batch") if n <= number])
        touched = batch.select("heat_id", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot")).distinct()
        t = tables()
        publish_clean_laps(t["lap"], known, t["pit"], t["gap"], t["state"], path, touched)

    return step
