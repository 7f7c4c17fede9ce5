"""The provider's statistics: nested patches merged by path, typed summary, records of laps, leaders and cautions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import lookup, parse_ts_time
from stintline.operators.windows import PARTS, running

#: Counters of the summary by wire key.
COUNTERS = {
    "p": "participants_started",
    "a": "participants_classified",
    "n": "participants_not_classified",
    "pt": "participants_on_track",
    "pp": "participants_in_pit_zone",
    "ptz": "participants_in_tank_zone",
    "o": "total_laps",
    "x": "total_pitstops",
    "e": "leader_laps_green",
    "y": "leader_laps_safety_car",
    "r": "leader_laps_code_60",
    "fy": "leader_laps_full_course_yellow",
    "c": "safety_car_count",
    "s": "code_60_count",
    "fc": "full_course_yellow_count",
}
#: Durations kept as they come, instants, and the collections of records.
DURATIONS = {"u": "safety_car_total_time_raw", "t": "code_60_total_time_raw", "fu": "full_course_yellow_total_time_raw"}
INSTANTS = {"g": "green_flag_ts_time", "f": "finish_flag_ts_time"}
COLLECTIONS = ("b", "q", "i", "l", "d")
#: Fields of the records by wire key; the kinds are int, float, text and ts.
RECORDS = {
    "b": {"r": ("lap_number", "int"), "i": ("lap_time_us", "int"), "t": ("occurred_at_ts_time", "ts"), "a": ("average_speed_kph", "float"), "d": ("driver_name", "text"), "n": ("team_name", "text"), "c": ("vehicle_name", "text"), "s": ("start_number", "text"), "m": ("class_name", "text"), "p": ("class_order", "int")},
    "l": {"f": ("occurred_at_ts_time", "ts"), "l": ("lap_number", "int"), "s": ("start_number", "text"), "n": ("team_name", "text"), "d": ("driver_name", "text"), "c": ("vehicle_name", "text")},
    "d": {"e": ("leader_laps", "int"), "n": ("team_name", "text"), "c": ("vehicle_name", "text"), "s": ("start_number", "text")},
}
#: Levels of objects that are merged by path; an object below them is replaced whole.
LEVELS = 4
#: Between the keys of a path.
SEP = "\x1f"
BY = ["heat_id", "epoch"]


def _written(message: DataFrame) -> DataFrame:
    """(heat_id, epoch, rank, path, value, is_object): what each patch writes. `a_i` and `a_r` begin an epoch. A string that reads as an object counts as one."""
    begins = F.when(F.col("handle").isin("a_i", "a_r"), F.lit(1))
    rows = running(message.select("heat_id", "frame_id", "message_ordinal", "handle", "payload"), ["heat_id"], ["frame_id", "message_ordinal"], {"epoch": begins}, {}, parts=PARTS).where("handle <> 'a_r'")
    entries = lambda text: F.map_entries(F.from_json(text, "map<string,string>"))

    def entry(path: Column, value: Column, n: int) -> Column:
        is_object = F.coalesce(F.startswith(F.trim(value), F.lit("{")) & F.from_json(value, "map<string,string>").isNotNull(), F.lit(False)) if n < LEVELS else F.lit(False)
        return F.struct(path.alias("path"), value.alias("value"), is_object.alias("is_object"))

    def inside(n: int):
        return lambda x: F.transform(entries(x["value"]), lambda e: entry(F.concat_ws(SEP, x["path"], e["key"]), e["value"], n))

    rows = rows.withColumn("__1", F.transform(entries(F.col("payload")), lambda e: entry(e["key"], e["value"], 1)))
    for n in range(2, LEVELS + 1):
        rows = rows.withColumn(f"__{n}", F.flatten(F.transform(F.filter(f"__{n - 1}", lambda x: x["is_object"]), inside(n))))
    all_levels = F.concat(*[F.col(f"__{n}") for n in range(1, LEVELS + 1)])
    return rows.select(*BY, F.struct("frame_id", "message_ordinal").alias("rank"), F.explode(all_levels).alias("x")).select(*BY, "rank", "x.*")


def merged(message: DataFrame) -> DataFrame:
    """(heat_id, epoch, path, value) of the deep merge of all patches of an epoch, in source order.

    A path holds its last value, unless a later patch made an object of it, or put a plain value in place of an object
    above it.
    """
    put, made = F.when(~F.col("is_object"), F.col("rank")), F.when(F.col("is_object"), F.col("rank"))
    told = _written(message).groupBy(*BY, "path").agg(F.max(put).alias("rank"), F.max_by("value", put).alias("value"), F.max(made).alias("made")).where("rank is not null")
    parts = F.split("path", SEP)
    above = [f"__k{n}" for n in range(1, LEVELS)]
    # dealt by the first key, sorted once by the deepest ones: the windows of all levels follow that order
    rows = told.withColumns({"__depth": F.size(parts), **{k: F.get(parts, F.lit(n)) for n, k in enumerate(above)}}).repartition(PARTS, *BY, above[0])
    for n in range(LEVELS - 1, 0, -1):
        own = F.max(F.when(F.col("__depth") == n, F.col("rank"))).over(Window.partitionBy(*BY, *above[:n]))
        rows = rows.withColumn(f"__p{n}", F.when(F.col("__depth") > n, own))
    gone = F.lit(False)
    for n in range(1, LEVELS):
        gone = gone | F.coalesce(F.col(f"__p{n}") > F.col("rank"), F.lit(False))
    return rows.where(~gone & (F.col("made").isNull() | (F.col("made") < F.col("rank")))).select(*BY, "path", "value")


def _whole(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint"))


def summary(state: DataFrame) -> DataFrame:
    """One row an epoch: heat name, counters, durations, instants, truncations, unknown keys and errors by field."""
    key, value = F.col("path"), F.col("value")
    top = state.where(F.instr("path", SEP) == 0)
    one = lambda k, x: F.max(F.when(key == k, x))
    name = F.nullif(F.trim(value), F.lit(""))
    typed = [one("h", name).alias("heat_name"), *[one(k, _whole(value)).alias(n) for k, n in COUNTERS.items()], *[one(k, value).alias(n) for k, n in DURATIONS.items()], *[one(k, parse_ts_time(value)).alias(n) for k, n in INSTANTS.items()]]
    cut = {f"{k}C": k for k in COLLECTIONS}
    wrong = (
        F.when((key == "h") & name.isNull(), "invalid_heat_name")
        .when(key.isin(*COUNTERS) & _whole(value).isNull(), F.concat(F.lit("invalid_"), lookup(COUNTERS, key)))
        .when(key.isin(*INSTANTS) & parse_ts_time(value).isNull(), F.concat(F.lit("invalid_"), lookup(INSTANTS, key)))
        .when(key.isin(*cut) & _whole(value).isNull(), F.concat(F.lit("invalid_"), key))
    )
    listed = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    known = (*COUNTERS, *DURATIONS, *INSTANTS, *COLLECTIONS, *cut, "h")
    short = listed(F.when(key.isin(*cut) & _whole(value).isNotNull(), F.concat(lookup(cut, key), F.lit("="), _whole(value).cast("string"))))
    first = F.split("path", SEP)[0]
    told = state.groupBy(*BY).agg(listed(F.when(~first.isin(*known), first)).alias("unknown_keys"))
    return told.join(top.groupBy(*BY).agg(*typed, short.alias("truncations"), listed(wrong).alias("errors")), BY, "left")


def records(state: DataFrame, collection: str, fields: str | None = None) -> DataFrame:
    """The typed records of a collection with their place: numeric keys first, by number, then the others by text."""
    parts = F.split("path", SEP)
    rows = state.where((parts[0] == collection) & (F.size(parts) == 3)).select(*BY, parts[1].alias("provider_key"), parts[2].alias("field"), "value")
    value = F.col("value")
    kinds = {"int": _whole(value), "float": F.when(value.rlike(r"^[0-9]+(\.[0-9]+)?$"), value.try_cast("double")), "text": F.nullif(F.trim(value), F.lit("")), "ts": parse_ts_time(value)}
    typed = [F.max(F.when(F.col("field") == wire, kinds[kind])).alias(name) for wire, (name, kind) in RECORDS[fields or collection].items()]
    number = F.when(F.col("provider_key").rlike("^[0-9]+$"), F.col("provider_key").try_cast("bigint"))
    place = F.row_number().over(Window.partitionBy(*BY).orderBy(number.isNull(), number, "provider_key")).cast("long")
    return rows.groupBy(*BY, "provider_key").agg(*typed).withColumn("place", place)


def class_bests(state: DataFrame) -> DataFrame:
    """A10: of each class its best lap record, the shortest, then the one placed first."""
    rows = records(state, "q", "b").where("class_name is not null and lap_time_us is not null")
    best = F.min_by(F.struct("lap_time_us", "lap_number", "start_number", "driver_name", "team_name"), F.struct("lap_time_us", "place"))
    return rows.groupBy(*BY, "class_name").agg(best.alias("x")).select(*BY, "class_name", "x.*")
