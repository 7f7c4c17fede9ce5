"""The provider's dynamic result grid: layouts, cells by the meaning of their column, row removals, schema contract.

Messages are (heat_id, conn_id, frame_id, message_ordinal, handle, payload). `r_i` replaces the grid and may bring a
layout, `r_l` brings a layout and keeps cells whose column it still holds, `r_c` merges cells, `r_d` removes rows. A
layout in which two columns mean the same empties the grid, and nothing enters until a better one comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import canonical_header, token
from stintline.operators.windows import PARTS, running

RANK = ["frame_id", "message_ordinal", "change_ordinal"]

#: The known wire headers, as key, source name and parameter; the first list is required.
REQUIRED_HEADERS = (
    ("position_overall", "position", None),
    ("start_number", "startnumber", None),
    ("state", "State", None),
    ("team_name", "Team name", None),
    ("current_driver", "CurrentDriver", None),
    ("class_name", "class", None),
    ("position_class", "position_in_class", None),
    ("gap", "hole", None),
    ("best_lap", "fastestRoundTime", None),
    ("last_lap", "lastRoundTime", None),
    ("driver_stint", "CurrentDriverStintTime", None),
    ("pit_time", "PitTime", None),
    ("pit_stops", "pitstops", None),
    ("sector_1", "SectorTimes", "1"),
    ("sector_2", "SectorTimes", "2"),
    ("sector_3", "SectorTimes", "3"),
)
OPTIONAL_HEADERS = (("car_name", "car", None), ("laps", "laps", None), ("diff", "diff", None), ("section_marker", "sectionMarker", None))

_COLUMNS = "array<struct<ix: bigint, name: string, parameter: string, key: string>>"


def headers(layout: Column) -> Column:
    """Columns of a layout as an array of (ix, name, parameter, key); key is NULL where the meaning is unknown."""
    listed = F.coalesce(F.get_json_object(layout, "$.h"), F.get_json_object(layout, "$.l.h"))

    def read(x: Column, i: Column) -> Column:
        rich = F.startswith(x, F.lit("{"))
        field = lambda k: F.when(rich, F.get_json_object(x, f"$.{k}"))
        name = F.trim(F.coalesce(F.when(rich, F.get_json_object(x, "$.n")).otherwise(x), i.cast("string")))
        return F.struct(i.cast("long").alias("ix"), name.alias("name"), F.nullif(field("p"), F.lit("")).alias("parameter"), F.trim(field("c")).alias("caption"))

    def meant(x: Column) -> Column:
        return F.struct(x["ix"].alias("ix"), x["name"].alias("name"), x["parameter"].alias("parameter"), canonical_header(x["name"], x["parameter"], x["caption"]).alias("key"))

    # read first, then told the meaning: each text is parsed once
    return F.coalesce(F.transform(F.transform(F.from_json(listed, "array<string>"), read), meant), F.array().cast(_COLUMNS))


def _snapshot() -> Column:
    return (F.col("handle") == "r_i") & F.startswith(F.trim("payload"), F.lit("{"))


def _layout() -> Column:
    """The layout that a message brings, as JSON."""
    return F.when(F.col("handle") == "r_l", F.get_json_object("payload", "$")).when(_snapshot(), F.get_json_object("payload", "$.l"))


def _judged(rows: DataFrame) -> DataFrame:
    """`columns` and `ambiguous` of rows with `layout`."""

    def judged(columns: Column) -> Column:
        keys = F.filter(F.transform(columns, lambda x: x["key"]), lambda k: k.isNotNull())
        return F.struct(columns.alias("columns"), (F.size(keys) > F.size(F.array_distinct(keys))).alias("ambiguous"))

    found = F.when(F.col("layout").isNotNull(), F.get(F.transform(F.array(headers(F.col("layout"))), judged), F.lit(0)))
    return rows.withColumn("__found", found).select("*", "__found.columns", "__found.ambiguous").drop("__found")


def _place(x: Column, i: int) -> Column:
    return F.when(F.get(x, F.lit(i)).rlike("^[0-9]+$"), F.get(x, F.lit(i)).try_cast("bigint"))


def _with_cells(message: DataFrame) -> DataFrame:
    """`cells`: the changes of three items or more whose row and column are whole and not negative, with their place in the message."""
    changes = F.from_json(F.when(F.col("handle") == "r_c", F.col("payload")).when(_snapshot(), F.get_json_object("payload", "$.r")), "array<array<string>>")
    cell = lambda x, i: F.struct(i.cast("long").alias("change_ordinal"), F.when(F.size(x) >= 3, _place(x, 0)).alias("row_ix"), _place(x, 1).alias("col_ix"), F.get(x, F.lit(2)).alias("value"), F.slice(x, 4, F.greatest(F.size(x) - 3, F.lit(0))).alias("presentation"))
    return message.withColumn("cells", F.filter(F.transform(changes, cell), lambda x: x["row_ix"].isNotNull() & x["col_ix"].isNotNull()))


def _with_dropped(message: DataFrame) -> DataFrame:
    rows = F.from_json(F.when(F.col("handle") == "r_d", F.col("payload")), "array<array<string>>")
    return message.withColumn("dropped", F.filter(F.transform(rows, lambda x: _place(x, 0)), lambda r: r.isNotNull()))


def parsed(message: DataFrame) -> DataFrame:
    """Messages with what they do to the grid: `layout`, `columns`, `ambiguous`, `cells`, `dropped`; no state, as streams need it."""
    rows = message.where(F.col("handle").isin("r_c", "r_d", "r_l") | _snapshot()).withColumn("layout", _layout())
    return _with_dropped(_with_cells(_judged(rows))).drop("payload")


def _changes_of_schema(message: DataFrame) -> DataFrame:
    """Messages that replace the grid or its layout, with the generation of the layout in force and whether cells may enter."""
    has = F.col("layout").isNotNull()
    # layouts come again and again: each text is read once
    texts = message.where((F.col("handle") == "r_l") | _snapshot()).withColumn("layout", _layout())
    known = _judged(texts.where("layout is not null").select("layout").distinct())
    rows = texts.join(known, "layout", "left").select("heat_id", "conn_id", "frame_id", "message_ordinal", "handle", "layout", "columns", "ambiguous")
    rows = running(rows, ["heat_id"], ["frame_id", "message_ordinal"], {"generation": has.cast("int")}, {"ready": F.when(has, ~F.col("ambiguous"))})
    return rows.withColumn("ready", F.coalesce("ready", F.lit(False))).withColumn("clears", ((F.col("handle") == "r_i") | F.coalesce("ambiguous", F.lit(False))).cast("int"))


def _cells(message: DataFrame) -> DataFrame:
    keys = ["heat_id", "conn_id", "frame_id", "message_ordinal"]
    return _with_cells(message.where((F.col("handle") == "r_c") | _snapshot())).select(*keys, "handle", F.explode("cells").alias("x")).select(*keys, "handle", "x.*")


def _in_time(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Cells and the events of their heat in one sorted window per row of the grid, so that no heat is one task."""
    told = events.join(cells.select("heat_id", "row_ix").distinct(), "heat_id")
    return cells.withColumn("is_cell", F.lit(True)).unionByName(told.withColumn("is_cell", F.lit(False)), allowMissingColumns=True)


def grid_as_of(message: DataFrame, at_frame: int | None = None) -> DataFrame:
    """(heat_id, row_ix, key, value, presentation, rank) after all messages, or after those up to a frame.

    A cell stays while no `r_i` and no ambiguous layout follows, its row is not removed after it, and each later layout
    holds its column exactly once, wherever. Columns of an unknown meaning go by name and parameter, cells beyond the
    layout by place, until the next one. The newest source rank wins.
    """
    rows = message if at_frame is None else message.where(F.col("frame_id") <= at_frame)
    schema = _changes_of_schema(rows)
    # nothing from before the last message that empties a heat's grid is left: one row a heat
    place = F.struct("frame_id", "message_ordinal")
    emptied = schema.where("clears = 1").groupBy("heat_id").agg(F.max(F.struct(place.alias("place"), "generation")).alias("x")).select("heat_id", F.col("x.place").alias("__from"), F.col("x.generation").alias("__oldest"))
    rows = rows.join(F.broadcast(emptied), "heat_id", "left").where(F.col("__from").isNull() | (place >= F.col("__from"))).drop("__from", "__oldest")
    schema = schema.join(F.broadcast(emptied), "heat_id", "left")
    column = schema.where("layout is not null and (__oldest is null or generation >= __oldest)").select("heat_id", "generation", F.explode("columns").alias("c")).select("heat_id", "generation", F.col("c.ix").alias("col_ix"), *_names("c"))
    last = schema.groupBy("heat_id").agg(F.max("generation").alias("newest"))
    schema = schema.where(F.col("__from").isNull() | (place >= F.col("__from")))
    change = F.lit(-1).cast("long").alias("change_ordinal")
    events = schema.select("heat_id", "frame_id", "message_ordinal", change, "generation", "ready", "clears")
    removed = _with_dropped(rows.where("handle = 'r_d'")).select("heat_id", "frame_id", "message_ordinal", change, F.explode("dropped").alias("row_ix"), F.lit(1).alias("clears")).distinct()
    cells = _cells(rows).drop("conn_id", "handle")
    both = _in_time(cells, events).unionByName(removed.withColumn("is_cell", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("heat_id", "row_ix").orderBy(*RANK)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("generation", "ready")}).withColumn("epoch", F.sum(F.coalesce("clears", F.lit(0))).over(so_far))
    alive = both.withColumn("now", F.max("epoch").over(Window.partitionBy("heat_id", "row_ix"))).where("is_cell and ready and epoch = now").drop("is_cell", "clears", "ready", "epoch", "now")

    unique = column.groupBy("heat_id", "identity", "generation").agg(F.count("*").alias("n")).where("n = 1")
    step = Window.partitionBy("heat_id", "identity")
    runs = unique.withColumn("run", F.col("generation") - F.row_number().over(step.orderBy("generation")))
    runs = runs.select("heat_id", "identity", (F.col("generation") - 1).alias("generation"), F.max("generation").over(Window.partitionBy("heat_id", "identity", "run")).alias("until"))
    known = column.join(runs, ["heat_id", "identity", "generation"], "left").select("heat_id", "generation", "col_ix", "shown", F.coalesce("until", "generation").alias("until"))
    named = alive.join(known, ["heat_id", "generation", "col_ix"], "left").join(last, "heat_id").where(F.coalesce("until", "generation") >= F.col("newest"))
    key = F.coalesce("shown", F.concat(F.lit("column_"), F.col("col_ix").cast("string"))).alias("key")
    best = named.groupBy("heat_id", "row_ix", key).agg(F.max_by(F.struct("value", "presentation", *RANK), F.struct(*RANK)).alias("x"))
    return best.select("heat_id", "row_ix", "key", "x.*")


def _names(column: str) -> list[Column]:
    key, name, parameter = F.col(f"{column}.key"), F.col(f"{column}.name"), F.col(f"{column}.parameter")
    raw = F.concat(F.lit("unknown:"), name, F.lit(":"), F.coalesce(parameter, F.lit("")))
    identity = F.when(key.isNotNull(), key).otherwise(F.to_json(F.struct(name.alias("n"), parameter.alias("p"))))
    return [F.coalesce(key, raw).alias("shown"), identity.alias("identity")]


def trusted_changes(message: DataFrame) -> DataFrame:
    """Each `r_c` cell with `trusted`: did an `r_i` or `r_l` of the same connection, under the layout generation in force, come before it?"""
    order = ["frame_id", "message_ordinal"]
    schema = _changes_of_schema(message).select("heat_id", "conn_id", *order, "generation", "ready")
    # the layout in force is told message by message; where a connection first meets it, by an equal join
    first = schema.where("ready").groupBy("heat_id", "conn_id", "generation").agg(F.min(F.struct(*order)).alias("anchor")).select(F.col("heat_id").alias("__heat"), F.col("conn_id").alias("__conn"), F.col("generation").alias("__generation"), "anchor")
    told = message.where("handle = 'r_c'").withColumn("turn", F.lit(1)).unionByName(schema.drop("conn_id").withColumn("turn", F.lit(0)), allowMissingColumns=True)
    now = running(told, ["heat_id"], [*order, "turn"], {}, {"current": F.col("generation"), "may": F.col("ready")}, parts=PARTS).where("turn = 1")
    same = F.col("heat_id").eqNullSafe(F.col("__heat")) & F.col("conn_id").eqNullSafe(F.col("__conn")) & (F.col("current") == F.col("__generation"))
    rows = now.join(first, same, "left").withColumn("good", F.col("may") & (F.col("anchor") <= F.struct(*order)))
    cells = _with_cells(rows).select("heat_id", "conn_id", *order, "good", F.explode("cells").alias("x"))
    return cells.select("heat_id", "conn_id", *order, "x.change_ordinal", "x.row_ix", "x.col_ix", F.coalesce("good", F.lit(False)).alias("trusted"))


def layout_versions(message: DataFrame) -> DataFrame:
    """The different layouts of a heat, numbered from 0 as they first appear, with where they do and their columns."""
    schema = _changes_of_schema(message).where("layout is not null")
    first = schema.groupBy("heat_id", F.sha2("layout", 256).alias("fingerprint")).agg(F.min_by(F.struct("frame_id", "message_ordinal", "generation", "ambiguous", "columns"), F.struct("frame_id", "message_ordinal")).alias("x"))
    number = F.row_number().over(Window.partitionBy("heat_id").orderBy("frame_id", "message_ordinal")) - 1
    return first.select("heat_id", "fingerprint", "x.*").withColumn("version", number.cast("long"))


def schema_contract(versions: DataFrame) -> DataFrame:
    """CURRENT or DEGRADED for each layout version, with the keys present, required ones without their wire header, keys bound otherwise, and unknown headers."""
    spark = versions.sparkSession
    wanted = [(*b, True) for b in REQUIRED_HEADERS] + [(*b, False) for b in OPTIONAL_HEADERS]
    bound = spark.createDataFrame(wanted, "key string, wire string, wire_parameter string, required boolean")
    by = ["heat_id", "version"]
    column = versions.select(*by, F.explode("columns").alias("c")).select(*by, "c.*")
    exact = (token(F.col("name")) == token(F.col("wire"))) & F.col("parameter").eqNullSafe(F.col("wire_parameter"))
    seen = column.join(F.broadcast(bound), "key").groupBy(*by, "key").agg(F.count("*").alias("n"), F.count_if(exact).alias("exact"))
    every = versions.select(*by).crossJoin(F.broadcast(bound.select("key", "required")))  # a fixed list of headers
    judged = every.join(seen, [*by, "key"], "left").fillna(0, ["n", "exact"])
    listed = lambda cond, x="key": F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col(x)))), ",")
    missing = F.col("required") & (F.col("exact") == 0)
    wrong = (F.col("n") > 0) & ((F.col("n") != 1) | (F.col("exact") != 1))
    found = judged.groupBy(*by).agg(listed(missing).alias("missing"), listed(wrong).alias("mismatched"), F.count_if(missing | wrong).alias("faults"))
    own = column.groupBy(*by).agg(listed(F.col("key").isNotNull()).alias("present"), listed(F.col("key").isNull(), "name").alias("unknown"))
    out = versions.join(found, by).join(own, by, "left").fillna("", ["present", "unknown"])
    return out.select("heat_id", "version", "frame_id", "message_ordinal", "generation", "ambiguous", F.size("columns").cast("long").alias("columns"), "present", "missing", "mismatched", "unknown", F.when(F.col("faults") == 0, "CURRENT").otherwise("DEGRADED").alias("status"))
