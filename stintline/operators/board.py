"""The race-control board: snapshots in reverse order, sparse changes, deletes, clears and absences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a message by wire key, and whether they are whole numbers.
FIELDS = {"t": ("text", False), "l": ("line", True), "m": ("modality", True), "bc": ("background_color", False), "fc": ("font_color", False)}
RANK = ["frame_id", "message_ordinal", "step"]
_PATCH = "struct<Id: string, t: string, l: bigint, m: bigint, bc: string, fc: string>"


def observations(message: DataFrame) -> DataFrame:
    """S21 ledger: one row for each change: (heat_id, frame_id, message_ordinal, step, action, message_id, fields, changed).

    `m_i` lists messages, the last applied first; it is complete if every item is an object with an id. `m_c` changes
    the fields that it holds, `m_d` deletes one message, `m_a` all. What can't be read is UNKNOWN and changes nothing.
    `step` orders the changes of one payload; -1 stands for the payload as a whole.
    """
    h, p = F.col("handle"), F.col("payload")
    null = F.coalesce(F.trim(p), F.lit("null")) == "null"
    items = F.when(h == "m_i", F.when(null, F.array().cast("array<string>")).otherwise(F.from_json(p, "array<string>"))).when(h == "m_c", F.array(p))
    good = F.transform(items, lambda x: F.coalesce(F.startswith(F.ltrim(x), F.lit("{")) & (F.get_json_object(x, "$.Id") != ""), F.lit(False)))
    rows = message.where(F.startswith(h, F.lit("m_"))).withColumns({"items": items, "good": good})
    whole = F.when((h == "m_i") & F.col("items").isNotNull() & F.forall("good", lambda x: x), "SNAPSHOT").when(h == "m_a", "CLEAR").when((h == "m_d") & ~null, "DELETE").when((h == "m_c") & F.get("good", F.lit(0)), "NONE").otherwise("UNKNOWN")
    key = ["heat_id", "frame_id", "message_ordinal"]
    rows = rows.withColumn("whole", whole)
    single = rows.where("whole <> 'NONE'").select(*key, F.lit(-1).alias("step"), F.col("whole").alias("action"), F.when(F.col("whole") == "DELETE", F.regexp_replace(F.trim(p), '^"|"$', "")).alias("message_id"))
    each = rows.where(F.size("items") > 0).select(*key, h.alias("handle"), F.posexplode("items").alias("at", "x"), "good", F.size("items").alias("n"))
    each = each.where(F.get("good", F.col("at"))).withColumn("f", F.from_json("x", _PATCH))
    held = lambda k: F.get_json_object("x", f"$.{k}").isNotNull()
    changed = F.filter(F.array(*[F.when(held(k), F.lit(name)) for k, (name, _) in FIELDS.items()]), lambda c: c.isNotNull())
    patch = each.select(*key, (F.col("n") - 1 - F.col("at")).alias("step"), F.when(F.col("handle") == "m_i", "INITIAL_SNAPSHOT").otherwise("UPSERT").alias("action"), F.col("f.Id").alias("message_id"), changed.alias("changed"), *[F.col(f"f.{k}").alias(name) for k, (name, _) in FIELDS.items()])
    return patch.unionByName(single, allowMissingColumns=True)


def board(ledger: DataFrame) -> DataFrame:
    """Each message ever seen with its fields as last changed, whether it stands, and what took it off.

    A message that comes back keeps the fields that no later change holds. It is off after a delete, a clear or a complete snapshot
    without it; the first of these after its last change is told.
    """
    rank = F.struct(*RANK)
    own = ledger.where(F.col("action").isin("INITIAL_SNAPSHOT", "UPSERT"))
    last = lambda name: F.max_by(name, F.when(F.array_contains("changed", name), rank)).alias(name)
    now = own.groupBy("heat_id", "message_id").agg(*[last(name) for name, _ in FIELDS.values()], F.min(rank).alias("first"), F.max(rank).alias("rank"), F.max_by("action", rank).alias("last_action"))
    ends = ledger.where(F.col("action").isin("SNAPSHOT", "CLEAR")).select("heat_id", rank.alias("rank"), F.when(F.col("action") == "CLEAR", "CLEAR").otherwise("SNAPSHOT_ABSENCE").alias("off"))
    deleted = ledger.where("action = 'DELETE'").select("heat_id", "message_id", rank.alias("rank"))
    # the first end after each message's last change: one pass backwards over a heat's messages and ends
    back = Window.partitionBy("heat_id").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    both = now.unionByName(ends, allowMissingColumns=True).withColumn("end", F.last(F.when(F.col("off").isNotNull(), F.struct("rank", "off")), ignorenulls=True).over(back)).where("off is null").drop("off")
    gone = now.select("heat_id", "message_id", F.col("rank").alias("at")).join(deleted, ["heat_id", "message_id"]).where("rank > at").groupBy("heat_id", "message_id").agg(F.min(F.struct("rank", F.lit("DELETE").alias("off"))).alias("deleted"))
    out = both.join(gone, ["heat_id", "message_id"], "left").withColumn("removal", F.least("end", "deleted"))
    return out.select("heat_id", "message_id", *[name for name, _ in FIELDS.values()], F.col("removal").isNull().alias("is_active"), F.col("first.frame_id").alias("first_frame"), "last_action", F.col("rank.frame_id").alias("last_frame"), F.col("removal.rank.frame_id").alias("removed_frame"), F.col("removal.off").alias("removal_action"))
