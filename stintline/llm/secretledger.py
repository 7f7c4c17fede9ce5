"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger is a table of (address, rules, spans):
which rule versions have read a blob, and what they found. A scan reads each blob once and only by the rule versions
that have not read it yet, appends what it finds, and joins the findings of the ledger back to all paths. All of it is
DataFrame functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.llm.common import checkpoint_dir, drop, key_filter, may_hold, save


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of `pattern` whose `group` has `least` characters or more. A changed rule needs a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The first three are the base. A run that is too short for its rule holds no longer one, so those lengths stand in the pattern; an assignment that fails still takes its characters.
RULES = (
    Rule("assign", 1, _ASSIGN, 1, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hub", 1, "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")
_ENTRY = "address string, rules array<string>, spans array<struct<rule: string, start: long, end: long>>"


def addressed(docs: DataFrame) -> DataFrame:
    """(doc_id, address, text); a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("address"), text.alias("text"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The entries so far; None before the first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return None
    return spark.read.schema(_ENTRY).parquet(ledger)


def _lengths(rule: Rule) -> Column:
    """Of each match of a text: characters since the last one, its own, and those of its group; a last element without a match follows."""
    size = lambda xs: F.transform(xs, F.length)
    every = lambda group: F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group))
    found = F.arrays_zip(size(F.split("text", rule.pattern, -1)).alias("gap"), size(every(0)).alias("n"), size(every(rule.group)).alias("own"))
    named = F.transform(found, lambda x, i: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.least).alias("least"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["own"].alias("own")))
    return F.when(F.array_contains("todo", rule.name) & F.col("text").rlike(rule.pattern), named)


def spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(address, spans) of the blobs (address, text, todo) in which a rule of `todo` finds something.

    Regular expressions give the matches and the pieces between them; running sums of their lengths give the places,
    in code points. Only lengths leave the scan, and only of texts that match.
    """
    nothing = F.array().cast("array<struct<rule: string, least: int, i: int, gap: int, n: int, own: int>>")
    found = blobs.select("address", F.explode(F.concat(*[F.coalesce(_lengths(r), nothing) for r in rules])).alias("x")).select("address", "x.*").where("n is not null")
    so_far = Window.partitionBy("address", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.repartition("address").withColumn("end", F.sum((F.col("gap") + F.col("n")).cast("long")).over(so_far)).where("own >= least")
    return placed.groupBy("address").agg(F.collect_list(F.struct("rule", (F.col("end") - F.col("n")).alias("start"), "end")).alias("spans"))


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger has not seen, append it, and return (doc_id, address) of all rows.

    A blob that stands once and is new to all rules is read where it lies. The texts of others, which bitmaps of
    addresses tell apart, meet by address, one for each blob, and are read by the rules that they lack.
    """
    spark = docs.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    rows = addressed(docs)
    paths = save(rows.select("doc_id", "address"), "paths")
    blobs = paths.groupBy("address").agg(F.count("*").alias("copies"))
    before = read_ledger(spark, ledger)
    if before is None:
        state = blobs.select("*", names.alias("todo"), F.lit(False).alias("known"))
    else:
        seen = before.groupBy("address").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        state = blobs.join(seen, "address", "left").select("address", "copies", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"), F.col("seen").isNotNull().alias("known"))
    state = save(state, "blobs")
    unseen = state.where(F.size("todo") > 0).select("address", "todo")

    texts = rows.select("address", "text")
    special = key_filter(state.where("known or copies > 1"), "address")
    marked = may_hold(texts, "address", special)
    alone = marked.where(~F.col("__may")).select("address", "text", names.alias("todo"))
    met = marked.where("__may").select("address", "text")
    if before is not None:
        wanted = key_filter(unseen, "address")
        met = may_hold(met, "address", wanted).where("__may").select("address", "text")
    met = met.groupBy("address").agg(F.first("text").alias("text")).join(unseen, "address")
    found = spans(alone.unionByName(met), rules)
    entries = unseen.join(found, "address", "left").select("address", F.col("todo").alias("rules"), F.coalesce("spans", F.array().cast("array<struct<rule: string, start: long, end: long>>")).alias("spans"))
    saved = save(entries, "entries")
    saved.write.mode("append").parquet(ledger)
    for x in (saved, state, special, *([wanted] if before is not None else [])):
        drop(x)
    return paths


def findings(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, address, found) of every path: found is an array of (start, place, end, kind) by start, then place of the kind."""
    spark = paths.sparkSession
    kinds = [r.kind for r in rules]
    named = spark.createDataFrame([(r.name, kinds.index(r.kind), r.kind) for r in rules], "rule string, place int, kind string")
    held = read_ledger(spark, ledger).select("address", F.explode("spans").alias("s")).select("address", "s.*").distinct().join(F.broadcast(named), "rule")
    found = held.groupBy("address").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind"))).alias("found"))
    return paths.join(found, "address", "left").select("doc_id", "address", F.coalesce("found", F.array().cast("array<struct<start: bigint, place: int, end: bigint, kind: string>>")).alias("found"))


def _digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of `docs`, from the ledger after its update.

    Without a ledger's path a new one is begun in the shared folder. Null and empty texts hold nothing. Rows of equal
    text are one blob, wherever and whenever they stand, and each gives a row; null and repeated ids too. Long texts
    are read whole; spans of one start stand in the order of their kinds. An empty table gives an empty result.
    Further columns are not read.
    """
    ledger = ledger or f"{checkpoint_dir(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}"
    out = findings(update(docs, ledger, rules), ledger, rules)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"))
