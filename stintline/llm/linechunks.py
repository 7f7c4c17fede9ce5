"""Line dedup by content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import apart, drop, key_filter, may_hold, renamed, save

#: A line ends a chunk if its rolling hash over this many lines, modulo this divisor, is 0.
ROLL, DIVISOR = 2, 3
#: A line of so many spaces or characters is a chunk by itself, so that a repeated passage on one line is met wherever it stands.
LONG_SPACES, LONG_CHARS = 49, 300
#: Shorter chunks stay where they are, and so do single lines that are not long.
LEAST_CHARS, LEAST_LINES = 40, 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_hash(line: Column) -> Column:
    """First 32 bits of the MD5 of a line, as a number that other SQL engines give too."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def is_long(line: Column) -> Column:
    return (F.length(line) >= LONG_CHARS) | (F.length(line) - F.length(F.replace(line, F.lit(" "))) >= LONG_SPACES)


def cut(text: Column, roll: int = ROLL, divisor: int = DIVISOR) -> Column:
    """Chunks of a text in order, without gaps: array of (n_lines, body).

    The rolling hash of line i is the sum of h(i - k) * 31^k over k < roll, so a boundary depends on `roll` lines
    only and comes back wherever the same lines stand. Long lines end the chunk before them and are one themselves.
    The last line always ends a chunk.
    """

    def ends(x: Column) -> Column:
        def is_end(i: Column) -> Column:
            rolled = F.element_at(x, i).h
            for k in range(1, roll):
                rolled = rolled + F.when(i > k, F.element_at(x, F.greatest(i - k, F.lit(1))).h * (31**k)).otherwise(0)
            return (rolled % divisor == 0) | (i == F.size(x)) | F.element_at(x, i).alone | F.coalesce(F.get(x, i).alone, F.lit(False))

        return F.filter(F.sequence(F.lit(1), F.size(x)), is_end)

    def bodies(lines: Column, e: Column) -> Column:
        def body(to: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(e, i - 1)).otherwise(0)
            return F.struct((to - before).alias("n_lines"), F.array_join(F.slice(lines, before + 1, to - before), "\n").alias("body"))

        return F.transform(e, body)

    def named(line: Column) -> Column:
        return F.struct(line_hash(line).alias("h"), is_long(line).alias("alone"))

    return let(F.split(text, "\n"), lambda lines: let(let(F.transform(lines, named), ends), lambda e: bodies(lines, e)))


def _key() -> Column:
    """Of a document: rows equal in id and text are one document."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))))


def repeated_chunks(docs: DataFrame, least_lines: int = LEAST_LINES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, gone): per document key, the numbers of its chunks that an earlier place holds already.

    Equal digests are only candidates: a chunk counts as repeated once its bytes have been grouped and found equal.
    """
    plain = docs.select("doc_id", "text").where("text is not null").select(_key().alias("key"), "doc_id", "text")
    all_cut = plain.select("key", "doc_id", F.posexplode(cut(F.col("text"))).alias("pos", "c"))
    wanted = (F.col("c.n_lines") >= least_lines) | is_long(F.col("c.body"))
    all_cut = all_cut.where(wanted & (F.length("c.body") >= least_chars))
    seen = save(all_cut.select("key", "doc_id", "pos", F.unhex(F.md5("c.body")).alias("digest")), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "pos")
    first = save(seen.distinct().groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    some = save(seen.join(first.select("digest", F.col("first.key").alias("first_key"), F.col("first.pos").alias("first_pos")), "digest"), "candidates")

    # bytes of the candidates only; of the documents that hold none, few reach the shuffle
    asked = save(some.groupBy("key").agg(F.collect_set(F.struct("pos", "digest", "first_key", "first_pos")).alias("asked")), "asked")
    held = key_filter(asked, "key")
    holders = may_hold(plain.select("key", "text"), "key", held).where("__may").select("key", "text").join(asked, "key")
    bodies = holders.select("key", let(cut(F.col("text")), lambda c: F.transform("asked", lambda a: F.struct(a.alias("a"), F.get(c, a.pos).body.alias("body")))).alias("found"))
    bodies = bodies.select("key", F.explode("found").alias("f")).select("key", "f.a.*", "f.body")
    groups = bodies.groupBy("digest", "body").agg(F.bool_or((F.col("key") == F.col("first_key")) & (F.col("pos") == F.col("first_pos"))).alias("has_first"))
    proven = save(groups.groupBy("digest").agg(F.count("*").alias("bodies"), F.bool_and("has_first").alias("whole")).where("bodies = 1 and whole").select("digest"), "proven")
    later = some.where("key <> first_key or pos <> first_pos").join(proven, "digest")
    gone = save(later.groupBy("key").agg(F.collect_set("pos").alias("gone")), "gone")
    for x in (seen, first, some, asked, held, proven):
        drop(x)
    return gone


def dedup_lines(docs: DataFrame, least_lines: int = LEAST_LINES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """`docs` with every chunk removed that stands at an earlier place too, and two more columns.

    Lines are split at newlines; chunks end where the rolling hash says so, and before and after a long line (49 spaces
    or 300 characters), which is a chunk by itself. The earliest place of a chunk is that of the smallest (doc_id, text
    digest, chunk number), null ids last; it keeps the chunk. Later places lose it if the bytes are equal. Chunks of one
    line that is not long, or of fewer than `least_chars` characters, stay. Adds n_lines (lines of the text before, null
    for null) and n_removed (lines that went). Null texts stay null and empty ones empty; long texts are cut in whole.
    Rows equal in doc_id and text count as one document and all keep or lose the same chunks. Other columns pass
    through; input columns of the two new names are replaced. An empty table gives an empty one.
    """
    names = apart([c for c in docs.columns if c not in ("n_lines", "n_removed")], ("doc_id", "text"))
    docs = renamed(docs, names)
    gone = repeated_chunks(docs, least_lines, least_chars).select(F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    # only documents that may lose something are shuffled
    keyed = may_hold(docs.withColumn("__key", _key()), "__key", key_filter(gone, "__key"))
    losing = keyed.where("__may").join(gone, "__key", "left").drop("__key", "__may")
    joined = losing.unionByName(keyed.where("not __may").drop("__key", "__may").withColumn("__gone", F.lit(None).cast("array<int>")))

    def rest(c: Column) -> Column:
        kept = F.filter(c, lambda x, i: ~F.array_contains("__gone", i))
        lost = F.filter(c, lambda x, i: F.array_contains("__gone", i))
        return F.struct(F.array_join(F.transform(kept, lambda x: x.body), "\n").alias("text"), F.aggregate(lost, F.lit(0), lambda a, x: a + x.n_lines).alias("n_removed"))

    joined = joined.withColumn("__new", F.when(F.col("__gone").isNotNull(), let(cut(F.col("text")), rest)))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.col("__new.text")).alias("text")
    done = joined.select(
        *[text if new == "text" else F.col(new) for new in names.values()],
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce("__new.n_removed", F.lit(0)).cast("long").alias("n_removed"),
    )
    return renamed(done, {**{new: old for old, new in names.items()}, "n_lines": "n_lines", "n_removed": "n_removed"})
