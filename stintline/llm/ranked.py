"""Ranked lexical search without random access (NRA) over an impact-sorted index.

The list of each asked term is stored in tiers of falling impact, each several times as long as the ones before. Every
round reads the next tier of all lists of the items that are not settled yet, and keeps for each (item, document) seen
the sum of the impacts read (its lower score) and what its unread lists can still add at most (to its upper score).
Documents that can't reach the last place any more go; an item takes no new documents once an unseen one can't reach it
either; it is settled when all documents that are left have their final score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.llm.common import ALNUM, Words, drop, lean, parts, save, sent_if_small

#: Documents returned for each item.
MOST = 50
#: Postings of a list in its first tier, about, and how many times longer each next one is.
FIRST, GROWTH = 64, 8
#: Impacts are told apart in bands of 2 ** BAND when tiers are cut.
BAND = 12
#: Bits of the filter that keeps postings of terms that nobody asks for out of the index: 8 MB whatever the number of terms. A fuller one lets more through, never fewer.
ASKED_BITS, _ROW_BITS = 1 << 26, 1 << 15


def _grouped(w: Words, rows: int, hit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of rows, terms, occurrences): the distinct words of each row, of those that `hit` marks."""
    h, row = (w.hash, w.row) if hit is None else (w.hash[hit], w.row[hit])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    return np.searchsorted(row[first], np.arange(rows + 1)), h[first].view(np.int64), np.diff(np.append(first, len(h)))


def _lists(bounds: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def asked_terms(items: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of each item (item, text), as 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in parts(batch.column(1)):
                bounds, terms, _ = _grouped(Words(data, offsets, ALNUM), end - row)
                yield pa.record_batch([batch.column(0).slice(row, end - row), _lists(bounds, terms, pa.int64())], names=["item", "terms"])

    return items.select("item", "text").mapInArrow(lean(run), "item long, terms array<long>").select("item", F.explode("terms").alias("term"))


def _bitmap(terms: DataFrame) -> np.ndarray:
    """ASKED_BITS bits, one for each term; built in parts by the tasks."""
    slot = F.pmod(F.col("term"), F.lit(ASKED_BITS))
    made = terms.select((slot / _ROW_BITS).cast("int").alias("part"), (slot % _ROW_BITS).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(ASKED_BITS // 8, np.uint8)
    for r in made.collect():  # at most ASKED_BITS / 8 bytes
        out[r.part * _ROW_BITS // 8 : (r.part + 1) * _ROW_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def document_terms(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """(rid, doc_id, n, terms, tf) of each row: its number of terms with repeats, and those that `asked` may hold."""

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in parts(batch.column(1)):
                w = Words(data, offsets, ALNUM)
                slot = w.hash.view(np.int64) & (ASKED_BITS - 1)
                hit = (asked[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                bounds, terms, tf = _grouped(w, end - row, hit)
                yield pa.record_batch(
                    [batch.column(0).slice(row, end - row), pa.array(np.diff(w.ptr), pa.int64()), _lists(bounds, terms, pa.int64()), _lists(bounds, tf, pa.int64())],
                    names=["doc_id", "n", "terms", "tf"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lean(run), "doc_id long, n long, terms array<long>, tf array<long>").select(F.monotonically_increasing_id().alias("rid"), "*")


def build_index(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(index, lists, number of tiers) of the given terms over all documents.

    index: (term, rid, doc_id, x, tier), stored by tier, x being a posting's impact but for its term's weight. lists:
    (term, weight, rest), rest[r] the most that a posting beyond tier r adds.
    """
    held = save(document_terms(docs, _bitmap(terms)), "doc-terms")
    size = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n_docs, n_words = F.lit(size.docs).cast("long"), F.lit(max(size.words, 1)).cast("long")
    m = 50 + F.call_function("div", 50 * F.col("n") * n_docs, n_words)
    long = held.select("rid", "doc_id", m.alias("m"), F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("rid", "doc_id", F.col("p.terms").alias("term"), F.call_function("div", 1_000_000_000 * F.col("p.tf"), 1000 * F.col("p.tf") + 20 * F.col("m")).alias("x"))
    band = F.shiftright("x", BAND).cast("int")

    # bands per term, a bounded number, stand for the sorted list: counts of the bands before one give its depth
    bands = long.groupBy("term", band.alias("band")).agg(F.count("*").alias("n"), F.max("x").alias("x")).join(terms.distinct(), "term")
    df = F.sum("n").over(Window.partitionBy("term"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    tiers = bands.select("term", "band", "x", df.alias("df"), F.floor(F.log(float(GROWTH), before / FIRST + 1)).cast("int").alias("tier"))
    tiers = save(tiers.withColumn("weight", weight).where("weight > 0 and x > 0"), "tiers")
    n_tiers = tiers.agg(F.coalesce(F.max("tier") + 1, F.lit(0)).alias("n")).first().n
    rest = [F.coalesce(F.max(F.when(F.col("tier") > r, F.col("x"))), F.lit(0)) * F.first("weight") for r in range(n_tiers)]
    lists = save(tiers.groupBy("term").agg(F.first("weight").alias("weight"), F.array(*rest).cast("array<bigint>").alias("rest")), "lists")
    index = long.withColumn("band", band).join(sent_if_small(tiers.select("term", "band", "tier"), 40), ["term", "band"]).select("term", "rid", "doc_id", "x", "tier")
    index = save(index, "impact-index", by=["tier"])
    drop(held)
    drop(tiers)
    return index, lists, n_tiers


def _none(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} long" for c in columns))


def search(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `most` highest-scoring documents of each item, scores above 0 only.

    Null and empty texts have no terms: such documents are in no list, such items have no rows. Every row of `docs` is
    a document and every row of `items` an item, repeated ones too. Equal scores rank by doc_id, null ids last; rows
    equal in both keep an arbitrary but single place each. Long texts are read whole; further columns are not read. An
    empty table on either side gives an empty result. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    asked = save(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")), "asked")
    wanted = save(asked_terms(asked), "wanted")
    index, lists, n_tiers = build_index(docs, wanted.select("term"))
    if not n_tiers:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    needs = save(wanted.join(lists, "term"), "needs")
    drop(wanted)
    needs_sent = sent_if_small(needs, 32 + 8 * n_tiers)
    totals = needs.groupBy("item").agg(*[F.sum(F.col("rest")[r]).alias(f"t{r}") for r in range(n_tiers)])

    state = _none(spark, ["item", "rid", "doc_id", "low", *[f"s{r}" for r in range(n_tiers)]])
    #: bound: the score of the last place so far; open: an unseen document may still reach it; busy: not settled
    status = None
    for r in range(n_tiers):
        tier = index.where(F.col("tier") == r)
        sums = [f"s{k}" for k in range(r, n_tiers)]
        added = ["item", "rid", "doc_id", (F.col("x") * F.col("weight")).alias("low"), *[F.col("rest")[k].alias(f"s{k}") for k in range(r, n_tiers)]]
        if status is None:
            new, kept = tier.join(needs_sent, "term").select(*added), state
        else:
            here = sent_if_small(status, 40)
            kept = state.join(here, "item").where(F.col("low") + F.col(f"t{r - 1}") - F.col(f"s{r - 1}") >= F.col("bound"))
            busy = kept.where("busy and not open").select("item", "rid")
            busy = save(busy, "candidates")
            opened = needs_sent.join(here.where("open").select("item"), "item", "left_semi")
            new = tier.join(F.broadcast(opened) if needs_sent is not needs else opened, "term").select(*added)
            later = tier.join(sent_if_small(busy, 32), "rid").join(needs_sent, ["item", "term"]).select(*added)
            new = new.unionByName(later)
        columns = ["item", "rid", "doc_id", "low", *sums]
        merged = kept.select(*columns).unionByName(new).groupBy("item", "rid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ["low", *sums]])
        before, state = state, save(merged, "bounds")
        drop(before)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
        last = state.select("item", "low", place.alias("place")).where(F.col("place") <= most).groupBy("item").agg(F.when(F.count("*") == most, F.min("low")).otherwise(0).alias("bound"))
        high, total = F.col("low") + F.col(f"t{r}") - F.col(f"s{r}"), F.col(f"t{r}")
        judged = totals.select("item", total).join(last, "item", "left").select("item", f"t{r}", F.coalesce("bound", F.lit(0)).alias("bound")).withColumn("open", (total > 0) & (total >= F.col("bound")))
        judged = save(judged, "bounds-of-items")
        unsure = state.join(sent_if_small(judged, 40), "item").where((high > F.col("low")) & (high >= F.col("bound"))).select("item").distinct().withColumn("unsure", F.lit(True))
        status = save(judged.join(unsure, "item", "left").withColumn("busy", F.col("open") | F.coalesce("unsure", F.lit(False))).drop("unsure"), "status")
        if status.where("busy").isEmpty():
            break
    by_score = Window.partitionBy("item").orderBy(F.desc("low"), F.asc_nulls_last("doc_id"), "rid")
    ranked = state.select("item", "rid", "doc_id", "low").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= most)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", F.col("low").alias("score"))
