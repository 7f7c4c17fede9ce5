"""Benchmark decontamination with a stored, document-partitioned positional inverted index.

Each shard of the index holds some whole documents: the sorted distinct terms of the shard, and for each term the
sorted positions at which it stands. Phrases are looked up shard by shard: the list of the rarest term is moved by
the term's offset, then intersected with the other lists, rarest first.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import ALNUM, LARGE_ROWS, Words, lean, parts, save

WINDOW = 10
#: Phrases that one pass over the index carries; more take further passes.
PASS_PHRASES = 200_000
INDEX = "shard string, doc_ids array<long>, doc_starts array<long>, n_words array<long>, terms array<long>, term_starts array<long>, positions array<int>"


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, hashes of its words in order) of each item that has words; the same word hash as the index."""

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in parts(batch.column(1)):
                w = Words(data, offsets, ALNUM)
                lists = [w.hash[w.ptr[r] : w.ptr[r + 1]].view(np.int64) for r in range(end - row)]
                yield pa.record_batch([batch.column(0).slice(row, end - row), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "words"])

    plain = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(lean(run), "item_id string, words array<long>").where("size(words) > 0")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write and read again the index of `docs`: the postings of all of their words.

    A shard spans about 2 MB of text and at least one whole document. Positions count the words of a shard, with one
    unused position after each document, so that no phrase runs across documents.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in parts(batch.column(1)):
                w = Words(data, offsets, ALNUM)
                position = np.arange(len(w.hash)) + w.row
                h = w.hash
                order = np.argsort(h, kind="stable")
                h, position = h[order], position[order]
                begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                lists = [w.ptr[:-1] + np.arange(end - row), np.diff(w.ptr), h[begin].view(np.int64), np.append(begin, len(h)), position.astype(np.int32)]
                yield pa.record_batch(
                    [pa.array([uuid.uuid4().hex]), pa.array([batch.column(0).slice(row, end - row).to_pylist()], pa.list_(pa.int64())), *[pa.array([x]) for x in lists]],
                    names=["shard", "doc_ids", "doc_starts", "n_words", "terms", "term_starts", "positions"],
                )

    return save(plain.mapInArrow(lean(run), INDEX), "index", options=LARGE_ROWS)


class Phrases:
    """A bounded set of phrases (words' hashes, of one length or less), rarest term first."""

    def __init__(self, phrases: list[tuple[int, np.ndarray]], counts: dict[int, int] | None = None):
        self.item = np.array([i for i, _ in phrases], np.int64)
        self.size = np.array([len(x) for _, x in phrases], np.int64)
        most = int(self.size.max()) if len(phrases) else 0
        self.words = np.zeros((len(phrases), most), np.uint64)
        for k, (_, x) in enumerate(phrases):
            self.words[k, : len(x)] = x
        self.terms = np.unique(np.concatenate([x for _, x in phrases])) if phrases else np.zeros(0, np.uint64)
        weight = np.array([(counts or {}).get(int(t), 0) for t in self.terms], np.int64)
        number = np.searchsorted(self.terms, self.words).clip(max=max(len(self.terms) - 1, 0))
        rank = weight[number] if len(self.terms) else np.zeros_like(self.words, dtype=np.int64)
        beyond = np.arange(most)[None, :] >= self.size[:, None]
        self.order = np.argsort(np.where(beyond, np.iinfo(np.int64).max, rank), axis=1, kind="stable")


class Shard:
    """One row of the index."""

    def __init__(self, row: dict):
        self.terms = np.asarray(row["terms"], np.int64).view(np.uint64)
        self.starts = np.asarray(row["term_starts"], np.int64)
        self.positions = np.asarray(row["positions"], np.int64)
        self.doc_starts = np.asarray(row["doc_starts"], np.int64)
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.span = int(self.doc_starts[-1] + self.n_words[-1] + 1) if len(self.doc_starts) else 0

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of the words begin and end; equal where a word has none."""
        at = np.searchsorted(self.terms, words).clip(max=max(len(self.terms) - 1, 0))
        known = self.terms[at] == words if len(self.terms) else np.zeros(len(words), bool)
        return np.where(known, self.starts[at], 0), np.where(known, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0)

    def exact(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence."""
        if not len(p.item) or not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        span = self.span + p.words.shape[1]  # a moved position stays within its term's range
        keys = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * span + self.positions  # sorted by term, then position
        first = p.order[:, 0]
        a, b = self.of(p.words[np.arange(len(first)), first])
        phrase = np.repeat(np.arange(len(first)), b - a)
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        start = self.positions[a[phrase] + inner] - first[phrase]
        for k in range(1, p.words.shape[1]):
            more = p.size[phrase] > k
            place = p.order[phrase, k]
            word = p.words[phrase, place]
            at = np.searchsorted(self.terms, word).clip(max=len(self.terms) - 1)
            want = at * span + start + place
            hit = np.searchsorted(keys, want).clip(max=len(keys) - 1)
            good = ~more | ((self.terms[at] == word) & (keys[hit] == want))
            phrase, start = phrase[good], start[good]
        good = start >= 0
        return phrase[good], start[good]

    def near(self, p: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) where a span of at most len + slop words that begins there holds each word of the phrase, as often as the phrase does, in any order."""
        found = [], []
        for k in range(len(p.item)):
            words, times = np.unique(p.words[k, : p.size[k]], return_counts=True)
            a, b = self.of(words)
            if (b - a < times).any():
                continue
            lists = sorted(((self.positions[x:y], n) for x, y, n in zip(a, b, times, strict=True)), key=lambda x: len(x[0]))
            length = p.size[k] + slop
            start = np.unique(lists[0][0][:, None] - np.arange(length)[None, :])
            start = start[start >= 0]
            doc = np.searchsorted(self.doc_starts, start, "right") - 1
            start, doc = start[doc >= 0], doc[doc >= 0]
            inside = start < self.doc_starts[doc] + self.n_words[doc]
            start, doc = start[inside], doc[inside]
            end = np.minimum(start + length, self.doc_starts[doc] + self.n_words[doc])
            good = np.ones(len(start), bool)
            begins = np.zeros(len(start), bool)
            for x, n in lists:
                low = np.searchsorted(x, start)
                good &= low + n <= np.searchsorted(x, end)
                begins |= x[low.clip(max=len(x) - 1)] == start
            start = start[good & begins]
            found[0].append(np.full(len(start), k))
            found[1].append(start)
        return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _lookup(p: Phrases, items: list[str], slop: int | None):
    """(doc_id, n_words, items, phrase positions, phrase lengths) of every document of each shard."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].values.to_numpy(zero_copy_only=False) if name not in ("shard", "doc_ids") else batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                s = Shard(row)
                phrase, start = s.exact(p) if slop is None else s.near(p, slop)
                doc = np.searchsorted(s.doc_starts, start, "right") - 1
                order = np.argsort(doc, kind="stable")
                phrase, start, doc = phrase[order], start[order], doc[order]
                cut = np.searchsorted(doc, np.arange(len(s.doc_starts) + 1))
                own, where, size = [], [], []
                for d in range(len(s.doc_starts)):
                    ph = phrase[cut[d] : cut[d + 1]]
                    own.append([items[i] for i in np.unique(p.item[ph])])
                    where.append(start[cut[d] : cut[d + 1]] - s.doc_starts[d])
                    size.append(p.size[ph])
                yield pa.record_batch(
                    [pa.array([row["shard"]] * len(own)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(s.n_words), pa.array(own, pa.list_(pa.string())), pa.array(where, pa.list_(pa.int64())), pa.array(size, pa.list_(pa.int64()))],
                    names=["shard", "doc", "doc_id", "n_words", "items", "starts", "sizes"],
                )

    return run


def windows(words: np.ndarray, n: int = WINDOW) -> list[np.ndarray]:
    """All runs of n words; fewer words, but some, are one run."""
    return [words[i : i + n] for i in range(max(1, len(words) - n + 1))] if len(words) else []


def _count(terms: np.ndarray):
    """(term, n) of the given sorted terms in each shard."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(0)[k].values.to_numpy(zero_copy_only=False)
                n = np.diff(batch.column(1)[k].values.to_numpy(zero_copy_only=False))
                kept = np.isin(own.view(np.uint64), terms)
                yield pa.record_batch([pa.array(own[kept]), pa.array(n[kept])], names=["term", "n"])

    return run


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """One row per document: (doc_id, n_words, items, starts, sizes) of its exact phrases, or of spans with `slop` further words.

    Items are split into passes of at most PASS_PHRASES windows; each pass sends a set of that bound to the tasks and
    reads the stored index, so a benchmark of any size works. There is one pass at least. Passes meet by document.
    """
    held = save(item_words(items, item_col, item_text), "items")
    index = build_index(docs, id_col, text_col)
    out, passes = None, 0
    for names, found in _passes(held, window):
        counted = index.select("terms", "term_starts").mapInArrow(lean(_count(Phrases(found).terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        phrases = Phrases(found, {int(np.array([r.term], np.int64).view(np.uint64)[0]): r.n for r in counted.collect()})
        one = index.mapInArrow(lean(_lookup(phrases, names, slop)), "shard string, doc int, doc_id long, n_words long, items array<string>, starts array<long>, sizes array<long>")
        out, passes = one if out is None else out.unionByName(one), passes + 1
    if passes > 1:
        whole = [F.flatten(F.collect_list(c)).alias(c) for c in ("items", "starts", "sizes")]
        out = out.groupBy("shard", "doc").agg(F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n_words"), *whole)
    return out.select("doc_id", "n_words", F.array_distinct("items").alias("items"), "starts", "sizes")


def _passes(items: DataFrame, window: int):
    """(item names, distinct windows of each) in passes of bounded size, as items stream to the driver; one empty pass for none."""
    names, found, any_pass = [], [], False
    for row in items.toLocalIterator():
        names.append(row.item_id)
        words = np.array(row.words, np.int64).view(np.uint64)
        for w in {x.tobytes(): x for x in windows(words, window)}.values():
            if len(found) >= PASS_PHRASES:
                yield names, found
                names, found, any_pass = [row.item_id], [], True
            found.append((len(names) - 1, w))
    if found or not any_pass:
        yield names, found


def _n_hit(starts: str, sizes: str) -> Column:
    """Words inside any of the phrases: the length of the union of their spans."""
    spans = F.array_sort(F.arrays_zip(starts, sizes))
    none = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))

    def further(own: Column, x: Column) -> Column:
        end = x[starts] + x[sizes]
        return F.struct((own.total + F.greatest(F.lit(0).cast("long"), end - F.greatest(x[starts], own.reach))).alias("total"), F.greatest(own.reach, end).alias("reach"))

    return F.aggregate(spans, none, further, lambda own: own.total)


def contamination(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated) of each document.

    Words are runs of digits, letters and non-ASCII bytes, A-Z in lower case. A window is `window` consecutive words
    of an item, or all words of a shorter one; a document word inside any occurrence of a window is hit. Null and
    empty texts have no words; null items and those without words match nothing; items of equal text all count.
    Rows that repeat a document each give a row. Null ids are kept as they are. Item ids are compared as strings; ties
    have no effect. Long texts are indexed whole, one to a shard. Further columns, whatever their names, play no part.
    Without documents the result is empty; without items nothing is hit.
    """
    merged = matches(docs, items, **how).select("doc_id", "n_words", _n_hit("starts", "sizes").alias("n_hit"), "items")
    listed = F.array_join(F.array_sort("items"), ",")
    return merged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )
