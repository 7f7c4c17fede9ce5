"""Divergence of the sources of a language, from in-mapper stripes.

A task folds whole documents into stripes: for each term of a language the number of its documents and its occurrences
by source. Stripes beyond a fixed number of cells are spilled into the shuffle; stripes of one term meet by key and are
merged. The merged stripes, dealt in slices of terms, emit the divergences: each slice compares sources where both hold
a term, and counts how often a source holds a term how many times, which settles the terms that only one of two holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.llm.common import LOWER, drop, lean, parts, save, word_places

#: Bytes of terms `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`, after A-Z are lower case: letters and all that is not ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Documents of a language that hold a term, at least, for the term to be kept.
LEAST_DOCS = 10
#: Terms shown for each group.
MOST_TERMS = 10
#: Shares are parts of this number.
WHOLE = 1_000_000_000
#: (term, source) cells that a task holds before it spills its stripes.
SPILL_CELLS = 1_000_000
#: Cells of a slice of merged stripes.
SLICE_CELLS = 20_000
#: Ways into which the pairs of a language's sources are dealt.
SALTS = 16

_STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_EMITTED = "lang string, kind string, source string, item string, count long, value long"


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each of the values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(keys) else v for v in values]


def term_cells(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of whole texts, row r being a document of group[r]."""
    data = LOWER[data]
    inside, _, length, ptr = word_places(data, offsets, LETTERS)
    ends = np.append(0, np.cumsum(length)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]).dictionary_encode()
    code, n_codes = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
    row = np.repeat(np.arange(len(group)), np.diff(ptr))
    own, n = _sums(row * n_codes + code, np.ones(len(code), np.int64))
    cell, n, docs = _sums(group[own // n_codes] * n_codes + own % n_codes, n, np.ones(len(own), np.int64))
    return words.dictionary.take(pa.array(cell % n_codes)), cell // n_codes, n, docs


class _Held:
    """The stripes of a task as cells (term, group, occurrences, documents)."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.cells: list[tuple] = []
        self.size = 0

    def add(self, langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        self.cells.append(term_cells(data, offsets, group))
        self.size += len(self.cells[-1][1])

    def fold(self) -> None:
        """Cells of one term and group become one."""
        terms = pa.chunked_array([t for t, *_ in self.cells], pa.large_string()).combine_chunks().dictionary_encode()
        group, n, docs = (np.concatenate([c[i] for c in self.cells]) for i in (1, 2, 3))
        cell, n, docs = _sums(terms.indices.to_numpy().astype(np.int64) * len(self.groups) + group, n, docs)
        self.cells = [(terms.dictionary.take(pa.array(cell // len(self.groups))), cell % len(self.groups), n, docs)]
        self.size = len(cell)

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """One stripe a term and language, and for each group an empty one, so that one without terms is known too."""
        names = list(self.groups)
        langs = pa.array([lang for lang, _ in names], pa.string()).dictionary_encode()
        lang_of, sources = langs.indices.to_numpy().astype(np.int64), pa.array([s for _, s in names], pa.string())
        empty = np.arange(len(names))
        self.cells.append((pa.array([""] * len(names), pa.large_string()), empty, empty * 0, empty * 0))
        self.fold()
        terms, group, n, docs = self.cells[0]
        terms = terms.dictionary_encode()
        key = lang_of[group] * len(terms.dictionary) + terms.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key, n, group, docs = key[order], n[order], group[order], docs[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        bounds = np.append(first, len(key))
        out = [
            langs.dictionary.take(pa.array(key[first] // len(terms.dictionary))),
            terms.dictionary.take(pa.array(key[first] % len(terms.dictionary))).cast(pa.string()),
            pa.array(np.add.reduceat(docs, first)),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), sources.take(pa.array(group))),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(n)),
        ]
        yield from pa.Table.from_arrays(out, names=["lang", "term", "df", "sources", "counts"]).to_batches(10_000)


def _fold(spill_cells: int):
    def run(batches):
        held = _Held()
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, end, data, offsets in parts(batch.column(2)):
                held.add(langs[row:end], sources[row:end], data, offsets)
                if held.size >= 2 * spill_cells:
                    held.fold()
                    if held.size >= spill_cells:
                        yield from held.stripes()
                        held = _Held()
        if held.groups:
            yield from held.stripes()

    return lean(run)


def _merged(rows: pa.Table) -> pa.Table:
    """Sorted stripes, those of one term and language made one."""
    lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
    new = np.ones(len(term), bool)
    new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    lists, counts = rows["sources"].combine_chunks(), rows["counts"].combine_chunks().flatten().to_numpy()
    names = lists.flatten().dictionary_encode()
    run = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy())
    key, counts = _sums(run * len(names.dictionary) + names.indices.to_numpy(), counts)
    bounds = pa.array(np.searchsorted(key // len(names.dictionary), np.arange(len(first) + 1)), pa.int32())
    at = pa.array(first)
    out = [
        lang.take(at),
        term.take(at),
        pa.array(np.add.reduceat(rows["df"].to_numpy(), first)),
        pa.ListArray.from_arrays(bounds, names.dictionary.take(pa.array(key % len(names.dictionary)))),
        pa.ListArray.from_arrays(bounds, pa.array(counts)),
    ]
    return pa.Table.from_arrays(out, names=rows.column_names)


def _merge(least_docs: int):
    """Stripes sorted by language and term to one a term; terms in too few documents go."""

    def kept(rows: pa.Table) -> list[pa.RecordBatch]:
        return rows.filter(pc.or_(pc.greater_equal(rows["df"], least_docs), pc.equal(rows["term"], ""))).to_batches()

    def run(batches):
        last = None  # the stripe that the next batch may go on with
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = _merged(rows if last is None else pa.concat_tables([last, rows]))
                yield from kept(rows.slice(0, len(rows) - 1))
                last = rows.slice(len(rows) - 1)
        if last is not None:
            yield from kept(last)

    return lean(run)


def stripes(docs: DataFrame, least_docs: int = LEAST_DOCS, spill_cells: int = SPILL_CELLS) -> DataFrame:
    """(lang, term, df, sources, counts) of the kept terms, merged; the term '' lists all sources of a language."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = plain.mapInArrow(_fold(spill_cells), _STRIPE)
    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least_docs), _STRIPE)


def share(count: np.ndarray, total: np.ndarray, v: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (count + 2) / (total + 2 v)) by long division in three steps, so that nothing overflows."""
    out, rest, by = np.zeros_like(count), count + 2, np.maximum(total + 2 * v, 1)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // by
        rest = rest * 1000 % by
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _share(count: Column, total: Column, v: Column) -> Column:
    whole = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * whole(count + 2), whole(F.greatest(total + 2 * v, F.lit(1)))) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _emit(most_terms: int):
    """A slice of merged stripes and the sources of its language to rows of three kinds.

    term: a source's best terms of the slice; pair: for two sources, what the terms that both hold add beyond the
    terms that one of them lacks; count: how many terms a source holds `count` times.
    """

    def run(key: tuple, stripe: pa.Table, roster: pa.Table) -> pa.Table:
        rows = []
        if stripe.num_rows and roster.num_rows:
            stripe = stripe.take(pc.sort_indices(stripe["term"].cast(pa.binary())))
            roster = roster.sort_by("source")
            n_sources = roster.num_rows
            group_n, lang_n, v = (roster[c].to_numpy() for c in ("n", "lang_n", "v"))
            lists = stripe["sources"].combine_chunks()
            t = np.repeat(np.arange(stripe.num_rows), pc.list_value_length(lists).to_numpy())
            s = pc.index_in(lists.flatten(), value_set=roster["source"].combine_chunks()).to_numpy().astype(np.int64)
            c = stripe["counts"].combine_chunks().flatten().to_numpy()
            order = np.lexsort((s, t))
            t, s, c = t[order], s[order], c[order]
            total = np.zeros(stripe.num_rows, np.int64)
            np.add.at(total, t, c)
            p, p0 = share(c, group_n[s], v[s]), share(np.zeros(n_sources, np.int64), group_n, v)
            q = share(total, lang_n[:1], v[:1])[t]
            f = distance(p, q)

            better = np.flatnonzero(p > q)
            better = better[np.lexsort((t[better], -f[better], s[better]))]
            place = np.arange(len(better)) - np.searchsorted(s[better], s[better])
            best = better[place < most_terms]
            rows.append(("term", s[best], pc.take(stripe["term"], pa.array(t[best])), np.zeros(len(best), np.int64), f[best]))

            kinds, n = np.unique(np.stack([s, c]), axis=1, return_counts=True)
            rows.append(("count", kinds[0], pa.nulls(len(n), pa.string()), kinds[1], n))

            held: list[tuple[np.ndarray, np.ndarray]] = []
            i, step, waiting = np.arange(len(t)), 1, 0

            def summed() -> list[tuple[np.ndarray, np.ndarray]]:
                keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, where, np.concatenate([x for _, x in held]))
                return [(keys, sums)]

            while len(i := i[i + step < len(t)]) and len(i := i[t[i] == t[i + step]]):
                j = i + step
                more = distance(p[i], p[j]) - distance(p[i], p0[s[j]]) - distance(p0[s[i]], p[j]) + distance(p0[s[i]], p0[s[j]])
                held.append((s[i] * n_sources + s[j], more))
                waiting += len(i)
                if waiting > 1_000_000:
                    held, waiting = summed(), 0
                step += 1
            if held:
                keys, sums = summed()[0]
                rows.append(("pair", keys // n_sources, pc.take(roster["source"], pa.array(keys % n_sources)), np.zeros(len(keys), np.int64), sums))
        tables = [
            pa.table({"lang": pa.array([key[0].as_py()] * len(x), pa.string()), "kind": pa.array([kind] * len(x), pa.string()), "source": pc.take(roster["source"], pa.array(x)), "item": item, "count": pa.array(count, pa.int64()), "value": pa.array(value, pa.int64())})
            for kind, x, item, count, value in rows
        ]
        empty = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("source", pa.string()), ("item", pa.string()), ("count", pa.int64()), ("value", pa.int64())])
        return pa.concat_tables(tables) if tables else empty.empty_table()

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, spill_cells: int = SPILL_CELLS, slice_cells: int = SLICE_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from each other and from the whole.

    Null lang, source and text count as ''. Every row is a document, so a repeated row counts again. A group without
    terms, and one whose language keeps no term, has its pairs (of value 0 in the latter case) and no terms. Equal
    values rank by the item's bytes. Long texts are read whole, further columns are not read; an empty table gives an
    empty one.
    """
    kept = save(stripes(docs, least_docs, spill_cells), "stripes")
    cells = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    groups = cells.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_n"))
    roster = save(groups.join(langs, "lang").select("lang", "source", "n", "lang_n", "v"), "roster")

    # a slice holds many more cells than its language has sources, so that the roster of all slices is smaller than they
    sizes = kept.where("term <> ''").agg(F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("n")).crossJoin(roster.agg(F.count("*").alias("m"))).first()
    slices = 1 + sizes.n // max(slice_cells, 10 * sizes.m)
    left = kept.where("term <> ''").select("*", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice"))
    right = roster.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    emitted = save(left.groupBy("lang", "slice").cogroup(right.groupBy("lang", "slice")).applyInArrow(_emit(most_terms), _EMITTED), "emitted")
    drop(kept)

    counted = emitted.where("kind = 'count'").groupBy("lang", "source", "count").agg(F.sum("value").alias("terms"))
    held = counted.groupBy("lang", "source").agg(F.sum("terms").alias("held"))
    lacking = roster.join(held, ["lang", "source"], "left").select("lang", "source", F.lit(0).cast("long").alias("count"), (F.col("v") - F.coalesce("held", F.lit(0))).alias("terms"))
    own = counted.unionByName(lacking).join(roster, ["lang", "source"]).withColumn("salt", F.pmod(F.xxhash64("source", "count"), F.lit(SALTS)).cast("int"))
    other = roster.select("lang", F.col("source").alias("item"), _share(F.lit(0), F.col("n"), F.col("v")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    p, q = _share(F.col("count"), F.col("n"), F.col("v")), F.col("q")
    alone = F.col("terms") * _distance(p, q)
    # what both lack is in both directions; once is enough
    twice = F.when((F.col("count") == 0) & (F.col("source") < F.col("item")), F.col("v") * _distance(p, q)).otherwise(0)
    ends = [F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")]
    one = own.join(other, ["lang", "salt"]).where("source <> item").select("lang", *ends, (alone - twice).alias("value"))
    sums = one.unionByName(emitted.where("kind = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("w")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", "value", ways).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    best = emitted.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    best = best.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(best)
