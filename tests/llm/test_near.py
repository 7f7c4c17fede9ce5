"""MinHash, hyperplanes and components against brute force."""

import math
import random
import re

import numpy as np
import pytest

from stintline.llm import common, components, hyperplanes, minhash


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 140))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    docs += [docs[0], docs[0].upper(), "one two", "ONE  two", "", "   ", "É é", "é É", "x " * 4000]
    rng.shuffle(docs)
    return [(i * 3, d) for i, d in enumerate(docs)]


@pytest.mark.parametrize("block", [3, 128])
def test_minhash_matches_brute_force(spark, block):
    rows = [*corpus(), (100_000, None)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    df = spark.createDataFrame([(i, t, "a", "b", i) for i, t in rows], "doc_id long, text string, digest string, rep string, component long")
    got = {r.doc_id: r for r in minhash.near_duplicates(df.repartition(3), block=block).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_minhash_nulls_repeats_and_empty(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (2, text), (7, None)], "doc_id long, text string")
    got = sorted([(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()], key=str)
    assert got == sorted([(None, None, True), (5, 2, False), (5, 2, False), (2, 2, True), (7, 7, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((20, 16))
    rows = [(i, (base[i % 20] + rng.standard_normal(16) * 0.12 * (i % 5)).tolist()) for i in range(160)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] * 16), (1003, [math.inf] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, [1.0, 2.0])]
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}

    def cosine(a, b):
        return a @ b / math.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else -1

    links = [(a, b) for a in good for b in good if a < b and cosine(good[a], good[b]) >= 0.9]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, label int, band string")
    for block in (4, 512):
        got = {r.vec_id: r for r in hyperplanes.near_vectors(df, block=block).collect()}
        want = closure([i for i, _ in rows if i is not None], links)
        assert {i: r.component_id for i, r in got.items() if i is not None} == want
        assert {i: r.n_links for i, r in got.items() if i is not None} == {i: sum(i in x for x in links) for i in want}
        assert got[None].n_links == 0 and got[None].kept
    assert hyperplanes.near_vectors(df.limit(0)).collect() == []


def test_tables_make_up_for_longer_keys():
    for n in (10, 10_000, 10**7, 10**10):
        bits, tables = hyperplanes.shape(n)
        same = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - same) ** tables >= 0.998


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    good = [x for x in links if x[1] is not None and x[0] != x[1]]
    want = closure({n for x in good for n in x}, good)
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_pipeline_stage_takes_near_copies_from_80_percent(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(104)]
    docs = [(1, base), (2, [*base[:94], *(f"x{i}" for i in range(10))]), (3, [*base[:85], *(f"y{i}" for i in range(19))])]
    rows = [(i, " ".join(w)) for i, w in docs]
    a, b, c = (shingles(t) for _, t in rows)
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b) and 100 * len(a & c) < 80 * len(a | c) and 100 * len(b & c) < 80 * len(b | c)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, df, "").collect()} == {1, 3}


def test_sketch_tells_long_texts_apart():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**63, 800_000, dtype=np.uint64) * np.uint64(2)
    first, second = minhash.signatures(hashes, np.array([0, 400_000, 800_000]))
    a, b = (minhash.sketch_of(x) for x in (first, second))
    assert (a == b).sum() <= 2 and (minhash.sketch_of(first) == a).all()


def test_filter_follows_the_number_of_keys():
    assert common.filter_bits(0) == common.filter_bits(1000) == common.FILTER_BITS
    assert common.filter_bits(5_000_000) == 1 << 27 and common.filter_bits(10**10) == common.MOST_FILTER_BITS
