"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, star components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import drop, forest, groups, lean, save, sorted_by_group
from stintline.llm.components import connected_components

COSINE = 0.9
#: Chance to find a pair that lies exactly at the threshold; nearer pairs are found more often.
RECALL = 0.998
#: Vectors that a bucket holds on average, and members of a block of a larger bucket.
BUCKET, BLOCK = 256, 512


def shape(n: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits of a key, tables): buckets stay near `bucket` vectors as n grows, and tables make up for the longer keys."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / bucket)))
    same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


def _sign(bits: int, tables: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            size = np.diff(offsets)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = flat[(offsets[rows][:, None] + np.arange(d)[None, :])].astype(np.float64)
                if d not in planes:
                    planes[d] = np.random.default_rng([7, int(d)]).standard_normal((int(d), bits * tables))
                sign = (x @ planes[d] > 0).reshape(len(rows), tables, bits)
                keys = (sign * (np.int64(1) << np.arange(bits))).sum(axis=2)
                yield pa.record_batch(
                    [
                        pa.array(ids[rows]),
                        pa.array(np.full(len(rows), d, np.int32)),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.array([k.tobytes() for k in keys], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    names=["vec_id", "dim", "vec", "all_keys", "keys"],
                )

    return run


def _links(cosine: float):
    """(vec_id, links, root) of each block pair: links first met in this table, and the smallest id of the linked part."""

    def run(batches):
        for g in groups(batches, ["dim", "band", "key", "block_a", "block_b"]):
            n = g.num_rows
            if n < 2:
                continue
            order = np.argsort(g["vec_id"].to_numpy(), kind="stable")
            ids, side = g["vec_id"].to_numpy()[order], g["own"].to_numpy()[order]
            x = np.frombuffer(b"".join(g["vec"].to_pylist()), np.float64).reshape(n, -1)[order]
            keys = np.frombuffer(b"".join(g["all_keys"].to_pylist()), np.int64).reshape(n, -1)[order]
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            near = np.triu(x @ x.T >= cosine, 1)
            if g["block_a"][0].as_py() != g["block_b"][0].as_py():
                near &= side[:, None] != side[None, :]
            left, right = np.nonzero(near)
            band = g["band"][0].as_py()
            if band and len(left):
                new = np.ones(len(left), bool)
                for t in range(band):
                    new &= keys[left, t] != keys[right, t]
                left, right = left[new], right[new]
            if not len(left):
                continue
            links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
            some = np.flatnonzero(links)
            yield pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[forest(n, left, right)[some]])], names=["vec_id", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector of `vectors`, which may hold any other columns.

    A pair is tried if the signs of its projections on `bits` random hyperplanes agree in one of several tables, and
    linked if its cosine in double precision is at least `cosine`; a pair that meets in several tables counts once.
    Vectors of different lengths have no cosine and link with nothing, as do null, empty, zero and non-finite
    vectors or those with null parts. Ties go to the smallest id. Rows that repeat an id are one vector (the smallest, if they differ); rows of
    null ids stay single, with null components, and are kept. An empty table gives an empty result.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    single = plain.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    single = save(single.unionByName(plain.where("vec_id is null")), "vectors")
    good = single.where(
        "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    # scaled by the largest part, so that squares neither overflow nor vanish
    good = good.withColumn("embedding", F.expr("transform(embedding, x -> x / array_max(transform(embedding, y -> abs(y))))"))
    bits, tables = shape(good.count(), cosine, recall)
    signed = save(good.mapInArrow(lean(_sign(bits, tables)), "vec_id long, dim int, vec binary, all_keys binary, keys array<long>"), "signed")
    cells = ["dim", "band", "key"]
    sizes = save(signed.select("dim", F.posexplode("keys").alias("band", "key")).groupBy(*cells).agg(F.count("*").alias("n")).where("n > 1"), "cells")
    rows = signed.select("vec_id", "dim", "vec", "all_keys", F.posexplode("keys").alias("band", "key")).join(sizes, cells)
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("vec_id", "vec", "all_keys", *cells, "own", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"))
    found = save(sorted_by_group(rows, [*cells, "block_a", "block_b"]).mapInArrow(lean(_links(cosine)), "vec_id long, links long, root long"), "links")
    counts = save(found.groupBy("vec_id").agg(F.sum("links").alias("links")), "counts")
    components = save(connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))), "components")
    for x in (signed, sizes, found):
        drop(x)
    out = single.select("vec_id").join(counts, "vec_id", "left").join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select(
        F.col("vec_id").alias(id_col) if id_col != "vec_id" else "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
    )
