"""MinHash near-dedup: universal minima, banding, signature verification, exact confirmation, star components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.blocks import block_pairs, bucket_sizes
from stintline.llm.common import NOT_SPACE, Words, drop, forest, groups, key_filter, lean, may_hold, mix, parts, save, sorted_by_group
from stintline.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Members of a block of a hot bucket.
BLOCK = 128
#: A link: 100 * intersection >= percent * union. PERCENT is that of the pipeline's stage, OP2_PERCENT that of op2.
PERCENT, OP2_PERCENT = 80, 85

_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: Words, rows: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and where each row's begin and end; fewer words than k, but some, are one shingle."""
    h, count = words.hash, np.diff(words.ptr)
    n = len(h)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    ptr = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ptr[-1], np.uint64)
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            full += h[i : n - k + 1 + i] * _PLACE[i]
        inside = words.row[: n - k + 1] == words.row[k - 1 :]
        at = np.repeat(count >= k, size)
        out[at] = mix(full[inside])
    for r in np.flatnonzero((count > 0) & (count < k)):
        own = h[words.ptr[r] : words.ptr[r + 1]]
        out[ptr[r]] = mix(np.array([(own * _PLACE[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
    return out, ptr


def signatures(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS multiply-add hashes modulo 2**64; rows without shingles are left out."""
    begin = ptr[:-1][np.diff(ptr) > 0]
    out = np.zeros((len(begin), BANDS * ROWS), np.uint64)
    for i, (a, b) in enumerate(zip(_MULTIPLY, _ADD, strict=True)):
        out[:, i] = np.minimum.reduceat(hashes * a + b, begin) if len(begin) else 0
    return out


def sketch_of(minima: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, mixed, since the top bits of minima over many shingles are all zero."""
    return (mix(minima) >> np.uint64(48)).astype(np.uint16)


def _sign(batches):
    """(doc_id, digest of the set, its size, band keys, 16 bits of each minimum) of each document."""
    for batch in batches:
        for row, end, data, offsets in parts(batch.column(1)):
            words = Words(data, offsets, NOT_SPACE)
            hashes, ptr = shingle_hashes(words, end - row)
            minima = signatures(hashes, ptr)
            keys = mix((minima.reshape(len(minima), BANDS, ROWS) * _PLACE[:ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
            short = sketch_of(minima)
            digest, size, band, sketch, k = [], [], [], [], 0
            for r in range(end - row):
                own = np.unique(hashes[ptr[r] : ptr[r + 1]])
                size.append(len(own))
                if len(own):
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    band.append(keys[k].view(np.int64))
                    sketch.append(short[k].tobytes())
                    k += 1
                else:
                    digest.append(None)
                    band.append(None)
                    sketch.append(None)
            yield pa.record_batch(
                [batch.column(0).slice(row, end - row), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "digest", "n_shingles", "bands", "sketch"],
            )


def _sets(batches):
    """(doc_id, digest, sorted set of shingle hashes as bytes) of each document that has one."""
    for batch in batches:
        for row, end, data, offsets in parts(batch.column(1)):
            hashes, ptr = shingle_hashes(Words(data, offsets, NOT_SPACE), end - row)
            owns = [np.unique(hashes[ptr[r] : ptr[r + 1]]) for r in range(end - row)]
            some = [i for i, x in enumerate(owns) if len(x)]
            yield pa.record_batch(
                [
                    batch.column(0).slice(row, end - row).take(pa.array(some, pa.int64())),
                    pa.array([hashlib.blake2b(owns[i].tobytes(), digest_size=16).digest() for i in some], pa.binary()),
                    pa.array([owns[i].tobytes() for i in some], pa.binary()),
                ],
                names=["doc_id", "digest", "hashes"],
            )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within a bounded group, by products of slices of the incidence matrix."""
    n = len(sets)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = np.repeat(np.arange(n), [len(x) for x in sets])[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.int64)
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        hit = np.zeros((n, 4096), np.float32)
        hit[owner[a:b], column[a:b] - low] = 1
        out += (hit @ hit.T).astype(np.int64)
    return out


def confirm(percent: int, least_agree: int):
    """Links of each block pair: minima agree often enough, then the full sets overlap enough. Gives a star per linked part."""

    def run(batches):
        u, v = [], []
        for g in groups(batches, ["band", "key", "block_a", "block_b"]):
            n = g.num_rows
            if n < 2:
                continue
            ids = g["rep"].to_numpy()
            side = g["own"].to_numpy()
            low, high = g["block_a"][0].as_py(), g["block_b"][0].as_py()
            order = np.argsort(ids, kind="stable")
            ids, side = ids[order], side[order]
            sketch = np.frombuffer(b"".join(g["sketch"].to_pylist()), np.uint16).reshape(n, -1)[order]
            hashes = g["hashes"].to_pylist()
            sets = [np.frombuffer(hashes[i], np.uint64) for i in order]
            wanted = np.zeros((n, n), bool)
            for i in range(n - 1):
                wanted[i, i + 1 :] = (sketch[i + 1 :] == sketch[i]).sum(axis=1) >= least_agree
            if low != high:
                wanted &= side[:, None] != side[None, :]
            if not wanted.any():
                continue
            if n == 2:
                both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
            else:
                both = overlaps(sets)
            size = np.array([len(x) for x in sets])
            left, right = np.nonzero(wanted & (100 * both >= percent * (size[:, None] + size[None, :] - both)))
            root = forest(n, left, right)
            moved = np.flatnonzero(root != np.arange(n))
            u += ids[moved].tolist()
            v += ids[root[moved]].tolist()
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = OP2_PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs`, which may hold any other columns.

    Words are runs of bytes other than space and 09-0D, A-Z in lower case; the set of a document is its distinct
    5-word shingles, as 64-bit hashes. Documents with equal sets are linked to the smallest id among them. The other
    candidates share one of 24 bands of 5 minima (a pair at 0.85 is missed with a chance below 1e-6); a pair counts
    if its minima agree about as often as the threshold asks (five standard deviations less) and then
    100 * intersection >= percent * union of the full sets.

    Null, empty and blank texts have no shingles and link with nothing. Rows with a null id link with nothing: their
    component is null and they are kept. Rows that repeat an id are one document, linked by each of its texts. Ties
    go to the smallest id. Long texts count in whole. An empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = save(plain.mapInArrow(lean(_sign), "doc_id long, digest binary, n_shingles long, bands array<long>, sketch binary"), "minhash")
    some = signed.where("doc_id is not null and digest is not null")
    classes = save(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "classes")

    members = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = bucket_sizes(members, ["band", "key"], "rep")
    needed = save(members.join(sizes, ["band", "key"]).select("rep").distinct(), "needed")
    # few texts but the needed ones reach the shuffle
    bitmaps = key_filter(needed, "rep")
    asked = may_hold(plain, "doc_id", bitmaps).where("__may").select("doc_id", "text")
    full = asked.join(needed.withColumnRenamed("rep", "doc_id"), "doc_id").mapInArrow(lean(_sets), "doc_id long, digest binary, hashes binary")
    sets = save(full, "sets")
    meant = classes.join(sets.select("digest", "hashes", F.col("doc_id").alias("rep")), ["digest", "rep"]).select("rep", "digest", "sketch", "hashes").dropDuplicates(["rep", "digest"])

    probability = percent / 100
    minima = BANDS * ROWS
    least = math.floor(minima * probability - 5 * math.sqrt(minima * probability * (1 - probability)))
    pairs = block_pairs(members, sizes, ["band", "key"], "rep", block).join(meant.drop("digest"), "rep")
    near = sorted_by_group(pairs, ["band", "key", "block_a", "block_b"]).mapInArrow(lean(confirm(percent, least)), "u long, v long")
    copies = some.join(classes.where("copies > 1").select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    components = save(connected_components(near.union(copies)), "components")
    for x in (sets, sizes, needed, bitmaps, classes):
        drop(x)
    out = signed.select("doc_id", "n_shingles").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select(
        F.col("doc_id").alias(id_col) if id_col != "doc_id" else "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, of the smallest id of each group of near copies; a repeated row stays as often as it came."""
    gone = save(near_duplicates(docs.select("doc_id", "text"), **how).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti")
