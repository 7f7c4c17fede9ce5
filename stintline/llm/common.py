"""Shared pieces: tables in the shared checkpoint folder, word hashing over Arrow buffers, streams of key groups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer document is a part of its own.
PART_BYTES = 1_000_000
#: Rows of a batch that are copied at once.
PART_ROWS = 1_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One of our own stands in where a local master names none; a cluster without one is refused, since executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside; the one before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: For rows of megabytes: the writer looks at its pages after each row and ends a row group after a few. By default it
#: looks after 100 rows, and packs pages of all of them through buffers outside the heap.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.row.count.limit": "8"}


def save(df: DataFrame, name: str, by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write a table in the shared folder, in subfolders of the columns `by`, and read it again. Its shuffle files go once it is written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**(options or {})).parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path  # type: ignore[attr-defined]
    return out


def apart(columns: list[str], known: tuple[str, ...]) -> dict[str, str]:
    """Names under which an operator carries the columns of its input, so that none is one of its own: those it knows by name keep theirs."""
    return {c: c if c in known else f"own_{i}" for i, c in enumerate(columns)}


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is written inside; the session's setting comes back. Spark bounds a batch's bytes itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with setting(spark, key, before if 0 < int(before) <= rows else str(rows)):
        yield


#: Bytes from which an array is given back to the system as soon as it is freed, and the allocator's number of that setting.
FREED_AT_ONCE, _M_MMAP_THRESHOLD = 8 << 20, -3


def lean(run: Callable) -> Callable:
    """`run`, a function of mapInArrow, that gives memory back to the system: large arrays when freed, the rest at its task's end, since workers serve many stages."""

    def whole(batches):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(_M_MMAP_THRESHOLD, FREED_AT_ONCE)
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return whole


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not at some later collection of the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Remove a saved table that nothing lazy needs any more."""
    path = getattr(df, "saved_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Bytes up to which a table is sent to every task; larger ones are shuffled.
SEND_BYTES = 32_000_000


def sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A saved table of rows of fixed width, marked for broadcast if its counted rows of at most `row_bytes` fit SEND_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= SEND_BYTES else df


#: Least bits of a filter of keys (8 MB), bits for a key, and most bits (128 MB); rows of the filter are 4 KB.
FILTER_BITS, BITS_FOR_KEY, MOST_FILTER_BITS, _ROW_BITS = 1 << 26, 16, 1 << 30, 1 << 15


def filter_bits(keys: int) -> int:
    """16 bits a key or more, a power of two: one in 16 other rows passes at most, up to 2^26 keys. Beyond, more pass, never fewer."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (max(1, BITS_FOR_KEY * keys) - 1).bit_length()))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """Bitmaps of the hashes of `key`, by slot, for `may_hold`: as many bits as the counted rows of `keys`, a saved table, ask for."""
    bits = filter_bits(keys.count())
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    slots = keys.select((slot / _ROW_BITS).cast("int").alias("__slot"), (slot % _ROW_BITS).alias("bit"))
    out = save(slots.groupBy("__slot").agg(F.bitmap_construct_agg("bit").alias("__bits")), "filter")
    out.filter_bits = bits  # type: ignore[attr-defined]
    return out


def may_hold(df: DataFrame, key: str, bitmaps: DataFrame) -> DataFrame:
    """`df` with the boolean __may: false only where the filter's keys surely don't hold the row's; no shuffle."""
    slot = F.pmod(F.xxhash64(key), F.lit(bitmaps.filter_bits))
    named = df.withColumn("__slot", (slot / _ROW_BITS).cast("int")).withColumn("__bit", (slot % _ROW_BITS).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(__bits, __bit div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce((byte.bitwiseAND(F.expr("shiftleft(1, __bit % 8)"))) != 0, F.lit(False))
    return named.join(F.broadcast(bitmaps), "__slot", "left").withColumn("__may", hit).drop("__slot", "__bit", "__bits")


# --- words -----------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15
_UP = _DOWN = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    global _UP, _DOWN
    if len(_UP) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _UP, _DOWN = both
    return _UP, _DOWN


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Polynomial hash of each span of bytes, whatever its place: differences of running sums, spans in blocks of `most` bytes."""
    out = np.zeros(len(start), np.uint64)
    k = 0
    while k < len(start):
        low = start[k]
        end = max(k + 1, int(np.searchsorted(start + size, low + most, "right")))
        own = data[low : start[end - 1] + size[end - 1]].astype(np.uint64)
        up, down = _powers(max(len(own), most) + 1)
        own += np.uint64(1)
        own *= up[: len(own)]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own, out=total[1:])
        a = start[k:end] - low
        out[k:end] = mix((total[a + size[k:end]] - total[a]) * down[a] + size[k:end].astype(np.uint64))
        k = end
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def parts(column: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about `most` bytes."""
    for low in range(0, len(column), PART_ROWS):
        data, offsets = utf8(column.slice(low, PART_ROWS))
        row, n = 0, len(offsets) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            yield low + row, low + end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def word_places(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(is each byte in a word, first byte of each word, its length, words before each row); no word runs across rows."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] |= inside[edges]
    start = np.flatnonzero(first)
    # a word ends where the next byte is outside or begins another
    length = np.flatnonzero(inside & np.append(~inside[1:] | first[1:], True)[: len(data)]) + 1 - start
    return inside, start, length, np.searchsorted(start, offsets)


class Words:
    """Words of a part: 64-bit hash, row, first byte and length of each, in order; rows' words are ptr[r]:ptr[r + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True):
        if lower:
            data = LOWER[data]
        _, self.start, self.length, self.ptr = word_places(data, offsets, is_word)
        self.hash = span_hashes(data, self.start, self.length)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.ptr))


# --- groups ----------------------------------------------------------------


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches, each whole, across batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]) if held else pa.Table.from_batches([batch])
        n = table.num_rows
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for k in keys:
            x = table[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        begin = np.flatnonzero(change)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(begin[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches by the given links."""
    root = np.arange(n)
    if len(left):
        while True:
            low = np.minimum(root[left], root[right])
            before = root.copy()
            np.minimum.at(root, left, low)
            np.minimum.at(root, right, low)
            np.minimum.at(root, before[left], low)
            np.minimum.at(root, before[right], low)
            root = root[root]
            if np.array_equal(root, before):
                break
    return root


def sorted_by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key together in one task, in runs that `groups` reads; the keys must name bounded groups."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
