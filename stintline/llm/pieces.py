"""SentencePiece encoding and decoding over a relational lattice of the corpus's distinct words.

Texts are cut before each run of spaces, around newlines and between other bytes that stand side by side in no piece:
nowhere there can a piece cross, so the parts, called words here, have best paths of their own. Every distinct word is exploded into substrings of at most a piece's length, these meet the piece table in an equi-join, edges are grouped
by word, and a SQL aggregate folds the best path; long words are folded without rows. Documents then take their words'
ids: the most frequent words from a bounded table sent to the tasks, all others by a join.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import PART_ROWS, batches_of, drop, lean, parts, release, save, setting, span_hashes

SPACE = "\u2581"
#: Stands for a space mark that the text itself holds; its bytes are encoded, so that decoding gives it back.
_OWN_MARK = "\ufdd0"
#: A word of more bytes is folded over the piece table in one pass of its task, whole, since its lattice as rows would carry the word as often as it has edges.
LONG = 512
#: Words of the table that is sent to the tasks, at most, and ids of each: a proven bound on its bytes (16 and 4 an id).
FREQUENT, SENT_IDS = 500_000, 16
#: Bytes of a model's pieces up to which their table is sent to the tasks; a larger one is joined by a shuffle.
SENT_PIECES = 64_000_000
UNKNOWN_PENALTY = 10.0
#: Words of a lattice task on average, and how many of them its aggregation may hold without sorting.
WORDS_IN_TASK, WORDS_HELD = 8_192, 32_768
#: Distinct words that a task holds before it hands their counts on; a word weighs one more for each WORD_BYTES of it.
WORDS_COUNTED, WORD_BYTES = 600_000, 40
#: Rows of an Arrow batch of texts in the passes that are written at once.
TEXTS_IN_BATCH = 2_000
_HELD = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def _on_paths(texts: list[str], scores: list[float], usable: list[bool], lowest: float) -> list[bool]:
    """Usable pieces less those whose own characters other pieces spell at a clearly higher sum: no best path holds one, since the spelling could take its place."""
    table: dict[str, float] = {}
    out = [False] * len(texts)
    most = 1
    for i in sorted((i for i, ok in enumerate(usable) if ok), key=lambda i: len(texts[i])):
        t, n = texts[i], len(texts[i])
        best = [0.0] + [-np.inf] * n
        for f in range(n):
            for e in range(f + 1, min(n, f + most) + 1):
                own = table.get(t[f:e], lowest if e == f + 1 else None)
                if own is not None and best[f] + own > best[e]:
                    best[e] = best[f] + own
        if n == 1 or not best[n] > scores[i] + 1e-6 * (1 + abs(scores[i])):
            table[t], out[i], most = max(scores[i], table.get(t, -np.inf)), True, max(most, n)
    return out


@dataclass
class Pieces:
    """A model's pieces: text and score by id, whether a best path can use it, ids of the 256 bytes (or the unknown id where there are none)."""

    texts: list[str]
    scores: list[float]
    usable: list[bool]
    bytes_of: list[bytes]
    byte_ids: list[int]
    unknown_score: float

    def beside(self) -> np.ndarray:
        """Whether byte a stands before byte b in any piece of a best path, at a * 256 + b."""
        out = np.zeros(1 << 16, bool)
        for raw, ok in zip(self.bytes_of, self.usable, strict=True):
            if ok:
                x = np.frombuffer(raw, np.uint8).astype(np.int32)
                out[x[:-1] * 256 + x[1:]] = True
        return out

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        return Pieces.of(sentencepiece.SentencePieceProcessor(model_file=path))

    @staticmethod
    def of(model) -> Pieces:
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        for t, ok in zip(texts, usable, strict=True):
            if ok and (SPACE in t.lstrip(SPACE) or "\n" in t and t != "\n"):
                raise ValueError(f"piece {t!r} crosses the border of a word")
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        bytes_of = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else b"" if not usable[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
        lowest = min(s for s, ok in zip(scores, usable, strict=True) if ok) - UNKNOWN_PENALTY
        return Pieces(texts, scores, _on_paths(texts, scores, usable, lowest), bytes_of, byte_ids, lowest)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, code, score): usable pieces, ids as three bytes."""
        rows = [(t, i.to_bytes(3), float(s)) for i, (t, s, ok) in enumerate(zip(self.texts, self.scores, self.usable, strict=True)) if ok]
        return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "code", "score"]), "piece string, code binary, score double")

    def sent(self, df: DataFrame) -> DataFrame:
        """`df`, made of the pieces, marked for broadcast if their bytes fit SENT_PIECES."""
        return F.broadcast(df) if sum(len(t.encode()) + 32 for t in self.texts) <= SENT_PIECES else df


def segment(data: np.ndarray, offsets: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before each row that has any, first byte of each word, hash of each word, rows' first words)."""
    rows = len(offsets) - 1
    some = np.diff(offsets) > 0
    offsets = offsets + np.concatenate([[0], np.cumsum(some)])
    own = np.ones(offsets[-1], bool)
    own[offsets[:-1][some]] = False
    text = np.full(offsets[-1], 32, np.uint8)
    text[own] = data
    before = np.empty_like(text)
    before[:1], before[1:] = 10, text[:-1]
    first = ((text == 32) & (before != 32)) | (text == 10) | (before == 10)
    first[offsets[:-1][some]] = True
    # a character begins here and no piece crosses
    first |= ~beside[(before.astype(np.int32) << 8) | text] & ((text & 0xC0) != 0x80)
    start = np.flatnonzero(first)
    if not len(start):
        return text, start, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    size = np.diff(np.append(start, len(text)))
    h = span_hashes(text, start, size)
    return text, start, h, np.searchsorted(start, offsets)


def words(docs: DataFrame, beside: np.ndarray) -> DataFrame:
    """(hash, word, n): the distinct words of `text` and their counts; a word starts with its spaces. Of two words with one 64-bit hash one stands for both in the end, and round_trip tells so."""

    def merged(held: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        h = np.concatenate([x[0] for x in held])
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        return own, pa.concat_arrays([x[1] for x in held]).take(pa.array(first)), np.bincount(back, weights=np.concatenate([x[2] for x in held])).astype(np.int64)

    def batch_of(own, word, count):
        return pa.record_batch([pa.array(own.view(np.int64)), word, pa.array(count)], names=["hash", "word", "n"])

    def run(batches):
        held, n, before = [], 0, 0
        for batch in batches:
            for _, _, data, offsets in parts(batch.column(0)):
                text, start, h, _ = segment(data, offsets, beside)
                if not len(start):
                    continue
                own, first, count = np.unique(h, return_index=True, return_counts=True)
                end = np.append(start[1:], len(text))
                a, size = start[first], end[first] - start[first]
                cut = np.concatenate([[0], np.cumsum(size)])
                flat = text[np.repeat(a - cut[:-1], size) + np.arange(cut[-1])]
                word = pa.StringArray.from_buffers(len(a), pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))
                held.append((own, word, count))
                n += len(own) + len(flat) // WORD_BYTES
                # merged once the unmerged parts outgrow what is merged, handed on once that is too much
                if n > max(WORDS_COUNTED // 2, 2 * before):
                    own, word, count = merged(held)
                    held, n = [(own, word, count)], len(own) + word.nbytes // WORD_BYTES
                    before = n
                    if n > WORDS_COUNTED:
                        yield batch_of(own, word, count)
                        held, n, before = [], 0, 0
        if held:
            yield batch_of(*merged(held))

    counted = docs.select(F.col("text")).where("text is not null").mapInArrow(lean(run), "hash long, word string, n long")
    return counted.groupBy("hash", "word").agg(F.sum("n").alias("n"))


def _best_path() -> Column:
    """Codes of the best path through `edges` (k = end * 1024 + begin, s score, c code), which come in order of k.

    For each end the state holds the highest sum of scores and its codes; of equal sums the one whose last piece is
    longest stays, since that edge comes first.
    """
    node = "named_struct('s', double(0), 'c', X'')"
    base = "get(a.done, e.k & 1023)"
    return F.expr(
        f"""aggregate(edges, named_struct('done', slice(array({node}), 1, 0), 'cur', {node}, 'at', 0), (a, e) ->
      if(shiftright(e.k, 10) = a.at,
        if({base}.s + e.s > a.cur.s, named_struct('done', a.done, 'cur', named_struct('s', {base}.s + e.s, 'c', concat({base}.c, e.c)), 'at', a.at), a),
        named_struct('done', concat(a.done, array(a.cur)), 'cur', if((e.k & 1023) = a.at,
          named_struct('s', a.cur.s + e.s, 'c', concat(a.cur.c, e.c)),
          named_struct('s', {base}.s + e.s, 'c', concat({base}.c, e.c))), 'at', shiftright(e.k, 10))),
      a -> a.cur.c)"""
    )


def folded(word: str, table: dict[str, tuple[int, float]], most: dict[str, int], pieces: Pieces) -> bytes:
    """The packed ids of a word by the same path as `_best_path`, in memory that grows as the word."""
    w = word.replace(SPACE, _OWN_MARK).replace(" ", SPACE)
    n = len(w)
    score, came, by = array("d", [-np.inf]) * (n + 1), array("q", [0]) * (n + 1), array("q", [-1]) * (n + 1)
    score[0] = 0.0
    for f in range(n):
        own = score[f]
        for t in range(f + 1, min(f + most.get(w[f : f + 2], 1), n) + 1):
            hit = table.get(w[f:t]) or ((-1, pieces.unknown_score) if t == f + 1 else None)
            if hit and own + hit[1] > score[t]:
                score[t], came[t], by[t] = own + hit[1], f, hit[0]
    ids, t = array("q"), n
    while t:
        if by[t] >= 0:
            ids.append(by[t])
        else:
            ids.extend(pieces.byte_ids[b] for b in reversed(w[t - 1].replace(_OWN_MARK, SPACE).encode()))
        t = came[t]
    return np.frombuffer(ids, np.int64)[::-1].astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def lattice(vocabulary: DataFrame, pieces: Pieces) -> DataFrame:
    """(hash, n, packed): ids of each word, three bytes each, by the best path through its lattice of pieces."""
    spark = vocabulary.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def fold(batches):
        own = shared.value
        table = {t: (i, s) for i, (t, s, ok) in enumerate(zip(own.texts, own.scores, own.usable, strict=True)) if ok}
        most: dict[str, int] = {}
        for t in table:
            most[t[:2]] = max(most.get(t[:2], 1), len(t))
        for batch in batches:
            for row in range(batch.num_rows):
                raw = folded(batch.column(2)[row].as_py(), table, most, own)
                yield pa.record_batch([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([raw], pa.binary())], names=["hash", "n", "packed"])

    long = vocabulary.where(F.octet_length("word") > LONG).select("hash", "n", "word").mapInArrow(lean(fold), "hash long, n long, packed binary")
    vocabulary = vocabulary.where(F.octet_length("word") <= LONG)
    tasks = max(1, -(-vocabulary.count() // WORDS_IN_TASK))
    marked = vocabulary.select("hash", "n", F.translate(F.regexp_replace("word", SPACE, _OWN_MARK), " ", SPACE).alias("w"))
    # edges stay in the task of their word; it holds few enough words to group them in memory
    held = marked.repartition(tasks, "hash")
    starts = held.select("hash", "n", "w", F.explode(F.sequence(F.lit(0), F.length("w") - 1)).alias("f"))
    # no substring of three characters or more is longer than the longest piece that begins with its first three
    table = pieces.table(spark)
    heads = table.where(F.length("piece") >= 3).groupBy(F.substring("piece", 1, 3).alias("head")).agg(F.max(F.length("piece")).alias("most"))
    starts = starts.withColumn("head", F.expr("substring(w, f + 1, 3)")).join(pieces.sent(heads), "head", "left")
    spans = starts.select("hash", "n", "w", "f", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("most", F.lit(2)), F.length("w") - F.col("f")))).alias("m"))
    cut = spans.select("hash", "n", "f", "m", F.expr("substring(w, f + 1, m)").alias("piece"))
    # single characters outside the piece table get an edge of their own, spelled in byte pieces
    known = cut.join(pieces.sent(table), "piece", "left").where("code is not null or m = 1")
    codes = ", ".join(f"X'{i.to_bytes(3).hex()}'" for i in pieces.byte_ids)
    spelled = f"""aggregate(transform(array(hex(encode(replace(piece, '{_OWN_MARK}', '{SPACE}'), 'UTF-8'))), x ->
      transform(sequence(0, length(x) div 2 - 1), k -> get(array({codes}), int(conv(substring(x, 2 * k + 1, 2), 16, 10)))))[0], X'', (a, b) -> concat(a, b))"""
    spell = F.when(F.col("code").isNull(), F.expr(spelled)).otherwise(F.col("code"))
    edge = F.struct(((F.col("f") + F.col("m")) * 1024 + F.col("f")).alias("k"), F.coalesce("score", F.lit(float(pieces.unknown_score))).alias("s"), spell.alias("c"))
    best = known.groupBy("hash", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges")).select("hash", "n", _best_path().alias("packed"))
    return best.union(long)


def unpack(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    return (x[:, 0] << 16) | (x[:, 1] << 8) | x[:, 2]


class Table:
    """Ids of a bounded set of words by hash; a word's number is its place in the given order."""

    def __init__(self, hashes: np.ndarray, packed: list[bytes]):
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.ptr = np.concatenate([[0], np.cumsum([len(x) // 3 for x in packed], dtype=np.int64)])
        self.ids = unpack(b"".join(packed))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where the table has none."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        own, back = np.unique(h, return_inverse=True)
        at = np.searchsorted(self.hashes, own).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == own, self.order[at], -1)[back]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered words one after the other, and how many each has."""
        size = self.ptr[at + 1] - self.ptr[at]
        cut = np.cumsum(size) - size
        return self.ids[np.repeat(self.ptr[at] - cut, size) + np.arange(size.sum())], size


def _short() -> Column:
    return F.octet_length("packed") <= 3 * SENT_IDS


def _frequent(coded: DataFrame, most: int) -> tuple[Table, int]:
    """The table of frequent words of at most SENT_IDS ids, commonest first, and the least count of its words: words above the count that at most `most` words reach, from a histogram of counts."""
    seen, least = 0, None
    coded = coded.where(_short())
    # a histogram of the counts' leading digits: some hundred rows, whatever the corpus
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("n")) - 4, F.lit(0)))
    for r in coded.groupBy((F.floor(F.col("n") / step) * step).cast("long").alias("low")).agg(F.count("*").alias("k")).orderBy(F.desc("low")).collect():
        if seen + r.k > most:
            break
        seen, least = seen + r.k, r.low
    if least is None:
        return Table(np.zeros(0, np.uint64), []), 1 << 62
    rows = coded.where(F.col("n") >= least).select("hash", "packed", "n").toArrow()
    order = np.lexsort((rows["hash"].to_numpy(), -rows["n"].to_numpy()))
    rows = rows.take(pa.array(order))
    return Table(rows["hash"].to_numpy().view(np.uint64), rows["packed"].to_pylist()), least


def encode(docs: DataFrame, pieces: Pieces, keep: list[str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """The columns `keep` of `docs` (all by default, `text` not among them) with ids array<int> and round_trip.

    The ids maximise the sum of the model's piece scores, as SentencePiece does for unigram models; where sums are
    equal the path whose last piece is longest wins. A character outside the table is spelled in byte pieces at the
    lowest score less 10. One space is put before the text, as the models have it; no other normalisation is made.
    round_trip tells that the ids decode to the very text. Null texts have null ids and null round_trip; empty ones
    no ids. Words are whole, however long. Repeated rows each give a row; input columns of the new names are
    replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "ids", "round_trip")]
    beside = pieces.beside()
    with batches_of(spark, TEXTS_IN_BATCH):
        vocabulary = save(words(docs, beside), "words")
    release(spark)
    with setting(spark, _HELD, str(WORDS_HELD)):
        packed = save(lattice(vocabulary, pieces), "lattice")
    drop(vocabulary)
    release(spark)
    frequent_words, least = _frequent(packed, frequent)
    table = spark.sparkContext.broadcast(frequent_words)
    rare = packed.where((F.col("n") < least) | ~_short()).select("hash", "packed")

    def numbered(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text's words by number (k for its k-th other word, ranks of the table above those) and the other words' hashes."""
        low = at < 0
        other, back = np.unique(h[low], return_inverse=True)
        number = at + len(other)
        number[low] = back
        return number, other.view(np.int64)

    def missing(batches):
        for batch in batches:
            for row, end, data, offsets in parts(batch.column(1)):
                _, _, h, ptr = segment(data, offsets, beside)
                at = table.value.find(h)
                lists = [np.unique(h[a:b][at[a:b] < 0]).view(np.int64) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(row, end - row), pa.array(lists, pa.list_(pa.int64()))], names=["__key", "others"])

    def known(batches):
        for batch in batches:
            for row, end, data, offsets in parts(batch.column(batch.num_columns - 1)):
                _, _, h, ptr = segment(data, offsets, beside)
                at = table.value.find(h)
                blobs = [_press(numbered(h[a:b], at[a:b])[0]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.record_batch([*[c.slice(row, end - row) for c in batch.columns[:-1]], pa.array(blobs, pa.binary())], names=[*batch.schema.names[:-1], "__blob"])

    # a text's key is its 128-bit digest, so that equal texts share their other words
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(keep)]
    wide = docs.select(*own, F.unhex(F.md5("text")).alias("__key"), "text")
    some = wide.where("text is not null")
    asked = some.select("__key", "text").mapInArrow(lean(missing), "__key binary, others array<long>").select("__key", F.posexplode("others").alias("k", "hash"))
    found = asked.join(rare, "hash").groupBy("__key").agg(F.collect_set(F.struct("k", "packed")).alias("own"))
    with batches_of(spark, TEXTS_IN_BATCH):
        found = save(found.select("__key", F.col("own.k").alias("__ks"), F.col("own.packed").alias("__ids")), "others")
    drop(packed)
    release(spark)
    coded = some.mapInArrow(lean(known), f"{_kinds(wide, 1)}__blob binary").join(found, "__key", "left")
    columns = [*[f"own_{i}" for i in range(len(keep))], "__key", "__blob", "__ks", "__ids"]
    nothing = {"__blob": F.lit(None).cast("binary"), "__ks": F.lit(None).cast("array<int>"), "__ids": F.lit(None).cast("array<binary>")}
    joined = coded.select(*columns).union(wide.where("text is null").withColumns(nothing).select(*columns))
    spell = pieces.bytes_of

    def assemble(batches):
        import hashlib

        for batch in batches:
            for low in range(0, batch.num_rows, PART_ROWS):
                own = batch.slice(low, PART_ROWS)
                k = own.num_columns - 4
                md5, blobs, ks, others = (own.column(i).to_pylist() for i in range(k, k + 4))
                ids, good = [], []
                for r in range(own.num_rows):
                    if md5[r] is None:
                        ids.append(None)
                        good.append(None)
                        continue
                    out = _fill(_unpress(blobs[r]), table.value, ks[r], others[r])
                    ids.append(out)
                    back = b"".join([spell[i] for i in out.tolist()])[1:]
                    good.append(hashlib.md5(back).digest() == md5[r])
                yield pa.record_batch([*own.columns[:k], pa.array(ids, pa.list_(pa.int32())), pa.array(good, pa.bool_())], names=[*own.schema.names[:k], "ids", "round_trip"])

    out = joined.mapInArrow(lean(assemble), f"{_kinds(wide, 2)}ids array<int>, round_trip boolean")
    return out.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)], "ids", "round_trip")


def _kinds(df: DataFrame, without: int) -> str:
    """The columns of `df` but the last ones, for the schema of a mapInArrow."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[:-without])


def _fill(number: np.ndarray, table: Table, ks: list[int] | None, others: list[bytes] | None) -> np.ndarray:
    """Ids of a document from its words' numbers: the smallest are its own other words, each with its ids."""
    if not ks:
        return table.take(number)[0]
    by_k = dict(zip(ks, others, strict=True))
    order = [by_k[k] for k in range(len(by_k))]
    own = Table(np.arange(len(order), dtype=np.uint64), order)
    low = number < len(order)
    size = np.zeros(len(number), np.int64)
    a, size[~low] = table.take(number[~low] - len(order))
    b, size[low] = own.take(number[low])
    out = np.empty(size.sum(), np.int32)
    from_own = np.repeat(low, size)
    out[~from_own], out[from_own] = a, b
    return out


def _press(number: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(number.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpress(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `text`: the pieces' bytes one after the other, less the space put before the text.

    Null ids give null text; ids outside the model or of control pieces add nothing; bytes that are no UTF-8 become
    replacement characters. The input's own `text`, if any, is replaced.
    """
    rest = encoded.drop("text")
    names = [c for c in rest.columns]
    spell = pieces.bytes_of
    place = names.index(ids_col)

    def run(batches):
        for batch in batches:
            texts = []
            for x in batch.column(place).to_pylist():
                raw = None if x is None else b"".join([spell[i] for i in x if i is not None and 0 <= i < len(spell)])
                texts.append(None if raw is None else raw.removeprefix(b" ").decode(errors="replace"))
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{kinds}, text string")
