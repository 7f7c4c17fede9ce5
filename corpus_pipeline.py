"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm import decontaminate, language, linechunks, minhash, pieces
from stintline.llm.common import batches_of, save
from stintline.llm.queries import MODEL

#: Documents whose language is less sure than this go, and so do those without letters.
LEAST_SCORE = 0.4


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its columns but doc_id and text under names that no operator adds, and those names by the old ones."""
    names = {c: c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]), names


def _back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(new).alias(old) for old, new in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; without a learned language it can only tell letters from none.

    Null, empty and letterless texts go. Null ids and labels, ties and repeated rows are treated row by row; further
    columns, whatever their names, come through as they were. An empty table gives an empty one.
    """
    model = language.train(docs)
    plain, names = _apart(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(plain, model)
    return _back(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines and chunks go; so does a document all of whose text stood at earlier places.

    n_chars, if there, follows the text. Null and empty texts stay. Rows equal in id and text are one document.
    Further columns, whatever their names, come through as they were. An empty table gives an empty one.
    """
    plain, names = _apart(docs)
    out = linechunks.dedup_lines(plain)
    out = out.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    chars = names.get("n_chars")
    if chars:
        out = out.withColumn(chars, F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(chars)))
    return _back(out, names)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of shingles or more in common) stays, that of the smallest id.

    Rows without words, and rows with null ids, have no copies and stay. Rows that repeat an id are one document: all
    stay or go. An empty table gives an empty one.
    """
    return minhash.keep_one(docs, percent=minhash.PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay. Rows equal in id and text are one document; null ids are no obstacle.
    Further columns, whatever their names, come through as they were. An empty table gives an empty one.
    """
    plain, names = _apart(docs)
    # null texts get keys of their own, lest they meet in one task
    key = F.when(F.col("text").isNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit(1))).otherwise(F.xxhash64("doc_id", "text"))
    named = plain.withColumn("__key", key)
    found = decontaminate.contamination(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key")
    hit = save(found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return _back(named.join(hit, "__key", "left_anti"), names)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids, n_pieces and round_trip of each document; `text` goes, input columns of these names are replaced.

    Null texts have null ids and null n_pieces, empty ones none. Repeated rows each give a row. An empty table gives an
    empty one.
    """
    out = pieces.encode(docs, pieces.Pieces.load(MODEL))
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages learn a classifier and fold paths, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with batches_of(spark, pieces.TEXTS_IN_BATCH):
            docs = save(stage(spark, docs, sf_dir), name)
    return docs
