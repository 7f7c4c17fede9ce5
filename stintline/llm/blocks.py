"""Candidate buckets cut into pairs of bounded blocks, so that a hot bucket is shared by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import save


def bucket_sizes(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Buckets of two members or more, one of those with the very same members; counts are pre-aggregated."""
    sizes = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(member).alias("low"),
        F.bit_xor(F.xxhash64(member)).alias("same"),
    ).where("n > 1")
    picked = sizes.groupBy("n", "low", "same").agg(F.min(F.struct(*keys)).alias("key"))
    return save(picked.select(*[F.col(f"key.{k}").alias(k) for k in keys], "n"), "buckets")


def block_pairs(rows: DataFrame, sizes: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Adds block_a <= block_b and own: every two members of a bucket meet in exactly one (bucket, block_a, block_b).

    A bucket of up to `block` members is one group. A larger one is dealt by hash into blocks, and each member goes
    to the groups of its block with every other, so no group holds more than about two blocks.
    """
    dealt = rows.join(sizes, keys).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        dealt.withColumn("other", other)
        .withColumn("block_a", F.least("own", "other"))
        .withColumn("block_b", F.greatest("own", "other"))
        .drop("other", "blocks", "n")
    )
